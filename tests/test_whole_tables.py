"""Source and sink queries hold all of their tables and texts."""

import pytest

from tidemark.sources import sinks
from tidemark.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"

def test_nothing_left_out(spark):
    every = lambda name, *c: {tuple(r) for r in QUERIES[name](spark, FOLDER).select(*c).distinct().collect()}
    assert every("src_kv_report", "tag") == {("YEAR",), ("SURVEYBIOMASS",)}
    assert ("ASIA",) in every("sink_split_by_key", "area")
    assert len(every("sink_template_replace", "zone")) == 5
    assert len(every("sink_comp_rows", "bin")) == 66
    assert every("src_terminated_blocks", "block") == {(0,), (1,)}
    years = {y for y, in every("catch_history_splice", "year")}
    # 1994 is in the older series only, 1995 and 1996 are before the splice.
    assert {1994, 1995, 1996} <= years


def test_template_of_many_files(spark):
    lines = spark.createDataFrame([("a", 1, "1"), ("a", 2, "mark"), ("a", 3, "old"), ("b", 1, "5"), ("b", 2, "note"), ("b", 3, "mark")], "file string, n long, value string")
    new = spark.createDataFrame([("a", 9, "new"), ("b", 9, "newer")], "file string, n long, value string")
    out = sinks.replace_after_marker(lines, new, "mark", 1, by=["file"]).collect()
    assert sorted((r.file, r.part, r.n, r.value) for r in out) == [
        ("a", 0, 1, "2"), ("a", 0, 2, "mark"), ("a", 1, 9, "new"), ("b", 0, 1, "6"), ("b", 0, 2, "note"), ("b", 0, 3, "mark"), ("b", 1, 9, "newer"),
    ]
    with pytest.raises(Exception, match="no line matches"):
        sinks.replace_after_marker(lines.where("file = 'a' or n < 3"), new, "mark", 1, by=["file"]).collect()
