"""The filters of the pipeline drop the rows judged, no others of the same or a null id."""

from collections import Counter

import pytest

from tidemark.llm import exact, quality, simhash

GOOD = {k: " ".join(f"{k}word{i * i % 41}{k}" for i in range(30)) for k in "abcdef"}
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def clashing(spark):
    """Null and repeated ids, some rows of which copy the texts of others."""
    rows = [
        (1, "a"), (2, "b"), (None, "a"), (None, "c"), (2, "a"), (3, "d"), (3, "b"), (4, "e"), (None, "f"),
    ]
    return spark.createDataFrame([(i, GOOD[k], "en", None) for i, k in rows], SCHEMA)


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("keep", [exact.filter_documents, simhash.filter_documents])
def test_copies(clashing, keep):
    got = left(keep(clashing))
    assert got == Counter({(i, GOOD[k]): 1 for i, k in ((1, "a"), (2, "b"), (None, "c"), (3, "d"), (4, "e"), (None, "f"))})
    assert keep(clashing).columns == clashing.columns


def test_any_column_names_and_repeated_rows(spark):
    """Columns with the filters' inner names stay, and one of equal rows."""
    rows = [(1, GOOD["a"], 1), (1, GOOD["a"], 2), (1, GOOD["a"].replace(" ", "  ", 1), 3), (None, GOOD["b"], 4), (None, GOOD["b"], 5), (2, GOOD["c"], 6), (None, None, 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("*", "'en' AS lang", "'s' AS source")
    for c in ("_gone", "_gone_text", "_good_id", "_good_key", "_text_key", "_c0", "_k0", "_o0", "id", "key", "root", "kept", "digest"):
        docs = docs.selectExpr("*", f"'{c}' AS `{c}`")
    for keep in (exact.filter_documents, simhash.filter_documents):
        out = keep(docs)
        got = out.collect()
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in docs.columns if c[0] == "_")
        assert Counter(r.doc_id for r in got) == Counter([1, 2, None, None]) and {r.n for r in got} & {1, 2, 3} and 6 in {r.n for r in got}
    good = quality.filter_documents(docs)
    assert good.columns == docs.columns and sorted(r.n for r in good.collect()) == [1, 2, 3, 4, 5, 6]
    assert exact.filter_documents(docs.where("false")).collect() == simhash.filter_documents(docs.where("false")).collect() == []


def test_quality(spark):
    rows = [(1, GOOD["a"]), (1, "too short"), (None, GOOD["b"]), (None, ""), (None, None), (2, GOOD["c"])]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], SCHEMA)
    got = quality.filter_documents(docs)
    assert left(got) == Counter({(1, GOOD["a"]): 1, (None, GOOD["b"]): 1, (2, GOOD["c"]): 1}) and got.columns == docs.columns


def test_quality_by_source(spark):
    """One id and text in two sources, an outlier in one of them."""
    usual = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i % 5)), "en", "short") for i in range(60)]
    long = [(i + 100, " ".join(f"v{i}y{j}" for j in range(60_000 + i % 5)), "en", "long") for i in range(60)]
    odd = (7, " ".join(f"z{j}" for j in range(60_000)), "en")
    docs = spark.createDataFrame(usual + long + [(*odd, "short"), (*odd, "long")], SCHEMA)
    got = quality.filter_documents(docs).select("doc_id", "source").collect()
    verdicts = Counter((r.doc_id, r.kept) for r in quality.judge(docs).select("doc_id", "kept").where("n_words = 60000").collect())
    assert verdicts[7, True] == verdicts[7, False] == 1
    assert Counter(tuple(r) for r in got)[7, "short"] == 1 and (7, "long") in {tuple(r) for r in got} and len(got) == 121


def test_quality_without_words(spark):
    """Texts without words beside a group that gives an estimate fail the base rules, also where a division by zero is an error."""
    usual = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i % 5)), "en", "s") for i in range(60)]
    none = [(100, None), (101, ""), (102, " \t\n"), (None, None)]
    plain, docs = (spark.createDataFrame(x, SCHEMA) for x in (usual, usual + [(i, t, "en", "s") for i, t in none]))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        want = {r.doc_id: tuple(r) for r in quality.judge(plain).collect()}
        got = quality.judge(docs).collect()
        left_over = left(quality.filter_documents(docs))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert {r.doc_id: tuple(r) for r in got if r.n_words} == want and all(r[8] is not None for r in want.values())
    assert Counter(tuple(r) for r in got if not r.n_words) == Counter((i, 0, 0, 0, 0, 0, True, False, None) for i, _ in none)
    assert left_over == Counter({(i, t): 1 for i, t, _, _ in usual})
