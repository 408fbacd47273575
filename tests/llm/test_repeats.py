"""Substring and phrase dedup against all windows of small tables."""

import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import reference_rules as R

from tidemark.llm import anchors, phrases, substring


def rows(df):
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0]))


@pytest.fixture(params=["odd", "corpus", "empty"])
def table(request):
    if request.param == "empty":
        return request.getfixturevalue("odd").where("doc_id < 0")
    return request.getfixturevalue(request.param)


def _shuffled(spark, seed, n=60, alphabet=("ab", "c", "dé", "e")):
    """Short texts over few words, so that windows repeat within and across rows in many ways."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(8)]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_substrings(table):
    have = rows(table)
    want = dict(zip([d for d, _ in have], R.bytes_dedup([t for _, t in have])))
    assert {r.doc_id: tuple(r)[1:] for r in substring.dedup(table).collect()} == want


def test_phrases(table):
    have = rows(table)
    want = dict(zip([d for d, _ in have], R.phrase_dedup([t for _, t in have])))
    assert {r.doc_id: tuple(r)[1:] for r in phrases.dedup(table).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_repeats(spark, seed):
    df = _shuffled(spark, seed)
    have = rows(df)
    texts = [t for _, t in have]
    got = substring.dedup(df, filter_bits=1 << 16, batch=3000).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(R.bytes_dedup(texts)))
    got = phrases.dedup(df, filter_bits=1 << 16, batch=3000).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(R.phrase_dedup(texts)))


def test_equal_and_null_ids(spark):
    """The same row twice is one document; a null id comes before all."""
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (4, "x " + t)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in phrases.dedup(df).collect()}
    assert got == {None: 0, 4: 40, 5: 40}
    df = df.where("doc_id = 5")
    assert [r.n_removed for r in phrases.dedup(df).collect()] == [0, 0]
    assert [r.n_removed for r in substring.dedup(df).collect()] == [0, 0]


def test_interval_classes():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (50, 2), (400, 3), (3000, 2)):
        s = np.r_[rng.integers(1, top + 1, n - 1), 0]  # ends in a separator
        for least in (1, 5, 20, 100):
            cls = substring.classes(s, least)
            key = [tuple(s[i : i + least]) for i in range(n)]
            full = [i for i in range(n) if i + least < n]
            assert len({(key[i], cls[i]) for i in full}) == len({key[i] for i in full}) == len({cls[i] for i in full})


def test_sliding_argmin():
    h = np.random.default_rng(2).integers(0, 9, 500).astype(np.uint64)
    for w in (1, 2, 13, 69):
        assert anchors.sliding_argmin(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


def test_positions_sort(spark):
    ids, tie, at = np.array([-(2**62), -5, 0, 2**62, 2**62]), np.array([7, 2**31 - 1, 0, 1, 2**31 - 1]), np.array([0, 2**31 - 1, 3, 9, 2**31 - 1])
    got = [int(x) for x in anchors.position(ids, tie, at).to_pylist()]
    assert got == [int(i) * 2**62 + int(t) * 2**31 + int(a) for i, t, a in zip(ids, tie, at)]
    df = spark.createDataFrame(pa.table({"pos": anchors.position(ids, tie, at)}))
    back = df.select(*[v.alias(k) for k, v in anchors.placed(df["pos"]).items()]).collect()
    assert [tuple(r) for r in back] == list(zip(ids.tolist(), tie.tolist(), at.tolist()))


def _batch(texts, units):
    """All segments of some texts as one batch of the method: (frame, row and place of each window)."""
    out = []
    for i, t in enumerate(texts):
        got = anchors.segments(units, t)
        for h, lo, hi in zip(got[0].view(np.int64).tolist(), got[2].tolist(), got[3].tolist()) if got else ():
            out.append((h, t[lo : hi + units.window], hi - lo + 1, i // 2, i % 2, lo))
    f = pd.DataFrame(out, columns=["h", "content", "starts", "id", "tie", "at"]).sort_values("h", kind="stable")
    # Some rows come twice, as they do where an id and a text repeat.
    f = pd.concat([f, f[::7]]).sort_values("h", kind="stable").reset_index(drop=True)
    starts = f["starts"].to_numpy()
    row = np.repeat(np.arange(len(f)), starts)
    return f, row, np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)


def _by_classes(f, row, s, least):
    """The same through the classes of a whole text of all segments."""
    sizes = f["content"].str.len().to_numpy()
    text = np.concatenate([x for c in f["content"] for x in (np.frombuffer(c, np.uint8).astype(np.int64) + 1, [0])])
    cls = substring.classes(text, least)[(np.cumsum(sizes + 1) - sizes - 1)[row] + s]
    return anchors.not_first(cls, *(f[c].to_numpy()[row] for c in ("id", "tie")), f["at"].to_numpy()[row] + s)


def _passages(seed, n, alphabet=b"abcd \x00\xff", longest=300):
    rng = random.Random(seed)
    made = lambda: bytes(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
    parts = [made() for _ in range(12)]
    return [b"".join(rng.choice((rng.choice(parts), made(), b"ab" * rng.randint(0, 90))) for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("window, gram", [(100, 32), (24, 5), (9, 8), (8, 8)])
def test_backward_extension(window, gram):
    for seed, n in ((1, 4), (2, 12), (3, 60)):
        f, row, s = _batch(_passages(seed, n), substring.units(window, gram))
        got = substring._method(window, gram)(f, row, s)
        assert got.tolist() == _by_classes(f, row, s, window).tolist()
        lead = substring.anchor_places(f["content"].tolist(), f["starts"].to_numpy(), f["h"].to_numpy().view(np.uint64), window, gram, size=500)
        assert all(anchors.segments(substring.units(window, gram), c)[1][0] == x for c, x in zip(f["content"], lead))


def test_backward_extension_without_anchor():
    """A row cut from another text of the same id and hash does not hold its anchor: it has no window to compare."""
    f, row, s = _batch([b"x" * 50 + bytes(range(120)), b"y" * 50 + bytes(range(120))], substring.units())
    f.loc[0, "content"] = bytes(len(f.loc[0, "content"]))
    assert not substring._method(100, 32)(f, row, s)[row == 0].any()


def test_backward_extension_time():
    """A batch of segments takes far less time than sorting all their suffixes."""
    f, row, s = _batch(_passages(4, 300, longest=600), substring.units())
    method, took = substring._method(100, 32), []
    for run in (lambda: method(f, row, s), lambda: _by_classes(f, row, s, 100)):
        t = time.process_time()
        run()
        took.append(time.process_time() - t)
    assert 3 * took[0] < took[1]
