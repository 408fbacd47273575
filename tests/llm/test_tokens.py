"""Wavelet shards and the word table against the tokenizer itself."""

import numpy as np
import pyarrow as pa
import pytest
import reference_rules as R

from tidemark.llm import common, wavelet, wordtable


def rows(df):
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0]))


@pytest.fixture(params=["odd", "corpus", "empty"])
def table(request):
    if request.param == "empty":
        return request.getfixturevalue("odd").where("doc_id < 0")
    return request.getfixturevalue(request.param)


def test_wavelet_round_trip(table):
    have = rows(table)
    ids = [x + [2] for x in R.word_ids([t for _, t in have], common.word_tokenizer_path())]
    at = np.cumsum([0] + [len(x) for x in ids])
    want = {d: (int(s), len(x), R.crc(x)) for (d, _), x, s in zip(have, ids, at)}
    assert {r.doc_id: tuple(r)[1:] for r in wavelet.round_trip(table, common.word_tokenizer_path()).collect()} == want


def test_wavelet_small_shards(spark, odd, tmp_path):
    path = str(tmp_path / "w")
    wavelet.write(odd, path, common.word_tokenizer_path(), shard_tokens=50)
    wavelet_rows = spark.read.parquet(path)
    assert wavelet_rows.count() > 3
    a = {r.doc_id: tuple(r) for r in wavelet.read(path, spark).collect()}
    assert a == {r.doc_id: tuple(r) for r in wavelet.round_trip(odd, common.word_tokenizer_path()).collect()}


def test_wavelet_equal_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, None), (None, "a")], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in wavelet.round_trip(df, common.word_tokenizer_path()).collect())
    assert [g[2] for g in got] == [None, None, 1, 1, 1] and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (511, 2), (5000, 40), (3000, 70_000)])
def test_wavelet_queries(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    m = wavelet.Matrix(n, *wavelet.build(ids))
    assert (m.all() == ids).all()
    for i in rng.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == ids[i]
    for t in [0, 1, top - 1, top + 5, 1 << 30, *ids[:20].tolist()]:
        at = np.flatnonzero(ids == t)
        assert m.count(t) == len(at) and m.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [m.select(t, k) for k in range(min(5, len(at)))] == at[:5].tolist() and m.select(t, len(at)) == -1


def test_cached_words():
    texts = ["don't I'LL 'S ''ll é́ İ Σας x\x1cy <|endoftext|>z ªµ §½", "a\tb\x0bc\r\nd  e", "", None]
    c = common.CachedTokenizer(common.word_tokenizer_path(), limit=5)
    assert c.plain
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == R.word_ids(texts, common.word_tokenizer_path())


def test_new_words_of_a_call_go_together():
    path = common.word_tokenizer_path()
    c, calls = common.CachedTokenizer(path), []
    ids = c.model.ids
    c.model.ids = lambda parts: calls.append(len(parts)) or ids(parts)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}, É{i}'LL" for i in range(500)), None, "wab  wab\n", "Łódź µ×'s x<|"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == R.word_ids(texts, path)
    # All parts in one call, none the second time.
    assert len([n for n in calls if n]) == 1 and c.encode([]) == []


@pytest.mark.parametrize("head", [wordtable.HEAD, 40, 0])
def test_word_table(table, head):
    path = common.byte_tokenizer_path()
    have = rows(table)
    ids = R.word_ids([t for _, t in have], path)
    want = {d: (len(x), R.sha(",".join(map(str, x))), R.sha(t or "")) for (d, t), x in zip(have, ids)}
    assert {r.doc_id: tuple(r)[1:] for r in wordtable.round_trip(table, path, head=head).collect()} == want


def test_splitting_as_the_library():
    import random

    from tokenizers import Tokenizer

    path = common.byte_tokenizer_path()
    cut, tok, rng = wordtable.splitter(path), Tokenizer.from_file(path), random.Random(4)
    for _ in range(4000):
        s = "".join(rng.choice(" \n\t\x1c\x85\xa0 'sStlLé1½!?あ") for _ in range(rng.randint(0, 14)))
        mine = [w for c in cut.chunks(s) for w in cut.words(c)]
        assert mine == [s[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(s)], repr(s)


@pytest.mark.parametrize("path", [common.byte_tokenizer_path, common.word_tokenizer_path])
def test_words_in_runs(path):
    """Many words cost one call of the library, with the ids of each word alone."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path())
    # A literal mark of a word's end, and characters that the vocabulary lacks, go one by one.
    plain = [f"word{i}ing" for i in range(25)] + ["a", "é", "!?", "zażółć"]
    letters = common.byte_letters()
    plain = ["".join(map(letters.__getitem__, w.encode())) for w in plain]
    for words in (plain, [*plain, "</w>x", "x</w>"], [*plain, "あ", "aあ"], []):
        m = common.WordModel(tok)
        m.RUN, bare, m.bare = 10, m.bare, type("Counted", (), {"n": 0})()


        def run(texts, **kw):
            m.bare.n += 1
            return bare.encode_batch_fast(texts, **kw)

        m.bare.encode_batch_fast = run
        assert [np.frombuffer(x, "<u4").tolist() for x in m.ids(words)] == [[t.id for t in tok.model.tokenize(w)] for w in words]
        assert m.bare.n == -(-len(words) // 10)


def test_numbered_chunks():
    path = common.byte_tokenizer_path()
    cut = wordtable.splitter(path)
    texts = [None, "", " \t\n", "one", "one  two\t", "a   b \n c <|endoftext|> it's  I'LL don't x 　 y\x1cz \r\n\n q ", "日本語 123 ½ é"]
    texts += ["é\xff a", " x  y", "x <|endoftext|>", " ", "a b a b"]
    found, numbers, ends = cut.numbered(texts)
    assert len(set(found)) == len(found)
    at = [0, *ends.tolist()]
    for t, a, b in zip(texts, at, at[1:]):
        assert [c for c in map(found.__getitem__, numbers[a:b].tolist()) if c] == cut.chunks(t)
    # Usual words, signs behind them too, are told without the pattern.
    assert cut.numbered([])[0] == []
    slow, cut.find = cut.find, None
    try:
        assert cut.words(" été***") == [" été", "***"] and cut.words("Łódź"[1:3]) == ["ód"]
    finally:
        cut.find = slow


def test_head_finds_words_of_high_bytes(spark):
    """Words of non-ASCII letters come from the head, none by the shuffle of holes."""
    path = common.byte_tokenizer_path()
    words = ["été", " naïve", " zażółć", "日本語", "\U0001f600"]
    table = next(wordtable._encode(path)(iter([pa.RecordBatch.from_pydict({"word": words, "n": [1] * len(words)})])))
    blobs = [tuple(c[0].as_py() for c in b.columns) for b in wordtable._pack_head(iter([table]))]
    rows = {r.id: bytes(r.piece) for r in wordtable.pieces(spark, path).collect()}
    head = wordtable.Head(blobs, [rows.get(i, b"") for i in range(max(rows) + 1)])
    assert head.find([*words, "other"]) == [*table.column("ids").to_pylist(), None]


def test_decode(spark):
    path = common.byte_tokenizer_path()
    texts = ["a b  é\U0001f600 <|endoftext|>", "", "x" * 50]
    df = spark.createDataFrame(list(enumerate(R.word_ids(texts, path))), "key long, ids array<int>")
    assert {r.key: bytes(r.decoded).decode() for r in wordtable.decode(df, path).collect()} == dict(enumerate(texts))
