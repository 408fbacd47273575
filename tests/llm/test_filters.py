"""Quality, exact and near dedup, personal data, packing and the pipeline against plain rules."""

import math

import numpy as np
import pytest
import reference_rules as R

from tidemark.llm import common, exact, packing, pii, quality, simhash


def rows(df):
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0]))


@pytest.fixture(params=["odd", "corpus", "empty"])
def table(request):
    if request.param == "empty":
        return request.getfixturevalue("odd").where("doc_id < 0")
    return request.getfixturevalue(request.param)


def test_quality_base(table):
    got = {r.doc_id: r[1:7] for r in quality.judge(table).collect()}
    assert got == {d: R.quality(t) for d, t in rows(table)}


def _mcd(x):
    """The estimate of one group in numpy: rows are fixed-point vectors in DIMENSIONS' order."""
    ridge = np.diag([(v * 1000) ** 2 for v in quality.DIMENSIONS.values()])
    k = x.shape[1]
    mid = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(abs(x - mid), axis=0)) ** 2) + ridge

    def d2():
        return np.einsum("ij,jk,ik->i", x - mid, np.linalg.inv(cov), x - mid)

    q = quality.chi2_quantile(quality.SHARE, k)
    for i in range(quality.STEPS + 1):
        b = np.floor(np.log(1 + d2()) * quality.BUCKETS)
        if i < quality.STEPS:
            near, share = b <= np.sort(b)[math.ceil(len(x) * quality.SHARE) - 1], quality.SHARE
        else:
            q = quality.chi2_quantile(0.975, k)
            near, share = b <= math.floor(math.log(1 + q) * quality.BUCKETS), 0.975
        mid = x[near].mean(axis=0)
        cov = np.cov(x[near].T, bias=True) * share / quality.chi2_cdf(q, k + 2) + ridge
    return d2()


def test_quality_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' and source = 'src0'")
    base = {d: R.quality(t) for d, t in rows(docs)}
    fit = {d: b for d, b in base.items() if not b[5]}
    n, c, s, l, r = np.array([b[:5] for b in fit.values()], float).T
    x = np.floor(np.stack([np.log(n), np.log(c / n), np.log(1 + 100 * s / c), np.log(1 + l), np.log(1 + 100 * r / n)], 1) * 1000 + 0.5)
    want = dict(zip(fit, _mcd(x)))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert {d for d, r in got.items() if r.distance is not None} == set(want)
    assert all(abs(got[d].distance - v) < 1e-6 * (1 + v) for d, v in want.items())
    cut = quality.chi2_quantile(1 - quality.TAIL, 5)
    assert all(r.kept == (not r.base_failed and want[d] <= cut) for d, r in got.items())


def test_chi2():
    assert abs(quality.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality.chi2_quantile(0.75, 5) - 6.6257) < 1e-3


def test_exact(table):
    norm = {d: R.re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows(table)}
    groups = {}
    for d, t in norm.items():
        groups.setdefault(t, []).append(d)
    want = {d: (min(groups[t]), len(groups[t]), d == min(groups[t]), R.sha(t)) for d, t in norm.items()}
    assert {r.doc_id: tuple(r)[1:] for r in exact.dedup(table).collect()} == want
    assert {r.doc_id for r in exact.filter_documents(table).collect()} == {d for d, w in want.items() if w[2]}


def test_exact_history_and_strangers(spark):
    """Members take the history's winner, others group among themselves; a hot text is dealt over tasks."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i // 6}") for i in range(1, 3000)] + [(None, "lone")], "doc_id long, text string")
    digest = lambda s: F.unhex(F.sha2(F.lit(s), 256)).alias("digest")
    history = spark.range(1).select(digest("hot"), F.lit(-7).cast("long").alias("winner"), F.lit(2000).cast("long").alias("copies"))
    got = exact.dedup(docs, history).collect()
    assert all(r.keep_id == -7 and not r.kept and r.group_size == 2000 for r in got if r.doc_id and r.doc_id % 3)
    assert all(r.keep_id == 6 * (r.doc_id // 6) or r.keep_id == 3 for r in got if r.doc_id and r.doc_id % 3 == 0)
    lone = [r for r in got if r.doc_id is None]
    assert len(lone) == 1 and lone[0].keep_id is None and lone[0].kept
    rows_ = docs.where("text = 'hot'").select(F.col("doc_id").alias("id"), digest("hot"))
    found = exact.lookup(rows_, exact.build_index(history), per_task=100)
    assert found.count() == rows_.count() and found.where("not member or winner <> -7").count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    s = np.zeros(5000, exact.SLOT)
    s["digest"] = [rng.bytes(31) + b"\x01" for _ in range(5000)]
    s["winner"] = np.arange(5000)
    t = exact.Table(exact.build_table(s))
    at = t.find(s["digest"])
    assert sorted(at) == list(range(5000)) and (t.slots["winner"][at] == np.arange(5000)).all()
    assert (t.find(np.array([rng.bytes(31) + b"\x02" for _ in range(999)], "S32")) == -1).all()


def test_near(table):
    have = rows(table)
    fps = [R.simhash(t) for _, t in have]
    comp = R.components([d for d, _ in have], fps)
    want = {d: (f"{f:016x}", c) for (d, _), f, c in zip(have, fps, comp)}
    assert {r.doc_id: tuple(r)[1:] for r in simhash.near_duplicates(table).collect()} == want


def test_links_lose_nothing(spark):
    """Random clusters of fingerprints, chained and dense, against all pairs."""
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(60):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            g = f
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                g ^= 1 << int(b)
            fps.add(g)
            f = g if rng.random() < 0.3 else f
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [roots.get(x, x) for x in fps]
    assert got == R.components(fps, [x % (1 << 64) for x in fps])


def test_anchors():
    half = np.random.default_rng(2).integers(0, 1 << 32, 300)
    a = simhash.anchors(half)
    code = {int(x) for x in a[:, 0]}
    for h, row in zip(half, a):
        near = {int(x) for x in row if x >= 0}
        assert all(bin(int(h) ^ x).count("1") <= 2 for x in near) and bin(int(h) ^ int(row[0])).count("1") <= 1
        assert {c for c in code if bin(c ^ int(h)).count("1") <= 2} <= near


def test_personal_data(table):
    got = {r.doc_id: r for r in pii.report(table).collect()}
    assert {d: tuple(r)[1:6] for d, r in got.items()} == {d: R.pii(t) for d, t in rows(table)}


def test_personal_data_learns(spark):
    """Hex strings behind trigger words and names are found, plain long words are not."""
    docs = [(i, f'the token = "{R.sha(str(i))[:40]}" is set') for i in range(200)]
    docs += [(i, f"an {'abcdefghij' * 3} extraordinarily {'x' * 25} word") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = pii.report(df).collect()
    assert sum("secret:" in r.spans for r in got) >= 199
    red = pii.redact(df).collect()
    assert sum("<SECRET>" in r.text for r in red) >= 199 and sum("abcdefghij" in r.text for r in red) == 400


def test_redaction(odd):
    got = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert got[1].text is None and got[2].text == "" and got[8].n_chars == len(got[8].text)
    assert got[8].text.startswith("mail <EMAIL>, 10.0.0.256 <IP> <PHONE>; <CARD> é 4111111111111112.")
    assert pii.redact(odd).columns == odd.columns


def test_packing(table):
    path = common.word_tokenizer_path()
    ids = {d: x + [1] for (d, _), x in zip(rows(table), R.word_ids([t for _, t in rows(table)], path))}
    got = packing.pack_documents(table, path).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for d, parts in by.items():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids[d])
        assert all(p.length == 4096 for p in parts[:-1])
        assert all(p.start == 4096 * p.piece and p.ids_crc32 == R.crc(ids[d][p.start : p.start + p.length]) for p in parts)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1]) and sum(r.length for r in s) <= 4096
    if got:
        least = math.ceil(sum(r.length for r in got) / 4096)
        assert len(seqs) <= least * 1.02 + 1


@pytest.mark.parametrize("packer_tokens", [packing.PACKER_TOKENS, 60_000])
def test_packing_does_not_hang_on_partitions(spark, packer_tokens):
    """At most 2 % above the least number, and the same sequences, with few and many partitions; also over many packers and rounds."""
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), common.word_tokenizer_path())
    found = []
    for n in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(n == "8").lower())
        try:
            got = packing.pack(parts.repartition(int(n)), open_bins=64, packer_tokens=packer_tokens).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(got) == len({(r.id, r.piece) for r in got})
        used = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert used.get(r.sequence_id, 0) == r.offset
            used[r.sequence_id] = r.offset + r.length
        assert max(used.values()) <= 4096
        assert len(used) <= math.ceil(sum(used.values()) / 4096) * 1.02 + 1
        found.append(sorted((r.id, r.piece, r.sequence_id, r.offset) for r in got))
    assert found[0] == found[1]


def test_sequences(odd):
    path = common.word_tokenizer_path()
    parts = packing.pack(packing.pieces(odd, path, with_ids=True))
    for r in packing.sequences(parts).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 4 * 4096


def test_packer_bounds():
    p, rng = packing.Packer(4096, 64), np.random.default_rng(5)
    n = np.minimum(4096, rng.lognormal(6, 1, 40_000).astype(int) + 1).tolist()
    used = {}
    for x in n:
        b, off = p.place(x)
        assert off == used.get(b, 0) and off + x <= 4096 and p.count <= 64
        used[b] = off + x
    assert len(used) < sum(n) / 4096 * 1.02 + 64


def test_pipeline(spark, odd):
    import corpus_pipeline as P

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    for start in (odd, odd.where("doc_id < 0"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in P.STAGES[:-1]:
            after = stage(spark, docs, "")
            assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(after.collect(), after.schema)
        texts = rows(docs)
        assert len({R.re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts}) <= len(texts)
        assert all(R.pii(t)[:4] == (0, 0, 0, 0) for _, t in texts)
        packed = P.STAGES[-1][1](spark, docs, "")
        assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in texts}
