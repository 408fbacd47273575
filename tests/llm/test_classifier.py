"""Hashed word n-grams: held-out accuracy, the update rule and odd inputs."""

import zlib

import numpy as np

from tidemark.llm import classifier as C


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in C.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    test = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([s.predicted == q for q, s in test]) > 0.98
    good = np.array([s.score for q, s in test if q == 1])
    bad = np.array([s.score for q, s in test if q == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert np.mean(good >= 0.3) > 0.99


def test_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(5, 1, "x"), (6, 0, "x"), (6, 1, "x"), (12, None, "x"), (13, 7, "x"), (None, 1, "x"), (999, 1, "x")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in C.classify(odd, labels).collect()}
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got.values())
    assert got[1].score == got[2].score == got[3].score
    assert got[12].score == got[13].score
    none = C.classify(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == odd.count()
    assert C.classify(odd.where("doc_id < 0"), labels).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c")], "doc_id long, text string")
    rows = C.classify(twice, labels).collect()
    assert len(rows) == 3 and [r.held_out for r in rows if r.doc_id is None] == [True, True]


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", C.F.when(C.held_out(C.F.col("doc_id")), 1 - C.F.col("quality")).otherwise(C.F.col("quality")))
    a = {r.doc_id: r.score for r in C.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in C.classify(docs, flipped).collect()}
    assert a == b


def test_bounded_sample(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    chosen = C.label_sample(labels, 100).collect()
    assert len(chosen) == 100 and not any(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in chosen)


def test_update_is_the_textbook_rule():
    """Against a plain dictionary version of FTRL-proximal, example by example."""
    rng = np.random.default_rng(1)
    state, z, n = C.Leader.fresh(), {}, {}
    for _ in range(200):
        at = np.unique(rng.integers(0, 50, 8)).astype(np.int32)
        value = rng.random(len(at)).astype(np.float32)
        label = int(at[0] % 2)
        dot, w = 0.0, {}
        x = {**dict(zip(at.tolist(), value.tolist())), 1 << C.BITS: 1.0}
        for i, v in x.items():
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= C.L1 else -(zi - np.sign(zi) * C.L1) / ((C.BETA + ni**0.5) / C.ALPHA + C.L2)
            dot += w[i] * v
        p = 1 / (1 + np.exp(-dot))
        for i, v in x.items():
            g = (p - label) * v
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / C.ALPHA
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
        state.update(at, value, label)
    for i in z:
        assert abs(state.z[i] - z[i]) < 1e-9 and abs(state.n[i] - n[i]) < 1e-9


def test_vector():
    at, value = C.vector("a a b".encode())
    assert abs(value @ value - 1) < 1e-6 and (np.diff(at) > 0).all()
    assert C.shape("ABC!! Wörter x12") == "A!! T a0"
