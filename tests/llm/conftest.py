import pytest

ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one", "en", None),
    (5, "one two", "en", "a"), (6, "one  two\t", "en", "a"), (7, None, None, "b"),
    (8, "mail a.b@c-d.example.org, 10.0.0.256 10.1.2.3 +1 (555) 555-0100; 4111 1111-1111 1111 é 4111111111111112.", "en", "a"),
    (9, "Dr. Ann Lee token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 1.2.3.4.5.6.7.8 x@y x@y.z_q@r.s", "de", "a"),
    (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 tail é", "fr", "c"),
    (11, "head w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22", "fr", "c"),
    (12, "same " * 400, "en", "c"), (13, "same " * 400, "en", "c"), (14, "ab" * 300, "en", "c"),
    (15, "long " + " ".join(f"x{i % 977}y{i}" for i in range(30_000)), "en", "c"),
    (16, "a   b \n c <|endoftext|> it's  I'LL don't x 　 y\x1cz \r\n\n q ", "en", "c"),
    (17, "tail  <|endoftext|>  ", "en", "c"), (18, "日本語のテキスト 123 ٣٤ ½ \U0001f600\U0001f600 é", "ja", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, space-only, repeated, overlapping and very long texts, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    for c in ("id", "n", "fp", "shard", "h", "spans", "base", "model", "grp", "start", "kept", "length"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("n_chars", F.char_length("text").cast("long")).repartition(3)


@pytest.fixture(scope="session")
def corpus(spark):
    """A whole small table, its rows also as a list in id order."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df


def rows(df):
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0]))
