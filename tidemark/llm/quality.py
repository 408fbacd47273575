"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Base rules read whole texts inside the row. Outliers: per language and source a
regularised minimum-covariance-determinant estimate (a subset of `share` of the
rows that the concentration steps make as tight as they can) of a transformed
statistic vector; a row whose squared Mahalanobis distance is beyond `cutoff`
is rejected. Statistics are fixed-point integers, so sums are exact and the
result does not depend on the order of rows or on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import SPACES, let, matching_rows, text_digest, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
UNIT = 1000
# Transformed statistics and the spread added to each one's variance, in natural units.
DIMENSIONS = {"length": 0.6, "word_size": 0.12, "symbols": 0.35, "lines": 0.5, "repeats": 0.6}
NAMES = list(DIMENSIONS)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
SHARE, STEPS, MIN_GROUP = 0.75, 4, 50
TAIL = 1e-6
# Distance buckets: BUCKETS per unit of log(1 + d2).
BUCKETS = 64


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function by its power series."""
    if x <= 0:
        return 0.0
    s, t, n = 0.0, 1.0 / math.gamma(k / 2 + 1), 0
    while t > 1e-17 * max(s, 1e-300) or n < x:
        s, n = s + t, n + 1
        t *= (x / 2) / (k / 2 + n)
    return s * math.exp(k / 2 * math.log(x / 2) - x / 2)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words found twice or more, the first one included."""

    def marked(wins: Column) -> Column:
        keyed = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(let(keyed, same), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
        step = lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["to"])).cast("long").alias("n"), (p + WINDOW).alias("to")
        )
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    wins = lambda hs: F.transform(
        F.sequence(F.lit(0), F.size(hs) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(WINDOW)]),
    )
    count = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), marked(w)).otherwise(F.lit(0).cast("long"))
    return let(hashes, lambda hs: F.when(F.size(hs) <= WINDOW, F.lit(0).cast("long")).otherwise(let(wins(hs), count)))


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; null text has none."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.translate(s, SPACES, "") != "")
    long = lambda c: c.cast("long")
    return let(
        F.transform(words(text), lambda w: F.xxhash64(w)),
        lambda hs: F.struct(
            long(F.size(hs)).alias("n_words"),
            long(F.char_length(F.translate(text, SPACES, ""))).alias("word_chars"),
            long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
            let(lines, lambda s: long(F.size(s) - F.size(F.array_distinct(s)))).alias("n_dup_lines"),
            _repeat_words(hs).alias("n_repeat_words"),
        ),
    )


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base statistics and base_failed."""
    s = df.withColumn("_s", base_statistics(F.col(text)))
    s = s.withColumns({n: F.col("_s")[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}).drop("_s")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return s.withColumn("base_failed", failed)


def transformed() -> dict[str, Column]:
    """The statistic vector in fixed point; without words its ratios are null, as a division by zero is an error."""
    n, c = (F.nullif(F.col(k), F.lit(0)).cast("double") for k in ("n_words", "word_chars"))
    value = {
        "length": F.log(n),
        "word_size": F.log(c / n),
        "symbols": F.log(1 + 100 * F.col("n_symbols") / c),
        "lines": F.log(1 + F.col("n_dup_lines").cast("double")),
        "repeats": F.log(1 + 100 * F.col("n_repeat_words") / n),
    }
    return {k: F.floor(v * UNIT + 0.5).cast("long") for k, v in value.items()}


def _factor(center: dict, cov: dict) -> dict[str, Column]:
    """Mean and Cholesky factor as columns c_<name>, l_<a>_<b>, from columns already computed."""
    low: dict = {}
    for i, a in enumerate(NAMES):
        for b in NAMES[: i + 1]:
            rest = cov[a, b]
            for k in NAMES[: NAMES.index(b)]:
                rest = rest - low[a, k] * low[b, k]
            low[a, b] = F.sqrt(rest) if a == b else rest / low[b, b]
    return {f"c_{a}": center[a] for a in NAMES} | {f"l_{a}_{b}": low[a, b] for a, b in PAIRS}


def _distance() -> Column:
    """Squared Mahalanobis distance of a row with the columns of _factor, by forward substitution."""
    z = "array()"
    for i, a in enumerate(NAMES):
        took = "".join(f" - l_{a}_{b} * z[{j}]" for j, b in enumerate(NAMES[:i]))
        z = f"transform(array({z}), z -> concat(z, array(cast((({a} - c_{a}){took}) / l_{a}_{a} AS double))))[0]"
    z = z.replace("array()", "cast(array() AS array<double>)", 1)
    return F.expr(f"aggregate({z}, 0D, (s, x) -> s + x * x)")


def _moments(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(a).alias(f"s_{a}") for a in NAMES],
        *[F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in PAIRS],
    )


def _estimate(m: DataFrame, scale: float) -> DataFrame:
    """Mean and factor of the scaled covariance plus the ridge, one row per group, from moments."""
    n = F.col("n").cast("double")
    mean = m.select("grp", "n", *[(F.col(f"s_{a}") / n).alias(f"c_{a}") for a in NAMES], *[f"q_{a}_{b}" for a, b in PAIRS])
    ridge = {a: (w * UNIT) ** 2 for a, w in DIMENSIONS.items()}
    cov = mean.select(
        "grp",
        *[f"c_{a}" for a in NAMES],
        *[
            ((F.col(f"q_{a}_{b}") / n - F.col(f"c_{a}") * F.col(f"c_{b}")) * scale + (ridge[a] if a == b else 0.0)).alias(f"v_{a}_{b}")
            for a, b in PAIRS
        ],
    )
    return cov.select("grp", *[v.alias(k) for k, v in _factor({a: F.col(f"c_{a}") for a in NAMES}, {p: F.col(f"v_{p[0]}_{p[1]}") for p in PAIRS}).items()])


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and scaled median absolute deviations of each group and statistic, exact.

    Values are counted first: a group has at most as many rows as distinct
    fixed-point values.
    """
    counts = vectors.select("grp", F.explode(F.array(*[F.struct(F.lit(a).alias("dim"), F.col(a).alias("v")) for a in NAMES])).alias("x"))
    counts = counts.groupBy("grp", "x.dim", "x.v").agg(F.count(F.lit(1)).alias("f"))
    mid = counts.groupBy("grp", "dim").agg(F.expr("percentile(v, 0.5, f)").alias("mid"))
    dev = counts.join(mid, ["grp", "dim"]).groupBy("grp", "dim").agg(
        F.first("mid").alias("mid"), F.expr("percentile(abs(v - mid), 0.5, f)").alias("dev")
    )
    wide = dev.groupBy("grp").agg(
        *[F.max(F.when(F.col("dim") == a, F.col("mid"))).alias(f"c_{a}") for a in NAMES],
        *[F.max(F.when(F.col("dim") == a, F.col("dev"))).alias(f"d_{a}") for a in NAMES],
    )
    spread = lambda a: F.sqrt((1.4826 * F.col(f"d_{a}")) ** 2 + (DIMENSIONS[a] * UNIT) ** 2)
    return wide.select(
        "grp",
        *[f"c_{a}" for a in NAMES],
        *[(spread(a) if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in PAIRS],
    )


def robust_estimates(vectors: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """One row per group: center and Cholesky factor of the regularised MCD estimate.

    Concentration steps: sum moments per distance bucket in one pass, keep the
    nearest buckets up to `share` of the rows, estimate again. After the last
    one the rows within the 97.5 % quantile give the reweighted estimate.
    """
    k = len(NAMES)
    q = chi2_quantile(share, k)
    scale = share / chi2_cdf(q, k + 2)
    q_w = chi2_quantile(0.975, k)
    scale_w = 0.975 / chi2_cdf(q_w, k + 2)
    at = stored(_start(vectors), "mcd")
    for i in range(steps + 1):
        near = vectors.join(at, "grp").withColumn("d2", _distance())
        bucket = F.floor(F.log(1 + F.col("d2")) * BUCKETS)
        sums = _moments(near.withColumn("b", bucket), "grp", "b")
        names = [c for c in sums.columns if c not in ("grp", "b")]
        if i < steps:
            w = "PARTITION BY grp ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
            run = sums.selectExpr("*", f"coalesce(sum(n) OVER ({w}), 0) AS before", "sum(n) OVER (PARTITION BY grp) AS total")
            inside = run.where(F.col("before") < F.ceil(F.col("total") * share))
        else:
            inside = sums.where(F.col("b") <= math.floor(math.log(1 + q_w) * BUCKETS))
        total = inside.groupBy("grp").agg(*[F.sum(c).alias(c) for c in names])
        at = stored(_estimate(total, scale if i < steps else scale_w), "mcd")
    return at


def judge(docs: DataFrame, id_col: str = "doc_id", tail: float = TAIL, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: id, base statistics, base_failed, distance (squared) and kept.

    Rows that pass the base rules make the estimates. A language-source group
    of fewer than `min_group` such rows is judged with the other small groups
    of its language; if these are too few as well, distance is null and only
    the base rules count. Null language or source is a value like any other.
    Repeated ids are judged row by row. Empty tables give no rows; empty and
    null texts fail the base rules. Extra columns are left out.
    """
    return _judged(docs, id_col, tail, min_group).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def _judged(docs: DataFrame, id_col: str = "doc_id", tail: float = TAIL, min_group: int = MIN_GROUP, with_key: bool = False) -> DataFrame:
    """judge() with the columns _id, _lang and _src, and _key, the text's digest, where asked for."""
    q = lambda c: F.col(f"`{c}`")
    key = [text_digest(q("text")).alias("_key")] if with_key else []
    base = with_base(docs.select(q(id_col).alias("_id"), q("text").alias("text"), q("lang").alias("_lang"), q("source").alias("_src"), *key))
    base = stored(base.drop("text"), "quality")
    fine = F.to_json(F.struct(F.col("_lang").alias("l"), F.col("_src").alias("s")))
    coarse = F.to_json(F.struct(F.col("_lang").alias("l")))
    fit = base.where(~F.col("base_failed")).withColumns(transformed())
    groups = fit.groupBy("_lang", "_src").agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("grp", F.when(F.col("_n") >= min_group, fine).otherwise(coarse))
    sizes = groups.groupBy("grp").agg(F.sum("_n").alias("_m"))
    groups = groups.join(sizes, "grp").where(F.col("_m") >= min_group)
    groups = stored(groups.select(F.col("_lang").alias("_gl"), F.col("_src").alias("_gs"), "grp"), "groups")
    same = F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_src").eqNullSafe(F.col("_gs"))
    at = robust_estimates(fit.join(groups, same).select("grp", *NAMES))
    d2 = F.when(~F.col("base_failed") & F.col("l_length_length").isNotNull(), _distance())
    out = base.withColumns(transformed()).join(groups, same, "left").join(at, "grp", "left").withColumn("distance", d2)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_quantile(1 - tail, len(NAMES)))
    return out.withColumn("kept", kept)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows that judge() keeps, with all their columns.

    Rows are told apart by id, text, language and source, on which the verdict
    depends, so ids may repeat or be null.
    """
    good = _judged(docs, with_key=True).where("kept").select("_id", "_key", "_lang", "_src").distinct()
    keys = [F.col("doc_id"), text_digest(F.col("`text`")), F.col("lang"), F.col("source")]
    return matching_rows(docs, keys, good, "left_semi")
