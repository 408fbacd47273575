"""Length and age compositions.

Facts are first summed or counted to (stock..., year, sex, bin): partial sums
run before the shuffle and the rest works on at most sexes x bins rows per
year, so windows and grids stay small whatever the size of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import age_bin, age_bins, length_bin, length_bins
from ..operators.filters import fleet_flag
from ..operators.reshape import complete_grid, pivot_wide, unpivot_long
from ..operators.windows import share_of_total

# Model sex codes: females first (fixed values).
FEMALE, MALE = 1, 2
# Survey sex codes (fixed values).
SURVEY_MALE, SURVEY_FEMALE, SURVEY_UNSEXED = 1, 2, 3
# Fewest hauls for a composition to count; first year with the present design (fixed values).
MIN_HAULS = 15
FIRST_YEAR = 1990


def length_frequencies(
    df: DataFrame, year: Column, sex: Column, length: Column, number: Column, bins: list[int] | None = None, by: dict[str, Column] | None = None
) -> DataFrame:
    """Frequencies by year, sex (1 female, 2 other) and bin; they sum to 1 over a year.

    All bins are present for both sexes, 0 where nothing was seen. Fish without
    a length are in no bin and not in the year's total.
    """
    bins = bins or length_bins()
    by = by or {}
    keys = [*by, "year"]
    counts = df.where(length.isNotNull()).groupBy(
        *[c.alias(n) for n, c in by.items()],
        year.alias("year"),
        F.when(sex == "F", F.lit(FEMALE)).otherwise(F.lit(MALE)).alias("sex"),
        length_bin(length, bins[0], bins[-1], bins[1] - bins[0]).alias("bin"),
    ).agg(F.sum(number).alias("nobs"))
    shares = share_of_total(counts, keys, "nobs", "freq").drop("nobs")
    return complete_grid(shares, keys, {"sex": [FEMALE, MALE], "bin": bins}, {"freq": 0.0})


def length_frequencies_wide_source(
    df: DataFrame, year: str, length_mm: str, males: str, females: str, bins: list[int] | None = None,
    by: list[str] = (),
) -> DataFrame:
    """The same from a table with one number column per sex and lengths in mm.

    Unsexed numbers are left out, and rows without a length. All bins are
    present for both sexes.
    """
    bins = bins or length_bins()
    step = bins[1] - bins[0]
    keys = [*by, "year"]
    binned = df.where(F.col(length_mm).isNotNull()).select(
        *by,
        F.col(year).alias("year"),
        length_bin(F.col(length_mm) / 10.0, bins[0], bins[-1], step).alias("bin"),
        F.col(males).alias("MALES"),
        F.col(females).alias("FEMALES"),
    )
    sums = binned.groupBy(*keys, "bin").agg(F.sum("MALES").alias("MALES"), F.sum("FEMALES").alias("FEMALES"))
    long = unpivot_long(sums, [*keys, "bin"], ["MALES", "FEMALES"], "variable", "nobs")
    shares = share_of_total(long, keys, "nobs", "freq").select(
        *keys, F.when(F.col("variable") == "FEMALES", FEMALE).otherwise(MALE).alias("sex"), "bin", "freq"
    )
    return complete_grid(shares, keys, {"sex": [FEMALE, MALE], "bin": bins}, {"freq": 0.0})


def with_front_matter(
    freq: DataFrame, hauls: DataFrame, bins: list[int], fleet: int, month: int = 7, min_hauls: int | None = MIN_HAULS, by: list[str] = ()
) -> DataFrame:
    """Model rows: front columns, then f<bin> and m<bin>.

    hauls: (by..., year, hauls), joined by year. Fewer than min_hauls turns the
    row off by fleet -1.
    """
    keys = [*by, "year"]
    prefix = F.when(F.col("sex") == FEMALE, F.lit("f")).otherwise(F.lit("m"))
    levels = [f"{p}{b}" for p in "fm" for b in bins]
    wide = pivot_wide(freq, keys, F.concat(prefix, F.col("bin").cast("string")), "freq", levels)
    rules = [(F.col("hauls") < min_hauls, -1)] if min_hauls is not None else []
    joined = wide.join(hauls, keys, "left").withColumn("_fleet", fleet_flag(F.lit(fleet), *rules))
    return joined.selectExpr(
        *by, "year AS yr", f"{month} AS month", "_fleet AS fleet", "3 AS sex", "0 AS part", "hauls AS nsamp", *levels
    )


def caal_long(
    df: DataFrame,
    year: Column,
    sex: Column,
    length_mm: Column,
    age: Column,
    weight: Column,
    lbins: list[int] | None = None,
    abins: list[int] | None = None,
    by: dict[str, Column] | None = None,
) -> DataFrame:
    """Counts of aged fish by year, model sex, length bin and age bin.

    Unsexed fish and fish without age, length or weight are dropped; lengths
    are rounded to whole cm before binning. Every length bin that was met has
    all age bins, 0 where no fish was seen; empty bins do not appear.
    """
    lbins = lbins or length_bins()
    abins = abins or age_bins()
    fish = df.where(
        (sex != SURVEY_UNSEXED) & age.isNotNull() & weight.isNotNull() & length_mm.isNotNull()
    )
    by = by or {}
    counts = fish.groupBy(
        *[c.alias(n) for n, c in by.items()],
        year.alias("year"),
        F.when(sex == SURVEY_FEMALE, F.lit(FEMALE)).when(sex == SURVEY_MALE, F.lit(MALE)).alias("sex"),
        length_bin(F.bround(length_mm / 10.0, 0), lbins[0], lbins[-1], lbins[1] - lbins[0]).alias("lbin"),
        age_bin(age, abins[0], abins[-1]).alias("abin"),
    ).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("sex").isNotNull())
    return complete_grid(counts, [*by, "year", "sex", "lbin"], {"abin": abins}, {"n": 0})


def caal_rows(
    long: DataFrame, abins: list[int] | None = None, fleet: int = 2, month: int = 7, first_year: int = FIRST_YEAR,
    by: list[str] = (),
) -> DataFrame:
    """Model rows of conditional ages: Nsamp is the row total, the vector stands twice."""
    abins = abins or age_bins()
    cells = [f"a{a}" for a in abins]
    key = F.concat(F.lit("a"), F.col("abin").cast("string"))
    wide = pivot_wide(long, [*by, "year", "sex", "lbin"], key, "n", cells, combine="sum", fill=0)
    total = "+".join(cells)
    flagged = wide.withColumn("_fleet", fleet_flag(F.lit(fleet), (F.col("year") < first_year, -fleet)))
    return flagged.where(F.expr(f"{total} > 0")).selectExpr(
        *by,
        "year AS yr",
        f"{month} AS month",
        "_fleet AS fleet",
        "sex",
        "0 AS part",
        "1 AS ageerr",
        "lbin AS lbin_lo",
        "lbin AS lbin_hi",
        f"{total} AS nsamp",
        *[f"a{a} AS {p}{a}" for p in "fm" for a in abins],
    )


def age_marginal(
    df: DataFrame, year: Column, sex: Column, age: Column, number: Column, abins: list[int] | None = None,
    by: dict[str, Column] | None = None,
) -> DataFrame:
    """Proportions by year over both blocks; sex 1 is male, every other code female."""
    abins = abins or age_bins()
    by = by or {}
    keys = [*by, "year"]
    rows = df.select(*[c.alias(n) for n, c in by.items()], year.alias("year"), sex.alias("_s"), age_bin(age, abins[0], abins[-1]).alias("bin"), number.alias("_n"))
    rows = rows.dropna(subset=["year", "_s", "bin", "_n"])
    sums = rows.groupBy(
        *keys, F.when(F.col("_s") == SURVEY_MALE, F.lit(MALE)).otherwise(F.lit(FEMALE)).alias("sex"), "bin"
    ).agg(F.sum("_n").alias("nobs"))
    shares = share_of_total(sums, keys, "nobs", "freq").drop("nobs")
    return complete_grid(shares, keys, {"sex": [FEMALE, MALE], "bin": abins}, {"freq": 0.0})


def age_marginal_rows(freq: DataFrame, hauls: DataFrame, abins: list[int] | None = None, fleet: int = -2, month: int = 7, by: list[str] = ()) -> DataFrame:
    """Model rows of marginal ages: female ages as 1.., male ages as 101.. columns."""
    abins = abins or age_bins()
    male = F.when(F.col("sex") == MALE, F.lit("p10")).otherwise(F.lit("p"))
    levels = [f"p{a}" for a in abins] + [f"p10{a}" for a in abins]
    wide = pivot_wide(
        freq, [*by, "year"], F.concat(male, F.col("bin").cast("string")), "freq", levels, combine="sum", fill=0.0
    )
    return wide.join(hauls, [*by, "year"]).selectExpr(
        *by,
        "year AS yr",
        f"{month} AS month",
        f"{fleet} AS fleet",
        "3 AS sex",
        "0 AS part",
        "1 AS ageerr",
        "-1 AS lbin_lo",
        "-1 AS lbin_hi",
        "hauls AS nsamp",
        *levels,
    )


def sample_sizes(sources: dict[str, DataFrame], by: list[str] = ()) -> DataFrame:
    """Total sample size by year, fleet, sex and model source; fleet -2 is left out."""
    out = None
    for name, df in sources.items():
        one = df.select(*by, "year", "fleet", "sex", "nsamp", F.lit(name).alias("src"))
        out = one if out is None else out.unionByName(one)
    return (
        out.where(F.col("fleet") != -2)
        .groupBy(
            *by,
            "year",
            F.when(F.col("fleet") == 1, "Fishery").otherwise("Survey").alias("fleet"),
            F.when(F.col("sex") == 1, "Female").otherwise("Male").alias("sex"),
            "src",
        )
        .agg(F.sum("nsamp").alias("total_nsamp"))
    )


def reweight_harmonic(df: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """Effective sample sizes and their ratio to the input sizes.

    df: (by..., row..., obs, exp, n), one line per bin. Per row
    effN = sum p(1-p) / sum (o-p)^2; the multiplier is the mean of effN / n.
    """
    per_row = df.groupBy(*by, *row).agg(
        F.max("n").alias("_n"),
        F.try_divide(
            F.sum(F.col("exp") * (1 - F.col("exp"))), F.sum(F.pow(F.col("obs") - F.col("exp"), F.lit(2.0)))
        ).alias("_eff"),
    )
    return per_row.groupBy(*by).agg(
        F.avg("_eff").alias("mean_eff_n"),
        F.avg("_n").alias("mean_input_n"),
        F.avg(F.try_divide(F.col("_eff"), F.col("_n"))).alias("mi_mult"),
    )


def _bin_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Observed and expected mean bin and expected variance per composition row."""
    b = F.col("bin").cast("double")
    return df.groupBy(*keys).agg(
        F.max("n").alias("_n"),
        F.try_divide(F.sum(F.col("obs") * b), F.sum("obs")).alias("_mo"),
        F.try_divide(F.sum(F.col("exp") * b), F.sum("exp")).alias("_me"),
        F.try_divide(F.sum(F.col("exp") * b * b), F.sum("exp")).alias("_m2"),
    )


def reweight_francis(df: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """1 / variance of standardised mean-bin residuals over composition rows."""
    m = _bin_moments(df, [*by, *row])
    spread = F.sqrt(F.try_divide(F.greatest(F.col("_m2") - F.col("_me") * F.col("_me"), F.lit(0.0)), F.col("_n")))
    resid = m.withColumn("_z", F.try_divide(F.col("_mo") - F.col("_me"), spread))
    return resid.groupBy(*by).agg(F.try_divide(F.lit(1.0), F.var_samp("_z")).alias("francis_mult"))


def mean_bin(df: DataFrame, by: list[str], sample: str | None = None, z: float = 1.96) -> DataFrame:
    """Mean bin weighted by number with limits from the sample size.

    df: (by..., bin, number). The sample size is the number total, or the
    maximum of the column `sample`.
    """
    b, n = F.col("bin").cast("double"), F.col("number")
    m = df.groupBy(*by).agg(
        F.sum(n).alias("_t"), F.sum(n * b).alias("_s1"), F.sum(n * b * b).alias("_s2"),
        (F.max(sample) if sample else F.sum(n)).alias("n"),
    )
    mean = F.try_divide(F.col("_s1"), F.col("_t"))
    var = F.greatest(F.try_divide(F.col("_s2"), F.col("_t")) - mean * mean, F.lit(0.0))
    half = F.lit(z) * F.sqrt(F.try_divide(var, F.col("n")))
    return m.select(*by, "n", mean.alias("mean_bin"), (mean - half).alias("lower"), (mean + half).alias("upper"))


def pearson(df: DataFrame) -> DataFrame:
    """(obs - exp) / sqrt(exp (1 - exp) / n) per bin."""
    sd = F.sqrt(F.try_divide(F.col("exp") * (1 - F.col("exp")), F.col("n")))
    return df.withColumn("pearson", F.try_divide(F.col("obs") - F.col("exp"), sd))


def multinomial_fit(df: DataFrame, by: list[str], delta: float = 1e-5) -> DataFrame:
    """Sum of n * p * log(expected), both proportions raised by a small delta."""
    term = F.col("n") * (F.col("obs") + F.lit(delta)) * F.log(F.col("exp") + F.lit(delta))
    return df.groupBy(*by).agg(F.sum(term).alias("loglik"))


def haul_counts(
    df: DataFrame, year: Column, haul: Column, by: dict[str, Column] | None = None, approx: bool = False
) -> DataFrame:
    """(by..., year, hauls): distinct hauls, exact unless approx is asked for."""
    keys = [c.alias(n) for n, c in (by or {}).items()]
    return df.groupBy(*keys, year.alias("year")).agg(
        (F.approx_count_distinct(haul) if approx else F.count_distinct(haul)).alias("hauls")
    )
