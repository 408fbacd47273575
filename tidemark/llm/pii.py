"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds are found by fixed patterns. Further spans come from candidates
(broad patterns) on which labelers vote: patterns of form, a gazetteer of
trigger words, and the characters around. Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability; its posteriors are
soft labels for a naive Bayes span classifier on other features, which decides.
The fitted model is one row of bounded size, looked up inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import with_scalar
from ..session import stored
from .common import let

# The contract's patterns (fixed values), made linear: possessive where a class cannot give back,
# and no start inside a run that would have matched from its beginning.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*BASE, "secret", "phone_local", "number", "name"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Candidates of the further kinds; each alternative is one of the kinds, told apart by its form.
CANDIDATE = (
    r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
    r"|(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?:Mr|Mrs|Ms|Dr)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?"
)
# Trigger words (gazetteer), by kind.
TRIGGERS = {
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_ -]?key|key|bearer|credential)\b",
    "phone_local": r"(?i)\b(?:call|phone|tel|telephone|mobile|fax|contact)\b",
    "number": r"(?i)\b(?:ssn|social security|passport|insurance|tax id|account)\b",
    "name": r"(?i)\b(?:name|dear|contact|patient|client|signed|attn)\b",
}
LABELERS = ["form", "gazetteer", "context", "mix"]
FEATURES = ["size", "digits", "before", "after"]
ROUNDS, BEFORE, AFTER = 25, 32, 4


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda m: let(_digits(m), lambda d: F.when(F.char_length(d) <= 19, _luhn(d)).otherwise(F.lit(False))),
    "phone": lambda m: F.char_length(_digits(m)).between(10, 15),
}
NONE = "array<struct<start:bigint,end:bigint,kind:string,text:string>>"


def matches(text: Column, pattern: str, kind: Column) -> Column:
    """All non-overlapping matches from the left: start, end (code points, exclusive), kind, text.

    The gaps between matches give their places; only a text with a match is cut.
    """
    p = F.lit(pattern)

    def placed(m: Column, gaps: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(NONE).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.char_length(F.get(gaps, i))
            e = s + F.char_length(F.get(m, i))
            span = F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), kind.alias("kind"), F.get(m, i).alias("text"))
            return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step, lambda a: a["out"])

    found = lambda m: F.when(F.size(m) == 0, F.array().cast(NONE)).otherwise(let(F.split(text, pattern, -1), lambda g: placed(m, g)))
    return let(F.regexp_extract_all(text, p, F.lit(0)), found)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds whose match passes its check."""

    def checked(kind: str) -> Column:
        return F.filter(matches(text, BASE[kind], F.lit(kind)), lambda x: CHECKS[kind](x["text"]))

    return F.concat(*[checked(k) for k in BASE])


def _kind_of(m: Column) -> Column:
    return (
        F.when(m.rlike("^(?:Mr|Mrs|Ms|Dr)"), "name")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "number")
        .when(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-]"), "phone_local")
        .otherwise("secret")
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _described(text: Column, x: Column) -> Column:
    """A candidate with its kind, votes and features."""
    before = F.substring(text, F.greatest(F.lit(1), x["start"] - BEFORE + 1), F.least(F.lit(BEFORE), x["start"]).cast("int"))
    after = F.substring(text, x["end"] + 1, F.lit(AFTER))

    def tell(kind: Column, b: Column, a: Column) -> Column:
        m = x["text"]
        n = F.char_length(m)
        d = F.char_length(_digits(m))
        trigger = F.lit(False)
        for k, words in TRIGGERS.items():
            trigger = trigger | ((kind == k) & b.rlike(words))
        plain = m.rlike("^[A-Za-z]+$") | m.rlike("^[0-9]+$")
        votes = {
            "form": _vote(F.when(kind == "secret", m.rlike("^[0-9a-f]{32,}$")).otherwise(F.lit(True)), plain),
            "gazetteer": _vote(trigger, ~trigger),
            "context": _vote(b.rlike(r"[:=]\x20?[\"']?$"), b.rlike(r"[A-Za-z0-9]$")),
            "mix": _vote((kind != "secret") | ((d * 5 >= n) & (d < n)), (kind == "secret") & (d * 20 < n)),
        }
        features = {
            "size": F.least(F.floor(F.log2(n)), F.lit(8)).cast("string"),
            "digits": F.floor(4 * d / n).cast("string"),
            "before": F.when(b == "", "none").when(b.rlike(r"[\"'=:]\x20?$"), "mark").when(b.rlike(r"\s$"), "space").otherwise("other"),
            "after": F.when(a == "", "none").when(a.rlike("^[\"']"), "mark").when(a.rlike(r"^\s"), "space").otherwise("other"),
        }
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"),
            F.array(*[votes[v] for v in LABELERS]).alias("votes"),
            F.array(*[F.concat(F.lit(f + "="), features[f]) for f in FEATURES]).alias("features"),
        )

    return let(_kind_of(x["text"]), lambda k: let(before, lambda b: let(after, lambda a: tell(k, b, a))))


def candidates(text: Column) -> Column:
    """Candidate spans with kind, votes (1, 0 for none, -1) and features."""
    return F.transform(matches(text, CANDIDATE, F.lit("")), lambda x: _described(text, x))


# --- estimation -------------------------------------------------------------
def _posterior(state: Column, votes: Column) -> Column:
    """Probability that a candidate with these votes is personal data."""
    yes, no = F.log(state["prior"]), F.log(1 - state["prior"])
    for j in range(len(LABELERS)):
        v, t, f = votes[j], state["hit"][j], state["false"][j]
        yes = yes + F.when(v == 1, F.log(t)).when(v == -1, F.log(1 - t)).otherwise(0.0)
        no = no + F.when(v == 1, F.log(f)).when(v == -1, F.log(1 - f)).otherwise(0.0)
    return 1 / (1 + F.exp(no - yes))


def _m_step(rows: Column, post: Callable[[Column], Column]) -> Column:
    """Prior and rates of the labelers from soft labels, each smoothed by one vote either way."""
    weighed = F.transform(rows, lambda r: F.struct(r["votes"].alias("v"), r["n"].cast("double").alias("n"), (r["n"] * post(r)).alias("p")))
    total = lambda w, of: F.aggregate(w, F.lit(0.0), lambda a, r: a + of(r))

    def rates(w: Column) -> Column:
        part = lambda r, j, val, of: F.when(r["v"][j] == 1 if val else r["v"][j] != 0, of(r)).otherwise(0.0)
        rate = lambda j, of: (total(w, lambda r: part(r, j, True, of)) + 1) / (total(w, lambda r: part(r, j, False, of)) + 2)
        return F.struct(
            ((total(w, lambda r: r["p"]) + 1) / (total(w, lambda r: r["n"]) + 2)).alias("prior"),
            F.array(*[rate(j, lambda r: r["p"]) for j in range(len(LABELERS))]).alias("hit"),
            F.array(*[rate(j, lambda r: r["n"] - r["p"]) for j in range(len(LABELERS))]).alias("false"),
        )

    return let(weighed, rates)


def reliabilities(votes: DataFrame) -> DataFrame:
    """(kind, votes, n) -> one row per kind: prior, hit and false rates of each labeler, by EM.

    A kind has at most 3 ** len(LABELERS) rows. It starts from the share of
    positive votes.
    """
    total = lambda r: F.aggregate(r["votes"], F.lit(0), lambda a, v: a + v)
    first = lambda r: F.when(total(r) > 0, 0.9).when(total(r) < 0, 0.1).otherwise(0.5)
    rows = votes.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("rows"))
    start = rows.withColumn("state", _m_step(F.col("rows"), first))
    fit = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("state"),
        lambda s, i: _m_step(F.col("rows"), lambda r: _posterior(s, r["votes"])),
    )
    return start.withColumn("state", fit)


def fit(described: DataFrame) -> DataFrame:
    """Candidates (kind, votes, features) -> one row: `model`, a map of weights.

    Keys are kind|feature=value and kind| for the prior; each weight is a log
    odds ratio from posterior sums, smoothed.
    """
    counts = described.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "votes")
    rel = reliabilities(counts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))).select("kind", "state")
    soft = counts.join(rel, "kind").withColumn("p", F.round(_posterior(F.col("state"), F.col("votes")), 9))
    each = soft.select("kind", "n", "p", F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("f"))
    sums = each.groupBy("kind", "f").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    prior = sums.where("f = ''").select("kind", F.col("yes").alias("ty"), F.col("no").alias("tn"))
    weight = F.when(F.col("f") == "", F.log((F.col("yes") + 1) / (F.col("no") + 1))).otherwise(
        F.log((F.col("yes") + 1) / (F.col("ty") + 2)) - F.log((F.col("no") + 1) / (F.col("tn") + 2))
    )
    entries = sums.join(prior, "kind").select(F.struct(F.concat_ws("|", "kind", "f").alias("k"), F.round(weight, 6).alias("w")).alias("e"))
    return entries.agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("model"))


def _accepted(cands: Column, model: Column, base: Column) -> Column:
    """Candidates with a positive score that overlap no base span."""
    weight = lambda x, f: F.coalesce(F.element_at(model, F.concat(x["kind"], F.lit("|"), f)), F.lit(0.0))
    score = lambda x: weight(x, F.lit("")) + F.aggregate(x["features"], F.lit(0.0).cast("double"), lambda a, f: a + weight(x, f))
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return F.filter(cands, lambda x: (score(x) > 0) & free(x))


def _slim(spans: Column) -> Column:
    """start, order of kind, end, kind: sorts by start, then kind as listed."""
    order = lambda k: F.array_position(F.lit(KINDS), k)
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `base` and `spans`: sorted arrays of (start, o, end, kind).

    All candidates of all rows fit the model; a second pass finds spans and
    applies it, row by row, so repeated ids and rows need no key. Null text
    counts as empty and has no spans.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    described = docs.select(F.explode(candidates(text)).alias("c")).select("c.kind", "c.votes", "c.features")
    model = stored(fit(described), "pii-model")
    rows = docs.withColumn("_base", base_spans(text)).withColumn("_cand", candidates(text))
    rows = with_scalar(rows, model, "model")
    rows = rows.withColumn("_more", _accepted(F.col("_cand"), F.col("model"), F.col("_base")))
    both = F.concat(_slim(F.col("_base")), _slim(F.col("_more")))
    return rows.withColumns({"base": _slim(F.col("_base")), "spans": F.sort_array(both)}).drop("_base", "_cand", "_more", "model")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans; repeated rows and null ids give a row
    each; an empty table gives none; further columns are left out.
    """
    found = find(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col("`text`").alias("text")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("_id").alias(id_col), *[n(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        )

    end = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, end))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced; the columns of the input, n_chars renewed where there is one."""
    found = find(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns}), "_in_text")
    text = F.when(F.col("_in_text").isNotNull(), redacted(F.col("_in_text"), F.col("spans")))
    out = found.withColumn("_in_text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("_in_n_chars", F.when(F.col("_in_text").isNotNull(), F.char_length("_in_text").cast(kind)).otherwise(F.col("_in_n_chars")))
    return out.select(*[F.col(f"`_in_{c}`").alias(c) for c in docs.columns])
