"""Run a bound query and its SQL twin on the same tables and compare them exactly."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_KIND = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def differences(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    want = con.execute(sql).fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for n, t in df.dtypes:
        if SPARK_KIND.get(t, t) != kinds[n]:
            out.append(f"type of {n}: {t} != {kinds[n]}")
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    got = sorted((tuple(_plain(x) for x in row) for row in df.select(*[f"`{c}`" for c in cols]).collect()), key=_key)
    exp = sorted((tuple(_plain(row[i]) for i in at) for row in want), key=_key)
    if len(got) != len(exp):
        return out + [f"rows {len(got)} != {len(exp)}; spark {got[:2]} sql {exp[:2]}"]
    if not got:
        out.append("both empty")
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        out.append(f"{len(bad)} of {len(got)} rows differ, {cols}: {bad[:2]}")
    return out
