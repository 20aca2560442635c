"""Run a registered query and its check SQL and compare them as bags of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v))
    if isinstance(v, bool):
        return (2, str(v))
    return (3, str(v))


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_plain(r[i]) for i in order) for r in rows
    )


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want_cols, want = bag(cols, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {str(bad[0])[:1500]}"
    return None
