"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def compare(spark, f, sql: str, sf_dir: str) -> str:
    """Empty if rows and columns agree, else what differs."""
    got = f(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(shown(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in want)
    if a == b:
        return ""
    x, y = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"{len(a)} rows against {len(b)}; only here {str(x)[:700]}; only there {str(y)[:700]}"
