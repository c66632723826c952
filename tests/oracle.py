"""Holds a query's rows against those that DuckDB gives for its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def same(spark_df, sf_dir, sql):
    names = sorted(spark_df.columns)
    rows = duck(sf_dir, sql)
    assert not rows or sorted(rows[0]) == names, (sorted(rows[0]), names)
    left = sorted(str([plain(r[n]) for n in names]) for r in (x.asDict() for x in spark_df.collect()))
    right = sorted(str([plain(r[n]) for n in names]) for r in rows)
    assert len(left) == len(right), (len(left), len(right))
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    assert not bad, bad[:3]
