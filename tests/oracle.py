"""Compare a Spark result with a DuckDB statement over the same Parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    try:
        return float(f"{float(value):.9g}") + 0.0 if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    made = [tuple(plain(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(made, key=repr)


def assert_same(df, db, sql):
    found = db.execute(sql)
    expected = rows_of([c[0] for c in found.description], found.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1]):
        assert a == b
