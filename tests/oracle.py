"""Compare a query's rows with its SQL in DuckDB, doubles at five decimals, order ignored."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.5f}".replace("-0.00000", "0.00000")
    if isinstance(value, (list, tuple)):
        return [_norm(v) for v in value]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_norm(row[i]) for i in order]) for row in rows)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def assert_same(df, sql, sf_dir):
    columns, expected = sql_rows(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, df.collect())
    want = rows_of(columns, expected)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want
