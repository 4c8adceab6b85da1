"""Rows of a query and of its SQL in DuckDB, in a form that compares."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    held = duckdb.connect()
    held.execute("SET TimeZone='UTC'")
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return held


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str([plain(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cursor = database(sf_dir).execute(sql)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cursor.description], cursor.fetchall())
