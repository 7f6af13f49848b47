"""Run a registered query and its SQL on the same tables and compare all values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> list[str]:
    """Differences between the two results; empty if they agree."""
    df = query(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    types = {n: str(t).lower() for n, t in zip(names, [d[1] for d in result.description])}
    ours = {n: t for n, t in df.dtypes}
    for name in names:
        sql_type = types[name]
        spark_type = {"int": "integer", "string": "varchar"}.get(ours[name], ours[name])
        if sql_type != spark_type:
            problems.append(f"type of {name}: {ours[name]} vs {sql_type}")
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    right = _rows(names, result.fetchall())
    if len(left) != len(right):
        problems.append(f"{len(left)} rows vs {len(right)}")
    else:
        wrong = [(a, b) for a, b in zip(left, right) if a != b]
        if wrong:
            problems.append(f"{len(wrong)} of {len(left)} rows differ, first: {wrong[0]}")
    return problems
