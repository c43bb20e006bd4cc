"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def difference(spark_df, con, sql) -> str | None:
    """None when columns, row count and every value agree."""
    relation = con.sql(sql)
    columns = sorted(relation.columns)
    if sorted(spark_df.columns) != columns:
        return f"columns {sorted(spark_df.columns)} != {columns}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    theirs = Counter(
        tuple(_value(v) for v in row)
        for row in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    )
    ours = Counter(
        tuple(_value(v) for v in row) for row in spark_df.select(*columns).collect()
    )
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only ours {list((ours - theirs).items())[:3]}; "
        f"only theirs {list((theirs - ours).items())[:3]}"
    )
