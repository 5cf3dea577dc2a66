"""How queries are registered, and the views of the driver's tables that they run on.

A view is one SQL text that Spark and DuckDB both read: ``{name}`` stands for a table. The operators themselves are DataFrame code on the one
side and plain SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    # Cells: parts as a grid of 64 columns, in the countries of the nations.
    "cells": """SELECT p_partkey AS cell_id, CAST(floor(p_partkey / 64.0) AS BIGINT) AS row_no, p_partkey % 64 AS col_no, CAST(p_size AS DOUBLE) AS depth, CAST(1 + p_partkey % 5 AS DOUBLE) AS field,
        CAST((p_partkey * 7) % 130 AS DOUBLE) / 100 AS aridity, CAST(12 AS DOUBLE) AS erosion, CAST(p_partkey % 25 + 1 AS BIGINT) AS country_code, CASE WHEN n_regionkey >= 2 THEN 400 END AS high, p_retailprice AS price, p_type AS kind
        FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25""",
    # Areas of seven crops on the cells: four annual ones, three of them suitable for conservation agriculture.
    "cell_crop": "SELECT l_partkey AS cell_id, concat('C', CAST(l_linenumber AS STRING)) AS crop, sum(l_quantity) AS ta, sum(l_quantity) * 0.5 AS tr FROM {lineitem} GROUP BY l_partkey, l_linenumber",
    "crops": "SELECT concat('C', CAST(k AS STRING)) AS crop, k <= 4 AS annual, k <= 3 AS ca_suitable FROM (SELECT DISTINCT l_linenumber AS k FROM {lineitem}) AS x",
    # Reported areas of countries: in thousands, some 0, some absent.
    "reported": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS country_code, CAST((n_nationkey % 4) * 0.5 AS DOUBLE) AS value FROM {nation} WHERE n_nationkey % 6 <> 5",
    # Observations: events of pixels with a class and a clear-sky score.
    "obs": """SELECT event_id, event_id AS scene_id, ts, user_id AS pixel_id, user_id % 13 AS tile_id, user_id, event_type, value, value / 1000 AS ndvi, CAST(event_id % 12 AS INT) AS scl, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS cs_cdf,
        CAST((event_id * 13) % 100 AS DOUBLE) AS cloudy_pct FROM {events}""",
    # Patches: embeddings as 8 x 8 pixels.
    "predictions": "SELECT doc_id, quality AS y_true, CAST(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS INT) AS y_pred, CAST((doc_id * 31) % 50 AS DOUBLE) / 100 + quality * 0.4 AS p1, toxic FROM {labels} WHERE quality IS NOT NULL",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in re.findall(r"{(\w+)}", text)})


def oracle(body: str, *views: str, doubles: str = "", digits: int = 6) -> str:
    """``body`` after the views it names, with the ``doubles`` rounded."""
    parts = [f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in views]
    head = f"WITH {', '.join(parts)} " if parts else ""
    if doubles:
        swaps = ", ".join(f"round({c}, {digits}) AS {c}" for c in doubles.split())
        return f"{head}SELECT * REPLACE ({swaps}) FROM ({body}) AS body"
    return head + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


def plan(sql: str | None = None, digits: int = 6):
    """Register a query under its function's name; its doubles are rounded to ``digits``."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
