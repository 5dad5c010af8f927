"""Registry of queries, and the model's tables as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
LONG_TODAY, DENSE_TODAY = "2001-07-01", "2024-01-30"

NAMED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
INC = f"""inc AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, n_name AS region, 6 - CAST(left(o_orderpriority, 1) AS INTEGER) AS escalation_level,
  CASE o_orderstatus WHEN 'F' THEN 'military' WHEN 'O' THEN 'unknown' ELSE 'none' END AS category, o_orderpriority || ' ' || c_mktsegment AS title, c_name AS source_name FROM {NAMED})"""
DEN = """den AS (SELECT event_id AS id, ts AS created_at, CAST(ts AS DATE) AS date, 'R' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS region,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS escalation_level, event_type AS title, value, user_id FROM events)"""
EXS = f"""items AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS end_date, max(l_discount) AS most FROM lineitem GROUP BY l_orderkey),
exs AS (SELECT o_orderkey AS id, 'Exercise ' || o_orderkey AS name, CAST(o_orderdate AS DATE) AS start_date, end_date, CAST(floor(o_totalprice / 5) AS INTEGER) AS scale, n_name AS region,
  CASE o_orderstatus WHEN 'F' THEN 'archived-manual' WHEN 'O' THEN 'confirmed' ELSE 'projected' END AS announcement_status, least(most * 20 - 1, 1.0) AS rhetoric_score,
  CASE o_orderkey % 4 WHEN 0 THEN 'NATO/SHAPE' WHEN 1 THEN 'Sweden' WHEN 2 THEN 'Russia' ELSE 'United States' END AS lead_nation,
  CASE o_orderkey % 3 WHEN 0 THEN 'maritime' WHEN 1 THEN 'joint' ELSE 'cyber' END AS domain FROM {NAMED} JOIN items ON l_orderkey = o_orderkey)"""
REP = """rep AS (SELECT doc_id AS id, substring(text, 1, 100) AS title, text AS description, 'doc://' || source || '/' || doc_id AS source_url,
  DATE '2024-01-01' + CAST((doc_id // 20) % 30 AS INTEGER) AS date, source AS region, source AS source_name FROM documents)"""
SER = f"{DEN}, ser AS (SELECT region, date, floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100.0::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE AS ei_score, count(*) AS n FROM den GROUP BY region, date)"


def query(sql: str | None = None):
    """Register a query under its function's name; dates become text, so every engine shows them alike."""

    def add(f: Callable[..., DataFrame]):
        def run(spark, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"
