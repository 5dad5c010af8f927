"""The model's tables as views of the given ones; each is one lazy plan over Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions.scoring import half_up


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports of their customer's nation, over some years."""
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    named = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("n_name").alias("region"),
        (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("escalation_level"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'military' WHEN 'O' THEN 'unknown' ELSE 'none' END").alias("category"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_name").alias("source_name"),
    )


def dense_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of twenty regions, over one month."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.to_date("ts").alias("date"),
        F.concat(F.lit("R"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("region"),
        F.expr("CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END").alias("escalation_level"),
        F.col("event_type").alias("title"),
        F.col("value"),
        F.col("user_id"),
    )


def exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as intervals: order date to last shipping."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("end_date"), F.max("l_discount").alias("most"))
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    named = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Exercise "), F.col("o_orderkey")).alias("name"),
        F.to_date("o_orderdate").alias("start_date"),
        "end_date",
        F.floor(F.col("o_totalprice") / 5).cast("int").alias("scale"),
        F.col("n_name").alias("region"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'archived-manual' WHEN 'O' THEN 'confirmed' ELSE 'projected' END").alias("announcement_status"),
        F.least(F.col("most") * 20 - 1, F.lit(1.0)).alias("rhetoric_score"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'NATO/SHAPE' WHEN 1 THEN 'Sweden' WHEN 2 THEN 'Russia' ELSE 'United States' END").alias("lead_nation"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'maritime' WHEN 1 THEN 'joint' ELSE 'cyber' END").alias("domain"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw reports with a title, an address and a day."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 100).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.col("doc_id") / 20) % 30).cast("int")).alias("date"),
        F.col("source").alias("region"),
        F.col("source").alias("source_name"),
    )


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily value of each region: the mean of its events."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))  # whole numbers: the sum doesn't depend on its order
    daily = dense_incidents(spark, sf_dir).groupBy("region", "date").agg(cents.alias("cents"), F.count("*").alias("n"))
    return daily.select("region", "date", half_up(F.col("cents") / (F.col("n") * 100.0), 4).alias("ei_score"), "n")
