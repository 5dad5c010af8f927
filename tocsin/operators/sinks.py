"""Write semantics: upserts, anti-join inserts, constraints, backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import dims


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new whose key isn't among existing; the first of equal keys."""
    first = new.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("n = 1").drop("n")
    return first.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key; new rows win over existing ones, later over earlier."""
    both = existing.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("turn"), F.desc(order))))
    return ranked.where("n = 1").drop("n", "turn")


def upsert_counts(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of new are created, updated, and of existing untouched."""
    marked = existing.select(key).distinct().withColumn("old", F.lit(True)).join(new.select(key).distinct().withColumn("fresh", F.lit(True)), key, "full_outer")
    return marked.agg(F.count_if(F.expr("old is null")).alias("created"), F.count_if(F.expr("old and fresh")).alias("updated"), F.count_if(F.expr("fresh is null")).alias("untouched"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with the names of the rules (SQL predicates) that a row doesn't meet; unknown counts as met, as in a CHECK."""
    names = [F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violated", F.array_compact(F.array(*names)))


#: SQL predicates that a row of each table must meet; unknown counts as met, so NOT NULL is spelled out.
INCIDENT_RULES = {
    "date": "date IS NOT NULL",
    "title": "title IS NOT NULL",
    "category": f"category IN ({', '.join(repr(c) for c in dims.CATEGORIES)})",
    "escalation_level": "escalation_level BETWEEN 1 AND 5",
}
EXERCISE_RULES = {
    "name": "name IS NOT NULL",
    "exercise_type": f"exercise_type IN ({', '.join(repr(c) for c in dims.EXERCISE_TYPES)})",
    "rhetoric_score": "rhetoric_score BETWEEN -1.0 AND 1.0",
}
INDEX_RULES = {"region": "region IS NOT NULL", "date": "date IS NOT NULL", "ei_score": "ei_score IS NOT NULL AND ei_score BETWEEN 0 AND 100"}
CORRELATION_RULES = {"confidence": "confidence BETWEEN 0 AND 1"}


def unique_violations(df: DataFrame, keys: dict[str, list[str]], order: str) -> DataFrame:
    """df (with violated) with the names of unique keys that an earlier row has already; a null key is no key."""
    out = df
    for name, columns in keys.items():
        whole = " and ".join(f"{c} is not null" for c in columns)
        first = df.where(whole).groupBy(*columns).agg(F.min(order).alias("first_row"))
        out = out.join(first, columns, "left").withColumn("violated", F.when(F.col("first_row") < F.col(order), F.array_append("violated", F.lit(name))).otherwise(F.col("violated"))).drop("first_row")
    return out


def archive_unregistered(exercises: DataFrame) -> DataFrame:
    """Exercises that no registry knows get the status archived-manual."""
    return exercises.withColumn("announcement_status", F.when(F.col("registry_id").isNull(), "archived-manual").otherwise(F.col("announcement_status")))


def renamed_with_view(index: DataFrame, old: str, new: str, view: str) -> DataFrame:
    """The table with its column renamed; a temporary view of the old name has the column under both names."""
    out = index.withColumnRenamed(old, new)
    out.withColumn(old, F.col(new)).createOrReplaceTempView(view)
    return out


def purge_preview(rows: DataFrame, ts: str, since: str, order: str, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """What a purge would take: (one row with the count, the newest n rows)."""
    hit = rows.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    return hit.agg(F.count("*").alias("n")), hit.orderBy(F.desc(ts), F.desc(order)).limit(n)


def write_back(rows: DataFrame, verdicts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the verdicts' values where there are any."""
    new = verdicts.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def purge(rows: DataFrame, ts: str, since: str) -> DataFrame:
    """rows without those taken in from a time on."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) < F.lit(since).cast("timestamp")))


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replace the days that df has in a table partitioned by date."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
