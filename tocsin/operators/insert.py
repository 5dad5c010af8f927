"""Inserting reports into a large table: three keys, pruned by day and by bitmaps before anything is shuffled.

A report is new if the table has neither its content hash, nor its title on its day,
nor its address.  The title is looked up in the partitions of the batch's days only.
Hash and address may be of any day; of these columns the table's rows are first held
against a bitmap of the batch's keys (BUCKETS bitmaps of 4 kB, whatever the batch),
so what is shuffled is hardly more than what can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions import text as T
from tocsin.operators.cluster import keep_first, written

KEYS = ("content_hash", "title_day", "source_url")
#: Bitmaps of BITS bits (what bitmap_construct_agg makes) that a batch's keys are spread over.
BUCKETS, BITS = 256, 32768


def keyed(reports: DataFrame) -> DataFrame:
    """reports with content_hash and title_day; without a title or a date there is no title_day, an empty address is none."""
    title, url = F.trim("title"), F.nullif(F.col("source_url"), F.lit(""))
    day = F.when(title != "", F.concat_ws("|", F.col("date").cast("string"), title))
    return reports.withColumns({"content_hash": T.content_hash(F.col("title"), F.col("source_url")), "title_day": F.when(F.col("date").isNotNull(), day), "source_url": url})


def _spot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS * BITS))


def possible(rows: DataFrame, key: str, batch: DataFrame) -> DataFrame:
    """The rows whose key's bit is set in the bitmap of the batch's keys: all that match, and few others."""
    spot = F.col("_spot")
    spots = batch.where(F.col(key).isNotNull()).select(_spot(F.col(key)).alias("_spot"))
    maps = spots.groupBy(F.floor(spot / BITS).alias("_bucket")).agg(F.bitmap_construct_agg(spot % BITS).alias("_bits"))
    placed = rows.where(F.col(key).isNotNull()).withColumn("_spot", _spot(F.col(key))).withColumn("_bucket", F.floor(spot / BITS))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int(_spot % {BITS} div 8) + 1, 1)")), 16, 10).cast("int")
    met = placed.join(F.broadcast(maps), "_bucket")  # at most BUCKETS rows of 4 kB
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, int(_spot % 8))")) != 0).select(*rows.columns)


def unseen(reports: DataFrame, table: DataFrame) -> DataFrame:
    """Keyed reports that match no row of the table in any key. table: content_hash, title, date, source_url, and more."""
    days = [r.date for r in reports.where("title_day is not null").select("date").distinct().collect()]  # a value a day
    held = keyed(table.where(F.col("date").isin(days)).select("title", "date", "source_url")).select("title_day")
    by_key = {"content_hash": table.select("content_hash"), "source_url": table.select(F.nullif("source_url", F.lit("")).alias("source_url")), "title_day": held}
    for key, known in by_key.items():
        hit = possible(known, key, reports)
        reports = reports.join(hit.withColumnRenamed(key, "_known"), F.col(key) == F.col("_known"), "left_anti")
    return reports


def insert_new(reports: DataFrame, table: DataFrame | None = None, order: str = "id") -> DataFrame:
    """The reports to add: those that the table hasn't got, and of these the first of each key in order, with a canonical region or 'Unknown'."""
    rows = keyed(reports)
    if table is not None:
        rows = written(unseen(rows, table), "unseen")
    kept = keep_first(rows, list(KEYS), order).drop("title_day")
    text = [F.col(c) for c in ("title", "raw_text", "description") if c in reports.columns]
    return kept.withColumn("region", F.coalesce(T.canonicalize(F.col("region")), T.resolve(*text), F.lit("Unknown")))


def insert_absent_exercises(exercises: DataFrame, table: DataFrame, by: str = "name", order: str = "id", size: int = 200) -> DataFrame:
    """The exercises to add, names cut to size: the first of each name (or source_url) that the table hasn't got. A missing one is like no other."""
    new = exercises.withColumn("name", F.substring("name", 1, size)).withColumn("_key", F.col(by))
    fresh = new.where("_key is not null").join(possible(table.select(F.col(by).alias("_key")), "_key", new), "_key", "left_anti")
    first = fresh.groupBy("_key").agg(F.min(order).alias("_first"))
    kept = fresh.join(first, "_key").where(F.col(order) == F.col("_first"))
    return kept.select(*exercises.columns).unionByName(new.where("_key is null").select(*exercises.columns))
