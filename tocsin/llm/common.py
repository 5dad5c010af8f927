"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, below one folder for each application.

    What an application has written there can be deleted as a whole when its results are saved.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/tocsin/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as make it differ from the taken ones in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Have the driver drop its garbage, and with it the shuffle files and broadcasts of plans that nobody holds any more.

    For long series of small jobs: their plans would fill the driver's heap to its end before it collects by itself.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """run for mapInArrow; when a task ends, what its worker has remembered is dropped and free memory goes back to the system.

    Workers outlive tasks and serve later stages, so what one stage keeps would count towards the next.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return whole


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: later reads survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of at most so many rows and bytes of the column (a longer text is a part of its own).

    What a task holds at once thus depends on its longest text, not on how long texts fall together.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        used = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, used + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_bucket(column: str, modulus: int):
    """crc32 of the id's text, modulo: the fold of a row, the same on every engine."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def _with_minimum(edges: DataFrame, salts: int) -> DataFrame:
    """(u, v, m) with m the least v of u; a hub's rows are spread over salts, so no task gets them all."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    spread = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then v is the least id of its component."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    degrees = edges.select(ends.alias("e")).select("e.*").groupBy("x").agg((F.sum("up") + F.when(F.sum("up") > 0, F.max("down")).otherwise(0)).alias("ups"))
    return (degrees.agg(F.max("ups")).first()[0] or 0) <= 1


def connected_components(edges: DataFrame, a: str, b: str, salts: int = 4) -> DataFrame:
    """(id, component) for every id that an edge names; component is its least reachable id.

    Alternating large-star and small-star steps: the number of rounds is
    logarithmic in the longest path, and every step is a join whose hubs are
    salted (and a merge join at any size: many small broadcasts would pile up in the
    driver).  Each round is written to the shared folder, so the lineage stays short; edges that are stars
    already take none.  Edges with a null end and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = cut(now, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, salts).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _with_minimum(large, salts)
        now = cut(star.select("u", F.col("m").alias("v")).unionByName(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        tidy(spark)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged_components(labels: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """labels (id, component) of connected_components after more edges: only components that these tie are gone through again."""
    ends = edges
    for x in (a, b):
        ends = ends.join(labels.select(F.col("id").alias(x), F.col("component").alias(f"{x}_of")).hint("merge"), x, "left")
    ends = ends.select(F.coalesce(f"{a}_of", a).alias("a"), F.coalesce(f"{b}_of", b).alias("b"))
    tied = connected_components(ends, "a", "b")
    moved = labels.join(tied.select(F.col("id").alias("component"), F.col("component").alias("now")).hint("merge"), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return cut(moved.unionByName(tied.join(labels.select("id").hint("merge"), "id", "left_anti").select("id", "component")), "labels")


def id_filter(ids: DataFrame, column: str, bits: int = 23) -> bytes:
    """A bitmap of 2**bits bits (1 MB by default, whatever the input) with the bit of each id's hash set.

    A scan may drop ids whose bit is unset before it shuffles; ids that pass by
    chance are dropped by the exact join that follows.
    """
    spot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
    spots = ids.where(F.col(column).isNotNull()).select(spot.alias("spot"))
    words = spots.selectExpr("spot div 32 AS w", "shiftleft(1L, int(spot % 32)) AS m").groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    got = words.toPandas()
    out[got["w"].to_numpy(dtype=np.int64)] = got["m"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out.tobytes()
