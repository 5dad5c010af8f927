"""Incremental ingest: landed reports into a table, each once by all of its keys, and a rate gate with expiring state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tocsin.functions import text as T
from tocsin.operators.insert import insert_new

REPORT = "id long, title string, description string, source_url string, region string, source_name string, escalation_level int, date date, ts timestamp"
TABLE = REPORT.replace("date date, ", "") + ", content_hash string, date date"


def landed(spark: SparkSession, landing: str, files: int = 1000) -> DataFrame:
    """Stream of landed Parquet reports, at most so many files a batch."""
    return spark.readStream.schema(REPORT).option("maxFilesPerTrigger", files).parquet(landing)


def new_reports(spark: SparkSession, landing: str, late: str = "60 days", files: int = 1000) -> DataFrame:
    """landed with each content once, as far as the watermark goes back; reports later than that are dropped."""
    hashed = landed(spark, landing, files).withColumn("content_hash", T.content_hash(F.col("title"), F.col("source_url")))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def table_of(spark: SparkSession, path: str) -> DataFrame:
    """The table of reports, by day; empty if nothing was written yet."""
    try:
        return spark.read.schema(TABLE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLE)


def append_new(spark: SparkSession, landing: str, target: str, checkpoint: str, late: str = "60 days", files: int = 1000) -> None:
    """Take in what has landed since the last run: reports that the table hasn't got, whatever batches they come in.

    A batch that is run again finds its own rows in the table and adds nothing; one that failed while it wrote has
    left no file that a reader sees. Batches follow each other, as reports do inside one by id.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = insert_new(batch, table_of(batch.sparkSession, target))
        new.select(*[c.split()[0] for c in TABLE.split(", ")]).write.mode("append").partitionBy("date").parquet(target)

    query = new_reports(spark, landing, late, files).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    query.awaitTermination()


class Gate(StatefulProcessor):
    """Accepts at most limit events of a key in any trailing window of seconds; rejected ones don't count.

    The state of a key is the times of its last accepted events, at most limit of them; a timer drops it when the
    window has passed since the last one.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        recent = sorted(t[0] for t in self.times.get()) if self.times.exists() else []
        events = pd.concat(list(rows)).sort_values(["ts", "id"])  # of one key and batch; what a trigger takes in bounds it
        verdicts = []
        for t in events["ts"].astype("int64") // 10**6 if str(events["ts"].dtype) == "datetime64[ns]" else events["ts"].astype("datetime64[ms]").astype("int64"):
            recent = [x for x in recent if x > t - self.window]
            verdicts.append(len(recent) < self.limit)
            recent += [t] * verdicts[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recent:
            self.times.put([(int(t),) for t in recent])
            self.handle.registerTimer(int(recent[-1] + self.window))
        else:
            self.times.clear()
        yield pd.DataFrame({"k": [key[0]] * len(events), "id": events["id"].to_numpy(), "accepted": verdicts})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"k": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "accepted": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def gated_stream(events: DataFrame, limit: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """(k, id, accepted) of a stream of events (k, id, ts), as accept_rate decides on all of them; events later than the watermark are dropped.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    keyed = events.withWatermark("ts", late).groupBy("k")
    return keyed.transformWithStateInPandas(Gate(limit, seconds), "k long, id long, accepted boolean", "append", "eventTime")
