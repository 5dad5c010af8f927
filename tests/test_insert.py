"""Inserts against a table, and the streams, against sequential models."""

import datetime as dt
import random

import pytest

from tocsin.operators import cluster as C
from tocsin.operators import insert as N
from tocsin.streaming import ingest as S


def day(n):
    return None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)


def report(rng, k):
    title = rng.choice([None, "", "  ", *(f"title {j}" for j in range(12))])
    return (k, title, rng.choice([None, "a report on Gaza"]), rng.choice([None, "", *(f"u/{j}" for j in range(25))]), rng.choice(["Sahel", "nowhere", None]), "s", 1, day(rng.choice([None, 0, 1, 2, 40])), dt.datetime(2024, 1, 1))


def sequential(rows, held=()):
    """As one insert after the other; returns the ids that are added."""
    hashes, days, urls, added = set(), set(), set(), []
    for r in [*held, *rows]:
        k, title, _, url, *_, date, _ = r
        h = (url or "") + "|" + (title or "")[:100]
        t = (title or "").strip()
        if h in hashes or (t and date and (t, date) in days) or (url and url in urls):
            if r in rows:
                continue
        hashes.add(h)
        if t and date:
            days.add((t, date))
        if url:
            urls.add(url)
        if r in rows:
            added.append(k)
    return added


@pytest.mark.parametrize("seed", [1, 2])
def test_insert_into_a_table_equals_a_loop(spark, tmp_path, seed):
    rng = random.Random(seed)
    held, rows = [report(rng, k) for k in range(30)], [report(rng, 100 + k) for k in range(90)]
    table = spark.createDataFrame(held, S.REPORT)
    N.keyed(table).drop("title_day").write.partitionBy("date").parquet(str(tmp_path / "t"))
    path = str(tmp_path / "t")
    got = N.insert_new(spark.createDataFrame(rows, S.REPORT), S.table_of(spark, path))
    assert sorted(r.id for r in got.collect()) == sequential(rows, held)
    assert {r.region for r in got.collect()} <= {"Sahel", "Gaza & Middle East", "Unknown"}
    assert sorted(r.id for r in N.insert_new(spark.createDataFrame(rows, S.REPORT)).collect()) == sequential(rows)


def test_only_partitions_of_the_days_are_read(spark, tmp_path):
    held = [(k, f"title {k}", None, f"u/{k}", None, "s", 1, day(k % 50), dt.datetime(2024, 1, 1)) for k in range(200)]
    N.keyed(spark.createDataFrame(held, S.REPORT)).drop("title_day").write.partitionBy("date").parquet(str(tmp_path / "t"))
    table = S.table_of(spark, str(tmp_path / "t"))
    new = N.keyed(spark.createDataFrame([(1000, "title 3", None, "new", None, "s", 1, day(3), None), (1001, "title 4", None, "new 2", None, "s", 1, day(5), None)], S.REPORT))
    days = [day(3), day(5)]
    scan = table.where(table.date.isin(days)).select("title", "date")
    assert len(scan.inputFiles()) > 2 and scan.distinct().count() == 8
    files = {r.f for r in scan.selectExpr("input_file_name() as f").distinct().collect()}
    assert {f.rsplit("date=", 1)[1][:10] for f in files} == {str(d) for d in days}
    out = N.unseen(new, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [cast(date") + plan.count("PartitionFilters: [date#") >= 1 and "IN" in plan
    assert [r.id for r in out.collect()] == [1001]
    met = N.possible(table.select("source_url"), "source_url", spark.createDataFrame([(f"u/{k}",) for k in range(5)], "source_url string"))
    assert {f"u/{k}" for k in range(5)} <= {r.source_url for r in met.collect()} and met.count() < 10


def test_exercises_by_name_or_address(spark):
    kinds = "id long, name string, source_url string, start_date date"
    table = spark.createDataFrame([(1, "a" * 200, "u1", day(1)), (2, "beta", "u2", day(2))], kinds)
    new = spark.createDataFrame([(10, "a" * 230, "v", day(1)), (11, "beta", "w", day(9)), (12, "gamma", "u1", day(1)), (13, "gamma", "x", day(3)), (14, None, None, None), (15, None, None, None)], kinds)
    assert sorted(r.id for r in N.insert_absent_exercises(new, table).collect()) == [12, 14, 15]
    assert sorted(r.id for r in N.insert_absent_exercises(new, table, "source_url").collect()) == [10, 11, 13, 14, 15]


@pytest.mark.parametrize("split", [[100], [13, 40, 47], [50, 50]])
def test_stream_of_reports_equals_one_insert(spark, tmp_path, split):
    rng = random.Random(7)
    rows = [report(rng, k) for k in range(100)]
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "table", "state"))
    at = 0
    for size in split:
        spark.createDataFrame(rows[at : at + size], S.REPORT).coalesce(1).write.mode("append").parquet(landing)
        at += size
        S.append_new(spark, landing, target, checkpoint)
    got = sorted(r.id for r in S.table_of(spark, target).collect())
    assert got == sequential(rows) == sorted(r.id for r in N.insert_new(spark.createDataFrame(rows, S.REPORT)).collect())
    S.append_new(spark, landing, target, str(tmp_path / "lost state"))  # the same batches again
    assert sorted(r.id for r in S.table_of(spark, target).collect()) == got


def test_gate_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = sorted((start + dt.timedelta(seconds=rng.randrange(20000)), k, rng.randrange(3)) for k in range(150))
    kinds = "id long, k long, ts timestamp"
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lot in (rows[:50], rows[50:90], rows[90:]):
            spark.createDataFrame([(k, key, t) for t, k, key in lot], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = S.gated_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), 2, 3600)
            query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(name)
    want = C.accept_rate(spark.createDataFrame([(k, key, t) for t, k, key in rows], kinds), "k", "ts", "id", 2, 3600)
    assert {r.id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r.id: r.accepted for r in want.collect()}
