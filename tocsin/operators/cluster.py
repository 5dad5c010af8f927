"""Greedy clustering in one sweep over similar pairs, and sequential deduplication as iterated aggregates.

Both keep an item if no earlier kept item conflicts with it.  Titles conflict
within a region and at most a day apart, so a region's days fall into chains that
pairs across midnight tie together; each chain is swept once, in order, and what it
has to know is which titles of the last two days aren't kept.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tocsin.operators import fuzzy
from tocsin.operators.fuzzy import title_score as token_similarity_of

#: Pairs of a row that are fetched at once by a sweep.
LOOKED_AT = 64


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/tocsin/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share, and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@F.pandas_udf(DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Title similarity 0..100 of two columns."""
    return pd.Series([token_similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _filled(items: DataFrame, text: str) -> DataFrame:
    """(id, region, date, t) of the rows that have a text."""
    filled = F.col(text).isNotNull() & (F.trim(F.col(text)) != "") if dict(items.dtypes)[text] == "string" else F.size(text) > 0
    return items.where(filled).select(F.col("id").cast("long").alias("id"), "region", "date", F.col(text).alias("t"))


def dated_pairs(items: DataFrame, text: str = "title", scorer: fuzzy.Scorer = fuzzy.title_scores, least: float = 70.0) -> DataFrame:
    """(region, day, gap, a, b, similarity) of similar rows of a region: b is of the day, a of the same (gap 0) or of the day before (gap 1)."""
    base = _filled(items, text).where("date is not null and region is not null")
    largest, pairs = fuzzy.cell_sizes(base, ["region", "date"])
    today, tomorrow = F.col("date"), F.date_add("date", 1)
    cell = lambda day, gap, part: F.struct(day.alias("day"), F.lit(gap).alias("gap"), F.lit(part).alias("part"))
    cells = F.array(cell(today, 0, fuzzy.BOTH), cell(today, 1, fuzzy.RIGHT), cell(tomorrow, 1, fuzzy.LEFT))
    rows = base.select("id", "t", "region", F.inline(cells))
    return fuzzy.block_join(rows, ["region", "day", "gap"], scorer, least, largest=2 * largest, pairs=3 * pairs)


def undated_pairs(items: DataFrame, text: str = "title", scorer: fuzzy.Scorer = fuzzy.title_scores, least: float = 70.0, earlier: DataFrame | None = None) -> DataFrame:
    """(region, kind, a, b, similarity): similar rows b without a date and a of the region; kind 0: a has one, 1: neither has.

    earlier: ids of the rows with a date to look at, all if left out.
    """
    base = _filled(items, text).where("region is not null")
    dated, undated = base.where("date is not null"), base.where("date is null")
    dated = dated.join(undated.select("region").distinct(), "region", "left_semi")  # elsewhere nothing meets them
    if earlier is not None:
        dated = dated.join(earlier.select("id"), "id", "left_semi")
    kind = lambda df, k, part: df.select("id", "t", "region", F.lit(k).alias("kind"), F.lit(part).alias("part"))
    rows = kind(dated, 0, fuzzy.LEFT).unionByName(kind(undated, 0, fuzzy.RIGHT)).unionByName(kind(undated, 1, fuzzy.BOTH))
    return fuzzy.block_join(rows, ["region", "kind"], scorer, least)


def similar_pairs(items: DataFrame, text: str = "title", scorer: fuzzy.Scorer = fuzzy.title_scores, least: float = 70.0) -> DataFrame:
    """(a, b, similarity) within a region and a day of each other, a before b by (date, id), rows without a date last.

    A row without a date is close to every one of its region. Empty texts are similar
    to nothing, rows without a region neither. Pairs of blocks are joined, see ``fuzzy``.
    """
    items = items.where("region is not null")
    pairs = dated_pairs(items, text, scorer, least).select("a", "b", "similarity")
    return pairs.unionByName(undated_pairs(items, text, scorer, least).select("a", "b", "similarity"))


def sweep(pairs: DataFrame) -> DataFrame:
    """(id, rep, rep_day) of the rows that aren't kept: rep is the first kept row before one, by (day, id).

    pairs: region, day (of b), gap, a, b as of dated_pairs. Days that a pair ties to the day before form a chain; each
    chain is streamed through a task once, in order, whatever its length.
    """
    days = pairs.groupBy("region", "day").agg(F.max("gap").alias("tied"))
    over = Window.partitionBy("region").orderBy("day")
    goes_on = (F.col("tied") == 1) & (F.datediff("day", F.lag("day").over(over)) == 1)
    chains = days.withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(over)).select("region", "day", "chain")
    order = ["region", "chain", "day", "b", F.desc("gap"), "a"]
    ready = pairs.join(chains, ["region", "day"]).repartition("region", "chain").sortWithinPartitions(*order)
    ready = ready.select("region", "chain", F.unix_date("day").alias("day"), "gap", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, today, now, before = None, None, set(), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            days, gaps, firsts, rows = (batch[k].to_numpy() for k in range(2, 6))
            heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (days[1:] != days[:-1])))  # a row b after the other, with all pairs of it
            named = [batch[k].take(pa.array(heads)).to_pylist() for k in (0, 1)]
            ids, reps, days_of = [], [], []
            for r, c, d, b, start, end in zip(*named, days[heads].tolist(), rows[heads].tolist(), heads.tolist(), np.append(heads[1:], len(rows)).tolist(), strict=True):
                if (r, c) != chain:
                    chain, today, now, before = (r, c), d, set(), set()
                elif d != today:
                    before, now, today = now if d == today + 1 else set(), set(), d
                if b in now:
                    continue
                for at in range(start, end, LOOKED_AT):  # mostly one of the first is kept
                    part = slice(at, min(at + LOOKED_AT, end))
                    hit = next(((a, gap) for a, gap in zip(firsts[part].tolist(), gaps[part].tolist(), strict=True) if a not in (before if gap else now)), None)
                    if hit:
                        now.add(b)
                        ids.append(b)
                        reps.append(hit[0])
                        days_of.append(d - hit[1])
                        break
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), pa.array(days_of, pa.int32()).cast(pa.date32())], names=["id", "rep", "rep_day"])

    return ready.mapInArrow(run, "id long, rep long, rep_day date")


def _undated_reps(nodes: DataFrame, dropped: DataFrame, **options) -> DataFrame:
    """(id, rep, rep_day) of the rows without a date that aren't kept: they come last, and look at all kept rows of their region."""
    kept = nodes.where("date is not null").join(dropped, "id", "left_anti")
    pairs = written(undated_pairs(nodes, earlier=kept, **options), "undated")
    first = F.min_by("a", F.struct("date", "a"))
    taken = written(pairs.where("kind = 0").join(kept.select(F.col("id").alias("a"), "date"), "a").groupBy(F.col("b").alias("id")).agg(first.alias("rep"), F.min("date").alias("rep_day")), "taken")
    among = pairs.where("kind = 1").join(taken.select(F.col("id").alias("b")), "b", "left_anti").join(taken.select(F.col("id").alias("a")), "a", "left_anti")
    among = among.select("region", F.lit("1970-01-01").cast("date").alias("day"), F.lit(0).alias("gap"), "a", "b")
    return taken.unionByName(sweep(among).withColumn("rep_day", F.lit(None).cast("date")))


def title_nodes(items: DataFrame) -> DataFrame:
    """region, date, title, n, level and id (least) of the distinct titles of a region and day, written.

    Equal titles of a region and day always share their cluster (whatever takes the
    first takes the others), so they are one item from the start. Empty titles, and
    rows without a region, are items of their own.
    """
    own = "if(title is null or trim(title) = '' or region is null, id, null)"
    rows = items.withColumn("own", F.expr(own))
    return written(rows.groupBy("region", "date", "title", "own").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max(F.coalesce("escalation_level", F.lit(1))).alias("level")).drop("own"), "titles")


def event_members(nodes: DataFrame, undated: bool | None = None, **options) -> DataFrame:
    """title_nodes with rep (the item that stands for the cluster) and rep_day (its day).

    undated: whether there are items without a date; looked up if left out.
    """
    dropped = sweep(written(dated_pairs(nodes, **options), "pairs"))
    if undated is None:
        undated = bool(nodes.where("date is null").take(1))
    if undated:
        dropped = written(dropped, "members")
        dropped = dropped.unionByName(_undated_reps(nodes, dropped, **options))
    joined = nodes.join(dropped, "id", "left")
    return joined.withColumn("rep_day", F.when(F.col("rep").isNull(), F.col("date")).otherwise(F.col("rep_day"))).withColumn("rep", F.coalesce("rep", "id"))


def events_of(members: DataFrame) -> DataFrame:
    """region, rep_id, date, severity, corroboration and title of each greedy cluster, and the same two of its first day.

    first_severity and first_corroboration count the members of the event's own day
    only: what was known of it on that day. A cluster's other members are a day later.
    """
    longest = F.max_by("title", F.struct(F.length("title"), F.col("date").isNotNull(), -F.unix_date("date"), -F.col("id")))
    now = F.expr("date <=> rep_day")
    return members.groupBy("region", F.col("rep").alias("rep_id")).agg(
        F.min("date").alias("date"), F.max("level").alias("severity"), F.sum("n").alias("corroboration"), longest.alias("title"),
        F.max(F.when(now, F.col("level"))).alias("first_severity"), F.sum(F.when(now, F.col("n"))).alias("first_corroboration"),
    )


def event_clusters(items: DataFrame, **options) -> DataFrame:
    """The events of reports, see ``events_of``."""
    return events_of(event_members(title_nodes(items), **options))


def changed_cells(items: DataFrame, new: DataFrame) -> DataFrame:
    """(region, date) of the cells whose clusters new rows may change.

    A cluster spans a day and the next, so runs of days with reports in a region have
    nothing to do with each other; only runs that a new report falls into (or joins)
    change. Reports without a date belong to any event of their region: where there are
    some, all cells of a region that gets new reports change.
    """
    days = items.select("region", "date").unionByName(new.select("region", "date")).distinct()
    over = Window.partitionBy("region").orderBy(F.asc_nulls_last("date"))
    runs = days.withColumn("run", F.sum(F.coalesce((F.datediff("date", F.lag("date").over(over)) > 1).cast("int"), F.lit(0))).over(over))
    runs = runs.withColumn("open", F.max(F.col("date").isNull()).over(Window.partitionBy("region")))
    runs = runs.withColumn("run", F.when(F.col("open"), 0).otherwise(F.col("run")))
    hit = runs.join(new.select(F.col("region").alias("r"), F.col("date").alias("d")).distinct(), F.expr("region <=> r and date <=> d"), "left_semi").select(F.col("region").alias("r"), F.col("run").alias("k")).distinct()
    return runs.join(hit, F.expr("region <=> r and run = k"), "left_semi").select("region", "date")


def within_cells(df: DataFrame, cells: DataFrame, how: str) -> DataFrame:
    """The rows of df in (left_semi) or outside (left_anti) the cells, nulls counting as equal."""
    return df.join(cells.select(F.col("region").alias("_r"), F.col("date").alias("_d")), F.expr("region <=> _r and date <=> _d"), how)


def recluster(items: DataFrame, new: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, cells): the events of items and late new reports, and the (region, date) cells that may have changed.

    Only the changed cells are clustered again. The index has to be revised from each changed day on, see ``index.revised``.
    """
    cells = written(changed_cells(items, new), "cells")
    again = event_clusters(within_cells(items.unionByName(new), cells, "left_semi"))
    return within_cells(events, cells, "left_anti").unionByName(again.select(*events.columns)), cells


def keep_first(items: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Rows that no earlier kept row matches in any non-null key, in sequence.

    Keys form cliques: each round compares a row with its key's first open or kept
    row only, by aggregates, so no pairs of a key's rows are made.
    """
    left = written(items.select(order, *keys), "open")
    kept = left.limit(0)
    while left.take(1):
        first = None
        for k in keys:
            least = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"first_{k}"))
            first = (left if first is None else first).join(least, k, "left")
        test = " and ".join(f"(first_{k} is null or first_{k} = {order})" for k in keys)
        new = written(first.where(test).select(order, *keys), "first")
        kept = kept.unionByName(new)
        rest = left.join(new.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(new.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        left = written(rest, "open")
    return items.join(kept.select(order), order, "left_semi")


def accept_rate(times: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """times with accepted: at most limit accepted rows of a key in any trailing window; rejected ones don't count.

    The state of a key is its last accepted times, at most limit of them, so rows
    are streamed in order through each partition: a hot key needs no memory.
    """
    ready = times.repartition(key).sortWithinPartitions(key, ts, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, []
        for batch in batches:
            verdicts = []
            for k, t in zip(batch[key], batch[ts].astype("int64") // 1000, strict=True):
                if k != now:
                    now, recent = k, []
                recent = [x for x in recent if x > t - seconds * 1_000_000]
                ok = len(recent) < limit
                if ok:
                    recent.append(t)
                verdicts.append(ok)
            yield batch.assign(accepted=verdicts)

    kept = ", ".join(f"`{c}` {t}" for c, t in times.dtypes)
    return ready.mapInPandas(run, f"{kept}, accepted boolean")
