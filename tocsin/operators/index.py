"""The escalation index for every region and day in one plan.

Reports are clustered into events once, for all days, and weighted per day; a dense spine of days then carries two rolling
sums, a trailing median and the interval join with exercises.  Windows run over
one row a region and day, so their input is small whatever the number of reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import dims, scoring
from tocsin.operators.cluster import changed_cells, event_members, events_of, title_nodes, within_cells, written

EPOCH = "1970-01-01"
#: Lengths of nested ranges: 2**0 to 2**LEVELS days, more than dates have.
LEVELS = 22


def _day(date: str = "date") -> Column:
    return F.datediff(F.col(date), F.lit(EPOCH).cast("date"))


def _back(days: int, until: int):
    return Window.partitionBy("region").orderBy("day").rangeBetween(-days, until)


def events_by_title(incidents: DataFrame) -> DataFrame:
    """One event for each region, day and title: highest level, number of reports, least id."""
    return incidents.groupBy("region", "date", "title").agg(F.max("escalation_level").alias("severity"), F.count("*").alias("corroboration"), F.min("id").alias("rep_id"))


def daily_weights(incidents: DataFrame) -> DataFrame:
    """region, date, w and w_first (weights of the day's events, with all members and with those of the day itself), events and reports.

    Events are clusters of similar titles; reports count on their own day, those without one not at all.
    """
    nodes = title_nodes(incidents.where("date is not null"))
    events = events_of(event_members(nodes, undated=False))
    w = lambda severity, corroboration: F.sum(scoring.severity_weight(F.col(severity)) * scoring.corroboration(F.col(corroboration)))
    per_day = events.groupBy("region", "date").agg(w("severity", "corroboration").alias("w"), w("first_severity", "first_corroboration").alias("w_first"), F.count("*").alias("n_events"))
    reports = nodes.groupBy("region", "date").agg(F.sum("n").alias("n_reports"))
    return written(reports.join(per_day, ["region", "date"], "left").na.fill(0, ["w", "w_first", "n_events"]), "daily")


def by_region(df: DataFrame) -> DataFrame:
    """df dealt out by region: windows over a region's days are heavy for their few bytes, so tasks aren't put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region")


def spine(daily: DataFrame, lead_days: int = dims.WINDOW_DAYS + dims.ANCHORS + 1) -> DataFrame:
    """Every region and day from so many days before the first to the last; regions and days come from the data."""
    ends = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = ends.select(F.explode(F.sequence(F.date_sub("first", lead_days), F.col("last"))).alias("date"))
    regions = daily.select("region").distinct()
    return regions.crossJoin(F.broadcast(days))  # one row a day: a few thousand, whatever the data


def rolling_load(daily: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """region, date, load, settled and counts over 31 days, on every day of the spine or on those given.

    Given days have right values where the 30 days before them are given too.

    settled is the day's load (31 days, the last 8 boosted) with all that is known of
    its events by the next day; load is what could be known on the day: members of
    the next day are left out of its own events.
    """
    dense = by_region((spine(daily) if days is None else days).join(daily, ["region", "date"], "left")).na.fill(0, ["w", "w_first", "n_events", "n_reports"]).withColumn("day", _day())
    long, short = _back(dims.WINDOW_DAYS, 0), _back(dims.RECENT_DAYS, 0)
    out = dense.withColumn("settled", F.sum("w").over(long) + (dims.RECENT_BOOST - 1) * F.sum("w").over(short))
    load = F.when(F.col("w") == F.col("w_first"), F.col("settled")).otherwise(F.col("settled") - dims.RECENT_BOOST * (F.col("w") - F.col("w_first")))
    return out.select("region", "date", "day", load.alias("load"), "settled", F.sum("n_events").over(long).alias("events_30d"), F.sum("n_reports").over(long).alias("reports_30d"))


def with_kappa(load: DataFrame) -> DataFrame:
    """load with the trailing median over the 90 days before, active days and kappa."""
    past = _back(dims.ANCHORS, -1)
    out = load.withColumn("median_load", F.coalesce(F.percentile("settled", 0.5).over(past), F.lit(0.0)))
    out = out.withColumn("active_days", F.coalesce(F.sum((F.col("settled") > 1e-9).cast("int")).over(past), F.lit(0)))
    return out.withColumn("kappa", scoring.kappa(F.col("median_load"), F.col("active_days")))


def with_gz(load: DataFrame) -> DataFrame:
    return with_kappa(load).withColumn("gz", scoring.saturation(F.col("load"), F.col("kappa")))


def _counted(exercises: DataFrame) -> DataFrame:
    """Exercises that count, with the first day on which they do; a missing status or date drops out."""
    return exercises.where("announcement_status <> 'archived-manual' and start_date - interval 14 days <= end_date").withColumn("first_day", F.date_sub("start_date", dims.AHEAD_DAYS))


def _figures() -> list[Column]:
    """What an exercise adds: capped scale, rhetoric (0 if unknown) and whether that is known."""
    tone = F.col("rhetoric_score").cast("decimal(10,4)")
    return [scoring.exercise_scale(F.col("scale")).cast("long").alias("size"), F.coalesce(tone, F.lit(0).cast("decimal(10,4)")).alias("tone"), tone.isNotNull().cast("int").alias("toned")]


def _means(totals: DataFrame) -> DataFrame:
    return totals.select("region", "date", (F.col("size") / (F.col("n") * float(dims.FULL_SCALE))).alias("ex"), F.when(F.col("toned") > 0, (F.col("tone").cast("double") / F.col("toned") + 1) / 2).alias("rh"), F.col("n").alias("n_exercises"), F.col("size").alias("total_scale"))


def dyadic_ranges(first: Column, last: Column) -> Column:
    """An interval of days as at most two nested ranges of each length 2**k: array of (level, number), empty if last is before first.

    From the bottom up: an odd left end and an even right end are ranges of their own, the rest goes on with half as many days.
    """
    start = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), F.array().cast("array<struct<level:int,number:bigint>>").alias("found"))

    def halved(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        left, right = (a <= b) & (F.pmod(a, F.lit(2)) == 1), (a <= b) & (F.pmod(b, F.lit(2)) == 0)
        own = F.struct(level.alias("level"), a.alias("number")), F.struct(level.alias("level"), b.alias("number"))
        more = F.filter(F.array(F.when(left, own[0]), F.when(right, own[1])), lambda x: x.isNotNull())
        a, b = a + left.cast("long"), b - right.cast("long")
        goes_on = a <= b  # else nothing is left, on any level
        return F.struct(F.when(goes_on, F.floor(a / 2)).otherwise(1).alias("a"), F.when(goes_on, F.floor(b / 2)).otherwise(-1).alias("b"), F.concat(s["found"], more).alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, halved, lambda s: s["found"])


def exercise_days(exercises: DataFrame, days: DataFrame) -> DataFrame:
    """Interval join: each region's asked days with the exercises running or starting within two weeks.

    An exercise's days are dealt to nested ranges of 2**k days, at most two of each length and so a few rows even for
    an interval of centuries; a day lies in one range of each length. The join has an equality on region and range.
    """
    ranges = dyadic_ranges(_day("first_day"), _day("end_date"))
    spread = _counted(exercises).select("region", "id", "scale", "rhetoric_score", F.inline(ranges))
    levels = spread.agg(F.collect_set("level")).first()[0]  # at most one row a length
    cell = F.transform(F.array(*[F.lit(k).cast("int") for k in sorted(levels or [0])]), lambda k: F.struct(k.alias("level"), F.floor(_day() / F.pow(F.lit(2.0), k)).cast("long").alias("number")))
    asked = days.select("region", "date", F.inline(cell))
    return asked.join(spread, ["region", "level", "number"]).select("region", "date", "id", "scale", "rhetoric_score")


def exercise_parts_on(exercises: DataFrame, days: DataFrame) -> DataFrame:
    """exercise_parts of the asked days only."""
    found = exercise_days(exercises, days).select("region", "date", *_figures())
    return _means(found.groupBy("region", "date").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("size", "tone", "toned")]))


def exercise_parts(exercises: DataFrame) -> DataFrame:
    """region, date, ex (mean capped scale), rh (rescaled mean rhetoric) and count, for days with any.

    Two rows an exercise: its figures are added on its first day and taken off after
    its last; a running sum over the days gives each day's totals.
    """
    rows = _counted(exercises).select("region", "first_day", "end_date", *_figures())
    ends = rows.select("region", F.explode(F.array(F.struct(F.col("first_day").alias("date"), F.lit(1).alias("by")), F.struct(F.date_add("end_date", 1).alias("date"), F.lit(-1).alias("by")))).alias("e"), "size", "tone", "toned")
    changes = ends.groupBy("region", F.col("e.date").alias("date")).agg(*[F.sum(F.expr(x)).alias(name) for name, x in {"n": "e.by", "size": "e.by * size", "tone": "e.by * tone", "toned": "e.by * toned"}.items()])
    upto = Window.partitionBy("region").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    dense = by_region(spine(changes, 0).join(changes, ["region", "date"], "left")).na.fill(0, ["n", "size", "toned"]).withColumn("tone", F.coalesce("tone", F.lit(0))).withColumn("day", _day())
    totals = dense.select("region", "date", *[F.sum(c).over(upto).alias(c) for c in ("n", "size", "tone", "toned")]).where("n > 0")
    return _means(totals)


def _composite(gz: DataFrame, parts: DataFrame, baselines: DataFrame | None) -> DataFrame:
    scored = gz.join(parts, ["region", "date"], "left")
    if baselines is not None:
        scored = scored.join(F.broadcast(baselines.select("region", "baseline")), "region", "left")  # one row a region
    else:
        scored = scored.withColumn("baseline", F.lit(None).cast("double"))
    scored = scored.withColumn("gz", F.round("gz", 6))  # beyond what summation order can change
    base, ex = F.coalesce("baseline", F.lit(dims.DEFAULT_BASELINE)), F.coalesce("ex", F.lit(0.0))
    return scored.select("region", "date", scoring.composite(F.col("gz"), ex, base).alias("ei_score"), scoring.half_up(F.col("gz") * 100, 1).alias("gz_score"), scoring.half_up(ex * 100, 1).alias("ex_score"), scoring.half_up(F.coalesce("rh", F.lit(0.5)) * 100, 1).alias("rh_score"), F.round("kappa", 4).alias("kappa"), "reports_30d", "events_30d")


def composite_history(incidents: DataFrame, exercises: DataFrame, baselines: DataFrame | None = None, daily: DataFrame | None = None) -> DataFrame:
    """The index and its parts for every region and day, without lookahead. daily: the reports' daily weights, if there are some already."""
    daily = daily_weights(incidents) if daily is None else daily
    return _composite(with_gz(rolling_load(daily)), exercise_parts(exercises), baselines)


#: A changed day's weight is in the loads of the 31 days from it on, and those are in the medians of the 90 days after them.
REACH = dims.WINDOW_DAYS + dims.ANCHORS


def revised(history: DataFrame, daily: DataFrame, incidents: DataFrame, late: DataFrame, exercises: DataFrame, baselines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(history, daily) after late reports, with only what they can change worked out again.

    history and daily are those of incidents (composite_history, daily_weights). Runs of days that a late report falls
    into are clustered and weighted again; then the days up to REACH after a changed one, and those that the
    spine has gained, get new rows, from the weights of the REACH days before.
    """
    old, new = incidents.where("date is not null"), late.where("date is not null")
    cells = written(changed_cells(old, new), "cells")
    fresh = daily_weights(within_cells(old.unionByName(new), cells, "left_semi"))
    daily = written(within_cells(daily, cells, "left_anti").unionByName(fresh.select(*daily.columns)), "daily")
    days = spine(daily)
    gained = days.join(history.select("region", "date"), ["region", "date"], "left_anti")
    around = lambda df, a, b: df.select("region", F.explode(F.sequence(F.date_add("date", a), F.date_add("date", b))).alias("date"))
    hit = written(around(cells, 0, REACH).unionByName(gained).distinct().join(days, ["region", "date"], "left_semi"), "days")
    needed = around(cells, -REACH, REACH).unionByName(around(gained, -REACH, 0)).distinct().join(days, ["region", "date"], "left_semi")
    gz = with_gz(rolling_load(daily, needed)).join(hit, ["region", "date"], "left_semi")
    again = _composite(gz, exercise_parts(exercises), baselines)  # a running sum: two rows an exercise, however many days are hit
    return history.join(hit, ["region", "date"], "left_anti").unionByName(again.select(*history.columns)), daily
