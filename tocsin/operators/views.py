"""Read views: filters, latest and trend, top-N, counts. Orders have a unique last key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.functions import text as T


def incident_list(incidents: DataFrame, today: str, region: str | None = None, category: str | None = None, days: int = 30, limit: int = 200) -> DataFrame:
    out = incidents.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days))
    out = out.where(F.col("region") == region) if region else out
    out = out.where(F.col("category") == category) if category else out
    return out.orderBy(F.desc("date"), F.desc("id")).limit(limit)


def text_search(rows: DataFrame, columns: list[str], words: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(words.lower()), F.lit(False))
    return rows.where(hit)


def latest_per(rows: DataFrame, key: str, order: str = "date", within: int | None = None) -> DataFrame:
    """Newest row of each key, optionally among the newest rows of all only."""
    rows = rows.orderBy(F.desc(order), key).limit(within) if within else rows
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("k = 1").drop("k")


def top_per(rows: DataFrame, key: str, by: list[Column], n: int) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(f"k <= {n}")


def overview(series: DataFrame, today: str, days: int = 30, lag: int = 7) -> DataFrame:
    """Latest value, change since the last point at or before a week ago, and the ordered history of each region."""
    day = F.lit(today).cast("date")
    recent = series.where((F.col("date") >= F.date_sub(day, days)) & (F.col("date") <= day))
    before = F.when(F.col("date") <= F.date_sub(day, lag), F.struct("date", "ei_score"))
    out = recent.groupBy("region").agg(F.max(F.struct("date", "ei_score")).alias("last"), F.max(before).alias("before"), F.array_sort(F.collect_list(F.struct("date", "ei_score"))).alias("h"))
    return out.select("region", F.col("last.ei_score").alias("latest"), F.round(F.col("last.ei_score") - F.col("before.ei_score"), 4).alias("delta"), F.size("h").cast("long").alias("points"), F.col("h").alias("history"))


def trend_exact(series: DataFrame, lag: int = 7) -> DataFrame:
    """Change against the row exactly a week before; null without one."""
    past = series.select("region", F.date_add("date", lag).alias("date"), F.col("ei_score").alias("past"))
    return series.join(past, ["region", "date"], "left").select("region", "date", F.round(F.col("ei_score") - F.col("past"), 4).alias("delta"))


def newest_less_oldest(series: DataFrame) -> DataFrame:
    out = series.groupBy("region").agg(F.max_by("ei_score", "date").alias("b"), F.min_by("ei_score", "date").alias("a"), F.count("*").alias("points"))
    return out.select("region", F.when(F.col("points") > 1, F.round(F.col("b") - F.col("a"), 4)).alias("change"), "points")


def against_previous(series: DataFrame) -> DataFrame:
    past = F.lag("ei_score").over(Window.partitionBy("region").orderBy("date"))
    out = series.withColumn("delta", F.round(F.col("ei_score") - past, 4))
    return out.select("region", "date", "delta", F.when(F.col("delta").isNull(), "none").when(F.col("delta") > 0, "rising").when(F.col("delta") < 0, "falling").otherwise("steady").alias("direction"))


def sparkline(series: DataFrame) -> DataFrame:
    """Place and scaled value of each point of regions with at least two."""
    w = Window.partitionBy("region")
    span = F.max("ei_score").over(w) - F.min("ei_score").over(w)
    out = series.withColumn("y", F.round((F.col("ei_score") - F.min("ei_score").over(w)) / F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0)), 4))
    out = out.withColumn("x", F.row_number().over(w.orderBy("date")) - 1).withColumn("points", F.count("*").over(w))
    return out.where("points >= 2").select("region", "x", "y")


def counts_with_zeros(rows: DataFrame, column: str, wanted: tuple[str, ...]) -> DataFrame:
    spark = rows.sparkSession
    dim = spark.createDataFrame([(w,) for w in wanted], f"{column} string")
    return dim.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def cross_verified(rows: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Rows of the last days in (region, date) groups of two or more."""
    groups = rows.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days)).groupBy("region", "date").count().where("count >= 2")
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("verified"), F.count("*").alias("groups"))


def remaps(rows: DataFrame, old: Column, new: Column, n: int = 20) -> DataFrame:
    pairs = rows.select(old.alias("old"), F.coalesce(new, F.lit("(unresolved)")).alias("new"))
    counts = pairs.groupBy("old", "new").agg(F.count_if(F.expr("old <> new")).alias("n"))  # counted first: a filter before it would work new out twice
    return counts.where("n > 0").orderBy(F.desc("n"), "old", "new").limit(n)


def remap_totals(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """How many rows a remap changes, and how many it leaves without a region."""
    pairs = rows.select(old.alias("old"), new.alias("new"))
    return pairs.agg(F.count_if(F.expr("new is not null and new <> old")).alias("changed"), F.count_if(F.expr("new is null")).alias("unresolved"), F.count("*").alias("n"))


def window_state(exercises: DataFrame, today: str) -> DataFrame:
    """State of each exercise on a day, from its dates; active also two weeks around."""
    day = F.lit(today).cast("date")
    end = F.coalesce("end_date", "start_date")
    state = F.when(F.col("start_date") > day, "upcoming").when(end < day, "concluded").otherwise("running")
    active = (F.col("start_date") <= F.date_add(day, 14)) & (end >= F.date_sub(day, 14))
    return exercises.select("id", state.alias("state"), active.alias("active"))


def exercise_totals(exercises: DataFrame, today: str) -> DataFrame:
    """By domain: active and upcoming exercises and personnel of all."""
    day = F.lit(today).cast("date")
    active = (F.col("start_date") <= F.date_add(day, 14)) & (F.coalesce("end_date", "start_date") >= F.date_sub(day, 14))
    return exercises.groupBy("domain").agg(F.count_if(active).alias("active"), F.count_if(F.col("start_date") > F.date_add(day, 14)).alias("upcoming"), F.sum(F.coalesce("scale", F.lit(0))).alias("personnel"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The element at half the sorted length, of each key; nulls don't count.

    Equal values are counted first, so a key's task gets a row a value.
    """
    counts = rows.groupBy(key, F.col(value).alias("v")).agg(F.count(value).alias("n"))
    whole = Window.partitionBy(key)
    upto = counts.withColumn("upto", F.sum("n").over(whole.orderBy("v"))).withColumn("total", F.sum("n").over(whole))
    return upto.groupBy(key).agg(F.min(F.when(F.expr("upto > total div 2"), F.col("v"))).alias("upper_median"))


def region_board(region_dim: DataFrame, latest: DataFrame) -> DataFrame:
    """Every region with its latest value, band and whether it counts as critical; missing stays null."""
    joined = region_dim.join(latest, "region", "left")
    return joined.select("region", "kind", "ei_score", T.index_label(F.col("ei_score")).alias("label"), F.coalesce(F.round("ei_score") >= 50, F.lit(False)).alias("critical"))


def brief_context(regions: DataFrame, incidents: DataFrame, exercises: DataFrame) -> DataFrame:
    """Of each region the newest eight of ten reports and three of four exercises as lines; both null where there is neither.

    Where only one kind is missing, its text says so.
    """

    def lines(rows: DataFrame, by: list[Column], take: int, show: int, line: Column, name: str) -> DataFrame:
        top = top_per(rows, "region", by, take).where(f"k <= {show}").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))
        return top.select("region", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias(name))

    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    inc = lines(incidents, [F.desc("date"), F.desc("id")], 10, 8, F.concat(F.lit("- ["), F.coalesce("category", F.lit("?")), F.lit("] "), known("title")), "reports")
    ex = lines(exercises, [F.desc("start_date"), F.desc("id")], 4, 3, F.concat(F.lit("- "), known("name"), F.lit(" ("), known("signal_target"), F.lit(")")), "exercises")
    both = regions.join(inc, "region", "left").join(ex, "region", "left")
    some = F.col("reports").isNotNull() | F.col("exercises").isNotNull()
    return both.select("region", F.when(some, F.coalesce("reports", F.lit("No recent incidents indexed."))).alias("reports"), F.when(some, F.coalesce("exercises", F.lit("No exercises in current window."))).alias("exercises"))


def upcoming(exercises: DataFrame, today: str) -> DataFrame:
    """Exercises that begin today or later and aren't archived; a missing status drops out."""
    return exercises.where((F.col("announcement_status") != "archived-manual") & (F.col("start_date") >= F.lit(today).cast("date")))


def with_baseline(latest: DataFrame, baselines: DataFrame) -> DataFrame:
    """Rows with base_score: their region's baseline in percent, the default where there is none."""
    joined = latest.join(F.broadcast(baselines), "region", "left")  # one row a region
    return joined.withColumn("base_score", F.round(F.coalesce("baseline", F.lit(dims.DEFAULT_BASELINE)) * 100, 1)).drop("baseline")


def by_day(rows: DataFrame, order: str) -> DataFrame:
    """rows with day (or 'Unknown') and their place in it."""
    days = rows.withColumn("day", F.coalesce(F.col("date").cast("string"), F.lit("Unknown")))
    return days.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(order)).cast("long"))


def relevant_exercises(exercises: DataFrame, region: str, theatre: str) -> DataFrame:
    """Exercises whose name or region has the first word of a region, or whose region has its theatre."""
    first = region.split()[0].lower()
    hit = F.lower("name").contains(first) | F.lower("region").contains(first) | F.lower("region").contains(theatre.lower())
    return exercises.where(F.coalesce(hit, F.lit(False)))


def dossiers(incidents: DataFrame, exercises: DataFrame) -> DataFrame:
    """Number and newest day of each region's reports and exercises; regions of either table."""
    inc = incidents.groupBy("region").agg(F.count("*").alias("reports"), F.max("date").alias("newest_report"))
    ex = exercises.groupBy("region").agg(F.count("*").alias("exercises"), F.max("start_date").alias("newest_exercise"))
    both = inc.join(ex, "region", "full_outer")
    return both.select("region", F.coalesce("reports", F.lit(0)).alias("reports"), "newest_report", F.coalesce("exercises", F.lit(0)).alias("exercises"), "newest_exercise")


def keys_in_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one table has and the other hasn't, with the side that has them."""
    sides = [x.select(key).distinct().withColumn(name, F.lit(True)) for x, name in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], key, "full_outer").where("l is null or r is null")
    return both.select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("only_in"))


def newest_links(incidents: DataFrame, exercises: DataFrame, n: int, ahead: int = 14) -> DataFrame:
    """The newest n pairs of a report and an exercise of its region that starts on its day or within so many days.

    Pairs are counted by day first (counts of either side multiplied), which tells the
    day from which on there are n of them; only reports from then on are joined.
    """
    near = exercises.select(F.col("id").alias("exercise_id"), "region", "start_date", F.explode(F.sequence(F.date_sub("start_date", ahead), F.col("start_date"))).alias("date"))
    sides = [df.groupBy("region", "date").agg(F.count("*").alias(name)) for df, name in ((incidents, "x"), (near, "y"))]
    per_day = sides[0].join(sides[1], ["region", "date"]).groupBy("date").agg(F.sum(F.col("x") * F.col("y")).alias("pairs"))
    upto = per_day.withColumn("upto", F.sum("pairs").over(Window.orderBy(F.desc("date"))))  # one row a day
    since = upto.agg(F.coalesce(F.max(F.when(F.col("upto") >= n, F.col("date"))), F.min("date")).alias("since"))
    recent = incidents.join(F.broadcast(since), F.col("date") >= F.col("since"))  # one row
    linked = recent.select(F.col("id").alias("incident_id"), "region", "date").join(near, ["region", "date"])
    return linked.orderBy(F.desc("date"), F.desc("incident_id"), F.desc("exercise_id")).limit(n).select("incident_id", "exercise_id", "region", F.datediff("start_date", "date").alias("lag_days"), "date")
