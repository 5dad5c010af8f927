"""Queries of the read views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.functions import text as T
from tocsin.operators import views as V
from tocsin.queries.base import DEN, DENSE_TODAY, EXS, INC, LONG_TODAY, SER, query
from tocsin.sources import bindings as B


@query(f"WITH {INC} SELECT id, CAST(date AS VARCHAR) AS date, region, title FROM inc WHERE date >= DATE '{LONG_TODAY}' - 30 AND category = 'unknown' ORDER BY date DESC, id DESC LIMIT 200")
def incident_list(spark, d):
    return V.incident_list(B.incidents(spark, d), LONG_TODAY, category="unknown").select("id", "date", "region", "title")


@query(f"WITH {INC} SELECT id, CAST(date AS VARCHAR) AS date, title FROM inc WHERE date >= DATE '{LONG_TODAY}' - 30 AND region = 'NATION_3' ORDER BY date DESC, id DESC LIMIT 100")
def incidents_by_region(spark, d):
    return V.incident_list(B.incidents(spark, d), LONG_TODAY, region="NATION_3", limit=100).select("id", "date", "title")


@query(f"WITH {INC} SELECT id, title, source_name FROM inc WHERE (lower(title) LIKE '%urgent auto%' OR lower(region) LIKE '%urgent auto%') AND escalation_level >= 4 AND category = 'military'")
def incident_text_search(spark, d):
    found = V.text_search(B.incidents(spark, d), ["title", "region"], "URGENT auto")
    return found.where("escalation_level >= 4 and category = 'military'").select("id", "title", "source_name")


@query(f"WITH {INC} SELECT CAST(date AS VARCHAR) AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM inc GROUP BY date")
def ledger_by_day(spark, d):
    rows = B.incidents(spark, d)
    return rows.groupBy(F.coalesce(F.col("date").cast("string"), F.lit("Unknown")).alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {INC}, c AS (SELECT unnest(['cyber', 'airspace', 'maritime', 'disinfo', 'proxy', 'economic', 'military', 'diplomatic', 'civilian', 'unknown', 'unclassifiable', 'none']) AS category) SELECT c.category, count(inc.id) AS n FROM c LEFT JOIN inc ON inc.category = c.category GROUP BY c.category")
def category_counts_zero_filled(spark, d):
    return V.counts_with_zeros(B.incidents(spark, d), "category", dims.CATEGORIES)


@query(f"WITH {INC} SELECT count(*) FILTER (category = 'none') AS n_none, count(*) FILTER (category = 'unknown') AS n_unknown, count(*) FILTER (category IN ('none', 'unknown')) AS backlog FROM inc")
def backlog_counts(spark, d):
    return B.incidents(spark, d).agg(F.count_if(F.expr("category = 'none'")).alias("n_none"), F.count_if(F.expr("category = 'unknown'")).alias("n_unknown"), F.count_if(F.expr("category in ('none', 'unknown')")).alias("backlog"))


@query(f"WITH {INC}, g AS (SELECT count(*) AS n FROM inc WHERE date >= DATE '{LONG_TODAY}' - 7 GROUP BY region, date HAVING count(*) >= 2) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS verified, count(*) AS groups FROM g")
def cross_verified_total(spark, d):
    return V.cross_verified(B.incidents(spark, d), LONG_TODAY)


@query(f"WITH {SER} SELECT region, CAST(date AS VARCHAR) AS date, ei_score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS k FROM ser) WHERE k = 1")
def latest_per_region(spark, d):
    return V.latest_per(B.index_series(spark, d), "region").select("region", "date", "ei_score")


@query(f"WITH {SER}, top AS (SELECT * FROM ser ORDER BY date DESC, region LIMIT 60) SELECT region, CAST(date AS VARCHAR) AS date, ei_score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS k FROM top) WHERE k = 1")
def latest_within_60(spark, d):
    return V.latest_per(B.index_series(spark, d), "region", within=60).select("region", "date", "ei_score")


@query(f"""WITH {SER}, b AS (SELECT 'R' || lpad(CAST(k AS VARCHAR), 2, '0') AS region, baseline FROM (VALUES {", ".join(f"({k}, {v[5]})" for k, v in enumerate(dims.REGIONS.values()) if k != 7)}) x(k, baseline))
SELECT ser.region, CAST(max(date) AS VARCHAR) AS date, arg_max(ei_score, date) AS ei_score, CAST(round(coalesce(any_value(baseline), 0.05) * 100, 1) AS DOUBLE) AS base_score FROM ser LEFT JOIN b ON b.region = ser.region GROUP BY ser.region""")
def region_latest(spark, d):
    """Each region's newest value with its baseline; a region that the list lacks has the default."""
    baselines = spark.createDataFrame([(f"R{k:02}", v[5]) for k, v in enumerate(dims.REGIONS.values()) if k != 7], "region string, baseline double")
    return V.with_baseline(V.latest_per(B.index_series(spark, d), "region"), baselines).select("region", "date", "ei_score", "base_score")


@query(f"WITH {SER} SELECT CAST(date AS VARCHAR) AS date, ei_score FROM ser WHERE region = 'R03' AND date >= DATE '{DENSE_TODAY}' - 20")
def region_history(spark, d):
    return B.index_series(spark, d).where((F.col("region") == "R03") & (F.col("date") >= F.date_sub(F.lit(DENSE_TODAY).cast("date"), 20))).select("date", "ei_score")


@query(f"""WITH {SER}, w AS (SELECT * FROM ser WHERE date >= DATE '{DENSE_TODAY}' - 30 AND date <= DATE '{DENSE_TODAY}')
SELECT region, arg_max(ei_score, date) AS latest, round(arg_max(ei_score, date) - arg_max(ei_score, date) FILTER (date <= DATE '{DENSE_TODAY}' - 7), 4) AS delta, count(*) AS points, string_agg(CAST(date AS VARCHAR) || ' ' || printf('%.4f', ei_score), ',' ORDER BY date) AS history FROM w GROUP BY region""")
def overview_delta_7d(spark, d):
    out = V.overview(B.index_series(spark, d), DENSE_TODAY)
    return out.withColumn("history", F.array_join(F.transform("history", lambda h: F.concat(h["date"].cast("string"), F.lit(" "), F.format_string("%.4f", h["ei_score"]))), ","))


@query(f"WITH {SER} SELECT a.region, CAST(a.date AS VARCHAR) AS date, round(a.ei_score - b.ei_score, 4) AS delta FROM ser a LEFT JOIN ser b ON a.region = b.region AND b.date = a.date - 7")
def trend_exact_lag(spark, d):
    return V.trend_exact(B.index_series(spark, d))


@query(f"WITH {SER} SELECT region, CASE WHEN count(*) > 1 THEN round(arg_max(ei_score, date) - arg_min(ei_score, date), 4) END AS change, count(*) AS points FROM ser GROUP BY region")
def trend_newest_oldest(spark, d):
    return V.newest_less_oldest(B.index_series(spark, d))


@query(f"""WITH {SER}, l AS (SELECT region, date, round(ei_score - lag(ei_score) OVER (PARTITION BY region ORDER BY date), 4) AS delta FROM ser)
SELECT region, CAST(date AS VARCHAR) AS date, delta, CASE WHEN delta IS NULL THEN 'none' WHEN delta > 0 THEN 'rising' WHEN delta < 0 THEN 'falling' ELSE 'steady' END AS direction FROM l""")
def prev_point_delta(spark, d):
    return V.against_previous(B.index_series(spark, d))


@query(f"""WITH {SER}, s AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY date) - 1 AS x, round((ei_score - min(ei_score) OVER (PARTITION BY region)) / coalesce(nullif(max(ei_score) OVER (PARTITION BY region) - min(ei_score) OVER (PARTITION BY region), 0), 1), 4) AS y, count(*) OVER (PARTITION BY region) AS n FROM ser)
SELECT region, x, y FROM s WHERE n >= 2""")
def sparkline_scaled(spark, d):
    return V.sparkline(B.index_series(spark, d))


@query(f"WITH {INC} SELECT region, id, k FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC, id DESC) AS k FROM inc) WHERE k <= 10")
def topn_per_region(spark, d):
    return V.top_per(B.incidents(spark, d), "region", [F.desc("date"), F.desc("id")], 10).select("region", "id", "k")


@query(f"""WITH {EXS} SELECT id, CASE WHEN start_date > DATE '{LONG_TODAY}' THEN 'upcoming' WHEN coalesce(end_date, start_date) < DATE '{LONG_TODAY}' THEN 'concluded' ELSE 'running' END AS state,
start_date <= DATE '{LONG_TODAY}' + 14 AND coalesce(end_date, start_date) >= DATE '{LONG_TODAY}' - 14 AS active FROM exs""")
def exercise_window_state(spark, d):
    return V.window_state(B.exercises(spark, d), LONG_TODAY)


LEADERS = ["NATO/SHAPE", "Sweden", "Russia", "United States", "Finland and Sweden", "Poland", "SHAPE", "China", None]
LED = f"{EXS}, led AS (SELECT exs.* EXCLUDE (lead_nation), l.nation AS lead_nation FROM exs JOIN (VALUES (0, 'NATO/SHAPE'), (1, 'Sweden'), (2, 'Russia'), (3, 'United States'), (4, 'Finland and Sweden'), (5, 'Poland'), (6, 'SHAPE'), (7, 'China'), (8, NULL)) l(k, nation) ON k = exs.id % 9)"


def _led(spark, d):
    """Exercises with more lead nations, and none for some."""
    return B.exercises(spark, d).withColumn("lead_nation", F.get(F.array(*[F.lit(x).cast("string") for x in LEADERS]), (F.col("id") % len(LEADERS)).cast("int")))


@query(f"""WITH {LED} SELECT count(*) FILTER (lead_nation IN ('NATO/SHAPE', 'SHAPE')) AS nato, count(*) FILTER (lead_nation IS NULL OR lead_nation IN ('Russia', 'United States', 'Poland', 'China')) AS multilateral, count(*) FILTER (lead_nation IN ('Sweden', 'Finland and Sweden')) AS national FROM led""")
def exercise_bloc_counts(spark, d):
    """The three filters' counts; they overlap and leave nothing out of their own."""
    return _led(spark, d).agg(*[F.count_if(c).alias(name) for name, c in T.in_bloc(F.col("lead_nation")).items()])


@query(f"""WITH {LED} SELECT id, CASE lead_nation WHEN 'NATO/SHAPE' THEN 'NATO' WHEN 'SHAPE' THEN 'NATO' WHEN 'Russia' THEN 'RUS/CHN' WHEN 'China' THEN 'RUS/CHN' WHEN 'Sweden' THEN 'NATIONAL' WHEN 'Finland and Sweden' THEN 'NATIONAL' ELSE 'MULTILATERAL' END AS badge,
CASE WHEN rhetoric_score >= 0.7 THEN 'high' WHEN rhetoric_score >= 0.5 THEN 'medium' ELSE 'muted' END AS band, CASE WHEN id % 4 = 0 OR id % 4 = 1 THEN 'muted' WHEN rhetoric_score >= 0.7 THEN 'high' WHEN rhetoric_score >= 0.5 THEN 'medium' ELSE 'muted' END AS map_band,
CASE WHEN scale < 5000 THEN 'Small' WHEN scale < 20000 THEN 'Medium' WHEN scale <= 50000 THEN 'Large' ELSE 'Strategic' END AS scale_label FROM led""")
def exercise_labels(spark, d):
    """Badge, rhetoric band (with and without a target) and scale of each exercise."""
    target = F.when(F.col("id") % 4 == 1, "General deterrence").when(F.col("id") % 4 > 1, "Russia")
    return _led(spark, d).select("id", T.bloc(F.col("lead_nation")).alias("badge"), T.rhetoric_band(F.col("rhetoric_score")).alias("band"), T.rhetoric_band(F.col("rhetoric_score"), target).alias("map_band"), T.scale_label(F.col("scale")).alias("scale_label"))


NAMED_PLACES = [("Steadfast Defender 24", 55.0, 24.0), ("RIMPAC 2026", 21.0, -157.0), ("Pacific Steller", -10.0, 140.0), ("Indo-Malay", -10.0, 140.0), ("arctic light", 70.0, 15.0), ("Nordic Response", 58.0, 20.0), ("Sea Med", 36.0, 14.0), ("Noble Jump", 30.0, 15.0), ("Cyber Coalition", 59.5, 24.7)]


@query(f"""WITH {EXS}, p AS (SELECT * FROM (VALUES {", ".join(f"({k}, {lat}::DOUBLE, {lng}::DOUBLE)" for k, (_, lat, lng) in enumerate(NAMED_PLACES))}) p(k, lat, lng)) SELECT id, CASE WHEN id % 5 = 0 THEN 1.5::DOUBLE ELSE lat END AS lat, CASE WHEN id % 5 = 0 THEN 2.5::DOUBLE ELSE lng END AS lng FROM exs JOIN p ON k = id % 9""")
def exercise_positions(spark, d):
    """Own position, else by name, else by a word of the name, else the middle; half a position is none."""
    name = F.get(F.array(*[F.lit(n) for n, _, _ in NAMED_PLACES]), (F.col("id") % 9).cast("int"))
    own = F.when(F.col("id") % 5 == 0, F.lit(2.5))
    at = T.position(name, F.when((F.col("id") % 5 == 0) | (F.col("id") % 7 == 1), F.lit(1.5)), own)
    return B.exercises(spark, d).select("id", at.alias("p")).select("id", "p.lat", "p.lng")


@query(f"""WITH {EXS} SELECT domain, count(*) FILTER (start_date <= DATE '{LONG_TODAY}' + 14 AND coalesce(end_date, start_date) >= DATE '{LONG_TODAY}' - 14) AS active,
count(*) FILTER (start_date > DATE '{LONG_TODAY}' + 14) AS upcoming, CAST(sum(coalesce(scale, 0)) AS BIGINT) AS personnel FROM exs GROUP BY domain""")
def personnel_totals(spark, d):
    return V.exercise_totals(B.exercises(spark, d), LONG_TODAY)


@query(f"WITH {EXS} SELECT id, CAST(start_date AS VARCHAR) AS start_date FROM exs WHERE announcement_status <> 'archived-manual' AND region = 'NATION_1' AND lead_nation = 'Sweden' ORDER BY start_date DESC, id DESC LIMIT 50")
def exercise_list(spark, d):
    rows = B.exercises(spark, d).where("announcement_status <> 'archived-manual' and region = 'NATION_1' and lead_nation = 'Sweden'")
    return rows.orderBy(F.desc("start_date"), F.desc("id")).limit(50).select("id", "start_date")


@query(f"WITH {EXS} SELECT id, CAST(start_date AS VARCHAR) AS start_date FROM exs WHERE announcement_status <> 'archived-manual' AND start_date >= DATE '{LONG_TODAY}' - 200 ORDER BY start_date, id LIMIT 20")
def upcoming_exercises(spark, d):
    return V.upcoming(B.exercises(spark, d), "2000-12-13").orderBy("start_date", "id").limit(20).select("id", "start_date")


@query(f"WITH {EXS} SELECT CAST(min(start_date) AS VARCHAR) AS first_day, CAST(max(coalesce(end_date, start_date)) + 14 AS VARCHAR) AS last_day, CAST(greatest(max(start_date), max(end_date)) AS VARCHAR) AS newest FROM exs")
def timeline_extent(spark, d):
    return B.exercises(spark, d).agg(F.min("start_date").alias("first_day"), F.date_add(F.max(F.coalesce("end_date", "start_date")), 14).alias("last_day"), F.greatest(F.max("start_date"), F.max("end_date")).alias("newest"))


@query(f"WITH {DEN} SELECT region, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM den GROUP BY region")
def upper_median(spark, d):
    return V.upper_median(B.dense_incidents(spark, d), "region", "value")


@query(f"WITH {INC} SELECT max(CAST(date AS VARCHAR)) AS last_sync, count(*) AS n FROM inc")
def last_sync(spark, d):
    return B.incidents(spark, d).agg(F.max("date").alias("last_sync"), F.count("*").alias("n"))


@query(f"""WITH {INC}, {EXS}, fewer AS (SELECT * FROM inc WHERE region NOT IN ('NATION_5', 'NATION_6')), few AS (SELECT * FROM exs WHERE region NOT IN ('NATION_6', 'NATION_7')), r AS (SELECT DISTINCT region FROM inc),
i AS (SELECT region, string_agg(line, chr(10) ORDER BY k) AS reports FROM (SELECT region, '- [' || category || '] ' || title AS line, row_number() OVER (PARTITION BY region ORDER BY date DESC, id DESC) AS k FROM fewer) WHERE k <= 8 GROUP BY region),
e AS (SELECT region, string_agg(line, chr(10) ORDER BY k) AS exercises FROM (SELECT region, '- ' || name || ' (' || domain || ')' AS line, row_number() OVER (PARTITION BY region ORDER BY start_date DESC, id DESC) AS k FROM few) WHERE k <= 3 GROUP BY region)
SELECT r.region, CASE WHEN i.region IS NULL AND e.region IS NULL THEN NULL ELSE coalesce(reports, 'No recent incidents indexed.') END AS reports, CASE WHEN i.region IS NULL AND e.region IS NULL THEN NULL ELSE coalesce(exercises, 'No exercises in current window.') END AS exercises FROM r LEFT JOIN i ON i.region = r.region LEFT JOIN e ON e.region = r.region""")
def brief_context(spark, d):
    """One region has no reports, one neither reports nor exercises, one no exercises."""
    inc, ex = B.incidents(spark, d), B.exercises(spark, d).withColumn("signal_target", F.col("domain"))
    return V.brief_context(inc.select("region").distinct(), inc.where("region not in ('NATION_5', 'NATION_6')"), ex.where("region not in ('NATION_6', 'NATION_7')"))


@query(f"WITH {INC}, x AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE date END AS date FROM inc) SELECT coalesce(CAST(date AS VARCHAR), 'Unknown') AS day, id, row_number() OVER (PARTITION BY coalesce(CAST(date AS VARCHAR), 'Unknown') ORDER BY id) AS place FROM x")
def ledger_rows(spark, d):
    """Every report under its day, rows without a date under 'Unknown', with its place there."""
    rows = B.incidents(spark, d).withColumn("date", F.when(F.col("id") % 50 != 0, F.col("date")))
    return V.by_day(rows, "id").select("day", "id", "place")


@query(f"""WITH {INC}, q AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY date DESC, id DESC) AS k FROM inc WHERE category IN ('unknown', 'none')) SELECT id, category FROM q WHERE k <= 50""")
def work_queue(spark, d):
    rows = B.incidents(spark, d).where("category in ('unknown', 'none')")
    return V.top_per(rows, "category", [F.desc("date"), F.desc("id")], 50).select("id", "category")


@query(f"""WITH {INC}, {EXS} SELECT i.id AS incident_id, e.id AS exercise_id, i.region, datediff('day', i.date, e.start_date) AS lag_days FROM inc i JOIN exs e ON i.region = e.region AND e.start_date BETWEEN i.date AND i.date + 14
ORDER BY i.date DESC, i.id DESC, e.id DESC LIMIT 50""")
def correlation_list(spark, d):
    """Newest links of a report and an exercise of its region that starts within two weeks."""
    return V.newest_links(B.incidents(spark, d), B.exercises(spark, d), 50).select("incident_id", "exercise_id", "region", "lag_days")
