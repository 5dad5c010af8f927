"""Queries of the index and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tocsin.functions import dims, scoring
from tocsin.operators import cluster as C
from tocsin.operators import fuzzy
from tocsin.operators import index as X
from tocsin.queries.base import EXS, INC, query
from tocsin.sources import bindings as B

WEIGHT = "(CASE least(greatest(coalesce(nullif(severity, 0), 1), 1), 5) " + " ".join(f"WHEN {k} THEN {v}" for k, v in dims.SEVERITY.items()) + " END * (1 + 0.15 * ln(greatest(corroboration, 1))))"
# Of the orders' 25 titles (priority, segment), these pairs have a similarity of 70 or more, worked out by hand from the scorer's definition.
SIMILAR = """(r.s = s OR (r.p = p AND (p = '4-NOT SPECIFIED' OR (p IN ('1-URGENT', '3-MEDIUM') AND (r.s = 'AUTOMOBILE' OR s = 'AUTOMOBILE' OR (r.s IN ('BUILDING', 'FURNITURE') AND s IN ('BUILDING', 'FURNITURE')) OR (r.s IN ('HOUSEHOLD', 'MACHINERY') AND s IN ('HOUSEHOLD', 'MACHINERY')))))))"""
EXACT = f"""{INC}, ev AS (SELECT region, date, title, max(escalation_level) AS severity, count(*) AS corroboration, min(id) AS rep_id FROM inc GROUP BY region, date, title)"""
# The greedy loop itself, a title after the other: it joins the first event that is at most a day old and similar, else it begins one.
EVENTS = f"""{INC}, one AS (SELECT region, date, title, regexp_replace(title, ' [A-Z]+$', '') AS p, regexp_extract(title, '[A-Z]+$') AS s, min(id) AS id, count(*) AS n, max(escalation_level) AS level FROM inc GROUP BY ALL),
node AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date, id) AS k FROM one),
run(region, k, reps, id, rep) AS (
  SELECT DISTINCT region, 0::BIGINT, []::STRUCT(date DATE, p VARCHAR, s VARCHAR, id BIGINT)[], NULL::BIGINT, NULL::BIGINT FROM node
  UNION ALL
  SELECT region, k, CASE WHEN hit IS NULL THEN list_append(near, {{'date': date, 'p': p, 's': s, 'id': id}}) ELSE near END, id, coalesce(hit.id, id)
  FROM (SELECT *, list_filter(near, lambda r: {SIMILAR})[1] AS hit FROM (SELECT node.*, list_filter(run.reps, lambda r: r.date >= node.date - 1) AS near FROM run JOIN node ON node.region = run.region AND node.k = run.k + 1))
),
mem AS (SELECT node.*, rep, min(node.date) OVER (PARTITION BY rep) AS first_day FROM node JOIN run ON run.id = node.id),
ev AS (SELECT region, rep AS rep_id, min(date) AS date, max(level) AS severity, CAST(sum(n) AS BIGINT) AS corroboration, arg_max(title, (length(title), -(date - DATE '1970-01-01'), -id)) AS title,
  max(level) FILTER (date = first_day) AS first_severity, CAST(sum(n) FILTER (date = first_day) AS BIGINT) AS first_corroboration FROM mem GROUP BY region, rep)"""
FIRST = WEIGHT.replace("severity", "first_severity").replace("corroboration", "first_corroboration")
LOAD = f"""{EVENTS}, perday AS (SELECT region, date, sum({WEIGHT}) AS w, sum({FIRST}) AS w_first, count(*) AS n_events FROM ev GROUP BY region, date),
daily AS (SELECT region, date, coalesce(w, 0) AS w, coalesce(w_first, 0) AS w_first, coalesce(n_events, 0) AS n_events, n_reports FROM (SELECT region, date, count(*) AS n_reports FROM inc GROUP BY region, date) LEFT JOIN perday USING (region, date)),
days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM daily) - 121, (SELECT max(date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date),
dense AS (SELECT r.region, days.date, coalesce(w, 0) AS w, coalesce(w_first, 0) AS w_first, coalesce(n_events, 0) AS n_events, coalesce(n_reports, 0) AS n_reports FROM (SELECT DISTINCT region FROM daily) r CROSS JOIN days LEFT JOIN daily ON daily.region = r.region AND daily.date = days.date),
settled AS (SELECT region, date, w, w_first, sum(w) OVER l + 0.6 * sum(w) OVER s AS settled, CAST(sum(n_events) OVER l AS BIGINT) AS events_30d, CAST(sum(n_reports) OVER l AS BIGINT) AS reports_30d FROM dense
  WINDOW l AS (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), s AS (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)),
load AS (SELECT region, date, settled, CASE WHEN w = w_first THEN settled ELSE settled - 1.6 * (w - w_first) END AS load, events_30d, reports_30d FROM settled)"""
KAPPA = f"""{LOAD}, med AS (SELECT *, coalesce(median(settled) OVER p, 0) AS median_load, coalesce(CAST(sum(CASE WHEN settled > 1e-9 THEN 1 ELSE 0 END) OVER p AS BIGINT), 0) AS active_days FROM load
  WINDOW p AS (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
kap AS (SELECT *, CASE WHEN median_load <= 0 AND active_days < 15 THEN 15.0 ELSE greatest(3.0, median_load * {dims.NORM!r}) END AS kappa FROM med),
gz AS (SELECT *, CASE WHEN load > 0 THEN least(1 - exp(-load / kappa), 1) ELSE 0 END AS gz FROM kap)"""
PARTS = f"""{EXS}, counted AS (SELECT * FROM exs WHERE announcement_status <> 'archived-manual' AND start_date - 14 <= end_date),
spread AS (SELECT region, CAST(unnest(generate_series(start_date - 14, end_date, INTERVAL 1 DAY)) AS DATE) AS date, id, scale, rhetoric_score FROM counted),
parts AS (SELECT region, date, CAST(sum(least(coalesce(nullif(scale, 0), 5000), 80000)) AS BIGINT) / (count(*) * 80000.0::DOUBLE) AS ex, (CAST(sum(CAST(rhetoric_score AS DECIMAL(10, 4))) AS DOUBLE) / count(rhetoric_score) + 1) / 2 AS rh, count(*) AS n_exercises FROM spread GROUP BY region, date)"""


def _load(spark, d):
    return X.rolling_load(X.daily_weights(B.incidents(spark, d)))


@query(f"WITH {EXACT} SELECT region, CAST(date AS VARCHAR) AS date, title, severity, corroboration, rep_id FROM ev")
def event_clusters_exact_title(spark, d):
    return X.events_by_title(B.incidents(spark, d))


@query(f"WITH RECURSIVE {EVENTS} SELECT region, rep_id, CAST(date AS VARCHAR) AS date, severity, corroboration, title, first_severity, first_corroboration FROM ev")
def event_clusters(spark, d):
    """Greedy clusters of similar titles, the events that the index weighs."""
    return C.event_clusters(B.incidents(spark, d))


PARTED = f"{INC}, t AS (SELECT id, region, date, regexp_replace(title, ' [A-Z]+$', '') AS p, regexp_extract(title, '[A-Z]+$') AS s FROM inc)"


@query(f"WITH {PARTED} SELECT r.id AS a, t.id AS b FROM t r JOIN t ON r.region = t.region AND t.date BETWEEN r.date AND r.date + 1 AND (t.date > r.date OR t.id > r.id) WHERE {SIMILAR.replace('r.s = s', 'r.s = t.s').replace('r.p = p', 'r.p = t.p').replace('(p =', '(t.p =').replace('(p IN', '(t.p IN').replace('OR s =', 'OR t.s =').replace('AND s IN', 'AND t.s IN')}")
def similar_title_pairs(spark, d):
    """Reports of a region, at most a day apart, whose titles are similar."""
    return C.similar_pairs(B.incidents(spark, d)).select("a", "b")


@query(f"WITH RECURSIVE {EVENTS} SELECT region, rep_id, CAST(date AS VARCHAR) AS date, severity, corroboration, title FROM ev")
def late_reports_revised(spark, d):
    """Events after a tenth of the reports came late: those of the runs of days that they fall into are clustered again."""
    rows = B.incidents(spark, d)
    old, late = rows.where("id % 10 <> 3"), rows.where("id % 10 = 3")
    return C.recluster(old, late, C.event_clusters(old))[0].select("region", "rep_id", "date", "severity", "corroboration", "title")


@query(f"WITH RECURSIVE {LOAD} SELECT region, CAST(date AS VARCHAR) AS date, round(load, 4) AS load, round(settled, 4) AS settled, events_30d, reports_30d FROM load")
def rolling_load_31d(spark, d):
    return _load(spark, d).select("region", "date", F.round("load", 4).alias("load"), F.round("settled", 4).alias("settled"), "events_30d", "reports_30d")


@query(f"WITH RECURSIVE {KAPPA} SELECT region, CAST(date AS VARCHAR) AS date, round(median_load, 4) AS median_load, active_days, round(kappa, 4) AS kappa FROM kap")
def kappa_trailing_median(spark, d):
    return X.with_kappa(_load(spark, d)).select("region", "date", F.round("median_load", 4).alias("median_load"), "active_days", F.round("kappa", 4).alias("kappa"))


@query(f"WITH RECURSIVE {KAPPA} SELECT region, CAST(date AS VARCHAR) AS date, round(gz, 4) AS gz FROM gz")
def gz_score_daily(spark, d):
    return X.with_gz(_load(spark, d)).select("region", "date", F.round("gz", 4).alias("gz"))


@query(f"""WITH {EXS}, ends AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(start_date)) FROM exs), (SELECT max(end_date) FROM exs), INTERVAL 1 MONTH)) AS DATE) AS date)
SELECT region, CAST(date AS VARCHAR) AS date, count(*) AS n, min(id) AS first_id, CAST(sum(scale) AS BIGINT) AS total_scale FROM exs JOIN ends ON end_date >= date AND start_date <= date + 14 WHERE announcement_status <> 'archived-manual' GROUP BY region, date""")
def exercise_overlap_join(spark, d):
    """Exercises that count on the first day of each month of the data."""
    exercises = B.exercises(spark, d)
    ends = exercises.agg(F.min("start_date").alias("first"), F.max("end_date").alias("last"))
    months = ends.select(F.explode(F.expr("sequence(cast(date_trunc('month', first) as date), last, interval 1 month)")).alias("date"))
    days = exercises.select("region").distinct().crossJoin(F.broadcast(months))  # one row a month
    return X.exercise_days(exercises, days).groupBy("region", "date").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("scale").alias("total_scale"))


@query(f"WITH {PARTS} SELECT region, CAST(date AS VARCHAR) AS date, floor(ex * 10000 + 0.5) / 10000.0::DOUBLE AS ex, floor(rh * 10000 + 0.5) / 10000.0::DOUBLE AS rh, n_exercises FROM parts")
def ex_rh_components(spark, d):
    return X.exercise_parts(B.exercises(spark, d)).select("region", "date", scoring.half_up(F.col("ex"), 4).alias("ex"), scoring.half_up(F.col("rh"), 4).alias("rh"), "n_exercises")


# The regions' names stand for nations here, so each takes the baseline of the region of the same number, if there is one.
BASELINES = "base AS (SELECT * FROM (VALUES " + ", ".join(f"('NATION_{k}', {v[5]})" for k, v in enumerate(dims.REGIONS.values())) + ") b(region, baseline))"


COMPOSITE = f"""WITH RECURSIVE {KAPPA}, {PARTS}, {BASELINES} SELECT gz.region, CAST(gz.date AS VARCHAR) AS date, round(least((round(gz, 6) * 0.45 + coalesce(ex, 0) * 0.35 + coalesce(baseline, 0.05)::DOUBLE * 0.20) * 100, 100), 1) AS ei_score, floor(round(gz, 6) * 100 * 10 + 0.5) / 10.0::DOUBLE AS gz_score, floor(coalesce(ex, 0) * 100 * 10 + 0.5) / 10.0::DOUBLE AS ex_score,
floor(coalesce(rh, 0.5) * 100 * 10 + 0.5) / 10.0::DOUBLE AS rh_score, round(kappa, 4) AS kappa, reports_30d, events_30d FROM gz LEFT JOIN parts ON gz.region = parts.region AND gz.date = parts.date LEFT JOIN base ON base.region = gz.region"""


def _baselines(spark):
    return spark.createDataFrame([(f"NATION_{k}", v[5]) for k, v in enumerate(dims.REGIONS.values())], "region string, baseline double")


@query(COMPOSITE)
def composite_index_history(spark, d):
    return X.composite_history(B.incidents(spark, d), B.exercises(spark, d), _baselines(spark))


@query(COMPOSITE)
def index_revised_by_late_reports(spark, d):
    """The index after one report in 500 came late: only the days that these can change are worked out again."""
    rows, exercises, baselines = B.incidents(spark, d), B.exercises(spark, d), _baselines(spark)
    old, late = rows.where("id % 500 <> 7"), rows.where("id % 500 = 7")
    daily = X.daily_weights(old)
    history = C.written(X.composite_history(old, exercises, baselines, daily), "history")
    return X.revised(history, daily, old, late, exercises, baselines)[0]


@query(f"""WITH v AS (SELECT vec_id AS id, label, vec_id % 3 AS day, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND ((p.day = q.day AND p.id < q.id) OR q.day = p.day + 1)
WHERE 100 * list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e) * list_inner_product(q.e, q.e)) >= 20""")
def similar_by_embedding(spark, d):
    """Vectors of a label at most a day apart with a cosine of 0.2 or more: the join of titles with another scorer."""
    rows = B.read(spark, d, "embeddings").selectExpr("vec_id as id", "cast(label as string) as region", "date_add(date'2024-01-01', cast(vec_id % 3 as int)) as date", "embedding")
    return C.similar_pairs(rows, "embedding", fuzzy.cosine_scores, 20.0).select("a", "b")


@query()
def similar_by_sequence(spark, d):
    """Pairs of similar report titles by difflib's ratio, the scorer to fall back on; a test compares with a loop."""
    return C.similar_pairs(B.reports(spark, d), "title", fuzzy.sequence_scores, 70.0)
