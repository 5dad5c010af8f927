"""Queries of the board: filters and orders of regions and exercises, dossiers, status, comparisons of reference lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.operators import views as V
from tocsin.operators.sinks import write_back
from tocsin.queries.base import EXS, INC, LONG_TODAY, REP, SER, query, values
from tocsin.sources import bindings as B
from tocsin.sources.feeds import capped, fan_in

LATEST = f"{SER}, last AS (SELECT region, date, ei_score, round(ei_score - before, 4) AS delta FROM (SELECT *, lag(ei_score) OVER (PARTITION BY region ORDER BY date) AS before, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS k FROM ser) WHERE k = 1)"
TODAY = f"DATE '{LONG_TODAY}'"


def _latest(spark, d) -> DataFrame:
    """Each region's newest value with its change since the point before."""
    series = B.index_series(spark, d)
    return V.latest_per(series.join(V.against_previous(series).select("region", "date", "delta"), ["region", "date"]), "region")


@query(f"WITH {INC} SELECT id, CAST(date AS VARCHAR) AS date, region, title FROM inc WHERE id = (SELECT max(id) FROM inc)")
def row_by_id(spark, d):
    """The one report whose id is the greatest, found by an aggregate and a join."""
    rows = B.incidents(spark, d)
    wanted = B.read(spark, d, "orders").agg(F.max("o_orderkey").alias("id"))  # one row
    return rows.join(F.broadcast(wanted), "id").select("id", "date", "region", "title")


@query(f"""WITH {INC}, hit AS (SELECT * FROM inc WHERE category = 'military' AND region = 'NATION_3'), page AS (SELECT * FROM hit ORDER BY date DESC, id DESC LIMIT 200)
SELECT (SELECT count(*) FROM hit) AS total, (SELECT count(*) FROM page) AS shown, (SELECT min(id) FROM page) AS least_id""")
def page_with_total(spark, d):
    """The exact number of rows under a filter beside the page that a reader gets."""
    hit = B.incidents(spark, d).where("category = 'military' and region = 'NATION_3'")
    page = hit.orderBy(F.desc("date"), F.desc("id")).limit(200).agg(F.count("*").alias("shown"), F.min("id").alias("least_id"))
    return hit.agg(F.count("*").alias("total")).join(F.broadcast(page))  # one row each


@query(f"WITH {LATEST} SELECT region, CASE WHEN ei_score >= 50 THEN 'high' WHEN ei_score >= 25 THEN 'moderate' WHEN ei_score < 25 THEN 'low' END AS band, coalesce(delta > 0, false) AS rising FROM last")
def region_bands(spark, d):
    """Band and direction by which a board is filtered; a missing value is in no band."""
    score = F.col("ei_score")
    band = F.when(score >= 50, "high").when(score >= 25, "moderate").when(score < 25, "low")
    return _latest(spark, d).select("region", band.alias("band"), F.coalesce(F.col("delta") > 0, F.lit(False)).alias("rising"))


@query(f"WITH {LATEST} SELECT count(*) FILTER (floor(ei_score + 0.5) >= 50) AS critical, count(*) FILTER (delta > 0) AS rising, count(*) AS regions FROM last")
def critical_and_rising(spark, d):
    return _latest(spark, d).agg(F.count_if(F.floor(F.col("ei_score") + 0.5) >= 50).alias("critical"), F.count_if(F.col("delta") > 0).alias("rising"), F.count("*").alias("regions"))


NAMED_REGIONS = "r AS (SELECT n_name AS name, 'R' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS region FROM nation)"


def _board(spark, d) -> DataFrame:
    dim = B.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("R"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("region"))
    return dim.join(_latest(spark, d), "region", "left")


@query(f"WITH {LATEST}, {NAMED_REGIONS} SELECT r.region, name, ei_score, delta FROM r LEFT JOIN last ON last.region = r.region")
def regions_with_latest(spark, d):
    """Every region of the dimension with its newest value; missing stays null."""
    return _board(spark, d).select("region", "name", "ei_score", "delta")


@query(f"""WITH {LATEST}, {NAMED_REGIONS} SELECT r.region, row_number() OVER (ORDER BY coalesce(ei_score, -1) DESC, r.region) AS by_score, row_number() OVER (ORDER BY name) AS by_name,
row_number() OVER (ORDER BY delta DESC NULLS LAST, r.region) AS by_rise FROM r LEFT JOIN last ON last.region = r.region""")
def region_orders(spark, d):
    """Places of each region in the three orders of the board (a fixed number of regions)."""
    place = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long")
    return _board(spark, d).select("region", place(F.coalesce("ei_score", F.lit(-1.0)).desc(), "region").alias("by_score"), place("name").alias("by_name"), place(F.desc_nulls_last("delta"), "region").alias("by_rise"))


ORDERS = {"latest": "start_date DESC, id DESC", "oldest": "start_date, id", "troops": "coalesce(scale, 0) DESC, id DESC", "signal": "coalesce(rhetoric_score, 0) DESC, id"}


@query(f"WITH {EXS} " + " UNION ALL ".join(f"(SELECT '{name}' AS ordering, id, row_number() OVER (ORDER BY {by}) AS k FROM exs ORDER BY {by} LIMIT 20)" for name, by in ORDERS.items()))
def exercise_orders(spark, d):
    """The first twenty exercises in each of four orders; every order ends in a top-k of its own."""
    rows = B.exercises(spark, d).select("id", "start_date", "scale", "rhetoric_score")
    keys = {
        "latest": [F.desc("start_date"), F.desc("id")],
        "oldest": [F.asc("start_date"), F.asc("id")],
        "troops": [F.coalesce("scale", F.lit(0)).desc(), F.desc("id")],
        "signal": [F.coalesce("rhetoric_score", F.lit(0.0)).desc(), F.asc("id")],
    }
    parts = [rows.orderBy(*by).limit(20).select(F.lit(name).alias("ordering"), "id", F.row_number().over(Window.orderBy(*by)).cast("long").alias("k")) for name, by in keys.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {EXS} SELECT id FROM exs WHERE coalesce(announcement_status, '') <> 'archived-manual' AND coalesce(end_date, start_date) >= {TODAY} - 14")
def current_exercises(spark, d):
    """Exercises that are neither archived nor ended over two weeks ago."""
    kept = (F.coalesce("announcement_status", F.lit("")) != "archived-manual") & (F.coalesce("end_date", "start_date") >= F.date_sub(F.lit(LONG_TODAY).cast("date"), 14))
    return B.exercises(spark, d).where(kept).select("id")


@query(f"WITH {EXS} SELECT id FROM exs WHERE start_date <= {TODAY} + 14 AND coalesce(end_date, start_date) >= {TODAY} - 14 AND contains(lower(domain), 'mari')")
def exercises_in_window_by_domain(spark, d):
    day = F.lit(LONG_TODAY).cast("date")
    near = (F.col("start_date") <= F.date_add(day, 14)) & (F.coalesce("end_date", "start_date") >= F.date_sub(day, 14))
    return B.exercises(spark, d).where(near & F.lower("domain").contains("mari")).select("id")


@query(f"WITH {EXS} SELECT id, region FROM exs WHERE contains(lower(name), 'nation_1') OR contains(lower(region), 'nation_1') OR contains(lower(region), '_2')")
def exercises_relevant_to_region(spark, d):
    """Name or region has the region's first word, or region has the theatre."""
    return V.relevant_exercises(B.exercises(spark, d), "NATION_1 north", "_2").select("id", "region")


@query(f"WITH {REP} SELECT rep.id, trim(substring(rep.description, 1, 600)) AS prompt FROM rep LEFT JOIN labels ON doc_id = rep.id WHERE quality IS NULL ORDER BY rep.id LIMIT 20")
def rows_without_label(spark, d):
    """The first twenty reports that no verdict covers: what a labelling run would take next."""
    labels = B.read(spark, d, "labels").where("quality is not null").select(F.col("doc_id").alias("id"))
    rows = B.reports(spark, d).join(labels, "id", "left_anti").orderBy("id").limit(20)
    return rows.select("id", F.trim(F.substring("description", 1, 600)).alias("prompt"))


@query(f"""WITH {INC}, {EXS}, i AS (SELECT region, count(*) AS reports, max(date) AS newest_report FROM inc GROUP BY region), e AS (SELECT region, count(*) AS exercises, max(start_date) AS newest_exercise FROM exs GROUP BY region)
SELECT coalesce(i.region, e.region) AS region, coalesce(reports, 0) AS reports, CAST(newest_report AS VARCHAR) AS newest_report, coalesce(exercises, 0) AS exercises, CAST(newest_exercise AS VARCHAR) AS newest_exercise FROM i FULL JOIN e ON e.region = i.region""")
def region_dossiers(spark, d):
    """What is known of each region, both tables summed up before they meet."""
    return V.dossiers(B.incidents(spark, d), B.exercises(spark, d))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_status(spark, d):
    """Rows of every table, from Parquet footers."""
    names = ("documents", "labels", "events", "orders", "lineitem")
    return reduce(DataFrame.unionByName, [B.read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in names])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS only_in FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def key_sets_compared(spark, d):
    """Keys that only one of two lists has; no rows if the lists are equal."""
    return V.keys_in_one(B.read(spark, d, "documents"), B.read(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "only_in")


@query(f"WITH {INC} SELECT region, count(*) AS inserted, count(*) FILTER (category = 'none') AS skipped, count(*) FILTER (escalation_level >= 4) AS flagged FROM inc GROUP BY region UNION ALL SELECT '(all)', count(*), count(*) FILTER (category = 'none'), count(*) FILTER (escalation_level >= 4) FROM inc")
def ingest_counters(spark, d):
    """Counters of each source and of all: one aggregate with a grand total."""
    counts = [F.count("*").alias("inserted"), F.count_if(F.expr("category = 'none'")).alias("skipped"), F.count_if(F.expr("escalation_level >= 4")).alias("flagged")]
    rows = B.incidents(spark, d).rollup("region").agg(F.grouping_id().alias("g"), *counts)
    return rows.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("region")).alias("region"), "inserted", "skipped", "flagged")



ALL_REGIONS = ["Gaza & Middle East", "Ukraine", "Sudan", "South China Sea", "Taiwan Strait", "Yemen", "Sahel", "Korean Peninsula", "Myanmar", "DRC", "Syria", "Somalia", "Baltic", "Haiti", "Ethiopia", "South Caucasus", "Libya", "Kosovo", "Arctic", "Mozambique"]
NEARLY = [*ALL_REGIONS, "baltic", "Unknown", "Europe", ""]


@query(f"WITH {REP}, n AS (SELECT * FROM {values(list(enumerate(NEARLY)))} n(k, region)) SELECT id, n.region, n.region IN ('Baltic', 'Taiwan Strait', 'Haiti', 'Libya') AS recalibrating FROM rep JOIN n ON k = id % 24 WHERE k < 20")
def canonical_regions_only(spark, d):
    """Reports whose region is one of the twenty by its exact name, and whether that region has a note on its baseline."""
    named = B.reports(spark, d).select("id", F.get(F.array(*[F.lit(r) for r in NEARLY]), (F.col("id") % len(NEARLY)).cast("int")).alias("region"))
    notes = spark.createDataFrame([(r, "baseline not settled") for r in dims.RECALIBRATING], "region string, note string")
    return named.where(F.col("region").isin(*dims.REGIONS)).join(F.broadcast(notes), "region", "left").select("id", "region", F.col("note").isNotNull().alias("recalibrating"))


@query(f"WITH {REP} SELECT region, id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY id) AS k FROM rep) WHERE k <= 15")
def capped_per_source(spark, d):
    """The first fifteen reports of each source, as a feed's cap takes them."""
    return capped(B.reports(spark, d).select("region", "id"), "region", "id", 15)


@query(f"""WITH {INC}, {REP} SELECT origin, count(*) AS n, min(id) AS first_id FROM (SELECT 'orders' AS origin, id FROM inc UNION ALL SELECT 'documents', id FROM rep) GROUP BY origin""")
def fan_in_counts(spark, d):
    """Two sources as one table, counted by where its rows came from."""
    both = fan_in([B.incidents(spark, d).withColumn("origin", F.lit("orders")), B.reports(spark, d).drop("description").withColumn("origin", F.lit("documents"))])
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {INC}, v AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'terrorism' ELSE 'protest' END AS category FROM labels) SELECT coalesce(v.category, inc.category) AS category, count(*) AS n FROM inc LEFT JOIN v ON v.id = inc.id GROUP BY 1")
def write_back_verdicts(spark, d):
    """Categories after verdicts are written back to the rows that have one."""
    verdicts = B.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "terrorism").otherwise("protest").alias("category"))
    return write_back(B.incidents(spark, d), verdicts, "id", ["category"]).groupBy("category").agg(F.count("*").alias("n"))
