"""The daily job as one composition: ingest, classify, classify exercises, index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.functions import text as T
from tocsin.operators.index import composite_history
from tocsin.operators.insert import insert_new
from tocsin.operators.sinks import write_back

ANSWER = "category string, escalation_level string, region string, actors array<string>, summary string"
TAXONOMY = "exercise_type string, domain string, scale string, signal_type string, classification string, signal_target string, rhetoric_score string"


def requests(reports: DataFrame, size: int = 600) -> DataFrame:
    """(id, prompt) of reports to label: the raw text, else the title, cut to size; prompt is null where there is neither."""
    text = F.trim(F.coalesce(F.nullif("description", F.lit("")), "title", F.lit("")))
    return reports.select("id", F.nullif(F.substring(text, 1, size), F.lit("")).alias("prompt"))


def unclassifiable(reports: DataFrame, size: int = 600) -> DataFrame:
    """Reports with category unclassifiable where there is nothing to label."""
    empty = requests(reports, size).where("prompt is null").select("id", F.lit("unclassifiable").alias("category"))
    return write_back(reports, empty, "id", ["category"])


def ingest(reports: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """First of each content, address and (title, day), in order of id, that the table hasn't got, with a canonical region or 'Unknown'."""
    return insert_new(reports, table)


def classify(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reports with category, level, actors, region and summary from raw answers; unreadable ones change nothing.

    The answer's region is made canonical, else looked for in the title, else left; a
    report without any is Unknown. Empty actors and summaries change nothing.
    """
    bare = verdicts.select("id", T.verdict_json(F.col("raw"), ANSWER).alias("v")).where("v.category is not null or v.escalation_level is not null or v.region is not null or v.summary is not null")
    actors = F.filter("v.actors", lambda a: a != "")
    ready = bare.select(
        "id",
        T.verdict_category(F.col("v.category")).alias("category"),
        T.verdict_level(F.col("v.escalation_level")).alias("escalation_level"),
        F.when(F.size("v.actors") > 0, actors).alias("actors"),
        F.nullif("v.summary", F.lit("")).alias("description"),
        T.canonicalize(F.col("v.region")).alias("region"),
    )
    named = reports.select("id", T.resolve(F.col("title")).alias("in_text"), F.nullif("region", F.lit("")).alias("had")).join(ready, "id")
    ready = named.withColumn("region", F.coalesce("region", "in_text", "had", F.lit("Unknown"))).drop("in_text", "had")
    return write_back(reports, ready, "id", [c for c in ("category", "escalation_level", "actors", "region", "description") if c in reports.columns])


def rhetoric(exercises: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Exercises with rhetoric score and signal target from raw answers, where they have none yet."""
    v = verdicts.select("id", T.verdict_json(F.col("raw"), "rhetoric_score double, signal_target string").alias("v")).where("v.rhetoric_score is not null or v.signal_target is not null")
    ready = v.select("id", T.rhetoric_score(F.col("v.rhetoric_score")).alias("rhetoric_score"), F.coalesce("v.signal_target", F.lit("Unknown")).alias("signal_target"))
    return write_back(exercises, ready.join(exercises.where("rhetoric_score is null").select("id"), "id", "left_semi"), "id", ["rhetoric_score", "signal_target"])


def exercise_requests(exercises: DataFrame, size: int = 400) -> DataFrame:
    """(id, name, context) of exercises without a type: the raw summary, else the name, cut to size."""
    return exercises.where("exercise_type is null").select("id", "name", F.substring(F.coalesce(F.nullif("raw_summary", F.lit("")), "name"), 1, size).alias("context"))


def classify_exercises(exercises: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Exercises with type, domain, scale label, signal, class, target and rhetoric from raw answers, where they have no type.

    Values outside the taxonomy are dropped. The scale of an answer is a label, so it
    goes to scale_label and never into the number of troops.
    """
    v = verdicts.select("id", T.verdict_json(F.col("raw"), TAXONOMY).alias("v")).where("v is not null")
    allowed = lambda c, known: F.when(F.col(f"v.{c}").isin(*known), F.col(f"v.{c}"))
    ready = v.select(
        "id",
        allowed("exercise_type", dims.EXERCISE_TYPES).alias("exercise_type"),
        allowed("domain", dims.DOMAINS).alias("domain"),
        allowed("scale", dims.SCALES).alias("scale_label"),
        allowed("signal_type", dims.SIGNALS).alias("signal_type"),
        allowed("classification", dims.CLASSES).alias("classification"),
        F.col("v.signal_target").alias("signal_target"),
        F.when(F.col("v.rhetoric_score").try_cast("double").isNotNull(), T.rhetoric_score(F.col("v.rhetoric_score").try_cast("double"))).alias("rhetoric_score"),
    )
    fields = ready.columns[1:]
    full = exercises.withColumns({c: F.lit(None).cast("string") for c in fields if c not in exercises.columns})
    return write_back(full, ready.join(full.where("exercise_type is null").select("id"), "id", "left_semi"), "id", fields)


def exercise_context(exercises: DataFrame) -> DataFrame:
    """(id, context): what a brief of an exercise is written from; missing values are empty, statements cut to 300."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return exercises.select("id", F.format_string("Exercise: %s\nType: %s | Domain: %s\nScale: %s | Signal type: %s\nSignal target: %s | Rhetoric score: %s\nContext: %s", *map(field, ("name", "exercise_type", "domain", "scale", "signal_type", "signal_target", "rhetoric_score")), F.substring(field("raw_summary"), 1, 300)).alias("context"))


def daily(reports: DataFrame, verdicts: DataFrame, exercises: DataFrame, exercise_verdicts: DataFrame | None = None, baselines: DataFrame | None = None) -> DataFrame:
    """Index history from raw reports, their verdicts, exercises and theirs."""
    if exercise_verdicts is not None:
        exercises = classify_exercises(exercises, exercise_verdicts)
    return composite_history(classify(ingest(unclassifiable(reports)), verdicts), exercises, baselines)
