"""Queries of text functions, dictionaries, deduplication, sinks, labels and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.functions import text as T
from tocsin.operators import cluster as C
from tocsin.operators import insert as N
from tocsin.operators import sinks as S
from tocsin.operators import views as V
from tocsin.plans import daily as P
from tocsin.queries.base import DEN, EXS, INC, REP, SER, query, values
from tocsin.sources import bindings as B

TERMS = values([(t, r, i) for i, (t, r) in enumerate(dims.terms())])
HINTS = [*dims.TERMS, "gang", "mss", "Rapid Support Forces", "no such place"]
ROWS = list(enumerate(HINTS))
# Each document's whole text; two of three have one or two terms added at the end, so that the dictionaries find something in prose that is made up.
PHRASES = "phr AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') || ' Near ' || upper(t.term) || '.' ELSE coalesce(text, '') || ' near ' || t.term || ' and ' || u.term || ' troops' END AS title, u.term AS hint FROM documents JOIN " + values(ROWS) + f" t(k, term) ON t.k = doc_id % {len(ROWS)} JOIN " + values(ROWS) + f" u(k, term) ON u.k = (doc_id * 7 + 3) % {len(ROWS)})"


def _phrases(spark, d):
    terms = F.array(*[F.lit(t) for t in HINTS])
    docs, text = B.read(spark, d, "documents"), F.coalesce("text", F.lit(""))
    one, two = F.get(terms, (F.col("doc_id") % len(ROWS)).cast("int")), F.get(terms, ((F.col("doc_id") * 7 + 3) % len(ROWS)).cast("int"))
    title = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.concat(text, F.lit(" Near "), F.upper(one), F.lit("."))).otherwise(F.concat(text, F.lit(" near "), one, F.lit(" and "), two, F.lit(" troops")))
    return docs.select(F.col("doc_id").alias("id"), title.alias("title"), two.alias("hint"))


def first_of(column: str, table: str) -> str:
    """SQL: the region of the least ranked entry that a lower-cased column contains."""
    return f"(SELECT arg_min(x.region, x.rank) FROM {table} x(term, region, rank) WHERE contains({column}, x.term))"


@query(f"""WITH {PHRASES}, v AS (SELECT id, CASE id % 4 WHEN 0 THEN upper(hint) WHEN 1 THEN '  ' || hint || ': shells fall' WHEN 2 THEN (SELECT name FROM {values(list(enumerate(dims.REGIONS)))} y(k, name) WHERE k = id % 20) ELSE NULL END AS value FROM phr)
SELECT id, CASE WHEN value IS NOT NULL THEN coalesce((SELECT any_value(name) FROM {values([(r,) for r in dims.REGIONS])} y(name) WHERE lower(name) = lower(trim(value))), (SELECT any_value(region) FROM {TERMS} x(term, region, rank) WHERE term = lower(trim(value))), {first_of("lower(trim(value))", TERMS)}) END AS region FROM v""")
def region_canonicalize(spark, d):
    names = F.get(F.array(*[F.lit(r) for r in dims.REGIONS]), (F.col("id") % 20).cast("int"))
    value = F.when(F.col("id") % 4 == 0, F.upper("hint")).when(F.col("id") % 4 == 1, F.concat(F.lit("  "), "hint", F.lit(": shells fall"))).when(F.col("id") % 4 == 2, names)
    return _phrases(spark, d).select("id", T.canonicalize(value).alias("region"))


@query(f"WITH {PHRASES}, l AS (SELECT id, lower(title) AS low FROM phr) SELECT id, {first_of('low', TERMS)} AS region FROM l")
def region_resolve_longest(spark, d):
    return _phrases(spark, d).select("id", T.resolve(F.col("title")).alias("region"))


def ranked(mapping: dict) -> str:
    return values([(t, r, i) for i, (t, r) in enumerate(mapping.items())])


def words_of(keywords: dict) -> str:
    return values([(w, r, i) for i, (r, ws) in enumerate(keywords.items()) for w in ws])


def counts(table: str, low: str) -> str:
    """SQL: each text's keywords by region."""
    return f"SELECT l.id, k.region, k.rank, count(*) AS n FROM l JOIN {table} k(word, region, rank) ON contains({low}, k.word) GROUP BY ALL"


@query(f"""WITH {PHRASES}, l AS (SELECT id, lower(title) AS low FROM phr), sc AS ({counts(words_of(dims.KEYWORDS), 'low')}), best AS (SELECT id, arg_max(region, n * 100 - rank) AS region, max(n) AS n FROM sc GROUP BY id),
old AS ({counts(words_of(dims.LOOSE_KEYWORDS), 'low')}), loose AS (SELECT id, arg_max(region, n * 100 - rank) AS region FROM old GROUP BY id)
SELECT l.id, coalesce({first_of('low', ranked(dims.ALIASES))}, CASE WHEN n >= 2 THEN best.region END) AS region, CASE WHEN n >= 2 THEN best.region END AS by_keywords, loose.region AS loosely FROM l LEFT JOIN best ON best.id = l.id LEFT JOIN loose ON loose.id = l.id""")
def region_score_argmax(spark, d):
    """The detector of the feeds (aliases in order, then two keywords), its second half alone, and the loose one."""
    title = F.col("title")
    return _phrases(spark, d).select("id", T.detect_region(title).alias("region"), T.score_regions(title, 2).alias("by_keywords"), T.detect_loosely(title).alias("loosely"))


@query(f"""WITH {PHRASES}, l AS (SELECT id, lower(title || ' ' || hint) AS low, lower(hint) AS hint FROM phr), sc AS ({counts(words_of(dims.LOOSE_KEYWORDS), 'low')}),
best AS (SELECT sc.id, arg_max(region, n * 100 - rank) AS region FROM sc JOIN l ON l.id = sc.id WHERE n >= 2 OR EXISTS (SELECT 1 FROM {words_of(dims.LOOSE_KEYWORDS)} k(word, of_region, rank) WHERE k.word = l.hint AND of_region = sc.region) GROUP BY sc.id)
SELECT l.id, coalesce({first_of('low', ranked(dims.STRICT_ALIASES))}, best.region) AS region FROM l LEFT JOIN best ON best.id = l.id""")
def region_hint_strict(spark, d):
    return _phrases(spark, d).select("id", T.detect_with_hint(F.col("title"), F.col("hint")).alias("region"))


EXERCISE_WORDS = values([(w, r, i) for i, (w, r) in enumerate((w, r) for r, ws in dims.EXERCISE_KEYWORDS.items() for w in ws)])


@query(f"WITH {PHRASES}, l AS (SELECT id, lower(title) AS low FROM phr) SELECT id, {first_of('low', EXERCISE_WORDS)} AS region FROM l")
def exercise_region(spark, d):
    """The first region with any of its exercise keywords; none is left open."""
    return _phrases(spark, d).select("id", T.detect_exercise_region(F.col("title")).alias("region"))


STEMS = " OR ".join(f"contains(low, '{s}')" for s in dims.SECURITY_STEMS)


@query(f"WITH {REP}, l AS (SELECT id, lower(title || ' ' || description) AS low FROM rep) SELECT id, {STEMS} AS security FROM l")
def security_pregate(spark, d):
    return B.reports(spark, d).select("id", T.is_security(F.col("title"), F.col("description")).alias("security"))


@query(f"WITH {REP} SELECT id FROM rep JOIN labels ON doc_id = id WHERE quality = 1")
def gate_fail_closed(spark, d):
    """Only reports whose verdict says so pass; a missing verdict rejects."""
    verdicts = B.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "Answer: security_incident.").otherwise("OTHER").alias("verdict"))
    return B.reports(spark, d).join(verdicts, "id", "left").where(T.gate_verdict(F.col("verdict"))).select("id")


@query(r"""SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS plain FROM pages""")
def clean_html(spark, d):
    return B.read(spark, d, "pages").select("page_id", F.md5(T.clean_html(F.col("html")).cast("binary")).alias("plain"))


@query(r"""WITH f AS (SELECT doc_id AS id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[\t-\r \x1c-\x1f\x85\p{Z}]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT id, t, list_filter(list_transform(string_split(t, '. ')[1:2], lambda s: trim(s)), lambda s: length(s) > 20) AS a, list_filter(list_transform(string_split(t, '! ')[1:2], lambda s: trim(s)), lambda s: length(s) > 20) AS b FROM f)
SELECT id, substring(CASE WHEN len(a) > 0 THEN array_to_string(a, '. ') WHEN len(b) > 0 THEN array_to_string(b, '! ') ELSE t END, 1, 280) AS brief FROM p""")
def extract_brief(spark, d):
    return B.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.extract_brief(F.col("text")).alias("brief"))


@query(f"WITH {REP} SELECT id, sha256(source_url || '|' || substring(title, 1, 100)) AS content_hash FROM rep")
def content_hash(spark, d):
    return B.reports(spark, d).select("id", T.content_hash(F.col("title"), F.col("source_url")).alias("content_hash"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages")
def url_host(spark, d):
    return B.read(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query(r"SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, d):
    return B.read(spark, d, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"WITH {REP}, u AS (SELECT id, title, source || '/' || id % 700 AS url FROM rep JOIN documents ON doc_id = id) SELECT min(id) AS id, url FROM u WHERE url NOT IN (SELECT url FROM u WHERE id % 9 = 0) GROUP BY url")
def exact_dedup(spark, d):
    """Reports whose address the table hasn't got yet (it has every ninth report), the first of each."""
    rows = B.reports(spark, d).withColumn("url", F.concat("source_name", F.lit("/"), (F.col("id") % 700).cast("string")))
    return S.insert_absent(rows, rows.where("id % 9 = 0"), ["url"], "id").select("id", "url")


@query(f"WITH {REP} SELECT min(id) AS id FROM rep WHERE trim(title) <> '' GROUP BY trim(title), date UNION ALL SELECT id FROM rep WHERE trim(title) = ''")
def multikey_dedup(spark, d):
    rows = B.reports(spark, d).withColumn("content_hash", T.content_hash(F.col("title"), F.col("source_url"))).withColumn("title_day", F.when(F.trim("title") != "", F.concat_ws("|", F.trim("title"), "date")))
    return C.keep_first(rows, ["content_hash", "title_day", "source_url"]).select("id")


@query(f"""WITH {REP}, b AS (SELECT id, 'T' || id // 6 AS title, 'u' || id // 2 AS url, date FROM rep),
e AS (SELECT CASE id % 30 WHEN 20 THEN 'other' || id ELSE title END AS title, CASE id % 30 WHEN 10 THEN 'other' || id ELSE url END AS url, CASE id % 30 WHEN 20 THEN date - 400 ELSE date END AS date FROM b WHERE id % 10 = 0)
SELECT min(id) AS id FROM b WHERE NOT EXISTS (FROM e WHERE e.url = b.url AND e.title = b.title) AND NOT EXISTS (FROM e WHERE e.title = b.title AND e.date = b.date) AND NOT EXISTS (FROM e WHERE e.url = b.url) GROUP BY title, date""")
def inserted_into_table(spark, d):
    """Reports that a table by days hasn't got: it has some by content, some by title and day, some by address only."""
    rows = B.reports(spark, d).selectExpr("id", "concat('T', id div 6) as title", "concat('u', id div 2) as source_url", "date", "region")
    k = F.col("id") % 30
    held = rows.where("id % 10 = 0").withColumns({"title": F.when(k == 20, F.concat(F.lit("other"), "id")).otherwise(F.col("title")), "source_url": F.when(k == 10, F.concat(F.lit("other"), "id")).otherwise(F.col("source_url")), "date": F.when(k == 20, F.date_sub("date", 400)).otherwise(F.col("date"))})
    held = held.withColumn("content_hash", T.content_hash(F.col("title"), F.col("source_url")))
    path = C.shared_path(spark, "reports")
    held.write.partitionBy("date").parquet(path)
    return N.insert_new(rows, spark.read.schema(held.schema).parquet(path)).select("id")


@query(f"WITH {SER} SELECT region, CAST(date AS VARCHAR) AS date, CASE WHEN date >= DATE '2024-01-20' THEN round(ei_score + 1, 4) ELSE ei_score END AS ei_score FROM ser")
def upsert_latest_wins(spark, d):
    old = B.index_series(spark, d)
    new = old.where("date >= '2024-01-20'").withColumn("ei_score", F.round(F.col("ei_score") + 1, 4))
    return S.upsert(old, new, ["region", "date"], "n").select("region", "date", "ei_score")


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) AS created, (SELECT count(*) FROM labels WHERE doc_id % 2 = 0) AS updated, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS untouched")
def upsert_created_updated(spark, d):
    """Labels upserted into a table that has the documents with even ids."""
    return S.upsert_counts(B.read(spark, d, "documents").where("doc_id % 2 = 0"), B.read(spark, d, "labels"), "doc_id")


@query(f"""WITH {INC}, bad AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE date END AS date, CASE WHEN id % 17 = 0 THEN NULL ELSE title END AS title, CASE id % 7 WHEN 0 THEN 'terrorism' WHEN 1 THEN NULL ELSE category END AS category, CASE WHEN id % 11 = 0 THEN 6 WHEN id % 11 = 1 THEN 0 WHEN id % 11 = 2 THEN NULL ELSE escalation_level END AS escalation_level, CASE WHEN id % 19 <> 0 THEN source_name || '/' || id % 997 END AS source_url FROM inc),
f AS (SELECT bad.*, m.first FROM bad LEFT JOIN (SELECT source_url, min(id) AS first FROM bad WHERE source_url IS NOT NULL GROUP BY source_url) m USING (source_url))
SELECT violated, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN id % 13 = 0 THEN 'date' END, CASE WHEN id % 17 = 0 THEN 'title' END, CASE WHEN id % 7 = 0 THEN 'category' END, CASE WHEN id % 11 IN (0, 1) THEN 'escalation_level' END, CASE WHEN first < id THEN 'source_url' END], lambda x: x IS NOT NULL), ',') AS violated FROM f) GROUP BY violated""")
def constraint_quarantine(spark, d):
    """Rows by the rules of the table that they break; missing values break only what must not be missing."""
    k = lambda n: F.col("id") % n
    bad = B.incidents(spark, d).withColumns({
        "date": F.when(k(13) != 0, F.col("date")), "title": F.when(k(17) != 0, F.col("title")),
        "category": F.when(k(7) == 0, "terrorism").when(k(7) > 1, F.col("category")),
        "escalation_level": F.when(k(11) == 0, 6).when(k(11) == 1, 0).when(k(11) > 2, F.col("escalation_level")),
        "source_url": F.when(k(19) != 0, F.concat("source_name", F.lit("/"), k(997).cast("string"))),
    })
    checked = S.unique_violations(S.violations(bad, S.INCIDENT_RULES), {"source_url": ["source_url"]}, "id")
    return checked.groupBy(F.array_join("violated", ",").alias("violated")).agg(F.count("*").alias("n"))


@query(f"WITH {DEN}, hit AS (SELECT * FROM den WHERE created_at >= TIMESTAMP '2024-01-29 12:00:00') SELECT (SELECT count(*) FROM hit) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS newest FROM (SELECT * FROM hit ORDER BY created_at DESC, id DESC LIMIT 20)")
def purge_preview(spark, d):
    """How many rows a purge would take, and the newest twenty of them."""
    count, newest = S.purge_preview(B.dense_incidents(spark, d), "created_at", "2024-01-29 12:00:00", "id")
    ids = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id")))), lambda x: x["id"].cast("string")), ",")
    return count.join(newest.agg(ids.alias("newest")))  # one row each


@query(f"WITH {EXS} SELECT announcement_status, count(*) AS n FROM (SELECT CASE WHEN id % 3 = 0 THEN 'archived-manual' ELSE announcement_status END AS announcement_status FROM exs) GROUP BY 1")
def archive_unregistered(spark, d):
    rows = B.exercises(spark, d).withColumn("registry_id", F.when(F.col("id") % 3 != 0, F.col("id").cast("string")))
    return S.archive_unregistered(rows).groupBy("announcement_status").agg(F.count("*").alias("n"))


@query(f"WITH {SER} SELECT region, CAST(date AS VARCHAR) AS date, ei_score, ei_score AS di_score FROM ser")
def renamed_index_view(spark, d):
    """The old name as a view that has the column under both its names."""
    S.renamed_with_view(B.index_series(spark, d).select("region", "date", F.col("ei_score").alias("di_score")), "di_score", "ei_score", "deterrence_index")
    return spark.table("deterrence_index")


@query(f"WITH {DEN} SELECT count(*) AS n, max(id) AS last_id FROM den WHERE created_at < TIMESTAMP '2024-01-15 12:00:00'")
def purge_window(spark, d):
    return S.purge(B.dense_incidents(spark, d), "created_at", "2024-01-15 12:00:00").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query(f"""WITH {PHRASES}, r AS (SELECT hint AS old, coalesce({first_of('lower(title)', TERMS)}, '(unresolved)') AS new FROM phr)
SELECT old, new, count(*) AS n FROM r WHERE old <> new GROUP BY old, new ORDER BY n DESC, old, new LIMIT 20""")
def top_remaps(spark, d):
    return V.remaps(_phrases(spark, d), F.col("hint"), T.resolve(F.col("title")))


@query(f"""WITH {PHRASES}, r AS (SELECT hint AS old, {first_of('lower(title)', TERMS)} AS new FROM phr) SELECT count(*) FILTER (new IS NOT NULL AND new <> old) AS changed, count(*) FILTER (new IS NULL) AS unresolved, count(*) AS n FROM r""")
def remap_totals(spark, d):
    return V.remap_totals(_phrases(spark, d), F.col("hint"), T.resolve(F.col("title")))


@query(f"""WITH {PHRASES}, r AS (SELECT id, coalesce({first_of('lower(title)', TERMS)}, hint) AS region FROM phr) SELECT region, count(*) AS n FROM r GROUP BY region""")
def backfill_regions(spark, d):
    return _phrases(spark, d).withColumn("region", F.coalesce(T.resolve(F.col("title")), "hint")).groupBy("region").agg(F.count("*").alias("n"))


# A sentence on an exercise at the end of each document's whole text: the forms that are read, forms that just miss, and none.
# (form, first day, last day, number): what the rules of the two parsers give for it, written out by hand.
DATED = [
    ("Drill held 12-15 March 2025 with 12,500 troops", "2025-03-12", "2025-03-15", 12500),
    ("drill on 3\u20139 MAY 2026, more than 9,000 came", "2026-05-03", "2026-05-09", 9000),
    ("June 10-14, 2024: approximately 12,000 in all", "2024-06-10", "2024-06-14", 12000),
    ("september 1-30 2023 and 5,000 NATO staff", "2023-09-01", "2023-09-30", 5000),
    ("in 1999 some 450 people", "1999-01-01", "1999-12-31", 450),
    ("30-31 February 2025 with 5 troops", "2025-01-01", "2025-12-31", None),
    ("12 - 15 March 2025 for 800 allied soldiers", "2025-01-01", "2025-12-31", 800),
    ("soon, with many ships", "2024-06-01", "2024-06-15", None),
    ("in the year 0000 over , soldiers", "2024-06-01", "2024-06-15", None),
    ("June 31-32, 2024 by 1,200 service members", "2024-01-01", "2024-12-31", 1200),
    ("about 7,77 and 30,000 personnel on 1-2 July 2022", "2022-07-01", "2022-07-02", 30000),
]
# The documents' own digits (addresses, card numbers, years) would be read too, so they are taken out of the text before the sentence is added.
FORMS = values([(k, *(x if x is not None else "" for x in row[:3]), -1 if row[3] is None else row[3]) for k, row in enumerate(DATED)])


def _dated(spark, d):
    forms = F.get(F.array(*[F.lit(f) for f, *_ in DATED]), (F.col("doc_id") % len(DATED)).cast("int"))
    return B.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", ""), F.lit(". "), forms).alias("text"))


@query(f"SELECT doc_id AS id, f.first AS start_date, f.last AS end_date FROM documents JOIN {FORMS} f(k, form, first, last, n) ON k = doc_id % {len(DATED)}")
def exercise_date_parse(spark, d):
    found = T.exercise_dates(F.col("text"), F.lit("2024-06-01").cast("date"))
    return _dated(spark, d).select("id", found.alias("f")).select("id", F.col("f.start").alias("start_date"), F.col("f.end").alias("end_date"))


@query(f"SELECT doc_id AS id, CAST(n AS BIGINT) AS troops FROM documents JOIN {FORMS} f(k, form, first, last, n) ON k = doc_id % {len(DATED)}")
def troop_count(spark, d):
    return _dated(spark, d).select("id", F.coalesce(T.troop_count(F.col("text")), F.lit(-1)).cast("long").alias("troops"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 3 WHEN l_quantity >= 5 THEN 2 ELSE 1 END AS from_deaths, least(greatest(1 + CASE WHEN l_quantity >= 10 THEN 2 WHEN l_quantity >= 1 THEN 1 ELSE 0 END + CASE WHEN l_returnflag IN ('R', 'A') THEN 2 ELSE 0 END, 1), 5) AS from_fatalities, CASE l_returnflag WHEN 'R' THEN 'proxy' WHEN 'A' THEN 'proxy' ELSE CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE 'disinfo' END END AS category FROM lineitem")
def severity_from_deaths(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "Battles").when(F.col("l_returnflag") == "A", "Explosions/Remote violence").when(F.col("l_linenumber") == 1, "Battle royale").otherwise("Protests")
    return B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.from_deaths(F.col("l_quantity")).alias("from_deaths"), T.from_fatalities(kind, F.col("l_quantity")).alias("from_fatalities"), T.event_category(kind).alias("category"))


# Raw answers for each document, and what becomes of a report with category 'unknown', level 2 and no region.
# (answer, category, level, actors, region or null, summary or null); region null: from the text, else Unknown.
ANSWERS = [
    ('```json\n{"category": " Cyber ", "escalation_level": "4", "region": "Lebanon", "actors": ["A", "", "B"], "summary": "One."}\n```', "cyber", 4, "A,B", "Gaza & Middle East", "One."),
    ('{"category": "none", "escalation_level": 9, "region": "kyiv oblast", "actors": []}', "unknown", 5, "", "Ukraine", None),
    ('{"category": "diplomatic", "escalation_level": 0, "region": null}', "diplomatic", 2, "", None, None),
    ('{"category": "terrorism", "escalation_level": -3, "region": "Atlantis", "summary": ""}', "unknown", 1, "", None, None),
    ("not json", None, None, None, None, None),
    ('{"category": "unclassifiable", "escalation_level": null, "region": "SAHEL"}', "unknown", 2, "", "Sahel", None),
    ('```\n{"category": "Airspace"}\n```', "airspace", 2, "", None, None),
]
ANSWER_ROWS = "(VALUES " + ", ".join("(" + ", ".join([str(k), *("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row[1:])]) + ")" for k, row in enumerate(ANSWERS)) + ")"


@query(f"""WITH {PHRASES}, a AS (SELECT * FROM {ANSWER_ROWS} a(k, category, level, actors, region, summary))
SELECT id, coalesce(category, 'unknown') AS category, coalesce(level, 2) AS escalation_level, coalesce(actors, '') AS actors, CASE WHEN category IS NULL THEN NULL ELSE coalesce(a.region, {first_of('lower(title)', TERMS)}, 'Unknown') END AS region, coalesce(summary, 'as it was') AS description
FROM phr JOIN a ON k = id % {len(ANSWERS)} WHERE id % 5 <> 4 UNION ALL SELECT id, 'unknown', 2, '', NULL, 'as it was' FROM phr WHERE id % 5 = 4""")
def verdict_ingest(spark, d):
    """Reports after their answers are written back; one in five has none, and some can't be read."""
    rows = _phrases(spark, d).select("id", "title", F.lit("as it was").alias("description"), F.lit("unknown").alias("category"), F.lit(2).alias("escalation_level"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("array<string>").alias("actors"))
    raw = F.get(F.array(*[F.lit(a) for a, *_ in ANSWERS]), (F.col("id") % len(ANSWERS)).cast("int"))
    verdicts = rows.where("id % 5 <> 4").select("id", raw.alias("raw"))
    return P.classify(rows, verdicts).select("id", "category", "escalation_level", F.coalesce(F.array_join("actors", ","), F.lit("")).alias("actors"), "region", "description")


@query(f"""WITH {EXS}, x AS (SELECT id, CASE WHEN id % 3 = 0 THEN rhetoric_score END AS had FROM exs) SELECT id, CASE WHEN had IS NOT NULL THEN had WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 0 THEN 1.0 WHEN id % 5 = 1 THEN -1.0 WHEN id % 5 = 2 THEN 0.0 ELSE 0.25 END AS rhetoric_score,
CASE WHEN had IS NOT NULL OR id % 5 = 4 THEN 'as it was' WHEN id % 5 = 1 THEN 'Unknown' ELSE 'Russia' END AS signal_target FROM x""")
def rhetoric_ingest(spark, d):
    """Scores are clamped, a missing one is 0, a missing target Unknown; exercises that have a score keep it."""
    rows = B.exercises(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.col("rhetoric_score")).alias("rhetoric_score"), F.lit("as it was").alias("signal_target"))
    raw = F.get(F.array(*[F.lit(x) for x in ('{"rhetoric_score": 3.5, "signal_target": "Russia"}', '```json{"rhetoric_score": -7}```', '{"signal_target": "Russia"}', '{"rhetoric_score": 0.25, "signal_target": "Russia"}', "none")]), (F.col("id") % 5).cast("int"))
    return P.rhetoric(rows, rows.select("id", raw.alias("raw")))


EX_ANSWERS = [
    '```json\n{"exercise_type": "CPX", "domain": "Cyber", "scale": "Large", "signal_type": "Deterrence", "classification": "Elevated", "signal_target": "Russia", "rhetoric_score": 0.75}\n```',
    '{"exercise_type": "PARADE", "domain": "Moon", "scale": "30000", "signal_type": "Anger", "rhetoric_score": "5"}',
    "sorry",
]


@query(f"""WITH {EXS} SELECT id, CASE WHEN id % 4 = 0 THEN 'FTX' WHEN id % 3 = 0 THEN 'CPX' END AS exercise_type, CASE WHEN id % 4 <> 0 AND id % 3 = 0 THEN 'Cyber' ELSE domain END AS domain, CASE WHEN id % 4 <> 0 AND id % 3 = 0 THEN 'Large' END AS scale_label, CASE WHEN id % 4 <> 0 AND id % 3 = 0 THEN 'Elevated' END AS classification, scale,
CASE WHEN id % 4 <> 0 AND id % 3 = 0 THEN 0.75 WHEN id % 4 <> 0 AND id % 3 = 1 THEN 1.0 ELSE rhetoric_score END AS rhetoric_score FROM exs""")
def exercise_taxonomy(spark, d):
    """Answers on exercises without a type; values outside the taxonomy are dropped, and the number of troops stays a number."""
    rows = B.exercises(spark, d).withColumn("exercise_type", F.when(F.col("id") % 4 == 0, "FTX"))
    raw = F.get(F.array(*[F.lit(x) for x in EX_ANSWERS]), (F.col("id") % 3).cast("int"))
    return P.classify_exercises(rows, rows.select("id", raw.alias("raw"))).select("id", "exercise_type", "domain", "scale_label", "classification", "scale", "rhetoric_score")


@query(f"""WITH {EXS} SELECT id, 'Exercise: ' || name || chr(10) || 'Type:  | Domain: ' || domain || chr(10) || 'Scale: ' || scale || ' | Signal type: ' || chr(10) || 'Signal target: Russia | Rhetoric score: ' || chr(10) || 'Context: ' || substring(repeat(name || ' ', 30), 1, 300) AS context FROM exs""")
def exercise_context(spark, d):
    rows = B.exercises(spark, d).withColumns({"exercise_type": F.lit(None).cast("string"), "signal_type": F.lit(None).cast("string"), "signal_target": F.lit("Russia"), "rhetoric_score": F.lit(None).cast("double"), "raw_summary": F.repeat(F.concat("name", F.lit(" ")), 30)})
    return P.exercise_context(rows)


@query(f"""WITH {EXS} SELECT id, name, substring(CASE WHEN id % 2 = 0 THEN repeat(name || ' ', 40) ELSE name END, 1, 400) AS context FROM exs WHERE id % 3 <> 0""")
def exercise_requests(spark, d):
    rows = B.exercises(spark, d).withColumns({"exercise_type": F.when(F.col("id") % 3 == 0, "CPX"), "raw_summary": F.when(F.col("id") % 2 == 0, F.repeat(F.concat("name", F.lit(" ")), 40)).otherwise("")})
    return P.exercise_requests(rows)


@query(r"""WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN '   ' ELSE text END AS description, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 = 0 THEN NULL ELSE 'T' || doc_id END AS title FROM documents),
p AS (SELECT id, substring(trim(coalesce(nullif(description, ''), title, '')), 1, 600) AS prompt FROM r) SELECT id, nullif(prompt, '') AS prompt, CASE WHEN nullif(prompt, '') IS NULL THEN 'unclassifiable' ELSE 'unknown' END AS category FROM p""")
def label_requests(spark, d):
    """What is sent to be labelled; reports without any text are unclassifiable."""
    rows = B.reports(spark, d).select("id", F.when(F.col("id") % 6 == 0, "   ").otherwise(F.col("description")).alias("description"), F.when(~((F.col("id") % 6 == 0) & (F.col("id") % 4 == 0)), F.concat(F.lit("T"), F.col("id").cast("string"))).alias("title"), F.lit("unknown").alias("category"))
    return P.requests(rows).join(P.unclassifiable(rows).select("id", "category"), "id")


SOURCE_NAMES = ["UN News Africa", "OCHA", "ReliefWeb", "UCDP (Uppsala University)", "SIPRI", "Bellingcat", "CIT (Leviev)", "The Guardian", "CSIS", "Crisis Group ICG", "Wikipedia Current Events", "Naval News", "ACLED (UN)", None, ""]
CLASSES = ["Inst", "Inst", "Inst", "Acad", "Acad", "OSINT", "OSINT", "Media", "Anal", "Anal", "Disc", "Media", "Inst", "Media", "Media"]
DAYS = ["2024-02-29T10:00:00Z", "2024-02-30", "2024-03-01", "yesterday", None, "", "2024-03-02 00:00", "24-03-01"]


@query(f"""WITH s AS (SELECT * FROM {values(list(enumerate(CLASSES)))} s(k, class)), dd AS (SELECT * FROM (VALUES (0, DATE '2024-02-29'), (1, NULL), (2, DATE '2024-03-01'), (3, NULL), (4, NULL), (5, NULL), (6, DATE '2024-03-02'), (7, NULL)) dd(k, day))
SELECT doc_id AS id, class, CAST(a.day AS VARCHAR) AS day, coalesce(abs(a.day - b.day) <= 1, true) AS close FROM documents JOIN s ON s.k = doc_id % 15 JOIN dd a ON a.k = doc_id % 8 JOIN dd b ON b.k = doc_id // 8 % 8""")
def source_classes_and_dates(spark, d):
    """Confidence class of a source's name, a day read leniently, and whether two days are close (a missing one is close to any)."""
    name = F.get(F.array(*[F.lit(x).cast("string") for x in SOURCE_NAMES]), (F.col("doc_id") % 15).cast("int"))
    days = F.array(*[F.lit(x).cast("string") for x in DAYS])
    one, two = F.get(days, (F.col("doc_id") % 8).cast("int")), F.get(days, (F.floor(F.col("doc_id") / 8) % 8).cast("int"))
    return B.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.source_confidence(name).alias("class"), T.lenient_date(one).alias("day"), T.dates_close(T.lenient_date(one), T.lenient_date(two)).alias("close"))


@query("SELECT CASE WHEN length(trim(substring(text, 1, 600))) > 0 THEN 'unknown' ELSE 'unclassifiable' END AS category, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1")
def resweep(spark, d):
    """Unclassifiable reports that have a text are open again."""
    rows = B.read(spark, d, "documents").join(B.read(spark, d, "labels").where("quality = 0"), "doc_id")
    return rows.groupBy(F.when(F.length(F.trim(F.substring("text", 1, 600))) > 0, "unknown").otherwise("unclassifiable").alias("category")).agg(F.count("*").alias("n"))


COUNTRY = [("NATION_0", "Sahel"), ("NATION_1", "Sahel"), ("NATION_1", "Libya"), ("NATION_2", "Baltic"), ("NATION_3", "Arctic"), ("NATION_3", "Baltic")]


@query(f"WITH {INC} SELECT c.region, count(*) AS n FROM inc JOIN {values(COUNTRY)} c(country, region) ON c.country = inc.region GROUP BY c.region")
def country_to_region(spark, d):
    """A country may count towards several regions: the fan-out is intended."""
    dim = spark.createDataFrame(COUNTRY, "country string, target string")
    return B.incidents(spark, d).join(F.broadcast(dim), F.col("region") == F.col("country")).groupBy(F.col("target").alias("region")).agg(F.count("*").alias("n"))


@query(f"WITH {SER} SELECT region, CAST(date AS VARCHAR) AS date, CASE WHEN ei_score >= 65 THEN 'HIGH' WHEN ei_score >= 45 THEN 'MODERATE' WHEN ei_score >= 25 THEN 'ELEVATED' ELSE 'LOW' END AS label FROM ser")
def index_labels(spark, d):
    return B.index_series(spark, d).select("region", "date", T.index_label(F.col("ei_score")).alias("label"))


@query()
def fuzzy_pairs(spark, d):
    """Report titles of a region that differ by at most a day and are similar, by the quick scorer."""
    return C.similar_pairs(B.reports(spark, d)).select("a", "b")


@query()
def report_clusters(spark, d):
    """Events among the documents' titles, as C.event_clusters finds them; tests compare with the greedy loop."""
    rows = B.reports(spark, d).withColumn("escalation_level", (F.col("id") % 5 + 1).cast("int"))
    return C.event_clusters(rows).select("region", "rep_id", "date", "severity", "corroboration", "title")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
run(user_id, k, hits, event_id, accepted) AS (
  SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BOOLEAN FROM e
  UNION ALL
  SELECT user_id, k, CASE WHEN len(near) < 2 THEN list_append(near, t) ELSE near END, event_id, len(near) < 2
  FROM (SELECT e.*, list_filter(run.hits, lambda h: e.t - h < 3600000000) AS near FROM run JOIN e ON e.user_id = run.user_id AND e.k = run.k + 1)
) SELECT event_id, accepted FROM run WHERE k > 0""")
def rate_gate(spark, d):
    """At most two accepted events of a user in an hour; rejected ones don't count."""
    rows = B.read(spark, d, "events").select("event_id", "user_id", "ts")
    return C.accept_rate(rows, "user_id", "ts", "event_id", 2, 3600).select("event_id", "accepted")
