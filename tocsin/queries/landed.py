"""Queries of the sources. Payload files of each kind are written from the given tables to the shared folder, then read as landed ones.

Texts are the documents' own, whole, with terms and forms added (see ``texts``); signs
other than letters, digits and plain punctuation are left out, so that they are the
same in every payload format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.functions import text as T
from tocsin.operators.cluster import shared_path
from tocsin.queries.base import LONG_TODAY, query, values
from tocsin.queries.texts import DATED, EXERCISE_WORDS, FORMS, HINTS, PHRASES, ROWS, STEMS, _phrases, counts, first_of, ranked, words_of
from tocsin.sources import bindings as B
from tocsin.sources import feeds as R

TODAY = "2024-03-15"
PLAIN = r"[^\p{L}\p{N} .,:!?-]"
PAY = PHRASES + rf""", pay AS (SELECT id, trim('Report ' || id || ': ' || right(body, 70)) AS t, trim(body) AS body, hint, day, source, pub
  FROM (SELECT id, regexp_replace(title, '{PLAIN}', '', 'g') AS body, hint, DATE '2023-12-01' + CAST(id % 120 AS INTEGER) AS day, source, id % 7 <> 0 AS pub FROM phr JOIN documents ON doc_id = id))"""
SITE = "https://site.example"
PAGE = 50_000


def _payload(spark, d) -> DataFrame:
    """id, t (title), body, hint, day, source and whether the item has a date."""
    rows = _phrases(spark, d).join(B.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    rows = rows.withColumns({"body": F.regexp_replace("title", PLAIN, ""), "day": F.date_add(F.lit("2023-12-01").cast("date"), (F.col("id") % 120).cast("int")), "pub": F.col("id") % 7 != 0})
    return rows.select("id", F.trim(F.concat(F.lit("Report "), F.col("id").cast("string"), F.lit(": "), F.right("body", F.lit(70)))).alias("t"), F.trim("body").alias("body"), "hint", "day", "source", "pub")


def _feeds(spark, rows: DataFrame) -> str:
    """Feeds as XML: one directory a source, items by id, in pages of PAGE ids, so that no task has a whole feed."""
    path = shared_path(spark, "feeds")
    rows = rows.withColumn("page", F.floor(F.col("id") / PAGE))
    date = F.when(F.col("pub"), F.concat(F.date_format("day", "EEE, dd MMM yyyy"), F.lit(" 10:20:30 GMT")))
    items = rows.repartition("source", "page").sortWithinPartitions("source", "page", "id").select("source", "page", F.when(F.col("id") % 11 != 3, F.col("t")).alias("title"), F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string")).alias("link"), F.col("body").alias("description"), date.alias("pubDate"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").partitionBy("source", "page").save(path)
    return path


def _json(spark, rows: DataFrame, payload: Column, by: str | None = None) -> str:
    path = shared_path(spark, "payloads")
    lines = rows.select(F.to_json(payload).alias("value"), *([by] if by else []))
    (lines.write.partitionBy(by) if by else lines.write).text(path)
    return path


def detected(name: str, low: str, table: str = "pay") -> str:
    """SQL: CTE name (id, region) by aliases in order, then two keywords."""
    return f"""l_{name} AS (SELECT id, lower({low}) AS low FROM {table}), s_{name} AS ({counts(words_of(dims.KEYWORDS), "low").replace("FROM l ", f"FROM l_{name} l ")}), b_{name} AS (SELECT id, arg_max(region, n * 100 - rank) AS region FROM s_{name} WHERE n >= 2 GROUP BY id),
{name} AS (SELECT l_{name}.id, coalesce({first_of("low", ranked(dims.ALIASES))}, b_{name}.region) AS region FROM l_{name} LEFT JOIN b_{name} ON b_{name}.id = l_{name}.id)"""


def loosely(name: str, low: str, table: str = "pay") -> str:
    """SQL: CTE name (id, region) by one keyword of the older list."""
    return f"""l_{name} AS (SELECT id, lower({low}) AS low FROM {table}), s_{name} AS ({counts(words_of(dims.LOOSE_KEYWORDS), "low").replace("FROM l ", f"FROM l_{name} l ")}), {name} AS (SELECT id, arg_max(region, n * 100 - rank) AS region FROM s_{name} GROUP BY id)"""


def secure(text: str) -> str:
    return f"(SELECT {STEMS} FROM (SELECT lower({text}) AS low))"


def brief(text: str) -> str:
    """SQL: the first two sentences of over 20 characters, cut to 280."""
    part = lambda mark: f"array_to_string(list_filter(list_transform(string_split(f, '{mark}')[1:2], lambda s: trim(s)), lambda s: length(s) > 20), '{mark}')"
    return f"""(SELECT substring(coalesce(nullif({part(". ")}, ''), nullif({part("! ")}, ''), f), 1, 280) FROM (SELECT trim(regexp_replace({text}, '[\\t-\\r \\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')) AS f))"""


SHOWN = ["title", "description", "date", "source_url", "source_name", "region", "category", "escalation_level", "raw_text"]


def _shown(reports: DataFrame, actors: bool = False) -> DataFrame:
    out = reports.select(*SHOWN, *([F.array_join("actors", "|").alias("actors")] if actors else []))
    return out.withColumns({"description": F.md5("description"), "raw_text": F.md5("raw_text")})


def row(title: str, description: str, date: str, url: str, name: str, region: str, raw: str, category: str = "'unknown'", level: str = "2") -> str:
    return f"SELECT substring({title}, 1, 200) AS title, md5({description}) AS description, CAST({date} AS VARCHAR) AS date, {url} AS source_url, {name} AS source_name, {region} AS region, {category} AS category, CAST({level} AS INTEGER) AS escalation_level, md5({raw}) AS raw_text"


OWN = {"S3": "Baltic", "web": "Arctic", "books": "Haiti"}


def feed_sql(cap: int, region: str, own: dict[str, str] | None = None, gate: str = "", name: str = "source") -> str:
    default = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in own.items()) + " END" if own else "NULL"
    return f"""WITH {PAY}, {region}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM pay),
c AS (SELECT k.*, coalesce(reg.region, {default}) AS region, CASE WHEN pub THEN day ELSE DATE '{TODAY}' END AS date FROM k LEFT JOIN reg ON reg.id = k.id WHERE k <= {cap} AND k.id % 11 <> 3)
{row("t", brief("body"), "date", f"'{SITE}/' || id", name, "region", "substring(t || '. ' || body, 1, 500)")} FROM c WHERE region IS NOT NULL AND date >= DATE '{TODAY}' - 60 {gate}"""


DETECTED, LOOSE = detected("reg", "t || ' ' || body"), loosely("reg", "t || ' ' || body")
GATE = f"AND {secure('''t || ' ' || body''')}"


@query(feed_sql(30, DETECTED, OWN, GATE + " AND id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def rss_items(spark, d):
    """News feeds with regions of their own; the gate lets in what a verdict lets in."""
    verdicts = B.read(spark, d, "labels").select(F.concat(F.lit(f"{SITE}/"), F.col("doc_id").cast("string")).alias("source_url"), F.when(F.col("quality") == 1, "SECURITY_INCIDENT").otherwise("NOT_SECURITY").alias("verdict"))
    return _shown(R.rss_items(spark, _feeds(spark, _payload(spark, d)), TODAY, default_regions=OWN, verdicts=verdicts))


@query(feed_sql(40, DETECTED, None, GATE))
def regional_feeds(spark, d):
    return _shown(R.rss_items(spark, _feeds(spark, _payload(spark, d)), TODAY, cap=40))


@query(feed_sql(25, DETECTED))
def think_tank_feeds(spark, d):
    return _shown(R.rss_items(spark, _feeds(spark, _payload(spark, d)), TODAY, cap=25, gate=False))


@query(feed_sql(50, LOOSE, name="'UN News'"))
def older_feeds(spark, d):
    return _shown(R.rss_items(spark, _feeds(spark, _payload(spark, d)), TODAY, cap=50, gate=False, detect=T.detect_loosely, source_name="UN News"))


ASKED = ["Palestine", "Israel", "Lebanon", "South Sudan", "Mali", "Niger", "Haiti", "Norway"]
ASKED_REGION = {"Palestine": "Gaza & Middle East", "Israel": "Gaza & Middle East", "South Sudan": "Sudan", "Mali": "Sahel", "Haiti": "Haiti"}


@query(f"""WITH {PAY}, c AS (SELECT pay.*, a.country, r.region FROM pay JOIN {values(list(enumerate(ASKED)))} a(k, country) ON a.k = id % {len(ASKED)} JOIN {values(list(ASKED_REGION.items()))} r(country, region) ON r.country = a.country)
{row("t", brief("body"), "day", f"'{SITE}/' || id", "CASE WHEN id % 5 = 0 THEN 'ReliefWeb' ELSE source END || ' (OCHA)'", "region", "t || '. ' || substring(' ' || body || ' ', 1, 300)")} FROM c WHERE {secure("t || ' ' || body")}""")
def humanitarian_reports(spark, d):
    """The third country of a region and the countries of none aren't asked for."""
    rows = _payload(spark, d).withColumn("country", F.get(F.array(*[F.lit(c) for c in ASKED]), (F.col("id") % len(ASKED)).cast("int")))
    url, created = F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string")), F.concat(F.col("day").cast("string"), F.lit("T08:00:00+00:00"))
    field = F.struct(F.col("t").alias("title"), F.concat(F.lit("<p>"), "body", F.lit("</p>")).alias("body"), F.struct(url.alias("canonical")).alias("url"), F.struct(created.alias("created")).alias("date"), F.when(F.col("id") % 5 != 0, F.array(F.struct(F.col("source").alias("name")))).alias("source"))
    return _shown(R.humanitarian_reports(spark, _json(spark, rows, F.struct(F.array(F.struct(field.alias("fields"))).alias("data")), "country"), TODAY))


@query(f"""WITH {PAY}, {loosely("reg", "t || ' ' || hint")}
{row("t", "'OCHA Situation Report — ' || hint", f"CASE WHEN pub THEN day ELSE DATE '{TODAY}' END", f"'{SITE}/' || pay.id", "'UNOCHA Situation Report'", "region", "substring(t, 1, 400)")} FROM pay JOIN reg ON reg.id = pay.id""")
def situation_reports(spark, d):
    rows = _payload(spark, d)
    url = F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string"))
    field = F.struct(F.col("t").alias("title"), F.struct(url.alias("canonical")).alias("url"), F.when(F.col("pub"), F.struct(F.concat(F.col("day").cast("string"), F.lit("T08")).alias("created"))).alias("date"), F.struct(F.col("hint").alias("name")).alias("primary_country"))
    return _shown(R.situation_reports(spark, _json(spark, rows, F.struct(F.array(F.struct(field.alias("fields"))).alias("data"))), TODAY))


@query(f"""WITH {PAY}, c AS (SELECT pay.*, r.region FROM pay JOIN {values(list(enumerate(dims.REGIONS)))} r(k, region) ON r.k = id % 20)
{row("t", brief("body"), f"CASE WHEN pub THEN day ELSE DATE '{TODAY}' END", f"'{SITE}/' || id", "'The Guardian'", "region", "substring(t || '. ' || body, 1, 400)")} FROM c WHERE {secure("t || ' ' || body")}""")
def newspaper_reports(spark, d):
    rows = _payload(spark, d).withColumn("region", F.get(F.array(*[F.lit(r) for r in dims.REGIONS]), (F.col("id") % 20).cast("int")))
    result = F.struct(F.col("t").alias("webTitle"), F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string")).alias("webUrl"), F.when(F.col("pub"), F.concat(F.col("day").cast("string"), F.lit("T01:02:03Z"))).alias("webPublicationDate"), F.struct(F.col("body").alias("trailText")).alias("fields"))
    return _shown(R.newspaper_reports(spark, _json(spark, rows, F.struct(F.struct(F.array(result).alias("results")).alias("response")), "region"), TODAY))


@query(f"""WITH {PAY}, {detected("reg", "t")}, c AS (SELECT pay.*, region, CASE WHEN pub THEN day ELSE DATE '{TODAY}' END AS date, CASE WHEN pub THEN strftime(day, '%Y%m%d') || 'T101500Z' ELSE 'soon' END AS seen FROM pay JOIN reg ON reg.id = pay.id)
{row("t", "seen", "date", f"'{SITE}/' || id", "'GDELT (' || source || ')'", "region", "substring(t, 1, 400)")} FROM c WHERE region IS NOT NULL AND date >= DATE '{TODAY}' - 7""")
def news_reports(spark, d):
    """Region from the title alone; an unreadable date is the day of the run."""
    rows = _payload(spark, d)
    seen = F.when(F.col("pub"), F.concat(F.date_format("day", "yyyyMMdd"), F.lit("T101500Z"))).otherwise("soon")
    article = F.struct(F.col("t").alias("title"), F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string")).alias("url"), seen.alias("seendate"), F.col("source").alias("domain"))
    return _shown(R.news_reports(spark, _json(spark, rows, F.struct(F.array(article).alias("articles"))), TODAY))


CLASHES = f"""o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, h.term AS country, CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS INTEGER) AS deaths, o_orderpriority AS side, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'the river' ELSE 'hill 5' END AS place, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Clash ' || o_orderkey % 9 END AS conflict
  FROM orders JOIN {values(ROWS)} h(k, term) ON k = o_orderkey % {len(ROWS)})"""


def _clashes(spark, d) -> DataFrame:
    country = F.get(F.array(*[F.lit(h) for h in HINTS]), (F.col("o_orderkey") % len(HINTS)).cast("int"))
    o = B.read(spark, d, "orders")
    place = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "the river").otherwise("hill 5")
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), country.alias("country"), (F.floor("o_totalprice") % 40).cast("int").alias("deaths"), F.col("o_orderpriority").alias("side"), place.alias("place"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("Clash "), (F.col("o_orderkey") % 9).cast("string"))).alias("conflict"))


@query(f"""WITH {CLASHES}, {detected("reg", "country || ' ' || place || ' ' || conflict || ' ' || side || ' '", "o")}, c AS (SELECT o.*, region, coalesce(nullif(conflict, ''), 'Armed clash') || ': ' || side || ' vs  in ' || place || ', ' || country AS t FROM o JOIN reg ON reg.id = o.id)
{row("t", "deaths || ' deaths. UCDP verified.'", "day", "'https://ucdp.uu.se/event/' || id", "'UCDP (Uppsala University)'", "region", "substring(t, 1, 400)", "'proxy'", "CASE WHEN deaths >= 25 THEN 3 WHEN deaths >= 5 THEN 2 ELSE 1 END")}, side AS actors
FROM c WHERE region IS NOT NULL AND day >= DATE '{LONG_TODAY}' - 180""")
def conflict_events(spark, d):
    """Paged events; one side is named, the other empty."""
    rows = _clashes(spark, d)
    event = F.struct("id", F.col("conflict").alias("conflict_name"), F.col("side").alias("side_a"), F.lit("").alias("side_b"), F.lit("").alias("where_description"), F.col("place").alias("adm_1"), "country", F.concat(F.col("day").cast("string"), F.lit(" 00:00:00")).alias("date_start"), F.col("deaths").alias("best"))
    return _shown(R.conflict_events(spark, _json(spark, rows, F.struct(F.array(event).alias("Result"))), LONG_TODAY), actors=True)


KINDS = [*dims.EVENT_CATEGORIES, "Other"]


@query(f"""WITH {CLASHES}, c AS (SELECT o.*, k.kind, r.region, coalesce(nullif(CASE WHEN id % 2 = 0 THEN '' ELSE 'Shelling' END, ''), kind) || ' in ' || place || ', ' || country AS t FROM o JOIN {values(list(enumerate(KINDS)))} k(k, kind) ON k.k = id % 7 JOIN {values(list(enumerate(dims.REGIONS)))} r(k, region) ON r.k = id % 20)
{row("t", "side || ' fought.'", "day", "'https://acleddata.com/data/?country=' || replace(country, ' ', '+') || '#' || day || '-' || replace(place, ' ', '')", "'ACLED (' || coalesce(CASE WHEN id % 3 = 0 THEN 'Local' END, 'ACLED') || ')'", "region", "substring(t || '. ' || side || ' fought.', 1, 600)",
"CASE WHEN kind IN ('Battles', 'Explosions/Remote violence', 'Violence against civilians', 'Riots', 'Strategic developments') THEN 'proxy' WHEN kind = 'Protests' THEN 'disinfo' ELSE 'unknown' END",
"least(1 + CASE WHEN id % 5 = 0 THEN 0 WHEN deaths >= 10 THEN 2 WHEN deaths >= 1 THEN 1 ELSE 0 END + CASE WHEN kind IN ('Battles', 'Explosions/Remote violence') THEN 2 ELSE 0 END, 5)")}, side || '|' || 'B' AS actors FROM c WHERE day BETWEEN DATE '{LONG_TODAY}' - 35 AND DATE '{LONG_TODAY}'""")
def fatality_events(spark, d):
    """Deaths come as text, or not at all."""
    rows = _clashes(spark, d).withColumns({"region": F.get(F.array(*[F.lit(r) for r in dims.REGIONS]), (F.col("id") % 20).cast("int")), "kind": F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("id") % 7).cast("int"))})
    event = F.struct(F.col("day").cast("string").alias("event_date"), F.col("kind").alias("event_type"), F.when(F.col("id") % 2 == 0, "").otherwise("Shelling").alias("sub_event_type"), F.col("side").alias("actor1"), F.lit("B").alias("actor2"), "country", F.col("place").alias("location"), F.concat("side", F.lit(" fought.")).alias("notes"), F.when(F.col("id") % 3 == 0, "Local").alias("source"), F.when(F.col("id") % 5 != 0, F.col("deaths").cast("string")).alias("fatalities"))
    return _shown(R.fatality_events(spark, _json(spark, rows, F.struct(F.array(event).alias("data")), "region"), LONG_TODAY), actors=True)


TRUSTED = [s for s, _, _ in dims.TRUSTED_SOURCES]
TRUST = f"{PAY}, named AS (SELECT pay.* EXCLUDE (source), s.source, row_number() OVER (PARTITION BY s.source ORDER BY id) AS k FROM pay JOIN {values(list(enumerate(TRUSTED)))} s(n, source) ON n = id % 4), c AS (SELECT *, CASE WHEN pub THEN day ELSE DATE '{TODAY}' END AS date FROM named WHERE k <= 30 AND id % 11 <> 3)"


def _trusted(spark, d):
    rows = _payload(spark, d).withColumn("source", F.get(F.array(*[F.lit(s) for s in TRUSTED]), (F.col("id") % 4).cast("int")))
    return R.trusted_items(spark, _feeds(spark, rows.withColumn("source", F.replace("source", F.lit("/"), F.lit("/")))), TODAY)


@query(f"""WITH {TRUST} {row("t", brief("body"), "date", f"'{SITE}/' || id", "source", "'Ukraine'", "substring(t || '. ' || body, 1, 800)", level="CASE WHEN source = 'Mash/OperMap' THEN 1 ELSE 2 END")}, 'Russia|Ukraine' AS actors FROM c""")
def trusted_items(spark, d):
    return _shown(_trusted(spark, d)[0], actors=True)


@query(f"WITH {TRUST} SELECT source AS source_name, count(*) AS items, count(*) FILTER (source = 'Mash/OperMap') AS flagged FROM c GROUP BY source")
def trusted_counts(spark, d):
    return _trusted(spark, d)[1]


def _page(inner: Column) -> Column:
    return F.concat(F.lit("<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav>"), inner, F.lit("</body></html>"))


@query(f"""WITH {PAY}, i AS (SELECT id, day, hint, unnest([t, 'short item', substring('&' || body, 1, 700)]) AS item FROM pay), n AS (SELECT *, row_number() OVER () AS row FROM i), {detected("reg", "item", "(SELECT row AS id, item FROM n)")}
{row("item", "substring(item, 1, 280)", "day", f"'{SITE}/' || n.id || '#' || substring(md5(substring(item, 1, 50)), 1, 8)", "'Wikipedia Current Events'", "region", "substring(item, 1, 500)")} FROM (SELECT n.id, n.day, trim(regexp_replace(n.item, ' +', ' ', 'g')) AS item, n.row FROM n) n JOIN reg ON reg.id = n.row
WHERE region IS NOT NULL AND length(item) BETWEEN 40 AND 600 AND {secure("substring(item, 1, 200) || ' ' || substring(item, 201, 200)")}""")
def current_events(spark, d):
    """List items of a day's page: the navigation and short or very long ones aren't reports."""
    third = F.replace(F.substring(F.concat(F.lit("&"), "body"), 1, 700), F.lit("&"), F.lit("&amp;"))
    rows = _payload(spark, d)
    inner = F.concat(F.lit("<ul><li class=x>"), "t", F.lit("</li><li>short <b>item</b><li>"), third, F.lit("</li></ul>"))
    pages = rows.select(F.col("id").alias("page_id"), F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string")).alias("url"), F.col("day").alias("date"), _page(inner).alias("html"))
    return _shown(R.current_events(pages))


@query(r"""WITH i AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), 1) - 1 AS n FROM pages), t AS (SELECT *, trim(regexp_replace(replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS item FROM i)
SELECT page_id, n, item, url || '#' || substring(md5(substring(item, 1, 50)), 1, 8) AS item_url FROM t WHERE length(item) BETWEEN 8 AND 40""")
def html_list_items(spark, d):
    """List items of the given pages, which are short."""
    return R.list_items(B.read(spark, d, "pages"), 8, 40)


@query(r"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\s[^>]*>.*?</a>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<a\s[^>]*>.*?</a>'), 1) - 1 AS n FROM pages) SELECT page_id, n, regexp_extract(raw, 'href=["'']?([^"'' >]*)', 1) AS href, trim(regexp_replace(raw, '<[^>]+>', ' ', 'g')) AS label FROM i""")
def html_links(spark, d):
    return R.links(B.read(spark, d, "pages"))


@query(f"""WITH {PAY} SELECT 'S' || id % 3 AS source, id % 2 AS n, substring(regexp_replace(t, ' +', ' ', 'g'), 1, 200) AS title, CASE WHEN id % 2 = 0 THEN '{SITE}/x' || id ELSE '{SITE}/list' || id // 2 * 2 END AS link FROM pay WHERE length(t) > 30 AND id // 2 = (SELECT min(id // 2) FROM pay p WHERE length(p.t) > 30 AND p.id // 2 % 3 = pay.id // 2 % 3 AND p.id // 2 >= 3) AND 'S' || id % 3 IS NOT NULL""".replace("'S' || id % 3", "'S' || id // 2 % 3"))
def fallback_pages(spark, d):
    """Each source's pages are tried in order; the first with long enough elements counts. Pages 0 to 2 have short ones only."""
    rows = _payload(spark, d).withColumn("pair", F.floor(F.col("id") / 2)).withColumn("even", F.col("id") % 2 == 0)
    text = F.when(F.col("pair") < 3, "too short").otherwise(F.col("t"))
    piece = F.when(F.col("even"), F.concat(F.lit("<article><a href='"), F.lit(f"{SITE}/x"), F.col("id").cast("string"), F.lit("'>"), text, F.lit("</a></article>"))).otherwise(F.concat(F.lit("<article>"), text, F.lit("</article>")))
    pages = rows.groupBy("pair").agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", piece.alias("p"))))["p"], "").alias("html"))  # two documents a page
    pages = pages.select(F.concat(F.lit("S"), (F.col("pair") % 3).cast("string")).alias("source"), F.col("pair").alias("rank"), F.concat(F.lit(f"{SITE}/list"), (F.col("pair") * 2).cast("string")).alias("url"), "html")
    return R.fallback_items(pages, "article").select("source", F.col("n").cast("long").alias("n"), "title", "link")


EXERCISE_COLUMNS = ["name", "region", "start_date", "end_date", "scale", "lead_nation", "source_url", "raw_summary"]
DRILL = f"""{PAY}, drill AS (SELECT pay.id, pay.hint, f.form, f.first, f.last, f.n, trim(regexp_replace(regexp_replace(body, '[0-9]', '', 'g'), ' +', ' ', 'g')) AS bare, CASE pay.id % 4 WHEN 0 THEN 'Exercise' WHEN 1 THEN 'STEADFAST' WHEN 2 THEN 'Parade' ELSE 'Iron drill' END AS word FROM pay JOIN {FORMS} f(k, form, first, last, n) ON k = pay.id % {len(DATED)})"""


def _drills(spark, d) -> DataFrame:
    word = F.when(F.col("id") % 4 == 0, "Exercise").when(F.col("id") % 4 == 1, "STEADFAST").when(F.col("id") % 4 == 2, "Parade").otherwise("Iron drill")
    form = F.get(F.array(*[F.lit(f) for f, *_ in DATED]), (F.col("id") % len(DATED)).cast("int"))
    return _payload(spark, d).select("id", "hint", form.alias("form"), F.trim(F.regexp_replace(F.regexp_replace("body", "[0-9]", ""), " +", " ")).alias("bare"), word.alias("word"))


def drilled(name: str, region_of: str, nation: str, url: str, summary: str, where: str, scale: str = "nullif(n, -1)") -> str:
    return f"""WITH {DRILL}, c AS (SELECT *, {name} AS name, {region_of} AS context FROM drill), r AS (SELECT *, {first_of("lower(context)", EXERCISE_WORDS)} AS region FROM c)
SELECT substring(name, 1, 200) AS name, region, first AS start_date, last AS end_date, CAST({scale} AS BIGINT) AS scale, '{nation}' AS lead_nation, {url} AS source_url, {summary} AS raw_summary FROM r WHERE region IS NOT NULL AND {where}"""


@query(drilled("word || ' in ' || hint", "word || ' in ' || hint || ' ' || substring(form || ' ' || bare, 1, 500)", "NATO/SHAPE", f"'{SITE}/n/' || id", "substring(form || ' ' || bare, 1, 500)", "word <> 'Parade'"))
def announced_exercises(spark, d):
    """News pages whose links name an exercise, and the pages behind them."""
    rows = _drills(spark, d)
    link = F.concat(F.lit("<p><a href='/about'>About us</a> <a class=n href='/n/"), F.col("id").cast("string"), F.lit("'>"), "word", F.lit(" in "), "hint", F.lit("</a>"))
    news = rows.select(F.col("id").alias("page_id"), F.lit(f"{SITE}/news").alias("url"), _page(link).alias("html"))
    details = rows.select(F.concat(F.lit(f"{SITE}/n/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("<h1>"), "form", F.lit("</h1><p>"), "bare", F.lit("</p>")).alias("html"))
    return R.announced_exercises(news, details, SITE, "2024-06-01").select(*EXERCISE_COLUMNS)


@query(drilled("word || ' ' || hint", "word || ' ' || hint || ' ' || form", "NATO/US", f"'{SITE}/' || id", "substring(word || ' ' || hint || ' ' || form, 1, 400)", "length(name) BETWEEN 3 AND 100"))
def html_table_rows(spark, d):
    """Rows of the first three tables of a kind: a fourth table, a header, a row of one cell and other tables don't count."""
    row = F.concat(F.lit("<tr><td>"), "word", F.lit(" "), "hint", F.lit("</td><td>"), "form", F.lit("</td></tr>"))
    head, end = F.lit("<table class='wikitable sortable'><tr><th>Name<th>When</tr>"), F.lit("</table>")
    other = F.lit("<table class=nav><tr><td>a<td>b</tr><tr><td>Korea<td>2024</tr></table>")
    html = F.concat(other, head, end, head, F.lit("<tr><td>Korea only</td></tr>"), row, end, head, F.lit("<tr><td>ab</td><td>Korea 2024</td></tr>"), end, head, F.lit("<tr><td>Korean drill</td><td>2024</td></tr>"), end)
    pages = _drills(spark, d).select(F.col("id").alias("page_id"), F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string")).alias("url"), html.alias("html"))
    return R.tabled_exercises(pages, "2024-06-01").select(*EXERCISE_COLUMNS)


@query(drilled("word || ' near ' || hint || ', ' || form", "word || ' near ' || hint || ', ' || form", "US DoD", f"CASE WHEN id % 3 = 0 THEN '{SITE}' ELSE '{SITE}/a/' || id END", "name", "(contains(lower(name), 'exercise') OR contains(lower(name), 'drill'))", "NULL"))
def headed_exercises(spark, d):
    """Articles' headings that name an exercise; some articles have no link."""
    name = F.concat("word", F.lit(" near "), "hint", F.lit(", "), "form")
    link = F.when(F.col("id") % 3 == 0, "<p>no link</p>").otherwise(F.concat(F.lit("<a class=x href='/a/"), F.col("id").cast("string"), F.lit("'>more</a>")))
    html = F.concat(F.lit("<article><h2>no heading</h2></article><article><h3>"), name, F.lit("</h3>"), link, F.lit("</article>"))
    pages = _drills(spark, d).select(F.col("id").alias("page_id"), F.lit(SITE).alias("url"), html.alias("html"))
    return R.headed_exercises(pages, "2024-06-01", SITE).select(*EXERCISE_COLUMNS)


@query(f"""WITH {PAY}, c AS (SELECT id, CASE WHEN id % 11 <> 3 THEN t END AS t, CASE WHEN id % 5 = 0 THEN body || ' DRILLS.' ELSE body END AS body FROM pay) SELECT coalesce(t, 'Unknown') AS name, '{SITE}/' || id AS source_url, 'NATO' AS lead_nation, 'Europe' AS region, coalesce(t, '') AS raw_title, md5(body) AS raw_summary FROM c
WHERE regexp_matches(lower(coalesce(t, '') || ' ' || body), 'exercise|drill|maneuver|training|operation')""")
def feed_exercises(spark, d):
    items = _payload(spark, d).withColumn("body", F.when(F.col("id") % 5 == 0, F.concat("body", F.lit(" DRILLS."))).otherwise(F.col("body")))
    rows = R.feed_exercises(spark, _feeds(spark, items))
    return rows.select("name", "source_url", "lead_nation", "region", F.col("statements.raw_title").alias("raw_title"), F.md5("statements.raw_summary").alias("raw_summary"))


@query(f"""SELECT 'reg-' || p_partkey AS registry_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'projected' ELSE 'confirmed' END AS announcement_status, p_brand || '|' || p_type AS participants, '2024-01-0' || (1 + p_partkey % 9) AS start_date, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS scale FROM part""")
def exercise_registry(spark, d):
    """The registry's file, made of parts; a missing status is 'projected'."""
    p = B.read(spark, d, "part")
    entry = F.struct(F.concat(F.lit("reg-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, "confirmed").alias("status"), F.concat("p_brand", F.lit(" ,  "), "p_type").alias("participants"), F.concat(F.lit("2024-01-0"), (1 + F.col("p_partkey") % 9).cast("string")).alias("start_date"), F.lit("2024-02-01").alias("end_date"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("scale"))
    out = R.registry(spark, _json(spark, p, entry))
    return out.select("registry_id", "name", "announcement_status", F.array_join("participants", "|").alias("participants"), "start_date", "scale")


@query("WITH p AS (SELECT p_partkey, p_name || '-' || p_partkey % 7 AS name FROM part) SELECT 'table' AS origin, count(*) AS n FROM p WHERE p_partkey % 2 = 0 UNION ALL SELECT 'seed', count(DISTINCT name) FROM p WHERE name NOT IN (SELECT name FROM p WHERE p_partkey % 2 = 0)")
def seeded_exercises(spark, d):
    """Seeds are inserted where their name isn't there yet, each name once."""
    p = B.read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 7).cast("string")).alias("name"))
    both = R.seeded(p.where("p_partkey % 2 = 0").select("name", F.lit("table").alias("origin")), p.select("name", F.lit("seed").alias("origin")))
    counts = both.agg(F.count_if(F.col("origin") == "table").alias("t"), F.count_if(F.col("origin") == "seed").alias("s"))  # one row, none of either included
    return counts.selectExpr("stack(2, 'table', t, 'seed', s) as (origin, n)")


@query(f"""WITH {PAY}, {detected("reg", "t")}, a AS (SELECT id % 400 AS key FROM pay WHERE id % 3 = 0), b AS (SELECT id % 400 AS key FROM pay), old AS (SELECT id % 400 AS key FROM pay WHERE id % 400 < 50),
n AS (SELECT (SELECT count(DISTINCT key) FROM a WHERE key NOT IN (SELECT key FROM old)) AS x, (SELECT count(DISTINCT key) FROM b WHERE key NOT IN (SELECT key FROM old) AND key NOT IN (SELECT key FROM a)) AS y)
SELECT 'first' AS source_group, x AS inserted FROM n UNION ALL SELECT 'second', y FROM n UNION ALL SELECT 'none', 0 UNION ALL SELECT 'total', x + y FROM n""")
def inserted_by_source(spark, d):
    """What each source of a run adds, the first to bring an address having it, and the total."""
    rows = _payload(spark, d).select("id", (F.col("id") % 400).alias("key"))
    return R.counted_fan_in({"first": rows.where("id % 3 = 0"), "second": rows, "none": rows.limit(0)}, ["key"], rows.where("key < 50"))


def _broken(spark, d) -> str:
    """Payloads of one event each, by source; every thirteenth is cut off in the middle."""
    rows = _payload(spark, d)
    line = F.to_json(F.struct(F.array(F.struct(F.col("id").cast("int").alias("id"), F.col("t").alias("conflict_name"), F.col("day").cast("string").alias("date_start"))).alias("Result")))
    path = shared_path(spark, "broken")
    rows.select("source", F.when(F.col("id") % 13 == 0, F.concat(F.substring(line, 1, 30), F.lit("#"), F.col("id"))).otherwise(line).alias("value")).write.partitionBy("source").text(path)
    return path


@query(f"WITH {PAY} SELECT source, count(*) AS payloads, count(*) FILTER (id % 13 = 0) AS errors FROM pay GROUP BY source")
def payload_errors(spark, d):
    """Payloads of each source and how many of them can't be read."""
    return R.payload_counts(spark, R.DEATHS, _broken(spark, d), "source")


@query(f"WITH {PAY} SELECT CAST(id AS VARCHAR) AS id FROM pay WHERE id % 13 = 0")
def quarantined_payloads(spark, d):
    """The payloads that can't be read, by the number at their end."""
    return R.quarantine(spark, R.DEATHS, _broken(spark, d)).select(F.substring_index("record", "#", -1).alias("id"))
