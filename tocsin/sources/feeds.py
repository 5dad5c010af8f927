"""Landed payload files as reports and exercises: RSS, JSON and HTML; fetching them is out of scope.

Files lie in one directory for each source, country, region or page set that was
asked for (``source=...``, ``country=...``, ``region=...``), which becomes a column;
a feed may be dealt to numbered pages below it (``page=...``).
Every reader gives reports with the columns of ``REPORT``, or exercises with those of
``EXERCISE``. Payloads that lack a title or an address give no row; a missing date is
the day of the run, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.functions import dims
from tocsin.functions import text as T

REPORT = ("title", "description", "date", "source_url", "source_name", "region", "category", "escalation_level", "raw_text", "actors")
EXERCISE = ("name", "region", "start_date", "end_date", "scale", "lead_nation", "source_url", "raw_summary")
RSS = "title string, link string, description string, pubDate string"
HUMANITARIAN = "data array<struct<fields: struct<title: string, body: string, url: struct<canonical: string>, date: struct<created: string>, source: array<struct<name: string>>, primary_country: struct<name: string>>>>"
NEWSPAPER = "response struct<results: array<struct<webTitle: string, webUrl: string, webPublicationDate: string, fields: struct<trailText: string>>>>"
NEWS = "articles array<struct<title: string, url: string, seendate: string, domain: string>>"
DEATHS = "Result array<struct<id: long, conflict_name: string, side_a: string, side_b: string, where_description: string, adm_1: string, country: string, date_start: string, best: int>>"
FATALITIES = "data array<struct<event_date: string, event_type: string, sub_event_type: string, actor1: string, actor2: string, country: string, location: string, notes: string, source: string, fatalities: string>>"
REGISTRY = "id string, name string, status string, exercise_type string, lead_nation string, participants string, domain string, region string, start_date string, end_date string, scale int, lat double, lng double, signal_target string, source string, notes string"


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _day(today: str) -> Column:
    return F.lit(today).cast("date")


def _has(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in columns])


def _report(rows: DataFrame, raw: Column, category: Column | None = None, level: Column | None = None, actors: Column | None = None) -> DataFrame:
    """rows (title, description, date, source_url, source_name, region) as reports; those without a region go."""
    full = rows.withColumns({"raw_text": raw, "category": F.lit("unknown") if category is None else category, "escalation_level": F.lit(2) if level is None else level, "actors": F.lit(None).cast("array<string>") if actors is None else actors})
    return full.where("region is not null").withColumn("title", F.substring("title", 1, 200)).select(*REPORT)


def gated(reports: DataFrame, title: Column, description: Column, verdicts: DataFrame | None = None) -> DataFrame:
    """Reports that name something of security and, where verdicts (source_url, verdict) are given, whose verdict says so; none is a no."""
    named = reports.where(T.is_security(title, description))
    if verdicts is None:
        return named
    return named.join(verdicts.select("source_url", "verdict"), "source_url", "left").where(T.gate_verdict(F.col("verdict"))).drop("verdict")


def published(text: Column, today: Column) -> Column:
    """RFC 822 date without its weekday, else today."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    return F.coalesce(F.to_date(F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")))), today)


def capped(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """The first cap rows of each group."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(f"k <= {cap}").drop("k")


def feed_items(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """source, title, link, description and pubDate of the first cap items of each landed feed, in its order.

    A feed is a file, or, where it has landed in pages (page=...), the files of all its pages.
    """
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    paged = "page" in rows.columns
    place = F.struct(F.col("page") if paged else F.lit(0).alias("page"), *([file.alias("file")] if paged else []), start.alias("start"), F.monotonically_increasing_id().alias("n"))  # rises with the place in a file, whichever task reads which part
    feed = F.regexp_replace(file, "/page=.*", "") if paged else file
    return capped(rows.withColumns({"feed": feed, "place": place}), "feed", "place", cap).drop("feed", "place", "page")


BROKEN = "_corrupt_record"


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Each line of the files as a payload: its fields, the columns that the path tells, the file, and the line itself where it can't be read."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    told = [c for c in lines.columns if c != "value"]
    parsed = F.from_json("value", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return lines.select(parsed.alias("p"), *told, F.col("_metadata.file_path").alias("file")).select("p.*", *told, "file")


def payloads(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """JSON payloads that can be read; the others are in quarantine."""
    return _read(spark, schema, path).where(F.col(BROKEN).isNull()).drop(BROKEN, "file")


def quarantine(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """file and record of the payloads that can't be read."""
    return _read(spark, schema, path).where(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("record"))


def payload_counts(spark: SparkSession, schema: str, path: str, by: str) -> DataFrame:
    """by, payloads, errors: how many payloads of each value of a column (or partition) there are, and how many can't be read, in one pass."""
    return _read(spark, schema, path).groupBy(by).agg(F.count("*").alias("payloads"), F.count(BROKEN).alias("errors"))


def observed(reports: DataFrame, name: str, known: DataFrame | None = None, keys: tuple[str, ...] = ("source_url",)) -> tuple[DataFrame, Observation]:
    """(reports to insert, metrics of them): seen, skipped (known already) and flagged (level 4 and over), counted while the rows go by.

    The metrics are there when the reports have been written, at no pass of their own.
    """
    metrics = Observation(name)
    if known is not None:
        marked = reports.join(known.select(*keys).distinct().withColumn("known", F.lit(True)), list(keys), "left")
    else:
        marked = reports.withColumn("known", F.lit(None).cast("boolean"))
    counted = marked.observe(metrics, F.count("*").alias("seen"), F.count("known").alias("skipped"), F.count_if((F.col("escalation_level") >= 4) & F.col("known").isNull()).alias("flagged"))
    return counted.where("known is null").drop("known"), metrics


def rss_items(
    spark: SparkSession, path: str, today: str, cap: int = 30, days: int = 60, default_regions: dict[str, str] | None = None, gate: bool = True,
    verdicts: DataFrame | None = None, detect: Callable[[Column], Column] = T.detect_region, source_name: str | None = None,
) -> DataFrame:
    """Reports of feeds: titled and linked items no older than days; region by the detector, else the feed's own.

    The feeds of news outlets have cap 30 and regions of their own, regional ones cap 40
    and none, think tanks cap 25 and no gate; the older reader has cap 50, the loose
    detector, no gate and one name for all.
    """
    day = _day(today)
    rows = feed_items(spark, path, cap).where(_has("title", "link")).withColumn("summary", _or_empty("description")).withColumn("date", published(F.col("pubDate"), day))
    rows = rows.where(F.col("date") >= F.date_sub(day, days))
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in default_regions.items() for x in kv]), F.col("source")) if default_regions else F.lit(None).cast("string")
    rows = rows.withColumn("region", F.coalesce(detect(F.concat_ws(" ", "title", "summary")), own))
    if gate:
        rows = gated(rows.withColumnRenamed("link", "source_url"), F.col("title"), F.col("summary"), verdicts).withColumnRenamed("source_url", "link")
    raw = F.substring(F.concat("title", F.lit(". "), "summary"), 1, 500)
    return _report(rows.select("title", T.extract_brief(F.col("summary")).alias("description"), "date", F.col("link").alias("source_url"), (F.lit(source_name) if source_name else F.col("source")).alias("source_name"), "region", "summary"), raw)


def trusted_items(spark: SparkSession, path: str, today: str, cap: int = 30) -> tuple[DataFrame, DataFrame]:
    """(reports, counts): items of the sources about one region; level 1 and flagged where the source isn't to be trusted alone.

    An item without a link gets an address of its source and day. counts: source_name, items, flagged.
    """
    trust = spark.createDataFrame(dims.TRUSTED_SOURCES, "source string, bias string, trust_level string")
    rows = feed_items(spark, path, cap).where(_has("title")).join(F.broadcast(trust), "source")  # four rows
    rows = rows.withColumn("date", published(F.col("pubDate"), _day(today))).withColumn("summary", _or_empty("description")).withColumn("low", F.col("trust_level") == "low")
    made = F.concat(F.lit("https://"), F.replace(F.lower("source"), F.lit(" "), F.lit("")), F.lit(".com/"), F.col("date").cast("string"))
    named = rows.withColumns({"source_url": F.coalesce(F.nullif("link", F.lit("")), made), "source_name": F.col("source"), "region": F.lit("Ukraine"), "description": T.extract_brief(F.col("summary"))})
    reports = _report(named, F.substring(F.concat("title", F.lit(". "), "summary"), 1, 800), level=F.when(F.col("low"), 1).otherwise(2), actors=F.array(F.lit("Russia"), F.lit("Ukraine")))
    return reports, rows.groupBy(F.col("source").alias("source_name")).agg(F.count("*").alias("items"), F.count_if("low").alias("flagged"))


def _regions_of(spark: SparkSession, countries: dict[str, list[str]], most: int | None = None) -> DataFrame:
    return spark.createDataFrame([(c, r) for r, cs in countries.items() for c in cs[:most]], "country string, region string")


def humanitarian_reports(spark: SparkSession, path: str, today: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Reports asked for by country (country=...): the region is that of the country, of which each region asks for two."""
    f = payloads(spark, HUMANITARIAN, path).select("country", F.explode("data.fields").alias("f")).join(F.broadcast(_regions_of(spark, dims.REPORT_COUNTRIES, 2)), "country")
    rows = f.select(F.col("f.title").alias("title"), T.clean_html(F.col("f.body")).alias("body"), F.col("f.url.canonical").alias("source_url"), T.lenient_date(F.col("f.date.created")).alias("date"), F.concat(F.coalesce(F.get("f.source", 0)["name"], F.lit("ReliefWeb")), F.lit(" (OCHA)")).alias("source_name"), "region")
    rows = gated(rows.where(_has("title", "source_url")), F.col("title"), F.col("body"), verdicts)
    return _report(rows.withColumn("description", T.extract_brief(F.col("body"))), F.concat("title", F.lit(". "), F.substring("body", 1, 300)))


def situation_reports(spark: SparkSession, path: str, today: str) -> DataFrame:
    """Situation reports: region by the loose detector from title and country; no gate."""
    f = payloads(spark, HUMANITARIAN, path).select(F.explode("data.fields").alias("f"))
    rows = f.select(F.col("f.title").alias("title"), F.col("f.url.canonical").alias("source_url"), F.coalesce(T.lenient_date(F.col("f.date.created")), _day(today)).alias("date"), F.coalesce("f.primary_country.name", F.lit("")).alias("country"))
    rows = rows.where(_has("title", "source_url")).withColumns({"region": T.detect_loosely(F.concat_ws(" ", "title", "country")), "description": F.concat(F.lit("OCHA Situation Report — "), "country"), "source_name": F.lit("UNOCHA Situation Report")})
    return _report(rows, F.substring("title", 1, 400))


def newspaper_reports(spark: SparkSession, path: str, today: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Search results of a newspaper (region=...): the region is the one asked for."""
    f = payloads(spark, NEWSPAPER, path).select("region", F.explode("response.results").alias("f"))
    rows = f.select(F.col("f.webTitle").alias("title"), F.coalesce("f.fields.trailText", F.lit("")).alias("body"), F.col("f.webUrl").alias("source_url"), F.coalesce(T.lenient_date(F.col("f.webPublicationDate")), _day(today)).alias("date"), F.lit("The Guardian").alias("source_name"), "region")
    rows = gated(rows.where(_has("title", "source_url")), F.col("title"), F.col("body"), verdicts)
    return _report(rows.withColumn("description", T.extract_brief(F.col("body"))), F.substring(F.concat("title", F.lit(". "), "body"), 1, 400))


def news_reports(spark: SparkSession, path: str, today: str, days: int = 7) -> DataFrame:
    """World news: the first eight digits as the date, else today; region from the title alone; no gate."""
    day = _day(today)
    f = payloads(spark, NEWS, path).select(F.explode("articles").alias("f")).select("f.*").where(_has("title", "url"))
    rows = f.select("title", F.substring(_or_empty("seendate"), 1, 280).alias("description"), F.coalesce(F.try_to_date(F.substring("seendate", 1, 8), "yyyyMMdd"), day).alias("date"), F.col("url").alias("source_url"), F.concat(F.lit("GDELT ("), _or_empty("domain"), F.lit(")")).alias("source_name"), T.detect_region(F.col("title")).alias("region"))
    return _report(rows.where(F.col("date") >= F.date_sub(day, days)), F.substring("title", 1, 400))


def conflict_events(spark: SparkSession, path: str, today: str, days: int = 180) -> DataFrame:
    """Events of paged conflict JSON: title from a template, level from deaths, both sides as actors; no gate."""
    e = payloads(spark, DEATHS, path).select(F.explode("Result").alias("e")).select("e.*")
    e = e.withColumns({c: _or_empty(c) for c in ("conflict_name", "side_a", "side_b", "country")}).withColumn("place", F.coalesce(F.nullif("where_description", F.lit("")), "adm_1", F.lit(""))).withColumn("deaths", F.coalesce("best", F.lit(0)))
    title = F.format_string("%s: %s vs %s in %s, %s", F.coalesce(F.nullif("conflict_name", F.lit("")), F.lit("Armed clash")), "side_a", "side_b", "place", "country")
    rows = e.withColumns({"title": title, "description": F.format_string("%d deaths. UCDP verified.", "deaths"), "date": T.lenient_date(F.col("date_start")), "source_url": F.concat(F.lit("https://ucdp.uu.se/event/"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "source_name": F.lit("UCDP (Uppsala University)")})
    rows = rows.withColumn("region", T.detect_region(F.concat_ws(" ", "country", "place", "conflict_name", "side_a", "side_b"))).where(F.col("date") >= F.date_sub(_day(today), days))
    return _report(rows, F.substring("title", 1, 400), F.lit("proxy"), T.from_deaths(F.col("deaths")), F.filter(F.array("side_a", "side_b"), lambda a: a != ""))


def fatality_events(spark: SparkSession, path: str, today: str, days: int = 35) -> DataFrame:
    """Events asked for by region (region=...), of the last days: category by type, level from deaths and type, an address from what is known."""
    day = _day(today)
    e = payloads(spark, FATALITIES, path).select("region", F.explode("data").alias("e")).select("region", "e.*")
    e = e.withColumns({c: _or_empty(c) for c in ("event_type", "actor1", "actor2", "country", "location", "notes")}).withColumns({"date": F.coalesce(T.lenient_date(F.col("event_date")), day), "deaths": F.coalesce(F.col("fatalities").try_cast("int"), F.lit(0))})
    title = F.format_string("%s in %s, %s", F.coalesce(F.nullif("sub_event_type", F.lit("")), "event_type"), "location", "country")
    url = F.concat(F.lit("https://acleddata.com/data/?country="), F.replace("country", F.lit(" "), F.lit("+")), F.lit("#"), _or_empty("event_date"), F.lit("-"), F.replace("location", F.lit(" "), F.lit("")))
    rows = e.where(F.col("date").between(F.date_sub(day, days), day)).withColumns({"title": title, "description": T.extract_brief(F.col("notes")), "source_url": url, "source_name": F.concat(F.lit("ACLED ("), F.coalesce("source", F.lit("ACLED")), F.lit(")"))})
    return _report(rows, F.substring(F.concat("title", F.lit(". "), "notes"), 1, 600), T.event_category(F.col("event_type")), T.from_fatalities(F.col("event_type"), F.col("deaths")), F.filter(F.array("actor1", "actor2"), lambda a: a != ""))


# ---- HTML: pages (page_id, url, html) ----


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags are spaces, white space is single, the usual entities are their characters."""
    out = T.clean_html(html)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.flat(out)


def _pieces(pages: DataFrame, pattern: str, group: int = 1, most: int | None = None) -> DataFrame:
    """pages' columns but html, with n (from 0) and raw: what the pattern finds, at most so many a page."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    return pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(F.slice(found, 1, most) if most else found).alias("n", "raw"))


def list_items(pages: DataFrame, least: int = 40, most: int = 600) -> DataFrame:
    """page_id, n, item and item_url of list items of so many characters; the address gets a digest of the text."""
    out = _pieces(pages, r"(?s)<li[^>]*>(.*?)(?=<li|</li|</ul|</ol|$)").withColumn("item", plain(F.col("raw"))).where(F.length("item").between(least, most))
    return out.select("page_id", F.col("n").cast("long").alias("n"), "item", F.concat("url", F.lit("#"), F.substring(F.md5(F.substring("item", 1, 50).cast("binary")), 1, 8)).alias("item_url"), *[c for c in pages.columns if c == "date"])


def current_events(pages: DataFrame, verdicts: DataFrame | None = None, most: int = 600) -> DataFrame:
    """Reports from the list items of days' pages (with date)."""
    items = list_items(pages, 40, most).withColumnRenamed("item_url", "source_url").withColumns({"title": F.col("item"), "description": F.substring("item", 1, 280), "source_name": F.lit("Wikipedia Current Events"), "region": T.detect_region(F.col("item"))})
    return _report(gated(items, F.substring("item", 1, 200), F.substring("item", 201, 200), verdicts), F.substring("item", 1, 500))


def fallback_items(pages: DataFrame, tags: str = "article|li", least: int = 30, most: int = 20) -> DataFrame:
    """source, title, link and summary of the first elements of the first page that has any long enough.

    pages: source, rank (order in which a source's pages are tried), url, html.
    """
    found = _pieces(pages, rf"(?s)<(?:{tags})\b[^>]*>.*?</(?:{tags})>", 0, most).withColumn("summary", plain(F.col("raw"))).where(F.length("summary") > least)
    first = found.groupBy("source").agg(F.min("rank").alias("rank"))
    link = F.coalesce(F.nullif(F.regexp_extract("raw", r"href=[\"']?([^\"' >]*)", 1), F.lit("")), F.col("url"))
    return found.join(first, ["source", "rank"]).select("source", "n", F.substring("summary", 1, 200).alias("title"), link.alias("link"), "summary")


def links(pages: DataFrame) -> DataFrame:
    """page_id, n, href and label of anchors."""
    found = _pieces(pages, r"(?s)<a\s[^>]*>.*?</a>", 0)
    return found.select("page_id", F.col("n").cast("long").alias("n"), F.regexp_extract("raw", r"href=[\"']?([^\"' >]*)", 1).alias("href"), F.trim(T.clean_html(F.col("raw"))).alias("label"))


def _exercise(rows: DataFrame, context: Column, lead_nation: str, today: str, summary: Column, scale: Column | None = None) -> DataFrame:
    """rows (name, source_url, region) as exercises, with dates and troops read from the context; those without a region go."""
    out = rows.where("region is not null").withColumns({"when": T.exercise_dates(context, _day(today)), "scale": T.troop_count(context) if scale is None else scale, "lead_nation": F.lit(lead_nation), "raw_summary": summary})
    return out.select(F.substring("name", 1, 200).alias("name"), "region", F.col("when.start").alias("start_date"), F.col("when.end").alias("end_date"), "scale", "lead_nation", "source_url", "raw_summary")


def announced_exercises(news: DataFrame, details: DataFrame, site: str, today: str, most: int = 15) -> DataFrame:
    """Exercises from a news page's links that name one, the first so many a page, and the pages that they lead to (url, html)."""
    named = links(news).where(T.any_word(F.col("label"), dims.ANNOUNCEMENT_WORDS) & (F.col("href") != ""))
    first = capped(named, "page_id", "n", most).withColumn("name", T.flat(F.col("label"))).where(F.length("name") >= 5)
    first = first.withColumn("source_url", F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(site), "href")))
    rows = first.join(details.select(F.col("url").alias("source_url"), F.substring(plain(F.col("html")), 1, 2000).alias("body")), "source_url")
    rows = rows.withColumn("region", T.detect_exercise_region(F.concat("name", F.lit(" "), F.substring("body", 1, 500))))
    return _exercise(rows, F.col("body"), "NATO/SHAPE", today, F.substring("body", 1, 500))


def table_cells(pages: DataFrame, tables: int = 3, kind: str = "") -> DataFrame:
    """page_id, tab, row and cells of the first tables (of a class, if one is named), without their header row, at least two cells."""
    pattern = rf"(?s)<table[^>]*{kind}[^>]*>.*?</table>" if kind else r"(?s)<table.*?</table>"
    found = _pieces(pages, pattern, 0, tables).withColumnsRenamed({"n": "tab", "raw": "html"})
    rows = _pieces(found, r"(?s)<tr[^>]*>(.*?)(?=<tr|</table)").withColumnRenamed("n", "row")
    cells = F.transform(F.regexp_extract_all("raw", F.lit(r"(?s)<t[dh][^>]*>(.*?)(?=<t[dhr]|</t|$)"), F.lit(1)), lambda c: plain(c))
    return rows.where("row > 0").withColumn("cells", cells).where("size(cells) >= 2").drop("raw")


def tabled_exercises(pages: DataFrame, today: str, kind: str = "wikitable") -> DataFrame:
    """Exercises from the rows of a page's first three tables: the first cell is the name, of 3 to 100 characters."""
    rows = table_cells(pages, 3, kind).withColumns({"name": F.get("cells", F.lit(0)), "context": F.array_join("cells", " ")}).where(F.length("name").between(3, 100))
    return _exercise(rows.withColumns({"source_url": F.col("url"), "region": T.detect_exercise_region(F.col("context"))}), F.col("context"), "NATO/US", today, F.substring("context", 1, 400))


def headed_exercises(pages: DataFrame, today: str, site: str, most: int = 20) -> DataFrame:
    """Exercises from the headings of a page's first articles, where they name one; no number of troops."""
    found = _pieces(pages, r"(?s)<article\b[^>]*>.*?</article>", 0, most)
    heading = lambda h: F.nullif(F.regexp_extract("raw", rf"(?s)<{h}\b[^>]*>(.*?)</{h}>", 1), F.lit(""))
    href = F.regexp_extract("raw", r"<a\s[^>]*href=[\"']?([^\"' >]*)", 1)
    url = F.when(href == "", F.lit(site)).when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))
    rows = found.withColumns({"name": plain(F.coalesce(heading("h3"), heading("h2"))), "source_url": url}).where(T.any_word(F.col("name"), dims.HEADING_WORDS))
    return _exercise(rows.withColumn("region", T.detect_exercise_region(F.col("name"))), F.col("name"), "US DoD", today, F.col("name"), F.lit(None).cast("long"))


def feed_exercises(spark: SparkSession, path: str) -> DataFrame:
    """name, source_url, lead_nation, exercise_type, region and statements of feed items that name an exercise; labels come later."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    rows = rows.where(T.any_word(F.concat(_or_empty("title"), F.lit(" "), _or_empty("description")), dims.FEED_WORDS))
    return rows.select(F.coalesce("title", F.lit("Unknown")).alias("name"), _or_empty("link").alias("source_url"), F.lit("NATO").alias("lead_nation"), F.lit("NATO").alias("exercise_type"), F.lit("Europe").alias("region"), F.struct(_or_empty("title").alias("raw_title"), _or_empty("description").alias("raw_summary")).alias("statements"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Exercises of a curated registry file; an empty one is an error, so that a lost file never empties the table."""
    rows = spark.read.schema(REGISTRY).json(path)
    if rows.isEmpty():
        raise ValueError(f"the registry at {path} is empty")
    named = rows.withColumnsRenamed({"id": "registry_id", "status": "announcement_status", "source": "source_url"})
    return named.withColumns({"participants": T.participants(F.col("participants")), "announcement_status": F.coalesce("announcement_status", F.lit("projected")), "start_date": T.lenient_date(F.col("start_date")), "end_date": T.lenient_date(F.col("end_date"))})


def seeded(exercises: DataFrame, seeds: DataFrame) -> DataFrame:
    """exercises with those seeds whose name isn't there yet; of seeds that share a name, any one."""
    return exercises.unionByName(seeds.dropDuplicates(["name"]).join(exercises.select("name"), "name", "left_anti"), allowMissingColumns=True)


def fan_in(sources: list[DataFrame]) -> DataFrame:
    """All sources' reports as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def counted_fan_in(sources: dict[str, DataFrame], keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """source_group and inserted: how many of each source's reports are new by key, and 'total'; an earlier source takes a key first."""
    ranked = fan_in([df.select(*keys).withColumns({"source_group": F.lit(name), "turn": F.lit(k)}) for k, (name, df) in enumerate(sources.items())])
    first = ranked.groupBy(*keys).agg(F.min_by("source_group", "turn").alias("source_group"))
    if existing is not None:
        first = first.join(existing.select(*keys), keys, "left_anti")
    names = first.sparkSession.createDataFrame([(n,) for n in sources], "source_group string")
    counts = names.join(first.groupBy("source_group").agg(F.count("*").alias("inserted")), "source_group", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    return counts.unionByName(counts.agg(F.lit("total").alias("source_group"), F.sum("inserted").alias("inserted")))
