"""Text functions, sources, sinks and the streaming ingest."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tocsin.functions import text as T
from tocsin.operators import sinks as S
from tocsin.operators import views as V
from tocsin.sources import feeds as R
from tocsin.streaming.ingest import append_new


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_canonicalize(spark):
    for value, expected in (("UKRAINE", "Ukraine"), ("lebanon", "Gaza & Middle East"), ("in Somalia today", "Somalia"), ("nowhere", None), ("", None), (None, None)):
        assert one(spark, T.canonicalize(F.lit(value).cast("string"))) == expected


def test_longest_term_wins(spark):
    assert one(spark, T.resolve(F.lit("Clashes in Somalia"), F.lit("near the coast"))) == "Somalia"


def test_hash(spark):
    h = lambda t, u: one(spark, T.content_hash(F.lit(t), F.lit(u)))
    assert h("a", "u") == h("a", "u") != h("a", "v") and h("a", "u") != h("b", "u") and h("x" * 100 + "p", "u") == h("x" * 100 + "q", "u")


def test_gate_fails_closed(spark):
    assert one(spark, T.gate_verdict(F.lit(None).cast("string"))) is False
    assert one(spark, T.gate_verdict(F.lit("it is a security_incident"))) is True


def test_verdicts(spark):
    v = T.verdict_json(F.lit('```json\n{"category": "Cyber", "escalation_level": "9"}\n```'), "category string, escalation_level string")
    assert one(spark, T.verdict_category(v["category"])) == "cyber" and one(spark, T.verdict_level(v["escalation_level"])) == 5


def test_rss_and_json(spark, tmp_path):
    rss = "<rss><channel><item><title>Drone attack near Kyiv</title><link>http://a/1</link><description>&lt;b&gt;Two drones&lt;/b&gt; struck a depot near the city at night.</description><pubDate>Mon, 03 Jun 2024 10:00:00 GMT</pubDate></item><item><title>Old attack</title><link>http://a/2</link><pubDate>Mon, 01 Jan 2018 10:00:00 GMT</pubDate></item><item><title>Attack on Kyiv</title></item></channel></rss>"
    (tmp_path / "feeds" / "source=Wire").mkdir(parents=True)
    (tmp_path / "feeds" / "source=Wire" / "feed.xml").write_text(rss)
    (row,) = R.rss_items(spark, str(tmp_path / "feeds"), "2024-06-04").collect()
    assert (row.region, row.date, row.source_url, row.source_name, row.escalation_level) == ("Ukraine", dt.date(2024, 6, 3), "http://a/1", "Wire", 2)
    (tmp_path / "e.json").write_text(json.dumps({"Result": [{"id": 1, "side_a": "A", "side_b": None, "where_description": "Goma", "country": "DR Congo", "date_start": "2024-06-01", "best": 30}]}))
    (row,) = R.conflict_events(spark, str(tmp_path / "e.json"), "2024-06-04").collect()
    assert (row.region, row.escalation_level, row.actors, row.title, row.category) == ("DRC", 3, ["A"], "Armed clash: A vs  in Goma, DR Congo", "proxy")


def test_an_empty_registry_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text("")
    with pytest.raises(ValueError, match="empty"):
        R.registry(spark, str(tmp_path))


def test_html_tables(spark):
    page = spark.createDataFrame([(1, "u", "<table><tr><th>N<th>D</tr><tr><td>Big &amp; drill<td>May</tr></table>")], "page_id long, url string, html string")
    assert [r.cells for r in R.table_cells(page).collect()] == [["Big & drill", "May"]]


def test_the_three_detectors_differ(spark):
    cases = [
        ("Talks in Gaza about south china sea", "Gaza & Middle East", "Gaza & Middle East", "Gaza & Middle East"),
        ("Clashes in Somalia", "Sahel", "Sahel", "Sahel"),  # 'mali' is looked for before 'somalia' and is part of it
        ("Ceasefire on the frontline", None, None, None),
        ("a gang near the viv ansanm base", "Haiti", "Haiti", "Haiti"),
        ("a gang", None, "Haiti", None),
        ("drones over svalbard", None, "Arctic", "Arctic"),
        ("", None, None, None),
        (None, None, None, None),
    ]
    for text, first, loose, strict in cases:
        t = F.lit(text).cast("string")
        assert (one(spark, T.detect_region(t)), one(spark, T.detect_loosely(t)), one(spark, T.detect_with_hint(t, F.lit("")))) == (first, loose, strict), text
    assert one(spark, T.detect_with_hint(F.lit("unrest"), F.lit("Gang"))) == "Haiti" and one(spark, T.detect_with_hint(F.lit("a gang"), F.lit("mss"))) == "Haiti"
    assert one(spark, T.detect_exercise_region(F.lit("Drill off Norway and Taiwan"))) == "Baltic" and one(spark, T.detect_exercise_region(F.lit("Drill at sea"))) is None


def test_exercise_dates_and_troops(spark):
    today = dt.date(2024, 6, 1)
    cases = [
        ("12-15 march 2025", dt.date(2025, 3, 12), dt.date(2025, 3, 15)), ("May 3–9, 2026", dt.date(2026, 5, 3), dt.date(2026, 5, 9)), ("in 1999", dt.date(1999, 1, 1), dt.date(1999, 12, 31)),
        ("30-31 February 2025", dt.date(2025, 1, 1), dt.date(2025, 12, 31)), ("soon", today, dt.date(2024, 6, 15)), ("0000", today, dt.date(2024, 6, 15)),
    ]
    for text, a, b in cases:
        assert tuple(one(spark, T.exercise_dates(F.lit(text), F.lit(today)))) == (a, b), text
    for text, n in (("approximately 12,000 in all", 12000), ("over 9,000 came", 9000), ("5,000 NATO staff", 5000), ("5 troops", None), ("12 Troops", 12), ("none", None)):
        assert one(spark, T.troop_count(F.lit(text))) == n, text


def test_brief(spark):
    long1, long2 = "A first sentence of some length", "a second sentence of some length"
    for text, want in ((f"{long1}. {long2}. more", f"{long1}. {long2}"), (f"Short. {long2}. third sentence that is long", long2), (f"Short. Too. {long2}", f"Short. Too. {long2}"), (f"No! {long1}! x", f"No! {long1}! x"), ("A. B. C! D", "A. B. C! D"), (None, ""), ("<b>x</b>  y", "x y")):
        assert one(spark, T.extract_brief(F.lit(text).cast("string"))) == want, text


def test_upsert_and_violations(spark):
    old = spark.createDataFrame([("a", 1, 1)], "k string, v int, n int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, 1)], "k string, v int, n int")
    assert sorted((r.k, r.v) for r in S.upsert(old, new, ["k"], "n").collect()) == [("a", 3), ("b", 4)]
    bad = S.violations(spark.createDataFrame([(7,), (None,)], "v int"), {"range": "v between 1 and 5"}).collect()
    assert [r.violated for r in bad] == [["range"], []]


def test_stream_takes_each_content_once(spark, tmp_path):
    rows = [(1, "t", "u", dt.datetime(2024, 1, 1)), (2, "t", "u", dt.datetime(2024, 1, 2)), (3, "t2", "u2", dt.datetime(2024, 1, 2))]
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(rows, "id long, title string, source_url string, ts timestamp").coalesce(1).write.parquet(landing)
    append_new(spark, landing, target, state)
    append_new(spark, landing, target, state)
    assert spark.read.parquet(target).count() == 2


def test_late_rows_are_dropped_beyond_the_watermark(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda *r: spark.createDataFrame(r, "id long, title string, source_url string, ts timestamp").coalesce(1).write.mode("append").parquet(landing)
    rows((1, "t", "u", dt.datetime(2024, 6, 1)))
    append_new(spark, landing, target, state)
    rows((2, "late", "u2", dt.datetime(2024, 5, 1)), (3, "too late", "u3", dt.datetime(2024, 1, 1)), (4, "other", "u", dt.datetime(2024, 6, 1)))
    append_new(spark, landing, target, state)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2]


def test_one_pass_over_keys_equals_a_search_for_each(spark):
    keys = ["niger", "nigeria", "a", "ab", "abc", "bc", "u.s.", "u+", "c (d)", "é漢", "north sea", "sea", "x*"]
    pairs = [(k, f"v{n}") for n, k in enumerate(keys)]
    texts = [None, "", "in nigeria now", "xxab", "zbc", "the u.s. at", "uxs.", "u+v", "c (d) e", "é漢字", "north seab", "x*", "xx", "north", *keys]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.first, r.any) for r in rows.select("t", T._first_contained(F.col("t"), pairs).alias("first"), T.any_word(F.col("t"), tuple(keys)).alias("any")).collect()}
    assert got == {t: (next((v for k, v in pairs if t and k in t), None), bool(t) and any(k in t for k in keys)) for t in texts}
    words = {"R1": ["niger", "ab", "sea"], "R2": ["nigeria", "abc", "bc", "x*"], "R3": ["a", "ab"]}
    scored = rows.select("t", T._scored(F.col("t"), words, lambda s: s["n"] >= 1).alias("r")).collect()
    counts = {t: {r: sum(k in t for k in ks) for r, ks in words.items()} for t in texts if t is not None}
    assert {r.t: r.r for r in scored if r.t is not None} == {t: max(c, key=lambda r: (c[r], -list(words).index(r))) if max(c.values()) else None for t, c in counts.items()}


def test_of_a_batch_little_is_strings_at_once(monkeypatch):
    texts = pa.array(["x" * 700_000, None, "", "y" * 700_000, "é" * 2_000_000, "z"], pa.string())
    whole, sizes = list(T._in_parts(texts)), []
    assert whole == texts.to_pylist() and list(T._in_parts(texts.slice(3))) == whole[3:] and list(T._in_parts(texts.slice(0, 0))) == []

    length = pc.binary_length

    class Part:
        def __init__(self, a):
            self.a = a

        def __len__(self):
            return len(self.a)

        def slice(self, at, n):
            sizes.append(self.a.slice(at, n).nbytes)
            return self.a.slice(at, n)

    monkeypatch.setattr(T.pc, "binary_length", lambda t: length(t.a))
    assert list(T._in_parts(Part(texts))) == whole and len(sizes) == 4


def test_a_remap_is_worked_out_once(spark):
    rows = spark.createDataFrame([("a", "in kyiv"), ("Ukraine", "near kyiv"), (None, "kyiv"), ("a", "nowhere"), ("a", "kyiv again")], "old string, t string")
    out = V.remaps(rows, F.col("old"), T.resolve(F.col("t")))
    assert [tuple(r) for r in out.collect()] == [("a", "Ukraine", 2), ("a", "(unresolved)", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_each_landed_feed_gives_its_first_items(spark, tmp_path):
    (tmp_path / "source=Wire").mkdir()
    for name in ("a", "b"):
        items = "".join(f"<item><title>{name}{k}</title><link>http://{name}/{k}</link></item>" for k in range(50))
        (tmp_path / "source=Wire" / f"{name}.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")  # a file is read in parts
    try:
        got = [r.title for r in R.feed_items(spark, str(tmp_path), 30).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(f"{name}{k}" for name in "ab" for k in range(30))


def test_a_feed_in_pages_gives_its_first_items(spark, tmp_path):
    for page, size in ((2, 50), (10, 50), (0, 10)):
        folder = tmp_path / "source=Wire" / f"page={page}"
        folder.mkdir(parents=True)
        folder.joinpath("a.xml").write_text("<rss><channel>" + "".join(f"<item><title>{page}-{k}</title></item>" for k in range(size)) + "</channel></rss>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        rows = R.feed_items(spark, str(tmp_path), 30)
        got = [r.title for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted([f"0-{k}" for k in range(10)] + [f"2-{k}" for k in range(20)])
    assert set(rows.columns) == {"title", "link", "description", "pubDate", "source"}


def test_broken_payloads_go_to_quarantine_and_are_counted(spark, tmp_path):
    good = json.dumps({"Result": [{"id": 1, "side_a": "A", "where_description": "Goma", "country": "DR Congo", "date_start": "2024-06-01", "best": 30}]})
    (tmp_path / "e.json").write_text(good + "\n" + good[:40] + "\n" + '{"Result": 7}' + "\n")
    assert R.conflict_events(spark, str(tmp_path), "2024-06-04").count() == 1
    assert sorted(r.record for r in R.quarantine(spark, R.DEATHS, str(tmp_path)).collect()) == sorted([good[:40], '{"Result": 7}'])
    reports = R.conflict_events(spark, str(tmp_path), "2024-06-04")
    new, metrics = R.observed(reports.unionByName(reports.withColumn("source_url", F.lit("known"))), "run", spark.createDataFrame([("known",)], "source_url string"))
    assert new.count() == 1
    assert metrics.get == {"seen": 2, "skipped": 1, "flagged": 0}
