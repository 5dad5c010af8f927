"""Facts about the index: weights, windows, normaliser, composite."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tocsin.functions import dims, scoring
from tocsin.operators import index as X

TODAY = dt.date(2026, 7, 1)


def gz_of(spark, events):
    """Load, kappa and saturation of one region on TODAY; events: (severity, days ago, corroboration)."""
    rows = [("r", TODAY - dt.timedelta(days=ago), s, c) for s, ago, c in events] + [("r", TODAY, None, 0)]
    df = spark.createDataFrame(rows, "region string, date date, severity int, corroboration long")
    w = F.when(F.col("corroboration") > 0, scoring.severity_weight(F.col("severity")) * scoring.corroboration(F.col("corroboration"))).otherwise(0.0)
    daily = df.groupBy("region", "date").agg(F.sum(w).alias("w"), F.sum(w).alias("w_first"), F.count("*").alias("n_events"), F.sum("corroboration").alias("n_reports"))
    return X.with_gz(X.rolling_load(daily)).where(F.col("date") == TODAY).first()


def steady(level, per_day, days=120):
    return [(level, k, 1) for k in range(days) for _ in range(per_day)]


def test_weights_are_convex():
    values = [dims.SEVERITY[k] for k in range(1, 6)]
    assert values == sorted(values) and values[4] / values[0] == pytest.approx(40)


def test_region_list_and_baselines_agree():
    assert len(dims.REGIONS) == 20 and set(dims.TERMS.values()) == set(dims.REGIONS) == set(dims.KEYWORDS) and len(dims.TERMS) == 141 and len(dims.SECURITY_STEMS) == 81
    assert all(0 <= v[-1] <= 0.5 for v in dims.REGIONS.values())


def test_empty_and_bounds(spark):
    assert gz_of(spark, []).gz == 0
    assert 0 <= gz_of(spark, [(5, 0, 20)] * 200).gz <= 1


def test_one_severe_outweighs_many_slight(spark):
    assert gz_of(spark, [(5, 1, 1)]).load > gz_of(spark, [(1, 1, 1)] * 10).load


def test_recency_and_window_edges(spark):
    single = dims.SEVERITY[3]
    for ago, expected in ((0, 1.6), (7, 1.6), (8, 1.0), (30, 1.0), (31, 0.0)):
        assert gz_of(spark, [(3, ago, 1)]).load == pytest.approx(single * expected, abs=1e-9)


def test_level_clamps(spark):
    for level, like in ((None, 1), (0, 1), (9, 5), (-3, 1)):
        got = spark.range(1).select(scoring.severity_weight(F.lit(level).cast("int")).alias("w")).first().w
        assert got == dims.SEVERITY[like]


def test_corroboration_is_sublinear(spark):
    got = spark.createDataFrame([(c,) for c in (1, 2, 5, 20)], "c long").select(scoring.corroboration(F.col("c")).alias("x"), "c").collect()
    by = {r.c: r.x for r in got}
    assert by[1] == 1 and by[1] < by[2] < by[5] < by[20] < 1.5


def test_kappa_cold_start_and_floor(spark):
    assert gz_of(spark, []).kappa == 15
    assert gz_of(spark, [(4, 1, 2)]).kappa == 15
    rows = spark.createDataFrame([(0.0, 14), (0.0, 15), (1.0, 90), (10.0, 90)], "m double, n int")
    got = [r.k for r in rows.select(scoring.kappa(F.col("m"), F.col("n")).alias("k")).collect()]
    assert got[:3] == [15.0, 3.0, 3.0] and got[3] == pytest.approx(10 / -math.log(0.65))


def test_steady_state_is_the_norm(spark):
    assert abs(gz_of(spark, steady(3, 8)).gz - 0.35) < 0.06
    assert abs(gz_of(spark, steady(2, 1)).gz - 0.35) < 0.12


def test_composite_and_exercises(spark):
    inc = spark.createDataFrame([(1, dt.date(2024, 3, 1), "r", 4, "t")], "id long, date date, region string, escalation_level int, title string")
    ex = spark.createDataFrame([(1, dt.date(2024, 3, 10), dt.date(2024, 3, 12), 80000, "r", "confirmed", 0.5), (2, dt.date(2024, 3, 1), dt.date(2024, 3, 2), 0, "r", None, 0.0)], "id long, start_date date, end_date date, scale int, region string, announcement_status string, rhetoric_score double")
    got = {r.date: r for r in X.composite_history(inc, ex).collect()}[dt.date(2024, 3, 1)]
    assert got.ex_score == 100.0 and got.rh_score == 75.0  # a null status drops out
    manual = ex.withColumn("announcement_status", F.lit("archived-manual"))
    assert {r.date: r for r in X.composite_history(inc, manual).collect()}[dt.date(2024, 3, 1)].ex_score == 0.0
    assert got.ei_score == pytest.approx(got.gz_score * 0.45 + 35 + 1, abs=0.11)


def test_upper_median_counts_equal_values(spark):
    from tocsin.operators.views import upper_median

    rows = [("a", v) for v in (5, 1, 5, 5, 2, 9)] + [("b", v) for v in (3, None, 1)] + [("c", 7)] * 5000 + [("c", 8)] * 5000 + [("d", None)]
    out = upper_median(spark.createDataFrame(rows, "k string, v int"), "k", "v")
    assert {r.k: r.upper_median for r in out.collect()} == {"a": 5, "b": 3, "c": 8, "d": None}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_no_lookahead_against_a_day_by_day_model(spark):
    """The history equals clustering anew, for every day, the reports up to that day."""
    import random

    from tocsin.operators.cluster import token_similarity_of

    rng = random.Random(4)
    words = ["alpha", "bravo", "carbon", "delta", "echo", "fox"]
    start = dt.date(2024, 1, 1)
    rows = [(k, " ".join(rng.choices(words, k=3)), start + dt.timedelta(days=rng.randrange(40)), rng.randrange(1, 6), "r") for k in range(90)]
    got = {r.date: r for r in X.with_gz(X.rolling_load(X.daily_weights(spark.createDataFrame(rows, "id long, title string, date date, escalation_level int, region string")))).collect()}

    def events(until):
        leaders = []
        for r in sorted((r for r in rows if r[2] <= until), key=lambda r: (r[2], r[0])):
            for e in leaders:
                if (r[2] - e["date"]).days <= 1 and token_similarity_of(e["title"], r[1]) >= 70:
                    e["n"] += 1
                    e["level"] = max(e["level"], r[3])
                    break
            else:
                leaders.append({"date": r[2], "title": r[1], "n": 1, "level": r[3]})
        return leaders

    def load(es, on):
        return sum(dims.SEVERITY[e["level"]] * (1 + 0.15 * math.log(e["n"])) * (1.6 if (on - e["date"]).days <= 7 else 1.0) for e in es if 0 <= (on - e["date"]).days <= 30)

    for k in range(0, 40, 3):
        on = start + dt.timedelta(days=k)
        es = events(on)
        past = sorted(load([e for e in es if e["date"] <= on - dt.timedelta(days=j)], on - dt.timedelta(days=j)) for j in range(1, 91))
        median = (past[44] + past[45]) / 2
        kappa = 15.0 if median <= 0 and sum(x > 0 for x in past) < 15 else max(3.0, median / -math.log(0.65))
        want = load(es, on)
        assert (got[on].load, got[on].kappa) == (pytest.approx(want), pytest.approx(kappa))
        assert got[on].gz == pytest.approx(min(1 - math.exp(-want / kappa), 1) if want > 0 else 0)


def test_intervals_as_sums_of_differences(spark):
    import random

    rng = random.Random(6)
    d0 = dt.date(2024, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    rows = [(k, day(a), day(a + rng.choice([-20, -14, 0, 3, 30])), rng.choice([None, 0, 4000, 90000]), rng.choice("rs"), rng.choice(["confirmed", "archived-manual", None, "projected"]), rng.choice([None, -1.0, 0.25])) for k in range(60) for a in [rng.randrange(50)]]
    rows += [(99, None, day(3), 1, "r", "confirmed", None), (98, day(3), None, 1, "r", "confirmed", None)]
    df = spark.createDataFrame(rows, "id long, start_date date, end_date date, scale int, region string, announcement_status string, rhetoric_score double")
    got = {(r.region, r.date): r for r in X.exercise_parts(df).collect()}
    asked = spark.createDataFrame([(r, day(n)) for r in "rs" for n in range(-20, 100, 7)], "region string, date date")
    pairs = {(r.region, r.date, r.id) for r in X.exercise_days(df, asked).collect()}
    for r in "rs":
        for n in range(-20, 100):
            t = day(n)
            on = [x for x in rows if x[4] == r and x[5] in ("confirmed", "projected") and x[1] and x[2] and x[2] >= t and x[1] <= t + dt.timedelta(days=14)]
            if not on:
                assert (r, t) not in got
                continue
            tones = [x[6] for x in on if x[6] is not None]
            assert got[r, t].n_exercises == len(on) and got[r, t].ex == pytest.approx(sum(min((x[3] or 5000) / 80000, 1) for x in on) / len(on))
            assert got[r, t].rh == (pytest.approx((sum(tones) / len(tones) + 1) / 2) if tones else None)
            if (n + 20) % 7 == 0:
                assert {i for q, u, i in pairs if (q, u) == (r, t)} == {x[0] for x in on}


def test_daily_job(spark):
    from tocsin.plans import daily as P

    day = dt.date(2024, 3, 1)
    reports = spark.createDataFrame([(1, "Shelling in Kyiv", "text", "u1", day, None, None), (2, "Shelling in Kyiv", "text", "u2", day, None, None), (3, "Port struck", "x", "u3", day, "Atlantis", None), (4, "", "", "u4", day, None, None)], "id long, title string, description string, source_url string, date date, region string, category string")
    reports = reports.withColumns({"escalation_level": F.lit(2), "actors": F.lit(None).cast("array<string>")})
    verdicts = spark.createDataFrame([(1, '{"category": "military", "escalation_level": 5}'), (3, '{"category": "maritime", "escalation_level": "4", "region": "red sea"}')], "id long, raw string")
    exercises = spark.createDataFrame([(7, "Drill", day, day, 80000, "Ukraine", "confirmed", None)], "id long, name string, start_date date, end_date date, scale int, region string, announcement_status string, rhetoric_score double").withColumn("exercise_type", F.lit(None).cast("string"))
    taxonomy = spark.createDataFrame([(7, '{"exercise_type": "FTX", "scale": "Large", "rhetoric_score": 1}')], "id long, raw string")
    kept = P.classify(P.ingest(P.unclassifiable(reports)), verdicts).collect()
    assert {(r.id, r.region, r.category, r.escalation_level) for r in kept} == {(1, "Ukraine", "military", 5), (3, "Yemen", "maritime", 4), (4, "Unknown", "unclassifiable", 2)}
    got = {r.region: r for r in P.daily(reports, verdicts, exercises, taxonomy).where(F.col("date") == day).collect()}
    assert got["Ukraine"].ex_score == 100.0 and got["Ukraine"].rh_score == 100.0 and got["Yemen"].ex_score == 0.0 and got["Ukraine"].reports_30d == 1


def test_nested_ranges_cover_an_interval_once(spark):
    rng = random.Random(4)
    rows = [(k, *sorted((rng.randrange(-40000, 40000), rng.randrange(-40000, 40000)))) for k in range(60)] + [(60, 5, 5), (61, 4, 4), (62, 7, 8), (63, 0, 2**15), (64, 9, 3), (65, -3, 12)]
    got = spark.createDataFrame(rows, "id int, a int, b int").select("id", "a", "b", X.dyadic_ranges(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        days = [d for x in r.r for d in range(x.number << x.level, (x.number + 1) << x.level)]
        assert sorted(days) == list(range(r.a, r.b + 1)) and len(r.r) <= 2 * max(1, (r.b - r.a + 1).bit_length()), r


def test_interval_join_with_intervals_of_decades(spark):
    rng = random.Random(5)
    day = lambda n: dt.date(1990, 1, 1) + dt.timedelta(days=n)
    rows = [(k, rng.choice("rq"), day(a := rng.randrange(9000)), day(a + rng.choice([0, 3, 100, 365 * 50])), 1000 * k, rng.choice([0.5, None]), "confirmed") for k in range(60)] + [(99, "r", day(50), None, 1, 0.1, "confirmed"), (98, "r", day(50), day(60), 1, 0.1, "archived-manual"), (97, "q", day(50), day(49), 1, 0.1, "confirmed"), (96, "q", day(50), day(20), 1, 0.1, "confirmed")]
    exercises = spark.createDataFrame(rows, "id long, region string, start_date date, end_date date, scale int, rhetoric_score double, announcement_status string")
    asked = [(r, day(n)) for r in "rq" for n in range(-40, 30000, 97)]
    got = {(r.region, r.date, r.id) for r in X.exercise_days(exercises, spark.createDataFrame(asked, "region string, date date")).collect()}
    want = {(r, d, e[0]) for r, d in asked for e in rows if e[1] == r and e[6] != "archived-manual" and e[3] and e[2] - dt.timedelta(days=14) <= d <= e[3]}
    assert got == want and len(want) > 500
    assert X.exercise_days(exercises.limit(0), spark.createDataFrame(asked, "region string, date date")).count() == 0
    key = lambda df: sorted((r.region, r.date, round(r.ex, 9), None if r.rh is None else round(r.rh, 9), r.n_exercises) for r in df.collect())
    days = spark.createDataFrame(asked, "region string, date date")
    assert key(X.exercise_parts_on(exercises, days)) == key(X.exercise_parts(exercises).join(days, ["region", "date"], "left_semi"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_revised_history_equals_a_full_rebuild(spark, seed):
    rng = random.Random(seed)
    titles = ["port hit by missile strike", "missile strike hits port", "talks resume", "flood in the south", "south flooded", ""]
    day = lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)
    one = lambda k, spots, regions: (k, rng.choice(titles), day(rng.choice(spots)), rng.randrange(1, 6), rng.choice(regions))
    kinds = "id long, title string, date date, escalation_level int, region string"
    spots = [rng.randrange(300) for _ in range(30)]
    old = spark.createDataFrame([one(k, [*spots, None], "rs") for k in range(150)], kinds)
    # before the first day, after the last one, in a region of its own, without a date, and among the others
    late = spark.createDataFrame([one(1000 + k, where, regions) for k, (where, regions) in enumerate([([-9], "r"), ([320], "s"), ([40], "t"), ([None], "r"), (spots, "rs"), (spots, "r")]) if seed > 1 or k > 2], kinds)
    exercises = spark.createDataFrame([(1, "r", day(10), day(90), 9000, 0.4, "confirmed"), (2, "t", day(30), day(35), None, None, "projected")], "id long, region string, start_date date, end_date date, scale int, rhetoric_score double, announcement_status string")
    daily = X.daily_weights(old)
    got, kept = X.revised(X.composite_history(old, exercises, daily=daily), daily, old, late, exercises)
    both = old.unionByName(late)
    row = lambda df: sorted(map(repr, df.collect()))
    assert row(got) == row(X.composite_history(both, exercises).select(*got.columns))
    rounded = lambda df: sorted((r.region, r.date, round(r.w, 9), round(r.w_first, 9), r.n_events, r.n_reports) for r in df.collect())
    assert rounded(kept) == rounded(X.daily_weights(both))


def test_undated_reports_do_not_weigh(spark):
    rows = [(1, "a title of a report", dt.date(2024, 1, 5), 2, "r"), (2, "a title of a report", None, 5, "r")]
    (r,) = X.daily_weights(spark.createDataFrame(rows, "id long, title string, date date, escalation_level int, region string")).collect()
    assert (r.w, r.n_events, r.n_reports) == (0.3, 1, 1)


def test_revision_makes_no_row_for_each_exercise_and_day(spark, monkeypatch):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    kinds = "id long, title string, date date, escalation_level int, region string"
    old, late = spark.createDataFrame([(1, "a", day(0), 2, "r"), (2, "b", day(9), 3, "r")], kinds), spark.createDataFrame([(3, "c", day(5), 4, "r")], kinds)
    exercises = spark.createDataFrame([(k, "r", day(k - 900), day(k + 900), 9000 * k, 0.4, "confirmed") for k in range(5)], "id long, region string, start_date date, end_date date, scale int, rhetoric_score double, announcement_status string")

    def joined(*_):
        raise AssertionError("days and exercises are joined")

    monkeypatch.setattr(X, "exercise_days", joined)
    daily = X.daily_weights(old)
    got, _ = X.revised(X.composite_history(old, exercises, daily=daily), daily, old, late, exercises)
    row = lambda df: sorted(map(repr, df.collect()))
    assert row(got) == row(X.composite_history(old.unionByName(late), exercises).select(*got.columns))
