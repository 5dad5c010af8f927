"""Clustering and deduplication against sequential models."""

import datetime as dt
import random
import tracemalloc
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from tocsin.operators import cluster as C
from tocsin.operators import fuzzy, screen

ITEM = "id long, title string, date date, escalation_level int, region string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def clusters(spark, rows):
    return C.event_clusters(spark.createDataFrame(rows, ITEM)).collect()


def test_identical_titles_merge(spark):
    (e,) = clusters(spark, [(1, "Missile strike hits port", day(0), 2, "r"), (2, "Missile strike hits port", day(0), 3, "r")])
    assert (e.corroboration, e.severity, e.rep_id, e.first_corroboration) == (2, 3, 1, 2)


def test_reworded_next_day_merges_and_takes_the_first_day(spark):
    (e,) = clusters(spark, [(1, "Missile strike hits port of Odesa", day(1), 2, "r"), (2, "Missile strike hits the port of Odesa", day(0), 3, "r")])
    assert (e.date, e.title, e.corroboration, e.first_corroboration, e.first_severity) == (day(0), "Missile strike hits the port of Odesa", 2, 1, 3)


def test_different_far_and_empty_stay_apart(spark):
    assert len(clusters(spark, [(1, "Flood relief arrives", day(0), 1, "r"), (2, "Parliament votes on budget", day(0), 1, "r")])) == 2
    assert len(clusters(spark, [(1, "Same words here", day(0), 1, "r"), (2, "Same words here", day(9), 1, "r")])) == 2
    assert len(clusters(spark, [(1, "", day(0), 1, "r"), (2, "", day(0), 1, "r")])) == 2
    assert clusters(spark, []) == []


def test_scorer_separates():
    assert C.token_similarity_of("port hit by missile strike", "missile strike port hit by") >= 70
    assert C.token_similarity_of("Flood relief arrives in town", "Parliament votes on the budget") < 70


def test_greedy_equals_a_loop(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "carbon", "delta", "echo", "fox"]
    rows = [(k, " ".join(rng.choices(words, k=3)), day(rng.randrange(4)), 1, rng.choice("rs")) for k in range(60)]
    leaders, expected = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        for q in leaders:
            if q[4] == r[4] and abs((q[2] - r[2]).days) <= 1 and C.token_similarity_of(q[1], r[1]) >= 70:
                expected[r[0]] = q[0]
                break
        else:
            leaders.append(r)
            expected[r[0]] = r[0]
    members = C.event_members(C.title_nodes(spark.createDataFrame(rows, ITEM))).collect()
    at = {(m.region, m.date, m.title): m.rep for m in members}
    assert {r[0]: at[r[4], r[2], r[1]] for r in rows} == expected
    full = clusters(spark, rows)
    assert sum(e.corroboration for e in full) == len(rows) and {e.rep_id for e in full} == set(expected.values())


def test_rows_without_a_date_are_close_to_all(spark):
    rows = [(1, "Same words here", day(0), 1, "r"), (2, "Same words here", day(9), 1, "r"), (3, "Same words here", None, 4, "r"), (4, "Same words here", None, 1, "q"), (5, "Same words here", None, 1, "q")]
    got = {e.rep_id: (e.corroboration, e.severity) for e in clusters(spark, rows)}
    assert got == {1: (2, 4), 2: (1, 1), 4: (2, 1)}


def test_a_chain_is_no_cluster_and_long_ones_end(spark):
    titles = ["aa bb cc dd", "bb cc dd ee", "cc dd ee ff"]
    assert C.token_similarity_of(titles[0], titles[1]) >= 70 > C.token_similarity_of(titles[0], titles[2])
    got = clusters(spark, [(k, t, day(k), 1, "r") for k, t in enumerate(titles)])
    assert sorted((e.rep_id, e.corroboration) for e in got) == [(0, 2), (2, 1)]


def test_chain_of_a_thousand_days_is_swept_in_one_pass(spark, monkeypatch):
    rows = [(k, "the same title every day", day(k), 1 + k % 5, "r") for k in range(1000)] + [(5000 + k, "other words altogether", day(7 * k), 1, "q") for k in range(100)]
    writes = []
    monkeypatch.setattr(C, "written", lambda df, name, f=C.written: writes.append(name) or f(df, name))
    got = clusters(spark, rows)
    assert sorted((e.rep_id, e.corroboration, e.severity) for e in got if e.region == "r") == [(k, 2, max(1 + k % 5, 1 + (k + 1) % 5)) for k in range(0, 1000, 2)]
    assert sum(e.region == "q" for e in got) == 100 and writes == ["titles", "pairs"]  # no rounds


def test_sweep_holds_no_object_for_each_pair_and_goes_on_over_batches(spark, monkeypatch):
    rng = np.random.default_rng(31)
    days, pairs = {k: k // 300 for k in range(900)}, []
    for b in range(900):
        for a in sorted(rng.choice(900, size=200, replace=False).tolist(), key=lambda a: (days[a], a)):
            if a < b and days[b] - days[a] <= 1 and (a % 7 == b % 7 or b % 50 == 0):
                pairs.append(("r", days[b], days[b] - days[a], a, b))
    dropped = {}
    for _, _, _, a, b in pairs:
        if b not in dropped and a not in dropped:
            dropped[b] = a
    ran = []
    given = spark.createDataFrame([("r", day(0), 0, 1, 2)], "region string, day date, gap int, a long, b long")
    monkeypatch.setattr(type(given), "mapInArrow", lambda df, f, schema: ran.append(f) or df)
    C.sweep(given)
    columns = lambda rows: [pa.array(c) for c in zip(*[(r, 0, d, gap, a, b) for r, d, gap, a, b in rows], strict=True)]
    names = ["region", "chain", "day", "gap", "a", "b"]
    batches = [pa.record_batch(columns(pairs[at : at + 97]), names=names) for at in range(0, len(pairs), 97)]
    got = {x["id"]: x["rep"] for out in ran[0](iter([batches[0].slice(0, 0), *batches])) for x in out.to_pylist()}
    assert got == dropped and len(dropped) > 500
    many = 200_000
    hot = pa.record_batch([pa.array(["r"]).take(pa.array(np.zeros(many, dtype=np.int64))), *[pa.array(np.zeros(many, dtype=np.int64))] * 3, pa.array(np.arange(many) % 1000), pa.array(1000 + np.arange(many) // 1000)], names=names)
    tracemalloc.start()
    assert sum(out.num_rows for out in ran[0](iter([hot]))) == 200
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()


TITLES = ["port hit by missile strike", "Missile strike hits port of Odesa", "strike", "a a b", "b a", "x y z", "z y x w", "The port, hit again", "talks resume in the capital", "talks in capital resume", "é 漢字 talks", "aaaa", "aaab"]


def test_batch_scores_equal_the_plain_scorer():
    rng = random.Random(6)
    texts = TITLES + ["".join(rng.choice(["ab", "a", " ", "b", "c d", "X"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts += [" ".join(rng.choices("alpha bravo Carbon delta echo the of in fox port strike".split(), k=rng.randint(1, 14))) for _ in range(60)]
    texts = [t for t in dict.fromkeys(texts) if t.strip()]
    x, y = (v.astype(np.int64) for v in np.triu_indices(len(texts), 1))
    got = fuzzy.title_scores(texts, x, y, 70.0)
    want = np.array([fuzzy.title_score(texts[i], texts[j]) for i, j in zip(x, y, strict=True)])
    assert ((got >= 70) == (want >= 70 - 1e-9)).all() and 100 < (want >= 70).sum() < len(x) / 2


def test_scores_worked_out_by_hand():
    share = lambda common, n, m: 200 * common / (n + m)
    known = {
        ("abcd", "abcd"): 100.0,
        ("ab cd", "cd ab"): 100.0,  # equal when sorted
        ("one two", "one two three"): 100.0,  # one word set holds the other
        ("aa bb", "cc dd"): share(1, 5, 3),  # only the space is common; "cc ", cut by its end, is the shortest window with it
        ("ab ab ab", "ab"): 100.0,  # repeated words count once in the word sets
        ("xx xx xx", "xy xy"): share(3, 5, 4),  # no shared word; x, space, x in the window "xx x", cut by its end
        ("pq rs pq rs", "rt pz"): share(3, 5, 5),  # no shared word: once repetitions are gone, p, space, r of "pq rs" and "pz rt"
        ("ab ab cd", "xy"): 0.0,
        ("kitten", "sitting"): share(4, 6, 6),  # i, t, t, n in the window "sittin"
    }
    got = {k: fuzzy.title_score(*k) for k in known}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in known.items()}


def test_blocks_of_a_hot_cell_give_all_pairs(spark):
    rng = random.Random(8)
    words = "alpha bravo carbon delta echo fox golf hotel".split()
    rows = [(k, " ".join(rng.choices(words, k=3)), day(rng.choice([0, 0, 0, 1, 3])), rng.choice("rrrq")) for k in range(120)]
    items = spark.createDataFrame(rows, "id long, title string, date date, region string")
    want = {(p[0], q[0]) for p in rows for q in rows if p[3] == q[3] and 0 <= (q[2] - p[2]).days <= 1 and (p[2], p[0]) < (q[2], q[0]) and C.token_similarity_of(p[1], q[1]) >= 70}
    assert {(r.a, r.b) for r in C.similar_pairs(items).collect()} == want
    same = {(p[0], q[0]) for p in rows for q in rows if p[3] == q[3] and p[0] < q[0] and C.token_similarity_of(p[1], q[1]) >= 70}
    split = {(p[0], q[0]) for p in rows for q in rows if p[3] == q[3] and p[0] % 3 == 0 < q[0] % 3 and C.token_similarity_of(p[1], q[1]) >= 70}
    base = items.selectExpr("id", "region", "title as t")
    parted = base.selectExpr("*", f"if(id % 3 = 0, {fuzzy.LEFT}, {fuzzy.RIGHT}) as part")
    for block in (7, 1024):  # pairs of blocks are rows, not pairs of titles
        for given, want in ((base.selectExpr("*", f"{fuzzy.BOTH} as part"), same), (parted, split)):
            got = [(r.a, r.b) for r in fuzzy.block_join(given, ["region"], block=block).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_other_scorers(spark):
    from difflib import SequenceMatcher

    texts = ["Port hit by strike", "strike BY port hit", "abc", "xyz", "", "a"]
    x, y = np.array([0, 2, 4]), np.array([1, 3, 5])
    ordered = lambda t: " ".join(sorted(t.lower().split()))
    exact = [100 * max(SequenceMatcher(None, texts[i].lower(), texts[j].lower()).ratio(), SequenceMatcher(None, ordered(texts[i]), ordered(texts[j])).ratio()) for i, j in zip(x, y, strict=True)]
    assert fuzzy.sequence_scores(texts, x, y, 70.0).tolist() == [v if v >= 70 else 0 for v in exact]
    rows = [(1, [1.0, 0.0], day(0), "r"), (2, [0.9, 0.1], day(1), "r"), (3, [0.0, 1.0], day(1), "r"), (4, None, day(1), "r"), (5, [1.0, 0.0], day(5), "r")]
    found = C.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>, date date, region string"), text="v", scorer=fuzzy.cosine_scores, least=95.0)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]


def test_difflib_sees_few_pairs(monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "bravo", "ÄÖ", "x", "the", "the", "carbon"]
    texts = ["", " ", "a", "漢字 a", "İstanbul ist", "the " * 80] + [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(60)] + ["".join(rng.choices("abcdefghij klmnopqrstuvwxyz", k=100)) for _ in range(60)]
    x, y = np.triu_indices(len(texts), 1)
    ordered = lambda t: " ".join(sorted(t.lower().split()))
    want = np.array([100 * max(SequenceMatcher(None, texts[i].lower(), texts[j].lower()).ratio(), SequenceMatcher(None, ordered(texts[i]), ordered(texts[j])).ratio()) for i, j in zip(x, y, strict=True)])
    for least in (40.0, 70.0, 100.0):
        assert np.array_equal(fuzzy.sequence_scores(texts, x, y, least), np.where(want >= least, want, 0))
    seen = []
    monkeypatch.setattr(fuzzy, "SequenceMatcher", lambda *a: seen.append(a) or SequenceMatcher(*a))
    far = x >= 66  # characters at random: like quantities, other orders
    fuzzy.sequence_scores(texts, x[far], y[far], 70.0)
    assert far.sum() == 1770 and len(seen) < 20


def test_matching_blocks_are_those_of_difflib():
    rng = random.Random(4)
    for _ in range(3000):
        letters = rng.choice(["ab", "abc", "abcdefgh ", "ab é漢"])
        a, b = ("".join(rng.choices(letters, k=rng.randrange(40))) for _ in "ab")
        if rng.random() < 0.5:
            b = a[: rng.randrange(len(a) + 1)] + b  # a common beginning
        if rng.random() < 0.1:
            a, b = a * 8, b * 7  # from 200 characters on difflib leaves usual ones out
        assert fuzzy.matched_length(a, b) == sum(block.size for block in SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_similar_titles_need_no_plain_difflib(monkeypatch):
    rng = random.Random(7)
    texts = ["the same beginning of many titles, " + "".join(rng.choices("abcdef gh", k=20)) for _ in range(30)]
    x, y = np.triu_indices(len(texts), 1)
    ordered = lambda t: " ".join(sorted(t.split()))
    want = [100 * max(SequenceMatcher(None, texts[i], texts[j]).ratio(), SequenceMatcher(None, ordered(texts[i]), ordered(texts[j])).ratio()) for i, j in zip(x, y, strict=True)]
    monkeypatch.setattr(fuzzy, "SequenceMatcher", None)
    assert min(want) > 60 and fuzzy.sequence_scores(texts, x, y, 60.0).tolist() == want


def test_a_side_that_meets_itself_has_each_pair_once(monkeypatch):
    titles = _mixed_titles(np.random.default_rng(29), 300)
    monkeypatch.setattr(screen, "STRIP", 16)
    monkeypatch.setattr(screen, "HANDED", 500)
    for strips, whole, least in ((screen.title_strips, screen.title_candidates, 70.0), (screen.sequence_strips, screen.sequence_candidates, 70.0)):
        parts = list(strips(titles, titles, least, True))
        got = [(min(i, j), max(i, j)) for part in parts for i, j in zip(part[0].tolist(), part[1].tolist(), strict=True)]
        one, other, _ = whole(titles, titles, least)
        want = {(i, j) for i, j in zip(one.tolist(), other.tolist(), strict=True)} | {(j, i) for i, j in zip(one.tolist(), other.tolist(), strict=True)}
        assert len(parts) > 1 and len(got) == len(set(got)) and set(got) <= want
        x, y = np.array(sorted(want)).T
        scorer = fuzzy.title_scores if strips is screen.title_strips else fuzzy.sequence_scores
        similar = {(min(i, j), max(i, j)) for i, j, v in zip(x.tolist(), y.tolist(), scorer(titles, x, y, least), strict=True) if v and i != j}
        assert len(similar) > 100 and similar <= set(got)


def test_titles_of_other_letters_are_ruled_out_by_counts(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices(letters, k=7)) for _ in range(12)) for letters in ("abcdefghijk", "lmnopqrstuv") for _ in range(40)]
    x, y = np.triu_indices(len(texts), 1)
    seen, common = [], fuzzy.Strings.common
    monkeypatch.setattr(fuzzy.Strings, "common", lambda self, a, start, size: seen.append(len(a)) or common(self, a, start, size))
    got = fuzzy.title_scores(texts, x, y, 70.0)
    apart = (x < 40) & (y >= 40)
    assert apart.sum() == 1600 and not got[apart].any()
    whole, seen[:] = sum(seen), []
    fuzzy.title_scores(texts, x[~apart], y[~apart], 70.0)
    assert sum(seen) == whole  # no pair of the two kinds was looked at


def test_late_reports_revise_their_component(spark):
    rng = random.Random(9)
    words = ["alpha", "bravo", "carbon", "delta", "echo"]
    rows = [(k, " ".join(rng.choices(words, k=3)), day(rng.choice([0, 1, 2, 5, 6, 9])), 1, rng.choice("rs")) for k in range(50)]
    old, new = [r for r in rows if r[0] % 7], [r for r in rows if r[0] % 7 == 0]
    items, late = spark.createDataFrame(old, ITEM), spark.createDataFrame(new, ITEM)
    got, changed = C.recluster(items, late, C.event_clusters(items))
    assert sorted(map(tuple, got.select("region", "rep_id", "date", "corroboration").collect())) == sorted(map(tuple, C.event_clusters(items.unionByName(late)).select("region", "rep_id", "date", "corroboration").collect()))
    assert {(r[4], r[2]) for r in new} <= {(r.region, r.date) for r in changed.collect()}


def test_undated_late_reports_arrive(spark):
    rows = [(1, "Same words here", day(0), 1, "r"), (2, "Other title entirely", day(9), 1, "r"), (3, "Same words here", day(4), 1, "q"), (4, "Something without a date", None, 1, "q"), (5, "Same words there", day(2), 2, "p")]
    new = [(10, "Same words here", None, 5, "r"), (11, "A new one, undated", None, 3, "r"), (12, "Something without a date", None, 4, "q"), (13, "Same words here", day(3), 2, "q")]
    items, late = spark.createDataFrame(rows, ITEM), spark.createDataFrame(new, ITEM)
    got, _ = C.recluster(items, late, C.event_clusters(items))
    want = C.event_clusters(items.unionByName(late))
    key = ("region", "rep_id", "date", "severity", "corroboration")
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, want.select(*key).collect()))
    found = {r.rep_id: (r.severity, r.corroboration) for r in got.collect()}
    assert found[1] == (5, 2) and found[11] == (3, 1) and found[4] == (4, 2) and found[13] == (2, 2)


def test_keep_first_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *"abcdef"]), rng.choice([None, *"uvwxyz"])) for k in range(40)]
    seen, expected = [set(), set()], []
    for k, *keys in rows:
        if not any(x is not None and x in s for x, s in zip(keys, seen, strict=True)):
            expected.append(k)
            for x, s in zip(keys, seen, strict=True):
                s.add(x)
    got = C.keep_first(spark.createDataFrame(rows, "id long, p string, q string"), ["p", "q"])
    assert sorted(r.id for r in got.collect()) == expected


def test_rate_gate_equals_a_loop(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, rng.randrange(3), start + dt.timedelta(seconds=rng.randrange(9000))) for k in range(120)]
    state, expected = {}, {}
    for k, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        recent = [x for x in state.get(key, []) if x > t - dt.timedelta(seconds=3600)]
        expected[k] = len(recent) < 2
        state[key] = recent + [t] * expected[k]
    got = C.accept_rate(spark.createDataFrame(rows, "id long, k long, ts timestamp"), "k", "ts", "id", 2, 3600)
    assert {r.id: r.accepted for r in got.collect()} == expected


def _mixed_titles(rng, many):
    """Titles of one length, shorter and longer ones, near copies, cut ones, repeated words, other letters."""
    words = [w[:1].upper() + w[1:] if k % 5 == 0 else w for k, w in enumerate("navy ship coast patrol über éclair missile test drill zone border crossing strait fleet sub the of in and at".split())]
    out = []
    for k in range(many):
        t = " ".join(words[i] for i in rng.integers(len(words), size=30))[:60]
        if k % 4 == 1:
            t = out[int(rng.integers(len(out)))]
            cut = int(rng.integers(1, 25))
            t = (t[cut:] + " " + t[::-1][:cut])[:60] if k % 8 == 1 else (t[::-1][:cut] + t)[:60]
        if k % 9 == 0:
            t = t[: int(rng.integers(1, 60))]
        if k % 31 == 0:
            t = t + " " + t[:50] + " " + t  # over two words of a lane
        if k % 11 == 0:
            t = " ".join(t.split()[:3] * 3)
        out.append(t.ljust(60, "x") if k % 9 and len(t) < 60 and k % 11 else t)
    return list(dict.fromkeys(t for t in out if t.strip()))


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(17)
    titles = _mixed_titles(rng, 420)
    xs, ys = titles[: len(titles) // 2], titles[len(titles) // 2 :]
    i, j = np.divmod(np.arange(len(xs) * len(ys)), len(ys))
    for scorer, bounds, leasts in ((fuzzy.title_scores, screen.title_candidates, (55.0, 70.0, 85.0)), (fuzzy.sequence_scores, screen.sequence_candidates, (70.0,))):
        for least in leasts:
            want = scorer(titles, i, j + len(xs), least)
            a, b, kinds = bounds(xs, ys, least)
            got = np.zeros(len(want))
            extra = {"kinds": kinds} if scorer is fuzzy.title_scores else {}
            got[a * len(ys) + b] = scorer(titles, a, b + len(xs), least, **extra)
            assert (want > 0).sum() > 100 and np.array_equal(got, want), (scorer, least, np.flatnonzero(got != want)[:5])
            assert len(a) < 0.9 * len(want)


def test_screened_blocks_give_the_plain_pairs(spark, monkeypatch):
    rng = np.random.default_rng(23)
    titles = _mixed_titles(rng, 130) * 3  # each three times
    rows = [(k, t, "r", 2) for k, t in enumerate(titles)]
    sides = [(k, t, "r", k % 2) for k, t in enumerate(titles)]
    for data in (rows, sides):
        given = spark.createDataFrame(data, "id long, t string, region string, part int")
        got = {}
        for least_side, block in ((10**9, 1024), (8, 4096), (8, 100)):
            monkeypatch.setattr(fuzzy, "SCREENED", least_side)
            monkeypatch.setattr(fuzzy, "PAIRS", 1 << 20 if least_side > 8 else 1 << 12)
            # workers import the module anew, so the tasks' function is run here
            run = fuzzy._scored(["region"], fuzzy.title_scores, 70.0)
            dealt = []
            monkeypatch.setattr(type(given), "mapInArrow", lambda df, f, schema: dealt.append(df) or df)
            fuzzy.block_join(given, ["region"], block=block)
            monkeypatch.undo()
            monkeypatch.setattr(fuzzy, "SCREENED", least_side)
            monkeypatch.setattr(fuzzy, "PAIRS", 1 << 20 if least_side > 8 else 1 << 12)
            batches = dealt[0].coalesce(1).sortWithinPartitions("region", "i", "j", "part").toArrow().to_batches()
            found = [(x["a"], x["b"], x["similarity"]) for out in run(iter(batches)) for x in out.to_pylist()]
            assert len(found) == len(set(found))
            got[least_side, block] = sorted(found)
            monkeypatch.undo()
        assert len(got[10**9, 1024]) > 1000
        assert got[8, 4096] == got[10**9, 1024] and got[8, 100] == got[10**9, 1024]
