"""Text, date and dictionary functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tocsin.functions import dims

BLANK = r"[\t-\r \x1c-\x1f\x85\p{Z}]+"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out a single time however often it is named."""
    return F.transform(F.array(value), then)[0]


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def clean_html(text: Column) -> Column:
    """Tags become a space; null becomes empty."""
    return F.regexp_replace(_text(text), "<[^>]+>", " ")


def flat(text: Column) -> Column:
    """Runs of white space are one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def extract_brief(text: Column, size: int = 280) -> Column:
    """Of the first two sentences those of over 20 characters, cut to size; else the text cut to size.

    Sentences end in '. ', or in '! ' if neither of the first two parts is long enough.
    """

    def brief(whole: Column) -> Column:
        def first(mark: str) -> Column:
            two = F.transform(F.slice(F.split(whole, "[" + mark[0] + "] "), 1, 2), lambda s: F.trim(s))
            return F.array_join(F.filter(two, lambda s: F.length(s) > 20), mark)

        return F.substring(F.coalesce(F.nullif(first(". "), F.lit("")), F.nullif(first("! "), F.lit("")), whole), 1, size)

    return _once(flat(clean_html(text)), brief)


def content_hash(title: Column, url: Column) -> Column:
    """sha256 of url, a bar and the first 100 characters of the title; nulls are empty."""
    return F.sha2(F.concat(_text(url), F.lit("|"), F.substring(_text(title), 1, 100)), 256)


def lenient_date(value: Column) -> Column:
    """The first ten characters as an ISO date, else null."""
    return F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")


def dates_close(a: Column, b: Column) -> Column:
    """At most a day apart; a missing date is close to any."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= 1, F.lit(True))


@lru_cache(maxsize=32)
def _automaton(keys: tuple[str, ...]):
    """All keys as one automaton: a text is gone through once, however many there are."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, key in enumerate(keys):
        if key not in out:  # the first of equal ones
            out.add_word(key, n)
    out.make_automaton()
    return out


def _in_parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[str | None]:
    """The texts one after the other; of a batch, about so many bytes are Python strings at once (or one longer text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield from texts.slice(at, end - at).to_pylist()
        at = end


def _first_key(keys: tuple[str, ...]):
    @F.arrow_udf(IntegerType())
    def first(texts: pa.Array) -> pa.Array:
        find = _automaton(keys).iter
        return pa.array([min((n for _, n in find(t)), default=None) if t else None for t in _in_parts(texts)], pa.int32())

    return first


def _all_keys(keys: tuple[str, ...]):
    @F.arrow_udf(ArrayType(IntegerType()))
    def found(texts: pa.Array) -> pa.Array:
        find = _automaton(keys).iter
        return pa.array([sorted({n for _, n in find(t)}) if t else [] for t in _in_parts(texts)], pa.list_(pa.int32()))

    return found


def _first_contained(text: Column, pairs: list[tuple[str, object]]) -> Column:
    """The value of the first pair whose key the text contains, else null. (In no lambda: the search runs on Arrow batches.)"""
    keys = tuple(dict.fromkeys(k for k, _ in pairs))
    value = dict(reversed(pairs))
    return F.get(F.array(*[F.lit(value[k]) for k in keys]), _first_key(keys)(text))


def _exact(text: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), text)


def canonicalize(value: Column) -> Column:
    """Region name (any case), else exact term, else the longest term contained, else null."""
    named = {r.lower(): r for r in dims.REGIONS}
    low = F.lower(F.trim(value))
    return F.coalesce(_exact(low, named), _exact(low, dims.TERMS), _first_contained(low, dims.terms()))


def resolve(*texts: Column) -> Column:
    """The region of the longest term in the joined texts, else null."""
    return _first_contained(F.lower(F.concat_ws(" ", *texts)), dims.terms())


def _scored(low: Column, keywords: dict[str, list[str]], least: Callable[[Column], Column]) -> Column:
    """The region with most keywords in the text, the first on ties, among those whose count passes."""
    keys = tuple(dict.fromkeys(k for words in keywords.values() for k in words))
    place = {k: n for n, k in enumerate(keys)}

    def best(found: Column) -> Column:
        among = lambda words: F.size(F.array_intersect(found, F.array(*[F.lit(place[k]) for k in words])))
        scores = [F.struct(among(words).alias("n"), F.lit(-rank).alias("rank"), F.lit(region).alias("region")) for rank, (region, words) in enumerate(keywords.items())]
        return F.array_max(F.filter(F.array(*scores), least))["region"]

    return _once(_all_keys(keys)(low), best)


def score_regions(text: Column, least: int = 2) -> Column:
    """The region with most keywords if there are at least so many."""
    return _scored(F.lower(_text(text)), dims.KEYWORDS, lambda s: s["n"] >= least)


def detect_region(text: Column) -> Column:
    """The region of the first alias in their own order, else of most keywords if there are two."""
    low = F.lower(_text(text))
    return F.coalesce(_first_contained(low, list(dims.ALIASES.items())), _scored(low, dims.KEYWORDS, lambda s: s["n"] >= 2))


def detect_loosely(text: Column) -> Column:
    """The region of most keywords of the older list, one is enough."""
    return _scored(F.lower(_text(text)), dims.LOOSE_KEYWORDS, lambda s: s["n"] >= 1)


def detect_with_hint(text: Column, hint: Column) -> Column:
    """Aliases in text and hint, else two keywords; one is enough for a region that has the hint among its keywords."""
    named = F.lower(_text(hint))
    hinted = F.array_compact(F.array(*[F.when(named.isin(*words), F.lit(region)) for region, words in dims.LOOSE_KEYWORDS.items()]))
    low = F.lower(F.concat(_text(text), F.lit(" "), _text(hint)))
    return F.coalesce(_first_contained(low, list(dims.STRICT_ALIASES.items())), _scored(low, dims.LOOSE_KEYWORDS, lambda s: (s["n"] >= 2) | ((s["n"] == 1) & F.array_contains(hinted, s["region"]))))


def detect_exercise_region(text: Column) -> Column:
    """The first region with any of its exercise keywords, else null: a report without one is to be left out."""
    return _first_contained(F.lower(_text(text)), [(k, region) for region, words in dims.EXERCISE_KEYWORDS.items() for k in words])


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs in the lower-cased text."""
    return _first_key(tuple(words))(F.lower(_text(text))).isNotNull()


def is_security(title: Column, description: Column) -> Column:
    """Whether a security stem occurs in either."""
    return any_word(F.concat(_text(title), F.lit(" "), _text(description)), dims.SECURITY_STEMS)


def gate_verdict(verdict: Column) -> Column:
    """Fail closed: only a verdict that says so lets a report in."""
    return F.coalesce(F.contains(F.upper(verdict), F.lit("SECURITY_INCIDENT")), F.lit(False))


def source_confidence(source: Column) -> Column:
    """Class of the first source name contained, else Media."""
    return F.coalesce(_first_contained(_text(source), list(dims.SOURCE_CONFIDENCE.items())), F.lit("Media"))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def exercise_dates(text: Column, today: Column) -> Column:
    """struct(start, end): 'd-d Month yyyy', 'Month d-d, yyyy', any four digits as a year, else today and two weeks on.

    Case doesn't matter. Only the first match of each form counts; if it is no date, the next form is tried.
    """
    first = rf"(?i)(\d{{1,2}})[–-](\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})"
    second = rf"(?i)({MONTHS})\s+(\d{{1,2}})[–-](\d{{1,2}})[,\s]+(\d{{4}})"

    def day(pattern: str, d: int, m: int, y: int) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)
        month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.left(part(m), F.lit(3)))) + 2) / 3
        return F.when(part(y) != "", F.try_to_date(F.concat_ws("-", part(y), F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd"))

    year = F.nullif(F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")), F.lit("0000"))
    options = [(day(first, 1, 3, 4), day(first, 2, 3, 4)), (day(second, 2, 1, 4), day(second, 3, 1, 4)), (F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd"), F.try_to_date(F.concat(year, F.lit("-12-31")), "yyyy-MM-dd"))]
    found = F.struct(today.alias("start"), F.date_add(today, 14).alias("end"))
    for start, end in reversed(options):
        found = F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))).otherwise(found)
    return found


#: Forms of a number of troops, tried in order; a number has two digits or commas at least.
TROOPS = (
    r"(\d[\d,]+)\s*(?:troops|soldiers|personnel|participants|service members)",
    r"(?:more than|over|about|approximately|some)\s*(\d[\d,]+)",
    r"(\d[\d,]+)\s*(?:NATO|allied|multinational)",
)


def troop_count(text: Column) -> Column:
    """The first number that stands as one of troops, commas dropped."""
    return F.coalesce(*[F.regexp_replace(F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")), ",", "").try_cast("long") for p in TROOPS])


def from_deaths(deaths: Column) -> Column:
    return F.when(deaths >= 25, 3).when(deaths >= 5, 2).otherwise(1)


def from_fatalities(event_type: Column, fatalities: Column) -> Column:
    """1, and more for deaths, battles and explosions, up to 5."""
    deaths = F.when(fatalities >= 10, 2).when(fatalities >= 1, 1).otherwise(0)
    fought = F.when(event_type.isin("Battles", "Explosions/Remote violence"), 2).otherwise(0)
    return F.least(F.greatest(F.lit(1) + deaths + fought, F.lit(1)), F.lit(5))


def event_category(event_type: Column) -> Column:
    """Category of a kind of conflict event, else unknown."""
    return F.coalesce(_exact(_text(event_type), dims.EVENT_CATEGORIES), F.lit("unknown"))


def bare_json(raw: Column) -> Column:
    """An answer without its code fences."""
    return F.trim(F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def verdict_json(raw: Column, schema: str) -> Column:
    """Parsed verdict without code fences; malformed text gives nulls."""
    return F.from_json(bare_json(raw), schema)


def verdict_category(category: Column) -> Column:
    """An allowed category that says something, else unknown."""
    low = F.lower(F.trim(category))
    return F.when(low.isin(*[c for c in dims.CATEGORIES if c not in ("none", "unclassifiable")]), low).otherwise("unknown")


def verdict_level(level: Column) -> Column:
    """1 to 5; missing or 0 is 2."""
    number = level.try_cast("int")
    return F.least(F.greatest(F.when(number != 0, number).otherwise(2), F.lit(1)), F.lit(5))


def rhetoric_score(score: Column) -> Column:
    return F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))


def scale_label(scale: Column) -> Column:
    return F.when(scale < 5000, "Small").when(scale < 20000, "Medium").when(scale <= 50000, "Large").when(scale > 50000, "Strategic")


def index_label(score: Column) -> Column:
    return F.when(score.isNull(), "NO DATA").when(score >= 65, "HIGH").when(score >= 45, "MODERATE").when(score >= 25, "ELEVATED").otherwise("LOW")


def bloc(lead_nation: Column) -> Column:
    """Badge of an exercise by substrings of its lead nation."""
    low = F.lower(_text(lead_nation))
    return F.when(low.contains("nato") | low.contains("shape"), "NATO").when(low.contains("russia") | low.contains("china"), "RUS/CHN").when(low.contains("sweden") | low.contains("finland"), "NATIONAL").otherwise("MULTILATERAL")


def in_bloc(lead_nation: Column) -> dict[str, Column]:
    """The three filters of the exercise list; Finland is in two of them."""
    low = F.lower(_text(lead_nation))
    nato, sweden = low.contains("nato") | low.contains("shape"), low.contains("sweden")
    return {"nato": nato, "multilateral": ~nato & ~sweden, "national": sweden | low.contains("finland")}


def rhetoric_band(score: Column, target: Column | None = None) -> Column:
    """high, medium or muted; where a target is asked for, missing or general deterrence is muted."""
    band = F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("muted")
    return band if target is None else F.when(F.coalesce(target, F.lit("")).isin("", "General deterrence"), "muted").otherwise(band)


def position(name: Column, lat: Column, lng: Column) -> Column:
    """struct(lat, lng): its own, else by the first name known, else by a word, else the middle of the map."""
    place = lambda p: F.struct(F.lit(float(p[0])).alias("lat"), F.lit(float(p[1])).alias("lng"))
    known = [(k, place(p)) for k, p in [*dims.PLACES.items(), *dims.PLACE_WORDS]]
    own = F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))
    return F.coalesce(own, _first_contained(F.upper(_text(name)), known), place(dims.DEFAULT_PLACE))


def participants(listed: Column) -> Column:
    """Names of a comma-separated list, without the blanks around them."""
    return F.transform(F.split(F.nullif(listed, F.lit("")), ","), lambda x: F.trim(x))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))
