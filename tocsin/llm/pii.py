"""Personal data: base patterns, and a boosted-tree model over high-recall candidates.

Everything on the data is a DataFrame or SQL function: no Python code runs on rows.

Base spans.  Four patterns (email, ip, card, phone), leftmost and non-overlapping
per kind, then their checks (octets, Luhn, number of digits).  The patterns below
are possessive or anchored forms that match the same spans without backtracking
over long runs.

Model.  Two generators propose every string that looks at all like an address or
a grouped number; these overlap the base spans and each other.  A candidate is
known by small counts and flags of its format and of the words before it.  As the
features are small, all candidates of all documents aggregate into a table of at
most some thousand rows; the trees are boosted on that table.

What it learns from.  No spans are labelled, and the base patterns need no model, so
the positives are base spans in disguise: every base span of the documents is
rewritten where it stands (``(at)``, ``[dot]``, a phone number without its plus, other
separators), so its own form can't give it away, and is looked for again.  The
candidates of the documents off their base spans are unlabelled: most are no personal
data, so they count as negatives, but some may be just what is looked for, so each
counts ``UNLABELLED`` at most, and all of them half of the positives.  ``SYNTHETIC``
sentences with numbers and addresses of either kind (dates, prices, versions, codes;
local phone numbers, spelled-out addresses) are added, so that a small corpus can fit
too.  Three quarters of the rows (by hash) fit the trees; on the rest, scores are
calibrated per generator, and a candidate off the base spans is added where the
calibrated share of positives reaches ``MIN_PRECISION``.

Defined cases: null or empty text: no spans.  Rows are kept one for one, ids
repeated or null included; all columns stay, whatever their names.  Positions are code
points from 0, end exclusive.  Without candidates nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.common import free_name

KINDS = ("email", "ip", "card", "phone")
#: Fixed by contract; see the module's docstring for the forms.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.') AND digits", "card": "digits", "phone": "contains(text, '+') AND digits"}
GENERATORS = {
    "address": r"[A-Za-z0-9._%+-]++(?:\x20?@{1,2}+\x20?|\x20?[(\[{<]\x20?(?i:at)\x20?[)\]}>]\x20?|\x20AT\x20)[A-Za-z0-9-]++(?:(?:[.,]|\x20?[(\[{<]\x20?(?i:dot)\x20?[)\]}>]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "spelled": r"[A-Za-z0-9._%+-]++\x20(?i:at)\x20[A-Za-z0-9-]++(?:(?:\x20(?i:dot)\x20|\.)[A-Za-z0-9-]++)++",
    "number": r"\+?\(?[0-9](?:[\x20().:/\[\]-]{0,3}+[0-9]){4}+(?:[\x20().:/\[\]-]{0,3}+[0-9])*+",
}
GENERATOR_NEEDS = {"address": "contains(text, '@') OR contains(text, ' AT ') OR text RLIKE '(?i)[(\\\\[{<] ?at ?[)\\\\]}>]'", "spelled": "text RLIKE '(?i) at [A-Za-z0-9-]+( dot |[.][A-Za-z0-9-])'", "number": "digits"}
#: The generator of numbers, the last; those before it are of addresses.
NUMBER = len(GENERATORS) - 1
CONTEXT = "mail|contact|call|tel|phone|fax|mobile|card|visa|credit|ip|host|server|address"
FEATURES = ("form", "n_digits", "n_marks", "n_groups", "octets", "luhn", "dated", "brackets", "context", "edge_left", "edge_right")
ROUNDS, SHRINK, DEPTH, MIN_PRECISION, MIN_SUPPORT, SYNTHETIC, UNLABELLED = 24, 0.5, 3, 0.9, 20, 3000, 0.1
SPAN = "array<struct<kind:string,start:int,end:int,s:string>>"


def _found(column: str, kind: str) -> str:
    """SQL: spans of the matches m_<column>, from what lies between them (p_<column>)."""
    return f"""aggregate(arrays_zip(p_{column}, m_{column}), named_struct('at', 0, 'out', cast(array() AS {SPAN})),
      (acc, x) -> named_struct(
        'at', acc.at + length(x.p_{column}) + coalesce(length(x.m_{column}), 0),
        'out', if(x.m_{column} IS NULL, acc.out, concat(acc.out, array(named_struct('kind', '{kind}', 'start', acc.at + length(x.p_{column}), 'end', acc.at + length(x.p_{column}) + length(x.m_{column}), 's', x.m_{column}))))),
      acc -> acc.out)"""


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(s: str) -> str:
    d = f"reverse({_digits(s)})"
    doubled = f"transform(sequence(1, length({d})), i -> cast(substr({d}, i, 1) AS int) * if(i % 2 = 0, 2, 1))"
    return f"(length({_digits(s)}) BETWEEN 13 AND 19 AND aggregate({doubled}, 0, (t, v) -> t + if(v > 9, v - 9, v)) % 10 = 0)"


def _octets(s: str) -> str:
    return f"forall(split({s}, '[.]'), o -> coalesce(try_cast(o AS int) <= 255, false))"


CHECKS = {"email": "true", "ip": _octets("c.s"), "card": _luhn("c.s"), "phone": f"length({_digits('c.s')}) BETWEEN 9 AND 15"}


def _matches(df: DataFrame, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """df with m_<name> (matches) and p_<name> (what lies between); both empty where a cheap test rules matches out."""
    none = F.expr("cast(array() AS array<string>)")
    out = {}
    for name, pattern in patterns.items():
        may = F.expr(needs[name])
        out[f"m_{name}"] = F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        out[f"p_{name}"] = F.when(may, F.split("text", pattern, -1)).otherwise(none)
    return df.withColumns(out)


def _with_digits(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digits", F.col("text").rlike("[0-9]"))


def _with_base(docs: DataFrame) -> DataFrame:
    """docs with text (never null) and base: all checked base spans, by kind as listed and start."""
    flagged = _with_digits(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    spans = _matches(flagged, BASE, NEEDS).withColumns({f"b_{k}": F.expr(_found(k, k)) for k in KINDS})
    checked = [f"filter(b_{k}, c -> {CHECKS[k]})" for k in KINDS]
    spans = spans.withColumn("base", F.expr(f"concat({', '.join(checked)})"))
    return spans.drop(*[f"{x}_{k}" for x in "mpb" for k in KINDS])


def _features(c: str) -> dict[str, str]:
    """SQL of a candidate's features; each has few values."""
    digits = f"length({_digits(f'{c}.s')})"
    plain = f"regexp_replace(if({c}.s LIKE '%.%', {c}.s, replace({c}.s, '-', '.')), '[^0-9.]', '')"
    before = f"substring(text, greatest({c}.start - 15, 1), least({c}.start, 16))"
    return {
        "form": f"{c}.form",
        "n_digits": f"least(CASE WHEN {digits} < 7 THEN 0 WHEN {digits} < 9 THEN 1 WHEN {digits} < 13 THEN 2 WHEN {digits} < 16 THEN 3 WHEN {digits} = 16 THEN 4 WHEN {digits} < 20 THEN 5 ELSE 6 END, 6)",
        "n_marks": f"least(length(regexp_replace({c}.s, '[A-Za-z0-9]', '')), 5)",
        "n_groups": f"least(size(regexp_extract_all({c}.s, '[0-9]+', 0)), 6)",
        "octets": f"cast({plain} RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' AND {_octets(plain)} AS int)",
        "luhn": f"cast({_luhn(f'{c}.s')} AS int)",
        "dated": f"cast({c}.s RLIKE '(^|[^0-9])(19|20)[0-9]{{2}}([^0-9]|$)|^[0-9]{{1,2}}[.:/][0-9]{{1,2}}[.:/][0-9]{{2,4}}$' AS int)",
        "brackets": f"cast({c}.s RLIKE '[(\\\\[]' AS int)",
        "context": f"cast(lower({before}) RLIKE '{CONTEXT}' AS int)",
        "edge_left": f"cast({c}.start > 0 AND substring(text, {c}.start, 1) RLIKE '[A-Za-z0-9]' AS int)",
        "edge_right": f"cast(substring(text, {c}.end + 1, 1) RLIKE '[A-Za-z0-9]' AS int)",
    }


def _proposed(df: DataFrame) -> DataFrame:
    """df with proposed: every span of the generators, with its form."""
    spans = _matches(df, GENERATORS, GENERATOR_NEEDS).withColumns({f"g_{k}": F.expr(_found(k, k)) for k in GENERATORS})
    parts = [f"transform(g_{name}, c -> named_struct('form', {form}, 'start', c.start, 'end', c.end, 's', c.s))" for form, name in enumerate(GENERATORS)]
    return spans.withColumn("proposed", F.expr(f"concat({', '.join(parts)})")).drop(*[f"{x}_{k}" for x in "mpg" for k in GENERATORS])


HIT = "exists(base, b -> b.start < c.end AND c.start < b.end)"


class Forest:
    """Trees of depth two on the aggregated table, and the score above which each form is redacted."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, float, int]]):
        """rows: (features, fold, candidates, positives); fold 0 calibrates."""
        fit = [(x, n, p) for x, fold, n, p in rows if fold]
        n, p = sum(r[1] for r in fit), sum(r[2] for r in fit)
        self.start = math.log((p + 1) / (n - p + 1))
        self.trees: list[tuple] = []
        margins = [self.start] * len(fit)
        for _ in range(ROUNDS if fit else 0):
            g, h = [], []
            for (_, count, pos), m in zip(fit, margins, strict=True):
                q = 1 / (1 + math.exp(-m))
                g.append(pos - count * q)
                h.append(count * q * (1 - q))
            tree = self._grow([x for x, _, _ in fit], g, h, list(range(len(fit))), DEPTH)
            self.trees.append(tree)
            margins = [m + self._leaf(tree, x) for (x, _, _), m in zip(fit, margins, strict=True)]
        self.limits = self._calibrate(rows)

    @staticmethod
    def _grow(x, g, h, rows, depth):
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        for f in range(len(FEATURES)) if depth else ():
            by_value: dict[int, list[float]] = {}
            for i in rows:
                cell = by_value.setdefault(x[i][f], [0.0, 0.0])
                cell[0] += g[i]
                cell[1] += h[i]
            lg = lh = 0.0
            for cut in sorted(by_value)[:-1]:
                lg, lh = lg + by_value[cut][0], lh + by_value[cut][1]
                gain = lg * lg / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, cut)
        if best is None:
            return SHRINK * total_g / (total_h + 1)
        _, f, cut = best
        return f, cut, Forest._grow(x, g, h, [i for i in rows if x[i][f] <= cut], depth - 1), Forest._grow(x, g, h, [i for i in rows if x[i][f] > cut], depth - 1)

    @staticmethod
    def _leaf(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, x: tuple[int, ...]) -> float:
        return self.start + sum(self._leaf(t, x) for t in self.trees)

    def _calibrate(self, rows) -> list[float]:
        """For each form the least score at which held-out candidates from there on are positive often enough."""
        limits = []
        for form in range(len(GENERATORS)):
            scored = sorted(((self.margin(x), n, p) for x, fold, n, p in rows if fold == 0 and x[0] == form), reverse=True)
            limit, seen, good = math.inf, 0, 0
            for m, n, p in scored:
                seen, good = seen + n, good + p
                if seen >= MIN_SUPPORT and good >= MIN_PRECISION * seen:
                    limit = m - 1e-9
            limits.append(limit)
        return limits

    def _sql(self, tree, c: str) -> str:
        if not isinstance(tree, tuple):
            return f"{tree:.12g}D"
        return f"if({c}.{FEATURES[tree[0]]} <= {tree[1]}, {self._sql(tree[2], c)}, {self._sql(tree[3], c)})"

    def chosen(self, c: str) -> str:
        """SQL: whether the model redacts a candidate."""
        known = [(k, x) for k, x in enumerate(self.limits) if x < math.inf]
        if not known:
            return "false"
        limit = f"CASE {c}.form " + " ".join(f"WHEN {k} THEN {x:.12g}D" for k, x in known) + " END"
        margin = " + ".join([f"{self.start:.12g}D", *(self._sql(t, c) for t in self.trees)])
        return f"coalesce({margin} >= {limit}, false)"


#: Sentences to learn from beside the documents: (what stands before, the string in SQL, whether it is personal). # is a digit.
EXAMPLES = (
    ("write to ", "ann### (at) example (dot) org", True),
    ("or ", "first.last[at]mail##[dot]example[dot]com", True),
    ("mail: ", "box-## (at) host.example.net", True),
    ("mail ", "dr.who##{at}site#{dot}org", True),
    ("via ", "lee## <AT> corp.example.com", True),
    ("or by ", "pat## @ web#.example.org", True),
    ("to ", "ada## AT lab.example.edu", True),
    ("is ", "max##@@news.example.com", True),
    ("ask ", "eve##@shop,example,com", True),
    ("to ", "joe## at firm dot com", True),
    ("by ", "sue at uni## dot example dot edu", True),
    ("look ", "prices at example##.com", False),
    ("sold ", "shares at market.example", False),
    ("ends ", "meeting at noon.Then", False),
    ("see ", "offices at 4#.main", False),
    ("call ", "(###) ###-####", True),
    ("from ", "(###) ### ####", True),
    ("phone: ", "###.###.####", True),
    ("tel ", "0##/#######", True),
    ("then ", "0049 ## #######", True),
    ("fax ", "00## (#) ## ### ####", True),
    ("reach me under ", "1 (###) ###-####", True),
    ("host ", "1#[.]2#[.]3#[.]#", True),
    ("server ", "1##(.)##(.)1##(.)##", True),
    ("host ", "1##-2#-1#-1##", True),
    ("server ", "10 . # . ## . 1#", True),
    ("ssn ", "###-##-####", False),
    ("years ", "20##-20## 20##-20##", False),
    ("card ", "9### #### #### ####", False),
    ("between ", "19##-20##", False),
    ("on ", "20##-01-1#", False),
    ("at ", "20##-10-2# 1#:2#:3#", False),
    ("of ", "1#.0#.20##", False),
    ("from ", "19##-19##", False),
    ("until ", "1#:##:##", False),
    ("version ", "#.#.#.#.#", False),
    ("build ", "9##.3##.#.#", False),
    ("costs ", "#.###.###", False),
    ("about ", "## ### ###", False),
    ("order ", "########", False),
    ("code ", "ab#####cd", False),
    ("key ", "f##########e", False),
    ("near ", "4#.####/2.####", False),
    ("isbn ", "978-#-##-######-#", False),
    ("table ", "##### ##### #####", False),
    ("page ", "###/####", False),
    ("call at ", "20##-0#-1#", False),
    ("card of ", "1#/##/20##", False),
)


def _synthetic(spark: SparkSession) -> DataFrame:
    """text and base (the personal span, if it is one) of SYNTHETIC sentences; every # becomes a digit from a hash."""
    known = spark.createDataFrame(EXAMPLES, "before string, form string, personal boolean").withColumn("kind", F.monotonically_increasing_id())
    rows = known.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(SYNTHETIC // len(EXAMPLES)))))
    spelled = "array_join(transform(split(form, ''), (x, i) -> if(x = '#', cast(pmod(xxhash64(form, turn, i), 10) AS string), x)), '')"
    rows = rows.withColumn("s", F.expr(spelled)).withColumn("lead", F.expr("if(pmod(turn, 3) = 0, 'and ', before)"))
    span = f"if(personal, array(named_struct('kind', 'known', 'start', length(lead), 'end', length(lead) + length(s), 's', s)), cast(array() AS {SPAN}))"
    return rows.select(F.expr("concat(lead, s, if(pmod(turn, 2) = 0, '.', ' today'))").alias("text"), F.expr(span).alias("base"))


def _disguised(spans: DataFrame) -> DataFrame:
    """The texts that have base spans, with every span rewritten in a form that the base patterns don't have, and where that stands."""
    pick = "element_at(array({}), 1 + pmod(hash(c.s, c.start), 3))"
    at, dot = pick.format("' (at) ', '[at]', '(at)'"), pick.format("'.', '[dot]', ' (dot) '")
    forms = {
        "email": f"concat(substring_index(c.s, '@', 1), {at}, replace(substring_index(c.s, '@', -1), '.', {dot}))",
        "ip": "replace(c.s, '.', " + pick.format("'[.]', '(.)', ' . '") + ")",
        "card": f"regexp_replace({_digits('c.s')}, '([0-9]{{4}})(?=[0-9])', " + pick.format("'$1.', '$1/', '$1--'") + ")",
        "phone": pick.format("substr(c.s, 2), concat('00', substr(c.s, 2)), regexp_replace(substr(c.s, 2), '[^0-9]+', '.')"),
    }
    new = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.items()) + " END"
    ordered = f"transform(array_sort(transform(base, c -> named_struct('start', c.start, 'end', c.end, 'new', {new}))), c -> c)"
    built = f"""aggregate({ordered}, named_struct('at', 0, 'out', cast('' AS string), 'base', cast(array() AS {SPAN})),
      (acc, c) -> if(c.start >= acc.at,
        named_struct('at', c.end, 'out', concat(acc.out, substring(text, acc.at + 1, c.start - acc.at), c.new),
          'base', concat(acc.base, array(named_struct('kind', 'known', 'start', length(acc.out) + c.start - acc.at, 'end', length(acc.out) + c.start - acc.at + length(c.new), 's', c.new)))),
        acc),
      acc -> named_struct('text', concat(acc.out, substring(text, acc.at + 1, length(text))), 'base', acc.base))"""
    return spans.where("size(base) > 0").select(F.expr(built).alias("x")).select("x.text", "x.base")


def _counts(spans: DataFrame, wanted: str) -> DataFrame:
    """Candidates (a row each, so that features are plain columns) by fold and features, with those that cover a known span."""
    rows = _proposed(spans).select("text", "base", F.explode_outer("proposed").alias("c")).where("c IS NOT NULL").withColumn("hit", F.expr(HIT)).where(wanted)
    rows = rows.select(F.expr("cast(pmod(xxhash64(text), 4) > 0 AS int)").alias("fold"), "hit", *[F.expr(v).alias(k) for k, v in _features("c").items()])
    return rows.groupBy("fold", *FEATURES).agg(F.count("*").alias("n"), F.count_if("hit").alias("p"))


def train(docs: DataFrame) -> Forest:
    """Counts over the candidates of all documents, then the trees. The table has at most some thousand rows."""
    real = _with_base(docs.select("text")).select("text", "base")
    seen = _with_digits(real)
    known = _with_digits(_disguised(real))
    made = _with_digits(_synthetic(docs.sparkSession))
    labelled = _counts(known, "hit").unionByName(_counts(made, "true")).withColumn("u", F.lit(0).cast("long"))
    table = labelled.unionByName(_counts(seen, "NOT hit").withColumn("u", F.col("n")).withColumn("n", F.lit(0).cast("long")))
    table = table.groupBy("fold", *FEATURES).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("u").alias("u"))
    rows = table.orderBy("fold", *FEATURES).collect()  # a row for each combination of features that occurs
    share = min(UNLABELLED, 0.5 * sum(r.p for r in rows) / max(1, sum(r.u for r in rows)))
    return Forest([(tuple(r[f] for f in FEATURES), r.fold, r.n + share * r.u, r.p) for r in rows])


def _spans(slim: DataFrame, forest: Forest) -> DataFrame:
    """slim (with text) with base, added and spans (base and added), each sorted by kind as listed, then start."""
    named = f"CASE WHEN c.form < {NUMBER} THEN 'email' WHEN c.octets = 1 THEN 'ip' WHEN c.luhn = 1 THEN 'card' ELSE 'phone' END"
    featured = f"transform(filter(proposed, c -> NOT {HIT}), c -> named_struct('start', c.start, 'end', c.end, 's', c.s, {', '.join(f"'{k}', {v}" for k, v in _features('c').items())}))"
    out = _proposed(_with_base(slim)).withColumn("picked", F.expr(f"transform(filter({featured}, c -> {forest.chosen('c')}), c -> named_struct('kind', {named}, 'start', c.start, 'end', c.end, 's', c.s, 'form', c.form))"))
    single = f"filter(picked, c -> c.form = 0 OR NOT exists(picked, d -> d.form < c.form AND d.start < c.end AND c.start < d.end))"
    added = f"transform({single}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 's', c.s))"
    order = "CASE {0}.kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 ELSE 3 END"
    keyed = "transform(concat(base, added), c -> named_struct('k', " + order.format("c") + ", 'start', c.start, 'end', c.end, 'kind', c.kind, 's', c.s))"
    out = out.withColumn("added", F.expr(added)).withColumn("spans", F.expr(f"transform(array_sort({keyed}), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 's', c.s))"))
    return out.drop("proposed", "picked", "digits")


def _apart(docs: DataFrame) -> DataFrame:
    """The rows' own columns in one, so that none of them meets a name in use here; and text."""
    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))


def with_spans(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with base, added and spans; an added column whose name is taken gets an underscore."""
    out = _spans(_apart(docs), forest or train(docs))
    return out.select("row.*", *[F.col(c).alias(free_name(c, docs.columns)) for c in ("base", "added", "spans")])


def _joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, sha256 of the base spans, all spans, and how many the model added."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base, c -> c.kind = '{k}')) AS long)") for k in KINDS}
    return with_spans(slim).select("doc_id", *[v.alias(k) for k, v in counts.items()], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.expr("cast(size(added) AS long)").alias("n_added"))


def redacted(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with every span's text replaced by its kind in angle brackets; overlapping spans become one, named after the first.

    All columns stay as they are; a null text stays null.
    """
    found = _spans(_apart(docs), forest or train(docs))
    ordered = "array_sort(transform(spans, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind)))"
    built = f"""aggregate({ordered}, named_struct('at', 0, 'out', cast('' AS string)),
      (acc, c) -> if(c.start >= acc.at,
        named_struct('at', c.end, 'out', concat(acc.out, substring(text, acc.at + 1, c.start - acc.at), '<', upper(c.kind), '>')),
        named_struct('at', greatest(acc.at, c.end), 'out', acc.out)),
      acc -> concat(acc.out, substring(text, acc.at + 1, length(text))))"""
    clean = F.when(F.size("spans") > 0, F.expr(built)).otherwise(F.col("row")["text"].cast("string"))
    return found.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
