"""Secret scans through a trigram index, in DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived that every matching text satisfies. Each document posts the
queried trigrams it holds; postings are intersected by counting, per document and conjunction, how many of its trigrams
arrived; only candidates are verified with the regex. Rules without a mandatory trigram scan every document.

Defined cases: null and empty texts have no spans; rows that share doc_id and text share candidates, so repeated rows get equal
results; a null doc_id is as good as any; an empty table gives an empty result; texts are scanned whole. Offsets count code
points, ends are exclusive; matches of one rule do not overlap, those of different rules may.
"""

from __future__ import annotations

import re._constants as k
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import bound, read


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; pattern: read alike by Java and Python; least: characters that group `group` must have, else the match is dropped; base: counts for base_sha256."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules come first, in their order. `{20,}` and `{24,}` drop the same matches as a later check of the
#: length would, as those runs cannot contain a longer one; `assign` needs the check, as a dropped match still uses up its text.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_MANY = 64
#: Hits whose places are counted from one base.
RUN = 64
Query = frozenset  # of conjunctions, each a frozenset of trigrams; the empty conjunction is always true
ALWAYS: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x, y in product(a, b))
    return both if len(both) <= _MANY else min(a, b, key=len)


def _of(strings: set[str]) -> Query:
    """What holds if one of the strings occurs."""
    if not strings or min(map(len, strings)) < 3:
        return ALWAYS
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all texts that items match, if few, in lower case; what holds besides)."""
    query, exact, whole = ALWAYS, {""}, True
    for op, arg in items:
        one, more = _item(op, arg)
        query = _and(query, more)
        joined = {a + b for a, b in product(exact, one)} if one is not None and len(exact) * len(one) <= _MANY else None
        if joined is None:
            query, whole = _and(query, _of(exact)), False
            exact = one if one is not None else {""}
        else:
            exact = joined
    return (exact, query) if whole else (None, _and(query, _of(exact)))


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is k.LITERAL:
        return {chr(arg).lower()}, ALWAYS
    if op is k.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is k.LITERAL:
                chars.add(chr(x).lower())
            elif kind is k.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALWAYS
        return (chars if len(chars) <= 8 else None), ALWAYS
    if op is k.SUBPATTERN:
        return _walk(arg[-1])
    if op is k.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in found):
            return set().union(*(e for e, _ in found)), ALWAYS
        query = frozenset().union(*(_and(q, _of(e)) if e is not None else q for e, q in found))
        return None, query if len(query) <= _MANY else ALWAYS
    if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ALWAYS
        if low == high and exact is not None and len(exact) ** low <= _MANY:
            return {"".join(x) for x in product(exact, repeat=low)}, query
        return None, _and(query, _of(exact)) if low and exact is not None else query if low else ALWAYS
    return (None, ALWAYS) if op is not k.AT else ({""}, ALWAYS)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams, one of which a text with a match satisfies; None if nothing is mandatory."""
    exact, query = _walk(parser.parse(pattern))
    query = _and(query, _of(exact)) if exact is not None else query
    least = [c for c in query if not any(d < c for d in query)]
    return None if frozenset() in least else sorted(least, key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, row, rules): the numbers of the rules that may match a document. docs: id, row, text."""
    spark = docs.sparkSession
    terms = [(i, j, t, len(c)) for i, r in enumerate(rules) for j, c in enumerate(trigram_query(r.pattern) or ()) for t in sorted(c)]
    rows = [F.struct(F.lit(i).alias("rule"), F.lit(j).alias("conjunction"), F.lit(t).alias("trigram"), F.lit(n).cast("long").alias("need")) for i, j, t, n in terms]
    query = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).selectExpr("0 AS rule", "0 AS conjunction", "'' AS trigram", "0L AS need")
    asked = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted({t for _, _, t, _ in terms})]) if terms else F.array(F.lit(None).cast("string"))
    # The Project that lower-cases must not be folded into each of the tests, so the text passes through a generator.
    low = docs.select("id", "row", F.explode(F.array(F.lower("text"))).alias("low"))
    postings = low.select("id", "row", F.explode(F.array_compact(asked)).alias("trigram")).distinct()
    met = postings.join(F.broadcast(query), "trigram").groupBy("id", "row", "rule", "conjunction").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").groupBy("id", "row").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end, name>> of a rule's matches in `text`, positions from the lengths of what lies between and before them.

    Lengths come in runs of `RUN` hits. Where a run begins is a sum over the runs before it, where a hit begins a sum within its
    run, so that a text of n hits costs n * (RUN + n / RUN) small steps and no list is copied hit by hit.
    """
    p = F.lit(rule.pattern)
    steps = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("hit"), F.regexp_extract_all("text", p, F.lit(rule.group)).alias("value"))
    # The text behind the last hit has no hit.
    lengths = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["value"]) >= rule.least).alias("good")))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["hit"], F.lit(0)))

    def spans_of(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / RUN).cast("int")), lambda i: F.slice(every, i * RUN + 1, F.lit(RUN)))

        def placed(sized: Column) -> Column:
            def part_of(x: Column, k: Column) -> Column:
                before = F.aggregate(F.slice(sized, F.lit(1), k), F.lit(0), lambda acc, y: acc + y["n"])

                def based(base: Column) -> Column:
                    def span(hit: Column, i: Column) -> Column:
                        start = base + total(F.slice(x["hits"], F.lit(1), i)) + hit["gap"]
                        return F.when(hit["good"], F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + hit["hit"]).alias("end"), F.lit(rule.kind).alias("name")))

                    return F.transform(x["hits"], span)

                return bound(before, based)

            return F.flatten(F.transform(sized, part_of))

        return bound(F.transform(parts, lambda h: F.struct(h.alias("hits"), total(h).alias("n"))), placed)

    return F.array_compact(bound(lengths, spans_of))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, spans: array of start, kind, end, name, sorted), a row for each row of docs."""
    d = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    c = candidates(d, rules).withColumnsRenamed({"id": "c_id", "row": "c_row"})
    j = d.join(c, d["id"].eqNullSafe(c["c_id"]) & (d["row"] == c["c_row"]), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    found = []
    for i, r in enumerate(rules):
        may = F.regexp_like("text", F.lit(r.pattern))
        if trigram_query(r.pattern) is not None:
            may = F.coalesce(F.array_contains("rules", i), F.lit(False)) & may
        found.append(F.when(may, _spans(r, i)).otherwise(none))
    return j.select(F.col("id").alias("doc_id"), "text", F.array_sort(F.flatten(F.array(*found))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_base = sum(r.base for r in RULES)

    def number(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")

    count = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base]
    base = F.sha2(_listed(F.filter("spans", lambda x: x["kind"] < n_base)), 256)
    return d.select("doc_id", *count, base.alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _rule_sql(r: Rule, i: int) -> str:
    p = "'" + r.pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {i} AS kind, '{r.kind}' AS name, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n
  FROM (SELECT rid, m, g, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS v, string_split_regex(text, {p}) AS g FROM d)) WHERE length(v[i]) >= {r.least}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
  string_agg(name || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, kind) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""
