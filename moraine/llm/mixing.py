"""Mixing sources to target weights.

Tokens are summed per source, targets follow from weights (no source above `max_repeat` times its size, the excess shared
out again), and each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy, rate = target / size of its
source. Two passes over the documents, no shuffle of texts: only one row per source is exchanged.

Defined cases: a null text has size 0; null is a source of its own and sorts last; rows that share a doc_id (null too) but not a
text draw numbers of their own by their text and place, repeated rows too, so that each source comes near its target whatever its ids
are (reruns agree if rows are read in the same order); an empty table gives an empty result; a source without words has target 0 and is not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import cut, fresh, n_words, read

#: A table of so many sources still counts as small enough to broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 100_000
#: Columns that a plan adds.
PLAN = ("size", "source_size", "target", "copies")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source_size and target.

    Sources by code point, null last, take `weights` in turn. Their targets add up to all tokens. The level that the weights
    are multiplied by is found by filling: sources in order of the level at which they reach `max_repeat` times their size;
    each one that the remaining tokens would lift above it stays there.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size")).withColumn("w", w.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col(source).asc_nulls_last())
    after, every = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("rest").cast("double") / F.sum("w").over(after)).withColumn("k", F.row_number().over(order))
    s = s.withColumn("full", F.col("level") >= F.col("cap").cast("double") / F.col("w"))
    first = F.min(F.when(~F.col("full"), F.col("k"))).over(every)
    s = s.withColumn("first", first).withColumn("at", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(every))
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first")), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("w"))
    return s.select(source, "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int, text: Column | None = None, number: Column | None = None) -> Column:
    """A number in [0, 1) that depends on doc_id and seed, and on text and number if they are given: the first 52 bits of an MD5."""
    more = [F.lit(":"), F.md5(F.coalesce(text, F.lit("")))] if text is not None else []
    more += [F.lit(":"), number.cast("string")] if number is not None else []
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), *more)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document) as further columns, in place of docs' own of these names."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in PLAN])
    sized = docs.withColumn("size", n_words(F.col(text)))
    key = fresh(sized, "mix_source")
    targets = cut(source_targets(sized.select(F.col(source).alias(key), "size"), key, "size", weights, max_repeat))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    out = sized.join(targets, sized[source].eqNullSafe(targets[key]), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Rows draw by their id. Ids that several rows have, if there are any, do not tell them apart: these rows draw by their text
    # and by where they are read as well.
    ids = cut(docs.groupBy(F.col(doc_id).alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared"))
    own = draw(F.col(doc_id), seed)
    if not ids.isEmpty():
        name, row = fresh(out, "mix_shared"), fresh(out, "mix_row")
        ids = ids.select(F.col("shared").alias(name), F.lit(True).alias(row))
        out = out.join(F.broadcast(ids) if ids.count() <= BROADCAST_SOURCES else ids, out[doc_id].eqNullSafe(ids[name]), "left")
        own = F.when(F.col(row), draw(F.col(doc_id), seed, F.col(text), F.monotonically_increasing_id())).otherwise(own)
    extra = (own < rate - F.floor(rate)).cast("long")
    return out.withColumn("copies", F.floor(rate) + extra).select(*sized.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' own rows and columns, each row as often as the mix takes it."""
    lost = [c for c in docs.columns if c.lower() in PLAN]
    if lost:  # columns of docs that share a name with one of the plan
        apart = {c: fresh(docs, f"own_{i}") for i, c in enumerate(lost)}
        return mix(docs.withColumnsRenamed(apart), **options).withColumnsRenamed({v: k for k, v in apart.items()}).select(*docs.columns)
    plan, n = mix_plan(docs, **options), fresh(docs, "copy_no")
    return plan.where("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mix_plan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, row_number() OVER o AS k, ((SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST)),
g AS (SELECT min(k) AS k FROM f WHERE level < 3 * source_size / w::DOUBLE),
t AS (SELECT source, source_size, CASE WHEN g.k IS NULL OR f.k < g.k THEN (3 * source_size)::DOUBLE ELSE (SELECT level FROM f AS x WHERE x.k = g.k) * w END AS target FROM f, g),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken, source, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies FROM r
"""
