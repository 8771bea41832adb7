"""Line dedup: of a line that several documents hold, only the smallest document keeps its occurrences.

Only hashes travel: 128 bits of each line's key are range-partitioned with a secondary sort by document and position, first
occurrences are streamed off, and per document a sparse bitmap of the lines to drop comes back. The text itself moves once,
to meet its bitmap. A key in a third of all documents is dealt over `SALTS` ranges: each range settles all but its own first
document, and what is left (at most SALTS documents a key) is settled in a second pass.

Defined cases: null and empty texts are one empty line; rows that share a doc_id are one document (null doc_id too, and it
sorts last); repeated rows get equal results; an empty table gives an empty result; texts of any length are split whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import BLANKS, fresh, lower_ascii, read

SALTS = 16


def line_key(line: Column) -> Column:
    """What is compared of a line: blanks stripped at both ends, A-Z lower-cased."""
    return F.btrim(lower_ascii(line), F.lit(BLANKS))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(id, row, pos) of each line to drop. docs: id, row (a hash of the row's text), text."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.select("id", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashes = lines.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("i"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "id", "row", "pos")
    last = F.col("id").isNull()
    # Level 1: ranges of (hash, salt); inside, rows stream by document and position.
    ranged = hashes.repartitionByRange(n, "h", "i", "salt").withColumn("last", last)
    stream = Window.partitionBy("h", "i", "salt").orderBy("last", "id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("head", F.struct(F.first("last").over(stream).alias("l"), F.first("id").over(stream).alias("d")))
    own = F.struct(F.col("last").alias("l"), F.col("id").alias("d"))
    settled = seen.withColumn("later", ~own.eqNullSafe(F.col("head"))).drop("head")
    # Level 2: only the first document of each range is still open; one hash has SALTS of them at most.
    open_ = settled.where("not later")
    across = Window.partitionBy("h", "i").orderBy("last", "id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = open_.withColumn("head", F.struct(F.first("last").over(across).alias("l"), F.first("id").over(across).alias("d")))
    rest = rest.withColumn("later", ~own.eqNullSafe(F.col("head")))
    return settled.where("later").select("id", "row", "pos").unionByName(rest.where("later").select("id", "row", "pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per (id, row): bits, a map from pos / 64 to 64 bits, with only the words that have a bit set; n_dropped."""
    words = dropped.groupBy("id", "row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """docs' columns (text without the dropped lines) behind which n_lines, n_dropped and bits (sparse drop bitmap) follow as a struct `line_dedup` (`_line_dedup` if docs has that name)."""
    work = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in docs.columns if c not in (doc_id, text)]).alias("own") if len(docs.columns) > 2 else F.lit(1).alias("own"), F.col(text).isNull().alias("was_null"))
    bits = drop_bitmaps(dropped_lines(work.select("id", "row", "text"), min_chars)).withColumnsRenamed({"id": "b_id", "row": "b_row"})
    j = work.join(bits, work["id"].eqNullSafe(bits["b_id"]) & (work["row"] == bits["b_row"]), "left")
    split = F.split("text", "\n", -1)
    kept = F.expr("filter(split(text, '\\n', -1), (x, i) -> (shiftright(coalesce(try_element_at(bits, cast(floor(i / 64) as int)), 0L), i % 64) & 1L) = 0L)")
    new = F.when(F.col("bits").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    info = F.struct(F.size(split).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.col("bits"))
    back = [F.col("id").alias(c) if c == doc_id else F.when(F.col("was_null") & F.col("bits").isNull(), F.lit(None).cast("string")).otherwise(new).alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns]
    return j.select(*back, info.alias(fresh(docs, "line_dedup")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents)),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY rid
"""
