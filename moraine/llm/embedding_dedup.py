"""Embedding near-dedup with spherical-cap filters.

Directions come from `CODES` random product codes: a vector is turned by a fixed random rotation and cut in two, each half is
compared with a codebook, and a filter is one codeword of each half. A vector goes to every filter whose direction it exceeds
a threshold with, found by list decoding: codewords of the first half that the best one of the second could lift over the
threshold, then all partners that do. Several codes even out how many filters a vector exceeds, so there is no least number
and no largest. Vectors meet on (label, filter) and are verified in double precision. The number of filters follows the number
of vectors, so a filter's list stays short: lists of one vector go before any vector travels, and a list longer than `SPLIT` is
dealt into blocks, and each pair of blocks is a task's group of its own. Exact copies are one vector with a weight before
anything else happens. Tasks give back sums and a spanning forest, never pairs. Not exact: a pair at cosine 0.98 misses all
filters with a chance below 0.01 (measured recall: tests and README).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label or id, link with
nothing (component: their own id); labels may be of any type and are told apart by 64-bit hashes; vectors of different lengths do not
link; repeated rows are copies that link; rows that share an id but not a vector share their links; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import cut, read
from moraine.llm.components import components, forest

#: Codes, filters a vector is in on average over all of them; the longest list compared in one go; pairs whose common filters are looked up at once.
CODES, MEAN, SPLIT, CHUNK = 32, 48, 1024, 1 << 14
SEED = 7


class ProductCode:
    """Filters for vectors of `dim` components: `side` codewords for each half. number: which of the codes it is."""

    def __init__(self, dim: int, side: int, number: int = 0, mean: float = MEAN / CODES):
        rng = np.random.default_rng((SEED, dim, side, number))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = (dim + 1) // 2
        books = [rng.standard_normal((side, n)) for n in (self.half, dim - self.half) if n]
        self.books = [b / np.linalg.norm(b, axis=1, keepdims=True) * np.sqrt(b.shape[1] / dim) for b in books]
        self.side, self.first = side, number * side * side
        total = side ** len(self.books)
        self.threshold = NormalDist().inv_cdf(1 - min(0.5, mean / total)) / np.sqrt(dim)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors exceed."""
        turned = unit @ self.turn
        a = turned[:, : self.half] @ self.books[0].T
        b = turned[:, self.half :] @ self.books[1].T if len(self.books) > 1 else np.zeros((len(unit), 1))
        row, i = np.nonzero(a >= self.threshold - b.max(1, keepdims=True))
        at, j = np.nonzero(b[row] >= (self.threshold - a[row, i])[:, None])
        return row[at], self.first + i[at] * self.side + j


def decode(unit: np.ndarray, side: int, codes: list[ProductCode]) -> list[np.ndarray]:
    """Of each unit vector the filters it exceeds in any code, sorted."""
    found = [c.decode(unit) for c in codes]
    row, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, row))
    return np.split(ids[order], np.searchsorted(row[order], np.arange(1, len(unit))))


def _code(side: int):
    """Adds to each vector its filters, and packs its components: as single precision if they came so."""
    codes: dict[int, list[ProductCode]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                dims = np.array([len(x) for x in b.column("embedding")])
                for dim in np.unique(dims).tolist():
                    rows = b.take(pa.array(np.flatnonzero(dims == dim)))
                    v = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    if dim not in codes:
                        codes[dim] = [ProductCode(dim, side, k) for k in range(CODES)]
                    lists = decode(v / np.linalg.norm(v, axis=1, keepdims=True), side, codes[dim])
                    single = v.astype(np.float32)
                    vec = [x.tobytes() for x in (single if (single == v).all() else v)]
                    filters = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(np.full(len(lists), dim, np.int32)), rows.column("id"), rows.column("n"), filters, pa.array(vec, pa.binary())], names=["label", "dim", "id", "n", "filters", "vec"])

    return run


def _owned(at: int, lists: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether `at` is the smallest filter that the vectors of each pair share. lists: padded with -1 - row."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i), CHUNK):
        a, b = lists[i[k : k + CHUNK]], lists[j[k : k + CHUNK]]
        a = np.where(a < at, a, -(2**62))
        smaller = np.zeros(len(a), bool)
        for c in range(b.shape[1]):
            smaller |= (a == b[:, c : c + 1]).any(1)
        out[k : k + CHUNK] = ~smaller
    return out


def _verify(threshold: float):
    def group(at: int, same: bool, ids, n, half, lists, v):
        """Sums and links of one list: all its pairs, or those across its two blocks."""
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        links = np.zeros(len(ids), np.int64)
        found = []
        width = max(map(len, lists))
        pad = np.full((len(lists), width), 0, np.int64) - 1 - np.arange(len(lists))[:, None]
        for r, x in enumerate(lists):
            pad[r, : len(x)] = x
        left = np.arange(len(ids)) if same else np.flatnonzero(half == 0)
        right = left if same else np.flatnonzero(half == 1)
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold)
            i, j = rows[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                own = _owned(at, pad, i, j)
                np.add.at(links, i[own], n[j[own]])
                np.add.at(links, j[own], n[i[own]])
                node, low = forest(ids[i], ids[j])
                found.append((node[node != low], low[node != low]))
        return links, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            keys = np.stack([t.column(c).to_numpy() for c in ("label", "dim", "filter", "a", "b")], 1)
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            ids, n, half = (t.column(c).to_numpy() for c in ("id", "n", "side"))
            vec, filters = t.column("vec").to_pylist(), t.column("filters").combine_chunks()
            first, flat = filters.offsets.to_numpy(), filters.values.to_numpy()
            out_id, out_links, out_low = [], [], []
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True):
                if y - x < 2:
                    continue
                links, found = group(int(keys[x, 2]), keys[x, 3] == keys[x, 4], ids[x:y], n[x:y], half[x:y], [flat[first[i] : first[i + 1]] for i in range(x, y)], np.stack([np.frombuffer(f, np.float32 if len(f) == 4 * keys[x, 1] else np.float64).astype(np.float64) for f in vec[x:y]]))
                got = np.flatnonzero(links)
                out_id += [ids[x:y][got], *(a for a, _ in found)]
                out_links += [links[got], *(np.zeros(len(a), np.int64) for a, _ in found)]
                out_low += [ids[x:y][got], *(b for _, b in found)]
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_id, out_links, out_low)], names=["id", "links", "low"])

        for b in batches:
            # A list is compared once its last row has come; the one at the end of a batch may go on.
            keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("label", "dim", "filter", "a", "b")], 1)
            if not len(keys):
                continue
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if last is not None and (keys[0] != last).any():
                yield from flush()
                held = []
            if len(change):
                held.append(b.slice(0, change[-1]))
                yield from flush()
                held = [b.slice(change[-1])]
            else:
                held.append(b)
            last = keys[-1]
        if held:
            yield from flush()

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id), a row for each row of vectors."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Scaling by a power of two, which loses nothing, keeps squares of very large or very small components in range.
    top = F.array_max(F.transform("embedding", F.abs))
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(top)))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & (top > 0), F.lit(False))
    v = v.select("id", "label", sound.alias("sound"), F.when(sound, F.transform("embedding", lambda x: x / unit)).alias("embedding"))
    v = v.withColumn("h", F.xxhash64("embedding")).withColumn("i", F.xxhash64(F.lit(1), "embedding"))
    good = v.where("sound")
    reps = good.groupBy("label", "h", "i").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    reps = cut(reps)
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    side = max(64, 2 * int(np.ceil(np.sqrt(largest))))
    coded = cut(reps.select("id", "label", "n", "embedding").mapInArrow(_code(side), "label long, dim int, id long, n long, filters array<long>, vec binary"))
    # Lists first, by numbers alone; only members of lists of two or more travel with their vectors.
    keys = ["label", "dim", "filter"]
    posts = coded.select("label", "dim", "id", F.explode("filters").alias("filter"))
    lists = cut(posts.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1").select(*keys, F.ceil(F.col("members") / SPLIT).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = posts.join(lists, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id")
    dealt = dealt.join(coded.select("id", "n", "filters", "vec", F.col("label").alias("v_label")), "id").where("label = v_label").drop("v_label")
    keys = [*keys, "a", "b"]
    sums = cut(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), "id long, links long, low long"))
    links = sums.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(sums.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = reps.select("label", "h", "i", F.col("id").alias("rep"), "n")
    named = named.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select(F.col("label").alias("r_label"), F.col("h").alias("r_h"), F.col("i").alias("r_i"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    j = v.join(named, v["sound"] & (v["label"] == named["r_label"]) & (v["h"] == named["r_h"]) & (v["i"] == named["r_i"]), "left")
    return j.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = link_vectors(read(spark, sf_dir, "embeddings"))
    return d.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, a.e) > 0 AND list_inner_product(b.e, b.e) > 0 AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
