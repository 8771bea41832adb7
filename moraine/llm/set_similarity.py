"""Near-dedup by Jaccard similarity of word shingles, without loss: SimHash links first, prefix filtering for the rest, and a check of the shingles themselves.

Each set has a fingerprint, and sets whose fingerprints ball hashing links are checked first. Similar sets may be further apart
than balls reach (at 0.8 about 10 of 64 bits), so what is not in one component by then is looked for in the shingles.

Shingles have one order for all texts. Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of
each, so only those are posted, and all that a pair shares there is counted: it stays only if that number and what can still follow
leave room for t. Rare shingles come first; what is rare is guessed from a sample of texts, which decides about the time taken, never about the result. Each set also has a bitmap in
which each shingle flips one bit: sets that differ in d shingles differ in at most d bits, so a pair with more differing bits than t
allows goes before any text is fetched.
Equal sets are one node. After the fingerprints a round checks pairs at most a bounded number of places apart in each posting list
(it may count too few shared shingles and leave a pair to the last round), and a last one counts in whole lists all pairs that are
not in one component by then, so a large group of copies is joined by pairs mostly in proportion to its size.

Defined cases: words are runs of bytes other than blanks with A-Z lower-cased; a text of fewer words than a shingle is one
shingle; null and empty texts are one node, similar to nothing else. Shingles are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import cut, forget
from moraine.llm.components import components, forest
from moraine.llm.wordscan import mix64, scan, slices, windows

#: Texts that are sampled to find frequent shingles, and how many of those are kept.
SAMPLE, HOT = 10_000, 1 << 17
#: Tables of so many keys count as small enough to broadcast.
BROADCAST_KEYS = 100_000
#: Shingles that one join of pairs carries: this share of those of all nodes, or so many if that is more.
SHARE, FEW = 0.4, 1 << 23
#: Edges that one task joins to components; more are joined by the whole cluster.
ONE_TASK = 1 << 18
#: Columns of 64 bits that make up the bitmap of a set.
BITS = ["m0", "m1", "m2", "m3"]
#: How far apart in a posting list the nodes of a pair may be, in each round; 0: any distance, so the last round misses nothing.
REACHES = (64, 0)
_EPS = 1e-9
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, shingle: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its distinct shingles in the common order: where each text begins (and the end), hashes."""
    w = scan(texts)
    w.data = _LOWER[w.data]
    h, n, at = w.hashes(0), np.diff(w.per), w.per[:-1]
    doc = np.repeat(np.arange(len(n)), n)
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(h) >= shingle:
        x = windows(h, shingle, 5)
        whole = doc[: len(x)] == doc[shingle - 1 :]
        docs.append(doc[: len(x)][whole])
        found.append(x[whole])
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        if len(short):
            docs.append(short)
            found.append(windows(h, k, 5)[at[short]])
    doc, h = np.concatenate(docs), np.concatenate(found)
    rank = np.zeros(len(h), np.int64)
    if len(hot[0]):
        i = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
        rank = np.where(hot[0][i] == h, hot[1][i], 0)
    order = np.lexsort((h, rank, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
        doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(n) + 1)), h


_NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _lists(per: np.ndarray, h: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(h.view(np.int64)))


def bitmaps(per: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each set a row of len(BITS) words, in which each of its shingles flips one bit."""
    n, width = len(per) - 1, 64 * len(BITS)
    place = ((mix64(h ^ _U(0x8CB92BA72F3D8DD7)) >> _U(32)) % _U(width)).astype(np.int64)
    flips = np.bincount(np.repeat(np.arange(n), np.diff(per)) * width + place, minlength=n * width) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(n, len(BITS))


def fingerprints(per: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if over half the shingles' hashes have it; 0 without shingles."""
    n = np.diff(per)
    some, out = np.flatnonzero(n > 0), np.zeros(len(n), np.uint64)
    if not len(some):
        return out
    x, at = mix64(h ^ _U(0xA0761D6478BD642F)), per[some]
    width = 16 if int(n.max()) < 1 << 16 else 32  # bits of a counter: several counters a word are summed at once
    lanes = _U(sum(1 << i for i in range(0, 64, width)))
    for k in range(width):
        sums = np.add.reduceat(x >> _U(k) & lanes, at)
        for i in range(0, 64, width):
            count = (sums >> _U(i) & _U((1 << width) - 1)).astype(np.int64)
            out[some] |= (2 * count > n[some]).astype(np.uint64) << _U(i + k)
    return out


def frequent(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                _, h = shingle_sets(part.column("text"), shingle, _NONE)
                s, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["s", "n"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    texts = docs.select(F.col(text).alias("text")).sample(share, 7) if share < 1 else docs.select(F.col(text).alias("text"))
    top = cut(texts.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(HOT)).toArrow()
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def with_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t1, t2, text): t1 and t2 are 128 bits of the text's hash."""
    t = F.col(text)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), t.alias("text"))


def _describe(shingle: int, similarity: float, hot) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                per, h = shingle_sets(part.column("text"), shingle, hot.value)
                n, sums = np.diff(per), []
                for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                    total = np.r_[_U(0), np.cumsum(mix64(h ^ _U(seed)), dtype=np.uint64)]
                    sums.append(pa.array((total[per[1:]] - total[per[:-1]]).view(np.int64)))
                first = np.where(n > 0, n - np.ceil(similarity * n - _EPS).astype(np.int64) + 1, 0)
                within = np.arange(len(h)) - np.repeat(per[:-1], n) < np.repeat(first, n)
                lists = _lists(np.r_[0, np.cumsum(first)], h[within])
                bits = [pa.array(np.ascontiguousarray(m)) for m in bitmaps(per, h).T]
                fp = pa.array(fingerprints(per, h).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *sums, pa.array(n.astype(np.int64)), fp, *bits, lists], names=["id", "t1", "t2", "a", "b", "n", "fp", *BITS, "prefix"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, in parts that hold whole groups of it."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        s = cols[0]
        if not len(s):
            continue
        if s[0] == s[-1] and held and held[-1][0][-1] == s[0]:
            held.append(cols)  # a group that goes on
            continue
        begin = int(np.searchsorted(s, s[-1]))
        ready = [*held, [c[:begin] for c in cols]]
        whole = [np.concatenate(x) for x in zip(*ready, strict=True)]
        held = [[c[begin:] for c in cols]]
        if len(whole[0]):
            yield whole
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of more than one node."""
    for cols in whole_groups(batches):
        s = cols[0]
        same = s[1:] == s[:-1]
        many = np.r_[False, same] | np.r_[same, False]
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in cols], names=["s", "node", "n", "pos"])


def _pairs(similarity: float, reach: int) -> Callable:
    """Pairs of nodes of one list and of different components, at most `reach` places apart (0: all): how many of these lists they share, and how many similar sets would at least.

    Shared shingles have the same order in both sets, so after the last one counted no more follow than the shorter rest of the two. And of the set whose
    prefix ends first in the common order, shingles not counted lie behind its prefix: no more than the larger set has there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches):
            edge = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            size = np.diff(np.r_[edge, len(cols[0])])
            mixed = np.minimum.reduceat(cols[-1], edge) != np.maximum.reduceat(cols[-1], edge)
            cols = [c[np.repeat(mixed, size)] for c in cols]  # lists within one component go
            size = size[mixed]
            left, found, held = np.repeat(size, size), [], 0

            def out() -> pa.RecordBatch:
                a, b, least = (np.concatenate(x) for x in zip(*found, strict=True))
                found.clear()
                order = np.lexsort((b, a))
                a, b, least = a[order], b[order], least[order]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                common = np.diff(np.r_[first, len(a)])
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], common.astype(np.int32), np.maximum.reduceat(least, first).astype(np.int32))], names=["a", "b", "common", "least"])

            longest = int(size.max(initial=1))
            for shift in range(1, min(longest, reach + 1) if reach else longest):
                live = left > shift
                cols, left = [c[live] for c in cols], left[live]
                if len(left) <= shift:
                    break
                s, node, n, pos = ([c[:-shift], c[shift:]] for c in cols[:4])
                low, high = np.minimum(*n), np.maximum(*n)
                ok = (s[0] == s[1]) & (low >= similarity * high - _EPS)
                ok &= cols[-1][:-shift] != cols[-1][shift:]
                at = np.flatnonzero(ok)
                differ = sum(np.bitwise_count((m[at] ^ m[at + shift]).view(np.uint64)).astype(np.int64) for m in cols[4 : 4 + len(BITS)])
                at = at[differ <= (1 - similarity) / (1 + similarity) * (low + high)[at] + _EPS]
                if len(at):
                    need = np.ceil(similarity / (1 + similarity) * (low + high)[at] - _EPS).astype(np.int64)
                    behind = np.ceil(similarity * high[at] - _EPS).astype(np.int64) - 1
                    after = np.minimum(n[0] - pos[0], n[1] - pos[1])[at] - 1
                    found.append((np.minimum(*node)[at], np.maximum(*node)[at], need - np.minimum(behind, after)))
                    held += len(at)
                if held > 1 << 20:
                    yield out()
                    held = 0
            if found:
                yield out()

    return run


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A Bloom filter of 64-bit keys: at least 16 bits a key, three of them set."""
    out = np.zeros(1 << max(10, (16 * len(keys)).bit_length() - 3), np.uint8)
    for at in _places(keys, out):
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _places(keys: np.ndarray, sieve: np.ndarray) -> list[np.ndarray]:
    k = keys.view(np.uint64)
    return [(mix64(k ^ _U(seed)) & _U(8 * len(sieve) - 1)).astype(np.int64) for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _sets(docs: DataFrame, need: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes needed (node, key, r_id, r1, r2). Texts stay where they are: the keys, or if they are many a sieve of them, pick the rows whose sets move."""
    keyed = docs.select(_row_key("id", "t1", "t2").alias("key"), "id", "t1", "t2", "text")
    few = need.count() <= BROADCAST_KEYS
    if few:  # so that only their texts go to Python
        sieve = None
        keyed = keyed.join(F.broadcast(need.select("key")), "key", "left_semi")
    else:
        sieve = docs.sparkSession.sparkContext.broadcast(_sieve(need.select("key").toArrow().column("key").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if sieve is not None:
                key = b.column(0).to_numpy()
                hit = np.ones(len(key), bool)
                for at in _places(key, sieve.value):
                    hit &= sieve.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                b = b.filter(pa.array(hit))
            for part in slices(b, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns[:4], _lists(*shingle_sets(part.column("text"), shingle, _NONE))], names=["key", "id", "t1", "t2", "shingles"])

    found = keyed.mapInArrow(run, "key long, id long, t1 long, t2 long, shingles array<long>")
    same = (found["key"] == need["key"]) & (found["t1"] == need["r1"]) & (found["t2"] == need["r2"]) & found["id"].eqNullSafe(need["r_id"])
    return found.join(F.broadcast(need) if few else need, same).select("node", "shingles").dropDuplicates(["node"])


def _row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), which are in the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip((_NONE[1], _NONE[1]), *((c.to_numpy() for c in b.columns) for b in batches), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long") if edges.count() <= ONE_TASK else components(edges)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, comp: DataFrame | None, shingle: int, similarity: float) -> DataFrame | None:
    """comp (c_node, component; None: no node has one) after the pairs (a, b) whose sets are similar are joined.

    A pair carries a whole set through a join, so pairs go in slices that carry a bounded share of all shingles, and those whose nodes
    the slices before have joined are left out.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct()
    rep = [F.col("rep.id").alias("r_id"), F.col("rep.t1").alias("r1"), F.col("rep.t2").alias("r2")]
    need = cut(nodes.join(need, nodes["node"] == need["m"]).select("node", _row_key("rep.id", "rep.t1", "rep.t2").alias("key"), *rep))
    sets = cut(_sets(docs, need, shingle))
    most, seed = max(FEW, int(SHARE * nodes.agg(F.sum("n")).first()[0])), 0
    while True:
        carried = pairs.join(nodes.select(F.col("node").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0
        parts = -(-carried // most)
        mine = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(max(1, parts))) == 0
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = pairs.where(mine).join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
        new = cut(both.where(F.col("i") >= F.lit(similarity) * (F.col("n") - F.col("i")) - F.lit(_EPS)).select("a", "b"))
        if not new.isEmpty():
            edges = new if comp is None else new.unionByName(comp.select(F.col("c_node").alias("a"), F.col("component").alias("b")))
            comp = cut(_joined(edges).withColumnRenamed("node", "c_node"))
        if parts <= 1:
            break
        pairs, seed = pairs.where(~mine), seed + 1
        if comp is not None:
            x, y = (comp.select(F.col("c_node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
            pairs = pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
        pairs = cut(pairs)
    forget(sets)
    return comp


def _by_fingerprint(nodes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes, a < b: each node with the first one of its fingerprint, and that one with the first one of the fingerprint that links reach."""
    some = nodes.where("n > 0")
    heads = cut(some.groupBy("fp").agg(F.min("node").alias("head")))
    met = cut(links(heads.select("fp")))
    x, y = (heads.select(F.col("fp").alias(f), F.col("head").alias(h)) for f, h in (("a", "x"), ("b", "y")))
    between = met.join(x, "a").join(y, "b").select("x", "y")
    within = some.join(heads, "fp").where(F.col("node") != F.col("head")).select(F.col("node").alias("x"), F.col("head").alias("y"))
    return between.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped(docs: DataFrame, links: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, t1, t2, root): one row for each row of docs; rows that a chain of similar sets joins have one root.

    links: of distinct fingerprints (fp), pairs (a, b) of them that are near each other.
    """
    spark = docs.sparkSession
    keyed, n = with_keys(docs, doc_id, text), int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = spark.sparkContext.broadcast(frequent(docs, text, shingle))
    fat = cut(keyed.mapInArrow(_describe(shingle, similarity, hot), f"id long, t1 long, t2 long, a long, b long, n long, fp long, {' long, '.join(BITS)} long, prefix array<long>"))
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("rep")
    rows = cut(fat.select("id", "t1", "t2", "a", "b", "n"))
    full = cut(fat.groupBy("a", "b", "n").agg(rep, *(F.first(c).alias(c) for c in ("fp", *BITS, "prefix"))))
    forget(fat)
    named = full.withColumn("node", F.monotonically_increasing_id())  # by place in the checkpoint, so the same in every use
    nodes = cut(named.drop("prefix"))
    posts = named.select("node", "n", F.posexplode("prefix").alias("pos", "s")).select("s", "node", "n", F.col("pos").cast("long").alias("pos"))
    shared = cut(posts.repartition(n, "s").sortWithinPartitions("s", "node").mapInArrow(_met, "s long, node long, n long, pos long"))
    forget(full)
    met = cut(shared.join(nodes.select("node", *BITS), "node").select("s", "node", "n", "pos", *BITS))
    forget(shared)
    comp = None
    seen = cut(_by_fingerprint(nodes, links))
    if not seen.isEmpty():
        comp = _verified(keyed, nodes, seen, comp, shingle, similarity)
    for reach in REACHES:
        if comp is None:
            apart = met.withColumn("component", F.col("node"))
        else:
            apart = met.join(comp, met["node"] == comp["c_node"], "left").select("s", "node", "n", "pos", *BITS, F.coalesce("component", "node").alias("component"))
        found = apart.repartition(n, "s").sortWithinPartitions("s", "node").mapInArrow(_pairs(similarity, reach), "a long, b long, common int, least int")
        found = found.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("least").alias("least")).where("common >= least").select("a", "b")
        found = cut(found.join(seen, ["a", "b"], "left_anti"))
        if found.isEmpty():
            continue
        seen = seen.unionByName(found)
        comp = _verified(keyed, nodes, found, comp, shingle, similarity)
    forget(met)
    named = nodes.select("node", F.col("a").alias("n_a"), F.col("b").alias("n_b"), F.col("n").alias("n_n"))
    if comp is None:
        named = named.withColumn("root", F.col("node"))
    else:
        named = named.join(comp, F.col("node") == comp["c_node"], "left").withColumn("root", F.coalesce("component", "node"))
    named = cut(named.select("n_a", "n_b", "n_n", "root"))
    return rows.join(named, (rows["a"] == named["n_a"]) & (rows["b"] == named["n_b"]) & (rows["n"] == named["n_n"])).select("id", "t1", "t2", "root")
