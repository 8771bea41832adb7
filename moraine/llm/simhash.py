"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits have, once a block of bits that holds one of the differences is masked, at most
2 differences left, and then a value in the middle at most 1 bit from either. So each distinct fingerprint emits, for each
way of masking one of `BLOCKS` blocks, its masked value and all values one bit away (half the radius); what meets on a value
is verified; where very many meet, only those that agree in further parts of their bits and are not joined yet. Within a
task the verified pairs shrink to a spanning forest before they leave it, so a group of copies costs
links in proportion to its distinct fingerprints, and equal fingerprints never meet at all.

Defined cases: null and empty texts have fingerprint 0, which links like any other; rows that share a doc_id (null too, which
sorts last) and repeated rows each get a row; an empty table gives an empty result; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import cut, fresh, read
from moraine.llm.components import components, forest
from moraine.llm.set_similarity import grouped, small, whole_groups, with_keys

RADIUS, BLOCKS, SHINGLE, SEED = 3, 3, 3, 42
#: Links that a task holds before it shrinks them to a forest; fingerprints on one value that are all compared.
CHUNK, SPLIT = 1 << 20, 256
_U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1).cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


#: Begin and end of the block of bits that each masking takes away, what it keeps, and the flips of half the radius (none comes first).
_CUTS = [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS) for i in range(BLOCKS)]
_KEEP = [_U((2**64 - 1) ^ (2**b - 2**a)) for a, b in _CUTS]
_FLIPS = [np.array([0, *(1 << i for i in range(64) if int(m) >> i & 1)], np.uint64) for m in _KEEP]


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's variants: key, the masked value with the block's number where the block was; rest, what gives the fingerprint back."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for block, ((a, b), keep, flip) in enumerate(zip(_CUTS, _KEEP, _FLIPS, strict=True)):
                key = ((fp & keep)[:, None] ^ flip[None, :]) | _U(block << a)
                free = (fp >> _U(a)) & _U(2 ** (b - a) - 1)
                rest = (free[:, None] << _U(8)) | _U(block) | (np.arange(len(flip), dtype=np.uint64) << _U(2))[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rest.ravel().astype(np.int32))], names=["key", "rest"])


def _fingerprints_of(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    key, rest = key.view(np.uint64), rest.astype(np.int64)
    block, flip, free = rest & 3, rest >> 2 & 63, (rest >> 8).astype(np.uint64)
    out = np.empty(len(key), np.uint64)
    for k, ((a, _), keep, flips) in enumerate(zip(_CUTS, _KEEP, _FLIPS, strict=True)):
        own = block == k
        out[own] = ((key[own] & keep) ^ flips[flip[own]]) | free[own] << _U(a)
    return out


def _shifted(key: np.ndarray, fp: np.ndarray, size: np.ndarray, comp: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of equal keys (size: of each row's group), by shifting the rows against themselves; comp: only across these."""
    left = size
    for shift in range(1, int(size.max(initial=1))):
        live = left > shift  # groups too small for this shift go
        key, fp, left = key[live], fp[live], left[live]
        comp = None if comp is None else comp[live]
        near = (key[shift:] == key[:-shift]) & (np.bitwise_count(fp[:-shift] ^ fp[shift:]) <= RADIUS)
        if comp is not None:
            near &= comp[shift:] != comp[:-shift]
        if near.any():
            yield fp[:-shift][near], fp[shift:][near]


def _sizes(key: np.ndarray) -> np.ndarray:
    """Of each row of sorted keys, how many have its key."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    n = np.diff(np.r_[edge, len(key)])
    return np.repeat(n, n)


def _large(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the distinct fingerprints of one large group, without comparing them all.

    Those one bit apart are looked up first. Then the bits that vary are cut in six parts: a pair within the radius agrees in
    three of them at least, so only fingerprints that agree there and are not in one component yet are compared.
    """
    fp = np.unique(fp)
    every = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [1 << i for i in range(64) if int(every) >> i & 1]
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for bit in bits:
        low = fp[fp & _U(bit) == 0]
        at = np.minimum(np.searchsorted(fp, low | _U(bit)), len(fp) - 1)
        met = fp[at] == (low | _U(bit))
        a.append(low[met])
        b.append(low[met] | _U(bit))

    def merged() -> np.ndarray:
        """Shrinks the links to a forest; the component of each fingerprint."""
        node, low = forest(np.concatenate(a), np.concatenate(b))
        a[:], b[:] = [node[node != low]], [low[node != low]]
        comp = fp.copy()
        comp[np.searchsorted(fp, node)] = low
        return comp

    parts = [sum(bits[i :: 2 * RADIUS]) for i in range(2 * RADIUS)]
    comp = merged()
    for kept in combinations(parts, RADIUS):
        key = fp & _U(sum(kept))
        order = np.argsort(key, kind="stable")
        k, f, c = key[order], fp[order], comp[order]
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        mixed = np.repeat(np.minimum.reduceat(c, edge) != np.maximum.reduceat(c, edge), np.diff(np.r_[edge, len(k)]))
        k, f, c = k[mixed], f[mixed], c[mixed]
        found = len(a)
        for x, y in _shifted(k, f, _sizes(k), c):
            a.append(x)
            b.append(y)
            if sum(map(len, a[found:])) > CHUNK:
                merged()
                found = len(a)
        comp = merged()
    return a[0], b[0]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: pairs of one key at RADIUS or fewer bits, as a forest."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]

    def shrink() -> None:
        node, low = forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        found[:] = [(node[node != low], low[node != low])]

    for key, rest in whole_groups(batches):
        size = _sizes(key)
        some = size > 1
        key, fp, size = key[some], _fingerprints_of(key[some], rest[some]), size[some]
        few = size <= SPLIT
        found += _shifted(key[few], fp[few], size[few])
        at = 0
        big, n = fp[~few], size[~few]
        while at < len(big):
            found.append(_large(big[at : at + n[at]]))
            at += int(n[at])
        if sum(len(a) for a, _ in found) > CHUNK:
            shrink()
    shrink()
    a, b = found[0]
    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links among distinct fingerprints (column fp)."""
    balls = distinct.select("fp").mapInArrow(_balls, "key long, rest int")
    return balls.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): one row for each row of docs; component is the smallest id that links reach."""
    fps = cut(fingerprints(docs, doc_id, text))
    low = fps.groupBy("fp").agg(F.min("id").alias("low"))
    low = cut(low)
    comp = components(links(low))
    # A component's nodes are fingerprints; its name is the smallest id of its members.
    member = low.join(comp, low["fp"] == comp["node"]).select("fp", "low", "component")
    named = member.groupBy("component").agg(F.min("low").alias("first"))
    linked = member.join(named, "component").select(F.col("fp").alias("l_fp"), "first")
    every = low.join(linked, low["fp"] == linked["l_fp"], "left").select(F.col("fp").alias("c_fp"), F.coalesce("first", "low").alias("component"))
    every = cut(every)  # read back, it can be broadcast if small, and else a key with very many rows can be split
    return fps.join(every, fps["fp"] == every["c_fp"]).select("id", "fp", "component")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t1, t2, root): one row for each row of docs; root is the smallest fingerprint that links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(3).cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], names=["id", "t1", "t2", "fp"])

    fps = cut(with_keys(docs, doc_id, text).mapInArrow(run, "id long, t1 long, t2 long, fp long"))
    comp = components(links(cut(fps.select("fp").distinct())))
    return fps.join(comp, fps["fp"] == comp["node"], "left").select("id", "t1", "t2", F.coalesce("component", "fp").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs' rows and columns, of each group of near duplicates only the row with the smallest id (null last; of one id, by a hash of the text).

    Near duplicates are texts whose sets of shingles have at least this Jaccard similarity (pairs that fingerprints link are checked for
    it first, prefix filtering finds those beyond RADIUS), or without one, fingerprints at RADIUS or fewer bits. Rows that share an id, null too, are documents of their own: one goes only if its own text links to a row that stays.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints have a fixed shingle; name a similarity")
    rows = cut(_grouped(docs, doc_id, text) if similarity is None else grouped(docs, links, doc_id, text, shingle, similarity))
    first = cut(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("first")))  # so that Spark can split a large group in the join
    apart = rows.join(first, "root").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))))
    names = {c: fresh(docs, f"gone_{c}") for c in ("id", "t1", "t2")}
    gone = small(cut(apart.select("id", "t1", "t2").distinct().withColumnsRenamed(names)))
    keys = [fresh(docs, "key_1"), fresh(docs, "key_2")]
    out = docs.withColumns({keys[0]: F.xxhash64(text), keys[1]: F.xxhash64(F.lit(1), F.col(text))})
    out = out.join(gone, out[doc_id].cast("long").eqNullSafe(gone[names["id"]]) & (out[keys[0]] == gone[names["t1"]]) & (out[keys[1]] == gone[names["t2"]]), "left_anti")
    repeated = not rows.groupBy("id", "t1", "t2").count().where("count > 1").isEmpty()
    return (out.dropDuplicates([doc_id, *keys]) if repeated else out).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(read(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
