"""Substring dedup by fixed-block anchors.

Words covered by a run of `WINDOW` words that also starts earlier go. Documents are dealt into small groups by hash.

1. Index and probe: each document's non-overlapping blocks of `BLOCK` words are the index, all its rolling windows of as many
   words are the probes. Any repeated run of WINDOW >= 2 * BLOCK - 1 words holds a whole block of its earlier occurrence, so
   a window without a live anchor (a hash that is a block somewhere and occurs twice) cannot be a repeat. Probes travel as
   sorted lists of distinct hashes, coded by their gaps, with a bit for blocks. False hits do no harm here.
2. Extend: around live anchors, and only there, all runs of WINDOW words are hashed to 96 bits and compared among groups: the
   smallest document that holds a run keeps it. Overlapping runs merge into maximal repeats when their words are struck out.

Hashes meet on two levels. A group sends `FIRST` lists; a range of a batch of `BATCH` groups merges them, each hash once, and
deals them on into `SECOND` finer ranges, where all batches meet. Answers come back the same way as bitmaps, a bit for each
hash of a list. So no number of rows, lists or groups in a task follows the size of the table (only the length of an anchor's
hash does, by its logarithm), and a passage in all documents is one entry a group, then one a batch.

The text is exchanged once and read three times from that exchange.

Defined cases: null and empty texts have no words; documents are ordered by id, null ids last; rows that share an id (null too)
have an order of their own, the same in each run, so of repeated rows one keeps its words; an empty table gives an empty result; texts
are taken whole, long ones in groups of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import read
from moraine.llm.wordscan import Words, by_group, runs, scan, windows

WINDOW, BLOCK = 20, 10
#: Size classes of texts: (bytes of a text at most, documents of a group on average); longer texts are alone in their groups on average.
CLASSES = ((8 << 10, 512), (64 << 10, 64), (512 << 10, 8))
#: Groups of a batch, and bits of a hash that name its range on the first level and, after those, on the second.
BATCH, FIRST, SECOND = 1024, 7, 11
#: Bits of an anchor's hash beyond those that number the blocks of all documents: one probe in 2 to the SPARE is a false hit.
SPARE = 10
_U = np.uint64


def _ordered(t: pa.Table) -> pa.Table:
    """Rows by id, null last, then text."""
    return t.take(pc.sort_indices(t, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end"))


# Lists of whole numbers as bytes


def _pack(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after a byte that says how many."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)[1:].reshape(-1, data[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : data[0]] = raw
    return out.view("<u8").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their gaps."""
    return x[:1].astype("<u8").tobytes() + _pack(np.diff(x)) if len(x) else b""


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8"), _unpack(data[8:])]), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


#: Of a group to a range of its batch (k >= 0; k < 0 takes bits past it to group -1 - k): a and b the hashes, or a and the bits of blocks; who, ids: documents.
_SENT = pa.schema([("k", pa.int64()), ("g", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("who", pa.binary()), ("ids", pa.binary())])
#: Of such a range to a finer one.
_FINE = pa.schema([("f", pa.int64()), ("k", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
#: Answers: bits for the list that `back` sent to `part`.
_BITS = pa.schema([("back", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())])
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha256", pa.string()), ("kept", pa.string())])
_SENT_SQL, _FINE_SQL, _BITS_SQL = "k long, g long, a binary, b binary, who binary, ids binary", "f long, k long, a binary, b binary, c binary", "back long, part long, bits binary"
_NEAR = -1


def _key(g: int, r: int, batch: int) -> int:
    """The range r of the batch that group g is in."""
    return (g // batch << FIRST) + r


def _cogrouped(t: pa.Table) -> bool:
    return bool(t.num_rows) and t.column("k")[0].as_py() >= 0


def _places(lists: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Begin and end of each list in all of them joined."""
    at = 0
    for x in lists:
        yield at, at + len(x)
        at += len(x)


# Words, blocks and windows of a group


def _words(t: pa.Table) -> Words:
    return scan(t.column("text"))


def _runs(w: Words, h: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of n words from each word on, whether those lie in one document); as long as h."""
    x = windows(h, n, salt)
    out = np.zeros(len(h), np.uint64)
    out[: len(x)] = x
    left = np.repeat(w.per[1:], np.diff(w.per)) - np.arange(len(h))
    return out, left >= n


class _Anchors:
    """The distinct hashes of a group's rolling blocks: u, sorted; inv: which one each rolling block has; n: how many have it; block: is it in the index?"""

    def __init__(self, w: Words, h: np.ndarray, bits: int, block: int):
        x, self.whole = _runs(w, h, block, 1)
        at = np.arange(len(h)) - np.repeat(w.per[:-1], np.diff(w.per))
        self.u, self.inv, self.n = np.unique(x[self.whole] >> _U(64 - bits), return_inverse=True, return_counts=True)
        self.block = np.zeros(len(self.u), bool)
        self.block[self.inv[at[self.whole] % block == 0]] = True
        self.range = (self.u >> _U(bits - FIRST)).astype(np.int64)


class _Repeats:
    """The distinct runs of some windows of a group: a, b: 96 bits, sorted; doc: the first row that holds it; inv: which run each window is; first: is the window its first?"""

    def __init__(self, w: Words, near: np.ndarray, window: int):
        a, full = _runs(w, w.hashes(0), window, 2)
        b, _ = _runs(w, w.hashes(1), window, 3)
        self.at = np.flatnonzero(near & full)
        a, b = a[self.at], (b[self.at] >> _U(32)).astype(np.uint32)
        order = np.lexsort((self.at, b, a))
        new = np.ones(len(order), bool)
        x, y = a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.a, self.b = x[new], y[new]
        self.inv, self.first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
        self.inv[order] = np.cumsum(new) - 1
        self.first[order[new]] = True
        self.doc = np.searchsorted(w.per, self.at[order[new]], side="right") - 1
        self.range = (self.a >> _U(64 - FIRST)).astype(np.int64)


# Step 1


def _probe(bits: int, block: int):
    def run(t: pa.Table) -> pa.Table:
        w, g = _words(_ordered(t)), t.column("g")[0].as_py()
        x = _Anchors(w, w.hashes(0), bits, block)
        return _table([(_key(g, int(x.range[i]), BATCH), g, _pack_sorted(x.u[i:j]), _bits(x.block[i:j]), None, None) for i, j in runs(x.range)], _SENT)

    return run


def _merged_keys(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lists, distinct hashes, which one each is, how many lists hold it, is it a block in any)."""
    lists = [_unpack_sorted(x) for x in t.column("a").to_pylist()]
    u, inv, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    flags = np.concatenate([_unbits(b, len(x)) for b, x in zip(t.column("b").to_pylist(), lists, strict=True)])
    block = np.zeros(len(u), bool)
    block[inv[flags]] = True
    return lists, u, inv, n, block


def _deal_keys(bits: int):
    def run(t: pa.Table) -> pa.Table:
        if not _cogrouped(t):
            return _table([], _FINE)
        _, u, _, n, block = _merged_keys(t)
        fine, k = (u >> _U(bits - FIRST - SECOND)).astype(np.int64), t.column("k")[0].as_py()
        return _table([(int(fine[i]), k, _pack_sorted(u[i:j]), _bits(block[i:j]), _bits(n[i:j] > 1)) for i, j in runs(fine)], _FINE)

    return run


def _live(t: pa.Table) -> pa.Table:
    """Fine ranges: the hashes that are a block somewhere and occur in two groups."""
    lists, u, inv, n, block = _merged_keys(t)
    many = n > 1
    many[inv[np.concatenate([_unbits(c, len(x)) for c, x in zip(t.column("c").to_pylist(), lists, strict=True)])]] = True
    hit = (block & many)[inv]
    return _flagged(t, hit, lists)


def _flagged(t: pa.Table, hit: np.ndarray, lists: list[np.ndarray]) -> pa.Table:
    """Bits for the lists of fine ranges, if any is set."""
    return _table([(k, f, _bits(hit[i:j])) for k, f, (i, j) in zip(t.column("k").to_pylist(), t.column("f").to_pylist(), _places(lists), strict=True) if hit[i:j].any()], _BITS)


def _in_ranges(one):
    """Tables of whole fine ranges put through `one`; hashes of different ranges differ, so many ranges go at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "f"):
            yield from one(t).to_batches()

    return run


def _far(fine: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Bits of the finer ranges, put together for hashes whose ranges are `fine`."""
    out = np.zeros(len(fine), bool)
    for f, data in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        i, j = np.searchsorted(fine, [f, f + 1])
        out[i:j] = _unbits(data, j - i)
    return out


def _spread_keys(bits: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not _cogrouped(t) or not answers.num_rows:
            return _table([], _BITS)
        lists, u, inv, _, _ = _merged_keys(t)
        hit = _far((u >> _U(bits - FIRST - SECOND)).astype(np.int64), answers)[inv]
        r = t.column("k")[0].as_py() % (1 << FIRST)
        return _table([(g, r, _bits(hit[i:j])) for g, (i, j) in zip(t.column("g").to_pylist(), _places(lists), strict=True) if hit[i:j].any()], _BITS)

    return run


# Step 2


def _extend(bits: int, block: int, window: int):
    def run(t: pa.Table, live: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], _SENT)
        t = _ordered(t)
        w, g = _words(t), t.column("g")[0].as_py()
        x = _Anchors(w, w.hashes(0), bits, block)
        hit = np.zeros(len(w.starts), bool)
        hit[x.whole] = (_far(x.range, live) | (x.block & (x.n > 1)))[x.inv]
        # A window counts if any anchor lies in it.
        sums = np.r_[0, np.cumsum(hit)]
        at = np.arange(len(hit))
        near = sums[np.minimum(at + window - block + 1, len(hit))] - sums[at] > 0
        if not near.any():
            return _table([], _SENT)
        x = _Repeats(w, near, window)
        # Ids in the order of documents, null last, as numbers above 0.
        ids = t.column("id").to_numpy(zero_copy_only=False) if not t.column("id").null_count else pc.fill_null(t.column("id"), 2**63 - 1).to_numpy()
        ids = ids.astype(np.int64).view(np.uint64) ^ _U(2**63)
        rows = [(-1 - g, g, _bits(near), None, None, None)]
        for i, j in runs(x.range):
            own, who = np.unique(ids[x.doc[i:j]], return_inverse=True)
            rows.append((_key(g, int(x.range[i]), BATCH), g, _pack_sorted(x.a[i:j]), x.b[i:j].tobytes(), _pack(who), _pack_sorted(own)))
        return _table(rows, _SENT)

    return run


def _merged_runs(a: list[np.ndarray], b: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists in their order: (an order by run, id and list; is it another run than the one before? the number of the run of each entry)."""
    x, y, z = np.concatenate(a), np.concatenate(b), np.concatenate(ids)
    order = np.lexsort((z, y, x))  # stable, so lists come in their order
    p, q = x[order], y[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    inv = np.empty(len(order), np.int64)
    inv[order] = np.cumsum(new) - 1
    return order, new, inv


def _sent_runs(t: pa.Table) -> tuple[pa.Table, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    t = t.sort_by("g")
    a = [_unpack_sorted(x) for x in t.column("a").to_pylist()]
    b = [np.frombuffer(x, np.uint32) for x in t.column("b").to_pylist()]
    ids = [_unpack_sorted(y)[_unpack(x).astype(np.int64)] for x, y in zip(t.column("who").to_pylist(), t.column("ids").to_pylist(), strict=True)]
    return t, a, b, ids


def _fine_runs(a: np.ndarray) -> np.ndarray:
    return (a >> _U(64 - FIRST - SECOND)).astype(np.int64)


def _deal_runs(t: pa.Table) -> pa.Table:
    """One range of a batch: each run goes to its fine range once, with the smallest id that holds it."""
    if not _cogrouped(t):
        return _table([], _FINE)
    t, a, b, ids = _sent_runs(t)
    order, new, _ = _merged_runs(a, b, ids)
    one = order[new]
    x, y, z = np.concatenate(a)[one], np.concatenate(b)[one], np.concatenate(ids)[one]
    k, rows = t.column("k")[0].as_py(), []
    for i, j in runs(_fine_runs(x)):
        low = z[i:j].min()
        rows.append((int(_fine_runs(x[i : i + 1])[0]), k, _pack_sorted(x[i:j]), y[i:j].tobytes(), low.tobytes() + _pack(z[i:j] - low)))
    return _table(rows, _FINE)


def _earlier(t: pa.Table) -> pa.Table:
    """Fine ranges: of each batch's runs, those that an earlier document of another batch holds."""
    t = t.sort_by("k")
    a = [_unpack_sorted(x) for x in t.column("a").to_pylist()]
    b = [np.frombuffer(x, np.uint32) for x in t.column("b").to_pylist()]
    ids = [np.frombuffer(x[:8], np.uint64) + _unpack(x[8:]) for x in t.column("c").to_pylist()]
    order, new, _ = _merged_runs(a, b, ids)
    hit = np.zeros(len(order), bool)
    hit[order[~new]] = True
    return _flagged(t, hit, a)


def _spread_runs(t: pa.Table, answers: pa.Table) -> pa.Table:
    if not t.num_rows:
        return _table([], _BITS)
    if not _cogrouped(t):
        return _table([(x["g"], _NEAR, x["a"]) for x in t.to_pylist()], _BITS)
    t, a, b, ids = _sent_runs(t)
    order, new, inv = _merged_runs(a, b, ids)
    hit = np.zeros(len(order), bool)
    hit[order[~new]] = True
    hit |= _far(_fine_runs(np.concatenate(a)[order[new]]), answers)[inv]
    r = t.column("k")[0].as_py() % (1 << FIRST)
    return _table([(g, r, _bits(hit[i:j])) for g, (i, j) in zip(t.column("g").to_pylist(), _places(a), strict=True) if hit[i:j].any()], _BITS)


def _strike(window: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], _OUT)
        t = _ordered(t)
        w = _words(t)
        change = np.zeros(len(w.starts) + window + 1, np.int64)
        near = [x for p, x in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True) if p == _NEAR]
        if near:
            x = _Repeats(w, _unbits(near[0], len(w.starts)), window)
            again = ~x.first | _far(x.range, answers.filter(pc.not_equal(answers.column("part"), _NEAR)))[x.inv]
            change[: len(w.starts)] += np.bincount(x.at[again], minlength=len(w.starts))
            change[window : window + len(w.starts)] -= np.bincount(x.at[again], minlength=len(w.starts))
        gone = np.cumsum(change)[: len(w.starts)] > 0
        rows, ids = [], t.column("id").to_pylist()
        for i, (p, q) in enumerate(zip(w.per[:-1].tolist(), w.per[1:].tolist(), strict=True)):
            keep = ~gone[p:q]
            text = w.data[w.first[i] : w.first[i + 1]].tobytes()
            kept = b" ".join(text.split() if keep.all() else [x for x, k in zip(text.split(), keep.tolist(), strict=True) if k])
            rows.append((ids[i], q - p, int(q - p - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        return _table(rows, _OUT)

    return run


def _dealt(d: DataFrame) -> tuple[DataFrame, int]:
    """d (id, text) with its group g, and the bits of an anchor's hash. Rows of one id and text are spread by the task that reads them."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    kind = F.lit(len(CLASSES))
    for c, (most, _) in reversed([*enumerate(CLASSES)]):
        kind = F.when(size <= most, F.lit(c)).otherwise(kind)
    found = {r.kind: r for r in d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()}
    h, g, first = F.xxhash64("id", "text", F.spark_partition_id()), F.lit(0).cast("long"), 0
    for c, r in sorted(found.items()):
        groups = -(-r.n // CLASSES[c][1]) if c < len(CLASSES) else r.n
        g = F.when(kind == c, F.lit(first).cast("long") + F.pmod(h, F.lit(groups))).otherwise(g)
        first += groups
    blocks = sum(r.bytes for r in found.values()) // (2 * BLOCK) + 1
    return d.withColumn("g", g), min(58, max(FIRST + SECOND + 4, blocks.bit_length() + SPARE))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(id, n_words, n_removed, sha256 of the kept words, kept: those words joined by one space), a row for each row of docs."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    d, bits = _dealt(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")))
    grouped = d.groupBy("g")
    sent = grouped.applyInArrow(_probe(bits, block), _SENT_SQL).groupBy("k")
    fine = sent.applyInArrow(_deal_keys(bits), _FINE_SQL).repartition("f").sortWithinPartitions("f").mapInArrow(_in_ranges(_live), _BITS_SQL)
    live = sent.cogroup(fine.groupBy("back")).applyInArrow(_spread_keys(bits), _BITS_SQL)
    found = grouped.cogroup(live.groupBy("back")).applyInArrow(_extend(bits, block, window), _SENT_SQL).groupBy("k")
    fine = found.applyInArrow(_deal_runs, _FINE_SQL).repartition("f").sortWithinPartitions("f").mapInArrow(_in_ranges(_earlier), _BITS_SQL)
    earlier = found.cogroup(fine.groupBy("back")).applyInArrow(_spread_runs, _BITS_SQL)
    return grouped.cogroup(earlier.groupBy("back")).applyInArrow(_strike(window), "id long, n_words long, n_removed long, sha256 string, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_substrings(read(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 19], ' ')) AS gram FROM p),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) > 1 AS again FROM g),
c AS (SELECT doc_id, unnest(range(pos, pos + 20)) AS pos FROM f WHERE again),
x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS kept FROM (SELECT w.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w JOIN x USING (doc_id)) AS e
  LEFT JOIN (SELECT DISTINCT doc_id, pos FROM c) AS y ON e.doc_id = y.doc_id AND e.pos = y.pos WHERE y.pos IS NULL GROUP BY e.doc_id) AS k ON w.doc_id = k.doc_id
"""
