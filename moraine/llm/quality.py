"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated scores.

Each word has a sparse ternary index vector; the vector of a word is the sum of the index vectors of its neighbours in all
documents (random indexing), labelled or not: tasks sum in whole numbers and Spark adds the sums up by word. The most frequent
words of all documents, `FREQUENT` or as many as equal frequency allows, have rows of their own, told apart by 64-bit hashes; rarer ones share `BUCKETS` rows. A word
also has a shape (letter case, digits, signs, length, whether it repeats a word just before), which is a pseudo-word of its own. A document is the mean of its words' vectors, the mean of its
shapes' vectors and its length, over the whole text. The network is trained with numpy on the driver; its
temperature is fitted on training rows set aside. The model has a bounded size (about 4 MB) and is broadcast.

Only the network and its temperature see a sample, the training set: at most `MAX_TRAIN` labelled rows with at most `MAX_BYTES` of text, by a hash of their id, none of them held out.
Neither labels nor lang, source or doc_id enter a score.

Defined cases: null and empty texts are scored as texts without words; rows without label are scored only; a null doc_id is
scored and not held out; repeated rows get equal scores; without usable labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import cut, read
from moraine.llm.wordscan import Words, scan, slices

MAX_TRAIN, MAX_BYTES, FOLDS, KEEP = 6000, 64 << 20, 5, 0.3
#: Words with rows of their own; rows that rarer words share, dimensions of the vectors, non-zero parts of an index vector, neighbours on either side, hidden units, rounds.
FREQUENT = 1 << 14
BUCKETS, DIM, PARTS, REACH, HIDDEN, ROUNDS = 1 << 14, 32, 2, 2, 32, 60
SHAPES = 1 << 11
#: Rows whose sums travel together; distinct words that a task holds before it sends them on.
ROWS, HELD = 256, 1 << 19
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def index_parts(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the parts of n sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    drawn = [(rng.integers(0, DIM, n), rng.choice(np.array([-1, 1], np.int64), n)) for _ in range(PARTS)]
    return np.stack([d for d, _ in drawn], axis=1), np.stack([x for _, x in drawn], axis=1)


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors."""
    out = np.zeros((n, DIM), np.float32)
    for d, x in zip(*(y.T for y in index_parts(n, seed)), strict=True):
        np.add.at(out, (np.arange(n), d), x.astype(np.float32))
    return out


def word_rows(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The row of each word: a shared one, or after those its own if its hash is in frequent (sorted)."""
    shared = (h >> _U(40)).astype(np.int64) % BUCKETS
    if not len(frequent):
        return shared
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, BUCKETS + at, shared)


#: For each byte: is it A-Z, a-z or part of a character beyond ASCII, 0-9, another sign?
_CLASS = np.full(256, 3)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 1, 2


def shapes(w: Words, h: np.ndarray) -> np.ndarray:
    """A number below SHAPES for each word."""
    kind = _CLASS[w.data]
    out = np.zeros(len(h), np.int64)
    length = w.ends - w.starts
    for k in range(4):
        if k == 1:
            continue
        sums = np.r_[0, np.cumsum(kind == k, dtype=np.int64)]
        n = sums[w.ends] - sums[w.starts]
        out = out * 4 + np.where(n == 0, 0, np.where(n == length, 3, np.where(n == 1, 1, 2)))
    out = out * 4 + np.minimum(np.log2(np.maximum(length, 1)).astype(np.int64), 6) // 2
    last = kind[w.ends - 1] if len(h) else kind[:0]
    out = out * 2 + (last == 3)
    again = np.zeros(len(h), np.int64)
    inner = np.ones(len(h), bool)
    inner[w.per[:-1][w.per[:-1] < len(h)]] = False
    again[1:] = (h[1:] == h[:-1]) & inner[1:]
    return out * 2 + again


@dataclass
class Model:
    frequent: np.ndarray
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def features(self, w: Words) -> np.ndarray:
        """A row for each text."""
        h = w.hashes(0)
        n = np.diff(w.per)
        full = np.flatnonzero(n)
        out = np.zeros((len(n), 2 * DIM + 1), np.float32)
        out[:, -1] = np.log1p(n)
        if len(full):
            at = w.per[:-1][full]
            out[full, :DIM] = np.add.reduceat(self.words[word_rows(h, self.frequent)], at) / n[full, None]
            out[full, DIM : 2 * DIM] = np.add.reduceat(self.shapes[shapes(w, h)], at) / n[full, None]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.mean) / self.spread @ a + b, 0) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def _count(total: np.ndarray, w: Words, frequent: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds the index vectors of the neighbours of all words to total (rows by DIM, whole numbers)."""
    row = word_rows(w.hashes(0), frequent)
    text, base = np.repeat(np.arange(len(w.per) - 1), np.diff(w.per)), row * DIM
    place, sign = [parts[0][row, p] for p in range(PARTS)], [parts[1][row, p].astype(np.float64) for p in range(PARTS)]
    at, signs = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k in range(1, min(REACH + 1, len(row))):
        near = text[k:] == text[:-k]
        for p in range(PARTS):
            at += [base[:-k] + place[p][k:], base[k:] + place[p][:-k]]
            signs += [sign[p][k:] * near, sign[p][:-k] * near]
    # Sums of whole numbers this small are exact in double precision.
    total += np.bincount(np.concatenate(at), np.concatenate(signs), total.size).reshape(total.shape).astype(total.dtype)


def _unit(total: np.ndarray) -> np.ndarray:
    """Each vector scaled to length 1 (0 for words never seen)."""
    norm = np.linalg.norm(total.astype(np.float64), axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def _word_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What word_vectors has for these texts, without Spark."""
    scans = [scan(pa.array(texts[at : at + 64], pa.large_string())) for at in range(0, len(texts), 64)]
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.hashes(0) for w in scans)]), return_counts=True)
    level = np.floor(np.log2(n) * 64)
    every = np.unique(level)
    fits = [x for x in every.tolist() if (level >= x).sum() <= FREQUENT]
    frequent = np.sort(h[level >= min(fits)]) if fits else h[:0]
    total, parts = np.zeros((BUCKETS + len(frequent), DIM), np.int64), index_parts(BUCKETS + len(frequent), 11)
    for w in scans:
        _count(total, w, frequent, parts)
    return frequent, _unit(total)


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The frequent words' hashes (sorted) and the vectors of all rows, by random indexing over all documents."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, inv = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in held)]), return_inverse=True)
            return h, np.bincount(inv, np.concatenate([np.zeros(0), *(n for _, n in held)]), len(h)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            h, n = merged()
            for at in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["h", "n"])

        for b in batches:
            for part in slices(b, "text", 4 << 20):
                held.append(np.unique(scan(part.column("text")).hashes(0), return_counts=True))
                if sum(len(x) for x, _ in held) > 2 * HELD:  # what a task has met so far, added up by word
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD:
                        yield from out()
                        held.clear()
        yield from out()

    counts = cut(texts.mapInArrow(words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    # How many words are about how frequent: a few thousand rows, from which the least frequency follows that still fits.
    level = F.floor(F.log2("n") * 64).cast("int")
    fits, least = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        fits += r["count"]
        least = r.level if fits <= FREQUENT else r.level + 1
        if fits > FREQUENT:
            break
    top = counts.where(level >= least).select("h").toArrow()
    frequent = np.sort(top.column("h").to_numpy().view(np.uint64))
    rows = BUCKETS + len(frequent)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts, n = np.zeros((rows, DIM), np.int32), index_parts(rows, 11), 0

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, rows, ROWS):
                if total[at : at + ROWS].any():
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + ROWS].tobytes()], pa.binary())], names=["at", "v"])

        for b in batches:
            for part in slices(b, "text", 1 << 20):
                w = scan(part.column("text"))
                if n + len(w.starts) > 1 << 26:  # 32 bits hold so many words
                    yield from out()
                    total[:], n = 0, 0
                _count(total, w, shared.value, parts)
                n += len(w.starts)
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                new = np.frombuffer(v.as_buffer(), np.int32).reshape(-1, DIM)
                total[at] = total[at] + new if at in total else new.astype(np.int64)
        for at, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([_unit(v).tobytes()], pa.binary())], names=["at", "v"])

    got = texts.mapInArrow(sums, "at long, v binary").repartition(n, "at").mapInArrow(merge, "at long, v binary").toArrow()
    out = np.zeros((rows, DIM), np.float32)
    for at, v in zip(got.column("at").to_pylist(), got.column("v"), strict=True):
        new = np.frombuffer(v.as_buffer(), np.float32).reshape(-1, DIM)
        out[at : at + len(new)] = new
    return frequent, out


def train(texts: list[str], labels: np.ndarray, vectors: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """texts and labels (0 or 1) in a fixed order; vectors of words from word_vectors, else from these texts."""
    none = np.zeros(2 * DIM + 1, np.float32)
    model = Model(*(vectors or _word_vectors(texts)), index_vectors(SHAPES, 13) / np.float32(np.sqrt(PARTS)), none, none + 1, [np.zeros((2 * DIM + 1, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.float32(0)], 1.0)
    y = labels.astype(np.float32)
    if len(set(labels.tolist())) < 2:
        return model
    x = np.concatenate([model.features(scan(pa.array(texts[at : at + 64], pa.large_string()))) for at in range(0, len(texts), 64)])
    rng = np.random.default_rng(17)
    order = rng.permutation(len(x))
    aside, used = order[: len(x) // 6], order[len(x) // 6 :]
    model.mean, model.spread = x[used].mean(0), x[used].std(0) + np.float32(1e-3)
    z = (x - model.mean) / model.spread
    p = [rng.standard_normal((z.shape[1], HIDDEN)).astype(np.float32) * np.float32(np.sqrt(2 / z.shape[1])), np.zeros(HIDDEN, np.float32), rng.standard_normal(HIDDEN).astype(np.float32) * np.float32(0.1), np.zeros((), np.float32)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(ROUNDS):
        rng.shuffle(used)
        rate = 3e-3 * (1 - epoch / ROUNDS) + 1e-4
        for at in range(0, len(used), 128):
            i = used[at : at + 128]
            a = z[i] @ p[0] + p[1]
            r = np.maximum(a, 0)
            g = (1 / (1 + np.exp(-np.clip(r @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            back = g[:, None] * p[2] * (a > 0)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), r.T @ g + 1e-4 * p[2], g.sum()]
            t += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.layers = p
    if len(aside):
        logit, true = model.logits(x[aside]).astype(np.float64), y[aside]

        def loss(temperature: float) -> float:
            s = logit / temperature
            return float(np.mean(np.logaddexp(0, s) - true * s))

        model.temperature = float(min(np.exp(np.linspace(np.log(0.5), np.log(8), 60)), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the labelled rows that are not held out, over word vectors from all of docs."""
    known = labels.select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.min("y").alias("y")).withColumn("k", F.xxhash64(F.lit(3), "l_id")).orderBy("k", "l_id").limit(max_train)
    found = docs.join(F.broadcast(known), docs[doc_id] == known["l_id"]).select("l_id", "y", "k", F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = cut(found.groupBy("l_id").agg(F.min("y").alias("y"), F.min("k").alias("k"), F.min("t").alias("t")))
    # Rows come by their hash; one that would pass the bytes allowed is left out, and the next is looked at.
    sizes, keep, left = found.select("l_id", "k", F.octet_length("t").alias("n")).collect(), [], max_bytes
    for r in sorted(sizes, key=lambda r: (r.k, r.l_id)):
        if r.n <= left:
            keep.append(r.l_id)
            left -= r.n
    rows = sorted(found.where(F.col("l_id").isin(keep)).collect(), key=lambda r: (r.k, r.l_id)) if keep else []
    if len({r.y for r in rows}) < 2:
        warnings.warn("no labelled rows of both kinds to learn from: every score is 0.5", stacklevel=2)
    return train([r.t for r in rows], np.array([r.y for r in rows]), word_vectors(docs, text))


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with one more column `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                s = shared.value.score(shared.value.features(scan(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=[*part.schema.names[:-1], "score"])

    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    schema = "".join(f"c{i} {t}, " for i, (_, t) in enumerate(docs.dtypes)) + "score double"
    out = docs.select(*own, F.col(text).alias("text")).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    d = scores(docs.select("doc_id", "text"), model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
