"""Benchmark decontamination: training passages are queries against a BM25 index of the test items.

Items get an inverted index; an item's weights are divided by the score it has against itself, so that one threshold means the
same for all. Each passage is a query. Its blocks of postings are passed over where even the largest weights of a block (`BLOCK`
items) for the passage's words cannot reach the threshold, and in the blocks left, items where theirs cannot; numpy does this for many
passages at once, in slices of `ROWS` entries. Passages with anything left go through block-max WAND. What it retrieves is
verified on the passage's words: `SIMILARITY` or more of the item's shingles of five words must occur (an item of fewer words is one shingle),
and half of the words of both its question and its answer (its last sentence).

Passages overlap by half and are twice as long as the longest item of their length class, so each occurrence of an item lies in
one passage whole; an edited copy longer than the longest item of its class may be cut. The index of an item set that is within
`SHARD_BYTES` is broadcast; a larger set is cut into shards of that size by a hash of the item, and the documents are read
once for each, one shard at a time: its matches are written to the shared folder before the next index is broadcast. Weights
are the same then: document frequencies of terms are counted over all items.

Defined cases: null and empty texts match nothing; items that are null or have no words match nothing; repeated items and rows
are reported each; a null id is as good as any; empty tables give results without matches; texts are taken whole.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import cut, fresh, read

SHINGLE, SIMILARITY, BM25_SHARE, K1, B, BLOCK = 5, 0.8, 0.5, 1.2, 0.75, 32
SHARD_BYTES = 16 << 20
#: Share of an item's weight whose terms are not posted for the first test; words of texts tested at once.
LIGHT, CHUNK = 0.25, 1 << 17
#: Entries of posting lists that are looked at together.
ROWS = 1 << 21
_words = re.compile(r"\w+").findall
_sentence = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def halves(text: str) -> tuple[set[str], set[str]]:
    """Words of an item's question and answer; both all words if it is one sentence."""
    parts = [p for p in _sentence.split(text.strip()) if words(p)]
    if len(parts) < 2:
        return set(words(text)), set(words(text))
    return set(words(" ".join(parts[:-1]))), set(words(parts[-1]))


class Index:
    """Items of one length class. df: in how many of all items a term occurs; n, mean: number and mean length of all items."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n: int, mean: float):
        self.ids = [i for i, _ in items]
        self.tokens = [words(t) for _, t in items]
        self.width = [min(SHINGLE, len(w)) for w in self.tokens]
        self.shingles = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w, n in zip(self.tokens, self.width, strict=True)]
        self.halves = [halves(t) for _, t in items]
        self.longest = max(map(len, self.tokens))
        lists: defaultdict[str, list[tuple[int, float]]] = defaultdict(list)
        for d, w in enumerate(self.tokens):
            score = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            whole = sum(score.values())
            for t, s in score.items():
                lists[t].append((d, s / whole))
        self.term = {t: i for i, t in enumerate(lists)}
        self.docs = [np.array([d for d, _ in x]) for x in lists.values()]
        self.weights = [np.array([s for _, s in x]) for x in lists.values()]
        self.block_max = [np.maximum.reduceat(s, np.arange(0, len(s), BLOCK)) for s in self.weights]
        heavy: defaultdict[int, list[tuple[int, float]]] = defaultdict(list)
        self.light = np.zeros(len(items))
        held: list[list[tuple[float, int]]] = [[] for _ in items]
        for t, (docs, weights) in enumerate(zip(self.docs, self.weights, strict=True)):
            for d, s in zip(docs.tolist(), weights.tolist(), strict=True):
                held[d].append((s, t))
        for d, x in enumerate(held):
            for s, t in sorted(x):
                if self.light[d] + s <= LIGHT:
                    self.light[d] += s
                else:
                    heavy[t].append((d, s))
        self.heavy_item = np.array([d for t in range(len(lists)) for d, _ in sorted(heavy[t])], np.int64)
        self.heavy_weight = np.array([s for t in range(len(lists)) for _, s in sorted(heavy[t])])
        # Blocks: of each term the blocks of items that its heavy postings lie in, where these begin, and the largest weight.
        term = np.repeat(np.arange(len(lists)), [len(heavy[t]) for t in range(len(lists))])
        edge = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.heavy_item[1:] // BLOCK != self.heavy_item[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
        self.part_begin, self.part_end = edge, np.r_[edge[1:], len(term)].astype(np.int64)
        self.part_block = self.heavy_item[edge] // BLOCK
        self.part_most = np.maximum.reduceat(self.heavy_weight, edge) if len(edge) else np.zeros(0)
        self.part_n = np.r_[np.bincount(term[edge], minlength=len(lists)), 0]
        self.part_at = np.cumsum(self.part_n) - self.part_n
        self.light_most = np.maximum.reduceat(self.light, np.arange(0, len(items), BLOCK))
        self.most = np.array([*(s.max() for s in self.weights), 0.0])  # the last is for words that no item has

    def retrieve(self, terms: list[int], share: float) -> list[tuple[int, float]]:
        """(item, score) of all items at `share` or above, by block-max WAND. terms: distinct."""
        heap = [(int(self.docs[t][0]), t, 0) for t in terms]  # (item at the cursor, term, cursor)
        heap.sort()
        found = []
        while heap:
            bound, pivot = 0.0, None
            for i, (d, t, _) in enumerate(heap):
                bound += self.most[t]
                if bound >= share - 1e-12:
                    pivot = i
                    break
            if pivot is None:
                break
            item = heap[pivot][0]
            while pivot + 1 < len(heap) and heap[pivot + 1][0] == item:
                pivot += 1
            # Bounds of the blocks that would hold the item, and where the nearest of them ends.
            tight, end = 0.0, math.inf
            for d, t, at in heap[: pivot + 1]:
                docs = self.docs[t]
                b = int(np.searchsorted(docs[BLOCK - 1 :: BLOCK], item))
                if b < len(self.block_max[t]):
                    tight += self.block_max[t][b]
                    end = min(end, int(docs[min(len(docs), (b + 1) * BLOCK) - 1]) + 1)
            if tight < share - 1e-12:
                target = max(item + 1, min(end, heap[pivot + 1][0] if pivot + 1 < len(heap) else math.inf))
                target = item + 1 if target == math.inf else int(target)
            elif heap[0][0] == item:
                score = sum(float(self.weights[t][at]) for _, t, at in heap[: pivot + 1])
                if score >= share - 1e-12:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            moved, rest = [], heap[pivot + 1 :]
            for d, t, at in heap[: pivot + 1]:
                if d < target:
                    at += int(np.searchsorted(self.docs[t][at:], target))
                if at < len(self.docs[t]):
                    moved.append((int(self.docs[t][at]), t, at))
            heap = list(heapq.merge(sorted(moved), rest))
        return found

    def pivots(self, texts: list[list[str]], share: float) -> Iterator[tuple[int, int, int]]:
        """(text, begin, end) of the passages in which some item may reach `share`.

        An item's lightest terms, LIGHT of its weight together, cannot make it. So it is enough to post the heavier ones: a
        passage counts if, for some item, those it holds and all the light ones together reach the threshold.
        """
        step, unknown = self.longest, len(self.term)
        n = np.array([len(w) for w in texts])
        ids = np.fromiter(map(self.term.get, chain.from_iterable(texts), repeat(unknown)), np.int64, int(n.sum()))
        first = np.cumsum(n) - n
        number = np.maximum(1, -((step - n) // step))  # passages of each text
        base = np.cumsum(number) - number
        heavy = np.flatnonzero(self.part_n[ids])
        text = np.searchsorted(first, heavy, side="right") - 1
        at, t = (heavy - first[text]) // step, ids[heavy]
        two = np.concatenate([at, at - 1])
        text, t = np.tile(text, 2), np.tile(t, 2)
        good = (two >= 0) & (two < number[text])
        pairs = np.unique((base[text] + two)[good] * (unknown + 1) + t[good])
        passage, t = pairs // (unknown + 1), pairs % (unknown + 1)
        # Slices of whole passages, by the number of blocks that their words are in.
        edge = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(self.part_n[t])]
        begins = np.r_[edge, len(passage)]
        i = 0
        while i < len(edge):
            j = max(i + 1, int(np.searchsorted(total[begins], total[begins[i]] + ROWS, side="right")) - 1)
            for g in self._within(passage[begins[i] : begins[j]], t[begins[i] : begins[j]], share):
                d = int(np.searchsorted(base, g, side="right")) - 1
                begin = (g - int(base[d])) * step
                yield d, begin, min(begin + 2 * step, int(n[d]))
            i = j

    def _within(self, passage: np.ndarray, t: np.ndarray, share: float) -> list[int]:
        """Of pairs of a passage and a heavy term of its words, the passages that some item may reach `share` in: first by block, then by item."""
        n_blocks = len(self.light_most)

        def spread(count: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.repeat(at - np.cumsum(count) + count, count) + np.arange(int(count.sum()))

        part = spread(self.part_n[t], self.part_at[t])
        passage = np.repeat(passage, self.part_n[t])
        key, inv = np.unique(passage * n_blocks + self.part_block[part], return_inverse=True)
        live = (np.bincount(inv, self.part_most[part], len(key)) + self.light_most[key % n_blocks] >= share - 1e-9)[inv]
        part, passage = part[live], passage[live]
        found: list[int] = []
        count = self.part_end[part] - self.part_begin[part]
        # A block has few items, so what is left is not much longer; slices end where a passage does.
        order = np.argsort(passage, kind="stable")
        part, passage, count = part[order], passage[order], count[order]
        edge = np.r_[np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]), len(passage)] if len(passage) else np.zeros(1, np.int64)
        total, i = np.r_[0, np.cumsum(count)], 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + ROWS, side="right")) - 1)
            x = slice(edge[i], edge[j])
            where = spread(count[x], self.part_begin[part[x]])
            key, inv = np.unique(np.repeat(passage[x], count[x]) * len(self.ids) + self.heavy_item[where], return_inverse=True)
            bound = np.bincount(inv, self.heavy_weight[where], len(key)) + self.light[key % len(self.ids)]
            found += np.unique(key[bound >= share - 1e-9] // len(self.ids)).tolist()
            i = j
        return found

    def matches(self, texts: list[list[str]], share: float, similarity: float) -> dict[int, dict[int, tuple[float, float]]]:
        """text -> item -> (best BM25 share, containment)."""
        out: defaultdict[int, dict[int, tuple[float, float]]] = defaultdict(dict)
        for d, a, b in self.pivots(texts, share):
            passage = texts[d][a:b]
            have = set(passage)
            grams: dict[int, set] = {}
            for item, score in self.retrieve([self.term[t] for t in have if t in self.term], share):
                own, width = self.shingles[item], self.width[item]
                if width not in grams:
                    grams[width] = {tuple(passage[i : i + width]) for i in range(len(passage) - width + 1)}
                contained = len(own & grams[width]) / len(own)
                question, answer = self.halves[item]
                if contained >= similarity and 2 * len(question & have) >= len(question) and 2 * len(answer & have) >= len(answer):
                    old = out[d].get(item, (0.0, 0.0))
                    out[d][item] = max(old[0], score), max(old[1], contained)
        return out


def build(items: list[tuple[object, str]], df: dict[str, int], n: int, mean: float) -> list[Index]:
    """Indexes by length class (powers of two), as passages are as long as their class needs."""
    classes: defaultdict[int, list] = defaultdict(list)
    for i, t in items:
        classes[max(6, (len(words(t)) - 1).bit_length())].append((i, t))
    return [Index(x, df, n, mean) for _, x in sorted(classes.items())]


def _search(shared, share: float, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[Index] = shared.value
        for b in batches:
            rows: list[list[dict]] = []
            held: list[list[str]] = []
            size = 0

            def flush(rows=rows, held=held) -> None:
                found = [[] for _ in held]
                for x in indexes:
                    for d, items in x.matches(held, share, similarity).items():
                        found[d] += [{"item_id": x.ids[i], "score": s, "containment": c} for i, (s, c) in items.items()]
                rows.extend(found)
                held.clear()

            for text in b.column("text"):
                held.append(words(text.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    flush()
                    size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("containment", pa.float64())])))], names=[*b.schema.names[:-1], "found"])

    return run


def shards(items: DataFrame, limit: int = SHARD_BYTES) -> Iterator[list[Index]]:
    """The index in parts of about `limit` bytes of text each; items: item_id, text."""
    items = items.where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shards = -(-total // limit)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["item_id", "text", "w"])

    tokens = items.select("item_id", "text").mapInArrow(split, "item_id long, text string, w array<string>").where(F.size("w") > 0)
    if n_shards > 1:
        tokens = cut(tokens)
        n, mean = tokens.agg(F.count("*"), F.avg(F.size("w"))).first()
        df = cut(tokens.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").count())
    for k in range(n_shards):
        part = tokens.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == k) if n_shards > 1 else tokens
        rows = sorted(((r.item_id, r.text) for r in part.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if not rows:
            continue
        if n_shards > 1:
            own = part.select(F.explode("w").alias("t")).distinct()
            counts = {r.t: r["count"] for r in df.join(own, "t", "left_semi").collect()}
        else:
            lists = [words(t) for _, t in rows]
            n, mean = len(rows), sum(map(len, lists)) / len(rows)
            counts = Counter(t for w in lists for t in set(w))
        yield build(rows, counts, n, mean)


def contaminated(docs: DataFrame, items: DataFrame, share: float = BM25_SHARE, similarity: float = SIMILARITY, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with one more column `contamination`: array<struct<item_id, score, containment>>, empty for a clean document."""
    spark = docs.sparkSession
    kind = "array<struct<item_id:bigint,score:double,containment:double>>"
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    name = "contamination"
    indexes = shards(items, shard_bytes)
    first, second = next(indexes, None), next(indexes, None)
    if first is None:
        return docs.withColumn(name, F.array().cast(kind))
    if second is None:
        own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
        schema = "".join(f"c{i} {t}, " for i, (_, t) in enumerate(docs.dtypes)) + f"found {kind}"
        found = docs.select(*own, F.col(text).alias("text")).mapInArrow(_search(spark.sparkContext.broadcast(first), share, similarity), schema)
        return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("found").alias(name))
    # One shard at a time: matches, which depend on the text alone, are written by its hash, and the index is let go.
    t, parts = F.col(text), []
    for index in chain([first, second], indexes):
        shared = spark.sparkContext.broadcast(index)
        hit = docs.select(F.xxhash64(t).alias("m_1"), F.xxhash64(F.lit(1), t).alias("m_2"), t.alias("text")).mapInArrow(_search(shared, share, similarity), f"m_1 long, m_2 long, found {kind}")
        parts.append(cut(hit.where(F.size("found") > 0).dropDuplicates(["m_1", "m_2"])))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, parts).groupBy("m_1", "m_2").agg(F.flatten(F.collect_list("found")).alias("m_found"))
    keys = {c: fresh(docs, c) for c in ("m_1", "m_2", "m_found")}
    every = cut(every.withColumnsRenamed(keys))
    out = docs.join(every, (F.xxhash64(docs[text]) == every[keys["m_1"]]) & (F.xxhash64(F.lit(1), docs[text]) == every[keys["m_2"]]), "left")
    return out.select(*docs.columns, F.coalesce(keys["m_found"], F.array().cast(kind)).alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("contamination", lambda x: x["item_id"])))
    return d.select("doc_id", (F.size("contamination") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_max(F.transform("contamination", lambda x: x["containment"])).alias("containment"))
