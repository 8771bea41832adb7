"""Token counts without token ids.

Documents are cut into chunks. A chunk sends its distinct pre-tokens, dealt into `RANGES` hash ranges, and its sparse matrix of
document frequencies. A hash range of a batch of chunks takes each distinct pre-token of these once and deals it on into
`RANGES` finer ranges; there each distinct pre-token of all documents is counted once. Numbers of pieces come back the same
way, a small number for each pre-token of a list, in the order of the list. The chunk joins them to its frequencies and sums.

Nothing here follows the size of the table: a chunk sends `RANGES` lists at most, a batch has a bounded number of chunks, and
there are `RANGES` times `RANGES` fine ranges. A pre-token that all documents hold is one entry in the list of a batch, and
one entry a batch in its fine range. Texts are read and pre-tokenised once and never shuffled.

Defined cases: a null text counts as empty, with 0 tokens; rows keep their doc_id whatever it is, repeated rows too; an empty
table gives an empty result; texts are taken whole; special strings inside texts are single tokens, as the library has it.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import read
from moraine.llm.wordscan import by_group, runs

#: A chunk ends at so many documents, distinct pre-tokens or bytes of text.
CHUNK_DOCS, CHUNK_TOKENS, CHUNK_BYTES = 512, 60_000, 8 << 20
#: Hash ranges of each of the two levels; tasks whose chunks make a batch, and chunks of each.
RANGES, BATCH_TASKS, BATCH_CHUNKS = 256, 256, 16
#: What the regexes of tokenizer files call white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PreTokens:
    """Pre-tokens of a text and their numbers of pieces.

    For files of the `tokenizers` library with a BPE over byte-level pre-tokens, whose normalizer composes, makes white space
    one blank and lower-cases, and whose pre-tokens are what one pattern finds. Other files raise ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.find = regex.compile(self._pattern(json.loads(self.tok.to_str()))).findall
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added, self.special = added, regex.compile("|".join(map(regex.escape, added)))
        self.plain = regex.compile(r"[^\x00-\u024f]").search
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.shown = {chr(b): c for b, c in shown.items()}
        self.table = str.maketrans(self.shown)

    @staticmethod
    def _pattern(file: dict) -> str:
        """The file's own pre-token pattern with white space spelled out, once the rest of the file is known to be of the kind above."""
        normal = [(x["type"], x.get("pattern"), x.get("content")) for x in (file["normalizer"] or {}).get("normalizers", ())]
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", ())
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in file["added_tokens"])
        known = normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and plain
        known = known and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        known = known and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"]) and file["model"]["type"] == "BPE" and not file["model"]["dropout"]
        pattern = steps[0]["pattern"].get("Regex", "") if known else ""
        if not pattern or pattern.count(r"\s") != pattern.count(r"[^\s"):
            raise ValueError("not a tokenizer whose pre-tokens can be counted one by one")
        return pattern.replace(r"\s", SPACES)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if self.plain(text) is None:  # below U+0250 composing changes nothing and lower case is the same everywhere
            return self.find(text.lower())
        text = self.tok.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> tuple[Counter, int]:
        """(frequencies of pre-tokens, number of special strings)."""
        if not any(x in text for x in self.added):
            return Counter(self.split(text)), 0
        parts, out = self.special.split(text), Counter()
        for p in parts:
            out.update(self.split(p))
        return out, len(parts) - 1

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """Number of pieces of each pre-token."""
        one, table = self.tok.model.tokenize, self.table
        return np.array([len(one(t.encode().decode("latin-1").translate(table))) for t in tokens], np.uint32)


@cache
def _tokenizer(path: str) -> PreTokens:
    return PreTokens(path)


_SENT = pa.schema([("k", pa.int64()), ("chunk", pa.int64()), ("tokens", pa.string()), ("ids", pa.binary()), ("nulls", pa.binary()), ("bytes", pa.binary()), ("special", pa.binary()), ("edge", pa.binary()), ("index", pa.binary()), ("freq", pa.binary())])
_SENT_SQL = "k long, chunk long, tokens string, ids binary, nulls binary, bytes binary, special binary, edge binary, index binary, freq binary"


def _ranges(tokens: list[str], level: int) -> np.ndarray:
    """Of each pre-token its hash range on level 0 or 1."""
    crc = np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.uint32, len(tokens))
    return (crc // np.uint32(RANGES**level)) % np.uint32(RANGES)


class _Chunk:
    """Frequencies of some documents while they are gathered."""

    def __init__(self, docs: int) -> None:
        self.docs = docs
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.bytes, self.special, self.index, self.freq, self.edge, self.size = [], [], [], [], [], [0], 0

    def add(self, doc_id: int | None, n_bytes: int, counts: Counter, special: int) -> None:
        self.ids.append(doc_id)
        self.bytes.append(n_bytes)
        self.special.append(special)
        self.index.append(np.fromiter(map(self.number.__getitem__, counts), np.uint32, len(counts)))
        self.freq.append(np.fromiter(counts.values(), np.uint32, len(counts)))
        self.edge.append(self.edge[-1] + len(counts))
        self.size += n_bytes

    def full(self) -> bool:
        return len(self.ids) >= self.docs or len(self.number) >= CHUNK_TOKENS or self.size >= CHUNK_BYTES

    def rows(self, batch: int) -> pa.RecordBatch:
        tokens = list(self.number)
        r = _ranges(tokens, 0)
        order = np.argsort(r, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        small = np.uint16 if len(tokens) < 2**16 else np.uint32
        index = place[np.concatenate(self.index)].astype(small) if tokens else np.zeros(0, small)
        freq = np.concatenate(self.freq)
        freq = freq.astype(np.uint8) if freq.max(initial=0) < 256 else freq
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        nulls = np.array([x is None for x in self.ids], np.uint8)
        # The chunk's name follows from what it holds, so that a task that runs again names it alike.
        digest = hashlib.blake2b(digest_size=8)
        for part in (ids.tobytes(), index.tobytes(), freq.tobytes(), "\n".join(tokens).encode()):
            digest.update(part)
        name = -1 - (int.from_bytes(digest.digest(), "little") >> 1)
        none = [None] * 8
        out = [(name, name, None, ids.tobytes(), nulls.tobytes(), np.array(self.bytes, np.int64).tobytes(), np.array(self.special, np.int32).tobytes(), np.array(self.edge, np.int32).tobytes(), index.tobytes(), freq.tobytes())]
        sorted_r = r[order]
        for a, b in runs(sorted_r):
            out.append((batch * RANGES + int(sorted_r[a]), name, "\n".join([tokens[i] for i in order[a:b]]), *none[:7]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENT.types, strict=True)], schema=_SENT)


def _send(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent = TaskContext.get().partitionId(), 0
        split, chunk = _tokenizer(path), _Chunk(CHUNK_DOCS)

        def batch() -> int:
            return task // BATCH_TASKS << 20 | min(sent // BATCH_CHUNKS, (1 << 20) - 1)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py() or ""
                chunk.add(doc_id, len(t.encode()), *split(t))
                if chunk.full():
                    yield chunk.rows(batch())
                    chunk, sent = _Chunk(CHUNK_DOCS), sent + 1
        if chunk.ids:
            yield chunk.rows(batch())

    return run


def _merged(t: pa.Table) -> tuple[dict[int, list[str]], dict[str, int], np.ndarray, np.ndarray]:
    """The lists of one range and batch: (by chunk, distinct pre-tokens and their numbers, those numbers in the order of fine ranges, the fine ranges)."""
    t = t.sort_by("chunk")
    lists = {c: x.split("\n") for c, x in zip(t.column("chunk").to_pylist(), t.column("tokens").to_pylist(), strict=True)}
    known: dict[str, int] = {}
    for x in lists.values():
        known.update(dict.fromkeys(x, 0))
    fine = _ranges(list(known), 1)
    order = np.argsort(fine, kind="stable")
    return lists, known, order, fine[order].astype(np.int64)


_FINE = pa.schema([("f", pa.int64()), ("k", pa.int64()), ("tokens", pa.string())])


def _is_range(t: pa.Table) -> bool:
    return bool(t.num_rows) and t.column("k")[0].as_py() >= 0


def _deal(t: pa.Table) -> pa.Table:
    """One range of a batch: each distinct pre-token goes to its fine range once."""
    if not _is_range(t):
        return _FINE.empty_table()
    _, known, order, fine = _merged(t)
    k, names = t.column("k")[0].as_py(), list(known)
    rows = [(k % RANGES * RANGES + int(fine[a]), k, "\n".join([names[i] for i in order[a:b]])) for a, b in runs(fine)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FINE.types, strict=True)], schema=_FINE)


_BACK = pa.schema([("to", pa.int64()), ("r", pa.int64()), ("pieces", pa.binary())])
_BACK_SQL = "to long, r long, pieces binary"


def _small(n: np.ndarray) -> bytes:
    """n in the least of 1, 2 or 4 bytes each."""
    top = n.max(initial=0)
    return n.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n if n else 1]).astype(np.uint32)


def _back(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(_BACK.types)], schema=_BACK)


def _count(path: str):
    """Fine ranges: each distinct pre-token is counted once, and every batch gets the numbers of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "f"):
            lists = [x.split("\n") for x in t.column("tokens").to_pylist()]
            known = dict.fromkeys(x for y in lists for x in y)
            known = dict(zip(known, _tokenizer(path).pieces(list(known)).tolist(), strict=True))
            yield from _back([(k, f, _small(np.fromiter(map(known.__getitem__, x), np.uint32, len(x)))) for k, f, x in zip(t.column("k").to_pylist(), t.column("f").to_pylist(), lists, strict=True)]).to_batches()

    return run


def _spread(t: pa.Table, answers: pa.Table) -> pa.Table:
    """One range of a batch: each chunk gets the numbers of its list."""
    if not _is_range(t):
        return _BACK.empty_table()
    lists, known, order, fine = _merged(t)
    pieces = np.zeros(len(order), np.uint32)
    r = t.column("k")[0].as_py() % RANGES
    for f, data in zip(answers.column("r").to_pylist(), answers.column("pieces").to_pylist(), strict=True):
        a, b = np.searchsorted(fine, [f - r * RANGES, f - r * RANGES + 1])
        pieces[order[a:b]] = _large(data, b - a)
    known = dict(zip(known, pieces.tolist(), strict=True))
    return _back([(chunk, r, _small(np.fromiter(map(known.__getitem__, x), np.uint32, len(x))) + len(x).to_bytes(4, "little")) for chunk, x in lists.items()])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _sum(t: pa.Table, answers: pa.Table) -> pa.Table:
    """One chunk (or equal ones): frequencies times pieces, summed by document."""
    if not t.num_rows or _is_range(t):
        return _OUT.empty_table()
    # Equal chunks of two batches have equal answers.
    by_range = dict(zip(answers.column("r").to_pylist(), answers.column("pieces").to_pylist(), strict=True))
    parts = [_large(x[:-4], int.from_bytes(x[-4:], "little")) for _, x in sorted(by_range.items())]
    pieces = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int64)
    out = []
    for x in t.to_pylist():
        edge = np.frombuffer(x["edge"], np.int32)
        index = np.frombuffer(x["index"], np.uint16 if len(x["index"]) == 2 * edge[-1] else np.uint32)
        freq = np.frombuffer(x["freq"], np.uint8 if len(x["freq"]) == edge[-1] else np.uint32)
        total = np.r_[0, np.cumsum(pieces[index] * freq)]
        n = total[edge[1:]] - total[edge[:-1]] + np.frombuffer(x["special"], np.int32)
        ids = pa.array(np.frombuffer(x["ids"], np.int64), mask=np.frombuffer(x["nulls"], np.uint8).astype(bool))
        out.append(pa.Table.from_arrays([ids, pa.array(np.frombuffer(x["bytes"], np.int64)), pa.array(n)], schema=_OUT))
    return pa.concat_tables(out)


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row for each row of docs. tokenizer: a file of the `tokenizers` library that each executor has."""
    _tokenizer(tokenizer)  # raises here if it is of another kind
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = d.mapInArrow(_send(tokenizer), _SENT_SQL).groupBy("k")
    fine = sent.applyInArrow(_deal, "f long, k long, tokens string").repartition("f").sortWithinPartitions("f")
    counted = fine.mapInArrow(_count(tokenizer), _BACK_SQL).groupBy("to")
    answers = sent.cogroup(counted).applyInArrow(_spread, _BACK_SQL).groupBy("to")
    return sent.cogroup(answers).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    d = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
