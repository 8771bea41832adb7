"""Line, substring, SimHash and embedding dedup against brute force."""

import gc
import hashlib
import random
import time
import tracemalloc
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from moraine.llm import components, embedding_dedup, line_dedup, set_similarity, simhash, substring_dedup, wordscan

DOCS = "doc_id long, text string, source string, line_dedup string"


def texts(n=60, seed=0):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "a\x0bb", "漢字"]
    passage = [" ".join(r.choices(vocab, k=r.choice([20, 25, 60]))) for _ in range(4)]
    out = [None, "", " \n\t", "one", "x " * 300, "\n".join(["The same long line here"] * 3)]
    while len(out) < n:
        t = " ".join(r.choices(vocab, k=r.randint(1, 80)))
        for p in r.sample(passage, r.randint(0, 3)):
            t += r.choice([" ", "\n", "  "]) + p
        out.append(t + r.choice(["", "\nThe same long line here", "\n  the SAME long line here\r"]))
    return out + out[6:12]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(i, t, f"s{i % 3}", None) for i, t in rows], DOCS)


def split(text):
    return (text or "").encode().split()


def test_words_are_runs_of_bytes_that_are_not_blank():
    t = texts() + ["\x85\xa0 a", "a\x1cb c"]
    w = wordscan.scan(pa.array(t))
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)] == [x for s in t for x in split(s)]
    assert np.diff(w.per).tolist() == [len(split(s)) for s in t]
    seen = {}
    for x, h in zip([x for s in t for x in split(s)], w.hashes(0).tolist(), strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    t = ["alpha beta " + "z" * 5000 + " gamma", "beta"]
    whole = wordscan.scan(pa.array(t)).hashes(1)
    monkeypatch.setattr(wordscan, "BLOCK", 6000)
    assert (wordscan.scan(pa.array(t)).hashes(1) == whole).all() and whole[1] == whole[4]


def test_lines(docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = defaultdict(list)
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            first[key(x)].append(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(first[key(x)]) == i]
        assert (got[i].text or "") == "\n".join(kept)
        assert got[i]["_line_dedup"].n_lines == len(lines) and got[i]["_line_dedup"].n_dropped == len(lines) - len(kept)
        assert got[i].source == f"s{i % 3}"


def test_lines_of_repeated_rows_and_null_ids(spark):
    long = "a line of some length"
    d = spark.createDataFrame([(1, f"{long}\nx"), (1, f"y\n{long}\nz"), (2, f"{long}\nk"), (None, long), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text or "") for r in line_dedup.dedup_lines(d).collect())
    assert got == [(0, ""), (0, ""), (1, f"{long}\nx"), (1, f"y\n{long}\nz"), (2, "k")]
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def strike(rows, window=20):
    """rows: [(id, text)] in order."""
    seen, out = set(), []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if g in seen:
                gone[p : p + window] = [True] * window
            seen.add(g)
        kept = b" ".join(x for x, z in zip(w, gone, strict=True) if not z)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "batch"), [(1, 3), (7, 1), (512, 256)])
def test_substrings(docs, group, batch, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CLASSES", ((300, group), (600, group)))
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    want = strike(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = sorted(map(tuple, substring_dedup.dedup_substrings(docs).drop("kept").collect()))
    assert got == want and sum(n for _, _, n, _ in want) > 500


def test_substrings_of_repeated_rows_and_nulls(spark):
    t = " ".join(f"w{i}" for i in range(25))
    d = spark.createDataFrame([(5, t), (5, t), (None, t), (7, None), (9, "a " * 45)], "doc_id long, text string")
    got = sorted((r.id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(d).collect())
    assert got == [(0, 25, 25), (5, 25, 0), (5, 25, 25), (7, 0, 0), (9, 45, 44)]
    apart = sorted((r.id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(d.union(d).repartition(7)).collect())
    assert sum(n for i, _, n in apart if i in (0, 5)) == 25 * 5 and sum(n for i, _, n in apart if i == 9) == 44 + 45
    assert substring_dedup.dedup_substrings(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(d, window=18)


def test_substring_rows_do_not_follow_the_table():
    # The bytes of anchors for a word, with the hashes of a table of 2^18 documents and of one of 2^27: a group sends as many rows, and hashes longer by the logarithm only.
    r = random.Random(4)
    t = pa.table({"id": list(range(512)), "text": [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)) for _ in range(512)], "g": [7] * 512})
    sent = [substring_dedup._probe(bits, 10)(t) for bits in (34, 43)]
    assert len({x.num_rows for x in sent}) == 1 and sent[0].num_rows <= 2**substring_dedup.FIRST
    small, large = (sum(map(len, x.column("a").to_pylist())) for x in sent)
    assert 2.9 <= small / (512 * 291) <= 3.2 and large / small < 1.4
    x = np.sort(np.random.default_rng(1).integers(0, 2**50, 1000).astype(np.uint64))
    for v in (x, x[:1], x[:0]):
        assert (substring_dedup._unpack_sorted(substring_dedup._pack_sorted(v)) == v).all()


def simple_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reach(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints_and_spark_agree(spark, docs):
    rows = docs.collect()
    for r in rows:
        assert simhash.fingerprint((r.text or "").encode()) == simple_fingerprint(r.text)
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(long.encode()) == simple_fingerprint(long)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_groups(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = [0, 0]
    for b in base:
        for _ in range(12):
            b ^= sum({1 << r.randrange(64) for _ in range(r.choice([1, 2, 3, 4, 5]))})
            fps.append(b)
    # One dense group of very many neighbours.
    fps += [base[0] ^ sum(1 << i for i in r.sample(range(20), 2)) for _ in range(150)]
    want = reach(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    d = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in dict.fromkeys(fps)], "fp long")
    comp = {x.node: x.component for x in components.components(simhash.links(d)).collect()}
    got = defaultdict(set)
    for i, f in enumerate(fps):
        s = f - 2**64 if f >= 2**63 else f
        got[comp.get(s, s)].add(i)
    expect = defaultdict(set)
    for i, c in want.items():
        expect[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_every_pattern_of_three_bits_meets():
    fp = np.uint64(0x0123456789ABCDEF)

    def variants(x):
        return {k for b in simhash._balls([pa.RecordBatch.from_arrays([pa.array(np.array([x], np.uint64).view(np.int64))], names=["fp"])]) for k in b.column(0).to_pylist()}

    own = variants(fp)
    assert len(own) == sum(map(len, simhash._FLIPS))
    flips = np.array([1 << i for i in range(64)], np.uint64)
    other = np.array([fp ^ flips[i] ^ flips[j] ^ flips[k] for i in range(64) for j in range(i) for k in range(j)], np.uint64)
    met = np.zeros(len(other), bool)
    for block, ((a, _), keep, flip) in enumerate(zip(simhash._CUTS, simhash._KEEP, simhash._FLIPS, strict=True)):
        k = ((other & keep)[:, None] ^ flip[None, :]) | np.uint64(block << a)
        met |= np.isin(k.view(np.int64), list(own)).any(1)
    assert len(other) == 41_664 and met.all()
    for b in simhash._balls([pa.RecordBatch.from_arrays([pa.array(other[:50].view(np.int64))], names=["fp"])]):
        back = simhash._fingerprints_of(b.column(0).to_numpy(), b.column(1).to_numpy())
        assert set(back.tolist()) == set(other[:50].tolist())


def test_large_groups_are_not_compared_pair_by_pair():
    r = np.random.default_rng(6)
    for width, n in ((21, 3000), (12, 1500)):
        fp = np.unique(r.integers(0, 2**width, n).astype(np.uint64)) << np.uint64(3)
        a, b = simhash._large(fp)
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
        want = reach(range(len(fp)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
        assert (np.bitwise_count(a ^ b) >= 0).all()
        place = {int(x): i for i, x in enumerate(fp)}
        assert reach(range(len(fp)), [(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)]) == want
    took = []
    for n in (20_000, 40_000):
        fp = np.unique(r.integers(0, 2**21, n).astype(np.uint64))
        began = time.perf_counter()
        simhash._large(fp)
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.2


def test_simhash_keeps_one(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: simple_fingerprint(t) for i, t in rows.items()}
    want = reach(rows, [(i, j) for i in rows for j in rows if i < j and (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {r.id: r.component for r in simhash.near_duplicates(docs).collect()} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    twice = docs.union(docs)
    assert simhash.keep_one(twice).count() == len(set(want.values()))
    assert simhash.keep_one(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "something else entirely here")], "doc_id long, text string")
    assert sorted((r.component or 0) for r in simhash.near_duplicates(nulls).collect()) == [0, 4, 4]


def jaccard_groups(rows, shingle=5, similarity=0.8):
    """The root of each (position of a) text by brute force."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [grams(t) for t in rows]
    alike = [(i, j) for j in range(len(sets)) for i in range(j) if (len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) if sets[i] or sets[j] else True)]
    return reach(range(len(rows)), alike)


def test_near_copies_by_similarity(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [None, "", " ", "one", "One", "two words", "a b c d", "A b c  d"]
    for _ in range(60):
        w = r.choices(vocab, k=r.randint(20, 160))
        rows.append(" ".join(w))
        for _ in range(r.randint(0, 5)):  # edits pile up, so groups are chains and some pairs fall below
            w = list(w)
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w))
    w = r.choices(vocab, k=80)
    rows += [" ".join([*w[:i], "x", *w[i + 1 :]]) for i in range(0, 80, 2)]  # one large group
    want = jaccard_groups(rows)
    assert 60 < len(set(want.values())) < len(rows) - 60
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = simhash.keep_one(d, shingle=5, similarity=0.8)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert simhash.keep_one(d.limit(0), shingle=5, similarity=0.8).count() == 0


@pytest.mark.parametrize("options", [{}, {"shingle": 5, "similarity": 0.8}])
def test_rows_that_share_an_id_are_documents_of_their_own(spark, options):
    r = random.Random(9)
    t = [" ".join(f"v{r.randrange(5000)}" for _ in range(40)) for _ in range(8)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (8, t[4]), (None, t[3]), (7, t[3]), (9, t[5]), (3, t[5]), (None, t[6]), (None, t[6])]
    got = sorted((x.doc_id or 0, t.index(x.text)) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (0, 6), (3, 5), (7, 3), (7, 4)]


def test_near_copies_meet_by_fingerprint_first(spark, monkeypatch):
    r = random.Random(13)
    rows = [None, "a b"]
    for k in range(120):  # pairs of texts, so that a link is a pair
        w = [f"f{r.randrange(10**6)}" for _ in range(300)]
        rows.append(" ".join(w))
        for _ in range(k % 8):
            w[r.randrange(len(w))] = f"f{r.randrange(10**6)}"
        rows.append(" ".join(w))
    per, h = set_similarity.shingle_sets(pa.array(rows), 5, set_similarity._NONE)
    fps = []
    for i in range(len(rows)):
        own = wordscan.mix64(h[per[i] : per[i + 1]] ^ np.uint64(0xA0761D6478BD642F)).tolist()
        fps.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own)))
    assert fps == set_similarity.fingerprints(per, h).tolist()
    many = np.random.default_rng(1).integers(0, 2**64, 70_000, dtype=np.uint64)  # more than 16 bits count
    bits = np.unpackbits(wordscan.mix64(many ^ np.uint64(0xA0761D6478BD642F)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) > 35_000
    assert set_similarity.fingerprints(np.array([0, 0, 70_000]), many).tolist() == [0, int("".join("01"[x] for x in bits.tolist()), 2)]
    near = jaccard_groups(rows)
    gone = {i + 1 for i in range(2, len(rows), 2) if near[i] == near[i + 1] and (fps[i] ^ fps[i + 1]).bit_count() <= simhash.RADIUS}
    assert 20 < len(gone) < len(rows) - len(set(near.values()))  # balls find some, the shingles the rest
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {x.doc_id for x in simhash.keep_one(d, shingle=5, similarity=0.8).collect()} == set(near.values())
    monkeypatch.setattr(set_similarity, "REACHES", ())
    assert {x.doc_id for x in simhash.keep_one(d, shingle=5, similarity=0.8).collect()} == set(range(len(rows))) - gone


def test_windows_leave_no_memory_behind():
    h = np.arange(200_000, dtype=np.uint64)
    wordscan.windows(h, 20, 1)
    gc.disable()
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(3):
            wordscan.windows(h, 20, 1)
        assert tracemalloc.get_traced_memory()[0] - before < h.nbytes
    finally:
        tracemalloc.stop()
        gc.enable()


def near_copies(n, seed=12):
    """n texts in families of near copies, some of them just above the threshold and some below."""
    r = random.Random(seed)
    rows = []
    while len(rows) < n:
        w = [f"q{r.randrange(10**6)}" for _ in range(r.randint(150, 300))]
        for _ in range(r.randint(1, 8)):
            w = list(w)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"q{r.randrange(10**6)}"
            rows.append(" ".join(w))
    return rows[:n]


def test_near_copies_leave_little_on_disk(spark, monkeypatch):
    rows = near_copies(1500)
    want = jaccard_groups(rows[:300])
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(d.where("doc_id < 300"), shingle=5, similarity=0.8).collect()) == sorted(set(want.values()))

    def used():
        at = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
        return sum(f.stat().st_size for f in at.rglob("*") if f.is_file())

    before = used()
    assert len({x.doc_id for x in simhash.keep_one(d, shingle=5, similarity=0.8).collect()}) < len(rows)
    assert used() - before < sum(map(len, rows)) / 2
    # In many slices, the same.
    monkeypatch.setattr(set_similarity, "FEW", 20_000)
    monkeypatch.setattr(set_similarity, "SHARE", 0.0)
    monkeypatch.setattr(set_similarity, "ONE_TASK", 40)
    monkeypatch.setattr(set_similarity, "BROADCAST_KEYS", 10)
    assert sorted(x.doc_id for x in simhash.keep_one(d.where("doc_id < 300"), shingle=5, similarity=0.8).collect()) == sorted(set(want.values()))


def test_pairs_that_share_too_little_are_not_verified(spark, monkeypatch):
    r = random.Random(21)
    passage = [f"p{i}" for i in range(40)]

    def words(n):
        return [f"u{r.randrange(10**7)}" for _ in range(n)]

    rows = [" ".join([*words(400), *passage, *words(r.randint(300, 460))]) for _ in range(30)]
    for k in range(0, 24, 2):  # at 0.8 and beside it, by edits and by cutting
        w = words(300 + 40 * k)
        rows.append(" ".join(w))
        for i in r.sample(range(len(w)), len(w) // 45 + k % 5 - 2):
            w[i] = f"e{r.randrange(10**7)}"
        rows.append(" ".join(w))
        w = words(104 + 50 * k)  # 100 + 50 k shingles, of which four fifths make 0.8
        rows += [" ".join(w), " ".join(w[: 4 + (100 + 50 * k) * 4 // 5 - k % 4 // 2])]
    rows += [" ".join([*w[: 7 * i], "x", *w[7 * i + 1 :]]) for i in range(30)]  # a group wider than the reach below
    monkeypatch.setattr(set_similarity, "frequent", lambda *_: set_similarity._NONE)  # so that the passage comes early
    verified, counts = set_similarity._verified, []
    monkeypatch.setattr(set_similarity, "_verified", lambda docs, nodes, pairs, *a: counts.append(pairs.count()) or verified(docs, nodes, pairs, *a))
    want = sorted(set(jaccard_groups(rows).values()))
    assert 50 < len(want) < len(rows) - 35
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = simhash.keep_one(d.where("doc_id < 30"), shingle=5, similarity=0.8)
    assert kept.count() == 30 and not sum(counts)
    for reaches in ((64, 0), (2, 0), (0,)):
        monkeypatch.setattr(set_similarity, "REACHES", reaches)
        assert sorted(x.doc_id for x in simhash.keep_one(d, shingle=5, similarity=0.8).collect()) == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(200, 400)]
    pairs = chain + star + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = reach({x for p in chain + star for x in p}, chain + star)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=700, dim=64, seed=5):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim))
    for i in range(0, n, 3):  # near copies on both sides of the threshold
        e = r.standard_normal(dim)
        v[i] = v[(i * 7) % n] + e * r.uniform(0.05, 0.3) * np.linalg.norm(v[(i * 7) % n]) / np.linalg.norm(e)
    v[-20:] = v[-21]
    v[-60:-30] = v[-61] + 0.02 * r.standard_normal((30, dim))
    return v.astype(np.float32)


def links(v, labels):
    u = v.astype(np.float64)
    n = np.linalg.norm(u, axis=1)
    ok = np.isfinite(n) & (n > 0)
    u[ok] /= n[ok, None]
    same = (labels[:, None] == labels[None, :]) & ok[:, None] & ok[None, :]
    with np.errstate(invalid="ignore"):
        hit = same & (u @ u.T >= 0.98)
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("split_at", [8, 1024])
def test_embeddings(spark, split_at, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SPLIT", split_at)
    v = vectors()
    labels = np.random.default_rng(1).integers(0, 3, len(v))
    labels[-70:] = 1
    rows = [(i, [float(x) for x in e], int(k)) for i, (e, k) in enumerate(zip(v, labels, strict=True))]
    odd = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [None] * 64, 1), (9005, rows[0][1], None), (9006, [1.0, 0.0], 1), (9007, [2.0, 0.0], 1), (9008, [], 1), (None, rows[0][1], 1)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(d).collect()}
    hit = links(v, labels)
    want = hit.sum(1)
    found = np.array([got[i][0] for i in range(len(v))])
    assert (found <= want).all() and found.sum() >= 0.985 * want.sum() and want.sum() > 500
    comp = reach(range(len(v)), [(i, j) for i, j in zip(*np.nonzero(hit), strict=True) if i < j])
    assert np.mean([got[i][1] == comp[i] for i in range(len(v))]) > 0.98
    assert [got[i] for i in (9001, 9002, 9003, 9004, 9005, 9008)] == [(0, i) for i in (9001, 9002, 9003, 9004, 9005, 9008)]
    assert got[9006] == (1, 9006) and got[9007] == (1, 9006) and got[None] == (0, None)
    assert embedding_dedup.link_vectors(d.limit(0)).count() == 0


def test_recall_of_filters():
    r = np.random.default_rng(2)
    a = r.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = r.standard_normal(a.shape)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * e
    for side in (64, 256):
        codes = [embedding_dedup.ProductCode(64, side, k) for k in range(embedding_dedup.CODES)]
        x, y = embedding_dedup.decode(a, side, codes), embedding_dedup.decode(b, side, codes)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]) >= 0.985
        # All exceeding directions and no others.
        c = codes[3]
        turned = a[:5] @ c.turn
        grid = (turned[:, :32] @ c.books[0].T)[:, :, None] + (turned[:, 32:] @ c.books[1].T)[:, None, :]
        for i, g in enumerate(grid):
            assert np.flatnonzero(g.ravel() >= c.threshold).tolist() == [f - c.first for f in x[i].tolist() if c.first <= f < c.first + side * side]


def test_sql_of_substrings_is_the_same(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(substring_dedup.SQL).fetchall()) == strike(sorted(rows))
