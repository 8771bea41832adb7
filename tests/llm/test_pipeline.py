"""The corpus pipeline against a brute-force version, and the registry of queries."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from moraine.llm import decontamination, mixing, quality, simhash, wordscan

NAMES = ["op1_embedding_near_dedup", "op2_benchmark_decontamination", "op3_pii_surrogates", "op4_token_counts", "op5_mix_sources", "op6_substring_dedup", "op7_line_dedup", "op8_simhash_near_dedup", "op9_quality_classifier", "op10_secret_scan"]


def test_registry():
    q = entry.queries()
    assert set(NAMES) | {"pipeline"} <= q.keys() and entry.oracle_sql().keys() <= q.keys()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(600)]

    def sentence():
        return " ".join(r.choices(vocab, k=r.randint(6, 14)))

    items = [(i, " ".join(r.choices(vocab, k=25))) for i in range(8)]
    common = [sentence() for _ in range(4)]
    docs, labels = [], []
    for i in range(500):
        lines = [sentence() for _ in range(r.randint(1, 5))]
        good = r.random() > 0.25
        if not good:
            lines = [" ".join(x + "###" for x in s.split()) for s in lines]
        if r.random() < 0.3:
            lines.insert(r.randint(0, len(lines)), r.choice(common))
        if r.random() < 0.1:
            lines.append(r.choice(items)[1])
        text = "\n".join(lines)
        if i > 40 and r.random() < 0.15:
            text = docs[r.randrange(i)][1]
        docs.append((i, text, r.choice("ab"), r.choice(["s1", "s2", None]), 1))
        labels.append((i, int("###" not in text), 0))
    docs += [(1000, None, "a", "s1", 0), (1001, "", "a", "s2", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def brute(spark, path, docs, items):
    model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    s = model.score(model.features(wordscan.scan(pa.array([d[1] for d in docs], pa.large_string()))))
    rows = {d[0]: [d[1], d[3]] for d, x in zip(docs, s, strict=True) if x >= quality.KEEP}
    first = {}
    for i in sorted(rows):
        for x in (rows[i][0] or "").split("\n"):
            first.setdefault(x.strip(" \t\n\x0b\x0c\r").lower(), i)
    for i, d in rows.items():
        if d[0]:
            d[0] = "\n".join(x for x in d[0].split("\n") if len(k := x.strip(" \t\n\x0b\x0c\r").lower()) < 10 or first[k] == i)
    fps = {i: simhash.fingerprint((d[0] or "").encode()) for i, d in rows.items()}
    root = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i in rows:
            for j in rows:
                if root[i] < root[j] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[j], changed = root[i], True
    rows = {i: d for i, d in rows.items() if root[i] == i}

    def grams(t):
        w = decontamination.words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    rows = {i: d for i, d in rows.items() if not any(len(g & grams(d[0])) >= 0.8 * len(g) for g in (grams(t) for _, t in items))}
    size = {i: len((d[0] or "").encode().split()) for i, d in rows.items()}
    total = Counter()
    for i, d in rows.items():
        total[d[1]] += size[i]
    left, target, weights, open_ = float(sum(total.values())), {}, {}, set(total)
    for k, x in enumerate(sorted(total, key=lambda x: (x is None, x or ""))):
        weights[x] = k % 3 + 1
    while open_:
        share = {x: left * weights[x] / sum(weights[y] for y in open_) for x in open_}
        over = {x for x in open_ if share[x] >= 3 * total[x]}
        target |= {x: 3.0 * total[x] for x in over} if over else share
        left -= sum(3.0 * total[x] for x in over)
        open_ = open_ - over if over else set()
    out = Counter()
    for i, d in rows.items():
        rate = target[d[1]] / total[d[1]] if total[d[1]] else 0.0
        u = int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i, d[0]] = math.floor(rate) + (u < rate - math.floor(rate))
    return +out


def test_pipeline_matches_brute_force(spark, tables):
    path, docs, items = tables
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute(spark, path, docs, items)


def test_stages_one_by_one(spark, tables, tmp_path):
    path, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert Counter(r.doc_id for r in docs.collect()) == Counter(r.doc_id for r in corpus_pipeline.run(spark, path).collect())
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, path)
        assert empty.count() == 0


def test_mix_plan_has_the_sources_of_the_contract(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "c", None)], "doc_id long, text string, source string")
    got = {r.source: (r.source_size, round(r.target, 6)) for r in mixing.mix_plan(d).collect()}
    assert got == {"x": (2, 1.0), None: (1, 2.0)}
