"""Token counts, mixing, secrets, surrogates, decontamination and the classifier against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from moraine.llm import decontamination, mixing, pii, quality, secrets, token_counts, wordscan

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=400, seed=1):
    r = random.Random(seed)
    alphabet = list("abcXYZ'’ÉéßΣσİıﬀ\n\t\x1c\x85\xa0  <|>09²½Ωṩ漢字é🙂_-!?") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " "] + ["é", "　", " "]
    return [None, "", " ", "\n", "<|endoftext|>"] + ["".join(r.choices(alphabet, k=r.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [3, 512])
def test_token_counts(spark, chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(token_counts, "BATCH_TASKS", 1 if chunk == 3 else 256)
    monkeypatch.setattr(token_counts, "BATCH_CHUNKS", 2)
    texts = odd_texts() + ["word " * 70_000, " ".join(f"w{i}x{i * 7}" for i in range(3000))]
    tok = Tokenizer.from_file(TOKENIZER)
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[20])] * 2
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, token_counts.count_tokens(d, TOKENIZER).collect())) == want
    assert token_counts.count_tokens(d.limit(0), TOKENIZER).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, token_counts.count_tokens(empty, TOKENIZER).collect())) == [(1, 0, 0), (2, 0, 0)]


def test_token_rows_do_not_follow_the_table():
    # What a chunk sends depends on the chunk alone: as many rows and bytes for a byte of text in the first batch and in one that only a huge table has.
    split = token_counts._tokenizer(TOKENIZER)
    r = random.Random(3)
    sent = []
    for batch in (0, 1 << 30):
        chunk = token_counts._Chunk(10**9)
        for i in range(300):
            t = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(200))
            chunk.add(i, len(t), *split(t))
        rows = chunk.rows(batch)
        assert rows.num_rows <= token_counts.RANGES + 1
        sent.append(rows.nbytes / chunk.size)
    assert abs(sent[0] / sent[1] - 1) < 0.2


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PreTokens(public_tokenizers.path("byte_bpe_50k.json"))


def fill(sizes, weights=(1, 2, 3)):
    """Targets by resharing the excess until none is above three times its source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))) if i % 50 else None, s) for i, s in enumerate(r.choices(["b", "a", "é", "Z", None, "tiny", "𐀀"], [60, 5, 10, 5, 5, 1, 30], k=4000))]
    rows += [(i, "w w", "empty-ish") for i in range(5000, 5002)] + [(6000, "", "nothing")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'mine' as size", "1 as copies")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(dict(sizes))
    plan = mixing.mix_plan(d).collect()
    taken = Counter()
    for p in plan:
        assert p.source_size == sizes[p.source] and math.isclose(p.target, want[p.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= p.copies <= 3
        rate = p.target / p.source_size if p.source_size else 0
        assert math.floor(rate) <= p.copies <= math.ceil(rate)
        taken[p.source] += p.size * p.copies
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.15 * t + 150
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    copies = {p.doc_id: p.copies for p in plan}
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert {x["size"] for x in mixed.collect()} == {"mine"}
    assert mixing.mix(d).count() == mixed.count()
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix_plan(d.limit(0)).count() == 0


def test_mixing_rows_that_ids_do_not_tell_apart(spark):
    rows = [(None, f"w{i} w", "a") for i in range(1000)] + [(i, "w w", "b") for i in range(1000)] + [(5, "same text here now", "c")] * 600 + [(-i % 3, f"x{i} y z", "d") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).cache()
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == len(rows)
    for s in "abcd":
        own = [p for p in plan if p.source == s]
        taken = sum(p.size * p.copies for p in own)
        assert abs(taken - own[0].target) <= 0.1 * own[0].target + 50, (s, taken, own[0].target)
        rate = own[0].target / own[0].source_size
        assert {p.copies for p in own} <= {math.floor(rate), math.ceil(rate)}
    again = mixing.mix_plan(d).collect()
    assert Counter(map(str, again)) == Counter(map(str, plan))


SECRETS = [
    None, "", "nothing here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "PassWord: token = abcdef123", "api_key=short", "apikey='longer.value+1/='", "é🙂 secret:abcdef",
    "AKIA" + "A" * 15, "AKIAAKIA" + "B9" * 10, "x" * 5000 + "f" * 24, "deadbeef" * 3 + "g" + "0" * 23, "tokentoken=aaaaaa bbbbbb", "password==abcdefgh", "api_key  :  \"qwertyu\" and API-KEY=zzzzzzz",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-1234567890-abc", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "\x20token\n=\nabcdefg", "Toﬀken=aaaaaaa Key api_Key=bbbbbbb", "secret=" + "a" * 30_000,
]


def simple_spans(text):
    out = []
    for n, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, m.end(), r.kind))
    return sorted(out)


def test_secrets(spark):
    r = random.Random(5)
    bits = ["token", "Secret", "passwd", "api_key", " ", "=", ":", '"', "'", "AKIA", "ABC123", "deadbeef", "0123456789abcdef", "é", "/", "xyz", "\n", "A" * 18]
    texts = SECRETS + ["".join(r.choices(bits, k=r.randint(1, 30))) for _ in range(500)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[4])], "doc_id long, text string")
    for row in secrets.find_secrets(d).collect():
        assert [tuple(s) for s in row.spans] == simple_spans(row.text), row.text
    assert secrets.find_secrets(d).count() == len(texts) + 3
    assert secrets.find_secrets(d.limit(0)).count() == 0


def test_very_many_hits_in_one_text(spark):
    line = "token=abcdef1 x "
    took = []
    for n in (1000, 10_000, 20_000):
        d = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        began = time.perf_counter()
        [row] = secrets.find_secrets(d).select("spans").collect()
        took.append(time.perf_counter() - began)
        assert [tuple(s) for s in (row.spans[0], row.spans[n // 2], row.spans[-1])] == [(16 * i, 0, 16 * i + 13, "assign") for i in (0, n // 2, n - 1)] and len(row.spans) == n
    assert took[2] < 3.5 * took[1] + 2


def test_trigram_queries_hold_for_every_match():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("(?:foo|ba)r+") is None
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for t in SECRETS:
            if query and t and re.search(rule.pattern, t, re.ASCII):
                assert any(all(g in t.lower() for g in c) for c in query)


def test_surrogates(spark):
    texts = [
        "call +1 (017) 555-7713 or +1-017-555-7713 now", "Foo.Bar9@mail7.example.com, foo.bar9@MAIL7.example.com!", "ip 152.143.123.131### card 4111 1111 1111 1111 and 4111111111111111, 9807915762804490",
        "Mr. Jon Doe met Mr. Doe, Mrs. Anna Doe; господин Иван Петров", None, "", "clean text 12.5 and 1.2.3.", "ssn 123-45-6789 x", "und.34@mail7.example.com geiever", "a" * 50_000 + "@ b",
    ]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    rows = pii.replace_pii(d, "k").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and len({r.text for r in rows if r.doc_id == 0}) == 1
    for i in (4, 5, 6, 9):
        assert got[i].text == texts[i] and got[i].entities == []
    a, b = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4}) now", got[0].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    a, b = re.fullmatch(r"([A-Z]\w+\.[A-Z]\w+\d@\w+\.\w+\.com), (\S+)!", got[1].text).groups()
    assert a.lower() == b.lower() and b.split("@")[1].split(".")[0].isupper() and "Foo" not in got[1].text
    cards = re.findall(r"4\d{3} \d{4} \d{4} \d{4}|\d{16}", got[2].text)
    assert cards[0].replace(" ", "") == cards[1] and cards[2] != "9807915762804490"

    def luhn(x):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0

    assert luhn(cards[1]) and luhn("9807915762804490") == luhn(cards[2])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr\. (\w+), Mrs\. (\w+) (\w+); господин (\w+) (\w+)", got[3].text)
    assert m[2] == m[3] == m[5] and m[1] in pii.GIVEN["latin", "m"] and m[4] in pii.GIVEN["latin", "f"] and m[6] in pii.GIVEN["cyrillic", "m"]
    assert pii.replace_pii(d, "k").orderBy("doc_id").collect() == pii.replace_pii(d, "k").orderBy("doc_id").collect()
    assert {r.text for r in pii.replace_pii(d, "other").collect()} != {r.text for r in rows}
    assert pii.replace_pii(d.limit(0), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    # More surnames than first draws: some must draw again, and keep apart.
    names = [f"{a}{b}{c}" for a in "BCDFGHKLMN" for b in "aeiou" for c in ("rk", "st", "nd", "ll", "mp", "tz")]
    d = spark.createDataFrame([(i, f"Herr {n} and Herr {n}") for i, n in enumerate(names)], "doc_id long, text string")
    out = [re.fullmatch(r"Herr (\S+) and Herr (\S+)", r.text).groups() for r in pii.replace_pii(d, "k").collect()]
    assert all(a == b for a, b in out) and len({a for a, _ in out}) == len(names)
    assert not {a.lower() for a, _ in out} & {n.lower() for n in names}


def bench_items():
    r = random.Random(7)
    vocab = [f"v{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, ". ".join(" ".join(r.choices(vocab, k=r.randint(5, 20))) for _ in range(r.randint(1, 3))) + ".") for i in range(60)]
    return items + [(60, None), (61, ""), (62, "too short one"), (63, items[0][1]), (64, " ".join(r.choices(vocab, k=300)))], vocab


def test_decontamination(spark):
    items, vocab = bench_items()
    r = random.Random(8)
    docs = []
    for i in range(250):
        w = r.choices(vocab, k=r.randint(0, 400))
        if i % 3 == 0:
            own = items[r.randrange(60)][1].split()
            if i % 2:
                own[r.randrange(len(own))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + "!!" if i % 5 == 0 else x for x in own]
        docs.append((i, " ".join(w)))
    docs += [(300, None), (301, ""), (None, items[5][1]), (5, items[5][1]), (302, "a b c d e f " * 9000 + items[64][1]), (303, "this is Too short, one."), (304, "short one too")]
    want = Counter()
    for i, t in docs:
        w = decontamination.words(t)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, text in items:
            own = decontamination.words(text)
            width = min(5, len(own))
            own = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if own else set()
            have = grams if width == 5 else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            if own and len(own & have) / len(own) >= 0.8:
                want[i, j] += 1
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as found")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(d, b)
    rows = got.collect()
    assert got.columns == [*d.columns, "contamination"] and len(rows) == len(docs)
    assert Counter((x.doc_id, c.item_id) for x in rows for c in x.contamination) == want and len(want) > 60
    # An index in several shards finds the same.
    small = decontamination.contaminated(d, b, shard_bytes=3000).collect()
    assert Counter((x.doc_id, c.item_id) for x in small for c in x.contamination) == want
    assert all(x.contamination == [] for x in decontamination.contaminated(d, b.limit(0)).collect())
    assert decontamination.contaminated(d.limit(0), b).count() == 0


def test_question_and_answer_must_both_be_there(spark):
    question = " ".join(f"q{i}" for i in range(48)) + "?"
    answer = "alpha beta gamma delta"
    b = spark.createDataFrame([(1, f"{question} {answer}.")], "item_id long, text string")
    texts = [f"{question} {answer}.", f"x {question} y", f"{question} alpha beta other words", f"{answer} {answer}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: len(r.contamination) for r in decontamination.contaminated(d, b).collect()}
    # The question alone holds 44 of 48 shingles and a BM25 share above the threshold, but the answer is missing.
    [x] = decontamination.build([(1, f"{question} {answer}.")], Counter(set(decontamination.words(f"{question} {answer}"))), 1, 52.0)
    assert sum(float(x.weights[x.term[f"q{i}"]][0]) for i in range(48)) > 0.9
    assert found == {0: 1, 1: 0, 2: 1, 3: 0}


def test_slices_of_postings_change_nothing(monkeypatch):
    items, _ = bench_items()
    items = [(i, t) for i, t in items if t]
    lists = [decontamination.words(t) for _, t in items]
    df = Counter(t for w in lists for t in set(w))
    texts = [decontamination.words(" ".join(t for _, t in items[i : i + 3])) for i in range(0, 60, 2)]
    for x in decontamination.build(items, df, len(items), sum(map(len, lists)) / len(lists)):
        whole = list(x.pivots(texts, 0.5))
        monkeypatch.setattr(decontamination, "ROWS", 7)
        assert sorted(x.pivots(texts, 0.5)) == sorted(whole)
        monkeypatch.setattr(decontamination, "ROWS", 1 << 21)
        # No passage is missed in which an item scores enough.
        step = x.longest
        for d, w in enumerate(texts):
            for begin in range(0, max(1, len(w) - step), step):
                have = {x.term[t] for t in w[begin : begin + 2 * step] if t in x.term}
                if x.retrieve(sorted(have), 0.5):
                    assert any(a == d and b == begin for a, b, _ in whole)


def test_wand_retrieves_all_above_the_threshold():
    items, _ = bench_items()
    items = [(i, t) for i, t in items if t and len(decontamination.words(t)) > 4]
    lists = [decontamination.words(t) for _, t in items]
    df = Counter(t for w in lists for t in set(w))
    for x in decontamination.build(items, df, len(items), sum(map(len, lists)) / len(lists)):
        r = random.Random(1)
        for _ in range(400):
            q = r.sample(range(len(x.term)), r.randint(1, min(60, len(x.term))))
            q = list(set(q) | {x.term[t] for t in r.sample(r.choice(x.tokens), 4)})
            score = np.zeros(len(x.ids))
            for t in q:
                score[x.docs[t]] += x.weights[t]
            share = r.choice([0.1, 0.3, 0.5])
            assert {i for i, _ in x.retrieve(q, share)} == {i for i, s in enumerate(score) if s >= share - 1e-12}


def graded(n=900, seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(5, 60))
        kind = r.randrange(5)
        if kind == 0:
            w = [x + r.choice(["###", "&&&", "$$$"]) for x in w]
        if kind == 1:
            w = [x for x in w[:6] for _ in range(12)]
        rows.append((i, " ".join(w), int(kind > 1)))
    return rows


def test_quality(spark):
    rows = graded()
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "abc"), (3, "x")], "doc_id long, text string").selectExpr("*", "0.0 as c0")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(7, None, 0), (None, 1, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    out = quality.scores(d, model)
    assert out.columns == ["doc_id", "text", "c0", "score"]
    s = {r.doc_id: r.score for r in out.collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i != 3]
    right = [(s[i] >= 0.3) == (rows[i][2] == 1) for i in held]
    assert len(held) > 120 and np.mean(right) > 0.95
    assert all(0 <= x <= 1 for x in s.values()) and s[5000] == s[5001]
    assert out.count() == d.count() and quality.scores(d.limit(0), model).count() == 0
    held_rows = d.select("doc_id", quality.held_out(d.doc_id).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held_rows)
    none = quality.fit(d, labels.limit(0))
    assert {r.score for r in quality.scores(d, none).collect()} == {0.5}


def test_word_vectors_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "FREQUENT", 300)
    rows = graded(200)
    extra = [f"unseen{i % 7} beside{i % 3} " * 3 for i in range(40)]  # documents without labels
    texts = [t for _, t, _ in rows] + extra
    d = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, "")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(d, labels)
    h = wordscan.scan(pa.array(["unseen0 beside1"])).hashes(0)
    at = quality.word_rows(h, model.frequent)
    assert (at >= quality.BUCKETS).all() and at[0] != at[1]
    assert np.allclose(np.linalg.norm(model.words[at], axis=1), 1)
    frequent, words = quality._word_vectors(texts)
    assert 200 < len(frequent) <= 300 and (frequent == model.frequent).all() and (words == model.words).all()
    one = quality.word_rows(np.array([frequent[0], frequent[1] ^ np.uint64(1)], np.uint64), frequent)
    assert one[0] == quality.BUCKETS and one[1] < quality.BUCKETS


def test_quality_is_learnt_alike_each_time():
    rows = graded(300)
    a, b = (quality.train([t for _, t, _ in rows], np.array([y for _, _, y in rows])) for _ in range(2))
    w = wordscan.scan(pa.array([t for _, t, _ in rows]))
    assert (a.score(a.features(w)) == b.score(b.features(w))).all() and hashlib.sha256(a.words.tobytes()).digest() == hashlib.sha256(b.words.tobytes()).digest()
