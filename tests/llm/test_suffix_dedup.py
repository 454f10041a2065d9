import hashlib
import random
from collections import Counter

import pytest

from voxlake.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, tid string, kept string"


def plain(texts, n=S.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice("der the ñandú été of house Straße walk".split()) + str(rng.randrange(50)) for _ in range(n))
    base = [words(rng.randrange(20, 700)) for _ in range(12)]
    texts = [None, "", "short", *base, base[0], base[1], base[1]]
    for b in base:  # near copies
        for _ in range(3):
            w = b.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = words(1)
            texts.append(" ".join(w))
    passages = [words(n)[:k] for n, k in ((90, 399), (90, 400), (90, 401), (90, 405), (100, 480), (120, 600), (200, 900))]
    for p in passages:
        for _ in range(4):
            texts.append(words(rng.randrange(30)) + rng.choice(["", "x", " "]) + p + rng.choice(["", "y"]) + words(rng.randrange(30)))
    twice = words(80)
    texts += [twice + " mid " + twice, "a" * 1500, "ab" * 700 + "c", "a" * 450 + words(40), "line one\n" * 200, words(5) + "line one\n" * 100, "z" * 400, "q" * 401]
    texts += [passages[6][:500] + passages[5][100:560], passages[6][200:700] + passages[6][300:800]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,crowd", [(1, 4096), (2, 1)])
def test_against_brute_force(spark, seed, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    texts = corpus(seed)
    rows = [(i if i != 7 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    got = S.op3_suffix_array_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(str, r))
    want = [(r[0], *p) for r, p in zip(rows, plain(texts))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_passages_and_hot_keys_against_brute_force(spark, monkeypatch):
    """Strings of the pipeline's length; one passage in most texts, so that its keys are known beforehand."""
    monkeypatch.setattr(S, "HOT", 2)
    rng = random.Random(4)
    words = lambda n: " ".join(f"{rng.choice('the ñandú of house'.split())}{rng.randrange(10**4)}" for _ in range(n))
    common, other = words(50), words(45)
    texts = corpus(3) + [words(rng.randrange(60)) + " " + common + " " + words(rng.randrange(60)) for _ in range(150)] + [words(9) + other + words(9)] * 1 + [other[1:-1]]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    assert S.frequent_keys(docs.select(S.text_id(0).alias("tid"), "text"), S.PASSAGE)
    want = plain(texts, S.PASSAGE)
    kept = {r.doc_id: r.text for r in S.without_repeats(docs, S.PASSAGE).collect()}
    lost = {r.row.doc_id: sum(b - a for a, b in r.spans) for r in S.with_removal(docs, S.PASSAGE).collect()}
    assert [lost[i] for i in range(len(texts))] == [w[1] for w in want]
    assert all(kept[i] == t for i, t in enumerate(texts) if not lost[i])
    got = S.op3_suffix_array_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == [(i, *p) for i, p in enumerate(plain(texts))]


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long, "", ""), (2, "head " + long[5000:6000], "", ""), (3, long[-700:], "", "")], SCHEMA)
    got = {r.doc_id: r.n_removed for r in S.op3_suffix_array_dedup(docs).collect()}
    assert got[2] in (1000, 1001) and got[3] == 700 and 1700 <= got[1] <= 1702


def test_anchors_are_a_cover_and_depend_on_content_only():
    rng = random.Random(5)
    data = bytes(rng.randrange(97, 101) for _ in range(3000)) + b"ab" * 300 + bytes(rng.randrange(256) for _ in range(900))
    s, lo, hi = S.anchors(data)
    first = {p: a for a, x, y in zip(s.tolist(), lo.tolist(), hi.tolist()) for p in range(x, y + 1)}
    assert sorted(first) == list(range(len(data) - S.LENGTH + 1))
    assert all(0 <= a - p < S.SPAN for p, a in first.items())
    for p in range(0, len(first), 37):
        t, a, b = S.anchors(data[p : p + S.LENGTH])
        assert t[0] == first[p] - p and (a[0], b[0]) == (0, 0)


def test_kept_texts_and_empty_table(spark):
    rows = [(1, "a" * 500, "", ""), (2, "é" * 300, "", ""), (3, "é" * 300, "", ""), (4, None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "", 2: "", 3: "", 4: None}
    assert S.op3_suffix_array_dedup(df.limit(0)).count() == 0
