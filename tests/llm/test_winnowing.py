import hashlib
import random
import re

import xxhash

from voxlake.llm import winnowing as W


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) & W.PRIME for w in words]

    def roll(xs):
        a = 0
        for x in xs:
            a = (a * W.BASE + x) % W.PRIME
        return a

    if not hs:
        return []
    grams = [roll(hs)] if len(hs) < W.GRAM else [roll(hs[i : i + W.GRAM]) for i in range(len(hs) - W.GRAM + 1)]
    out = []
    for i in range(max(1, len(grams) - W.WINDOW + 1)):
        low = min(grams[i : i + W.WINDOW])
        at = max(j for j in range(i, min(len(grams), i + W.WINDOW)) if grams[j] == low)
        if (low, at) not in out:
            out.append((low, at))
    return out


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, ranges):
    got = W.op5_document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"), ranges).collect()
    spread = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) % 2**31
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spread(r[1]), r[1] or ""))
    want = []
    for i, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        f, e = plain(text), plain(edited)
        show = lambda x: " ".join(f"{h:x}@{p}" for h, p in x)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(f), show(e), near(f, e), near(f, plain(after))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 101, " ".join(rng.choice("a b cc ddé ñ 😀 the of".split()) + str(rng.randrange(9)) for _ in range(n)), "x") for i, n in enumerate([0, 1, 2, 4, 5, 6, 11, 12, 13, 14, 40, 200, 1000, 3, 7])]
    rows += [(500, None, ""), (501, "", ""), (502, " \n ", ""), (503, "ab", ""), (504, "same same " * 60, ""), (504, "same same " * 60, ""), (504, "other", "")]
    check(spark, rows, 4)
    check(spark, rows[:1], 3)
    check(spark, rows[:2] + [(None, "no id here at all", "")], 5)


def test_hot_ids_and_many_ranges(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(9)))
    rows = [(rng.choice([None, 7, 7, -3, rng.randrange(1000)]), text(), "") for _ in range(1500)]
    check(spark, rows, 40)
    check(spark, rows, 10_000)
    edges, parts, first = W.plan_ranges([1, 5, 5, 5, 9], 50, 100, 6)
    assert edges == [1, 4, 5, 9] and parts == [1, 1, 3, 1, 1, 3] and first == [6, 5, 2, 1, 0, 7]


def test_one_id_for_every_row(spark):
    docs = spark.range(100_000).selectExpr("CAST(5 AS BIGINT) AS doc_id", "concat('t', id) AS text")
    out = W.with_successor(docs, {"next": "text"}, 64)
    assert out.select("text", "next").distinct().count() == 100_000 == out.select("next").distinct().count()


def test_very_long_text(spark):
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    got = {r.doc_id: r for r in W.op5_document_fingerprints(spark.createDataFrame([(1, long), (2, "short text")], "doc_id long, text string"), 4).collect()}
    assert got[1].n_chars == len(long) and got[1].fingerprint.startswith(" ".join(f"{h:x}@{p}" for h, p in plain(long[:3000])[:20]))


def test_empty_table(spark):
    assert W.op5_document_fingerprints(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_match_guarantee_and_equal_texts(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(W.GRAM + W.WINDOW - 1)
    texts = [" ".join(words(rng.randrange(30)) + shared + words(rng.randrange(30))) for _ in range(20)]
    df = W.with_hashes(W.with_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "c"), "c", "h")
    sets = [set(r.h) for r in df.collect()]
    assert set.intersection(*sets)
