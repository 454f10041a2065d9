import random

import xxhash
from pyspark.sql import functions as F

from voxlake.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, prints):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha Beta gamma Delta epsilon été ñu".split()) for _ in range(400)) for _ in range(6)]
    texts = [None, "", " \n\t", "One", "one", "two Words", *base, *base[:2]]
    for b in base:
        for _ in range(8):
            words = b.split()
            words[rng.randrange(400)] = f"edit{rng.randrange(99)}"
            texts.append(" ".join(words))
    rows = [(i + 3, t, "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.op1_simhash_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_components([r[0] for r in rows], prints)
    assert len(got) == len(rows)
    for (doc_id, *_), p, c in zip(rows, prints, want, strict=True):
        assert (got[doc_id].fingerprint, got[doc_id].component_id) == (f"{p:016x}", c)


def test_links_find_every_pair_within_the_radius_once(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
        prints |= {s ^ 1 << 63, s ^ 1 << 63 ^ 1, s ^ 1 << 63 ^ 1 << 62 ^ 1 << 61, s ^ 0b111}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()]
    p = [signed(x) for x in prints]
    want = {(a, b) for a in p for b in p if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.op1_simhash_near_dedup(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c d", "", ""), (5, "a b c d", "", ""), (2, "a b c d", "", "")], SCHEMA)
    assert [r.component_id for r in simhash.op1_simhash_near_dedup(twice).collect()] == [2, 2, 2]
    kept = simhash.one_of_each(twice)
    assert kept.columns == twice.columns and [r.doc_id for r in kept.collect()] == [2]
    nulls = spark.createDataFrame([(None, "p q r", "", ""), (9, "p q r", "", "")], SCHEMA)
    assert {r.component_id for r in simhash.op1_simhash_near_dedup(nulls).collect()} == {9}
    assert simhash.op1_simhash_near_dedup(nulls.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 2


def test_one_of_each_keeps_one_row_of_every_group(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    rows = [(None, base[0]), (None, base[0]), (None, base[1]), (4, base[2]), (4, base[2]), (4, base[3])]  # null-only groups; one id over unrelated texts
    rows += [(2, base[4]), (6, base[4]), (6, base[5])]  # id 6 is a copy in one group and the least id of another
    rows += [(None, base[6]), (9, base[6]), (11, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "x", f"row {k}") for k, (d, t) in enumerate(rows)], SCHEMA)
    kept = simhash.one_of_each(docs)
    want = [(None, base[0]), (None, base[1]), (4, base[2]), (4, base[3]), (2, base[4]), (6, base[5]), (9, base[6]), (11, None)]
    assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
