import random

from voxlake.llm.suffix_order import suffix_ranks


def test_against_plain_sorting(spark):
    rng = random.Random(11)
    strings = {i * 17: [rng.randrange(2 + i % 3) for _ in range(rng.choice([1, 2, 3, 4, 7, 30]))] for i in range(20)}
    strings |= {9000: [1] * 40, 9001: [0, 1] * 20}
    rows = [(s, p, x) for s, v in strings.items() for p, x in enumerate(v)]
    for depth in (None, 9):
        got = {(r.sid, r.pos): r.rank for r in suffix_ranks(spark.createDataFrame(rows, "sid long, pos long, sym long"), depth).collect()}
        assert len(got) == len(rows)
        cut = depth or 10**6
        order = sorted(got, key=got.get)
        shown = [strings[s][p : p + cut] for s, p in order]
        assert shown == sorted(shown)


def test_empty(spark):
    assert suffix_ranks(spark.createDataFrame([], "sid long, pos long, sym long")).count() == 0
