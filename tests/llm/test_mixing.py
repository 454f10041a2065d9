import random
import zlib
from collections import Counter

import numpy as np
import pytest

from voxlake.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, rate string"


def corpus(n):
    rng = random.Random(10)
    words = {"en": "the of and to it", "de": "der die und zu es", "fr": "le la et de il", "es": "el los y para lo"}
    return [(i, " ".join(rng.choice((words[d] + " x y z").split()) for _ in range(rng.randrange(5, 120))), d, "clash") for i in range(n) for d in [rng.choice(["en"] * 6 + ["de", "fr", "es"])]]


def labelled(df):
    return df.where("lang IS NOT NULL").selectExpr("doc_id", "lang AS domain")


def test_rates_match_targets(spark):
    rows = corpus(400) + [(900, None, None, ""), (901, "", None, ""), (902, "y z", None, ""), (3, "the the the", "en", ""), (903, "der " * 30_000, None, ""), (None, "la et", None, ""), (None, "le la", None, "")]
    df = spark.createDataFrame(rows + rows[5:7], SCHEMA)
    got = M.op2_mixing(df, labelled(df)).toPandas()
    assert len(got) == len(rows) + 2
    p = got[["p_de", "p_en", "p_es", "p_fr"]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    expected = (got.rate * got.n_tokens).to_numpy() @ p
    want = np.array([M.TARGETS[d] for d in ("de", "en", "es", "fr")])
    assert np.allclose(expected / expected.sum(), want, atol=3e-3)
    assert (got.rate >= 0).all() and (got.copies >= np.floor(got.rate)).all() and (got.copies <= np.ceil(got.rate)).all()
    out = M.mixed(df, labelled(df))
    assert out.columns == df.columns and out.count() == got.copies.sum()


def test_fit_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    tokens = rng.integers(1, 500, 60)
    members = spark.createDataFrame([(str(i), i, 1, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p))], "key string, text_hash long, copies_in long, n_tokens long, p0 double, p1 double, p2 double")
    for weights in ([0.2, 0.3, 0.5], [0.05, 0.15, 0.8]):
        rates, told = M.fit_rates(members, weights, budget=float(tokens.sum()), tolerance=1e-4)
        r = np.array([x.rate for x in sorted(rates.collect(), key=lambda x: int(x.key))])
        a, goal = (p * tokens[:, None]).T, np.array(weights) * tokens.sum()
        s, have = np.ones(60), a.sum(1)
        for _ in range(20_000):  # the same problem, plainly, to the end
            s = np.maximum(0, s - p @ ((a @ s - goal) / have))
        assert (r >= 0).all()
        loss = lambda x: (((a @ x - goal) ** 2) / have).sum()
        assert loss(r) <= loss(s) + 1e-4 * (goal.sum()) and loss(r) < loss(np.ones(60))


def test_absent_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", None, ""), (2, None, None, "")], SCHEMA)
    got = M.op2_mixing(df, labelled(df)).collect()
    assert len(got) == 2
    one = spark.createDataFrame([(1, "a b", "en", ""), (2, "c", None, "")], SCHEMA)
    assert all(r.p_en == 1 and r.rate == 1 for r in M.op2_mixing(one, labelled(one)).collect())
    assert M.op2_mixing(df.limit(0), labelled(df)).count() == 0
    assert M.mixed(df.limit(0), labelled(df)).count() == 0


def test_results_of_the_query_against_plain_bayes_and_copies(spark):
    """Posteriors by counting words in Python; rates from these; copies from rates; every row there, empty texts too."""
    rng = random.Random(31)
    words = {"en": "the and of house".split(), "de": "der und von haus".split(), "fr": "le et de maison".split(), "es": "el y de casa".split()}
    rows = []
    for k in range(160):
        lang = rng.choice(["en"] * 5 + ["de", "fr", "es"])
        rows.append((k, " ".join(rng.choice(words[lang] + ["zz"]) for _ in range(rng.randrange(1, 30))), lang if k % 2 else None))
    rows += [(500, None, None), (501, "", None), (3, rows[3][1], "en"), (None, "der haus", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = M.op2_mixing(docs, docs.where("lang IS NOT NULL").selectExpr("doc_id", "lang AS domain")).collect()
    domains = sorted(M.TARGETS)
    learned = {}
    for i, t, lang in rows:
        if lang and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[i] = (t or "", lang)
    counts = {d: Counter() for d in domains}
    for t, lang in learned.values():
        counts[lang].update(t.split())
    known = set().union(*counts.values())
    size = Counter(lang for _, lang in learned.values())

    def posterior(text):
        logs = []
        for d in domains:
            total = sum(counts[d].values()) + len(known) + 1
            logs.append(np.log(size[d] / len(learned)) + sum(np.log((counts[d][w] + 1) / total) for w in (text or "").split() if w in known))
        e = np.exp(np.array(logs) - max(logs))
        return e / e.sum()

    key = lambda r: (str(r[0]), r[1])
    want = sorted(((i, len((t or "").split()), posterior(t)) for i, t, _ in rows), key=key)
    got = sorted(got, key=key)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, n) for i, n, _ in want]
    for r, (_, _, p) in zip(got, want):
        assert np.allclose([r[f"p_{d}"] for d in domains], p, atol=1e-9)
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    mass = np.array([r.n_tokens * r.rate * p for r, (_, _, p) in zip(got, want)]).sum(0)
    off = np.abs(mass / mass.sum() - [M.TARGETS[d] for d in domains]).max()
    assert off < 0.01 and all(r.fit_error <= M.TOLERANCE for r in got)


def test_a_target_out_of_reach_is_reported(spark):
    members = spark.createDataFrame([(1, 10, 0.5, 0.5, 1)], "key long, n_tokens long, p0 double, p1 double, copies_in long")
    with pytest.warns(UserWarning):
        _, told = M.fit_rates(members, [0.9, 0.1])
    assert told["error"] > M.TOLERANCE
