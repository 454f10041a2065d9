import itertools
import random
import zlib

import numpy as np

from voxlake.llm import quality as Q


def corpus(n):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice("the of and house river walked Slowly under".split()) for _ in range(rng.randrange(4, 12))) + "." for _ in range(rng.randrange(1, 9))]
        bad = rng.random() < 0.3
        if bad:
            at = rng.randrange(len(lines))
            lines[at:] = [" ".join(rng.choice(["###x", "%%%", "a | b |", "BUY!!"]) for _ in range(12)) for _ in range(6)]
        rows.append((i, "\n".join(lines), int(not bad)))
    return rows


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 4, 5])
    emit, steps = rng.normal(size=(4, 5, 2)), rng.normal(size=(2, 2))
    state, pairs = Q.marginals(emit, steps, lengths)
    for c, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.exp([sum(emit[c, i, s] for i, s in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        for i in range(n):
            assert np.isclose(state[c, i, 1], sum(w for w, p in zip(weight, paths) if p[i]))
        want = np.zeros((2, 2))
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                want[a, b] += w
        assert np.allclose(pairs[c], want)
        assert not state[c, n:].any()


def test_held_out_accuracy_edges_and_filter(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9000, None, ""), (9001, "", ""), (None, "### %%%", ""), (9002, "word " * 50_000, ""), (9003, "\n" * 3000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5] + [(9000, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.op4_quality(docs, labels).collect()}
    assert len(got) == len(rows) + 5
    held = [(got[i].predicted, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9000].score == got[9001].score
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in Q.op4_quality(docs, none).collect()] == [(0.5, 1)]
    assert Q.op4_quality(docs.limit(0), none).count() == 0


def test_results_of_the_query_against_all_labellings(spark):
    """Scores from the sum over every labelling of the lines, one document at a time."""
    rows = [(i, "\n".join(t.split("\n")[:6]), q) for i, t, q in corpus(120)] + [(900, None, 0), (901, "", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    field = Q.learn(docs, labels)
    got = {r.doc_id: r for r in Q.op4_quality(docs, labels).collect()}
    for i, text, _ in rows[:25] + rows[-2:]:
        x, size = Q.line_features(text)
        emit, n = x @ field.weights, len(x)
        good, whole = np.zeros(n), 0.0
        for states in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(emit[k, s] for k, s in enumerate(states)) + sum(field.steps[a, b] for a, b in zip(states, states[1:])))
            whole += weight
            good += weight * np.array(states)
        share = (good / whole * size).sum() / size.sum()
        want = 1 / (1 + np.exp(-field.slope * (share - field.middle)))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == int(want >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_a_repeated_id_and_clashing_columns(spark):
    rows = [(i, t, "a", 1.0) for i, t, _ in corpus(60)] + [(0, f"again {k}", "b", 2.0) for k in range(300)] + [(None, "no id", "c", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, _score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in corpus(60)], "doc_id long, quality int")
    assert Q.op4_quality(docs, labels).count() == len(rows)
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r._score for r in kept.collect()} <= {1.0, 2.0, 3.0}
