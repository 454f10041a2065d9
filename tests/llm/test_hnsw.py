import tracemalloc

import numpy as np

from voxlake.llm import hnsw as H

SCHEMA = "vec_id long, embedding array<float>, component_id string"


def plain(rows):
    good = {k: np.array(v, np.float64) for k, (i, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    keys = list(good)
    for a, i in enumerate(keys):
        for j in keys[:a]:
            x, y = good[i], good[j]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= H.COSINE:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for k, r in enumerate(rows):
        ids.setdefault(find(k), []).append(r[0])
    return [(r[0], n[k], min(ids[find(k)])) for k, r in enumerate(rows)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    vectors = [c + rng.normal(scale=s, size=16) for c in centres for s in (0.05, 0.2, 0.3, 0.4, 0.5, 0.6)] + list(rng.normal(size=(150, 16)))
    vectors += [vectors[0]] * 4 + [3 * vectors[1]]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0, 2.0], [1.0, 2.1], [1.0]]
    rows = [(1000 - i, v, "clash") for i, v in enumerate(vectors + odd)]
    got = H.op7_embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(plain(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_and_one(spark):
    assert H.op7_embedding_near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in H.op7_embedding_near_dedup(spark.createDataFrame([(4, [1.0, 0.0], "")], SCHEMA)).collect()] == [(4, 0, 4, True)]


def test_recall_of_a_graph_and_a_dense_group():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(2500, 32)), rng.normal(size=32) + rng.normal(scale=0.15, size=(500, 32))])
    x = H._unit(x).astype(np.float32)
    graph = H.Graph(x)
    beam = H.audited_beam(graph, x[::50], H.COSINE)
    truth = [set(np.nonzero(s >= H.COSINE)[0]) for s in x @ x.T]
    found = graph.within(x, H.COSINE, beam)
    assert sum(len(t & set(f)) for t, f in zip(truth, found)) >= 0.98 * sum(map(len, truth))
    assert all(set(f) <= t for t, f in zip(truth, found))


def test_repeated_and_null_ids(spark):
    rows = [(None, [1.0, 0.0], ""), (5, [1.0, 0.01], ""), (5, [0.0, 1.0], ""), (None, [-1.0, 0.0], ""), (7, [1.0, 0.02], "")]
    got = H.op7_embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (None, 0, None, True), (7, 2, 5, False)], key=key)


def test_audit_judges_where_nothing_is_near():
    x = H._unit(np.random.default_rng(9).normal(size=(3000, 24))).astype(np.float32)
    graph = H.Graph(x)
    own = x[np.linspace(0, len(x) - 1, 64).astype(int)]
    beam = H.audited_beam(graph, own, H.COSINE, 64)
    ids, _ = graph.search(own, beam)
    near = [set(np.argsort(-s, kind="stable")[:8]) for s in own @ x.T]
    assert sum(len(t & set(i)) for t, i in zip(near, ids)) >= 0.99 * 8 * 64


def test_a_search_copies_few_vectors_at_a_time():
    x = H._unit(np.random.default_rng(4).normal(size=(3000, 64))).astype(np.float32)
    graph = H.Graph(x)
    tracemalloc.start()
    graph.search(x[:512], 48)
    peak = tracemalloc.get_traced_memory()[1] - 512 * len(x)  # what each query has seen
    tracemalloc.stop()
    assert peak < 12 << 20, peak
