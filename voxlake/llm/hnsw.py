"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node with a count. Nodes are dealt to shards by a hash;
their number follows ``SHARD_ROWS``. A task builds the graph of its shard and
answers the queries of all nodes, which stream through in batches, so a task
holds one shard and one batch. Searches of a batch run in lockstep.

Two rules widen the beam. Before a shard answers, an audit compares the answers
for a sample of its own nodes and of the first queries with brute force over the shard
and doubles the beam until the recall reaches ``AUDIT_RECALL``; at the size of
the shard the search is exhaustive. And a query whose beam is filled by links
to more than half is asked again with a beam four times as wide. A pair is found from either
side. Every pair is verified by cosine in double precision before it counts.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; vectors of different lengths never
link; equal vectors link; rows with equal or null vec_id are rows of their own
(a null is never a component's id while a non-null one exists); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ship, stash

ship(__name__)

COSINE = 0.9
SHARD_ROWS = 100_000
MIN_SHARDS = 6
LINKS = 12
BUILD_BEAM = 64
BEAM = 48
AUDIT = 64
AUDIT_RECALL = 0.99
BATCH = 512
_SLACK = 1e-4
#: Nodes that a step of a search expands; a similarity is held in so many steps for each unit, a node's number in 32 bits.
WIDE = 4
_STEPS = 1 << 28
_NODE = (1 << 32) - 1
_CACHED = 1 << 19


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` of ``x`` with rows ``j`` of ``y``, by as many at a time as stay in a processor's cache."""
    out, step = np.empty(len(i), np.float32), max(1, _CACHED // max(1, x[:1].nbytes))
    for a in range(0, len(i), step):
        out[a : a + step] = np.vecdot(x.take(i[a : a + step], 0), y.take(j[a : a + step], 0))
    return out


def _keys(sims: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Numbers in the order of the similarities, each with its node and, in the last bit, that it is to be expanded."""
    return ((np.clip(sims, -1.5, 1.5).astype(np.float64) + 2) * _STEPS).astype(np.int64) << 33 | nodes << 1 | 1


class Graph:
    """Layers of links over unit vectors; layer 0 holds all nodes, each layer above about one in LINKS."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.x = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (members, links as rows of node numbers, -1 for none)
        self.row: list[np.ndarray] = []
        for level in range(int(height.max(initial=0)) + 1):
            members = np.nonzero(height >= level)[0]
            place = np.full(n, -1)
            place[members] = np.arange(len(members))
            self.row.append(place)
            self.layers.append((members, np.full((len(members), LINKS * (2 if level == 0 else 1)), -1, np.int64)))
        order = np.argsort(-height, kind="stable")
        self.entry = int(order[0]) if n else -1
        done, at = 1, 1
        while at < n:
            # a batch may be as large as what is there; its nodes also see each other
            new = order[at : at + min(256, max(1, done))]
            self._insert(new, height)
            at += len(new)
            done += len(new)

    def _insert(self, new: np.ndarray, height: np.ndarray) -> None:
        entries = np.full(len(new), self.entry)
        peers = self.x[new] @ self.x[new].T
        np.fill_diagonal(peers, -2)
        for level in range(len(self.layers) - 1, -1, -1):
            takes = height[new] >= level
            width = np.where(takes.any(), BUILD_BEAM if level == 0 or takes.any() else 1, 1)
            ids, sims = self._search_layer(self.x[new], entries, level, int(width))
            entries = np.where(ids[:, 0] >= 0, ids[:, 0], entries)
            if not takes.any():
                continue
            mine = np.nonzero(takes)[0]
            inside = peers[np.ix_(mine, mine)]
            k = min(len(mine), 2 * LINKS)
            near = np.argsort(-inside, 1, kind="stable")[:, :k]
            all_ids = np.hstack([ids[mine], np.where(np.take_along_axis(inside, near, 1) > -2, new[mine][near], -1)])
            all_sims = np.hstack([sims[mine], np.take_along_axis(inside, near, 1)])
            chosen = self._diverse(all_ids, all_sims, LINKS)
            self._connect(new[mine], chosen, level)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row's node than to any chosen one; then the nearest of the rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), 1, kind="stable")[:, : 4 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        between = np.empty((*ids.shape, ids.shape[1]), np.float32)
        step = max(1, _CACHED // max(1, ids.shape[1] * self.x[:1].nbytes))
        for a in range(0, len(ids), step):
            v = self.x[np.maximum(ids[a : a + step], 0)]
            between[a : a + step] = v @ v.transpose(0, 2, 1)
        b, c = ids.shape
        chosen, count = np.zeros((b, c), bool), np.zeros(b, int)
        for j in range(c):
            blocked = (chosen & (between[:, :, j] >= sims[:, j : j + 1])).any(1)
            take = (ids[:, j] >= 0) & ~blocked & (count < most)
            chosen[:, j] = take
            count += take
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
        pick = np.argsort(rank, 1)[:, :most]
        return np.take_along_axis(ids, pick, 1)

    def _connect(self, nodes: np.ndarray, chosen: np.ndarray, level: int) -> None:
        _, links = self.layers[level]
        place = self.row[level]
        links[place[nodes], : chosen.shape[1]] = chosen
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
        width = int(counts.max(initial=0))
        if not width:
            return
        extra = np.full((len(heads), width), -1, np.int64)
        extra[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
        old = links[place[heads]]
        known = (old[:, :, None] == extra[:, None, :]).any(1)
        both = np.hstack([old, np.where(known, -1, extra)])
        cap = links.shape[1]
        both = -np.sort(-both, 1)
        full = (both >= 0).sum(1) > cap
        links[place[heads[~full]], : both.shape[1]] = both[~full, :cap]
        if full.any():
            tight, centre = both[full], heads[full]
            sims = _dots(self.x, np.maximum(tight, 0).ravel(), self.x, np.repeat(centre, tight.shape[1])).reshape(tight.shape)
            links[place[centre]] = self._diverse(tight, sims, cap)

    def _search_layer(self, q: np.ndarray, entries: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (queries, beam) of node numbers and similarities, best first.

        A beam is a sorted row of numbers that hold similarity, node and whether it is still to be expanded, so that one
        plain sort orders all three."""
        links, place, b, n = self.layers[level][1], self.row[level], len(q), len(self.x)
        wide, width = 1 if beam == 1 else WIDE, links.shape[1]
        state = np.full((b, beam), -1, np.int64)
        state[:, -1] = _keys(np.einsum("bd,bd->b", self.x[entries], q), entries)
        # by query and node 0, or one more than the column of the step that named it first
        seen = np.zeros(b * n, np.int8)
        seen[np.arange(b) * n + entries] = 1
        live = np.arange(b)
        while len(live):
            now = state[live]
            open_ = ((now & 1) == 1) & (now >= 0)
            rank = np.cumsum(open_[:, ::-1], 1, dtype=np.int16)[:, ::-1]
            rows, cols = np.nonzero(open_ & (rank <= wide))
            some = now[rows, cols]
            now[rows, cols] = some - 1
            near = links[place[some >> 1 & _NODE]]
            at, j = np.nonzero(near >= 0)
            found, row = near[at, j], rows[at]
            column = (rank[rows, cols][at] - 1) * width + j
            spot = live[row] * n + found
            fresh = np.flatnonzero(seen[spot] == 0)
            found, row, column, spot = found[fresh], row[fresh], column[fresh], spot[fresh]
            # a node that two of the expanded ones name counts once
            seen[spot] = column + 1
            first = np.flatnonzero(seen[spot] == column + 1)
            found, row, column = found[first], row[first], column[first]
            more = np.full((len(live), wide * width), -1, np.int64)
            more[row, column] = _keys(_dots(self.x, found, q, live[row]), found)
            both = np.hstack([now, more])
            both.sort(1)
            state[live] = both = both[:, -beam:]
            live = live[(((both & 1) == 1) & (both >= 0)).any(1)]
        state = state[:, ::-1]
        return np.where(state >= 0, state >> 1 & _NODE, -1), np.where(state >= 0, (state >> 33) / _STEPS - 2, -2).astype(np.float32)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full(len(q), self.entry)
        for level in range(len(self.layers) - 1, 0, -1):
            entries = self._search_layer(q, entries, level, 1)[0][:, 0]
        return self._search_layer(q, entries, 0, beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Nodes at least ``least`` similar to each query; beams widen until under half of them is filled by such nodes."""
        n, out = len(self.x), [np.zeros(0, np.int64)] * len(q)
        todo = np.arange(len(q))
        while len(todo):
            if beam >= n:
                for i in range(0, len(todo), 64):
                    part = todo[i : i + 64]
                    sims = q[part] @ self.x.T
                    for k, r in enumerate(part):
                        out[r] = np.nonzero(sims[k] >= least)[0]
                return out
            ids, sims = self.search(q[todo], beam)
            good = (sims >= least) & (ids >= 0)
            for k, r in enumerate(todo):
                out[r] = ids[k][good[k]]
            todo = todo[good.sum(1) * 2 > beam]
            beam *= 4
        return out


def audited_beam(graph: Graph, q: np.ndarray, least: float, own: int = 0, beam: int = BEAM) -> int:
    """The beam, doubled until the sample's links are found with recall AUDIT_RECALL.

    The first ``own`` queries are nodes of the graph; that one finds itself says nothing, so it does not count. Where
    fewer than AUDIT links are left to judge by, so are the AUDIT nearest nodes of each query, linked or not."""
    truth = [set(np.nonzero(s >= least)[0]) for s in q @ graph.x.T]
    alike = graph.x @ graph.x[np.linspace(0, len(graph.x) - 1, own).astype(int)].T if own else None
    for k in range(own):
        truth[k] -= set(np.nonzero(alike[:, k] >= 1 - 1e-6)[0])
    if sum(map(len, truth)) < AUDIT:
        near = min(AUDIT // 8, len(graph.x))
        truth = [set(np.argsort(-s, kind="stable")[:near]) for s in q @ graph.x.T]
        while beam < len(graph.x):
            ids, _ = graph.search(q, beam)
            if sum(len(t & set(i)) for t, i in zip(truth, ids)) >= AUDIT_RECALL * sum(map(len, truth)):
                break
            beam *= 2
        return beam
    while beam < len(graph.x):
        found = sum(len(t & set(f)) for t, f in zip(truth, graph.within(q, least, beam)))
        if found >= AUDIT_RECALL * sum(map(len, truth)):
            break
        beam *= 2
    return beam


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    cosine = np.einsum("kd,kd->k", x, y) / (np.sqrt(np.einsum("kd,kd->k", x, x)) * np.sqrt(np.einsum("kd,kd->k", y, y)))
    keep = (cosine >= COSINE) & (ids != other_ids)
    a, b = ids[keep], other_ids[keep]
    return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)})


def _answers(frames):
    """Of partitions sorted by shard, its nodes before the queries: the verified links of every query."""
    shard, nodes, asked, graph = None, [], [], None

    def build():
        ids = np.array([i for i, _ in nodes], np.int64)
        x = np.stack([v for _, v in nodes])
        g = Graph(_unit(x).astype(np.float32))
        return [ids, x, g, None]

    def ask():
        ids, x, g, beam = graph
        q_ids, q = np.array([i for i, _ in asked], np.int64), np.stack([v for _, v in asked])
        units = _unit(q).astype(np.float32)
        if beam is None:
            own = g.x[np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int)]
            beam = graph[3] = audited_beam(g, np.vstack([own, units[:AUDIT]]), COSINE - _SLACK, len(own))
        found = g.within(units, COSINE - _SLACK, beam)
        sizes = np.array([len(f) for f in found])
        asked.clear()
        hits = np.concatenate(found) if sizes.sum() else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(q)), sizes)
        return _verified(q_ids[rows], q[rows], ids[hits], x[hits])

    for frame in frames:
        for s, kind, i, v in zip(frame["shard"], frame["kind"], frame["node"], frame["vector"]):
            if s != shard:
                if asked:
                    yield ask()
                shard, graph = s, None
                nodes.clear()
            v = np.asarray(v, np.float64)
            if kind == 0:
                nodes.append((i, v))
                continue
            if graph is None:
                if not nodes:  # a shard that no node fell to
                    continue
                graph = build()
                nodes.clear()
            asked.append((i, v))
            if len(asked) == BATCH:
                yield ask()
    if asked:
        yield ask()


def context_cores(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def links(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs ``(u, v)`` of nodes ``(node, vector)`` with cosine of at least COSINE."""
    n = nodes.count()
    shards = max(MIN_SHARDS, -(-n // shard_rows))
    # a task holds a shard and answers one part of the queries: its number is the partition's, so tasks come out even
    parts = max(1, context_cores(nodes) // shards)
    sizes = sorted(r["d"] for r in nodes.select(F.size("vector").alias("d")).distinct().collect())
    place = F.array_position(F.array(*map(F.lit, sizes or [0])), F.size("vector")).cast("int") - 1
    keyed = nodes.withColumn("own", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).withColumn("lot", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int")).withColumn("d", place)
    number = (F.col("d") * shards + F.col("k")) * parts + F.col("q")
    every = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    own = keyed.withColumn("k", F.col("own")).withColumn("q", F.explode(every(parts))).select(number.alias("shard"), F.lit(0).alias("kind"), "node", "vector")
    asks = keyed.withColumn("k", F.explode(every(shards))).withColumn("q", F.col("lot")).select(number.alias("shard"), F.lit(1).alias("kind"), "node", "vector")
    dealt = own.unionByName(asks).repartitionById(max(1, len(sizes)) * shards * parts, "shard").sortWithinPartitions("shard", "kind", "node")
    return dealt.mapInPandas(_answers, "u long, v long").distinct()


def op7_embedding_near_dedup(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    valid = F.coalesce(F.when(F.size("vector") > 0, finite).otherwise(F.lit(False)), F.lit(False))
    rows = rows.withColumn("ok", valid).withColumn("ok", F.when(F.col("ok"), (norm > 0) & (norm < F.lit(float("inf")))).otherwise(F.lit(False)))
    groups = rows.where("ok").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    groups = stash(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    pairs = stash(links(groups.select("node", "vector")), "vector-links")
    sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counted = sides.join(groups.select(F.col("node").alias("v"), "n"), "v").groupBy("u").agg(F.sum("n").alias("linked")).withColumnRenamed("u", "node")
    roots = groups.select("node", "first_id", "n").join(components(pairs), "node", "left").select("node", "first_id", "n", F.coalesce("root", "node").alias("root"))
    named = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = groups.select("node", "vector").join(roots.join(named, "root"), "node").join(counted, "node", "left")
    told = told.select("vector", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    met = rows.where("ok").join(told, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
