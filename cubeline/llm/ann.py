"""Nearest neighbours by inner product over sharded HNSW graphs.

Vectors are dealt to shards of bounded size by a hash of their id. In each shard
a hierarchical navigable small-world graph is built (Malkov and Yashunin 2016):
levels are drawn from a hash of the id with geometric chances; a level's
candidates are its nearest vectors, found in blocks of matrix products, which a
bounded shard allows; the diversity rule thins them, and edges back are thinned
likewise. A graph is stored as flat neighbour arrays, one fixed-width row of
positions for each vector and level, -1 where there is none.

Nearest candidates alone would close a dense group of vectors upon itself, so
equal vectors, and dense groups within a small radius, are one node of the graph
(their first vector), and a search scores all members of the nodes that it finds.
Beside its neighbours each node has long edges: both ways along a random ring,
so that every level is strongly connected, and to the nearest of thinner and
thinner random samples.

Inner product becomes Euclidean distance by one more component, the root of what
the largest squared norm leaves (Bachrach et al. 2014), so the graph is metric
for any norms.

Queries come in blocks of bounded size, twice that of a shard, so a graph travels
once for so many queries: until these fill a second block (with one query for each
20 vectors, at about 330,000 vectors) the shuffle grows in proportion to the table,
and beyond that by about a sixth of a byte for each query and vector, as every
shard must be searched. Each (shard, block) is a task of its own:
a greedy descent through the upper levels and a best-first search with ``ef``
candidates on the lowest, for the whole block at once. Scores are computed again
in double precision on the original vectors, and the shards' results are merged
by score, then id; the merge is pre-aggregated by shard: each brings at most k.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part; nor do vectors of another length than the most common
one; rows that repeat an id count as one (the first by value); null ids take no
part; a query never finds its own id; with k candidates or fewer all are returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .scratch import Scratch

SHARD = 8192
BLOCK = 16384
M = 16
EF = 192
K = 20
#: Long edges of a node on each level, beside its neighbours: two along the ring, two to each of the samples.
LONG = 8
#: The squared radius of a dense group that is one node, as a part of the mean squared distance in the shard.
TIGHT = 0.01
#: lead: the position of the node's vector; the others of a node have no edges.
NODES = "shard long, pos int, vec_id long, lead int, level int, vector binary, lower binary, upper binary"
FOUND = "query_id long, vec_id long, score double"


def _level(ids: np.ndarray, m: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    u = (x >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.minimum(-np.log(u + 1e-18) / np.log(m), 8).astype(int)


def _thin(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """The diversity rule for many vectors at once: a candidate (in order of distance) is kept if it is nearer
    to the vector than to each kept one, not as near; free places then go to the nearest that were passed over."""
    n, c = cand.shape
    kept = np.zeros((n, c), bool)
    count = np.zeros(n, int)
    near = x[np.maximum(cand, 0)]
    gram = np.einsum("ncd,ned->nce", near, near)
    norm = np.einsum("ncc->nc", gram)
    between = norm[:, :, None] + norm[:, None, :] - 2 * gram
    for j in range(c):
        clash = (kept[:, :j] & (between[:, j, :j] <= dist[:, j, None])).any(1) if j else np.zeros(n, bool)
        kept[:, j] = (cand[:, j] >= 0) & ~clash & (count < width)
        count += kept[:, j]
    rank = np.where(kept, 0, np.where(cand >= 0, 1, 2)) * (c + 1) + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :width]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, width - out.shape[1]))), constant_values=-1)


def _metric(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """The vectors with one more component, about their mean, which no distance depends on."""
    more = np.sqrt(np.maximum(norm2 - (vectors * vectors).sum(1), 0))
    x = np.hstack((vectors, more[:, None]))
    return (x - x.mean(0)).astype(np.float32)


def leaders(vectors: np.ndarray, norm2: float, candidates: int) -> np.ndarray:
    """The position of each vector's node: the first of its copies, or of a group within a small radius that would fill ``candidates``."""
    _, first, of = np.unique(vectors + 0.0, axis=0, return_index=True, return_inverse=True)
    same = first[of.ravel()]
    tops = np.unique(same)
    x = _metric(vectors[tops], norm2)
    square = (x * x).sum(1)
    radius = TIGHT * 2 * float(square.mean())
    dense = np.zeros(len(tops), bool)
    for a in range(0, len(tops), 512):
        d = square[a : a + 512, None] + square[None, :] - 2 * x[a : a + 512] @ x.T
        dense[a : a + 512] = (d <= radius).sum(1) > candidates
    lead = np.full(len(tops), -1)
    for v in np.flatnonzero(dense):
        if lead[v] < 0:
            near = (lead < 0) & (square + square[v] - 2 * x @ x[v] <= radius)
            lead[near], lead[v] = v, v
    lead = np.where(lead < 0, np.arange(len(tops)), lead)
    return tops[lead][np.searchsorted(tops, same)]


def _long(own: np.ndarray, square: np.ndarray) -> np.ndarray:
    """LONG positions for each vector: before and after it on a random ring, and the nearest two of random samples, each an eighth of the one before."""
    n = len(own)
    ring = np.random.RandomState(n).permutation(n)
    at = np.empty(n, int)
    at[ring] = np.arange(n)
    out = [ring[(at + 1) % n][:, None], ring[at - 1][:, None]]
    for scale in range(1, LONG // 2):
        some = ring[: max(3, n >> 3 * scale)]
        near = np.empty((n, min(2, len(some))), int)
        for a in range(0, n, 512):
            d = square[some] - 2 * own[a : a + 512] @ own[some].T
            d[some[None, :] == np.arange(a, min(a + 512, n))[:, None]] = np.inf
            near[a : a + 512] = some[np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]]
        out.append(near)
    out = np.hstack(out)
    out[out == np.arange(n)[:, None]] = -1
    return np.pad(out, ((0, 0), (0, LONG - out.shape[1])), constant_values=-1)


def build_layer(x: np.ndarray, members: np.ndarray, width: int, candidates: int) -> np.ndarray:
    """Neighbour positions, len(members) rows of ``width`` and LONG."""
    n = len(members)
    own = x[members]
    square = (own * own).sum(1)
    c = min(candidates, n - 1)
    if c <= 0:
        return np.full((n, width + LONG), -1, np.int32)
    half = width // 2
    out = np.full((n, half), -1, np.int64)
    for a in range(0, n, 512):
        d = square[a : a + 512, None] + square[None, :] - 2 * own[a : a + 512] @ own.T
        d[np.arange(d.shape[0]), np.arange(a, a + d.shape[0])] = np.inf
        cand = np.argpartition(d, c - 1, axis=1)[:, :c]
        dist = np.take_along_axis(d, cand, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        out[a : a + 512] = _thin(own, cand, dist, half)
    # edges both ways, thinned to the width
    src = np.repeat(np.arange(n), half)
    dst = out.ravel()
    ok = dst >= 0
    pairs = np.unique(np.concatenate((src[ok] * n + dst[ok], dst[ok] * n + src[ok])))
    src, dst = pairs // n, pairs % n
    starts = np.searchsorted(src, np.arange(n + 1))
    degree = np.diff(starts)
    final = np.full((n, width), -1, np.int32)
    for v in np.flatnonzero(degree <= width):
        final[v, : degree[v]] = dst[starts[v] : starts[v + 1]]
    for v in np.flatnonzero(degree > width):
        c_ = dst[starts[v] : starts[v + 1]]
        d = square[c_] + square[v] - 2 * own[c_] @ own[v]
        order = np.argsort(d, kind="stable")[: 4 * width]
        final[v] = _thin(own, c_[order][None, :], d[order][None, :], width)[0]
    final = np.hstack((final, _long(own, square)))
    return np.where(final >= 0, members[np.maximum(final, 0)], -1).astype(np.int32)


def build_graph(ids: np.ndarray, vectors: np.ndarray, norm2: float, m: int = M) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, neighbours) of each level, the lowest first; every level but the lowest has m neighbours, that 2m, and all have LONG more."""
    x = _metric(vectors, norm2)
    levels = _level(ids, m)
    out = []
    for level in range(levels.max() + 1):
        members = np.flatnonzero(levels >= level)
        out.append((members, build_layer(x, members, 2 * m if level == 0 else m, 3 * m)))
    return out


def search_graph(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, ef: int = EF, step: int = 4) -> np.ndarray:
    """Positions of about the ef largest inner products of each query, -1 where there are fewer."""
    n, nq = len(vectors), len(queries)
    x, q = vectors.astype(np.float32), queries.astype(np.float32)
    rows = np.arange(nq)
    at = np.full(nq, layers[-1][0][0])
    best = np.einsum("qd,qd->q", q, x[at])
    for members, table in reversed(layers[1:]):
        where = np.full(n, -1)
        where[members] = np.arange(len(members))
        live = rows
        while len(live):
            near = table[where[at[live]]]
            score = np.einsum("qd,qmd->qm", q[live], x[np.maximum(near, 0)])
            score[near < 0] = -np.inf
            j = score.argmax(1)
            s = score[np.arange(len(live)), j]
            up = s > best[live]
            live, to, s = live[up], near[np.arange(len(live)), j][up], s[up]
            at[live], best[live] = to, s
    table = layers[0][1]
    width = table.shape[1]
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True
    seen[rows, at] = True
    beam = np.full((nq, ef), -1)
    score = np.full((nq, ef), -np.inf, np.float32)
    opened = np.ones((nq, ef), bool)
    beam[:, 0], score[:, 0], opened[:, 0] = at, best, False
    live = rows
    while len(live):
        # the best unopened candidates of each query
        value = np.where(opened[live], -np.inf, score[live])
        pick = np.argpartition(-value, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(value, pick, 1) > -np.inf
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        near = np.where(good[:, :, None], table[np.where(good, beam[live[:, None], pick], 0)], -1).reshape(len(live), step * width)
        near = np.where(near < 0, n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        r, c = np.nonzero(new)
        fresh = np.full(near.shape, -np.inf, np.float32)
        fresh[r, c] = np.einsum("id,id->i", q[live[r]], x[near[r, c]])
        ids = np.hstack((beam[live], near))
        values = np.hstack((score[live], fresh))
        done = np.hstack((opened[live], fresh == -np.inf))
        top = np.argpartition(-values, ef - 1, axis=1)[:, :ef]
        beam[live], score[live], opened[live] = (np.take_along_axis(v, top, 1) for v in (ids, values, done))
    return np.where(score > -np.inf, beam, -1)


def _built(norm2: float, m: int):
    def built(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        ids = pdf["vec_id"].to_numpy(np.int64)
        vectors = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(ids), -1)
        lead = leaders(vectors, norm2, 3 * m)
        tops = np.flatnonzero(lead == np.arange(len(ids)))
        layers = build_graph(ids[tops], vectors[tops], norm2, m)
        lower = [b""] * len(ids)
        for v, row in zip(tops, layers[0][1], strict=True):
            lower[v] = row.tobytes()
        upper: list[list[np.ndarray]] = [[] for _ in ids]
        level = np.zeros(len(ids), int)
        for members, table in layers[1:]:
            for v, row in zip(tops[members], table, strict=True):
                upper[v].append(row)
                level[v] += 1
        return pd.DataFrame(
            {
                "shard": np.full(len(ids), key[0]),
                "pos": np.arange(len(ids), dtype=np.int32),
                "vec_id": ids,
                "lead": lead.astype(np.int32),
                "level": level.astype(np.int32),
                "vector": list(pdf["vector"]),
                "lower": lower,
                "upper": [b"".join(r.tobytes() for r in u) for u in upper],
            }
        )

    return built


def _members(lead: np.ndarray, vectors: np.ndarray, copies: int) -> list[np.ndarray]:
    """The positions of each node's vectors; of equal ones (which score the same) the first ``copies``, as no more can be a result."""
    _, of = np.unique(vectors + 0.0, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(of.max() + 1))
    rank = np.empty(len(of), int)
    rank[order] = np.arange(len(of)) - starts[of[order]]
    used = np.flatnonzero(rank < copies)
    used = used[np.argsort(lead[used], kind="stable")]
    return np.split(used, np.flatnonzero(np.diff(lead[used])) + 1)


def _searched(ef: int, k: int, m: int):
    def searched(key, nodes, queries):
        import pandas as pd

        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(nodes) or not len(queries):
            return empty
        nodes = nodes.sort_values("pos")
        ids = nodes["vec_id"].to_numpy(np.int64)
        vectors = np.frombuffer(b"".join(nodes["vector"]), np.float64).reshape(len(ids), -1)
        lead = nodes["lead"].to_numpy()
        tops = np.flatnonzero(lead == np.arange(len(ids)))
        members_of = _members(lead, vectors, k + 1)
        indexed = vectors[tops]
        level = nodes["level"].to_numpy()[tops]
        uppers = [np.frombuffer(u, np.int32).reshape(-1, m + LONG) for u in nodes["upper"].iloc[tops]]
        layers = [(np.arange(len(tops)), np.frombuffer(b"".join(nodes["lower"]), np.int32).reshape(len(tops), -1))]
        for h in range(1, level.max() + 1):
            members = np.flatnonzero(level >= h)
            layers.append((members, np.array([uppers[v][h - 1] for v in members], np.int32)))
        queries = queries.sort_values("vec_id")
        qids = queries["vec_id"].to_numpy(np.int64)
        q = np.frombuffer(b"".join(queries["vector"]), np.float64).reshape(len(qids), -1)
        out = []
        for a in range(0, len(qids), 256):
            found = search_graph(indexed, layers, q[a : a + 256], max(ef, k + 1))
            for i, row in enumerate(found):
                row = np.concatenate([members_of[v] for v in row[row >= 0]])
                row = row[ids[row] != qids[a + i]]
                score = vectors[row] @ q[a + i]
                order = np.lexsort((ids[row], -score))[:k]
                out.append(pd.DataFrame({"query_id": qids[a + i], "vec_id": ids[row][order], "score": score[order]}))
        return pd.concat([empty, *out], ignore_index=True)

    return searched


def clean_vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector): doubles as bytes, of vectors that take part."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            ids, vectors, sizes = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vectors.append(x.tobytes())
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(sizes, pa.int64()), pa.array([float((np.frombuffer(v) ** 2).sum()) for v in vectors], pa.float64())], names=["vec_id", "vector", "size", "norm2"])

    rows_ = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast(T.ArrayType(T.DoubleType())).alias("v"))
    return rows_.mapInArrow(rows, "vec_id long, vector binary, size long, norm2 double")


def nearest(
    table: DataFrame,
    queries,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    shard: int = SHARD,
    block: int = BLOCK,
    m: int = M,
    ef: int = EF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``table`` that fits the condition ``queries`` (a column of vec_id), the k nearest others.

    shard: vectors of a graph, about; block: queries that are searched together;
    m: neighbours of a node on the upper levels; ef: candidates of a search.
    """
    scratch = Scratch(table.sparkSession, "ann")
    vectors = scratch.keep(clean_vectors(table, vec_id, embedding).groupBy("vec_id").agg(F.min(F.struct("vector", "size", "norm2")).alias("v")).select("vec_id", "v.*"), "vectors")
    sizes = vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).orderBy(F.desc("n"), "size").limit(1).collect()
    size, n, norm2 = sizes[0] if sizes else (0, 0, 0.0)
    vectors = vectors.filter(F.col("size") == size).select("vec_id", "vector")
    shards = max(1, -(-n // shard))
    asked = vectors.filter(queries(F.col("vec_id")))
    blocks = max(1, -(-asked.count() // block))
    nodes = scratch.keep(vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("shard").applyInPandas(_built(norm2, m), NODES), "graph")
    # salted by another seed, so that blocks and shards are independent
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)))
    left = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_searched(ef, k, m), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
