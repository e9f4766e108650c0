"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards of bounded size by a hash of their id. A shard's graph is built in numpy, level by
level, and kept as flat neighbour arrays in one row. Queries go to every shard in blocks; each shard answers a query
with one row, and the shards' rows are merged by score. Scores are inner products in double precision of the vectors as
given. Every query has to meet every shard, so shards grow with the table, as a graph's search grows with the logarithm
of its size: there are at most SHARDS of them until each holds LARGEST vectors.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
than most candidates, whose inner product with the others is not defined. Of rows that repeat a query's id, one is the
query. Fewer candidates than asked for are all returned; ties go to the smaller id; only the two named columns are read,
so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import materialize, table

SHARD = 8192  # vectors of a shard, about, while there are at most SHARDS
SHARDS, LARGEST = 8, 131_072  # shards up to which their number grows, and vectors from which it grows again
SEEN = 1 << 26  # marks of visited nodes that a search holds at once: queries x vectors
LINKS = 12  # links that a new vector makes; twice as many are kept on the lowest level
BREADTH_BUILD, BREADTH_SEARCH = 64, 144  # the latter in shards of SHARD vectors or fewer; see breadth_of
BLOCK = 32_768  # queries that one search task holds
SEED = 9


def breadth_of(n: int) -> int:
    """Breadth of a search among n vectors. It grows with the size beyond SHARD to the power 0.75, since a beam of one breadth
    finds a smaller part of the nearest in a larger graph."""
    return int(BREADTH_SEARCH * max(1.0, n / SHARD) ** 0.75)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best nodes (and scores) that a best-first search with so broad a beam meets, best first.

    All queries step at once; a query rests when its beam holds no node that is unexpanded.
    """
    n = len(queries)
    ids = np.full((n, breadth), -1, np.int64)
    score = np.full((n, breadth), -np.inf, np.float32)
    open_ = np.zeros((n, breadth), bool)
    seen = np.zeros((n, len(vectors)), bool)
    ids[:, 0], open_[:, 0] = entry, True
    score[:, 0] = np.einsum("nd,nd->n", vectors[entry], queries)
    seen[np.arange(n), entry] = True
    live = np.arange(n)
    while len(live):
        best = np.where(open_[live], score[live], -np.inf).argmax(1)
        going = open_[live, best]
        live, best = live[going], best[going]
        if not len(live):
            break
        open_[live, best] = False
        near = links[ids[live, best]]
        fresh = near >= 0
        near = np.where(fresh, near, 0)
        fresh &= ~seen[live[:, None], near]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[rows, cols] = np.einsum("nd,nd->n", vectors[near[rows, cols]], queries[live[rows]])
        all_ids = np.concatenate([ids[live], near], 1)
        all_score = np.concatenate([score[live], got], 1)
        all_open = np.concatenate([open_[live], fresh], 1)
        top = np.argpartition(-all_score, breadth - 1, 1)[:, :breadth]
        ids[live] = np.take_along_axis(all_ids, top, 1)
        score[live] = np.take_along_axis(all_score, top, 1)
        open_[live] = np.take_along_axis(all_open, top, 1) & np.isfinite(score[live])
    order = np.argsort(-score, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def diverse(vectors: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first; -1 for none) up to `keep`: first those nearer to the row's own vector than
    to any chosen before, then the best of the others."""
    n, m = ids.shape
    own = vectors[np.maximum(ids, 0)]
    among = np.einsum("nad,nbd->nab", own, own)
    chosen = np.zeros((n, m), bool)
    for c in range(m):
        worse = (chosen & (among[:, c] >= score[:, c, None])).any(1)
        chosen[:, c] = ~worse & (ids[:, c] >= 0) & (chosen.sum(1) < keep)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * m + np.arange(m)
    order = np.argsort(rank, 1)[:, :keep]
    return np.take_along_axis(ids, order, 1)


def connect(vectors: np.ndarray, nodes: np.ndarray, keep: int, enter) -> np.ndarray:
    """Neighbour array (all vectors x 2 keep) of one level: `nodes` are added in growing batches.

    enter(node ids) gives the nodes from which searches on this level start, among the first of `nodes`.
    """
    width = 2 * keep
    links = np.full((len(vectors), width), -1, np.int64)
    done = 0
    while done < len(nodes):
        new = nodes[done : done + max(1, min(1024, done, SEEN // len(vectors) + 1))] if done else nodes[:256]
        score = vectors[new] @ vectors[new].T
        np.fill_diagonal(score, -np.inf)
        ids = np.broadcast_to(new, score.shape)
        if done:
            far, far_score = beam(vectors, links, vectors[new], enter(new), BREADTH_BUILD)
            ids, score = np.concatenate([far, ids], 1), np.concatenate([far_score, score], 1)
        top = np.argsort(-score, 1, kind="stable")[:, :BREADTH_BUILD]
        ids, score = np.take_along_axis(ids, top, 1), np.take_along_axis(score, top, 1)
        ids = np.where(np.isfinite(score), ids, -1)
        links[new, :keep] = _padded(diverse(vectors, ids, score, keep), keep)
        # links go both ways; who gets too many keeps diverse ones
        a = np.repeat(new, keep)
        b = links[new, :keep].ravel()
        a, b = a[b >= 0], b[b >= 0]
        touched = np.unique(b)
        old = links[touched]
        rows, cols = np.nonzero(old >= 0)
        source = np.concatenate([touched[rows], b])
        target = np.concatenate([old[rows, cols], a])
        pair = np.unique(source * len(vectors) + target)
        source, target = pair // len(vectors), pair % len(vectors)
        s = np.einsum("nd,nd->n", vectors[source], vectors[target])
        order = np.lexsort((-s, source))
        source, target, s = source[order], target[order], s[order]
        start = np.searchsorted(source, touched)
        at = np.arange(len(source)) - np.repeat(start, np.diff(np.r_[start, len(source)]))
        some = at < BREADTH_BUILD
        row = np.searchsorted(touched, source[some])
        ids = np.full((len(touched), BREADTH_BUILD), -1, np.int64)
        score = np.full(ids.shape, -np.inf, np.float32)
        ids[row, at[some]], score[row, at[some]] = target[some], s[some]
        links[touched] = _padded(diverse(vectors, ids, score, width), width)
        done += len(new)
    return links


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that makes them equally long, so that nearness by inner product is nearness."""
    norm = np.square(vectors).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(0, norm.max() - norm))[:, None]], 1).astype(np.float32)


def build(vectors: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
    """Neighbour arrays from the lowest level up; a vector reaches each next level by a chance of 1 in LINKS."""
    x, draw = lifted(vectors), np.random.default_rng(seed)
    height = np.floor(-np.log(1 - draw.random(len(x))) / np.log(LINKS)).astype(int)
    order = np.argsort(-height, kind="stable")
    levels: list[np.ndarray] = []
    above: list[np.ndarray] = []
    for h in range(height.max(), -1, -1):
        nodes = order[: int((height >= h).sum())]
        upper = list(above)
        links = connect(x, nodes, LINKS, lambda new, upper=upper: descend(x, upper, x[new], order[0]))
        levels.insert(0, links)
        above.append(links)
    return levels


def descend(vectors: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, top: int) -> np.ndarray:
    """The node that a search through the upper levels, highest first, ends at."""
    entry = np.full(len(queries), top)
    for links in levels:
        entry = beam(vectors, links, queries, entry, 1)[0][:, 0]
    return entry


def find(vectors: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, k: int) -> np.ndarray:
    """Indices of about k nearest of each query; -1 for none."""
    x, top = lifted(vectors), int(sum((lv >= 0).any(1).astype(int) for lv in levels).argmax())
    q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
    out, step = [], max(1, min(512, SEEN // len(x)))
    for s in range(0, len(q), step):
        entry = descend(x, levels[:0:-1], q[s : s + step], top)
        out.append(beam(x, levels[0], q[s : s + step], entry, max(breadth_of(len(x)), k))[0][:, :k])
    return np.concatenate(out)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, whatever their length."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("vector").isNotNull() & sound)


def usual_length(rows: DataFrame) -> int:
    """The length of most vectors, the smaller of equals; 0 if there are none."""
    found = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def shard_count(n: int, shard_size: int = SHARD) -> int:
    return max(1, min(SHARDS, -(-n // shard_size)), -(-n // LARGEST))


def packed(levels: list[np.ndarray]) -> tuple[bytes, bytes, list[int]]:
    """(nodes, links, sizes): for each level the nodes that have links on it and their neighbour arrays, level after level.
    Upper levels hold few of the vectors, so only these are kept."""
    nodes = [np.flatnonzero((links >= 0).any(1)) for links in levels]
    links = [own[at] for own, at in zip(levels, nodes, strict=True)]
    return np.concatenate(nodes).astype(np.int32).tobytes(), np.concatenate(links).astype(np.int32).tobytes(), [len(x) for x in nodes]


def unpacked(nodes: bytes, links: bytes, sizes: list[int], n: int) -> list[np.ndarray]:
    """Neighbour arrays of n vectors, from the lowest level up."""
    at = np.split(np.frombuffer(nodes, np.int32), np.cumsum(sizes)[:-1])
    rows = np.split(np.frombuffer(links, np.int32).reshape(-1, 2 * LINKS), np.cumsum(sizes)[:-1])
    out = []
    for own, near in zip(at, rows, strict=True):
        level = np.full((n, 2 * LINKS), -1, np.int32)
        level[own] = near
        out.append(level)
    return out


def index(rows: DataFrame, shards: int) -> DataFrame:
    """One row per shard: (shard, ids, vectors, nodes, links, sizes) as flat arrays of bytes; see packed."""

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        vectors = np.stack(pdf["vector"].to_numpy())
        levels = build(vectors)
        nodes, links, sizes = packed(levels)
        return pd.DataFrame({"shard": [pdf["shard"][0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.astype(np.float64).tobytes()], "nodes": [nodes], "links": [links], "sizes": [sizes]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(graph, "shard long, ids binary, vectors binary, nodes binary, links binary, sizes array<int>")


def search(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", shard_size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all vectors but its own."""
    every = materialize(usable(vectors, id_col, vec_col), "vectors")
    length = usual_length(every)
    rows = every.where(F.size("vector") == length)
    shards = shard_count(rows.count(), shard_size)
    graphs = materialize(index(rows, shards), "graphs")
    asked = usable(queries, id_col, vec_col).where(F.size("vector") == length).groupBy("id").agg(F.max("vector").alias("vector"))
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def answer(graph: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(part):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "near": pd.Series([], dtype="object")})
        g = graph.iloc[0]
        ids = np.frombuffer(g["ids"], np.int64)
        x = np.frombuffer(g["vectors"], np.float64).reshape(len(ids), -1)
        levels = unpacked(g["nodes"], g["links"], list(g["sizes"]), len(ids))
        q, q_ids = np.stack(part["vector"].to_numpy()), part["id"].to_numpy(np.int64)
        near = find(x, levels, q, min(k + 1, len(ids)))
        out = []
        for own, vector, at in zip(q_ids.tolist(), q, near, strict=True):
            at = at[(at >= 0) & (ids[at] != own)]
            out.append([{"loss": -score, "vec_id": i} for score, i in zip((x[at] * vector).sum(1).tolist(), ids[at].tolist(), strict=True)])
        return pd.DataFrame({"query_id": q_ids, "near": out})

    near = "array<struct<loss:double,vec_id:long>>"
    found = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answer, f"query_id long, near {near}")
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return merged.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.loss")).alias("score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
