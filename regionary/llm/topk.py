"""Exact top-k search by inner product, with dual-tree descent over cover trees.

Vectors become integers, floor(scale * x), and scores are integer inner products. Candidates are cut
into blocks of a bounded size; in each block a cover tree indexes the candidates and another one the
queries. A pair of nodes (Q, C) is pruned if for every query q of Q the bound
<cq, cc> + |cq| rc + |cc| rq + rq rc is below the worst k-th score among Q's queries.
Blocks' lists are merged by score, then smaller id.

Queries and candidates meet in blocks against blocks, so memory is bounded by the two block sizes; work is
queries times candidates at worst. Equal vectors share a tree point and are all scored.

Defined results: null and incomplete vectors (null or not finite components) take no part, neither do null ids;
vectors of unlike length are not compared; repeated rows are candidates each, and an id asks once, of several
vectors by the one whose bytes come first (rows with the query's id are its own); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

K = 10
SCALE = 1024
EVERY = 100
CANDIDATES = 8192
QUERIES = 2048
LEAF = 32


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raw, size = [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                raw.append(np.floor(SCALE * x).astype(np.int64).tobytes())
                size.append(len(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(size, pa.int64())], names=["vec_id", "vector", "size"])


class CoverTree:
    """A cover tree in batches: a node of radius r is covered by centres of its own points at r / 2.

    Centres are picked greedily, farthest first, so they are more than r / 2 apart; each point goes to
    its nearest centre. A node with few or only equal points is a leaf.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        self.root = self._build(np.arange(len(x)))

    def _new(self, centre: int, points: np.ndarray, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.points.append(points)
        return len(self.centre) - 1

    def _far(self, points: np.ndarray, centre: int) -> np.ndarray:
        d = self.x[points] - self.x[centre]
        return np.sqrt((d * d).sum(1))

    def _build(self, points: np.ndarray) -> int:
        middle = self.x[points].mean(0)
        d = self.x[points] - middle
        centre = int(points[(d * d).sum(1).argmin()])
        far = self._far(points, centre)
        top = self._new(centre, points, float(far.max()))
        todo = [(top, points, far)]
        while todo:
            node, points, far = todo.pop()
            if len(points) <= LEAF or self.radius[node] == 0.0:
                continue
            centres, near, owner = [self.centre[node]], far.copy(), np.zeros(len(points), np.int64)
            while near.max() > self.radius[node] / 2 and len(centres) < 16:
                new = int(points[near.argmax()])
                d = self._far(points, new)
                owner[d < near] = len(centres)
                near = np.minimum(near, d)
                centres.append(new)
            for k, c in enumerate(centres):
                mine = owner == k
                if len(centres) == 1 or mine.all():
                    break
                if mine.any():
                    child = self._new(c, points[mine], float(near[mine].max()))
                    self.children[node].append(child)
                    todo.append((child, points[mine], near[mine]))
        return top


class Best:
    """The k best of each query, by score and then smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.worst = np.full(len(ids), -np.inf)

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (score >= self.worst[q]) & (ids != self.ids[q])
        if not keep.any():
            return
        s, i = np.concatenate([self.score[q], score[keep]]), np.concatenate([self.found[q], ids[keep]])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.found[q] = s[order], i[order]
        if len(order) == self.k:
            self.worst[q] = s[order][-1]


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Best:
    """Dual-tree descent, most promising pair first within a node."""
    best = Best(qid, k)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qt, ct = CoverTree(qf), CoverTree(cf)
    qn, cn = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
    worst_of: dict[int, float] = {}

    def bound(a: int, b: int) -> float:
        i, j, r, s = qt.centre[a], ct.centre[b], qt.radius[a], ct.radius[b]
        return float(qf[i] @ cf[j] + qn[i] * s + cn[j] * r + r * s) + 1.0

    stack = [(qt.root, ct.root, np.inf)]
    while stack:
        a, b, top = stack.pop()
        worst = worst_of.get(a, -np.inf)
        if top < worst:
            continue
        worst = worst_of[a] = float(best.worst[qt.points[a]].min())
        if top < worst:
            continue
        if not qt.children[a] and not ct.children[b]:
            rows, cols = qt.points[a], ct.points[b]
            score = q[rows] @ c[cols].T
            for x, row in enumerate(rows.tolist()):
                if score[x].max() >= best.worst[row]:
                    best.offer(row, cid[cols], score[x])
            continue
        if ct.children[b] and (not qt.children[a] or ct.radius[b] >= qt.radius[a]):
            pairs = [(a, y, bound(a, y)) for y in ct.children[b]]
        else:
            pairs = [(x, b, bound(x, b)) for x in qt.children[a]]
        stack += sorted(pairs, key=lambda p: p[2])
    return best


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: for each id divisible by ``every`` its k best other rows."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in pdf["size"].unique():
            mine = pdf[pdf["size"] == size]
            ask, has = mine[mine["side"] == 1], mine[mine["side"] == 0]
            if len(ask) == 0 or len(has) == 0:
                continue
            x, y = (np.frombuffer(b"".join(t["vector"]), np.int64).reshape(len(t), -1) for t in (ask, has))
            got = search(ask["vec_id"].to_numpy(), x, has["vec_id"].to_numpy(), y, k)
            for q, ids, score in zip(got.ids, got.found, got.score, strict=True):
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    with Scratch(vectors.sparkSession, "topk") as scratch:
        rows = scratch.save(vectors.select("vec_id", "embedding").mapInArrow(_integers, "vec_id long, vector binary, size long"))
        asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "size")).alias("v")).select("vec_id", "v.*")
        counts = rows.agg(F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("q")).first()
        blocks, groups = max(1, -(-counts["n"] // CANDIDATES)), max(1, -(-counts["q"] // QUERIES))
        every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        # rows are dealt by a hash of everything, so equal vectors and equal ids spread as well
        has = rows.select("vec_id", "vector", "size", F.lit(0).alias("side"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"), every_group.alias("group"))
        ask = asked.select("vec_id", "vector", "size", F.lit(1).alias("side"), every_block.alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(groups)).cast("int").alias("group"))
        found = scratch.save(has.unionByName(ask).groupBy("block", "group").applyInPandas(block, "query_id long, vec_id long, score long"), keep=True)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
