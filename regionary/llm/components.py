"""Connected components: within one task while the edges are few, by alternating stars beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60
#: Up to so many edges are joined in one task, which takes a stage and not a dozen a round; more are never gathered.
ALONE = 1 << 18


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of every vertex to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex that each of ``n`` reaches: roots hook on the least root beside them, and paths are halved, until nothing moves."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vertex of all batches with the least that it reaches."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    number = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
    names = number.dictionary
    order = np.array(sorted(range(len(names)), key=names.to_pylist().__getitem__))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[number.indices.to_numpy()]
    root = least_reached(at[: t.num_rows], at[t.num_rows :], len(order))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(order)), names.take(pa.array(order[root]))], names=["v", "root"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b), root the least vertex that it reaches, itself included.

    Over ``ALONE`` edges each round is two grouped minima and joins back; rounds grow with the logarithm of the longest path.
    The rounds' edges are written, so a lost executor costs no more than one round.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if now.count() <= ALONE:
        kind = dict(now.dtypes)["a"]
        return scratch.save(now.coalesce(1).mapInArrow(_alone, f"v {kind}, root {kind}"))
    mark = None
    for _ in range(MOST_ROUNDS):
        wide = _star(now, large=True)
        nxt = scratch.save(_star(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), large=False))
        scratch.drop(now)
        now = nxt
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (got["n"], got["h"]):
            break
        mark = (got["n"], got["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
