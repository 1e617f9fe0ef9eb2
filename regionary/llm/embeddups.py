"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared within their label only. Equal vectors form one class first. A tree's root is a
label; a node of more than ``SMALL`` classes is split by its projections on a random direction, at the one of
five quantiles with the least spill: classes within ``SPILL`` of the cut go to both sides. Leaves are compared
exhaustively in double precision, and links are joined into components.

Links are counted without writing them: a pair is counted in the least of the leaves that both its
classes are in, so each leaf yields one count for a class and a spanning forest of its links. A leaf
of which every cut spills a seventh (thousands of vectors nearly alike) is compared in blocks against blocks, which is exact.

Projections are scaled by the root of the dimension, so that those of unit vectors spread by 1 or so.
Two unit vectors with cosine 0.98 differ by at most 0.2, and so do their projections on average; a
split loses the pair only beyond 2 * SPILL, which is 1 % of such pairs a level. With three trees of six
levels that is 1 in 5000 pairs, of 25 levels 1 in 90. The spill makes a tree 10 % larger a level. As
every cut leaves at least a fifth on either side and spills less than ``WASTE``, each side is smaller.

Defined results: null, zero and incomplete vectors (null or not finite components), and null labels, link with
nothing; vectors of unlike length don't link; repeated rows are other vectors, linked if valid; a null
id counts as a vector and names a component only if no other id is there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .neardup import _groups

COSINE = 0.98
TREES = 3
SMALL = 256
WHOLE = 8192
BLOCK = 512
SPILL = 0.12
LEVELS = 24
WAYS = 4
QUANTILES = [0.5, 0.35, 0.65, 0.2, 0.8]
WASTE = 0.15


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, raw = [], []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            good = label is not None and v and None not in v
            x = np.array(v, np.float64) + 0.0 if good else None
            if good and np.isfinite(x).all() and (x != 0).any():
                x = x / np.abs(x).max()
                raw.append(x.tobytes())
                keys.append(xxhash.xxh3_128_digest(f"{label}\0".encode() + raw[-1]))
            else:
                raw.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.string()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "class", "vector"])


def _by_length(column: list[bytes]) -> dict[int, np.ndarray]:
    size = np.array([len(x) for x in column])
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's projection on its node's direction."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        raw = batch.column("vector").to_pylist()
        out = np.zeros(len(raw))
        which, place = np.unique(node, return_inverse=True)
        for n, rows in _by_length(raw).items():
            x = unit(np.frombuffer(b"".join([raw[i] for i in rows]), np.float64).reshape(len(rows), -1))
            for k in np.unique(place[rows]):
                mine = place[rows] == k
                way = np.random.default_rng([int(which[k]) & (1 << 62) - 1, n]).standard_normal(x.shape[1])
                out[rows[mine]] = x[mine] @ (way * np.sqrt(x.shape[1] / (way @ way)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "at"])


def _compare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T >= COSINE - 1e-12


def _exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of pairs on the given vectors, once more and one by one."""
    a, b = x[i], y[j]
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= COSINE


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in a symmetric matrix; at most one link fewer than rows."""
    left = linked.any(1)
    out = []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            v = todo.pop()
            new = np.flatnonzero(linked[v] & left)
            left[new] = False
            out += [(v, w) for w in new.tolist()]
            todo += new.tolist()
    return out


def _met_before(homes: list[list[int]], leaf: int) -> np.ndarray:
    """Which pairs of rows share a leaf that is less than this one."""
    row = np.repeat(np.arange(len(homes)), [len(h) for h in homes])
    which = np.array([k for h in homes for k in h], np.int64)
    less = which < leaf
    names, place = np.unique(which[less], return_inverse=True)
    out = np.zeros((len(homes), len(homes)), bool)
    for k in range(0, len(names), BLOCK):
        at = (place >= k) & (place < k + BLOCK)
        here = np.zeros((len(homes), BLOCK), np.float32)
        here[row[less][at], place[at] - k] = 1
        out |= here @ here.T > 0
    return out


def _leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a leaf: for each class the copies linked to it that are counted here, and a spanning forest.

    A row of side 0 is in the block itself; one of side 1 stands on the other side of a pair of blocks.
    """
    for t in _groups(batches, "block"):
        leaf = t.column("node")[0].as_py()
        side = t.column("side").to_numpy()
        keys, raw, copies, homes = (t.column(c).to_pylist() for c in ("class", "vector", "copies", "leaves"))
        copies = np.array(copies, np.int64)
        before = _met_before(homes, leaf)
        counts: dict[bytes, int] = {}
        edges: list[tuple[bytes, bytes]] = []
        for n, rows in _by_length(raw).items():
            x = np.frombuffer(b"".join([raw[k] for k in rows]), np.float64).reshape(len(rows), -1)
            u = unit(x)
            other = side[rows] == 1
            asked = other[:, None] != other[None, :] if other.any() else ~np.eye(len(rows), dtype=bool)
            i, j = np.nonzero(np.triu(asked & _compare(u, u)))
            linked = np.zeros((len(rows), len(rows)), bool)
            for k in range(0, len(i), BLOCK * 128):
                p, q = i[k : k + BLOCK * 128], j[k : k + BLOCK * 128]
                linked[p, q] = linked[q, p] = _exact(x, p, x, q)
            edges += [(keys[rows[p]], keys[rows[q]]) for p, q in _spanning(linked)]
            total = (linked & ~before[np.ix_(rows, rows)]) @ copies[rows]
            for k in np.flatnonzero(total):
                counts[keys[rows[k]]] = counts.get(keys[rows[k]], 0) + int(total[k])
        a = [k for k in counts] + [e[0] for e in edges]
        b = [None] * len(counts) + [e[1] for e in edges]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*counts.values(), *[0] * len(edges)], pa.int64())], names=["a", "b", "links"])


def _best_split(x: np.ndarray, name: int) -> list[np.ndarray]:
    """Positions on both sides of the cut with the least spill, of some directions and quantiles; none if all spill too much."""
    ways = np.random.default_rng([name, x.shape[1]]).standard_normal((WAYS, x.shape[1]))
    best, sides = WASTE * len(x), []
    for at in (x @ (ways * np.sqrt(x.shape[1] / (ways * ways).sum(1, keepdims=True))).T).T:
        for cut in np.quantile(at, QUANTILES):
            low, high = at <= cut + SPILL, at > cut - SPILL
            size = int(low.sum() + high.sum()) - len(x)
            if size < best:
                best, sides = size, [np.flatnonzero(low), np.flatnonzero(high)]
    return sides


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, class) of the leaves below each node of at most ``WHOLE`` classes, which are split in memory."""
    for t in _groups(batches, "node"):
        keys, raw = t.column("class").to_pylist(), t.column("vector").to_pylist()
        top = t.column("node")[0].as_py()
        names, members = [], []
        for n, rows in _by_length(raw).items():
            x = unit(np.frombuffer(b"".join([raw[i] for i in rows]), np.float64).reshape(len(rows), -1))
            todo = [(xxhash.xxh3_64_intdigest(f"{top} {n}"), np.arange(len(rows)))]
            while todo:
                name, mine = todo.pop()
                halves = [mine[side] for side in _best_split(x[mine], name)] if len(mine) > SMALL else []
                for k, half in enumerate(halves or [mine]):
                    if halves:
                        todo.append((xxhash.xxh3_64_intdigest(f"{name} {k}"), half))
                    elif len(half) > 1:
                        leaf = xxhash.xxh3_64_intdigest(f"{name} {k} leaf") - (1 << 63)
                        names.append(np.full(len(half), leaf, np.int64))
                        members += [keys[rows[i]] for i in half]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(members, pa.binary())], names=["node", "class"])


def _leaves(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(node, class) of every tree's leaves.

    Only nodes of more than ``WHOLE`` classes are split level by level, each level written once; what is
    smaller goes to one task with its vectors, which splits it to the leaves.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    nodes = classes.select("class", "vector", "label", tree.alias("tree")).select(F.xxhash64("tree", "label").alias("node"), "class", "vector")
    whole, leaves = [], []
    for level in range(LEVELS):
        at = scratch.save(nodes.mapInArrow(_projected, "node long, class binary, vector binary, at double"))
        cuts = F.percentile_approx("at", QUANTILES, 1000).alias("cuts")
        stats = scratch.save(at.groupBy("node").agg(F.count("*").alias("size"), cuts).filter("size > 1"))
        large = stats.filter(F.col("size") > WHOLE)
        near = [F.count_if(F.abs(F.col("at") - F.col("cuts")[k]) <= SPILL).alias(f"spill{k}") for k in range(len(QUANTILES))]
        spilt = at.select("node", "at").join(large, "node").groupBy("node").agg(*near)
        choices = F.array(*(F.struct(F.col(f"spill{k}").alias("spill"), F.col("cuts")[k].alias("cut")) for k in range(len(QUANTILES))))
        stats = scratch.save(stats.join(spilt, "node", "left").withColumn("best", F.array_min(choices)).select("node", "size", "best.spill", "best.cut"))
        # a node that every cut hardly divides is a leaf, whatever its size
        stuck = (F.col("size") > WHOLE) & (F.lit(level == LEVELS - 1) | (F.col("spill") >= WASTE * F.col("size")))
        more = (F.col("size") > WHOLE) & ~stuck
        rows = at
        whole.append(rows.join(stats.filter(F.col("size") <= WHOLE).select("node"), "node").select("node", "class", "vector"))
        leaves.append(rows.join(stats.filter(stuck).select("node"), "node").select("node", "class"))
        if stats.filter(more).isEmpty():
            break
        cut = rows.join(stats.filter(more).select("node", "cut"), "node")
        sides = F.array_compact(F.array(F.when(F.col("at") <= F.col("cut") + SPILL, F.lit(0)), F.when(F.col("at") > F.col("cut") - SPILL, F.lit(1))))
        nodes = cut.select("node", "class", "vector", F.explode(sides).alias("side")).select(F.xxhash64("node", "side").alias("node"), "class", "vector")
    small, out = whole[0], leaves[0]
    for a, b in zip(whole[1:], leaves[1:], strict=True):
        small, out = small.unionByName(a), out.unionByName(b)
    return out.unionByName(small.repartition(F.xxhash64("node")).sortWithinPartitions("node").mapInArrow(_subtrees, "node long, class binary"))


def _blocks(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows of every pair of blocks: a leaf of b blocks has b * (b + 1) / 2 of them, one for most."""
    sizes = leaves.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    at = rows.join(sizes, "node").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = at.withColumn("other", every)
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    side = (F.col("mine") > F.col("other")).cast("int")
    return pairs.select(F.xxhash64("node", lo, hi).alias("block"), "node", side.alias("side"), "class", "vector", "copies", "leaves")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept."""
    with Scratch(vectors.sparkSession, "embeddups") as scratch:
        rows = scratch.save(vectors.select("vec_id", "label", "embedding").mapInArrow(_describe, "vec_id long, label string, class binary, vector binary"))
        valid = rows.filter(F.col("class").isNotNull())
        classes = scratch.save(valid.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label")))
        leaves = scratch.save(_leaves(scratch, classes))
        homes = leaves.groupBy("class").agg(F.collect_set("node").alias("leaves"))
        full = scratch.save(classes.select("class", "vector", "copies").join(homes, "class"))
        placed = leaves.distinct().join(full, "class")
        blocks = _blocks(placed, leaves.distinct())
        found = scratch.save(blocks.repartition(F.xxhash64("block")).sortWithinPartitions("block").mapInArrow(_leaf, "a binary, b binary, links long"))
        links = found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
        labels = components(scratch, found.filter("b is not null").select("a", "b"))
        named = scratch.save(classes.join(labels.withColumnRenamed("v", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")).join(links, "class", "left").select("class", "root", "least", "copies", F.coalesce("links", F.lit(0)).alias("links")))
        names = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = scratch.save(named.join(names, "root").select("class", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), keep=True)
        slim = scratch.save(rows.select("vec_id", "class"), keep=True)
    out = slim.filter(F.col("class").isNotNull()).join(named, "class").select("vec_id", "n_links", "component_id")
    alone = slim.filter(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
