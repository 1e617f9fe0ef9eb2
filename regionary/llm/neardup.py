"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of five-word shingles. Equal sets form one class first, so copies cost nothing
more. Each class carries ``HASHES`` minwise tokens, the least
members of as many ranges of hash values. In every one of ``TREES`` trees the
classes branch by selected minwise tokens: a node picks 4/3 of the tokens on average (one over
the threshold), and a class goes to the child named by its token there. A node of at most ``SMALL``
classes is compared exhaustively; a larger one branches on. Independent trees bring the recall up.

Only connection is asked for, and no list of pairs is ever made. First every class names one leader, the
least that it resembles in any root, roots of over ``LED`` classes being read in parts. A leader's followers are compared on their full sets, all with all, within blocks
of bounded size, and only a spanning forest of their links leaves the block. Then the nodes are read again: a node puts out a
spanning forest of the pairs that may be similar but are still in different components. What these forests
connect is a family; its members are compared on full sets, block against block, once, and not again in each tree. So
what a node or a block puts out grows with its members and not with their pairs. A large node whose members are all in one component is
finished; any other keeps branching until it is small, and after ``DEEPEST`` levels what is left is taken block
against block. No pair is dropped for the size of its group.

Defined results: null and empty texts have no shingles and stand alone; texts under five words
are one shingle; repeated rows fall into one class; a null id sorts after all others within its component and
is never the component's name unless there is no other; extra columns are ignored; an empty table gives an empty
result; a very long text is one set, compared whole, in a block of its own from ``LONG`` shingles on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import components

WORDS = 5
NUMBER, WHOLE = 75, 100
HASHES = 128
TREES = 14
ROOTS = 2
SMALL = 8192
LED = 1024
DEEPEST = 12
#: Sketch likeness from which a class follows a leader, and from which a pair is compared: the latter is over five
#: standard errors of the sketch under the threshold.
ALIKE = 0.70
MAYBE = 0.55
#: About how many classes and shingles a block has; two blocks are compared in one task.
GROUP = 384
LONG = 1 << 20
COLUMNS = 4096
BLOCK = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The lower edges of the ranges, and the greatest value; and the ranges that stand in for an empty one, in turn.
_EDGES = np.append(np.arange(HASHES, dtype=np.uint64) * np.uint64((1 << 64) // HASHES), np.uint64((1 << 64) - 1))
_PROBES = np.random.default_rng(11).permuted(np.tile(np.arange(HASHES), (HASHES, 1)), axis=1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte, the same for A-Z as for a-z.
_BYTE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: bytes) -> np.ndarray:
    """A hash of every word, from prefix sums of a polynomial over its bytes; A-Z count as a-z."""
    out, at = [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not _SPACE[data[end - 1]]:  # a block ends after white space, or with the text
            back = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, end - at, at)])
            end = at + int(back[-1]) + 1 if len(back) else min(len(data), 2 * end - at)
        x = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        at = end
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = ~_SPACE[x]
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turn[::2], turn[1::2]
        up, down = (_UP, _DOWN) if len(x) <= BLOCK else (_powers(_BASE, len(x)), _powers(_INVERSE, len(x)))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * up[: len(x)], out=sums[1:])
        out.append(_hash((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Shingles:
    """Hashed shingle sets of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; words are of ASCII white space, only A-Z are lowered."""
        h = _words((text or "").encode("utf-8", "surrogatepass"))
        if not len(h):
            return h
        n = len(h) - self.words + 1
        if n < 1:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
        out = h[:n].copy()
        for k in range(1, self.words):
            out *= _MIX
            out ^= out >> np.uint64(32)
            out += h[k : k + n]
        out ^= out >> np.uint64(29)
        out *= _MIX
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def sketch(s: np.ndarray) -> np.ndarray:
    """Thirty-two bits of the least member in each of ``HASHES`` equal ranges of hash values.

    The members are sorted, so a range's least is where its lower edge falls. An empty range takes the token
    of the first non-empty one in a sequence of ranges fixed for it, so that two sets agree there as
    often as in any other (one-permutation hashing with optimal densification).
    """
    at = np.searchsorted(s, _EDGES)
    full = at[1:] > at[:-1]
    tokens = _hash(s[np.minimum(at[:-1], len(s) - 1)]).astype("<u4")
    if full.all():
        return tokens
    probe = _PROBES[~full]
    tokens[~full] = tokens[probe[np.arange(len(probe)), full[probe].argmax(1)]]
    return tokens


@lean
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, class, sketch of 16 bits a token, and the whole tokens that choose the roots."""
    shingles = Shingles()
    for batch in batches:
        n, key, sk, roots = [], [], [], []
        for t in batch.column("text"):
            s = shingles(t.as_py())
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()))
            tokens = sketch(s) if len(s) else np.zeros(0, "<u4")
            sk.append(tokens.astype("<u2").tobytes())
            roots.append(tokens[: TREES * ROOTS].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sk, pa.binary()), pa.array(roots, pa.binary()), batch.column("key")],
            names=["doc_id", "n", "class", "sketch", "roots", "key"],
        )


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "members"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _children(node: np.ndarray, pick: np.ndarray, token: np.ndarray, salt: int) -> np.ndarray:
    return _hash(_hash(node + np.uint64(salt)) ^ _hash((pick.astype(np.uint64) << np.uint64(32)) + token.astype(np.uint64))).astype(np.int64)


def _root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = np.frombuffer(b"".join(batch.column("roots").to_pylist()), "<u4").reshape(-1, TREES * ROOTS)
        for pick in range(TREES * ROOTS):
            child = _children(np.full(len(tokens), pick // ROOTS, np.uint64), np.full(len(tokens), pick), tokens[:, pick], 1)
            yield pa.RecordBatch.from_arrays([pa.array(child), batch.column("class")], names=["node", "class"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sk = _matrix(batch.column("sketch"))
        node = batch.column("node").to_numpy().astype(np.uint64)
        dice = _hash(node ^ np.uint64(0x5DEECE66D))
        for j, use in ((0, np.ones(len(sk), bool)), (1, (dice >> np.uint64(8)) % np.uint64(3) == 0)):
            pick = ((dice >> np.uint64(16 + 12 * j)) % np.uint64(HASHES)).astype(np.int64)
            child = _children(node, pick, sk[np.arange(len(sk)), pick], 2 + j)
            keep = pa.array(use)
            yield pa.RecordBatch.from_arrays([pa.array(child), *(batch.column(c) for c in ("class", "n", "sketch"))], names=["node", "class", "n", "sketch"]).filter(keep)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches sorted by key."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        k = held.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(cut):
            held = held.combine_chunks()
            for a, b in zip([0, *cut[:-1]], cut, strict=True):
                yield held.slice(a, b - a)
            held = held.slice(int(cut[-1]))
    if held is not None and held.num_rows:
        yield held


def _likeness(sk: np.ndarray) -> np.ndarray:
    out = np.empty((len(sk), len(sk)), np.float32)
    for k in range(0, len(sk), 32):
        out[k : k + 32] = np.count_nonzero(sk[k : k + 32, None, :] == sk[None, :, :], axis=2)
    return out / np.float32(HASHES)


PAIR = "a binary, b binary"


def _pairs(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _forest(link: np.ndarray) -> list[list[tuple[int, int]]]:
    """A spanning tree, as (member, its parent) from the first member on, for each component of a symmetric matrix."""
    left, out = np.ones(len(link), bool), []
    for i in range(len(link)):
        if left[i]:
            left[i] = False
            tree, todo = [(i, i)], [i]
            while todo:
                j = todo.pop()
                near = np.flatnonzero(link[j] & left).tolist()
                left[near] = False
                tree += [(k, j) for k in near]
                todo += near
            out.append(tree)
    return out


@lean
def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node, each class with the first class, in the order of classes, that it resembles; per task one leader a class."""
    lead_of: dict[bytes, bytes] = {}
    for t in _groups(batches, "node"):
        keys = t.column("class").to_pylist()
        order = np.argsort(np.array(keys, dtype=object))
        keys = [keys[i] for i in order]
        like = _likeness(_matrix(t.column("sketch"))[order])
        lead: list[int] = []
        for x in range(len(keys)):
            if lead:
                best = lead[int(like[x, lead].argmax())]
                if like[x, best] >= ALIKE:
                    lead_of[keys[x]] = min(keys[best], lead_of.get(keys[x], keys[best]))
                    continue
            lead.append(x)
        if len(lead_of) > 50_000:
            yield _pairs(list(lead_of.values()), list(lead_of))
            lead_of = {}
    yield _pairs(list(lead_of.values()), list(lead_of))


def _bridges(sk: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that may be similar though in different components; a few rows of the comparison are held at a time."""
    label = np.arange(len(sk))
    for k in range(0, len(sk), 32):
        same = np.count_nonzero(sk[k : k + 32, None, :] == sk[None, :, :], axis=2) >= MAYBE * HASHES
        same &= root[k : k + 32, None] != root[None, :]
        for i, row in enumerate(same, k):
            near = np.flatnonzero(row)
            found, first = np.unique(label[near], return_index=True)
            for other, j in zip(found.tolist(), near[first].tolist(), strict=True):
                if other != label[i]:
                    yield j, i
                    label[label == other] = label[i]


@lean
def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node what connects the classes that may be similar though in different components."""
    out: set[tuple[bytes, bytes]] = set()
    for t in _groups(batches, "node"):
        root = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        keys = t.column("class").to_pylist()
        out.update((keys[j], keys[i]) for j, i in _bridges(_matrix(t.column("sketch")), root))
        if len(out) > 50_000:
            yield _pairs(*map(list, zip(*out, strict=True)))
            out = set()
    if out:
        yield _pairs(*map(list, zip(*out, strict=True)))


def _links(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets reach the threshold with which: common members are counted by products of membership matrices."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(m, dtype=np.int32), size)[order]
    column = np.cumsum(np.append(True, every[1:] != every[:-1])) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((m, m))
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        both += x @ x.T
    link = WHOLE * both >= NUMBER * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    return link


@lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group a spanning forest of the links between its full sets."""
    a: list[bytes] = []
    b: list[bytes] = []
    for t in _groups(batches, "g"):
        if t.num_rows > 1:
            keys = t.column("class").to_pylist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members")]
            for tree in _forest(_links(sets)):
                a += [keys[j] for _, j in tree[1:]]
                b += [keys[k] for k, _ in tree[1:]]
        if len(a) > 50_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


NODE = "node long, class binary, n long, sketch binary"


def _text_key() -> Column:
    """Tells texts of one id apart; null for a null text."""
    return F.md5(F.col("text").cast("binary"))


class Join:
    """The trees, their groups and the components, over the classes of one table."""

    def __init__(self, scratch: Scratch, docs: DataFrame):
        self.scratch, self.docs = scratch, docs
        self.rows = scratch.save(docs.select("doc_id", "text", _text_key().alias("key")).mapInArrow(_describe, "doc_id long, n long, class binary, sketch binary, roots binary, key string"))
        full = self.rows.filter("n > 0")
        self.classes = scratch.save(full.groupBy("class").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "sketch", "roots"))))

    def split(self, nodes: DataFrame) -> DataFrame:
        """Nodes of two classes and more, with their sizes; written. Roots get their sketches only now."""
        counts = nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        both = nodes.join(counts, "node")
        if "sketch" not in nodes.columns:
            both = self.scratch.save(both).join(self.classes.select("class", "n", "sketch"), "class")
        return self.scratch.save(both.select("node", "class", "n", "sketch", "size"))

    def verify(self, groups: DataFrame) -> DataFrame:
        """The links within groups (g, class) that reach the threshold on full sets, as spanning forests."""
        of = groups.select("class").distinct()
        # written, so that its size is known: while it is small, the texts stay where they are
        ids = self.scratch.save(self.classes.join(of, "class", "left_semi").select("class", F.col("least").alias("id__")))
        texts = self.docs.select("doc_id", "text").join(ids.select("id__").distinct(), F.col("doc_id").eqNullSafe(F.col("id__")), "left_semi")
        sets = texts.mapInArrow(_sets, "class binary, members binary").join(ids.select("class"), "class", "left_semi")
        sets = self.scratch.save(sets.dropDuplicates(["class"]))
        out = self.scratch.save(groups.join(sets, "class").select("g", "class", "members").repartition(F.xxhash64("g")).sortWithinPartitions("g").mapInArrow(_verify, PAIR))
        self.scratch.drop(sets)
        self.scratch.drop(ids)
        return out

    def led(self, nodes: DataFrame) -> DataFrame:
        """Groups of one leader and a bounded number of its followers: each class follows at most one."""
        # a large node is cut into parts, each with the node's first class for a leader
        parts = F.ceil(F.col("size") / LED)
        cut = nodes.select(F.when(F.col("size") <= LED, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("class"), parts))).alias("node"), "class", "sketch")
        large = nodes.filter(F.col("size") > LED).groupBy("node").agg(F.max(parts).alias("parts"), F.min_by(F.struct("class", "sketch"), F.col("class")).alias("first"))
        first = large.select("node", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k")).select(F.xxhash64("node", F.col("k")).alias("node"), "first.class", "first.sketch")
        pairs = self.by_node(cut.unionByName(first)).mapInArrow(_leaders, PAIR).filter("a <> b")
        pairs = self.scratch.save(pairs.groupBy("b").agg(F.min("a").alias("a")).join(self.classes.select(F.col("class").alias("b"), "n"), "b"))
        count = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / LONG)).alias("blocks"))
        follow = pairs.join(count, "a").select("a", F.col("b").alias("class"), F.xxhash64("a", F.pmod(F.xxhash64("b", F.lit(3)), F.col("blocks"))).alias("g"))
        return self.scratch.save(follow.select("g", "class").unionByName(follow.select("g", F.col("a").alias("class")).distinct()))

    def mixed(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of nodes whose members are not all in one component, with their components."""
        rooted = nodes.join(labels.withColumnRenamed("v", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        several = rooted.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("node")
        return rooted.join(several, "node").select("node", "class", "n", "sketch", "root")

    @staticmethod
    def by_node(nodes: DataFrame) -> DataFrame:
        # by a function of the key: a plain key may already be dealt by a join, which adaptive execution can turn into
        # a broadcast that deals nothing, and a node would be cut
        return nodes.repartition(F.xxhash64("node")).sortWithinPartitions("node")

    def apart(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs that may be similar across components, enough of them to connect what a small node connects."""
        return self.scratch.save(self.by_node(self.mixed(nodes, labels)).mapInArrow(_maybe, PAIR))

    def families(self, pairs: DataFrame) -> DataFrame:
        """Groups that hold each pair of the blocks of what the pairs connect."""
        of = components(self.scratch, pairs).withColumnRenamed("v", "class").join(self.classes.select("class", "n"), "class")
        size = of.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / LONG)).alias("blocks"))
        mine = of.join(size, "root").withColumn("k", F.pmod(F.xxhash64("class", F.lit(9)), F.col("blocks")))
        # a block meets itself where it meets another, so (k, k) is needed only if there is one block
        other = mine.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("o <> k or blocks = 1")
        return self.scratch.save(other.select(F.xxhash64("root", F.least("k", "o"), F.greatest("k", "o")).alias("g"), "class"))

    def against(self, many: DataFrame) -> DataFrame:
        """Large nodes as small ones that hold each pair of the node's blocks: exact, whatever the node's size."""
        half = max(2, SMALL // 3)
        size = many.groupBy("node").agg(F.ceil(F.count("*") / half).alias("blocks"))
        mine = many.join(size, "node").withColumn("k", F.pmod(F.xxhash64("class", F.lit(9)), F.col("blocks")))
        other = mine.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.select(F.xxhash64("node", F.least("k", "o"), F.greatest("k", "o")).alias("node"), "class", "n", "sketch")

    def run(self) -> DataFrame:
        """(class, root) for the classes that are linked to another."""
        nodes = self.split(self.classes.select("class", "roots").mapInArrow(_root, "node long, class binary"))
        edges = self.verify(self.led(nodes))
        labels = self.scratch.save(components(self.scratch, edges))
        small = F.col("size") <= SMALL
        pairs, many = self.apart(nodes.filter(small), labels), nodes.filter(~small)
        # what is large and still mixed branches on; each level is written, so plans stay small
        for level in range(DEEPEST + 1):
            many = self.scratch.save(self.mixed(many, labels).drop("root"))
            if many.isEmpty():
                break
            if level == DEEPEST:
                pairs = pairs.unionByName(self.apart(self.against(many), labels))
                break
            nodes = self.split(many.mapInArrow(_branch, NODE))
            pairs, many = pairs.unionByName(self.apart(nodes.filter(small), labels)), nodes.filter(~small)
        if pairs.isEmpty():
            return labels
        return self.scratch.save(components(self.scratch, edges.unionByName(self.verify(self.families(pairs)))))


def _placed(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, key of its text, n, class, component_id, and root, which names the component where an id can't."""
    with Scratch(docs.sparkSession, "neardup") as scratch:
        join = Join(scratch, docs)
        labels = join.run()
        named = join.classes.select("class", "least").join(labels.withColumnRenamed("v", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        names = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = scratch.save(named.select("class", "root").join(names, "root").select("class", "root", "component_id"), keep=True)
        rows = scratch.save(join.rows.select("doc_id", "key", "n", "class"), keep=True)
    alone = rows.filter("n = 0").select("doc_id", "key", "n", "class", F.col("class").alias("root"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(named, "class").select("doc_id", "key", "n", "class", "root", "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, and ``class``, the key of its shingle set."""
    return _placed(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, with their own columns.

    Each component keeps one row, of several with its least id one of the least text key; a null id stands where there
    is no other. Documents without words all stay.
    """
    found = _placed(docs).filter("n > 0").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stands = found.groupBy("root").agg(F.min("key").alias("key__"), F.first("doc_id").alias("id__")).select("id__", "key__")
    void = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    full = docs.filter(~void).withColumn("text__", _text_key()).join(stands, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("text__") == F.col("key__")))
    return full.dropDuplicates(["id__", "key__"]).select(*docs.columns).unionByName(docs.filter(void))
