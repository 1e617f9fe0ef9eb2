"""Components of few and of many edges, against union by hand."""

import numpy as np
import pytest

from regionary.llm import components as C
from regionary.llm.common import Scratch


def by_hand(edges):
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("alone", [C.ALONE, 10])
def test_components_by_either_way(spark, monkeypatch, alone):
    monkeypatch.setattr(C, "ALONE", alone)
    rng = np.random.default_rng(4)
    path = rng.permutation(60)
    long = [(int(a), int(b)) for a, b in [*zip(path[:-1], path[1:]), *(100 + rng.integers(0, 40, (30, 2)))]]
    names = [(bytes([a, 0, 200]), bytes([b, 0, 200])) for a, b in long]
    for edges, kind in ((long, "long"), (names, "binary")):
        with Scratch(spark, "test") as scratch:
            got = C.components(scratch, spark.createDataFrame([*edges, (None, edges[0][0])], f"a {kind}, b {kind}").repartition(3)).collect()
            want = by_hand([e for e in edges if e[0] != e[1]])
            assert len(got) == len(want) and {(bytes(r["v"]), bytes(r["root"])) if kind == "binary" else tuple(r) for r in got} == set(want.items())
            # few edges take one written table for the edges and one for the answer, whatever the length of the path
            assert (scratch.count == 2) == (alone > len(edges))


def test_components_of_no_edges(spark):
    with Scratch(spark, "test") as scratch:
        assert C.components(scratch, spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
