"""Queries that leave no row out, against brute force on tables with large groups."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionary.functions import text as T
from regionary.operators import fit, grouping


def test_shared_grams_of_large_groups(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    copy, passage = words(40), words(30)
    texts = [copy] * 30 + [words(5) + passage + words(5) for _ in range(25)] + [copy[:30] + words(9) for _ in range(3)] + [words(40), copy[:20], ["a"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 8]) for i in range(len(t) - 7)} for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 20}
    rows = grouping.shared_grams(docs, words=8, least=20).collect()
    members, k = {}, {}
    for r in rows:
        if r["same"]:
            members.setdefault(r["a"], [r["a"]]).append(r["b"])
            k[r["a"]] = r["shared"]
    got = Counter({p: k[a] for a, m in members.items() for p in combinations(sorted(m), 2)})
    for r in rows:
        if not r["same"]:
            got.update({(min(x, y), max(x, y)): r["shared"] for x in members.get(r["a"], [r["a"]]) for y in members.get(r["b"], [r["b"]])})
    assert got == want and len(want) > 700


@pytest.mark.parametrize("block", [7, 4096])


def test_last_baselines_of_all_rows(spark, block):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(3)) if i % 2 else 9, None if i % 50 == 3 else float(rng.integers(0, 2000))) for i in range(800)]
    want = {}
    for _, u, v in rows:
        y = want.get(u)
        want[u] = v if y is None else y + 1.5 if v is None else max(v, y + 1.5)
    got = {r["user_id"]: r["last"] for r in fit.last_baselines(spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(5), "user_id", "event_id", "value", 1.5, block).collect()}
    assert got == want


def test_coverage_finds_lost_text(spark):
    long = "the same first twenty characters, "
    rows = [(long + "end", "x " + long + "end", "", True, "window"), (long + "lost", long + "end", long + "end", False, "missing"), ("a b", "", "z a b", False, "page"),
            ("a bc", "", "zab c", False, "page"), ("abca", "", "c a b a", True, "reordered"), ("abca", "", "c a b a", False, "missing"), ("abca", "", "c a b", True, "missing")]
    df = spark.createDataFrame(rows, "t string, w string, page string, kept boolean, want string")
    got = df.select("want", T.coverage(F.col("t"), F.col("w"), F.col("page"), F.col("kept")).alias("found")).collect()
    assert [r["found"] for r in got] == [r["want"] for r in got]
