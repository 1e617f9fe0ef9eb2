"""Small scenarios for the operators, with our own wording."""

import pandas as pd
from pyspark.sql import functions as F

from regionary.functions import rects
from regionary.functions import text as T
from regionary.operators import fit, grouping, ordered, requests, spatial
from regionary.sources import files
from regionary.streaming import responses


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_mask_round_trip_and_numbers(spark):
    text = "Write to ann@site.org or https://x.org/a?b=1, supply 12 V and 5 mm, twice 12 V, type AB12-C."
    r = one(spark, t=text).select(T.mask(F.col("t")).alias("m")).select("m.*", T.restore(F.col("m.masked"), F.col("m.tokens")).alias("back")).first()
    assert r["back"] == text and "@" not in r["masked"] and r["tokens"]["MEAS_3"] == "12 V" and r["tokens"]["MODEL_1"] == "AB12-C"


def test_authenticity_needs_evidence(spark):
    df = spark.createDataFrame([("alpha beta gamma delta", "Alpha  beta gamma delta"), ("one two", "one two"), ("alpha beta gamma delta epsilon zeta eta theta", "alpha beta")], ["s", "t"])
    assert [r[0] for r in df.select(T.authenticity(F.col("s"), F.col("t"))).collect()] == ["identical", None, "truncated"]


def test_symbol_negation_artifact(spark):
    r = one(spark, s="do not open if x < 3", t="```ouvrir si x > 3").select(T.symbol_drift(F.col("s"), F.col("t")), T.negation_drop(F.col("s"), F.col("t")), T.artifact(F.col("s"), F.col("t"))).first()
    assert tuple(r) == (2, True, "fence")


def test_slug_and_readability(spark):
    r = one(spark, a="  My File (2).PDF", b="zz zz").select(T.slug(F.col("a")), T.readable_ratio(F.col("b"))).first()
    assert tuple(r) == ("my_file_2_pdf", None)


def test_intervals_merge_through_a_long_one(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 2), (1, 9, 12), (1, 14, 15)], "p int, lo int, hi int")
    assert sorted(tuple(r)[1:] for r in ordered.merged_intervals(df, ["p"], "lo", "hi", 1).collect()) == [(0, 12, 3), (14, 15, 1)]


def test_consensus_and_ties(spark):
    df = spark.createDataFrame([("a", v) for v in "LLLLLLC"] + [("b", v) for v in "LC"], "g string, v string")
    assert [tuple(r) for r in grouping.consensus(df, ["g"], "v").collect()] == [("a", "L", 6, 7)]


def test_batches_never_cut_a_held_row(spark):
    df = spark.createDataFrame([("j", i, 1 + i // 4, i == 4) for i in range(8)], "job string, i int, page int, held boolean")
    got = ordered.batches(df, ["job"], ["i"], "page", "held", most=3).orderBy("i").toPandas()["batch"].tolist()
    assert got == [0, 0, 0, 1, 1, 1, 2, 2]


def test_rect_join_finds_a_pair_once(spark):
    big = lambda x0, y0, x1, y1: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])
    a = spark.range(1).select(F.lit(1).alias("p"), F.lit("a").alias("id"), big(0, 0, 100, 100).alias("box"))
    b = spark.range(1).select(F.lit(1).alias("p"), F.lit("b").alias("id"), big(50, 50, 300, 300).alias("box"))
    assert spatial.rect_join(a, b, ["p"], 10.0).count() == 1
    assert a.select(rects.area(F.col("box"))).first()[0] == 10000.0


def test_wrap_and_baselines(spark):
    df = one(spark, t="aaa bb cccc d", y=[1.0, 1.2, 9.0])
    r = df.select(fit.wrapped_lines(F.split("t", " "), 6.0), fit.wrapped_lines(F.split("t", " "), 3.0), fit.baselines(F.col("y"), F.lit(2.0))).first()
    assert tuple(r) == (2, None, [1.0, 3.0, 9.0])


def test_largest_size_is_monotone(spark):
    size = fit.largest_size()
    df = spark.createDataFrame(pd.DataFrame({"t": ["word " * 40] * 3, "w": [100.0, 200.0, 10.0], "h": [60.0, 60.0, 60.0]}))
    a, b, c = [r[0] for r in df.select(size("t", "w", "h")).collect()]
    assert 4 <= a < b <= 14 and c is None


def test_files(spark, tmp_path):
    assert files.read_jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "g.csv").write_text("term,type,target,note\n alpha ,,x,\n,keep,,\nbeta,locked,y,\n")
    got = files.read_glossary(spark, str(tmp_path / "g.csv")).orderBy("term").collect()
    assert [(r["term"], r["type"]) for r in got] == [("alpha", "keep"), ("beta", "locked")]


def test_stream_keeps_the_latest(spark, tmp_path):
    spark.createDataFrame([("r", 1, "old"), ("r", 2, "new"), ("s", 1, "x")], "region string, seq int, v string").write.json(f"{tmp_path}/in")
    stream = responses.read_responses(spark, f"{tmp_path}/in", "region string, seq int, v string")
    responses.keep_latest(stream, ["region"], ["seq"], f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert {r["region"]: r["v"] for r in spark.read.parquet(f"{tmp_path}/out/v0").collect()} == {"r": "new", "s": "x"}


def test_term_hits_of_more_words_than_blanks(spark):
    docs = spark.createDataFrame([(1, "He said: One.Two\nThree four"), (2, "one two, four three"), (3, "..."), (4, None), (5, "two"), (6, "on one two threes")], "doc_id int, text string")
    terms = spark.createDataFrame([("one.\nTwo Three",), ("Two ",), ("-",), (None,), ("said one two three four",), ("two",)], "term string")
    got = sorted(tuple(r) for r in requests.term_hits(docs, "doc_id", "text", terms).collect())
    two = [(i, t) for i in (1, 2, 5, 6) for t in ("Two ", "two")]
    assert got == sorted([(1, "one.\nTwo Three"), (1, "said one two three four"), (3, "-"), *two])
