"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates r in [0, cap] that meet the target,
entropy balancing takes the one nearest to 1 in relative entropy. Its convex dual has one
multiplier per source, and the solution is an exponentially tilted rate
r = min(cap, exp(multiplier * size / mean size of the source)). Newton iterations, each one
aggregate over a (source, size) histogram, solve the dual for all sources together. Rates are
then rounded into whole copies by systematic rounding along (size, hash), so the words taken from
a source stay within about one document of its target; of several starts of the rounding the one that comes nearest is taken.

Everything is DataFrame work. A source with a third of all rows is harmless: sums are combined
before the shuffle, and the running counts that rounding needs are taken over
(source, size, hash bucket) cells of about ``CELL_ROWS`` rows.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own,
last in order; repeated rows count and are taken each for itself; other columns are ignored; an empty
table gives an empty result; when no document has words every target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3.0
CELL_ROWS = 1024
MAX_STEPS = 60
OFFSETS = 24
TOLERANCE = 1e-6


def word_count(name: str = "text"):
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def source_key():
    """A source as a non-null string whose order is by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))


def targets(hist: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source: size, mean size and target; the excess of capped sources is reshared by weight.

    With sources in the order of cap * size / weight, a source is capped just if that ratio is at most the
    share per weight that is left for it and the sources after it. One row per source is sorted, not rows.
    """
    per = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(W.orderBy("skey")) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), "skey")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("skey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("share", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("capped", F.col("most") <= F.col("share") * F.col("weight"))
    share = F.max(F.when(~F.col("capped"), F.col("share"))).over(whole)
    return per.select("skey", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(share * F.col("weight")).alias("target"), (F.col("source_size") / F.col("docs")).alias("mean"))


def solve(scratch: Scratch, hist: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """Multiplier per source, by guarded Newton steps on log(words) = log(target).

    A source whose target is its cap, or nothing, needs no step. ``lo`` and ``hi`` bracket the
    root once known; a step that leaves the bracket is replaced by its middle.
    """
    full = F.col("target") >= F.lit(cap * (1 - 1e-9)) * F.col("source_size")
    none = F.col("target") <= 0
    state = goals.select("*", F.when(full, F.lit(float("inf"))).when(none, F.lit(float("-inf"))).otherwise(F.lit(0.0)).alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (full | none).alias("done"))
    state = scratch.save(state)
    for _ in range(MAX_STEPS):
        z = F.col("size") / F.col("mean")
        free = F.exp(F.col("m") * z)
        part = (
            hist.join(state.filter(~F.col("done")), "skey")
            .groupBy("skey")
            .agg(F.sum(F.col("n") * F.col("size") * F.least(F.lit(cap), free)).alias("f"), F.sum(F.when(free < cap, F.col("n") * F.col("size") * z * free).otherwise(0.0)).alias("g"))
        )
        new = state.join(part, "skey", "left")
        over = F.col("f") > F.col("target")
        new = new.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.coalesce(F.when(F.col("f").isNotNull(), F.col("m")), F.col("lo")))).withColumn("hi", F.when(over, F.col("m")).otherwise(F.col("hi")))
        new = new.withColumn("done", F.col("done") | (F.abs(F.col("f") - F.col("target")) <= TOLERANCE * F.col("target")))
        step = F.when(F.col("g") > 0, (F.log("f") - F.log("target")) * F.col("f") / F.col("g"))
        reach = 2.0 + 2.0 * F.abs(F.col("m"))
        step = F.greatest(-reach, F.least(reach, F.coalesce(step, F.when(over, reach).otherwise(-reach))))
        step = F.when(F.isnan(step), F.when(over, reach).otherwise(-reach)).otherwise(step)
        to = F.col("m") - step
        middle = (F.col("lo") + F.col("hi")) / 2
        to = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull() & ((to <= F.col("lo")) | (to >= F.col("hi"))), middle).otherwise(to)
        new = new.withColumn("m", F.when(F.col("done"), F.col("m")).otherwise(to)).select(*state.columns)
        saved = scratch.save(new)
        scratch.drop(state)
        state = saved
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def best_offset(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Per source, the start of systematic rounding, of ``OFFSETS`` ones, whose words come nearest to the target.

    The words that an offset leads to follow from the histogram alone.
    """
    starts = [(k + 0.5) / OFFSETS for k in range(OFFSETS)]

    def words(u: float):
        low = F.col("above") + u
        return F.sum(F.col("size") * (F.col("n") * F.floor("rate") + F.floor(low + F.col("n") * F.col("part")) - F.floor(low)))

    sums = cells.groupBy("skey").agg(*[words(u).alias(f"w{k}") for k, u in enumerate(starts)])
    tries = F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("error"), F.lit(u).alias("offset")) for k, u in enumerate(starts)])
    return sums.join(state.select("skey", "target"), "skey").select("skey", F.array_min(tries)["offset"].alias("offset"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per document row: doc_id, source, size, key (xxhash64 of id and text), source_size,
    target, rate and copies; copies is at most ``cap`` rounded down, for ``cap`` a whole number."""
    spark = docs.sparkSession
    with Scratch(spark, "mixing") as scratch:
        key = F.xxhash64(F.col("doc_id"), text_or_empty())
        base = scratch.save(docs.select("doc_id", "source", source_key().alias("skey"), word_count().alias("size"), key.alias("key")), keep=True)
        hist = scratch.save(base.groupBy("skey", "size").agg(F.count("*").alias("n")))
        rows = hist.agg(F.sum("n").alias("n")).first()["n"] or 0
        goals = scratch.save(targets(hist, weights, cap))
        state = scratch.save(solve(scratch, hist, goals, cap).select("skey", "source_size", "target", "mean", "m"), keep=True)

        rate = F.when(F.col("m") == float("inf"), F.lit(cap)).when(F.col("m") == float("-inf"), F.lit(0.0)).otherwise(F.least(F.lit(cap), F.exp(F.col("m") * F.col("size") / F.col("mean"))))
        rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(rate)
        cells = hist.join(state, "skey").select("skey", "size", "n", rate.alias("rate"))
        cells = cells.withColumn("part", F.col("rate") - F.floor("rate"))
        by_size = W.partitionBy("skey").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
        cells = scratch.save(cells.withColumn("above", F.coalesce(F.sum(F.col("n") * F.col("part")).over(by_size), F.lit(0.0))).select("skey", "size", "rate", "part", "above"))

        state = scratch.save(state.join(best_offset(cells.join(hist, ["skey", "size"]), state), "skey"), keep=True)

        buckets = max(1, -(-rows // CELL_ROWS))
        base = base.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
        by_bucket = W.partitionBy("skey", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        fine = base.groupBy("skey", "size", "bucket").agg(F.count("*").alias("c"))
        fine = fine.withColumn("before", F.coalesce(F.sum("c").over(by_bucket), F.lit(0)))
        fine = scratch.save(fine.join(cells, ["skey", "size"]).select("skey", "size", "bucket", "rate", "part", (F.col("above") + F.col("before") * F.col("part")).alias("start")), keep=True)

    row = F.row_number().over(W.partitionBy("skey", "size", "bucket").orderBy("key", "doc_id")) - 1
    out = base.withColumn("row", row).join(fine, ["skey", "size", "bucket"]).join(state.select("skey", "source_size", "target", "offset"), "skey")
    low = F.col("start") + F.col("row") * F.col("part") + F.col("offset")
    copies = F.floor("rate") + F.floor(low + F.col("part")) - F.floor(low)
    return out.select("doc_id", "source", "size", "key", "source_size", "target", "rate", F.least(copies, F.lit(int(cap))).cast("long").alias("copies"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The documents themselves, each row repeated as often as the mix takes it.

    Rows are matched by (doc_id, hash of the text). Where several rows agree on both, each gets an equal part
    of their copies, and the lowest row numbers one more.
    """
    plan = mix(docs, weights, cap).groupBy("key").agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    names = docs.columns
    keyed = docs.withColumn("key__", F.xxhash64(F.col("doc_id"), text_or_empty()))
    plan = plan.filter("total > 0").select(F.col("key").alias("key__"), F.col("total").alias("total__"), F.col("rows").alias("rows__"))
    both = keyed.join(plan, "key__")
    single = both.filter("rows__ = 1").withColumn("take__", F.col("total__"))
    nth = F.row_number().over(W.partitionBy("key__", F.pmod(F.monotonically_increasing_id(), F.lit(1))).orderBy("key__"))
    several = both.filter("rows__ > 1").withColumn("nth__", nth)
    several = several.withColumn("take__", F.floor(F.col("total__") / F.col("rows__")) + (F.col("nth__") <= F.col("total__") % F.col("rows__")).cast("long")).drop("nth__")
    copies = single.unionByName(several).withColumn("copy__", F.explode(F.array_repeat(F.lit(1), F.col("take__").cast("int"))))
    return copies.select(*names)
