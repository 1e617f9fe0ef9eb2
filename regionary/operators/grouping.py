"""Grouped operators: shared keys and representatives, votes, agreement and bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_keys(df: DataFrame, key: Column, order: list[str], least: int = 3, most: int = 80) -> DataFrame:
    """AG10 and AG11: per key of ``least`` to ``most`` characters in two rows and more, how many there are and
    the representative, the least by ``order``. One aggregate; partial sums keep a common key light."""
    keyed = df.withColumn("key", key).filter(F.length("key").between(least, most))
    return keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(*order)).alias("first")).filter("members >= 2")


def repeated_edges(df: DataFrame, key: Column, per: list[str], pages: DataFrame, share: float = 0.4, least: int = 2) -> DataFrame:
    """AG9: keys seen in at least max(``least``, int(share * pages)) rows of their group."""
    counts = df.withColumn("key", key).groupBy(*per, "key").agg(F.count("*").alias("seen"))
    return counts.join(pages, per).filter(F.col("seen") >= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("pages")).cast("int"))).select(*per, "key", "seen")


def consensus(df: DataFrame, per: list[str], vote: str, least: int = 4, share: float = 0.75) -> DataFrame:
    """AG7: the winner of each group of ``least`` votes and more that holds ``share`` of them; ties go to the smaller value."""
    tally = df.groupBy(*per, vote).agg(F.count("*").alias("votes"))
    group = tally.groupBy(*per).agg(F.sum("votes").alias("total"), F.min(F.struct((-F.col("votes")).alias("less"), F.col(vote).alias("winner"))).alias("top"))
    won = group.select(*per, F.col("top.winner").alias("winner"), (-F.col("top.less")).alias("votes"), "total")
    return won.filter((F.col("total") >= least) & (F.col("votes") >= share * F.col("total")))


def top_two(df: DataFrame, per: list[str], value: str) -> DataFrame:
    """ST7: the two most frequent values of each group, ties to the smaller one."""
    counts = df.groupBy(*per, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*per).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter("rank <= 2")


def mode_or_median(df: DataFrame, per: list[str], value: str, share: float = 0.8) -> DataFrame:
    """AG4: the median of a group; if its second most frequent value has ``share`` of the first's count, the larger of both."""
    pair = top_two(df, per, value).groupBy(*per).agg(F.max(F.when(F.col("rank") == 1, F.struct("n", value))).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("n", value))).alias("b"))
    middle = df.groupBy(*per).agg(F.expr(f"percentile({value}, 0.5)").alias("middle"))
    close = F.col("b.n") >= share * F.col("a.n")
    return middle.join(pair, per).select(*per, F.when(close, F.greatest(F.col(f"a.{value}"), F.col(f"b.{value}"))).otherwise(F.col("middle")).alias("size"))


def agreement(df: DataFrame, per: list[str], value: str, within: float = 1.0) -> DataFrame:
    """AG5: the most values that lie within ``within`` of some value of the group; a range frame, no self-join."""
    near = F.expr(f"count(*) over (partition by {', '.join(per)} order by {value} range between {within}D preceding and {within}D following)")
    return df.withColumn("near", near).groupBy(*per).agg(F.max("near").alias("agreeing"))


def bag_difference(df: DataFrame, ids: list[str], left: Column, right: Column) -> DataFrame:
    """AG12 and SET4: per id, the values whose counts differ and by how much."""
    one = df.select(*ids, F.explode(left).alias("value"), F.lit(1).alias("sign"))
    two = df.select(*ids, F.explode(right).alias("value"), F.lit(-1).alias("sign"))
    return one.unionByName(two).groupBy(*ids, "value").agg(F.sum("sign").alias("excess")).filter("excess <> 0")


def variants(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """AG17: groups with more than one distinct normalised value."""
    return df.groupBy(*group).agg(F.count_distinct(value).alias("variants")).filter("variants > 1")


def shared_grams(docs: DataFrame, words: int, least: int) -> DataFrame:
    """(a, b, shared, same): pairs of classes of documents that share ``least`` grams or more, and the classes' members.

    Documents with equal sets of shared grams are one class, named by its least id, and grams with equal lists of classes are
    counted together, so that neither copies nor long common passages multiply the pairs. No gram is left out as too common.
    """
    t = F.split(F.lower("text"), " ")
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("t", i, words), " ")))
    g = docs.filter("doc_id is not null").select("doc_id", t.alias("t")).filter(F.size("t") >= words).select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))
    # one shuffle of the grams; most are in one document only and end here
    one, first = W.partitionBy("gram"), W.partitionBy("gram").orderBy("doc_id")
    met = g.select("doc_id", "gram", F.lag("doc_id").over(first).alias("before"), F.min("doc_id").over(one).alias("lo"), F.max("doc_id").over(one).alias("hi"))
    met = met.filter("lo <> hi and (before is null or before <> doc_id)").groupBy("gram").agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
    # 128 bits of a set of grams, besides its size, stand for the set
    lists = met.groupBy("d").agg(F.count("*").alias("k"), *(F.bit_xor(F.xxhash64("gram", F.lit(n))).alias(f"h{n}") for n in (1, 2)))
    rows = lists.select(F.struct("k", "h1", "h2").alias("list"), F.explode("d").alias("doc_id"))
    of = rows.groupBy("doc_id").agg(F.sum("list.k").alias("k"), *(F.bit_xor(f"list.h{n}").alias(f"h{n}") for n in (1, 2))).filter(F.col("k") >= least)
    classes = of.groupBy("k", "h1", "h2").agg(F.min("doc_id").alias("a"))
    members = of.join(classes, ["k", "h1", "h2"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.col("k").alias("shared"), F.lit(True).alias("same"))
    heads = rows.join(classes.select(F.col("a").alias("doc_id")), "doc_id").groupBy("list").agg(F.sort_array(F.collect_list("doc_id")).alias("d")).filter(F.size("d") > 1)
    heads = heads.groupBy("d").agg(F.sum("list.k").alias("k")).select("k", "d", F.posexplode("d").alias("i", "a"))
    pairs = heads.select("k", "a", F.explode(F.slice("d", F.col("i") + 2, F.size("d"))).alias("b")).groupBy("a", "b").agg(F.sum("k").alias("shared")).filter(F.col("shared") >= least)
    return pairs.select("a", "b", "shared", F.lit(False).alias("same")).unionByName(members)
