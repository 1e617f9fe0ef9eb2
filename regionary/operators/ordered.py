"""Ordered operators: islands, interval merge, carried headings, latest rows, chains and folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def islands(df: DataFrame, per: list[str], order: list[str], starts: Column) -> DataFrame:
    """WN2 and WN4: numbers the runs of each group; ``starts`` says where a new one begins (null: it doesn't)."""
    w = W.partitionBy(*per).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merged_intervals(df: DataFrame, per: list[str], lo: str, hi: str, gap: float = 0.0) -> DataFrame:
    """WN10: intervals that overlap or are at most ``gap`` apart become one; the running end decides."""
    w = W.partitionBy(*per).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = islands(df.withColumn("_reach", reach), per, [lo, hi], F.col(lo) > F.col("_reach") + gap)
    return runs.groupBy(*per, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("parts")).drop("island")


def last_heading(df: DataFrame, per: list[str], order: list[str], is_heading: Column, title: Column, itself: bool = True) -> Column:
    """WN5 and WN6: the last heading up to a row, with or without the row itself."""
    w = W.partitionBy(*per).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if itself else -1)
    return F.last(F.when(is_heading, title), ignorenulls=True).over(w)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """WN14: the last row of each key. As an aggregate, so a common key meets in partial maxima and not in one sort."""
    return df.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in order + key])).alias("row")).select(*key, "row.*")


def neighbours(df: DataFrame, per: list[str], order: list[str], value: str) -> DataFrame:
    """JN12: the previous and next value of each row."""
    w = W.partitionBy(*per).orderBy(*order)
    return df.withColumn("prev", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def chains(df: DataFrame, per: list[str], order: list[str], links: Column, most: int = 40) -> DataFrame:
    """GR2: runs of rows whose link to the row before holds, of two rows and more, cut to ``most``; with position k of n."""
    runs = islands(df, per, order, ~F.coalesce(links, F.lit(False)))
    w = W.partitionBy(*per, "island")
    placed = runs.withColumn("position", F.row_number().over(w.orderBy(*order))).filter(F.col("position") <= most)
    return placed.withColumn("length", F.count("*").over(w)).filter("length >= 2")


def batches(df: DataFrame, per: list[str], order: list[str], page: str, held: str, most: int = 20) -> DataFrame:
    """GR6: numbers batches in order; a new one begins on another page or after ``most`` rows, never where ``held``.

    A batch always begins on another page where not held, so a group (a job) is cut there first; the size restarts at each cut, so
    between two such places this is a fold, and the batches of all parts before give the numbers.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, number, size, on = [], 0, 0, None
        for p, h in zip(pdf[page], pdf[held], strict=True):
            if size and (p != on or size >= most) and not h:
                number, size = number + 1, 0
            size, on = size + 1, p
            out.append(number)
        return pdf.assign(batch=out)

    turned = ~F.col(page).eqNullSafe(F.lag(page).over(W.partitionBy(*per).orderBy(*order))) & ~F.col(held)
    parts = islands(df, per, order, turned)
    local = parts.groupBy(*per, "island").applyInPandas(fold, StructType([*parts.schema.fields, StructField("batch", LongType())]))
    counts = local.groupBy(*per, "island").agg((F.max("batch") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*per).orderBy("island").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = local.join(counts.withColumn("_before", before).drop("_n"), [*per, "island"])
    return out.withColumn("batch", F.col("batch") + F.col("_before")).select(*df.columns, "batch")


def illegal_steps(df: DataFrame, per: list[str], order: list[str], status: str, allowed: DataFrame) -> DataFrame:
    """WN15 and the status lattice: steps to another status that ``allowed`` (from_status, to_status) lacks."""
    steps = df.withColumn("from_status", F.lag(status).over(W.partitionBy(*per).orderBy(*order))).withColumnRenamed(status, "to_status")
    steps = steps.filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("to_status")))
    return steps.join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti")


def reading_order(y: Column, x: Column, row: float = 4.0) -> list[Column]:
    """ST1: rows of ``row`` points by half-even rounding, then from the left."""
    return [F.bround(y / row), x]
