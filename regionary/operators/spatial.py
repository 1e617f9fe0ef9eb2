"""Range and rectangle joins by way of a grid: cells are an equi-join key, the exact predicate follows.

A long interval or large rectangle enters every cell that it covers; a pair is taken in the first cell that both
cover, so nothing is found twice and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cells(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def interval_join(a: DataFrame, b: DataFrame, per: list[str], lo: str, hi: str, width: float) -> DataFrame:
    """JN7 and JN8: pairs of overlapping intervals (closed) within a group; columns get the prefixes a_ and b_."""
    left = a.select(*per, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in per], F.explode(_cells(F.col(lo), F.col(hi), width)).alias("cell"))
    right = b.select(*per, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in per], F.explode(_cells(F.col(lo), F.col(hi), width)).alias("cell"))
    pairs = left.join(right, [*per, "cell"]).filter((F.col(f"a_{lo}") <= F.col(f"b_{hi}")) & (F.col(f"b_{lo}") <= F.col(f"a_{hi}")))
    first = F.floor(F.greatest(f"a_{lo}", f"b_{lo}") / width).cast("long")
    return pairs.filter(F.col("cell") == first).drop("cell")


def tightest_container(points: DataFrame, spans: DataFrame, per: list[str], at: str, point_id: str, lo: str, hi: str, span_id: str, width: float) -> DataFrame:
    """JN4 and JN5 in one dimension: for each point the shortest span that holds it, ties to the smaller id."""
    cells = spans.select(*per, lo, hi, span_id, F.explode(_cells(F.col(lo), F.col(hi), width)).alias("cell"))
    at_cell = points.withColumn("cell", F.floor(F.col(at) / width).cast("long"))
    found = at_cell.join(cells, [*per, "cell"]).filter(F.col(at).between(F.col(lo), F.col(hi)))
    return found.groupBy(*per, point_id).agg(F.min(F.struct((F.col(hi) - F.col(lo)).alias("size"), F.col(span_id).alias("span"))).alias("best")).select(*per, point_id, F.col("best.span").alias(span_id), F.col("best.size").alias("size"))


def rect_join(a: DataFrame, b: DataFrame, per: list[str], cell: float, least: float = 1.0) -> DataFrame:
    """JN8 in two dimensions: pairs of rectangles (``id``, ``box``) that overlap by more than ``least``."""
    from ..functions import rects

    def spread(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*per, F.col("id").alias(f"{p}_id"), F.col("box").alias(f"{p}_box"), F.explode(_cells(F.col("box.x0"), F.col("box.x1"), cell)).alias("cx"), F.col("box.y0").alias("_lo"), F.col("box.y1").alias("_hi"))
        return out.withColumn("cy", F.explode(_cells(F.col("_lo"), F.col("_hi"), cell))).drop("_lo", "_hi")

    pairs = spread(a, "a").join(spread(b, "b"), [*per, "cx", "cy"])
    first = (F.col("cx") == F.floor(F.greatest("a_box.x0", "b_box.x0") / cell)) & (F.col("cy") == F.floor(F.greatest("a_box.y0", "b_box.y0") / cell))
    return pairs.filter(first & (rects.overlap_area(F.col("a_box"), F.col("b_box")) > least)).drop("cx", "cy")


def first_claim(pairs: DataFrame, item: list[str], order: list[str]) -> DataFrame:
    """JN4 and JN10: of an item's candidates the first by ``order``; each item is consumed once."""
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy(*item).orderBy(*order))).filter("_n = 1").drop("_n")


def nearest_limits(boxes: DataFrame, obstacles: DataFrame, per: list[str], page: Column, gap: float = 2.0) -> DataFrame:
    """JN6: how far right and down each box may grow before the nearest obstacle in its band, less ``gap``."""
    o = obstacles.select(*per, F.col("box").alias("o"))
    j = boxes.join(o, per, "left")
    right = F.min(F.when((F.col("o.x0") >= F.col("box.x1")) & (F.col("o.y0") < F.col("box.y1")) & (F.col("o.y1") > F.col("box.y0")), F.col("o.x0") - gap))
    down = F.min(F.when((F.col("o.y0") >= F.col("box.y1")) & (F.col("o.x0") < F.col("box.x1")) & (F.col("o.x1") > F.col("box.x0")), F.col("o.y0") - gap))
    out = j.groupBy(*per, "id", "box").agg(right.alias("r"), down.alias("d"))
    return out.select(*per, "id", F.greatest(F.col("box.x1"), F.coalesce("r", page["x1"])).alias("right"), F.greatest(F.col("box.y1"), F.coalesce("d", page["y1"])).alias("bottom"))
