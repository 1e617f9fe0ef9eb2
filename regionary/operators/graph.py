"""The context graph: links between neighbouring regions, edges, chains and what regions take from them.

A region is a row with ``job``, ``page``, ``idx`` (its reading index on the page), ``id``, ``kind``, ``text``, ``box``, ``size`` and
``n_lines``. A job is one document, so a window over a job is bounded by a document's regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reading as R

MOST = 40


def flow_score(a: Column, b: Column, line_height: Column) -> Column:
    """JN13: the score of running text from a to b, null where b does not go on."""
    gap, dx = b["box"]["y0"] - a["box"]["y1"], F.abs(b["box"]["x0"] - a["box"]["x0"])
    words = F.size(F.filter(F.split(a["text"], r"(?U)\s+"), lambda w: w != ""))
    holds = (
        a["kind"].isin(*R.FLOW_TYPES)
        & b["kind"].isin(*R.FLOW_TYPES)
        & ~R.heading_like(a["text"])
        & ~R.contents_line(a["text"])
        & ~R.contents_line(b["text"])
        & ~R.caption(b["text"])
        & ~R.label_value(b["text"])
        & R.soft_end(a["text"])
        & (words >= 4)
        & gap.between(0, 0.7 * line_height)
        & (dx <= 10)
        & (F.abs(b["size"] - a["size"]) <= 0.5)
    )
    return F.when(holds, F.round(1 - 0.3 * gap / F.greatest(line_height, F.lit(1.0)) - 0.1 * dx / 10, 3))


def stack_score(a: Column, b: Column) -> Column:
    """JN13: 0.9 for two labels stacked closely with an edge or their centres in line."""
    gap = b["box"]["y0"] - a["box"]["y1"]
    one = F.greatest((a["box"]["y1"] - a["box"]["y0"]) / F.greatest(a["n_lines"], F.lit(1)), F.lit(1.0))
    middle = lambda r: (r["box"]["x0"] + r["box"]["x1"]) / 2
    aligned = (F.abs(a["box"]["x0"] - b["box"]["x0"]) <= 8) | (F.abs(middle(a) - middle(b)) <= 8) | (F.abs(a["box"]["x1"] - b["box"]["x1"]) <= 8)
    both = a["kind"].isin(*R.LABEL_TYPES) & b["kind"].isin(*R.LABEL_TYPES)
    return F.when(both & gap.between(-1, 0.12 * one) & aligned, F.lit(0.9))


_PARTS = ("id", "kind", "text", "box", "size", "n_lines", "idx")


def page_links(regions: DataFrame) -> DataFrame:
    """JN13: (job, page, from, to, score) of consecutive reading indices on a page; one sort a page."""
    page = W.partitionBy("job", "page")
    height = F.coalesce(F.median(F.col("box.y1") - F.col("box.y0")).over(page), F.lit(12.0))
    a = F.struct(*_PARTS)
    pairs = regions.select("job", "page", a.alias("a"), F.lead(a).over(page.orderBy("idx")).alias("b"), height.alias("lh")).filter(F.col("b.idx") - F.col("a.idx") == 1)
    score = F.coalesce(flow_score(F.col("a"), F.col("b"), F.col("lh")), stack_score(F.col("a"), F.col("b")))
    return pairs.select("job", "page", F.col("a.id").alias("from"), F.col("b.id").alias("to"), score.alias("score")).filter("score is not null")


def sibling_labels(regions: DataFrame) -> DataFrame:
    """WN9: labels next to each other among a page's labels, at most two reading indices apart."""
    w = W.partitionBy("job", "page").orderBy("idx")
    near = regions.filter(F.col("kind").isin(*R.LABEL_TYPES)).select("job", "page", F.col("id").alias("from"), F.lead("id").over(w).alias("to"), (F.lead("idx").over(w) - F.col("idx")).alias("d"))
    return near.filter("d <= 2").select("job", "page", "from", "to")


def page_breaks(regions: DataFrame, least: int = 25) -> DataFrame:
    """JN14: the last running text of a page with the first of the next, if the one stops within a sentence and the other starts in lower case."""
    flow = regions.filter(F.col("kind").isin(*R.FLOW_TYPES)).groupBy("job", "page")
    ends = flow.agg(F.max_by(F.struct("id", "text"), F.col("idx")).alias("last"), F.min_by(F.struct("id", "text"), F.col("idx")).alias("first"))
    after = ends.select("job", (F.col("page") - 1).alias("page"), F.col("first").alias("next"))
    t = F.trim("last.text")
    holds = (F.length(t) > least) & R.soft_end(t) & F.trim("next.text").rlike(r"^\p{Ll}")
    return ends.join(after, ["job", "page"]).filter(holds).select("job", "page", F.col("last.id").alias("from"), F.col("next.id").alias("to"))


def edges(regions: DataFrame) -> DataFrame:
    """GR1: ``continues`` within a page with its score, over a page break with 0.8 where the region has no successor yet, and ``co_figure`` with 0.6."""
    same = page_links(regions).select("job", F.lit("continues").alias("type"), "from", "to", "score", F.lit(False).alias("cross_page"))
    over = page_breaks(regions).join(same.select("job", "from"), ["job", "from"], "left_anti").select("job", F.lit("continues").alias("type"), "from", "to", F.lit(0.8).alias("score"), F.lit(True).alias("cross_page"))
    beside = sibling_labels(regions).select("job", F.lit("co_figure").alias("type"), "from", "to", F.lit(0.6).alias("score"), F.lit(False).alias("cross_page"))
    return same.unionByName(over).unionByName(beside)


def chain_members(regions: DataFrame, links: DataFrame, most: int = MOST) -> DataFrame:
    """GR2-GR4: each region in a chain, its chain's head, kind, length and its position; chains are cut after ``most`` regions.

    A link joins running text with running text or label with label, next to each other among the job's regions of
    that family, so chains are runs within the family's reading order.
    """
    family = F.when(F.col("kind").isin(*R.LABEL_TYPES), "label_stack").when(F.col("kind").isin(*R.FLOW_TYPES), "flow")
    to = links.filter("type = 'continues'").select("job", F.col("to").alias("id"), F.lit(True).alias("linked"))
    rows = regions.withColumn("family", family).filter("family is not null").join(to, ["job", "id"], "left")
    order = W.partitionBy("job", "family").orderBy("page", "idx")
    rows = rows.withColumn("run", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    chain = W.partitionBy("job", "family", "run")
    rows = rows.withColumn("position", F.row_number().over(chain.orderBy("page", "idx"))).filter(F.col("position") <= most)
    rows = rows.withColumn("length", F.count("*").over(chain).cast("int")).withColumn("chain", F.first("id").over(chain.orderBy("page", "idx")))
    return rows.filter("length > 1").select("job", "id", "chain", F.col("family").alias("chain_kind"), "position", "length", "text", "page", "idx")


def chains(members: DataFrame, cut: int = 600) -> DataFrame:
    """GR2 and GR4: a row per chain: its regions in order, their texts joined and cut."""
    parts = F.array_sort(F.collect_list(F.struct("position", "id", "text")))
    rows = members.groupBy("job", "chain", "chain_kind").agg(parts.alias("parts"))
    return rows.select("job", "chain", "chain_kind", F.col("parts.id").alias("region_ids"), F.substring(F.array_join(F.transform("parts", lambda p: F.trim(p["text"])), " "), 1, cut).alias("source_joined"))


def with_chains(regions: DataFrame, members: DataFrame) -> DataFrame:
    """GR3: chain and position ``k/n`` written to their regions; a stale chain goes."""
    at = members.select("job", "id", "chain", F.concat_ws("/", F.col("position"), F.col("length")).alias("chain_position"))
    return regions.drop("chain", "chain_position").join(at, ["job", "id"], "left")


def siblings(links: DataFrame, most: int = 4) -> DataFrame:
    """GR5: the co-figure neighbours of a region in both directions, the first ``most`` by id (ST6)."""
    co = links.filter("type = 'co_figure'")
    both = co.select("job", F.col("from").alias("id"), F.col("to").alias("other")).unionByName(co.select("job", F.col("to").alias("id"), F.col("from").alias("other")))
    return both.groupBy("job", "id").agg(F.slice(F.array_sort(F.collect_set("other")), 1, most).alias("siblings"))


def statistics(regions: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """AG20: per job its regions, edges by type, chains and the longest one."""
    e = links.groupBy("job").agg(F.count_if(F.col("type") == "continues").alias("continues"), F.count_if(F.col("type") == "co_figure").alias("co_figure"))
    c = members.groupBy("job").agg(F.count_distinct("chain").alias("chains"), F.max("length").cast("long").alias("chains_max_len"))
    out = regions.groupBy("job").agg(F.count("*").alias("regions")).join(e, "job", "left").join(c, "job", "left")
    return out.na.fill(0)
