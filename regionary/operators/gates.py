"""Gates over supplied tables of painted lines, kept lines, rules, images, clusters and links; each gives issues (job, page, id, code, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rects
from .spatial import rect_join

PAGE = ["job", "page"]


def _issue(df: DataFrame, code: str, severity: str) -> DataFrame:
    return df.select(*PAGE, "id", F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def ratio_floor(regions: DataFrame, floor: float = 0.85, turned: float = 0.6) -> DataFrame:
    """GT4: painted smaller than allowed; turned text has a floor of its own."""
    least = F.when(F.col("rotation").isin(90, 270), turned).otherwise(floor)
    return _issue(regions.filter(F.col("ratio") < least - 1e-6), "G4_RATIO_FLOOR", "P0")


def overflow(lines: DataFrame, tol: float = 1.0, slack: float = 0.6) -> DataFrame:
    """GT4: painted lines (id, box, container, size, rotation) outside their container; under the lower edge ``slack`` sizes are allowed, with a note."""
    b, c = F.col("box"), F.col("container")
    out = F.greatest(c["x0"] - b["x0"], b["x1"] - c["x1"], c["y0"] - b["y0"])
    under, room = b["y1"] - c["y1"], F.greatest(F.lit(tol), slack * F.col("size"))
    flat = lines.filter("rotation = 0")
    bad = (out > tol) | (under > room)
    return _issue(flat.filter(bad), "G4_OUT_OF_CONTAINER", "P1").unionByName(_issue(flat.filter(~bad & (under > tol)), "G4_BOTTOM_SLACK", "P2"))


def rule_crossings(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """GT4 and JN9: table cells whose painted line is cut by a vertical rule (x inside by 1, heights overlapping by 0.5); one issue a region."""
    r = rules.select(*PAGE, "x", F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    j = lines.filter("rotation = 0 and kind = 'table_cell'").join(r, PAGE)
    hit = j.filter((F.col("box.x0") + 1 < F.col("x")) & (F.col("x") < F.col("box.x1") - 1) & (F.col("r0") < F.col("box.y1") - 0.5) & (F.col("r1") > F.col("box.y0") + 0.5))
    return _issue(hit.select(*PAGE, "id").distinct(), "G4_TABLE_RULE_CROSS", "P1")


def collisions(painted: DataFrame, kept: DataFrame, cell: float = 128.0) -> DataFrame:
    """GT4 and JN8: painted lines over kept ones by more than an area of 1; one issue a painted line."""
    pairs = rect_join(painted.filter("rotation = 0"), kept, PAGE, cell)
    return _issue(pairs.select(*PAGE, F.col("a_id").alias("id")).distinct(), "G4_COLLISION", "P1")


def page_boxes(before: DataFrame, after: DataFrame) -> DataFrame:
    """GT4: pages that are gone or new, or whose box or turn has changed."""
    j = before.select(*PAGE, F.struct("box", "rotation").alias("a")).join(after.select(*PAGE, F.struct("box", "rotation").alias("b")), PAGE, "full")
    gone = F.col("a").isNull() | F.col("b").isNull()
    code = F.when(gone, "G4_PAGE_COUNT").when(F.col("a") != F.col("b"), "G4_PAGE_BOX")
    return j.withColumn("code", code).filter("code is not null").select(*PAGE, F.lit(None).cast("string").alias("id"), "code", F.lit("P0").alias("severity"))


def matched_images(want: DataFrame, have: DataFrame, tol: float = 1.0) -> DataFrame:
    """JN10 and GT5: wanted images (n, digest, box) with the image of the draft (n, digest, box) that stands for each, one to one.

    Images of equal digest and place within ``tol`` stand for each other. Wanted images with the same first candidate take
    the candidates by rank, in order, so that none is used twice; ``have`` is null where none is left.
    """
    w = want.select(*PAGE, "digest", F.col("n").alias("want"), F.col("box").alias("w"))
    h = have.select(*PAGE, "digest", F.col("n").alias("have"), F.col("box").alias("h"))
    apart = F.greatest(*[F.abs(F.col(f"w.{k}") - F.col(f"h.{k}")) for k in ("x0", "y0", "x1", "y1")])
    pairs = w.join(h, [*PAGE, "digest"]).filter(apart <= tol)
    group = pairs.withColumn("among", F.min("have").over(W.partitionBy(*PAGE, "digest", "want")))
    rank_w = F.dense_rank().over(W.partitionBy(*PAGE, "digest", "among").orderBy("want"))
    rank_h = F.dense_rank().over(W.partitionBy(*PAGE, "digest", "among").orderBy("have"))
    found = group.withColumn("kw", rank_w).withColumn("kh", rank_h).filter("kw = kh").select(*PAGE, "digest", "want", "have")
    return w.join(found, [*PAGE, "digest", "want"], "left").select(*PAGE, "digest", "want", "have")


def lost_links(want: DataFrame, have: DataFrame) -> DataFrame:
    """GT5, JN11, RG10: links of the source (kind, uri, target and place to whole points) that the draft lacks."""
    key = lambda d: d.select(*PAGE, "kind", "uri", "target", *[F.round(F.col(f"box.{k}")).cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")])
    return key(want).subtract(key(have))


def lost_clusters(want: DataFrame, have: DataFrame, removed: DataFrame, tol: float = 1.5) -> DataFrame:
    """JN20 and GT5: per page the wanted vector clusters less those removed on purpose, against what is there; pages whose numbers differ."""
    r = removed.select(*PAGE, F.col("box").alias("r"))
    c = want.select(*PAGE, "n", "box")
    meant = c.join(r, PAGE).filter(F.greatest(*[F.abs(F.col(f"box.{k}") - F.col(f"r.{k}")) for k in ("x0", "y0", "x1")]) <= tol).select(*PAGE, "n").distinct()
    left = c.join(meant, [*PAGE, "n"], "left_anti").groupBy(*PAGE).agg(F.count("*").alias("wanted"))
    there = have.groupBy(*PAGE).agg(F.count("*").alias("found"))
    return left.join(there, PAGE, "full").na.fill(0, ["wanted", "found"]).filter("wanted <> found")


def structure(files: DataFrame, most: float = 3.0) -> DataFrame:
    """GT7: encrypted drafts and left-over annotations are P0, a draft over ``most`` times the source's size is P2. One row a file and code."""
    rules = [("encrypted", "G7_ENCRYPTED", "P0"), ("annotations > 0", "G7_ANNOTATIONS", "P0"), (f"draft_bytes > {most} * source_bytes", "G7_SIZE", "P2")]
    fired = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for rule, code, s in rules]))
    return files.select("job", F.explode(fired).alias("i")).select("job", "i.*")


def integrity(issues: DataFrame, flags: DataFrame, most: float = 0.05) -> DataFrame:
    """GT2: per job, whether the validator left no P0 or P1 and the shares of identical and suspect targets are within ``most``."""
    open_ = issues.groupBy("job").agg(F.count_if(F.col("severity").isin("P0", "P1")).alias("open"))
    shares = flags.groupBy("job").agg(F.avg(F.col("identical").cast("int")).alias("identical"), F.avg(F.col("suspect").cast("int")).alias("suspect"))
    out = shares.join(open_, "job", "left").na.fill(0, ["open"])
    return out.withColumn("passed", (F.col("open") == 0) & (F.col("identical") <= most) & (F.col("suspect") <= most))


def coverage(regions: DataFrame) -> DataFrame:
    """GT1: per job how many regions have no decision, no target or are left to a human; all must be none."""
    g = regions.groupBy("job").agg(
        F.count_if(F.col("action").isNull()).alias("pending"),
        F.count_if((F.col("action") == "translate") & F.col("target").isNull()).alias("untranslated"),
        F.count_if(F.col("action") == "manual").alias("manual"),
    )
    return g.withColumn("passed", (F.col("pending") == 0) & (F.col("untranslated") == 0) & (F.col("manual") == 0))


def release(jobs: DataFrame, issues: DataFrame, waivers: DataFrame) -> DataFrame:
    """GT9: a job is released if it is whole, its status allows it, a human asks, nothing is P0 and every P1 code is waived."""
    open_ = issues.filter("severity = 'P0'").select("job").unionByName(issues.filter("severity = 'P1'").join(waivers.select("job", "code"), ["job", "code"], "left_anti").select("job"))
    bars = open_.groupBy("job").agg(F.count("*").alias("bars"))
    ok = ~F.col("partial") & F.col("status").isin("AUTO_QA_PASS", "NEEDS_REVIEW") & F.col("human") & (F.col("bars") == 0)
    return jobs.join(bars, "job", "left").na.fill(0, ["bars"]).withColumn("released", ok)


def masks(targets: DataFrame, protected: DataFrame, pads: tuple[float, ...] = (1.0, 0.5, 0.05, 0.0)) -> DataFrame:
    """FT10: for each box to blank out the largest pad that touches nothing protected, else none and a conflict. ``protected`` has job, page and box."""
    p = protected.select(*PAGE, F.col("box").alias("p"))
    touches = lambda pad: F.coalesce(F.bool_or(rects.overlap_area(rects.grown(F.col("box"), pad), F.col("p")) > 0), F.lit(False))
    g = targets.join(p, PAGE, "left").groupBy(*PAGE, "id", "box").agg(*[touches(pad).alias(f"_t{k}") for k, pad in enumerate(pads)])
    pad: Column = F.lit(None).cast("double")
    for k in range(len(pads) - 1, -1, -1):
        pad = F.when(~F.col(f"_t{k}"), F.lit(float(pads[k]))).otherwise(pad)
    return g.select(*PAGE, "id", "box", pad.alias("pad"), pad.isNull().alias("conflict"))
