"""Sources over decoded page tables: rules, tables, hidden text and sibling files. Decoding itself stays outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rects
from ..functions.text import no_blanks, source_key

PAGE = ["job", "page"]


def chars_of(lines: DataFrame) -> DataFrame:
    """SRC5: a decoded page's nested lines (job, page, block, n, spans) to one row per character, numbered within its line; blanks are kept (FLT11 drops them)."""
    spans = lines.select(*PAGE, "block", "n", F.posexplode("spans").alias("s", "span"))
    return spans.select(*PAGE, "block", "n", "s", "span.size", "span.font", "span.flags", F.posexplode("span.chars").alias("k", "char")).select(*PAGE, "block", "n", "s", "k", "size", "font", "flags", "char.*")


def ink(chars: Column) -> Column:
    """FLT11: the characters of a span that are not blank."""
    return F.filter(chars, lambda c: ~c["c"].rlike(r"(?U)^\s*$"))


def ink_box(chars: Column) -> Column:
    """FLT11: the box of the ink of an array of characters (c, box); null without ink."""
    some = ink(chars)
    edge = lambda f, k: f(F.transform(some, lambda c: c["box"][k]))
    return F.when(F.size(some) > 0, rects.rect(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")))


def hidden_text(traced: DataFrame, primary: DataFrame, lines: DataFrame, page: Column) -> DataFrame:
    """SRC6: traced spans that the primary text lacks: not of the invisible type 3, not within the page's text when blanks are taken out, at
    least half on the page, and with no more than half of their characters centred in a known line.

    ``traced`` has job, page, id, type, text, box and chars (array of box); ``primary`` job, page and text; ``lines`` job, page and box.
    """
    t = traced.filter("type <> 3").join(primary.select(*PAGE, no_blanks(F.col("text")).alias("_all")), PAGE, "left")
    t = t.filter(~F.coalesce(F.contains("_all", no_blanks(F.col("text"))), F.lit(False))).drop("_all")
    t = t.filter(rects.overlap_area(F.col("box"), page) >= 0.5 * rects.area(F.col("box")))
    c = t.select(*PAGE, "id", F.posexplode("chars").alias("k", "b"))
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    known = c.join(lines.select(*PAGE, F.col("box").alias("l")), PAGE).filter(rects.has_point(F.col("l"), x, y)).select(*PAGE, "id", "k").distinct().groupBy(*PAGE, "id").agg(F.count("*").alias("known"))
    return t.join(known, [*PAGE, "id"], "left").filter(F.coalesce("known", F.lit(0)) <= 0.5 * F.size("chars")).drop("known")


def baseline_rows(chars: DataFrame) -> DataFrame:
    """SRC6: characters (job, page, x, baseline, style, c) regrouped by baselines rounded to a tenth, a new span where the style changes."""
    from ..operators.ordered import islands

    rows = chars.withColumn("row", F.round("baseline", 1))
    per = [*PAGE, "row"]
    runs = islands(rows, per, ["x"], F.col("style") != F.lag("style").over(W.partitionBy(*per).orderBy("x")))
    g = runs.groupBy(*per, "island").agg(F.array_sort(F.collect_list(F.struct("x", "c"))).alias("t"), F.first("style").alias("style"))
    return g.select(*per, F.col("island").alias("span"), "style", F.array_join(F.transform("t", lambda v: v["c"]), "").alias("text"))


def usable_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC7: detected tables (job, page, rows, cols, cells, error) of two rows, two columns and four cells; a detector's error is an issue, not a failure."""
    errors = found.filter("error is not null").select(*PAGE, F.lit("TABLE_DETECT_ERROR").alias("code"), F.lit("P2").alias("severity"), F.col("error").alias("detail"))
    return found.filter("error is null and rows >= 2 and cols >= 2 and cells >= 4"), errors


def vertical_rules(drawings: DataFrame, tol: float = 0.8) -> DataFrame:
    """SRC8: drawn vertical rules (job, page, x, y0, y1): upright lines over 2 long, thin bars, and both sides of stroked frames over 2 high.

    ``drawings`` has job, page, stroked, op ('l' or 're') and box, whose corners are a line's ends.
    """
    b = F.col("box")
    top, bottom, middle = F.least(b["y0"], b["y1"]), F.greatest(b["y0"], b["y1"]), (b["x0"] + b["x1"]) / 2
    line = (F.col("op") == "l") & (F.abs(b["x0"] - b["x1"]) <= tol) & (bottom - top > 2)
    high = (F.col("op") == "re") & (bottom - top > 2)
    thin = high & (F.abs(b["x1"] - b["x0"]) <= 1.5)
    xs = F.when(line | thin, F.array(middle)).when(high & F.col("stroked"), F.array(b["x0"], b["x1"]))
    return drawings.select(*PAGE, F.explode(xs).alias("x"), top.alias("y0"), bottom.alias("y1"))


def horizontal_rules(drawings: DataFrame, high: float = 1.5, wide: float = 10.0) -> DataFrame:
    """SRC9: solid thin horizontal rules; dashed ones are leaders of a table of contents."""
    b = F.col("box")
    solid = F.coalesce("dashes", F.lit("")).isin("", "[] 0")
    return drawings.filter((b["y1"] - b["y0"] <= high) & (b["x1"] - b["x0"] >= wide) & solid).select(*PAGE, "box")


def page_inventory(pages: DataFrame, images: DataFrame, drawings: DataFrame, chars: DataFrame) -> DataFrame:
    """SRC10, FLT1, FLT2 and AG23: per page its counts, the share of its area under images, the share of glyph-sized paths, and its class.

    ``pages`` has job, page and box; the others job, page and box.
    """
    area = images.groupBy(*PAGE).agg(F.count("*").alias("images"), F.sum(rects.area(F.col("box"))).alias("image_area"))
    small = ((F.col("box.x1") - F.col("box.x0")) < 20) & ((F.col("box.y1") - F.col("box.y0")) < 20)
    paths = drawings.groupBy(*PAGE).agg(F.count("*").alias("drawings"), F.avg(small.cast("double")).alias("glyph_share"))
    text = chars.groupBy(*PAGE).agg(F.count("*").alias("chars"))
    j = pages.join(area, PAGE, "left").join(paths, PAGE, "left").join(text, PAGE, "left").na.fill(0, ["images", "drawings", "chars"]).na.fill(0.0, ["image_area", "glyph_share"])
    ratio = F.col("image_area") / rects.area(F.col("box"))
    scanned = (F.col("chars") < 5) & (ratio > 0.8)
    suspect = (F.col("chars") < 5) & ~scanned & (F.col("drawings") > 40)
    kind = F.when(scanned, "scanned").when(suspect & (F.col("glyph_share") >= 0.8), "outlined").when(suspect, "vector_suspect").when(F.col("chars") >= 5, "texty").otherwise("empty")
    return j.select(*PAGE, "images", "drawings", "chars", ratio.alias("image_area_ratio"), "glyph_share", kind.alias("kind"))


def readable_pages(regions: DataFrame, inventory: DataFrame) -> DataFrame:
    """FLT5: regions of pages that are neither scanned nor drawn."""
    return regions.join(inventory.filter(F.col("kind").isin("scanned", "vector_suspect", "outlined")), PAGE, "left_anti")


def document_class(inventory: DataFrame, issues: DataFrame) -> DataFrame:
    """FLT3, FLT4: REJECTED with a P0, MANUAL_DTP_REQUIRED without any text page, SUPPORTED_WITH_REVIEW with a P1, else SUPPORTED."""
    i = issues.groupBy("job").agg(F.count_if(F.col("severity") == "P0").alias("p0"), F.count_if(F.col("severity") == "P1").alias("p1"))
    t = inventory.groupBy("job").agg(F.count_if(F.col("kind") == "texty").alias("texty")).join(i, "job", "left").na.fill(0)
    kind = F.when(F.col("p0") > 0, "REJECTED").when(F.col("texty") == 0, "MANUAL_DTP_REQUIRED").when(F.col("p1") > 0, "SUPPORTED_WITH_REVIEW").otherwise("SUPPORTED")
    return t.select("job", kind.alias("class"))


def sibling_files(spark: SparkSession, folder: str, stem: str, pattern: str = "*", most: int = 12) -> DataFrame:
    """SRC11: files below a folder whose name key begins with that of ``stem``, the first ``most`` by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[.][^.]*$", "")
    return found.filter(source_key(name).startswith(source_key(F.lit(stem)))).orderBy("path").limit(most)
