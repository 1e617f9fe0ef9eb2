"""Layout fitting over words with a width model: greedy wrap, size search and baselines, per row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 0.1


def wrapped_lines(words: Column, width: float) -> Column:
    """FT1: lines that greedy wrapping takes, a character being one wide; null if a word is wider than the line."""
    start = F.struct(F.lit(0).alias("lines"), F.lit(0.0).alias("used"))

    def step(acc: Column, w: Column) -> Column:
        n = F.length(w).cast("double")
        fits = (acc["lines"] > 0) & (acc["used"] + 1 + n <= width + TOLERANCE)
        return F.struct(F.when(fits, acc["lines"]).otherwise(acc["lines"] + 1).alias("lines"), F.when(fits, acc["used"] + 1 + n).otherwise(n).alias("used"))

    fold = F.aggregate(words, start, step, lambda acc: acc["lines"])
    return F.when(~F.exists(words, lambda w: F.length(w) > width + TOLERANCE), fold)


def count_lines(words: list[str], per_line: float) -> int | None:
    lines, used = 0, 0.0
    for w in words:
        if len(w) > per_line + TOLERANCE:
            return None
        if lines and used + 1 + len(w) <= per_line + TOLERANCE:
            used += 1 + len(w)
        else:
            lines, used = lines + 1, float(len(w))
    return lines


def largest_size(floor: float = 4.0, cap: float = 14.0, em: float = 0.5, leading: float = 1.15, steps: int = 24, near: float = 0.05):
    """FT2: a pandas UDF (text, width, height) -> the largest size between floor and cap that fits, or null."""

    def fits(words: list[str], size: float, width: float, height: float) -> bool:
        n = count_lines(words, width / (em * size))
        return n is not None and n * size * leading <= height

    @F.pandas_udf("double")
    def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, widths, heights in batches:
            out = []
            for t, w, h in zip(texts, widths, heights, strict=True):
                words = (t or "").split()
                if fits(words, cap, w, h):
                    out.append(cap)
                    continue
                if not fits(words, floor, w, h):
                    out.append(None)
                    continue
                lo, hi = floor, cap
                for _ in range(steps):
                    if hi - lo < near:
                        break
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if fits(words, mid, w, h) else (lo, mid)
                out.append(lo)
            yield pd.Series(out, dtype="float64")

    return search


def baselines(anchors: Column, leading: Column) -> Column:
    """WN11: y_i = max(anchor_i, y_(i-1) + leading), as a fold over an array."""
    empty = F.array().cast("array<double>")
    return F.aggregate(anchors, empty, lambda ys, a: F.concat(ys, F.array(F.when(F.size(ys) == 0, a).otherwise(F.greatest(a, F.element_at(ys, -1) + leading)))))


def last_baselines(rows: DataFrame, key: str, order: str, anchor: str, leading: float, block: int = 4096) -> DataFrame:
    """WN11 over all rows of a key: (key, last), the last of y_i = max(anchor_i, y_(i-1) + leading).

    That is the maximum of anchor_i + leading * (rows after i). Rows are counted within blocks of the whole numbers ``order`` and then over
    the blocks, so no task holds a key with many rows.
    """
    cut = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(anchor).alias("a"), F.floor(F.col(order) / block).alias("b"))
    after = F.row_number().over(W.partitionBy("k", "b").orderBy(F.desc_nulls_last("o"), F.desc_nulls_last("a"))) - 1
    blocks = cut.withColumn("y", F.col("a") + after * leading).groupBy("k", "b").agg(F.count("*").alias("n"), F.max("y").alias("y"))
    later = W.partitionBy("k").orderBy(F.desc_nulls_last("b")).rowsBetween(W.unboundedPreceding, -1)
    last = blocks.withColumn("y", F.col("y") + F.coalesce(F.sum("n").over(later), F.lit(0)) * leading)
    return last.groupBy(F.col("k").alias(key)).agg(F.max("y").alias("last"))


def advances(words: DataFrame, metrics: DataFrame, default: float = 0.5) -> DataFrame:
    """FT1's widths: (id, n, word, em) of words (id, n, font, word) from a supplied table of advances (font, codepoint, advance_em).

    Characters meet the metrics by equality on font and code point; one that the font lacks counts ``default``.
    """
    chars = words.select("id", "n", "font", "word", F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("c"))
    chars = chars.withColumn("codepoint", F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("int"))
    return chars.join(metrics, ["font", "codepoint"], "left").groupBy("id", "n", "word").agg(F.sum(F.coalesce("advance_em", F.lit(default))).alias("em"))


def wrapped_by_width(words: Column, width: Column, size: Column, gap: float = 0.25) -> Column:
    """FT1 over measured words (array of struct em): lines at a size, with a gap after each word; null if a word is too wide."""
    start = F.struct(F.lit(0).alias("lines"), F.lit(0.0).cast("double").alias("used"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["lines"] > 0) & (acc["used"] + (gap + w["em"]) * size <= width + TOLERANCE)
        return F.struct(F.when(fits, acc["lines"]).otherwise(acc["lines"] + 1).alias("lines"), F.when(fits, acc["used"] + (gap + w["em"]) * size).otherwise(w["em"] * size).alias("used"))

    return F.when(~F.exists(words, lambda w: w["em"] * size > width + TOLERANCE), F.aggregate(words, start, step, lambda acc: acc["lines"]))


def fitted_size(words: Column, width: Column, height: Column, floor: float, cap: Column, leading: float = 1.15, steps: int = 24, near: float = 0.05) -> Column:
    """FT2 as a fold, without Python: the cap if it fits, null if the floor doesn't, else the lower end of a bisection of at most ``steps`` steps."""
    fits = lambda s: F.coalesce(wrapped_by_width(words, width, s) * s * leading <= height, F.lit(False))
    low = F.lit(float(floor))
    start = F.struct(low.alias("lo"), cap.cast("double").alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        ok, done = fits(mid), acc["hi"] - acc["lo"] < near
        return F.struct(F.when(~done & ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(~done & ~ok, mid).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["lo"])
    return F.when(fits(cap), cap).when(fits(low), found)


def fit_issue(size: Column, source_size: Column, hard: float = 0.90, review: float = 0.95) -> Column:
    """FT11: the code of a fit: impossible, hard, to review or none."""
    ratio = size / source_size
    return F.when(size.isNull(), "FIT_IMPOSSIBLE").when(ratio < hard, "FONT_RATIO_HARD").when(ratio < review, "FONT_RATIO_REVIEW")


def better_fit(size: Column, lines: Column, new_size: Column, new_lines: Column, near: float = 0.05) -> Column:
    """FT11: whether a candidate layout is taken: a larger size, or as large with fewer lines."""
    return F.coalesce((new_size > size + near) | ((F.abs(new_size - size) <= near) & (new_lines < lines)), size.isNull() & new_size.isNotNull())


def resolved_fonts(spans: DataFrame, fonts: DataFrame, coverage: DataFrame, fallback: str) -> DataFrame:
    """FT3: the face of each span (id, name, style, text): its own if known, else the style's, else the fallback; a character that the face lacks
    sends the span to the fallback, and one that the fallback lacks too is counted as ``missing``.

    ``fonts`` maps (name, style) to face, ``coverage`` holds (face, codepoint).
    """
    by_style = fonts.groupBy("style").agg(F.min("face").alias("style_face"))
    face = F.coalesce("face", "style_face", F.lit(fallback))
    s = spans.join(fonts, ["name", "style"], "left").join(by_style, "style", "left").select("id", "text", face.alias("face"))
    chars = s.select("id", "face", F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda c: F.trim(c) != ""))).alias("c"))
    chars = chars.withColumn("codepoint", F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("int"))
    own = coverage.withColumn("own", F.lit(True))
    back = coverage.filter(F.col("face") == fallback).select("codepoint", F.lit(True).alias("back"))
    seen = chars.join(own, ["face", "codepoint"], "left").join(back, "codepoint", "left").na.fill(False, ["own", "back"])
    lacks = seen.groupBy("id").agg(F.count_if(~F.col("own")).alias("lacking"), F.count_if(~F.col("own") & ~F.col("back")).alias("missing"))
    out = s.join(lacks, "id", "left").na.fill(0, ["lacking", "missing"])
    return out.select("id", F.when(F.col("lacking") > 0, fallback).otherwise(F.col("face")).alias("face"), (F.col("lacking") > 0).alias("degraded"), "missing")


def role_faces(runs: DataFrame, group: list[str]) -> DataFrame:
    """FT4: per role of a group the style of its run with the most ink, the first of equals; a role without ink borrows the group's.

    ``runs`` has the group, run, role, text and style.
    """
    ink = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    most = F.struct(ink.alias("ink"), (-F.col("run")).alias("first"))
    role = runs.groupBy(*group, "role").agg(F.max_by("style", most).alias("own"), F.sum(ink).alias("ink"))
    every = runs.groupBy(*group).agg(F.max_by("style", most).alias("any"))
    return role.join(every, group).select(*group, "role", F.when(F.col("ink") > 0, F.col("own")).otherwise(F.col("any")).alias("style"))


def draw_origin(lines: DataFrame, group: list[str]) -> DataFrame:
    """FT5: where drawing begins: the least over lines of the greater of origin and ink's left; and the other formula, the greater of
    the first line's origin and the least ink, which grouping uses. ``lines`` has the group, n, origin and ink."""
    return lines.groupBy(*group).agg(F.min(F.greatest("origin", "ink")).alias("base_x"), F.greatest(F.min_by("origin", "n"), F.min("ink")).alias("paint_x"))


def segment_lines(n_lines: Column, n_segments: Column, starts: Column) -> Column:
    """FT6: the source line of each segment: line for line, or one paragraph start for each, or all on the first line; null if none fits.

    ``starts`` is the array of the lines that open a paragraph.
    """
    each = F.sequence(F.lit(0), F.greatest(n_segments - 1, F.lit(0)))
    return F.when(n_segments == n_lines, each).when(n_segments == F.size(starts), starts).when(n_segments == 1, F.array(F.lit(0)))


def indents(lines: DataFrame, group: list[str], near: float = 1.0) -> DataFrame:
    """FT6: how far each line begins right of its group's left edge; under ``near`` it is none."""
    d = F.col("box.x0") - F.min("box.x0").over(W.partitionBy(*group))
    return lines.withColumn("indent", F.when(d > near, F.round(d, 2)).otherwise(0.0))


def expanded(boxes: DataFrame, neighbours: DataFrame, page_right: float, gap: float = 2.0) -> DataFrame:
    """FT7: boxes grown to the right to the nearest neighbour in their band: half the gap is shared with one that moves too, all but ``gap`` is
    taken from one that does not; a centred box grows by the same on the left. Boxes and neighbours have job, page, id, movable, box; boxes also centred."""
    page = ["job", "page"]
    b = F.col("box")
    o = neighbours.select(*page, F.col("id").alias("oid"), F.col("movable").alias("moves"), F.col("box").alias("o"))
    j = boxes.join(o, page, "left")
    band = (F.col("oid") != F.col("id")) & (F.col("o.y0") < b["y1"]) & (F.col("o.y1") > b["y0"])
    room = F.when(F.col("moves"), (F.col("o.x0") - b["x1"]) / 2).otherwise(F.col("o.x0") - b["x1"] - gap)
    left = F.when(F.col("moves"), (b["x0"] - F.col("o.x1")) / 2).otherwise(b["x0"] - F.col("o.x1") - gap)
    g = j.groupBy(*page, "id", "centred", "box").agg(F.min(F.when(band & (F.col("o.x0") >= b["x1"]), room)).alias("r"), F.min(F.when(band & (F.col("o.x1") <= b["x0"]), left)).alias("l"))
    grow = F.greatest(F.coalesce("r", F.lit(page_right) - b["x1"]), F.lit(0.0))
    both = F.greatest(F.least(grow, F.coalesce("l", b["x0"])), F.lit(0.0))
    return g.select(*page, "id", F.when(F.col("centred"), b["x0"] - both).otherwise(b["x0"]).alias("x0"), F.when(F.col("centred"), b["x1"] + both).otherwise(b["x1"] + grow).alias("x1"))


def split_columns(text: Column, least: int = 4) -> Column:
    """FT8: the parts of a table or contents line between runs of ``least`` blanks or dots, with their offsets; one part if there is no such run."""
    parts = F.filter(F.split(text, rf"[ .]{{{least},}}"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct((F.instr(text, p) - 1).alias("at"), F.trim(p).alias("text")))


def dot_leaders(head_em: Column, tail_em: Column, size: Column, width: Column, dot_em: float = 0.25) -> Column:
    """FT9: how many dots fill a contents line between its title and its page number; at least three."""
    return F.greatest(F.lit(3), F.floor((width / size - head_em - tail_em) / dot_em)).cast("int")


def painted_right(segments: Column) -> Column:
    """RG11: the right edge of painted segments (array of struct x, width)."""
    return F.array_max(F.transform(segments, lambda s: s["x"] + s["width"]))
