"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns name candidates in every text. Marks are set around each match and the text is split at
them, which gives offsets without any user code. Candidate values are hashed and counted over the
whole corpus: distinct documents (as repositories) and distinct sources (as owners). A value that
several owners hold is a widely copied example; a value of one owner that looks random is live.
Live values of the wider pattern ``token`` (20 and more characters with letters of both cases and digits, none
of them found by the base kinds) are added to the spans.

The counts are pre-aggregated, so a value that a third of all documents hold costs one row a task.
Defined results: null texts are empty; a null source is an owner of its own; repeated rows are
scanned each for itself and are one repository if they share an id; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

KINDS = ("assign", "access", "hex")
WIDER = "token"
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"()(AKIA[A-Z0-9]+)",
    "hex": r"()([0-9a-f]{24,})",
    "token": r"()([A-Za-z0-9+/_-]{20,})",
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "token": 20}
OWNERS_OF_EXAMPLE = 3
#: A value in as many documents (repositories) is a copied example too, whoever owns them.
REPOSITORIES_OF_EXAMPLE = 25
LEAST_BITS = 2.5

MARK, INNER = "\x01", "\x02"


def found(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) for the leftmost matches, in code points; short ones are dropped.

    ``text`` must hold neither mark. Every second part of the split is a match: its lead and its value.
    """
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$1{INNER}$2{MARK}"), MARK, -1)
    size = lambda p: F.length(p) - F.when(F.instr(p, INNER) > 0, 1).otherwise(0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + size(p)
        value = F.substring_index(p, INNER, -1)
        hit = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), value.alias("value"))
        good = (F.instr(p, INNER) > 0) & (F.length(value) >= LEAST[kind])
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(start["out"])


def entropy_bits(value: Column) -> Column:
    """Bits per character of a value's own character frequencies."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))


def scan(docs: DataFrame, owners_of_example: int = OWNERS_OF_EXAMPLE, repositories_of_example: int = REPOSITORIES_OF_EXAMPLE) -> DataFrame:
    """One row per document row: doc_id and ``spans``, an array by (start, kind) of
    (start, kind number, end, kind, owners, repositories, live); base kinds first among equals."""
    spark = docs.sparkSession
    clean = F.translate(text_or_empty(), MARK + INNER, "\x03\x03")
    kinds = [*KINDS, WIDER]
    scratch = Scratch(spark, "secrets")
    with scratch:
        rows = docs.select("doc_id", F.col("source").cast("string").alias("owner"), clean.alias("clean"))
        each = [found(F.col("clean"), k) for k in kinds]
        rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", F.concat(*each[:3]).alias("base"), each[3].alias("wide"))
        inside = lambda w: F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
        mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
        rows = rows.withColumn("wide", F.when(F.size("wide") > 0, F.filter("wide", lambda w: mixed(w["value"]) & ~inside(w))).otherwise(F.col("wide")))
        rows = scratch.save(rows.select("row", "doc_id", "owner", F.concat("base", "wide").alias("hits")), keep=True)

        hits = rows.filter(F.size("hits") > 0).select("row", "doc_id", "owner", F.explode("hits").alias("hit"))
        hits = hits.select("row", "doc_id", "owner", "hit.kind", "hit.start", "hit.end", F.xxhash64("hit.value").alias("hash"), (entropy_bits(F.col("hit.value")) >= LEAST_BITS).alias("random"))
        hits = scratch.save(hits)
        owner = F.coalesce(F.concat(F.lit("a"), F.col("owner")), F.lit("b"))
        once = hits.select("hash", owner.alias("owner"), "doc_id").groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
        counts = once.groupBy("hash", "owner").agg(F.count("*").alias("repositories")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
        order = F.element_at(F.create_map(*[x for k, kind in enumerate(kinds) for x in (F.lit(kind), F.lit(k))]), F.col("kind"))
        told = hits.join(scratch.save(counts), "hash").withColumn("live", (F.col("owners") < owners_of_example) & (F.col("repositories") < repositories_of_example) & F.col("random"))
        told = told.filter(F.col("kind").isin(*KINDS) | (F.col("live") & (F.col("owners") == 1)))
        span = F.struct("start", order.alias("order"), "end", "kind", "owners", "repositories", "live")
        spans = scratch.save(told.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans")), keep=True)
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
