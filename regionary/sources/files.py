"""Readers and writers: JSON documents, JSON lines with line numbers, glossaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC1: whole-file JSON; a missing file is an empty frame."""
    return spark.read.schema(schema).json(path, multiLine=True) if _there(spark, path) else spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC2: JSON lines, blank ones skipped; a missing file is an empty frame. ``seq`` is a field of the
    log, as readers keep no order of lines."""
    return spark.read.schema(schema).json(path) if _there(spark, path) else spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    """SNK2."""
    df.write.mode("append").json(path)


def replace_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """SNK1 and SNK3: atomic by the commit protocol; with ``by`` only the partitions at hand are replaced."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else w).parquet(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: CSV with a header; rows without a term go, blanks are trimmed, the type is ``keep`` by default."""
    raw = spark.read.schema("term string, type string, target string, note string").csv(path, header=True)
    trimmed = raw.select(*[F.trim(c).alias(c) for c in raw.columns]).filter(F.length("term") > 0)
    return trimmed.withColumn("type", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("keep")))


def last_issues(issues: DataFrame, most: int = 30, detail: int = 90) -> DataFrame:
    """SNK4: the last issues of a report, their details cut."""
    return issues.orderBy(F.desc("ts"), "code").limit(most).withColumn("detail", F.substring("detail", 1, detail))
