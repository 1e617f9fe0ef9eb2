"""Job control: status steps, stages, configuration and release (FLT15, CT1-CT3, SRC4, SNK5, SNK7)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RERUNNABLE = ("PREFLIGHTED", "NEEDS_REVIEW", "REVOKED")
RELEASED = "RELEASED"


class Blocked(RuntimeError):
    """A stage may not run."""

    exit_code = 2


def guard(status: str, allowed: tuple[str, ...] = RERUNNABLE) -> None:
    """FLT15: raises unless a stage may run in this status; never on a released job."""
    if status == RELEASED or status not in allowed:
        raise Blocked(f"not in status {status}")


def runnable(jobs: DataFrame, allowed: tuple[str, ...] = RERUNNABLE) -> DataFrame:
    """FLT15 over a table of jobs."""
    return jobs.filter(F.col("status").isin(*[s for s in allowed if s != RELEASED]))


def stamped(jobs: DataFrame, stage: str, state: str, engine: str, at: Column) -> DataFrame:
    """CT1: the stage's state, time and engine written to the map ``stages``; other stages stay."""
    entry = F.create_map(F.lit(stage), F.struct(F.lit(state).alias("state"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit(engine).alias("engine")))
    return jobs.withColumn("stages", F.map_concat(F.map_filter("stages", lambda k, v: k != stage), entry))


def layout_model(merge: bool) -> str:
    """CT2: the model's version tells whether paragraphs were merged."""
    return "lg-basic-4" if merge else "lg-basic-3"


def with_defaults(jobs: DataFrame, config: str, defaults: dict[str, str]) -> DataFrame:
    """CT3: keys that an old job's configuration lacks take their default."""
    base = F.create_map(*[F.lit(x) for kv in sorted(defaults.items()) for x in kv])
    own = F.coalesce(F.col(config), F.create_map().cast("map<string,string>"))
    return jobs.withColumn(config, F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own))


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """SRC4: a configuration of ``key: value`` lines and one level of sections, as flat dotted keys; comments and blanks are skipped.

    A configuration is one small file of a job; lines come in order of their offset.
    """
    text = spark.read.text(path, wholetext=True).first()["value"]
    out, section = {}, ""
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or ":" not in body:
            continue
        key, _, value = body.strip().partition(":")
        if not line[0].isspace():
            section = "" if value.strip() else key
        out[f"{section}.{key}" if line[0].isspace() and section else key] = value.strip().strip("'\"")
    return {k: v for k, v in out.items() if v}


def fingerprints(files: DataFrame) -> DataFrame:
    """SNK7: path, size and SHA-256 of file contents (as the ``binaryFile`` source gives them)."""
    return files.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def promote(df: DataFrame, folder: str) -> str:
    """SNK5: a release is written beside its place and renamed into it, so it is there whole or not; an existing one is refused."""
    spark = df.sparkSession
    part = f"{folder}.part-{uuid.uuid4().hex[:8]}"
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(folder)
    fs = b.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):
        raise Blocked(f"{folder} is released")
    df.write.parquet(part)
    if not fs.rename(a, b):
        raise Blocked(f"{folder} could not be put in place")
    return folder


def transition(jobs: DataFrame, to: str, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The jobs that may step to a status, stepped, and those that may not; the status a job has already is no step."""
    can = allowed.filter(F.col("to_status") == to).select(F.col("from_status").alias("status"), F.lit(True).alias("_ok"))
    j = jobs.join(F.broadcast(can), "status", "left")
    ok = F.coalesce("_ok", F.lit(False)) | (F.col("status") == to)
    return j.filter(ok).drop("_ok").withColumn("status", F.lit(to)), j.filter(~ok).drop("_ok")
