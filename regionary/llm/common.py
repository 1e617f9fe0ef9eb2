"""Shared parts of the corpus operators: scratch tables in the shared folder, and reading."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: list[tuple[SparkSession, str]] = []
_MEMO: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local master (driver and executors are one process) gets a folder under its
    warehouse; any other master is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive lost executors.

    ``save`` writes a frame as Parquet and reads it back. On leaving the ``with`` block every
    table but those saved with ``keep=True`` is deleted; kept ones go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.mine: set[str] = set()
        self.kept = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.mine:
            delete_path(self.spark, path)
        self.mine = set()

    def save(self, df: DataFrame, keep: bool = False) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.mine.add(path)
            out._scratch_path = path  # type: ignore[attr-defined]
        elif not self.kept:
            self.kept = True
            _KEPT.append((self.spark, self.root))
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path in self.mine:
            self.mine.remove(path)
            delete_path(self.spark, path)


def _sweep() -> None:
    for spark, root in _KEPT:
        with contextlib.suppress(Exception):
            delete_path(spark, root)


atexit.register(_sweep)


def memo(name: str, make: Callable[[], object]) -> object:
    """The one memo of a Python worker, kept from task to task; workers outlive an operator, so another name's is dropped."""
    if name not in _MEMO:
        _MEMO.clear()
        _MEMO[name] = make()
    return _MEMO[name]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable:
    """``run`` so that an idle worker holds little: freed memory goes back after each task, and memos, unless ``keep``, before it."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            _MEMO.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
