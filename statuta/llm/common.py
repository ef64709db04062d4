"""Helpers shared by the corpus operators: shared scratch tables, id handling, shipping code."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in Python workers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Characters that separate words and are stripped from lines: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local folder in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or getattr(shared_dir, "local", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = shared_dir.local = tempfile.mkdtemp(prefix="statuta-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base if "://" in base else f"file://{base}"


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Paths of tables that results still read, to be deleted once those results are written.
SIDE_TABLES: list[str] = []


def drop_side_tables(spark: SparkSession) -> None:
    """Delete what ``Scratch.side`` wrote; only after the results that read it are written."""
    while SIDE_TABLES:
        delete_path(spark, SIDE_TABLES.pop())


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Fewer rows a batch between the JVM and Python: rows are whole documents, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Intermediate tables in the shared folder.

    ``put`` writes a table and reads it back, which cuts the lineage in a way that survives lost
    executors.  On leaving the ``with`` block all of them are deleted except those written by
    ``keep``, which back the returned result, and by ``side``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        delete_path(self.spark, f"{self.root}/tmp")

    def path(self, kind: str = "tmp") -> str:
        self.n += 1
        return f"{self.root}/{kind}/{self.n}"

    def put(self, df: DataFrame, kind: str = "tmp") -> DataFrame:
        path = self.path(kind)
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.put(df, "result")

    def side(self, df: DataFrame) -> DataFrame:
        """Like ``keep``, for a table that a returned result reads; ``drop_side_tables`` deletes it."""
        out = self.put(df, "side")
        SIDE_TABLES.append(f"{self.root}/side/{self.n}")
        return out

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of queries that have ended; it does so once their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``put`` returned as soon as nothing reads it."""
        for f in df.inputFiles()[:1]:
            delete_path(self.spark, f.rpartition("/")[0])


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of ``taken`` equals, whatever the case of letters."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def release_memory() -> None:
    """Gives memory that is no longer used back to the system: Python workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives its memory back when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return tidied


def parts_for(docs: DataFrame, mb: int = 16) -> int:
    """A number of shuffle partitions that grows with the input, also where the session's setting doesn't."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # of other sources than files Spark doesn't know the size
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (mb << 20), 1_000_000))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))
