"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from inspect import getfullargspec

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of every word contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  lower() does just that where all characters are ASCII, and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def values(column: pa.Array, step: int = 256) -> Iterator:
    """Python values of a column, of step rows at a time, so that the texts of a whole batch never stand beside their Arrow form."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def give_back() -> None:
    """Returns the process's free memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a partition's batches, after which the worker gives its memory back: it waits idle beside the workers of later stages."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def tidy_groups(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run, a function of a group's table (or of the tables of two), after which the worker gives its memory back, as in tidy."""

    def one(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    def two(t: pa.Table, other: pa.Table) -> pa.Table:
        out = run(t, other)
        give_back()
        return out

    return one if len(getfullargspec(run).args) == 1 else two


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most rows rows in the jobs run inside, as wide columns stand in them in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a unique long for every row; a column of that name is replaced.

    For tables read from Parquet it is the place of the row's file among all, and of the row in its file: the same in every scan, however
    files are split and whatever executors come or go.  Files are listed once (their names, which the driver knows anyway).
    Other inputs are numbered by partition.
    """
    file, place = f"_{name}_file", f"_{name}_place"
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    try:
        d = df.select(*keep, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    files = sorted(r[0] for r in d.select(file).distinct().collect())
    at = df.sparkSession.createDataFrame([(f, i << 36) for i, f in enumerate(files)], f"`{file}` string, `{place}` long")
    joined = d.join(F.broadcast(at) if len(files) <= 50_000 else at, file)
    return joined.withColumn(name, F.col(place) + F.col(name)).drop(file, place)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
