"""Helpers that the corpus operators share: table access, the shared folder, joins that stand hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot if it holds over one HOT_KEYS-th of all rows, so there are fewer than HOT_KEYS hot keys.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that ``spark.checkpoint.dir`` names.

    A folder of this machine is made only where the setting is missing, as in tests in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="namtok-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` gave and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that Python holds few texts as objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of values that begin at these places and have these lengths, one after the other."""
    return values[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Jobs that run inside have this session setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def rows_per_batch(spark: SparkSession, n: int):
    """Jobs that run inside send at most ``n`` rows at once to Python, for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return setting(spark, name, str(min(n, before) if before > 0 else n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of many rows of ``left`` to the one row of ``right`` with their key, safe for hot keys.

    ``weight`` (dropped) is the count of left rows of a key and ``total`` their sum. Rows of keys
    with over 1/HOT_KEYS of the total meet a broadcast of fewer than HOT_KEYS rows and aren't
    shuffled; the other rows are joined by a shuffle. Both inputs are read twice.
    """
    hot = right.filter(F.col(weight) * HOT_KEYS > total).drop(weight)
    cold = right.filter(F.col(weight) * HOT_KEYS <= total).drop(weight)
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(hot_keys, key, "left_anti").join(cold, key))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
