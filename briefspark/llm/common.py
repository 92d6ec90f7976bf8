"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that reach a Python worker at once; texts may be long, so far fewer than Spark's default.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Keep the Arrow batches of the session small enough for rows of long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over small batches; ``run`` maps an iterator of batches."""
    small_batches(df)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary
    one in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="briefspark-"))
    return context.getCheckpointDir()


#: Folders of the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside go when the scope ends, but for those that stay.

    What leaves the scope must read none of them: save it with ``stays``.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def saved(df: DataFrame, stays: bool = False) -> DataFrame:
    """A Parquet table in the shared folder, read back: computed once, safe when an executor is lost.

    Unlike a checkpoint it does not keep the order of rows, and it has the size of its files.  A
    checkpoint keeps the size that Spark estimates, the product of both sides of each join: in a loop of
    joins the number of its digits doubles every round, until the driver's memory is full.
    """
    path = f"{shared_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not stays:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: computed once, safe when an executor is lost."""
    place, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return df.checkpoint(eager=True)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch as Python lists."""
    for batch in batches:
        yield [c.to_pylist() for c in batch.columns]


def partitions(spark: SparkSession) -> int:
    """The number of partitions that the session deals shuffles out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that hash partitioning by it deals there."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        numbers = spark.range(size).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
        found = {r["p"]: r["label"] for r in numbers.groupBy("p").agg(F.min("id").alias("label")).collect()}
        size *= 2
    return [int(found[p]) for p in range(n)]
