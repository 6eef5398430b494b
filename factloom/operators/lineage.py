"""Cutting lineage in the folder that driver and executors share, and results that are built once a session."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which executors share too."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def _written(df: DataFrame, folder: str, *by: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: it outlives any executor.

    A checkpoint keeps the size that Spark had guessed for the plan before it. A join's guess is the product of its sides, so
    from round to round of a fixpoint the guesses' digits double until planning takes longer than the work. A written
    table has the size of its files: small frames are broadcast by their true size, and large ones never are.
    """
    return _written(df, f"{shared_dir(df.sparkSession).rstrip('/')}/cut")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``cut``, partitioned by columns if any are named, whose tables go when the block ends; what outlives it is cut outside."""
    folder = f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    try:
        yield lambda df, *by: _written(df, folder, *by)
    finally:
        _remove(spark, folder)


@contextmanager
def removed_after(spark: SparkSession, folder: str) -> Iterator[str]:
    """``folder``, which goes when the block ends."""
    try:
        yield folder
    finally:
        _remove(spark, folder)


class Growing:
    """A table that each round of a fixpoint adds to, partitioned by the round and by ``part``.

    What was found until now, and what was found last, are each one scan of it, whatever the number of rounds, so that plans
    stay of one size and their compiled code is found again.
    """

    def __init__(self, spark: SparkSession, part: str) -> None:
        self.spark, self.part, self.round, self.schema = spark, part, 0, None
        self.folder = f"{shared_dir(spark).rstrip('/')}/growing-{uuid.uuid4().hex}"

    def __enter__(self) -> "Growing":
        return self

    def __exit__(self, *_) -> None:
        _remove(self.spark, self.folder)

    def add(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as the next round; returns it as it was written."""
        self.round += 1
        self.schema = self.schema or df.withColumn("round", F.lit(0)).schema
        df.write.partitionBy(self.part).parquet(f"{self.folder}/round={self.round}")
        return self.all().where(F.col("round") == self.round)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)


_built: dict[tuple, tuple[DataFrame, str]] = {}


def stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what is in a folder, which change when an input is written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def build_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], inputs: str) -> DataFrame:
    """The frame of ``make``, written once for each application, key and state of the folder ``inputs``; ``forget`` drops it."""
    full = (spark.sparkContext.applicationId, *key, stamp(spark, inputs))
    if full not in _built:
        path = f"{shared_dir(spark).rstrip('/')}/built-{uuid.uuid4().hex}"
        df = make()
        df.write.parquet(path)
        _built[full] = spark.read.schema(df.schema).parquet(path), path
    return _built[full][0]


def forget(spark: SparkSession, *key) -> None:
    """Removes what was built under keys that begin so."""
    for full in [k for k in _built if k[1 : 1 + len(key)] == key]:
        _remove(spark, _built.pop(full)[1])
