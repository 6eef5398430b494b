"""A shared table of notes, in which a commit replaces what its paths hold and leaves all others alone.

Rows (path, heading, ord, text) are dealt to a fixed number of partitions by a hash of their path. A commit reads the partitions of its paths,
puts the new rows in the place of the old ones and overwrites just these partitions (dynamic partition overwrite), so its work goes with
the partitions touched and not with the table. A path that has been committed keeps a row without heading, as a file of notes keeps its
first line, so that a partition whose last note goes is overwritten too.

Defined cases: rows of paths that a commit doesn't name are ignored; rows without a path or heading aren't notes and are left out; a path named
without rows loses its notes; repeated paths count once; a table that isn't there has no notes; an empty commit changes nothing. Commits to one table
follow each other: two at a time on one partition are not kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import lineage

SCHEMA = "path string, heading string, ord int, text string, bucket int"
BUCKETS = 64


def _exists(spark: SparkSession, store: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _rows(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(store) if _exists(spark, store) else spark.createDataFrame([], SCHEMA)


def read(spark: SparkSession, store: str) -> DataFrame:
    """path, heading, ord, text of all notes, as of the last commit."""
    return _rows(spark, store).where("heading is not null").select("path", "heading", "ord", "text")


def commit(store: str, paths: DataFrame, notes: DataFrame, buckets: int = BUCKETS) -> None:
    """Replaces all notes of ``paths`` (path) by those of them in ``notes`` (path, heading, ord, text). ``buckets`` is a table's for good."""
    spark = paths.sparkSession
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    with lineage.rounds(spark) as cut:
        named = cut(paths.where("path is not null").select("path").distinct())
        touched = [r["bucket"] for r in named.select(bucket).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        kept = _rows(spark, store).where(F.col("bucket").isin(touched)).join(named, "path", "left_anti").select("path", "heading", "ord", "text")
        new = notes.where("heading is not null").join(named, "path", "left_semi").select("path", "heading", F.col("ord").cast("int").alias("ord"), "text")
        head = named.select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("heading", "string"), ("ord", "int"), ("text", "string"))])
        # written apart first, as what is overwritten can't be read meanwhile
        rows = cut(kept.unionByName(new).unionByName(head).select("path", "heading", "ord", "text", bucket))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)
    spark.catalog.refreshByPath(store)
