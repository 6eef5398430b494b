"""Exact dedup by content sort, in DataFrame operations only.

Texts are equal when identical after replacing each run of white space by one space. Sampled splitters range-partition
the rows by content, each partition is sorted (Spark's external sort, which spills), and the window that follows
compares whole normalised texts of neighbours; of each run of equals the row with the smallest identifier stays.

Rows are dealt to ranges by their first 32 characters, and by the digest where these tie: the splitters that Spark samples
and keeps on the driver are then of bounded size, and rows that share a beginning still spread over partitions. Inside a
partition the order is that of the whole normalised text. A text with more than ``hot_share`` of all rows (fewer than
1 / hot_share such texts exist, so their list may be broadcast) is dealt into runs by a salt; each run is sorted like any
other and the runs' keepers, a few rows a text, are merged.

Defined cases: a null text counts as empty, and empty texts form a group like any other; of repeated identifiers in a
group one row stays; a null identifier stays only where the group has no other, and its keep_id is null; an empty table
gives an empty result; columns besides doc_id and text are carried along, whatever their names, unless named like a result
column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, named, packed_others, settle, unpacked

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _runs(rows: DataFrame) -> DataFrame:
    """Sorted runs of equal texts: each row with its run's smallest identifier and size, and whether it is the first."""
    ranged = rows.repartitionByRange("_head", "text_sha256", "_salt")
    # sorted by the text itself first; the others are the same for equal texts and say that ranges hold runs whole
    run = Window.partitionBy("_norm", "_head", "text_sha256", "_salt")
    return (
        ranged.withColumn("_norm", normal(F.col("text")))
        .withColumn("keep_id", F.min("doc_id").over(run))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
        .withColumn("kept", F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last())) == 1)
        .drop("_head", "_norm")
    )


def content_sort(docs: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 (of the normalised text)."""
    columns = [c for c in docs.columns if c not in ADDED]
    # written once: sampling splitters, counting and sorting then read digests and beginnings instead of making them again
    norm = packed_others(docs.select(*[named(c) for c in columns]), "doc_id", "text").withColumn("_norm", normal(F.col("text")))
    rows = settle(norm.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_head", F.substring("_norm", 1, 32)).drop("_norm"))
    least = max(2.0, hot_share * rows.count())
    hot = rows.groupBy("text_sha256").count().where(F.col("count") > F.lit(least)).select("text_sha256", F.ceil(F.col("count") / F.lit(least)).alias("_parts"))
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("long")
    salted = rows.join(hot, "text_sha256", "left").withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(-1)).otherwise(salt).cast("long")).drop("_parts")
    # the hot texts' runs alone, one row a run; of runs that tie on the identifier the smallest salt wins
    heads = _runs(rows.select("doc_id", "text", "text_sha256", "_head").join(hot, "text_sha256").withColumn("_salt", salt).drop("_parts")).where("kept")
    merged = heads.groupBy("text_sha256").agg(
        F.min("keep_id").alias("_keep"), F.sum("group_size").alias("_size"), F.min(F.struct(F.col("keep_id").isNull(), "keep_id", "_salt"))["_salt"].alias("_first")
    )
    joined = _runs(salted).join(F.broadcast(merged), "text_sha256", "left")
    whole = F.col("_size").isNull()
    return joined.select(
        *[F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in columns],
        F.when(whole, F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(whole, F.col("group_size")).otherwise(F.col("_size")).cast("long").alias("group_size"),
        (F.col("kept") & (whole | (F.col("_salt") == F.col("_first")))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, with all columns of ``docs``, whatever their names."""
    return unpacked(content_sort(packed_others(docs, "doc_id", "text")).where("kept"), docs.columns)


def op9_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return content_sort(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over (partition by norm order by doc_id nulls last) = 1 as kept, sha256(norm) as text_sha256
from n
"""
