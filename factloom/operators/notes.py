"""Notes on symbols (path, heading, ord, text): a table whose rows of one path and heading are one note's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def view(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, heading, body for each wanted (path, heading); ``(empty)`` for a note without text, null for none."""
    own = notes.groupBy("path", "heading").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("b"))
    return wanted.join(own, ["path", "heading"], "left").select("path", "heading", F.when(F.col("b") == "", "(empty)").otherwise(F.col("b")).alias("body"))


def append(notes: DataFrame, more: DataFrame) -> DataFrame:
    """``notes`` with ``more`` (path, heading, text) behind the lines that a heading has, in order of the text."""
    last = notes.groupBy("path", "heading").agg((F.max("ord") + 1).alias("next"))
    place = F.row_number().over(Window.partitionBy("path", "heading").orderBy("text")) - 1
    new = more.withColumn("k", place).join(last, ["path", "heading"], "left").select("path", "heading", (F.coalesce("next", F.lit(0)) + F.col("k")).cast("int").alias("ord"), "text")
    return notes.select("path", "heading", "ord", "text").unionByName(new)


def delete(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return notes.join(gone, ["path", "heading"], "left_anti").select("path", "heading", "ord", "text")


def lines_of_headings(notes: DataFrame) -> DataFrame:
    """path, heading, line: where a heading stands in the exported text, whose first line is the path."""
    sizes = notes.groupBy("path", "heading").agg((F.count(F.lit(1)) + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("heading").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("path", "heading", (F.coalesce(before, F.lit(0)) + 2).alias("line"))
