"""Calls through fields of fields: targets by signature and by the path of (type, field) that a function pointer is loaded from.

A function's address is stored at a path, innermost field first, and a call loads its pointer from one. Of a call's path the longest part
that some function of its signature is stored at decides. A type that escapes (it is converted to one that isn't followed, or to one that
escapes) ends a path: what lies in it may have been put there, or be read, as something else. A function whose path ends so stays a
target of every call that agrees with it up to there, however long the call's own match is.

Calls are given classes, and classes their members, so that a thousand calls through one field share one set of targets. Paths are
looked up by all their prefixes (at most ``layers`` and one, a bounded factor), so work is an equi-join on (signature, prefix).

Defined cases: a null path is an empty one; a null signature agrees with none; a null type or field ends a path; a function may be stored at several
paths; repeated rows count once; a call that no function fits has a class without members, at depth 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import lineage

LAYERS = 10


def escaping(types: DataFrame, conversions: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """type: ``types`` (type) that escape by themselves, and all that are converted (type, to) to one that does, by any number of steps."""
    spark = types.sparkSession
    with lineage.rounds(spark) as cut, lineage.Growing(spark, "part") as table:
        step = cut(conversions.where("type is not null").select(F.col("type").cast("long").alias("source"), F.col("to").cast("long").alias("type")).distinct())
        last = table.add(types.where("type is not null").select(F.col("type").cast("long").alias("type"), F.lit(0).alias("part")).distinct())
        for _ in range(most_rounds):
            back = last.join(step, "type").select(F.col("source").alias("type")).distinct()
            last = table.add(back.join(table.all(), "type", "left_anti").select("type", F.lit(0).alias("part")))
            if last.isEmpty():
                return lineage.cut(table.all().select("type"))
    raise RuntimeError("escaping types have not converged")


def _confined(rows: DataFrame, lost: DataFrame, layers: int) -> DataFrame:
    """``rows`` with distinct (id, signature, path), paths ended before the first type that escapes; ``ended`` tells which."""
    named = rows.where("id is not null").select("id", "signature", F.slice(F.coalesce("path", F.array().cast(rows.schema["path"].dataType)), 1, layers).alias("path")).distinct()
    steps = named.select("id", "signature", "path", F.posexplode("path").alias("pos", "step")).select("id", "signature", "path", "pos", F.col("step.type").alias("type"), F.col("step.field").alias("field"))
    bad = steps.join(lost.withColumn("lost", F.lit(True)), "type", "left").where("lost or type is null or field is null")
    first = bad.groupBy("id", "signature", "path").agg(F.min("pos").alias("end")).select(F.col("id").alias("i"), F.col("signature").alias("s"), F.col("path").alias("p"), "end")
    same = (F.col("id") == F.col("i")) & F.col("signature").eqNullSafe(F.col("s")) & (F.col("path") == F.col("p"))
    out = named.join(first, same, "left")
    return out.select("id", "signature", F.when(F.col("end").isNull(), F.col("path")).otherwise(F.slice("path", 1, F.coalesce("end", F.lit(0)))).alias("path"), F.col("end").isNotNull().alias("ended")).distinct()


def _prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.slice(path, 1, n))


def classes(calls: DataFrame, stores: DataFrame, lost: DataFrame, layers: int = LAYERS) -> tuple[DataFrame, DataFrame]:
    """(callsite, class, depth) of calls (callsite, signature, path), and (class, callee) from stores (callee, signature, path).

    Paths are arrays of (type, field); ``lost`` (type) escape. A class is named by its smallest call. ``layers`` = 0 asks signatures alone.
    """
    with lineage.rounds(calls.sparkSession) as cut:
        asks = cut(_confined(calls.withColumnRenamed("callsite", "id"), lost, layers))
        kept = cut(_confined(stores.withColumnRenamed("callee", "id"), lost, layers).where("signature is not null"))
        at = cut(kept.select("signature", F.explode(_prefixes(F.col("path"))).alias("prefix"), F.col("id").alias("callee")).distinct())
        found = asks.select("id", "signature", F.explode(_prefixes(F.col("path"))).alias("prefix")).join(at.select("signature", "prefix").distinct(), ["signature", "prefix"], "left_semi")
        deepest = found.groupBy("id").agg(F.max_by("prefix", F.size("prefix")).alias("prefix"))
        decided = asks.groupBy("id").agg(F.min("signature").alias("signature")).join(deepest, "id", "left")
        decided = cut(decided.select("id", "signature", F.coalesce("prefix", F.array().cast(asks.schema["path"].dataType)).alias("prefix")))
        named = cut(decided.groupBy("signature", "prefix").agg(F.min("id").alias("class")))
        same = decided["signature"].eqNullSafe(named["signature"]) & (decided["prefix"] == named["prefix"])
        of_calls = decided.join(named, same).select(F.col("id").alias("callsite"), "class", F.size(decided["prefix"]).alias("depth"))
        own = named.join(at, ["signature", "prefix"]).select("class", "callee")
        # functions whose path ended before: they may be anywhere beyond
        open_ = kept.where("ended").select("signature", F.col("path").alias("prefix"), F.col("id").alias("callee")).distinct()
        beyond = named.select("class", "signature", F.explode(_prefixes(F.col("prefix"))).alias("prefix")).join(open_, ["signature", "prefix"]).select("class", "callee")
        return lineage.cut(of_calls), lineage.cut(own.unionByName(beyond).distinct())


def figures(of_calls: DataFrame, members: DataFrame) -> DataFrame:
    """depth, n_calls, n_without (calls that nothing fits), n_targets, largest: what each depth decides."""
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    calls = of_calls.join(size, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return calls.groupBy("depth").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("n") == 0).alias("n_without"), F.sum("n").alias("n_targets"), F.max("n").alias("largest"))
