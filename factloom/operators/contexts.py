"""Calls in points-to solving: contexts by call strings, and targets of indirect calls found while solving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import pointsto
from factloom.operators.lineage import cut


def contexts(calls: DataFrame, roots: DataFrame, k: int, most_rounds: int = 1000) -> DataFrame:
    """func, ctx: the call strings (the last ``k`` call sites, newest first) in which functions run, from the roots (func).

    ``calls``: callsite, caller, callee and, if only some calls make a context (those that spawn: origins), push. With k = 0
    every function has the empty one. Rounds join the new ones with calls.
    """
    step = cut(_pushing(calls).select("callsite", "caller", "callee", "push").distinct())
    frontier = cut(roots.select("func", F.array().cast("array<int>").alias("ctx")).distinct())
    seen = frontier
    for _ in range(most_rounds):
        new = frontier.join(step, F.col("func") == F.col("caller")).select(F.col("callee").alias("func"), _pushed(k).alias("ctx")).distinct()
        new = cut(new.join(seen, ["func", "ctx"], "left_anti"))
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new
    raise RuntimeError("contexts have not converged")


def _pushing(calls: DataFrame) -> DataFrame:
    return calls if "push" in calls.columns else calls.withColumn("push", F.lit(True))


def _pushed(k: int) -> Column:
    return F.when(F.col("push"), F.slice(F.concat(F.array("callsite"), "ctx"), 1, k)).otherwise(F.col("ctx")) if k else F.array().cast("array<int>")


def _at(var: Column, owned: Column, ctx: Column) -> Column:
    """A variable in a context as one name; those that no function owns (globals, sites) are the same in all."""
    return F.when(owned, F.concat(var.cast("string"), F.lit("@"), F.array_join(F.transform(ctx, lambda x: x.cast("string")), ","))).otherwise(var.cast("string"))


def clone(constraints: DataFrame, owners: DataFrame, passed: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """op, dst, src (names) with a copy of a function's constraints for each of its contexts.

    ``constraints``: op, dst, src, func; ``owners``: var, func; ``passed``: callsite, caller, callee, dst, src, back (and push, as
    in ``contexts``), the copies that a call makes, into its callee (back false) or out of it; ``found``: func, ctx.
    """
    owned = owners.select("var", F.lit(True).alias("own"))
    of = lambda df, c: df.join(owned.select(F.col("var").alias(c), F.col("own").alias(f"own_{c}")), c, "left").withColumn(f"own_{c}", F.coalesce(f"own_{c}", F.lit(False)))
    inside = of(of(constraints, "dst"), "src").join(found, "func").select("op", _at(F.col("dst"), F.col("own_dst"), F.col("ctx")).alias("dst"), _at(F.col("src"), F.col("own_src"), F.col("ctx")).alias("src"))
    over = of(of(_pushing(passed), "dst"), "src").join(found, F.col("caller") == F.col("func")).withColumn("in", _pushed(k))
    there, here = F.when(F.col("back"), F.col("ctx")).otherwise(F.col("in")), F.when(F.col("back"), F.col("in")).otherwise(F.col("ctx"))
    calls = over.select(F.lit("COPY").alias("op"), _at(F.col("dst"), F.col("own_dst"), there).alias("dst"), _at(F.col("src"), F.col("own_src"), here).alias("src"))
    return inside.unionByName(calls).distinct()


def without_contexts(pts: DataFrame) -> DataFrame:
    """ptr, site of a cloned solution: the union over contexts."""
    return pts.select(F.substring_index("ptr", "@", 1).alias("ptr"), F.substring_index("site", "@", 1).alias("site")).distinct()


def solve_with_calls(constraints: DataFrame, indirect: DataFrame, params: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(ptr, site) and (callsite, callee) where indirect calls are resolved by what is solved, until no call is new.

    ``indirect``: callsite, operand (the pointer called), arg, result; ``params``: site (a function's), callee, param, ret.
    """
    targets, extra = None, None
    for _ in range(most_rounds):
        pts = cut(pointsto.inclusion(constraints if extra is None else constraints.unionByName(extra)))
        now = indirect.join(pts, F.col("operand") == F.col("ptr")).join(params, "site").select("callsite", "callee", "arg", "result", "param", "ret").distinct()
        new = cut(now if targets is None else now.join(targets, ["callsite", "callee"], "left_anti"))
        if new.isEmpty():
            return pts, (targets if targets is not None else now).select("callsite", "callee").distinct()
        targets = new if targets is None else targets.unionByName(new)
        into = targets.where("arg is not null and param is not null").select(F.lit("COPY").alias("op"), F.col("param").alias("dst"), F.col("arg").alias("src"))
        out = targets.where("result is not null and ret is not null").select(F.lit("COPY").alias("op"), F.col("result").alias("dst"), F.col("ret").alias("src"))
        extra = into.unionByName(out).distinct()
    raise RuntimeError("calls have not converged")
