"""Allocation sites: globals, functions, stack and heap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names


def allocation_sites(values: DataFrame, direct_calls: DataFrame, mem_fn: DataFrame) -> DataFrame:
    """type, vid, func_vid: globals (declared ones too, the compiler's own not); of each defined function itself, then its
    allocas and its direct calls (callsite, symbol) of allocators. Order: func_vid (none first), function, vid."""
    g = values.where((F.col("kind") == "GlobalVar") & ~names.intrinsic(F.col("name"))).select(F.lit("global").alias("type"), "vid", F.lit(None).cast("int").alias("func_vid"))
    defined = values.where((F.col("kind") == "Func") & ~F.col("is_decl") & ~F.col("is_intrinsic")).select(F.col("vid").alias("func_vid"))
    f = defined.select(F.lit("function").alias("type"), F.col("func_vid").alias("vid"), "func_vid")
    inside = values.where("kind = 'Inst'").select("vid", "func_vid", "opcode").join(defined, "func_vid")
    stack = inside.where("opcode = 'alloca'").select(F.lit("stack").alias("type"), "vid", "func_vid")
    heap_calls = direct_calls.join(F.broadcast(mem_fn.where("is_alloc").select("symbol")), "symbol").select(F.col("callsite").alias("vid"))
    heap = inside.join(heap_calls, "vid").select(F.lit("heap").alias("type"), "vid", "func_vid")
    return reduce(DataFrame.unionByName, [g, f, stack, heap])


def sites_of(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Stack and heap sites of the functions (func_vid)."""
    return sites.where("type in ('stack', 'heap')").join(functions, "func_vid", "left_semi").select("type", "vid", "func_vid")


def in_order(sites: DataFrame) -> DataFrame:
    return sites.orderBy(F.col("func_vid").asc_nulls_first(), F.col("type") != "function", "vid")
