"""Symbol queries: the name index, prefix lists, exact lookup, statistics, windows of ids, and where things are defined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names


def name_index(values: DataFrame) -> DataFrame:
    """name, vid, is_real: each symbol's raw name and, where they differ, its demangled name and that without namespaces.

    Written as Parquet sorted by name, prefix queries read a few row groups only.
    """
    own = values.where(F.col("kind").isin("Func", "GlobalVar") & F.col("name").isNotNull())
    real = own.select("name", "vid", F.lit(True).alias("is_real"))
    forms = own.select("vid", F.col("name").alias("raw"), F.explode(names.ns_suffixes(F.col("demangled"))).alias("name"))
    return real.unionByName(forms.where("name <> raw").select("name", "vid", F.lit(False).alias("is_real")))


def list_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """name, vid of every symbol with a name that begins so: its first one in order."""
    hits = index.where(F.col("name").startswith(prefix.removeprefix("@").removeprefix("%")))
    return hits.groupBy("vid").agg(F.min("name").alias("name")).select("name", "vid")


def without_silenced(listed: DataFrame, values: DataFrame, std: bool = True, llvm: bool = True, runtime: bool = True) -> DataFrame:
    """Rows (.., vid) whose symbol isn't silenced."""
    quiet = values.where(F.col("kind").isin("Func", "GlobalVar") & names.silenced(F.col("demangled"), std, llvm, runtime)).select("vid")
    return listed.join(quiet, "vid", "left_anti").select(*listed.columns)


def exact_lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """name, n_matches, vid, problem for each wanted name: the one symbol of exactly this raw name, or why there is none."""
    found = index.where("is_real").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("v"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    problem = F.when(n == 0, "not found").when(n > 1, "ambiguous")
    return wanted.join(found, "name", "left").select("name", n.alias("n_matches"), F.when(n == 1, F.col("v")).alias("vid"), problem.alias("problem"))


def statistics(values: DataFrame, structs: DataFrame) -> DataFrame:
    """One row of counts and flags: conditional aggregates, so one pass with partial sums."""
    n = lambda c: F.count_if(c)
    kind, body = F.col("kind"), ~F.col("is_decl")
    counted = values.agg(
        n(kind == "GlobalVar").alias("n_globals"), n((kind == "Func") & body).alias("n_functions"), n((kind == "Func") & ~body).alias("n_declared"),
        n((kind == "Func") & F.col("is_intrinsic")).alias("n_intrinsics"), n(kind == "Inst").alias("n_instructions"), n((kind == "Inst") & F.col("is_ptr")).alias("n_pointers"),
        n(F.col("opcode") == "call").alias("n_calls"), F.coalesce(F.max((kind == "Func") & (F.col("demangled") == "main")), F.lit(False)).alias("has_main"),
    )
    return counted.crossJoin(F.broadcast(structs.agg(F.count(F.lit(1)).alias("n_structs"))))  # one row each


def candidate_pointers(values: DataFrame) -> DataFrame:
    """vid of all globals and of pointer arguments and instructions."""
    return values.where((F.col("kind") == "GlobalVar") | (F.col("kind").isin("Arg", "Inst") & F.col("is_ptr"))).select("vid")


def debug_window(values: DataFrame, uses: DataFrame, locs: DataFrame, first: int, n: int = 1, most_uses: int = 10) -> DataFrame:
    """vid, kind, opcode, line, n_uses, users of ``n`` consecutive ids; ids that don't exist are left out.

    Users (instructions only) are listed up to ``most_uses`` uses; beyond, the list is null.
    """
    inside = lambda c: F.col(c).between(first, first + n - 1)
    own = uses.where(inside("def_vid")).groupBy("def_vid").agg(F.count(F.lit(1)).alias("n"))
    few = uses.where(inside("def_vid")).join(own.where(F.col("n") <= most_uses), "def_vid").groupBy("def_vid", "n").agg(F.sort_array(F.collect_set("user_vid")).alias("users"))
    counted = own.join(few.select("def_vid", "users"), "def_vid", "left")
    lines = locs.where(inside("vid") & F.col("path").isNotNull() & (F.col("line_start") != 0)).select("vid", F.col("line_start").alias("line"))
    out = values.where(inside("vid")).join(counted, F.col("vid") == F.col("def_vid"), "left").join(lines, "vid", "left")
    return out.select("vid", "kind", "opcode", "line", F.coalesce("n", F.lit(0)).cast("long").alias("n_uses"), F.when(F.col("n") > most_uses, None).otherwise(F.coalesce("users", F.array().cast("array<int>"))).alias("users"))


def function_ranges(values: DataFrame, locs: DataFrame) -> DataFrame:
    """func_vid, path, line_start, line_end of each function, from its instructions' valid lines."""
    valid = locs.where(F.col("path").isNotNull() & (F.col("line_start") != 0))
    own = values.where("kind = 'Inst'").select("vid", "func_vid").join(valid, "vid")
    return own.groupBy("func_vid").agg(F.min("path").alias("path"), F.min("line_start").alias("line_start"), F.max("line_start").alias("line_end"))


def struct_locations(structs: DataFrame, methods: DataFrame) -> DataFrame:
    """vid, name, class_name, path, line_start, line_end of struct types with a method (class_name, func_vid, path, line_start, line_end).

    The first method in order of its function decides; the end is the last line of any of the class.
    """
    own = structs.withColumn("class_name", names.struct_stripped(F.col("name"))).withColumn("class_name", names.stripped(F.col("class_name")))
    of = methods.groupBy("class_name").agg(F.min_by(F.struct("path", "line_start"), "func_vid").alias("f"), F.max("line_end").alias("line_end"))
    return own.join(of, "class_name").select("vid", "name", "class_name", "f.path", "f.line_start", "line_end")


