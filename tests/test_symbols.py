"""Names, allocators, symbols and notes on small programs written by hand."""

import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import memory, names, render
from factloom.operators import notes, sites, symbols

VALUES = "vid int, kind string, func_vid int, name string, demangled string, is_ptr boolean, is_decl boolean, is_intrinsic boolean, opcode string"


@pytest.fixture(scope="module")
def values(spark):
    rows = [
        (0, "GlobalVar", None, "table", "table", True, False, False, None),
        (1, "Func", None, "_ZN1A1fEv", "A::B<x::y>::f", True, False, False, None),
        (2, "Inst", 1, None, None, True, False, False, "alloca"),
        (3, "Inst", 1, None, None, True, False, False, "call"),
        (4, "Func", None, "main", "main", True, False, False, None),
        (5, "Inst", 4, None, None, False, False, False, "store"),
        (6, "Func", None, "malloc", "malloc", True, True, False, None),
        (7, "Func", None, "_ZNSt3fooEv", "std::foo", True, True, False, None),
        (8, "GlobalVar", None, "llvm.used", "llvm.used", True, False, False, None),
    ]
    return spark.createDataFrame(rows, VALUES)


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "forms"),
    [("f", ["f"]), ("A::B::f", ["A::B::f", "B::f", "f"]), ("A<x::y>::g<z::w>::h", ["A<x::y>::g<z::w>::h", "g<z::w>::h", "h"]), ("", [""]), ("a::", ["a::", ""]), ("v<a::b>", ["v<a::b>"])],
)
def test_namespaces(spark, name, forms):
    assert one(spark, names.ns_suffixes(F.col("n")), n=name) == forms
    assert one(spark, names.stripped(F.col("n")), n=name) == forms[-1]


def test_silence(spark):
    quiet = {"std::x": (True, False, False), "llvm::y::z": (False, True, False), "__cxa_throw": (False, False, True), "__gnu_cxx::w": (False, False, True), "__dso_handle": (False, False, True), "mystd::x": (False,) * 3, "std": (False,) * 3}
    df = spark.createDataFrame([(n,) for n in quiet], "n string")
    got = df.select("n", *[names.silenced(F.col("n"), *flags).alias(f"c{k}") for k, flags in enumerate([(True, False, False), (False, True, False), (False, False, True)])]).collect()
    assert {r["n"]: (r["c0"], r["c1"], r["c2"]) for r in got} == quiet


def test_small_functions(spark):
    assert one(spark, names.struct_stripped(F.col("n")), n="class.A::B.12") == "A::B"
    assert [one(spark, names.spawns(F.col("n")), n=x) for x in ("pthread_create", "std_thread_start", "f")] == [True, True, False]
    assert one(spark, names.bare(F.col("n")), n="@@x") == "@x"
    assert one(spark, names.file_name(F.col("n")), n="a/b/c.cc") == "c.cc"
    assert [one(spark, names.strict_int(F.col("n")), n=x) for x in ("12", "-3", "1x", " 1", "", "99999999999")] == [12, -3, None, None, None, None]


def test_allocators(spark):
    dim = {r["symbol"]: r for r in memory.mem_fn(spark).collect()}
    assert len(dim) == memory.mem_fn(spark).count() < 120
    assert dim["_ZnwmSt11align_val_tRKSt9nothrow_t"]["fn_group"] == "new" and dim["_ZdaPvm"]["fn_group"] == "delete_array"
    assert dim["realloc"]["is_alloc"] and dim["realloc"]["is_free"] and not dim["free"]["is_alloc"]
    calls = [("malloc", 8), ("calloc", 8 * 3), ("new_array", 9), ("aligned_alloc", 3), ("reallocarray", 6), ("strdup", 6), ("strndup", 4), ("free", None)]
    df = spark.createDataFrame([(g,) for g, _ in calls], "g string")
    size = memory.allocated_size(F.col("g"), F.lit(8), F.lit(3), F.lit(2), F.lit(5))
    assert [(r[0], r[1]) for r in df.select("g", size).collect()] == calls


def test_index_and_lookup(spark, values):
    index = symbols.name_index(values)
    assert {(r["name"], r["is_real"]) for r in index.where("vid = 1").collect()} == {("_ZN1A1fEv", True), ("A::B<x::y>::f", False), ("B<x::y>::f", False), ("f", False)}
    assert index.where("vid = 4").count() == 1
    assert sorted(r["vid"] for r in symbols.list_prefix(index, "@f").collect()) == [1, 7]
    left = symbols.without_silenced(symbols.list_prefix(index, "f"), values)
    assert [r["vid"] for r in left.collect()] == [1]
    more = index.unionByName(spark.createDataFrame([("main", 99, True)], schemas.NAME_INDEX))
    got = {r["name"]: (r["n_matches"], r["vid"], r["problem"]) for r in symbols.exact_lookup(spark.createDataFrame([("main",), ("f",), ("malloc",)], "name string"), more).collect()}
    assert got == {"main": (2, None, "ambiguous"), "f": (0, None, "not found"), "malloc": (1, 6, None)}


def test_statistics(spark, values):
    s = symbols.statistics(values, spark.createDataFrame([(9, "struct.S")], schemas.STRUCT_TYPE))
    r = s.first()
    assert (r["n_globals"], r["n_functions"], r["n_declared"], r["n_instructions"], r["has_main"], r["n_structs"]) == (2, 2, 2, 3, True, 1)
    assert render.key_values(s).orderBy("ord").first()["line"] == "n_globals: 2"


def test_debug_window_leaves_out_long_use_lists(spark, values):
    uses = spark.createDataFrame([(2, 3, 0), (2, 5, 1), (2, 5, 0), *[(3, 100 + k, 0) for k in range(11)]], schemas.USE)
    locs = spark.createDataFrame([(2, "a.cc", 7, 7), (3, None, 9, 9), (5, "a.cc", 0, 0)], schemas.DEBUG_LOC)
    got = {r["vid"]: (r["line"], r["n_uses"], r["users"]) for r in symbols.debug_window(values, uses, locs, 2, 20).collect()}
    assert got[2] == (7, 3, [3, 5]) and got[3] == (None, 11, None) and got[5] == (None, 0, []) and set(got) == {2, 3, 4, 5, 6, 7, 8}


def test_allocation_sites(spark, values):
    got = sites.allocation_sites(values, spark.createDataFrame([(3, "malloc")], "callsite int, symbol string"), memory.mem_fn(spark))
    assert [tuple(r) for r in sites.in_order(got).collect()] == [("global", 0, None), ("function", 1, 1), ("stack", 2, 1), ("heap", 3, 1), ("function", 4, 4)]
    assert sites.sites_of(got, spark.createDataFrame([(1,)], "func_vid int")).count() == 2


def test_values_as_text(spark, values):
    got = {r["vid"]: r["t"] for r in values.select("vid", render.value_text().alias("t")).collect()}
    assert got[2] == "2 inst of 1" and got[4] == "4 main"
    assert values.select(render.value_text(False)).where("vid = 4").first()[0] == "4"


def test_notes(spark):
    own = spark.createDataFrame([("p", "f", 0, "one"), ("p", "g", 0, ""), ("q", "f", 3, "z")], schemas.NOTE)
    more = notes.append(own, spark.createDataFrame([("p", "f", "two"), ("p", "h", "new"), ("q", "f", "y")], "path string, heading string, text string"))
    seen = {(r["path"], r["heading"]): r["body"] for r in notes.view(more, spark.createDataFrame([("p", "f"), ("p", "g"), ("p", "h"), ("q", "f"), ("r", "f")], "path string, heading string")).collect()}
    assert seen == {("p", "f"): "one\ntwo", ("p", "g"): "(empty)", ("p", "h"): "new", ("q", "f"): "z\ny", ("r", "f"): None}
    assert notes.delete(more, spark.createDataFrame([("p", "f")], "path string, heading string")).count() == 4
    assert {(r["heading"], r["line"]) for r in notes.lines_of_headings(more).where("path = 'p'").collect()} == {("f", 2), ("g", 5), ("h", 7)}
