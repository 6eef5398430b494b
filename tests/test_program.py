"""Programs in textual IR to facts with identifiers, and from these to points-to sets and calls."""

import itertools

import pytest
from pyspark.sql import functions as F

from factloom.operators import callgraph, pointsto
from factloom.sources import files, program

A = """%struct.P = type { ptr, ptr }
@shared = global ptr @impl, align 8, !dbg !7
@table = constant [2 x ptr] [ptr @impl, ptr @"odd name"], !dbg !8, !dbg !7
@away = external global ptr
define ptr @main(ptr %argv) !dbg !3 {
entry:
  %slot = alloca ptr, align 8
  store ptr @impl, ptr %slot, align 8, !dbg !5
  %f = load volatile ptr, ptr %slot, align 8
  %r = call ptr %f(ptr noundef %argv, ptr getelementptr inbounds (%struct.P, ptr @shared, i32 0, i32 1)), !dbg !6
  %o = invoke ptr @outside(ptr %r) to label %go unwind label %bad
go:
  %s = call ptr @next(ptr %o)
  %m = tail call noalias dereferenceable_or_null(8) ptr @calloc(i64 1, i64 8)
  br label %bad
bad:
  %p = phi ptr [ %s, %go ], [ %r, %entry ], [ null, %entry ]
  %q = select i1 true, ptr %p, ptr @away
  %z = call i32 @count(ptr %m)
  call void @llvm.memmove.p0.p0.i64(ptr align 8 %slot, ptr align 8 %m, i64 8, i1 false)
  ret ptr %q
}
define internal ptr @impl(ptr returned %x, ptr %y) {
  store ptr %y, ptr %x
  ret ptr %x
}
define void @"odd name"(i32 %i, ptr %x) {
  %l = load ptr, ptr @table
  call void %l(i32 0, ptr %x)
  ret void
}
declare ptr @outside(ptr)
declare ptr @next(ptr)
declare ptr @calloc(i64, i64)
declare i32 @count(ptr)
declare void @llvm.memmove.p0.p0.i64(ptr, ptr, i64, i1)
!1 = !DIFile(filename: "a.cc", directory: "/src")
!2 = !DIFile(filename: "i.h", directory: "/inc")
!3 = distinct !DISubprogram(name: "main", scope: !1, file: !1, line: 10, scopeLine: 99, unit: !9)
!4 = distinct !DILexicalBlock(scope: !3, file: !2, line: 1)
!5 = !DILocation(line: 42, column: 7, scope: !4)
!6 = !DILocation(line: 0, scope: !3)
!7 = !DIGlobalVariableExpression(var: !10, expr: !DIExpression())
!8 = !DIGlobalVariableExpression(var: !11, expr: !DIExpression())
!10 = distinct !DIGlobalVariable(name: "shared", file: !1, line: 3)
!11 = distinct !DIGlobalVariable(name: "nowhere", line: 5)
"""
B = """@away = global ptr null
define ptr @next(ptr %n) {
  %v = load ptr, ptr @away
  store ptr %n, ptr @away
  ret ptr %v
}
"""


class Program:
    def __init__(self, spark, *modules):
        texts = spark.createDataFrame([(f"{i}.ll", t) for i, t in enumerate(modules)], "path string, text string")
        self.lines = files.in_functions(files.split_lines(texts)).cache()
        self.values = program.values(self.lines).cache()
        self.insts = program.instructions(self.lines, self.values).cache()
        known = program.names(self.values).cache()
        self.sites = program.call_sites(self.insts, known, self.values).cache()
        self.passed = program.passed(self.insts, known).cache()
        self.constraints = program.constraints(self.lines, self.insts, known, self.values, self.sites, self.passed).cache()
        self.calls = (self.sites.where("kind = 'indirect'").join(self.passed, "callsite").select("operand", "pos", "node"), program.formals(self.values).select(program.site(F.col("func_id")).alias("site"), "pos", "node"))
        self.name = {r["id"]: (r["func"] + ":" if r["func"] and r["name"] else "") + (r["name"] or f"{r['func']}:{r['opcode']}") for r in self.values.collect()}

    def called(self, n):
        if n == program.ANYTHING:
            return "ANYTHING"
        return f"&{self.name[-1 - n]}" if n < 0 else f"{self.name[n - program.RETURN]}()" if n >= program.RETURN else self.name[n]

    def facts(self):
        return {(r["op"], self.called(r["dst"]), self.called(r["src"])) for r in self.constraints.collect()}


def solved(constraints, given, formals):
    """Sets grown until nothing changes."""
    pts, copies = {}, {(d, s) for op, d, s in constraints if op == "COPY"}
    for op, d, s in constraints:
        if op == "ADDR":
            pts.setdefault(d, set()).add(s)
    while True:
        before = sum(map(len, pts.values())), len(copies)
        for op, d, s in constraints:
            if op == "LOAD":
                copies |= {(d, o) for o in pts.get(s, ())}
            if op == "STORE":
                copies |= {(o, s) for o in pts.get(d, ())}
        for (operand, pos, node), (site, at, formal) in itertools.product(given, formals):
            if pos == at and site in pts.get(operand, ()):
                copies.add((node, formal) if pos == -1 else (formal, node))
        for d, s in copies:
            pts.setdefault(d, set()).update(pts.get(s, ()))
        if before == (sum(map(len, pts.values())), len(copies)):
            return {(p, o) for p, s in pts.items() for o in s}


@pytest.fixture(scope="module")
def two(spark):
    return Program(spark, A, B)


def test_constraints_of_a_program(two):
    own = {f for f in two.facts() if f[0] != "ADDR"}
    assert own == {
        ("STORE", "shared", "impl"), ("STORE", "table", "impl"), ("STORE", "table", "odd name"), ("STORE", "main:%slot", "impl"), ("LOAD", "main:%f", "main:%slot"),
        ("COPY", "next:%n", "main:%o"), ("COPY", "main:%s", "next()"), ("COPY", "main:%p", "main:%s"), ("COPY", "main:%p", "main:%r"), ("COPY", "main:%q", "main:%p"), ("COPY", "main:%q", "away"),
        ("COPY", "main()", "main:%q"), ("STORE", "impl:%x", "impl:%y"), ("COPY", "impl()", "impl:%x"), ("LOAD", "odd name:%l", "table"), ("LOAD", "next:%v", "away"), ("STORE", "away", "next:%n"), ("COPY", "next()", "next:%v"),
        ("LOAD", "main:call", "main:%m"), ("STORE", "main:%slot", "main:call"),
    }
    assert {f[1:] for f in two.facts() if f[0] == "ADDR" and not f[2].startswith("&" + f[1])} == {("main:%o", "ANYTHING"), ("ANYTHING", "ANYTHING")}
    assert {f[1] for f in two.facts() if f[0] == "ADDR"} >= {"shared", "table", "away", "impl", "main:%slot", "main:%m", "outside"}


def test_names_declared_here_and_defined_there_are_one(two):
    away = {r["id"] for r in two.values.where("name = 'away' and not is_decl").collect()}
    assert {r["src"] for r in two.constraints.where("op = 'LOAD'").collect()} >= away
    assert two.constraints.join(two.values.where("is_decl and name in ('away', 'next')").select("id"), F.col("src") == F.col("id")).where("op <> 'ADDR'").isEmpty()


def test_calls_are_resolved_while_solving(two):
    got = {(r["ptr"], r["site"]) for r in pointsto.inclusion(two.constraints, calls=two.calls).collect()}
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert got == solved(rows(two.constraints.select("op", "dst", "src")), rows(two.calls[0]), rows(two.calls[1]))
    named = {(two.called(p), two.called(s)) for p, s in got}
    assert ("impl:%y", "&shared") in named and ("odd name:%l", "&odd name") in named and ("main:%o", "ANYTHING") in named and ("main:%s", "ANYTHING") in named
    sites = {(r["kind"], two.called(r["operand"])) for r in two.sites.collect()}
    assert sites == {("indirect", "main:%f"), ("direct", "outside"), ("direct", "next"), ("direct", "calloc"), ("direct", "count"), ("direct", "llvm.memmove.p0.p0.i64"), ("indirect", "odd name:%l")}


def test_places(two):
    got = {(two.called(r["id"]), r["path"], r["line_start"], r["line_end"], r["column"]) for r in program.places(two.lines, two.insts, two.values).collect()}
    assert got == {("main:store", "/inc/i.h", 42, 42, 7), ("main", "/src/a.cc", 10, 42, 0), ("shared", "/src/a.cc", 3, 3, 0), ("table", "/src/a.cc", 3, 3, 0)}


def test_empty_program(spark):
    p = Program(spark, "")
    assert p.values.count() == 0 and p.sites.count() == 0 and {f[1] for f in p.facts()} == {"ANYTHING"}
    assert program.places(p.lines, p.insts, p.values).count() == 0
    assert callgraph.reach_set(p.sites.selectExpr("kind as type", "int(caller) as caller", "int(callsite) as callsite", "int(operand) as callee"), p.values.selectExpr("int(id) as vid")).count() == 0
