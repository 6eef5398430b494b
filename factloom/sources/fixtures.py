"""Program facts derived from the driver's tables by integer arithmetic alone, so that SQL elsewhere derives the same.

Functions are customers, global variables suppliers, struct types parts, instructions orders; constraints come from line
items and a pointer trace from events. Identifier ranges don't overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOBAL, STRUCT, INST = 1_000_000, 2_000_000, 3_000_000

#: What a function of the fixture is called if it is an allocator.
ALLOCATORS = ["malloc", "calloc", "realloc", "_Znwm", "_Znam", "free", "strdup", "strndup", "aligned_alloc", "reallocarray", "_ZdlPv"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, name, demangled, symbol, is_decl, is_intrinsic, signature, is_taken of each function."""
    ns = "case c_custkey % 10 when 0 then 'std' when 1 then 'llvm' when 2 then '__gnu_cxx' else lower(c_mktsegment) end"
    symbols = ", ".join(f"'{s}'" for s in ALLOCATORS)
    return table(spark, sf_dir, "customer").selectExpr(
        "int(c_custkey) as vid", "concat('_Zf', c_custkey) as name", f"concat({ns}, '::f_', c_custkey) as demangled",
        f"if(c_custkey % 25 = 0, element_at(array({symbols}), int(c_custkey div 25 % {len(ALLOCATORS)}) + 1), concat('_Zf', c_custkey)) as symbol",
        "c_custkey % 17 = 3 as is_decl", "c_custkey % 50 = 1 as is_intrinsic", "int(c_nationkey % 8) as signature", "int(c_custkey % 5) as layer", "c_custkey % 3 = 0 as is_taken",
    )


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, kind, func_vid, name, demangled, is_ptr, is_decl, is_intrinsic, opcode of functions, globals and instructions."""
    f = functions(spark, sf_dir).selectExpr("vid", "'Func' as kind", "cast(null as int) as func_vid", "name", "demangled", "true as is_ptr", "is_decl", "is_intrinsic", "cast(null as string) as opcode")
    g = table(spark, sf_dir, "supplier").selectExpr(f"int({GLOBAL} + s_suppkey) as vid", "'GlobalVar' as kind", "cast(null as int) as func_vid", "s_name as name", "s_name as demangled", "true as is_ptr", "s_suppkey % 7 = 0 as is_decl", "false as is_intrinsic", "cast(null as string) as opcode")
    opcode = "case o_orderkey % 8 when 0 then 'call' when 1 then 'alloca' when 2 then 'load' when 3 then 'store' else 'other' end"
    i = table(spark, sf_dir, "orders").selectExpr(f"int({INST} + o_orderkey) as vid", "'Inst' as kind", "int(o_custkey) as func_vid", "cast(null as string) as name", "cast(null as string) as demangled", "o_orderkey % 3 = 0 as is_ptr", "false as is_decl", "false as is_intrinsic", f"{opcode} as opcode")
    return f.unionByName(g).unionByName(i)


def struct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(f"int({STRUCT} + p_partkey) as vid", "concat('struct.', replace(p_brand, '#', '_'), '::', p_type, '.', p_partkey) as name")


def debug_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instruction's line; every 11th has none."""
    return table(spark, sf_dir, "orders").selectExpr(f"int({INST} + o_orderkey) as vid", "if(o_orderkey % 11 = 0, null, concat('src/', o_custkey % 7, '.cc')) as path", "int(o_orderkey % 500 + 1) as line_start")


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """def_vid, user_vid, operand_no: an instruction uses the one of half its number and a global variable."""
    orders = table(spark, sf_dir, "orders")
    n = F.broadcast(table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))  # one row
    a = orders.selectExpr(f"int({INST} + o_orderkey div 2) as def_vid", f"int({INST} + o_orderkey) as user_vid", "1 as operand_no")
    b = orders.join(n).selectExpr(f"int({GLOBAL} + o_orderkey % n) as def_vid", f"int({INST} + o_orderkey) as user_vid", "2 as operand_no")
    return a.unionByName(b)


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """callsite, caller, kind (direct, indirect), operand (the function called, or what its pointer would be), known, empty."""
    n = F.broadcast(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    return table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").join(n).selectExpr(
        f"int({INST} + o_orderkey) as callsite", "int(o_custkey) as caller", "if(o_orderstatus = 'F', 'direct', 'indirect') as kind",
        "int((o_orderkey * 31 + o_custkey * 17) % n) as operand", "not (o_orderstatus = 'P' and o_orderkey % 64 = 0) as known", "o_orderkey % 40 = 16 as empty",
        "int((o_orderkey * 3 + o_custkey) % 8) as signature", "if(o_orderkey % 3 = 0, int(o_orderkey % 5), null) as layer",
    )


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, caller, callsite, callee; the order of edges is that of call sites."""
    return call_sites(spark, sf_dir).selectExpr("if(known, kind, 'unknown') as type", "caller", "callsite", "if(known, operand, null) as callee")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, caller_name, callee_name; some names don't exist."""
    n = F.broadcast(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    return table(spark, sf_dir, "orders").join(n).selectExpr("o_orderkey as seq", "concat('_Zf', o_custkey) as caller_name", "concat('_Zf', (o_orderkey * 13) % (n + 5)) as callee_name")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op, dst, src, of every line item. Variables are 0 and more; allocation sites are negative and are storage cells
    themselves. An order's line items have two variables; 40 variables and 5 sites make a unit that has no constraint with others."""
    return repeated_constraints(spark, sf_dir).distinct()


def repeated_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``constraints`` as often as line items make them."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "case (l_orderkey + l_linenumber * 3) % 10 when 0 then 'ADDR' when 1 then 'ADDR' when 2 then 'LOAD' when 3 then 'STORE' when 4 then 'LOAD' else 'COPY' end as op",
        "int(l_orderkey * 2 + l_linenumber % 2) as dst", "l_partkey * 13 + l_suppkey * 7 as h", "l_suppkey",
    )
    src = "int(case when op = 'ADDR' then -1 - ((dst div 40) * 5 + l_suppkey % 5) else (dst div 40) * 40 + h % 40 end)"
    return rows.selectExpr("op", "dst", f"{src} as src")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, stream_id, vid, action, ptr, size, of events."""
    return trace_of(table(spark, sf_dir, "events"))


def trace_of(events: DataFrame) -> DataFrame:
    """The trace that a frame of events stands for, streaming or not."""
    k = events.selectExpr("event_id", "user_id", "event_type", "floor(value) as v", "cast(get_json_object(props, '$.k') as bigint) as k")
    action = "case event_type when 'purchase' then 0 when 'signup' then 1 when 'error' then 2 else 8 end"
    return k.selectExpr(
        "event_id as seq", "user_id as stream_id", "int(if(event_type in ('view', 'click'), k, event_id)) as vid", f"smallint({action}) as action",
        "k * 16 + if(event_type in ('view', 'click'), v % 16, 0) as ptr", "v % 64 + 1 as size",
    )


def scoped_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with scopes: of the probes some begin (16), end (17) or unwind (18) one."""
    scope = F.expr("smallint(case when action <> 8 then action when seq % 50 = 2 then 18 when seq % 5 = 0 then 16 when seq % 5 = 1 then 17 else 8 end)")
    return trace(spark, sf_dir).withColumn("action", scope).withColumn("vid", F.expr("int(if(action in (16, 18), seq % 4, vid))"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("url as path", "concat('f_', page_id) as heading", "int(page_id % 3) as ord", "html as text")


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat(source, '/', doc_id) as path", "text")


def module_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, line: a module of textual IR for each nation. A customer is a function, every fourth a global variable too."""
    nation = "concat('m', c_nationkey, '.ll') as path"
    rows = table(spark, sf_dir, "customer").selectExpr(nation, "bigint(c_custkey) as k")
    types = rows.select("path").distinct().selectExpr("path", "explode(map(1L, '%struct.Pair = type { %struct.Inner, ptr }', 2L, '%struct.Inner = type { i32 }', 3L, concat('source_filename = \"', path, '\"'))) as (line_no, line)")
    variables = rows.where("k % 4 = 0").selectExpr("path", "100 + k as line_no", "concat('@g_', k, if(k % 8 = 0, ' = global %struct.Pair zeroinitializer', ' = global ptr null')) as line")
    body = "array(concat('define ptr @f_', k, '(ptr noundef %a, i32 %b) {'), '  %p = load ptr, ptr %a, align 8', '  ret ptr %p', '}')"
    functions_ = rows.selectExpr("path", "k", f"posexplode(if(k % 17 = 3, array(concat('declare ptr @f_', k, '(ptr)')), {body})) as (pos, line)")
    return types.unionByName(variables).unionByName(functions_.selectExpr("path", "1000000000000 + k * 10 + pos as line_no", "line"))


#: Functions of a module of the program below.
UNIT = 15

#: The lines of an order with each value of its key modulo 8; {k} is its key, {t} another function of the module.
ORDER_LINES = [
    ["  %x{k} = call ptr @f_{t}(ptr noundef %a, ptr nonnull align 8 %s, i32 {k})", "  store ptr %x{k}, ptr %s, align 8"],
    ["  %x{k} = load ptr, ptr %s, align 8", "  store ptr %x{k}, ptr @g0, align 8"],
    ["  %x{k} = alloca %struct.Pair, align 8", "  store ptr %x{k}, ptr %b, align 8"],
    ["  %h{k} = load ptr, ptr @h, align 8", "  %x{k} = call ptr %h{k}(ptr %s, ptr getelementptr inbounds (%struct.Pair, ptr @g1, i32 0, i32 1), i32 0)"],
    ["  store ptr @f_{t}, ptr @h, align 8", "  %x{k} = getelementptr inbounds %struct.Late, ptr %t, i32 0, i32 1"],
    ["  br label %L{k}", "L{k}:                ; preds = %entry", "  %x{k} = call noalias ptr @malloc(i64 16)", "  store ptr %x{k}, ptr %s, align 8"],
    ["  %x{k} = select i1 true, ptr %a, ptr %t", "  store ptr %x{k}, ptr %s, align 8"],
    ["  call void @llvm.memcpy.p0.p0.i64(ptr align 8 %b, ptr align 8 %s, i64 8, i1 false)", "  call void @sink(ptr sret(%struct.Ret) align 4 %t)"],
]


def program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, line: a program in textual IR. Fifteen customers are a module, a customer is a function and its orders are what it
    does; every 17th is declared only. Modules have global variables, nested types, debug locations and named metadata."""
    f = table(spark, sf_dir, "customer").selectExpr("bigint(c_custkey) as k", f"c_custkey div {UNIT} as m", "c_custkey % 17 = 3 as is_decl").selectExpr("concat('m', lpad(m, 9, '0'), '.ll') as path", f"(k - m * {UNIT}) * 1000000000000 + 1000000000 as base", "*")
    o = table(spark, sf_dir, "orders").selectExpr("bigint(o_orderkey) as o", "bigint(o_custkey) as k").join(f.where("not is_decl"), "k")
    n = F.broadcast(f.agg(F.count(F.lit(1)).alias("n")))  # one row
    o = o.join(n).withColumn("t", F.expr(f"m * {UNIT} + (o * 7 + k) % {UNIT}")).withColumn("t", F.expr(f"if(t < n, t, m * {UNIT})"))
    quoted = lambda line: "concat('" + line.replace("{k}", "', o, '").replace("{t}", "', t, '") + "'"
    scope = f"100 + 2 * (k - m * {UNIT}) + o % 2"
    # the first line of an order that is an instruction has its place in the sources
    kinds = [[quoted(line) + (f", if(o % 11 = 0, '', concat(', !dbg !', 1000 + o)))" if i == 0 else ")") for i, line in enumerate(lines)] for lines in ORDER_LINES]
    body = "case o % 8 " + " ".join(f"when {j} then array({', '.join(lines)})" for j, lines in enumerate(kinds)) + " end"
    rows = [o.selectExpr("path", "base", "o", f"posexplode({body}) as (pos, line)").selectExpr("path", "base + 100 + o * 10 + pos as line_no", "line")]
    head = f"concat('define ptr @f_', k, '(ptr noundef %a, ptr noundef dereferenceable(8) %b, i32 %n) !dbg !', 100 + 2 * (k - m * {UNIT}), ' {{')"
    first = f"if(is_decl, array(concat('declare ptr @f_', k, '(ptr, ptr, i32)')), array({head}, if(k % 2 = 0, '', 'entry:'), '  %s = alloca ptr, align 8', '  %t = alloca %struct.Pair, align 8'))"
    rows.append(f.selectExpr("path", "base", f"posexplode({first}) as (pos, line)").selectExpr("path", "base + pos as line_no", "line"))
    rows.append(f.where("not is_decl").selectExpr("path", "base", "posexplode(array('  %rv = load ptr, ptr %s, align 8', '  ret ptr %rv', '}')) as (pos, line)").selectExpr("path", "base + 900000000000 + pos as line_no", "line"))
    # 10^9 lines from the last function on: declarations and metadata
    top = ["concat('source_filename = \"m', m, '.cc\"')", "'%struct.Pair = type { %struct.Inner, ptr }'", "'%struct.Inner = type { i32, ptr }'", "'%struct.Late = type { ptr, ptr }'", "'%struct.Ret = type { i64 }'", "'@g0 = global ptr null, align 8, !dbg !3'", "'@g1 = global %struct.Pair zeroinitializer, align 8'", f"concat('@h = internal global ptr @f_', m * {UNIT}, ', align 8')"]
    end = ["'declare noalias ptr @malloc(i64)'", "'declare void @llvm.memcpy.p0.p0.i64(ptr, ptr, i64, i1)'", "'declare void @sink(ptr)'", "'!llvm.ident = !{!0}'", "concat('!0 = !{!\"made for m', m, '\"}')", "concat('!1 = !DIFile(filename: \"m', m, '.cc\", directory: \"/src\")')", "'!2 = !DIFile(filename: \"inc.h\", directory: \"/inc\")'",
           "'!3 = !DIGlobalVariableExpression(var: !4, expr: !DIExpression())'", "'!4 = distinct !DIGlobalVariable(name: \"g0\", scope: !5, file: !1, line: 7, type: !6, isLocal: false)'", "'!5 = distinct !DICompileUnit(language: DW_LANG_C_plus_plus_14, file: !1, producer: \"none\")'"]
    modules = f.select("path", "m").distinct()
    rows.append(modules.selectExpr("path", f"posexplode(array({', '.join(top)})) as (pos, line)").selectExpr("path", "bigint(pos + 1) as line_no", "line"))
    rows.append(modules.selectExpr("path", f"posexplode(array({', '.join(end)})) as (pos, line)").selectExpr("path", f"{UNIT} * 1000000000000 + 2000000000 + pos as line_no", "line"))
    spec = f"array(concat('!', 100 + 2 * (k - m * {UNIT}), ' = distinct !DISubprogram(name: \"f_', k, '\", scope: !1, file: !1, line: ', k * 3 % 400 + 1, ', unit: !5)'), concat('!', 101 + 2 * (k - m * {UNIT}), ' = distinct !DILexicalBlock(scope: !', 100 + 2 * (k - m * {UNIT}), ', file: !2, line: 3, column: 1)'))"
    rows.append(f.where("not is_decl").selectExpr("path", "m", "k", f"posexplode({spec}) as (pos, line)").selectExpr("path", f"{UNIT} * 1000000000000 + 3000000000 + k * 2 + pos as line_no", "line"))
    rows.append(o.where("o % 11 <> 0").selectExpr("path", f"{UNIT} * 1000000000000 + 500000000000 + o as line_no", f"concat('!', 1000 + o, ' = !DILocation(line: ', o % 500 + 1, ', column: ', o % 30 + 1, ', scope: !', {scope}, ')') as line"))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out.where("line <> ''")


def field_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op, dst, src, offset of every line item: ``constraints`` with every fifth moving a pointer by up to two fields or, without an
    offset, anywhere in its object; now and then an address is that of unknown memory (site 0). An order has three variables; 120 variables and 15 sites make a unit."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "case (l_orderkey + l_linenumber * 3) % 10 when 0 then 'ADDR' when 1 then 'ADDR' when 2 then 'LOAD' when 3 then 'STORE' when 4 then 'LOAD' when 5 then 'GEP' when 6 then 'GEP' else 'COPY' end as op",
        "int(l_orderkey * 3 + l_linenumber % 3) as dst", "l_partkey * 13 + l_suppkey * 7 as h", "l_suppkey", "l_partkey",
    )
    src = "int(case when op = 'ADDR' then if(l_partkey % 500 = 7, 0, -1 - ((dst div 120) * 15 + l_suppkey % 15)) else (dst div 120) * 120 + h % 120 end)"
    return rows.selectExpr("op", "dst", f"{src} as src", "int(case when op = 'GEP' and l_suppkey % 11 <> 0 then l_partkey % 3 end) as offset").distinct()


def object_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, size of the objects of ``field_constraints``: one field to four."""
    return field_constraints(spark, sf_dir).where("op = 'ADDR' and src < 0").selectExpr("src as site", "int((-src) % 4 + 1) as size").distinct()


#: Orders of a unit of the flow-sensitive program.
FLOW_UNIT = 100


def flow_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at, block, ord, op, dst, src: every line item is a statement and its order the block that it stands in. A hundred orders make a unit of 400
    variables and 20 objects. Line items of one order and number that are equal in what counts are equal statements."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as block", "l_linenumber as ord", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k",
        "case (l_orderkey + l_linenumber * 3) % 10 when 0 then 'ADDR' when 1 then 'ADDR' when 2 then 'LOAD' when 3 then 'STORE' when 4 then 'LOAD' when 5 then 'STORE' when 6 then 'ADDR' else 'COPY' end as op",
        "bigint(l_orderkey * 4 + l_linenumber % 4) as dst", f"l_orderkey div {FLOW_UNIT} as unit", "l_partkey * 13 + l_suppkey * 7 as h", "l_suppkey",
    )
    src = f"bigint(if(op = 'ADDR', -1 - (unit * 20 + l_suppkey % 20), unit * {4 * FLOW_UNIT} + h % {4 * FLOW_UNIT}))"
    return rows.selectExpr("block * 100000 + k as at", "block", "ord", "op", "dst", f"{src} as src")


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, next: an order leads to the next one of its unit, every third also four on and every tenth six back."""
    steps = "filter(array(1, if(o_orderkey % 3 = 0, 4, 1), if(o_orderkey % 10 = 7, -6, 1)), d -> (o_orderkey + d) div {u} = o_orderkey div {u} and o_orderkey + d >= 0)".format(u=FLOW_UNIT)
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as block", f"explode(array_distinct({steps})) as d").selectExpr("block", "block + d as next")


def flow_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site: two thirds of the objects are one cell."""
    return flow_statements(spark, sf_dir).where("op = 'ADDR' and src % 3 <> 0").select(F.col("src").alias("site")).distinct()


#: Types of the fields that calls of one signature go through.
TYPES = 9


def _layer_path(seed: str, n: str, turn: str) -> str:
    """SQL of a path of n fields; from the field ``turn`` on it goes another way."""
    s = f"({seed} + if(i >= {turn}, 1, 0))"
    return f"transform(filter(sequence(0, 9), i -> i < {n}), i -> named_struct('type', bigint(signature * {TYPES} + ({s} + i * i) % {TYPES}), 'field', bigint({s} * (i + 1) % 3)))"


def layer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """callsite, signature, path of the indirect calls, through up to ten fields."""
    return call_sites(spark, sf_dir).where("kind = 'indirect'").selectExpr("callsite", "signature", _layer_path("callsite % 6", "(callsite div 8) % 11", "10") + " as path")


def layer_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """callee, signature, path of the functions whose address is taken."""
    return functions(spark, sf_dir).where("is_taken").selectExpr("vid as callee", "signature", _layer_path("vid % 6", "vid % 11", "vid % 13") + " as path")


def layer_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, to; ``to`` is null where a type is converted to one that isn't followed."""
    n = 8 * TYPES
    return table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 3").selectExpr(f"bigint(s_suppkey % {n}) as type", f"if(s_suppkey % 9 = 8, null, bigint(s_suppkey * 5 % {n})) as to").distinct()
