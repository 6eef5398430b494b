"""The registered program-fact queries and their SQL twins, over facts derived from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import memory, names
from factloom.operators import callgraph, commands, cycles, dyck, fields, flow, layers, notes, pointsto, sites, symbols
from factloom.operators.lineage import build_once, cut, removed_after, shared_dir
from factloom.sources import files, ir, note_store
from factloom.sources import fixtures as X
from factloom.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- facts in SQL --------------------------------------------------------------------------------------------------

_ALLOCATORS = "[" + ", ".join(f"'{s}'" for s in X.ALLOCATORS) + "]"
FUNCS = f"""fn as (select c_custkey::int as vid, '_Zf' || c_custkey as name,
  case c_custkey % 10 when 0 then 'std' when 1 then 'llvm' when 2 then '__gnu_cxx' else lower(c_mktsegment) end as ns, ns || '::f_' || c_custkey as demangled,
  case when c_custkey % 25 = 0 then {_ALLOCATORS}[c_custkey // 25 % {len(X.ALLOCATORS)} + 1] else '_Zf' || c_custkey end as symbol,
  c_custkey % 17 = 3 as is_decl, c_custkey % 50 = 1 as is_intrinsic, (c_nationkey % 8)::int as signature, (c_custkey % 5)::int as layer, c_custkey % 3 = 0 as is_taken from customer)"""
INDEX = FUNCS + f""", raw as (select vid, name, demangled, ns from fn),
ix as (select name, vid, true as is_real from raw union all select demangled, vid, false from raw union all select 'f_' || vid, vid, false from raw
  union all select s_name, ({X.GLOBAL} + s_suppkey)::int, true from supplier)"""
SITES = f"""cs as (select ({X.INST} + o_orderkey)::int as callsite, o_custkey::int as caller, case when o_orderstatus = 'F' then 'direct' else 'indirect' end as kind,
  ((o_orderkey * 31 + o_custkey * 17) % (select count(*) from customer))::int as operand, not (o_orderstatus = 'P' and o_orderkey % 64 = 0) as known, o_orderkey % 40 = 16 as empty,
  ((o_orderkey * 3 + o_custkey) % 8)::int as signature, case when o_orderkey % 3 = 0 then (o_orderkey % 5)::int end as layer from orders where o_orderkey % 8 = 0)"""
EDGES = SITES + """, edges as (select case when known then kind else 'unknown' end as type, caller, callsite, case when known then operand end as callee from cs)"""
CONS = """c0 as (select case (l_orderkey + l_linenumber * 3) % 10 when 0 then 'ADDR' when 1 then 'ADDR' when 2 then 'LOAD' when 3 then 'STORE' when 4 then 'LOAD' else 'COPY' end op,
  l_orderkey * 2 + l_linenumber % 2 dst, l_partkey * 13 + l_suppkey * 7 h, l_suppkey from lineitem),
cn as (select distinct op, dst::int as dst, (case when op = 'ADDR' then -1 - ((dst // 40) * 5 + l_suppkey % 5) else (dst // 40) * 40 + h % 40 end)::int as src from c0)"""
PTS = "recursive " + CONS + """, sol(v, o, n) using key (v, o) as (
  select dst, src, 0 from cn where op = 'ADDR'
  union
  (select x.v, x.o, 1 from (
     select cn.dst v, p.o o from recurring.sol p join cn on cn.op = 'COPY' and cn.src = p.v
     union select cn.dst, p2.o from recurring.sol p join cn on cn.op = 'LOAD' and cn.src = p.v join recurring.sol p2 on p2.v = p.o
     union select p.o, p2.o from recurring.sol p join cn on cn.op = 'STORE' and cn.dst = p.v join recurring.sol p2 on p2.v = cn.src) x
   where not exists (select 1 from recurring.sol q where q.v = x.v and q.o = x.o))),
pts as (select v as ptr, o as site from sol)"""
#: Pointers: every variable below a bound that the constraints name; every 97th isn't known.
PTRS = """ptrs as (select distinct n as ptr, n % 97 <> 5 as known from (select dst as n from cn union all select src from cn where op <> 'ADDR') where n >= 0)"""
TRACE = """tr as (select event_id as seq, user_id as stream_id, case event_type when 'purchase' then 0 when 'signup' then 1 when 'error' then 2 else 8 end as action,
  (case when event_type in ('view', 'click') then k else event_id end)::int as vid, k * 16 + case when event_type in ('view', 'click') then v % 16 else 0 end as ptr, v % 64 + 1 as size
  from (select event_id, user_id, event_type, floor(value)::bigint as v, (props ->> '$.k')::bigint as k from events))"""
HITS = TRACE + """, rg as (select *, lead(seq) over (partition by stream_id, ptr order by seq) as until from tr where action < 3),
met as (select p.stream_id, p.seq, p.vid as ptr, p.ptr as addr, r.ptr as base, r.size, r.vid as site,
    row_number() over (partition by p.stream_id, p.seq order by r.ptr desc) as k
  from tr p join rg r on r.stream_id = p.stream_id and r.action < 2 and r.ptr <= p.ptr and r.seq < p.seq and (r.until is null or r.until > p.seq) where p.action = 8),
hits as (select stream_id, seq, ptr, site from met where k = 1 and addr < base + size)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return symbols.name_index(X.values(spark, d))


def _pts(spark: SparkSession, d: str) -> DataFrame:
    """Solved once for each session and input, as every points-to query starts from it."""
    return build_once(spark, ("pts", d), lambda: pointsto.inclusion(X.constraints(spark, d)), d)


def _status(spark: SparkSession, d: str) -> DataFrame:
    """Pointers and whether they are known, from line items as they are: one pass, and only pointers are made distinct."""
    named = X.repeated_constraints(spark, d).selectExpr("explode(array(dst, if(op <> 'ADDR', src, null))) as ptr").where("ptr >= 0").distinct()
    return named.select("ptr", (F.col("ptr") % 97 != 5).alias("known"))


# ---- symbols -------------------------------------------------------------------------------------------------------


@query(f"with {FUNCS} select (select count(*) from supplier) as n_globals, (select count(*) from fn where not is_decl) as n_functions, (select count(*) from fn where is_decl) as n_declared, (select count(*) from fn where is_intrinsic) as n_intrinsics, (select count(*) from orders) as n_instructions, (select count(*) from orders where o_orderkey % 3 = 0) as n_pointers, (select count(*) from orders where o_orderkey % 8 = 0) as n_calls, false as has_main, (select count(*) from part) as n_structs")
def q_stat(spark, d):
    return symbols.statistics(X.values(spark, d), X.struct_types(spark, d))


@query(f"with {INDEX} select min(name) as name, vid from ix where name like 'automobile::f\\_1%' escape '\\' group by vid")
def q_list_prefix(spark, d):
    return symbols.list_prefix(_index(spark, d), "@automobile::f_1")


@query(f"with {INDEX} select min(ix.name) as name, vid from ix where ix.name like 'f\\_%' escape '\\' and vid not in (select vid from fn where ns in ('std', 'llvm', '__gnu_cxx')) group by vid")
def q_list_silenced(spark, d):
    return symbols.without_silenced(symbols.list_prefix(_index(spark, d), "f_"), X.values(spark, d))


@query(f"with {INDEX}, w as (select '_Zf' || (c_custkey * 3) as name from customer union all select demangled from fn) select w.name, count(ix.vid) as n_matches, case when count(ix.vid) = 1 then min(ix.vid) end as vid, case when count(ix.vid) = 0 then 'not found' when count(ix.vid) > 1 then 'ambiguous' end as problem from w left join ix on ix.name = w.name and ix.is_real group by w.name")
def q_exact_lookup(spark, d):
    raw = X.table(spark, d, "customer").selectExpr("concat('_Zf', c_custkey * 3) as name")
    return symbols.exact_lookup(raw.unionByName(X.functions(spark, d).selectExpr("demangled as name")), _index(spark, d))


@query(f"with {INDEX} select * from ix")
def q_ns_suffix_index(spark, d):
    return _index(spark, d)


@query(f"""with u as (select ({X.INST} + o_orderkey // 2)::int as def_vid, ({X.INST} + o_orderkey)::int as user_vid from orders union all select ({X.GLOBAL} + o_orderkey % (select count(*) from supplier))::int, ({X.INST} + o_orderkey)::int from orders),
n as (select def_vid, count(*) as n, list_sort(list(distinct user_vid)) as users from u group by def_vid)
select ({X.INST} + o_orderkey)::int as vid, 'Inst' as kind, case o_orderkey % 8 when 0 then 'call' when 1 then 'alloca' when 2 then 'load' when 3 then 'store' else 'other' end as opcode,
  case when o_orderkey % 11 <> 0 then (o_orderkey % 500 + 1)::int end as line, coalesce(n, 0) as n_uses, case when n > 10 then null else coalesce(users, []) end as users
from orders left join n on n.def_vid = {X.INST} + o_orderkey""")
def q_debug_window(spark, d):
    return symbols.debug_window(X.values(spark, d), X.uses(spark, d), X.debug_locs(spark, d), X.INST, 1_000_000_000)


@query("select o_custkey::int as func_vid, min('src/' || o_custkey % 7 || '.cc') as path, min(o_orderkey % 500 + 1)::int as line_start, max(o_orderkey % 500 + 1)::int as line_end from orders where o_orderkey % 11 <> 0 group by o_custkey")
def q_function_ranges(spark, d):
    return symbols.function_ranges(X.values(spark, d), X.debug_locs(spark, d))


@query(f"""with s as (select ({X.STRUCT} + p_partkey)::int as vid, 'struct.' || replace(p_brand, '#', '_') || '::' || p_type || '.' || p_partkey as name, p_type as class_name from part),
m as (select p_type as class_name, p_partkey as func_vid, 'src/' || p_partkey % 7 || '.cc' as path, (p_partkey % 90 + 1)::int as line_start, (p_partkey % 90 + p_size)::int as line_end from part where p_partkey % 3 = 1 and p_type <> 'PROMO'),
f as (select class_name, arg_min(path, func_vid) as path, arg_min(line_start, func_vid) as line_start, max(line_end) as line_end from m group by class_name)
select s.vid, s.name, s.class_name, f.path, f.line_start, f.line_end from s join f using (class_name)""")
def q_struct_debug(spark, d):
    methods = X.table(spark, d, "part").where("p_partkey % 3 = 1 and p_type <> 'PROMO'").selectExpr("p_type as class_name", "p_partkey as func_vid", "concat('src/', p_partkey % 7, '.cc') as path", "int(p_partkey % 90 + 1) as line_start", "int(p_partkey % 90 + p_size) as line_end")
    return symbols.struct_locations(X.struct_types(spark, d), methods)


@query(f"select ({X.GLOBAL} + s_suppkey)::int as vid from supplier union all select ({X.INST} + o_orderkey)::int from orders where o_orderkey % 3 = 0")
def q_candidate_pointers(spark, d):
    return symbols.candidate_pointers(X.values(spark, d))


# ---- allocation ----------------------------------------------------------------------------------------------------

_MEM = "mem(symbol, fn_group, is_alloc, is_free) as (values ('malloc', 'malloc', true, false), ('calloc', 'calloc', true, false), ('realloc', 'realloc', true, true), ('_Znwm', 'new', true, false), ('_Znam', 'new_array', true, false), ('free', 'free', false, true), ('strdup', 'strdup', true, false), ('strndup', 'strndup', true, false), ('aligned_alloc', 'aligned_alloc', true, false), ('reallocarray', 'reallocarray', true, true), ('_ZdlPv', 'delete', false, true))"
_ALLOC = f"""{FUNCS}, {EDGES}, {_MEM}, df as (select vid from fn where not is_decl and not is_intrinsic),
al as (select 'global' as type, ({X.GLOBAL} + s_suppkey)::int as vid, null::int as func_vid from supplier union all select 'function', vid, vid from df
  union all select 'stack', ({X.INST} + o_orderkey)::int, o_custkey::int from orders join df on df.vid = o_custkey where o_orderkey % 8 = 1
  union all select 'heap', callsite, caller from edges join fn on fn.vid = callee and type = 'direct' join mem on mem.symbol = fn.symbol and is_alloc join df on df.vid = caller)"""


def _direct_calls(spark, d):
    return X.call_edges(spark, d).where("type = 'direct'").join(X.functions(spark, d).select(F.col("vid").alias("callee"), "symbol"), "callee").select("callsite", "symbol")


def _sites(spark, d):
    return sites.allocation_sites(X.values(spark, d), _direct_calls(spark, d), memory.mem_fn(spark))


@query(f"with {_ALLOC} select * from al")
def q_site_all(spark, d):
    return _sites(spark, d)


@query(f"with {_ALLOC} select * from al where type in ('stack', 'heap')")
def q_site_fn(spark, d):
    return sites.sites_of(_sites(spark, d), X.functions(spark, d).select(F.col("vid").alias("func_vid")))


@query(f"with {FUNCS}, {_MEM} select fn.vid, symbol, fn_group, is_alloc, is_free from fn join mem using (symbol)")
def q_mem_class(spark, d):
    return X.functions(spark, d).join(F.broadcast(memory.mem_fn(spark)), "symbol").select("vid", "symbol", "fn_group", "is_alloc", "is_free")


@query(f"""with {FUNCS}, {EDGES}, {_MEM}, a as (select callsite, fn_group, (callsite % 64)::bigint as a0, (caller % 16 + 1)::bigint as a1, (callsite % 5 + 1)::bigint as a2, (callsite % 23)::bigint as n from edges join fn on fn.vid = callee and type = 'direct' join mem using (symbol))
select callsite, fn_group, case when fn_group in ('malloc', 'new') then a0 when fn_group = 'new_array' then a0 + 1 when fn_group in ('aligned_alloc', 'realloc') then a1 when fn_group = 'calloc' then a0 * a1 when fn_group = 'reallocarray' then a1 * a2 when fn_group = 'strdup' then n + 1 when fn_group = 'strndup' then least(n, a1) + 1 end as size from a""")
def q_mem_size_rules(spark, d):
    own = X.call_edges(spark, d).where("type = 'direct'").join(X.functions(spark, d).select(F.col("vid").alias("callee"), "symbol"), "callee").join(F.broadcast(memory.mem_fn(spark)), "symbol")
    number = lambda e: F.expr(f"bigint({e})")
    return own.select("callsite", "fn_group", memory.allocated_size(F.col("fn_group"), number("callsite % 64"), number("caller % 16 + 1"), number("callsite % 5 + 1"), number("callsite % 23")).alias("size"))


# ---- call graph ----------------------------------------------------------------------------------------------------

_BUILT = f"""{FUNCS}, {SITES}, tg as (select callsite as ptr, operand as site from cs where kind = 'indirect' and known and not empty union all select callsite, (operand + 1) % (select count(*) from customer)::int from cs where kind = 'indirect' and known and not empty and callsite % 24 = 0),
built as (select 'direct' as type, caller, callsite, operand as callee from cs join fn on fn.vid = operand where kind = 'direct' and not is_intrinsic
  union all select 'unknown', caller, callsite, null from cs where kind = 'indirect' and not known
  union all select 'indirect', caller, callsite, site from cs join tg on tg.ptr = callsite join fn on fn.vid = site where kind = 'indirect' and known and not is_intrinsic)"""


def _targets(spark, d):
    own = X.call_sites(spark, d).where("kind = 'indirect' and known and not empty")
    n = X.table(spark, d, "customer").agg(F.count(F.lit(1)).cast("int").alias("n"))
    more = own.where("callsite % 24 = 0").join(F.broadcast(n)).selectExpr("callsite as ptr", "(operand + 1) % n as site")
    return own.selectExpr("callsite as ptr", "operand as site").unionByName(more)


def _built(spark, d):
    own = X.call_sites(spark, d)
    return callgraph.build_edges(own, X.functions(spark, d), _targets(spark, d), own.selectExpr("callsite as ptr", "known"))


@query(f"with {_BUILT} select * from built")
def q_edge_build(spark, d):
    return _built(spark, d)


_PATCH = f"""pt as (select o_orderkey as seq, o_custkey as a, (o_orderkey * 13) % ((select count(*) from customer) + 5) as b from orders)"""


@query(f"with {_PATCH} select seq, 'indirect' as type, a::int as caller, null::int as callsite, b::int as callee from pt where b < (select count(*) from customer)")
def q_patch_edges(spark, d):
    return callgraph.patch_edges(X.patches(spark, d), _index(spark, d))[0]


@query(f"with {_PATCH} select seq, '_Zf' || a as caller_name, '_Zf' || b as callee_name from pt where b >= (select count(*) from customer)")
def q_patch_problems(spark, d):
    return callgraph.patch_edges(X.patches(spark, d), _index(spark, d))[1]


@query(f"""with {EDGES}, {FUNCS}, {_PATCH}, u as (select type, caller, callsite, callee, null::bigint as seq from edges
  union all select 'indirect', a::int, null, b::int, seq from pt join fn on fn.vid = a where b < (select count(*) from customer) and not is_decl and not is_intrinsic)
select type, caller, callsite, callee, (row_number() over (partition by caller order by callsite nulls last, seq nulls first, callee nulls last))::int as place from u""")
def q_callout_patched(spark, d):
    patched = callgraph.patch_edges(X.patches(spark, d), _index(spark, d))[0]
    return callgraph.with_patches(X.call_edges(spark, d), patched, X.functions(spark, d))


@query(f"with {EDGES}, {FUNCS} select * from edges where callee is null or callee not in (select vid from fn where ns in ('std', 'llvm', '__gnu_cxx'))")
def q_callout_silenced(spark, d):
    return callgraph.without_silenced(X.call_edges(spark, d), X.functions(spark, d).where(names.silenced(F.col("demangled"))).select("vid"))


@query(f"with {EDGES} select * from edges")
def q_callout(spark, d):
    return callgraph.callout(X.call_edges(spark, d), X.functions(spark, d).select(F.col("vid").alias("caller")))


@query(f"with {EDGES} select arg_min(type, callsite) as type, caller, min(callsite) as callsite, callee from edges group by caller, callee")
def q_callout_dedup(spark, d):
    return callgraph.first_of_pairs(X.call_edges(spark, d))


@query(f"with {EDGES} select 'known' as section, * from edges where callee is not null union all select 'unknown', * from edges where type = 'unknown'")
def q_callin(spark, d):
    return callgraph.callin(X.call_edges(spark, d), X.functions(spark, d).select(F.col("vid").alias("callee")))


@query(f"with {_BUILT} select callsite, count(callee) as n_targets, coalesce(list_sort(list(distinct callee) filter (where callee is not null)), []) as targets, max((type = 'unknown')::int) = 1 as unknown from built group by callsite")
def q_callsite_targets(spark, d):
    return callgraph.callsite_targets(_built(spark, d))


_REACH = f"recursive {EDGES}, r as (select caller as source, callee as node from edges where caller % 100 = 0 and callee is not null union select r.source, e.callee from r join edges e on e.caller = r.node where e.callee is not null)"


@query(f"with {_REACH} select source, node from r")
def q_reach_set(spark, d):
    return callgraph.reach_set(X.call_edges(spark, d), X.functions(spark, d).where("vid % 100 = 0").select("vid")).select("source", "node")


_PAIRS = "pr as (select distinct c_custkey::int as source, ((c_custkey * 31 + k * 97 + 3) % (select count(*) from customer))::int as target from customer, range(8) r(k) where c_custkey % 100 = 0)"


def _pairs(spark, d):
    """Of every hundredth function, whether it reaches eight others."""
    n = F.broadcast(X.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    own = X.functions(spark, d).where("vid % 100 = 0").join(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return own.selectExpr("vid as source", "int((bigint(vid) * 31 + k * 97 + 3) % n) as target").distinct()


@query(f"with {_REACH}, {_PAIRS}, b as (select distinct source from (select source, node from r union all select source, source from pr) x where node in (select caller from edges where type = 'unknown')) select source, target, exists (select 1 from r where r.source = pr.source and r.node = pr.target) or source in (select source from b) as reachable from pr")
def q_reach(spark, d):
    return callgraph.reachable(X.call_edges(spark, d), _pairs(spark, d))


@query(f"with {_REACH}, {_PAIRS} select source, target, exists (select 1 from r where r.source = pr.source and r.node = pr.target) as reachable from pr")
def q_reach_ignore_unknown(spark, d):
    return callgraph.reachable(X.call_edges(spark, d), _pairs(spark, d), ignore_unknown=True)


def _paths_sql(ignore_unknown: bool) -> str:
    """Levels as breadth-first search finds them, the end that decides, and the way back to the source, edge by edge."""
    ends = "select source, target, false as blind, target as node, hops as h from pr join lv on lv.source = pr.source and lv.node = pr.target" if ignore_unknown else """select pr.source, pr.target, lv.hops is null or lv.hops > bl.u.h + 1 as blind, case when lv.hops is null or lv.hops > bl.u.h + 1 then bl.u.n else pr.target end as node, case when lv.hops is null or lv.hops > bl.u.h + 1 then bl.u.h else lv.hops end as h
    from pr left join lv on lv.source = pr.source and lv.node = pr.target left join (select source, min({'h': hops, 'n': node}) as u from (select source, node, hops from lv union all select distinct source, source, 0 from pr) z where node in (select caller from eg where type = 'unknown') group by source) bl on bl.source = pr.source where lv.hops is not null or bl.u is not null"""
    ends = ends.replace("select source, target, false", "select pr.source, pr.target, false")
    return f"""with recursive {EDGES}, {FUNCS}, {_PAIRS},
good as (select o_orderkey as seq, o_custkey::int as caller, ((o_orderkey * 13) % ((select count(*) from customer) + 5))::int as callee from orders join fn on fn.vid = o_custkey where not is_decl and not is_intrinsic and o_orderkey % 64 = 7 and (o_orderkey * 13) % ((select count(*) from customer) + 5) < (select count(*) from customer)),
eg as (select type, caller, callsite, callee from edges union all select 'indirect', caller, null, callee from good),
lv(source, node, hops, via) using key (source, node) as (
  select p.source, callee, 1, caller from (select distinct source from pr) p join eg on caller = p.source where callee is not null group by all
  union
  (select l.source, e.callee, min(l.hops) + 1, min(e.caller) from lv l join eg e on e.caller = l.node where e.callee is not null and not exists (select 1 from recurring.lv q where q.source = l.source and q.node = e.callee) group by l.source, e.callee)),
en as ({ends}),
pt(source, target, node, h) as (select source, target, node, h from en where h > 0 union all select pt.source, pt.target, lv.via, pt.h - 1 from pt join lv on lv.source = pt.source and lv.node = pt.node where pt.h > 1),
fe as (select caller, callee, arg_min(type, coalesce(callsite, 1e12)) as type, min(callsite) as callsite from eg group by caller, callee)
select pt.source, pt.target, pt.h::int as hop, fe.type, fe.caller, fe.callsite, fe.callee from pt join lv on lv.source = pt.source and lv.node = pt.node join fe on fe.caller = lv.via and fe.callee = pt.node
union all select en.source, en.target, (h + 1)::int, fe.type, fe.caller, fe.callsite, fe.callee from en join fe on fe.caller = en.node and fe.callee is null where blind"""


def _with_some_patches(spark, d):
    """The edges and those of every 64th patch."""
    good, _ = callgraph.patch_edges(X.patches(spark, d).where("seq % 64 = 7"), _index(spark, d))
    return callgraph.with_patches(X.call_edges(spark, d), good, X.functions(spark, d)).select(*callgraph.EDGE)


@query(_paths_sql(False))
def q_reach_path(spark, d):
    """Of every hundredth function, the shortest call path to eight others, over patched edges too; unknown edges lead anywhere."""
    return callgraph.paths(_with_some_patches(spark, d), _pairs(spark, d))


@query(_paths_sql(True))
def q_reach_path_known(spark, d):
    """The same over known edges alone."""
    return callgraph.paths(_with_some_patches(spark, d), _pairs(spark, d), ignore_unknown=True)


@query(f"with recursive {EDGES}, t as (select caller as root, caller, callee, 1 as depth from edges where caller % 100 = 0 union select t.root, e.caller, e.callee, t.depth + 1 from t join edges e on e.caller = t.callee where t.depth < 5), m as (select root, caller, callee, min(depth)::int as depth from t group by root, caller, callee) select * from m")
def q_call_tree_depth(spark, d):
    return callgraph.call_tree(X.call_edges(spark, d), X.functions(spark, d).where("vid % 100 = 0").select("vid"), 5)


@query()
def q_call_tree_silenced(spark, d):
    quiet = X.functions(spark, d).where(names.silenced(F.col("demangled"))).select("vid")
    return callgraph.call_tree(X.call_edges(spark, d), X.functions(spark, d).where("vid % 100 = 0").select("vid"), 5, quiet)


@query(f"with {_BUILT} select callsite, count(*) as n_targets, string_agg(name, ',' order by name) as targets from built join fn on fn.vid = callee where type = 'indirect' group by callsite")
def q_indirect_targets(spark, d):
    return callgraph.indirect_targets(_built(spark, d), X.functions(spark, d).select("vid", "name"))


@query(f"with {_BUILT} select count(*) filter (where type = 'direct') as n_direct, count(*) filter (where type = 'indirect') as n_indirect, count(*) filter (where type = 'unknown') as n_unknown, count(distinct callsite) as n_sites, count(distinct caller) as n_callers, count(distinct callee) as n_callees from built")
def q_indirect_stats(spark, d):
    return callgraph.statistics(_built(spark, d))


# ---- points-to -----------------------------------------------------------------------------------------------------


@query(f"with recursive {CONS}, cp(v, o) as (select dst, src from cn where op = 'ADDR' union select cn.dst, cp.o from cp join cn on cn.op = 'COPY' and cn.src = cp.v) select v as ptr, o as site from cp")
def q_pts_copy(spark, d):
    return pointsto.copy_closure(X.constraints(spark, d))


@query(f"with {PTS} select ptr, site from pts")
def q_pts_andersen(spark, d):
    return pointsto.inclusion(X.constraints(spark, d))


@query(f"with {PTS} select ptr, site from pts")
def q_pts_waves(spark, d):
    """Inclusion with the cycles of copies joined between waves: the sets of ``q_pts_andersen``."""
    return cycles.inclusion(X.constraints(spark, d))


@query(f"""with recursive {CONS}, cp as (select distinct dst, src from cn where op = 'COPY' and dst <> src), r(a, b) as (select src, dst from cp union select r.a, cp.dst from r join cp on cp.src = r.b)
select x.a as node, least(x.a, min(x.b)) as component from r x join r y on y.a = x.b and y.b = x.a where x.a <> x.b group by x.a""")
def q_copy_cycles(spark, d):
    """The variables on cycles of copies, and the smallest of each cycle."""
    return cycles.strong_components(X.constraints(spark, d).where("op = 'COPY'"))


_UNIFY = f"""recursive {CONS}, tm as (select distinct n * 3::bigint + k as t from (select dst as n from cn union all select src from cn), range(3) r(k)),
lk0 as (select dst * 3::bigint + case op when 'STORE' then 2 else 1 end as x, src * 3::bigint + case op when 'ADDR' then 0 when 'LOAD' then 2 else 1 end as y from cn),
lk as (select x, y from lk0 union select y, x from lk0),
lab(t, l) using key (t) as (
  select t, t as l from tm
  union
  (select n.t, n.l from (select t, min(l) as l from (
      select lk.x as t, r.l from lk join recurring.lab r on r.t = lk.y
      union all
      select a.t + 1 as t, m.l from recurring.lab a join (select b.l as c, min(e.l) as l from recurring.lab b join recurring.lab e on e.t = b.t + 1 where ((b.t % 3) + 3) % 3 < 2 group by b.l) m on m.c = a.l where ((a.t % 3) + 3) % 3 < 2) group by t) n
   join recurring.lab c on c.t = n.t where n.l < c.l))"""


@query(f"with {_UNIFY} select floor(t / 3.0)::int as node, (((t % 3) + 3) % 3)::int as level, l as label from lab")
def q_pts_steensgaard(spark, d):
    return pointsto.unification(X.constraints(spark, d))


@query(f"with {_UNIFY}, tl as (select floor(t / 3.0)::int as node, (((t % 3) + 3) % 3)::int as level, l as label from lab) select a.node as ptr, b.node as site from tl a join tl b using (label) where a.level = 1 and a.node >= 0 and b.level = 0 and b.node < 0")
def q_pts_from_alias(spark, d):
    return pointsto.unification_pts(pointsto.unification(X.constraints(spark, d)))


@query(f"with {FUNCS}, {SITES}, j as (select callsite, cs.layer as want, fn.vid as callee, fn.layer as have from cs join fn using (signature) where kind = 'indirect' and is_taken), e as (select callsite, bool_or(coalesce(want = have, false)) as exact from j group by callsite) select callsite, callee from j join e using (callsite) where not exact or want = have")
def q_pts_typebased(spark, d):
    return pointsto.type_based(X.call_sites(spark, d), X.functions(spark, d))


@query(f"with {PTS}, {PTRS} select ptr, known, case when known then count(site) end as n_sites, case when known then coalesce(list_sort(list(distinct site) filter (where site is not null)), []) end as sites from ptrs left join pts using (ptr) group by ptr, known")
def q_pts_of(spark, d):
    s = _status(spark, d)
    return pointsto.pts_of(s.select("ptr"), _pts(spark, d), s)


@query(f"with {PTS}, {PTRS}, q as (select ptr, -1 - ((ptr // 40) * 5 + ptr * 7 % 5)::int as site from ptrs) select ptr, site, case when not known or exists (select 1 from pts where pts.ptr = q.ptr and pts.site = q.site) then 'May' else 'No' end as result from q join ptrs using (ptr)")
def q_pt_modality(spark, d):
    s = _status(spark, d)
    return pointsto.pt(s.selectExpr("ptr", "int(-1 - ((ptr div 40) * 5 + ptr * 7 % 5)) as site"), _pts(spark, d), s)


_ALIAS = "q as (select distinct least(a.ptr, b.ptr) as a, greatest(a.ptr, b.ptr) as b from ptrs a join ptrs b on b.ptr = (a.ptr // 40) * 40 + (a.ptr * 13 + 5) % 40)"


def _asked(spark, d):
    s = _status(spark, d)
    return s.selectExpr("ptr as a", "int((ptr div 40) * 40 + (ptr * 13 + 5) % 40) as b").join(s.select(F.col("ptr").alias("b")), "b").select("a", "b")


@query(f"with {PTS}, {PTRS}, {_ALIAS} select q.a, q.b, case when not x.known or not y.known or exists (select 1 from pts p join pts r on p.site = r.site where p.ptr = q.a and r.ptr = q.b) then 'May' else 'No' end as result from q join ptrs x on x.ptr = q.a join ptrs y on y.ptr = q.b")
def q_alias_pairs(spark, d):
    return pointsto.alias(_asked(spark, d), _pts(spark, d), _status(spark, d))


@query(f"with {PTS} select distinct p.ptr, r.ptr as other from pts p join pts r on p.site = r.site and p.ptr <> r.ptr where p.ptr >= 0 and p.ptr % 100 = 0")
def q_alias_set(spark, d):
    return pointsto.alias_set(_status(spark, d).where("ptr % 100 = 0").select("ptr"), _pts(spark, d))


_FIELDS = "fo as (select distinct site as base, site - 1 as field from pts where site % 2 = 0)"


@query(f"with {PTS}, {_FIELDS} select ptr, site from pts union select ptr, field from pts join fo on fo.base = pts.site")
def q_alias_field_expand(spark, d):
    p = _pts(spark, d)
    return pointsto.expand_fields(p, p.where("site % 2 = 0").selectExpr("site as base", "site - 1 as field").distinct())


@query(f"with {PTS}, {PTRS}, s as (select ptr, known, count(site) as n from ptrs left join pts using (ptr) group by ptr, known) select count(*) as n_pointers, count(*) filter (where not known) as n_unknown, count(*) filter (where known and n = 0) as n_empty, max(n) as largest, sum(n)::bigint as n_facts from s")
def q_crash_sweep(spark, d):
    return pointsto.sweep(_pts(spark, d), _status(spark, d))


@query(f"""with {PTS}, {PTRS}, {EDGES}, {INDEX}, qs as (select o_orderkey as qid, o_orderkey % 5 as k, o_custkey as x, (o_custkey * 7) % 400 as y from orders where o_orderkey % 100 = 0)
select qid, type || ' TO ' || case when type = 'unknown' then 'UNKNOWN' else callee::varchar end || ' BY ' || callsite as line from qs join edges on caller = x where k = 0
union all select qid, case when not coalesce(known, false) then 'unknown' else site::varchar end from qs left join ptrs on ptrs.ptr = x left join pts on pts.ptr = x and known where k = 1 and (not coalesce(known, false) or site is not null)
union all select qid, case when not coalesce(known, false) or exists (select 1 from pts where pts.ptr = x and pts.site = -y) then 'May' else 'No' end from qs left join ptrs on ptrs.ptr = x where k = 2
union all select qid, vid || ' ' || min(name) from qs join ix on starts_with(name, 'f_' || x) where k = 3 group by qid, vid
union all select qid, 'syntax: unknown command jump' from qs where k = 4""")
def q_command_batch(spark, d):
    q = "case o_orderkey % 5 when 0 then concat('callout ', o_custkey) when 1 then concat(' pts  ', o_custkey) when 2 then concat('pt ', o_custkey, ' -', (o_custkey * 7) % 400) when 3 then concat('l @f_', o_custkey) else 'jump 1' end"
    lines = X.table(spark, d, "orders").where("o_orderkey % 100 = 0").selectExpr("o_orderkey as qid", f"{q} as line")
    return commands.answer(lines, X.call_edges(spark, d), _pts(spark, d), _status(spark, d), _index(spark, d))


# ---- calls by layers -----------------------------------------------------------------------------------------------


def _layer_sql(seed: str, n: str, turn: str) -> str:
    """A path as numbers type * 3 + field."""
    s = f"({seed} + case when i >= {turn} then 1 else 0 end)"
    return f"[(signature * {X.TYPES} + ({s} + i * i) % {X.TYPES}) * 3 + {s} * (i + 1) % 3 for i in range(10) if i < {n}]"


_LAYERS = f"""recursive {FUNCS}, {SITES}, cv as (select distinct s_suppkey % {8 * X.TYPES} as type, case when s_suppkey % 9 <> 8 then s_suppkey * 5 % {8 * X.TYPES} end as into_ from supplier where s_suppkey % 5 = 3),
lost(type) as (select type from cv where into_ is null union select cv.type from lost join cv on cv.into_ = lost.type), lostlist as (select coalesce(list(type), []) as ts from lost),
ac as (select callsite as id, signature, {_layer_sql("callsite % 6", "(callsite // 8) % 11", "10")} as p from cs where kind = 'indirect'),
af as (select vid as id, signature, {_layer_sql("vid % 6", "vid % 11", "vid % 13")} as p from fn where is_taken),
cut0 as (select true as call, * from ac union all select false, * from af), cut1 as (select call, id, signature, p, list_position([list_contains(ts, x // 3) for x in p], true) as e from cut0, lostlist),
cut2 as (select call, id, signature, case when e > 0 then p[1:e - 1] else p end as p, coalesce(e > 0, false) as ended from cut1),
st as (select id, signature, ended, p, p[1:k] as pre, k from cut2, range(11) r(k) where not call and k <= len(p)),
dec as (select c.id, c.signature, c.p, coalesce(max(st.k), 0) as depth from cut2 c left join st on st.signature = c.signature and st.k <= len(c.p) and c.p[1:st.k] = st.pre where c.call group by c.id, c.signature, c.p),
cls as (select id, depth, min(id) over (partition by signature, p[1:depth]) as class, signature, p[1:depth] as pre from dec),
mem as (select distinct class, st.id as callee from (select distinct class, signature, pre, depth from cls) c join st on st.signature = c.signature and ((st.k = depth and st.pre = c.pre) or (st.ended and st.k = len(st.p) and st.k <= depth and c.pre[1:st.k] = st.pre)))"""


def _layers(spark, d):
    conversions = X.layer_conversions(spark, d)
    lost = layers.escaping(conversions.where("to is null").select("type"), conversions.where("to is not null"))
    return layers.classes(X.layer_calls(spark, d), X.layer_stores(spark, d), lost)


@query(f"with {_LAYERS} select id as callsite, class, depth::int as depth from cls")
def q_layer_calls(spark, d):
    """The class and depth that decide each indirect call, of up to ten layers."""
    return _layers(spark, d)[0]


@query(f"with {_LAYERS} select class, callee from mem")
def q_layer_targets(spark, d):
    return _layers(spark, d)[1]


@query(f"with {_LAYERS}, n as (select class, count(*) as n from mem group by class) select depth::int as depth, count(*) as n_calls, count(*) filter (where n is null) as n_without, sum(coalesce(n, 0))::bigint as n_targets, max(coalesce(n, 0)) as largest from cls left join n using (class) group by depth")
def q_layer_figures(spark, d):
    return layers.figures(*_layers(spark, d))


# ---- fields --------------------------------------------------------------------------------------------------------

_FIELD_CONS = """c0 as (select case (l_orderkey + l_linenumber * 3) % 10 when 0 then 'ADDR' when 1 then 'ADDR' when 2 then 'LOAD' when 3 then 'STORE' when 4 then 'LOAD' when 5 then 'GEP' when 6 then 'GEP' else 'COPY' end op,
  l_orderkey * 3 + l_linenumber % 3 dst, l_partkey * 13 + l_suppkey * 7 h, l_suppkey, l_partkey from lineitem),
fc as (select distinct op, dst::bigint as dst, (case when op = 'ADDR' then case when l_partkey % 500 = 7 then 0 else -1 - ((dst // 120) * 15 + l_suppkey % 15) end else (dst // 120) * 120 + h % 120 end)::bigint as src, case when op = 'GEP' and l_suppkey % 11 <> 0 then (l_partkey % 3)::int end as off from c0)"""
#: A node is (v, vf): a variable with vf 0, or a site and one of its fields. Unknown memory is site 0, written as variable -1000000000.
_FIELD_PTS = "recursive " + _FIELD_CONS + """, hole as (select -1000000000::bigint as z), fo as (select op, dst, case when op = 'ADDR' and src = 0 then z else src end as src, off from fc, hole),
sol(v, vf, o, f, n) using key (v, vf, o, f) as (
  (select dst, 0, src, 0, 0 from fo where op = 'ADDR' union select z, 0, z, 0, 0 from hole)
  union
  (select x.v, x.vf, x.o, x.f, 1 from (
     select c.dst v, 0 vf, p.o, p.f from recurring.sol p join fo c on c.op = 'COPY' and c.src = p.v
     union select c.dst, 0, p2.o, p2.f from recurring.sol p join fo c on c.op = 'LOAD' and c.src = p.v join recurring.sol p2 on p2.v = p.o and (p2.vf = p.f or p2.vf = -1 or p.f = -1)
     union select p.o, p.f, p2.o, p2.f from recurring.sol p join fo c on c.op = 'STORE' and c.dst = p.v join recurring.sol p2 on p2.v = c.src
     union select c.dst, 0, p.o, case when p.o = z then 0 when off is null or p.f = -1 or p.f + off > (-p.o) % 4 then -1 else p.f + off end from recurring.sol p join fo c on c.op = 'GEP' and c.src = p.v, hole) x
   where not exists (select 1 from recurring.sol q where q.v = x.v and q.vf = x.vf and q.o = x.o and q.f = x.f)))"""


def _field_pts(spark: SparkSession, d: str) -> DataFrame:
    return build_once(spark, ("fields", d), lambda: fields.inclusion(X.field_constraints(spark, d), X.object_sizes(spark, d)), d)


@query(f"with {_FIELD_PTS} select case when v >= 0 then v end as ptr, case when v < 0 then case when v = z then 0 else v end end as base, case when v < 0 then vf::int end as base_field, case when o = z then 0 else o end as site, f::int as field from sol, hole")
def q_pts_fields(spark, d):
    """Field-sensitive inclusion: what pointers and fields of objects point to, objects' fields being found while solving."""
    return _field_pts(spark, d)


@query(f"""with {_FIELD_PTS}, pp as (select distinct n as ptr, n % 97 <> 5 as known from (select dst as n from fc union all select src from fc where op <> 'ADDR')),
q as (select distinct least(a.ptr, b.ptr) as a, greatest(a.ptr, b.ptr) as b from pp a join pp b on b.ptr = (a.ptr // 120) * 120 + (a.ptr * 13 + 5) % 120), lost as (select ptr from pp where not known union select v from sol, hole where o = z)
select a, b, case when a in (select ptr from lost) or b in (select ptr from lost) or exists (select 1 from sol x join sol y on x.o = y.o and (x.f = y.f or x.f = -1 or y.f = -1) where x.v = q.a and y.v = q.b) then 'May' else 'No' end as result from q""")
def q_alias_fields(spark, d):
    """Aliases by shared fields of objects, with memory that nothing is known of."""
    c = X.field_constraints(spark, d)
    status = c.selectExpr("bigint(dst) as ptr").unionByName(c.where("op <> 'ADDR'").selectExpr("bigint(src) as ptr")).distinct().withColumn("known", F.expr("ptr % 97 <> 5"))
    pairs = status.selectExpr("ptr as a", "(ptr div 120) * 120 + (ptr * 13 + 5) % 120 as b").join(status.select(F.col("ptr").alias("b")), "b").select("a", "b")
    return fields.alias(pairs, _field_pts(spark, d), status)


# ---- flow ----------------------------------------------------------------------------------------------------------


@query()
def q_pts_flow(spark, d):
    """What variables point to, and what objects hold after each store, with stores that overwrite."""
    return flow.solve(X.flow_statements(spark, d), X.flow_edges(spark, d), X.flow_singles(spark, d))


_DYCK = f"""with recursive {_FIELD_CONS}, dc as (select op, dst, case when op = 'ADDR' and src = 0 then -1000000000 else src end as src, off from fc),
ed as (select distinct case when op = 'LOAD' then src else dst end as s, 0 as k, case when op = 'LOAD' then dst else src end as d from dc where op in ('ADDR', 'LOAD', 'STORE') union select src, off, dst from dc where op = 'GEP' and off <> 0),
eq0 as (select dst as x, src as y from dc where op = 'COPY' or op = 'GEP' and coalesce(off, 0) = 0), eq as (select x, y from eq0 union select y, x from eq0),
tm as (select s as t from ed union select d from ed union select x from eq),
lab(t, l) using key (t) as (
  select t, t as l from tm
  union
  (select n.t, n.l from (select t, min(l) as l from (
      select eq.x as t, r.l from eq join recurring.lab r on r.t = eq.y
      union all
      select ed.d, m.l from ed join recurring.lab a on a.t = ed.s join (select b.l as c, e.k, min(x.l) as l from ed e join recurring.lab b on b.t = e.s join recurring.lab x on x.t = e.d group by b.l, e.k) m on m.c = a.l and m.k = ed.k) group by t) n
   join recurring.lab c on c.t = n.t where n.l < c.l))
select t as node, l as class from lab"""


@query(_DYCK)
def q_alias_dyck(spark, d):
    """Classes of variables and objects by paths of dereferences and fields of any depth."""
    c = X.field_constraints(spark, d).withColumn("src", F.expr("if(op = 'ADDR' and src = 0, -1000000000, src)"))
    return dyck.closure(*dyck.of_constraints(c))


# ---- traces --------------------------------------------------------------------------------------------------------


@query(f"with {HITS} select * from hits")
def q_trace_batch(spark, d):
    return replay.replay_batch(X.trace(spark, d))


@query(f"with {HITS} select ptr, list_sort(list(distinct site)) as sites from hits group by ptr")
def q_observed_pts(spark, d):
    return replay.observed(replay.replay_batch(X.trace(spark, d)))


@query()
def q_trace_context(spark, d):
    return replay.replay_scoped(X.scoped_trace(spark, d), 2)


@query(f"with {HITS} select stream_id, seq, ptr, site, []::int[] as ctx from hits")
def q_trace_stateful(spark, d):
    return replay.replay_scoped(X.trace(spark, d), 2)


@query(f"with {HITS} select stream_id, seq, ptr, site, []::int[] as ctx from hits")
def q_trace_stream(spark, d):
    """The same by Structured Streaming: events as a file stream, a stream's state kept between batches."""
    out = f"{shared_dir(spark).rstrip('/')}/replayed-{uuid.uuid4().hex}"
    # a glob, as a file source takes directories and globs
    events = spark.readStream.schema(X.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    hits = replay.replay_stream(X.trace_of(events), 2)
    hits.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(replay.HITS).parquet(out)


@query(f"with {HITS}, t as (select k.vid as site, count(*) as n from tr k where k.action < 2 group by k.vid) select count(*) as n_hits, count(distinct ptr) as n_pointers, count(distinct hits.site) as n_sites, count(*) filter (where t.site is null) as n_unallocated from hits left join t on t.site = hits.site")
def q_observed_vs_static(spark, d):
    """Every site observed is one that was allocated."""
    t = X.trace(spark, d)
    made = t.where("action in (0, 1)").select(F.col("vid").alias("site"), F.lit(True).alias("made")).distinct()
    own = replay.replay_batch(t).join(made, "site", "left")
    return own.agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("ptr").alias("n_pointers"), F.countDistinct("site").alias("n_sites"), F.count_if(F.col("made").isNull()).alias("n_unallocated"))


# ---- notes and sources ---------------------------------------------------------------------------------------------

_NOTES = "nt as (select url as path, 'f_' || page_id as heading, (page_id % 3)::int as ord, html as text from pages)"


def _more(spark, d):
    return X.notes(spark, d).where("ord = 1").selectExpr("path", "heading", "concat('more on ', heading) as text")


@query(f"with {_NOTES} select * from nt union all select path, heading, 2::int, 'more on ' || heading from nt where ord = 1")
def q_notes_append(spark, d):
    return notes.append(X.notes(spark, d), _more(spark, d))


@query(f"with {_NOTES} select path, case when ord = 2 then 'none' else heading end as heading, case when ord = 2 then null else text end as body from nt")
def q_notes_view(spark, d):
    n = X.notes(spark, d)
    return notes.view(n, n.selectExpr("path", "if(ord = 2, 'none', heading) as heading"))


@query(f"with {_NOTES} select * from nt where ord <> 0")
def q_notes_delete(spark, d):
    n = X.notes(spark, d)
    return notes.delete(n, n.where("ord = 0").select("path", "heading"))


@query("""with n as (select page_id as k, url as path, 'f_' || page_id as heading, (page_id % 3)::int as ord, html as text from pages)
select path, heading, ord, text from n where k % 5 <> 0 union all select path, heading, ord + 1, 'seen ' || k from n where k % 3 = 0 and k % 5 <> 0""")
def q_notes_commit(spark, d):
    """All notes put into a table, then lines added by a second commit and notes deleted by a third."""
    every, pages = X.notes(spark, d), X.table(spark, d, "pages").selectExpr("page_id as k", "url as path", "concat('f_', page_id) as heading")
    with removed_after(spark, f"{shared_dir(spark).rstrip('/')}/notes-{uuid.uuid4().hex}") as store:
        note_store.commit(store, every.select("path"), every)
        some = pages.where("k % 3 = 0")
        own = note_store.read(spark, store).join(some.select("path").distinct(), "path", "left_semi")
        note_store.commit(store, some.select("path"), notes.append(own, some.selectExpr("path", "heading", "concat('seen ', k) as text")))
        gone = pages.where("k % 5 = 0")
        own = note_store.read(spark, store).join(gone.select("path").distinct(), "path", "left_semi")
        note_store.commit(store, gone.select("path"), notes.delete(own, gone.select("path", "heading")))
        return cut(note_store.read(spark, store))


@query("with l as (select source || '/' || doc_id as path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as x from documents) select path, i as line_no, x[i] as line from l, unnest(range(1, len(x) + 1)) t(i)")
def q_source_lines(spark, d):
    return files.split_lines(X.source_texts(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))


# ---- textual IR ----------------------------------------------------------------------------------------------------

_IR = """cu as (select 'm' || c_nationkey || '.ll' as path, c_custkey::bigint as k from customer),
it as (select path, 0 as s, k, 2 as sub, 'GlobalVar' as kind, 'g_' || k as name, null as func, null as opcode, k % 8 <> 0 as is_ptr, false as is_decl from cu where k % 4 = 0
  union all select path, 0, min(k), i, 'Struct', case i when 0 then 'struct.Pair' else 'struct.Inner' end, null, null, false, false from cu, range(2) r(i) where k % 8 = 0 group by path, i
  union all select path, 1, k, 0, 'Func', 'f_' || k, null, null, false, k % 17 = 3 from cu
  union all select path, 1, k, i, case when i < 3 then 'Arg' when i = 3 then 'Block' else 'Inst' end, case when k % 17 = 3 then null when i = 1 then '%a' when i = 2 then '%b' when i = 4 then '%p' end, 'f_' || k,
    case i when 4 then 'load' when 5 then 'ret' end, i in (1, 4), false from cu, range(1, 6) r(i) where k % 17 <> 3 or i = 1),
vals as (select path, (row_number() over (partition by path order by s, k, sub) - 1)::int as vid, kind, name, func, opcode, is_ptr, is_decl from it)"""


def _module_values(spark, d):
    lines = files.in_functions(X.module_lines(spark, d))
    return lines, ir.values(lines)


@query(f"with {_IR} select * from vals")
def q_ir_values(spark, d):
    """Identifiers of the values of every module, read from its text."""
    return _module_values(spark, d)[1]


@query(f"""with {_IR} select path, '' as moduleID, path as sourceFileName, '' as targetTriple, '' as dataLayout, '' as llvmIdent, '' as clangVersion, '' as optlevel, '' as commandline, '' as llvmModuleDeps,
  count(*) filter (where kind = 'Func') as funcCnt, count(*) filter (where kind = 'GlobalVar') as globalCnt, count(*) filter (where kind = 'Struct') as idStructTypeCnt, count(*) filter (where kind in ('Arg', 'Inst')) as localCnt,
  count(*) filter (where kind = 'GlobalVar' and is_ptr) as globalPtrCnt, count(*) filter (where kind = 'Arg' and is_ptr) as argPtrCnt, count(*) filter (where kind = 'Inst' and is_ptr) as instPtrCnt,
  0 as hasMain, 0 as hasGlobalCtor, 0 as hasGlobalDtor from vals group by path""")
def q_ir_stat(spark, d):
    return ir.statistics(*_module_values(spark, d))


from factloom.plans import programs  # noqa: E402, F401  registers its own
