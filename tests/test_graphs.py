"""Call graphs, points-to solvers and traces: small programs by hand, and brute force on random ones."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import render
from factloom.operators import callgraph, commands, contexts, lineage, pointsto
from factloom.streaming import replay


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("direct", 1, 10, 2), ("indirect", 1, 11, 3), ("direct", 1, 12, 2), ("direct", 2, 20, 4), ("direct", 4, 40, 1), ("unknown", 3, 30, None), ("direct", 5, 50, 5), ("indirect", 1, None, 6)]
    return spark.createDataFrame(rows, schemas.CALL_EDGE)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edges_of_call_sites(spark):
    sites = spark.createDataFrame([(10, 1, "direct", 2), (11, 1, "indirect", 0), (12, 1, "indirect", 0), (13, 1, "indirect", 0), (14, 1, "direct", 9)], schemas.CALL_SITE)
    functions = spark.createDataFrame([(1, False), (2, False), (3, False), (9, True)], "vid int, is_intrinsic boolean")
    targets = spark.createDataFrame([(11, 2), (11, 3), (11, 77), (11, 9)], schemas.PTS)
    status = spark.createDataFrame([(11, True), (12, True), (13, False)], schemas.PTS_STATUS)
    assert rows_of(callgraph.build_edges(sites, functions, targets, status)) == [("direct", 1, 10, 2), ("indirect", 1, 11, 2), ("indirect", 1, 11, 3), ("unknown", 1, 13, None)]


def test_neighbours(spark, edges):
    assert rows_of(callgraph.first_of_pairs(edges).where("caller = 1")) == [("direct", 1, 10, 2), ("indirect", 1, 11, 3), ("indirect", 1, None, 6)]
    got = callgraph.callin(edges, spark.createDataFrame([(2,)], "callee int"))
    assert rows_of(got) == [("known", "direct", 1, 10, 2), ("known", "direct", 1, 12, 2), ("unknown", "unknown", 3, 30, None)]
    lines = [r[0] for r in callgraph.in_order(edges).where("caller = 1").orderBy("place").select(render.edge_text()).collect()]
    assert lines == ["direct FROM 1 TO 2 BY 10", "indirect FROM 1 TO 3 BY 11", "direct FROM 1 TO 2 BY 12", "indirect FROM 1 TO 6 BY -"]


def test_patched_edges_come_last_and_need_a_body(spark, edges):
    functions = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, False)], "vid int, is_decl boolean, is_intrinsic boolean")
    patched = spark.createDataFrame([(9, "indirect", 1, None, 2), (4, "indirect", 1, None, 5), (1, "indirect", 2, None, 1)], "seq long, type string, caller int, callsite int, callee int")
    got = callgraph.with_patches(edges.where("caller in (1, 2) and callsite is not null"), patched, functions)
    assert [tuple(r) for r in got.orderBy("caller", "place").select("caller", "callsite", "callee", "place").collect()] == [
        (1, 10, 2, 1), (1, 11, 3, 2), (1, 12, 2, 3), (1, None, 5, 4), (1, None, 2, 5), (2, 20, 4, 1),
    ]
    quiet = spark.createDataFrame([(2,), (6,)], "vid int")
    assert rows_of(callgraph.without_silenced(edges.where("caller in (1, 3)"), quiet)) == [("indirect", 1, 11, 3), ("unknown", 3, 30, None)]


def test_reachability(spark, edges):
    pairs = spark.createDataFrame([(1, 4), (4, 3), (1, 1), (2, 5), (6, 1), (5, 5), (3, 99), (6, 6)], "source int, target int")
    known = {(r[0], r[1]): r[2] for r in callgraph.reachable(edges, pairs, ignore_unknown=True).collect()}
    assert known == {(1, 4): True, (4, 3): True, (1, 1): True, (2, 5): False, (6, 1): False, (5, 5): True, (3, 99): False, (6, 6): False}
    blind = {(r[0], r[1]): r[2] for r in callgraph.reachable(edges, pairs).collect()}
    assert blind[(3, 99)] and blind[(2, 5)] and not blind[(6, 1)]
    assert [tuple(r) for r in callgraph.path(edges, 1, 4).orderBy("hop").collect()] == [(1, "direct", 1, 10, 2), (2, "direct", 2, 20, 4)]
    assert callgraph.path(edges, 6, 1).count() == 0 and callgraph.path(edges, 5, 5).count() == 1 and callgraph.path(edges, 6, 6).count() == 0


def test_reach_set_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (75, 2))} | {(k, k + 1) for k in range(60, 85)}
    got = callgraph.reach_set(spark.createDataFrame([("direct", a, 0, b) for a, b in pairs], schemas.CALL_EDGE), spark.createDataFrame([(k,) for k in (0, 1, 2, 60)], "vid int"), hops_a_round=3)
    want = set()
    for s in (0, 1, 2, 60):
        seen, todo, hop = {}, {s}, 0
        while todo:
            hop += 1
            todo = {b for a, b in pairs if a in todo} - set(seen)
            seen |= dict.fromkeys(todo, hop)
        want |= {(s, n, h) for n, h in seen.items()}
    assert {tuple(r) for r in got.select("source", "node", "hops").collect()} == want


def test_call_tree(spark, edges):
    roots = spark.createDataFrame([(1,)], "vid int")
    assert rows_of(callgraph.call_tree(edges, roots, 1)) == [(1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 6, 1)]
    whole = callgraph.call_tree(edges, roots, 5)
    assert rows_of(whole) == [(1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 6, 1), (1, 2, 4, 2), (1, 3, None, 2), (1, 4, 1, 3)]
    assert render.tree_lines(whole, 1) == ["1", "├ 2", "│ └ 4", "│   └ 1 (recursive)", "├ 3", "│ └ call to UNKNOWN", "└ 6"]
    quiet = callgraph.call_tree(edges, roots, 1, spark.createDataFrame([(2,)], "vid int"))
    assert rows_of(quiet) == [(1, 1, 3, 1), (1, 1, 4, 1), (1, 1, 6, 1)]


def test_patches(spark):
    index = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 3, True), ("c", 4, True)], schemas.NAME_INDEX)
    good, bad = callgraph.patch_edges(spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, "c", "a"), (4, "b", None)], schemas.CG_PATCH), index)
    assert rows_of(good) == [(1, "indirect", 1, None, 2)] and {r["seq"] for r in bad.collect()} == {2, 3, 4}


# ---- points-to


def andersen(cons):
    pts = defaultdict(set)
    while True:
        before = sum(map(len, pts.values()))
        for op, d, s in cons:
            if op == "ADDR":
                pts[d].add(s)
            elif op == "COPY":
                pts[d] |= pts[s]
            elif op == "LOAD":
                for o in list(pts[s]):
                    pts[d] |= pts[o]
            else:
                for o in list(pts[d]):
                    pts[o] |= pts[s]
        if sum(map(len, pts.values())) == before:
            return {(v, o) for v, os in pts.items() for o in os}


def random_constraints(seed, n=40):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(n):
        op = str(rng.choice(["ADDR", "ADDR", "COPY", "COPY", "LOAD", "STORE"]))
        out.add((op, int(rng.integers(0, 20)), -1 - int(rng.integers(0, 6)) if op == "ADDR" else int(rng.integers(0, 20))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_solvers_on_random_programs(spark, seed):
    cons = random_constraints(seed)
    df = spark.createDataFrame(cons, schemas.CONSTRAINT)
    found = {tuple(r) for r in pointsto.inclusion(df).collect()}
    assert found == andersen(cons)
    classes = {(r["node"], r["level"]): r["label"] for r in pointsto.unification(df).collect()}
    # closed under every constraint, and at least as large as inclusion
    pairs = {"ADDR": (1, 0), "COPY": (1, 1), "LOAD": (1, 2), "STORE": (2, 1)}
    assert all(classes[d, pairs[op][0]] == classes[s, pairs[op][1]] for op, d, s in cons)
    for (x, i), (y, j) in itertools.combinations(classes, 2):
        if classes[x, i] == classes[y, j] and i < 2 and j < 2:
            assert classes[x, i + 1] == classes[y, j + 1]
    wide = {tuple(r) for r in pointsto.unification_pts(pointsto.unification(df)).collect()}
    assert {(v, o) for v, o in found if v >= 0} <= wide


def test_three_levels_of_pointers(spark):
    a, b, c, d = 1, 2, 3, 4  # b = &a; c = &b; d = &c; x = *d; y = *x
    cons = spark.createDataFrame([("ADDR", b, -a), ("ADDR", c, -b), ("ADDR", d, -c), ("STORE", c, b), ("STORE", d, c), ("LOAD", 10, d), ("LOAD", 11, 10)], schemas.CONSTRAINT)
    got = {tuple(r) for r in pointsto.inclusion(cons).where("ptr >= 10").collect()}
    assert got == {(10, -2), (11, -1)}


def test_points_to_queries(spark):
    pts = spark.createDataFrame([(1, -1), (1, -2), (2, -2), (3, -3)], schemas.PTS)
    status = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], schemas.PTS_STATUS)
    ask = spark.createDataFrame([(1,), (4,), (5,), (9,)], "ptr int")
    assert rows_of(pointsto.pts_of(ask, pts, status)) == [(1, True, 2, [-2, -1]), (4, True, 0, []), (5, False, None, None), (9, False, None, None)]
    two = spark.createDataFrame([(1, -1), (1, -3), (4, -1), (5, -1)], "ptr int, site int")
    assert {(r[0], r[1]): r[2] for r in pointsto.pt(two, pts, status).collect()} == {(1, -1): "May", (1, -3): "No", (4, -1): "No", (5, -1): "May"}
    pairs = spark.createDataFrame([(2, 1), (1, 2), (1, 3), (1, 4), (5, 4), (4, 4)], "a int, b int")
    assert rows_of(pointsto.alias(pairs, pts, status)) == [(1, 2, "May"), (1, 3, "No"), (1, 4, "No"), (4, 4, "No"), (4, 5, "May")]
    assert rows_of(pointsto.alias_set(ask, pts)) == [(1, 2)]
    fields = spark.createDataFrame([(-3, -30), (-3, -31)], "base int, field int")
    assert {r[1] for r in pointsto.expand_fields(pts, fields).where("ptr = 3").collect()} == {-3, -30, -31}
    r = pointsto.sweep(pts, status).first()
    assert (r["n_pointers"], r["n_unknown"], r["n_empty"], r["largest"], r["n_facts"]) == (5, 1, 1, 2, 4)


def test_contexts_tell_calls_apart(spark):
    """id(x) returns x; main calls it twice with different addresses."""
    calls = spark.createDataFrame([(100, 1, 2), (200, 1, 2)], "callsite int, caller int, callee int")
    cons = spark.createDataFrame([("ADDR", 10, -1, 1), ("ADDR", 11, -2, 1), ("COPY", 21, 20, 2)], schemas.CONSTRAINT + ", func int")
    owners = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 1), (20, 2), (21, 2)], "var int, func int")
    passed = spark.createDataFrame([(100, 1, 2, 20, 10, False), (200, 1, 2, 20, 11, False), (100, 1, 2, 12, 21, True), (200, 1, 2, 13, 21, True)], "callsite int, caller int, callee int, dst int, src int, back boolean")
    want = {0: {("12", "-1"), ("12", "-2"), ("13", "-1"), ("13", "-2")}, 1: {("12", "-1"), ("13", "-2")}}
    for k in (0, 1):
        found = contexts.contexts(calls, spark.createDataFrame([(1,)], "func int"), k)
        assert found.count() == (2 if k == 0 else 3)
        pts = contexts.without_contexts(pointsto.inclusion(contexts.clone(cons, owners, passed, found, k)))
        assert {tuple(r) for r in pts.where("ptr in ('12', '13')").collect()} == want[k]


def test_origins_are_the_calls_that_spawn(spark):
    calls = spark.createDataFrame([(100, 1, 2, False), (200, 1, 2, True), (300, 2, 3, False)], "callsite int, caller int, callee int, push boolean")
    found = contexts.contexts(calls, spark.createDataFrame([(1,)], "func int"), 2)
    assert rows_of(found) == sorted([(1, []), (2, []), (2, [200]), (3, []), (3, [200])], key=repr)


def test_graph_texts(spark, edges):
    got = {r["caller"]: r["value"] for r in render.dot(edges.withColumn("from", F.col("caller")), "caller", "from", "callee").collect()}
    assert got[1] == 'digraph "1" {\n  "1" -> "2";\n  "1" -> "3";\n  "1" -> "6";\n}' and got[3] == 'digraph "3" {\n}'
    lines = spark.createDataFrame([(1, "b"), (1, "a")], "qid int, line string")
    assert render.framed(lines).first()["value"] == "<queryresult>\na\nb\n</queryresult>"


def test_calls_found_while_solving(spark):
    """p = &f; q = p(x) where f returns its parameter, which is &g; q() then calls g."""
    cons = spark.createDataFrame([("ADDR", 1, -100), ("ADDR", 2, -200), ("COPY", 11, 10)], schemas.CONSTRAINT)
    indirect = spark.createDataFrame([(7, 1, 2, 3), (8, 3, None, None)], "callsite int, operand int, arg int, result int")
    params = spark.createDataFrame([(-100, 50, 10, 11), (-200, 60, None, None)], "site int, callee int, param int, ret int")
    pts, targets = contexts.solve_with_calls(cons, indirect, params)
    assert rows_of(targets) == [(7, 50), (8, 60)] and (3, -200) in {tuple(r) for r in pts.collect()}


def test_batch_commands(spark, edges):
    pts = spark.createDataFrame([(1, -1), (2, -1)], schemas.PTS)
    status = spark.createDataFrame([(1, True), (2, True), (3, False)], schemas.PTS_STATUS)
    index = spark.createDataFrame([("main", 1, True), ("map", 2, True)], schemas.NAME_INDEX)
    asked = ["callout 1 i", "callin 4", "pts 1", "pts 3", "pt 1 -1", "a 2 1", "l @ma", "pts x", "pts", "jump 3", "  ", "callout 1 j"]
    got = defaultdict(set)
    for r in commands.answer(spark.createDataFrame(list(enumerate(asked)), "qid int, line string"), edges, pts, status, index).collect():
        got[r["qid"]].add(r["line"])
    assert got == {
        0: {"direct TO 2", "indirect TO 3", "indirect TO 6"}, 1: {"direct FROM 2 BY 20"}, 2: {"-1"}, 3: {"unknown"}, 4: {"May"}, 5: {"May"}, 6: {"1 main", "2 map"},
        7: {"syntax: not a number"}, 8: {"syntax: wrong number of arguments"}, 9: {"syntax: unknown command jump"}, 11: {"syntax: not a number"},
    }


# ---- traces


def test_scopes_and_landing(spark):
    A, H, P, B, E, L = 0, 1, 8, 16, 17, 18
    events = [(B, 1, 0, 0), (A, 5, 100, 8), (B, 2, 0, 0), (A, 6, 200, 8), (P, 50, 203, 0), (P, 51, 104, 0), (E, 0, 0, 0), (P, 52, 200, 0), (B, 3, 0, 0), (A, 7, 300, 8), (B, 4, 0, 0), (H, 8, 400, 8), (L, 1, 0, 0), (P, 53, 300, 0), (P, 54, 400, 0), (P, 55, 100, 0)]
    trace = spark.createDataFrame([(k, 1, v, a, p, s) for k, (a, v, p, s) in enumerate(events)], "seq long, stream_id long, vid int, action int, ptr long, size long")
    got = {(r["ptr"], r["site"], tuple(r["ctx"])) for r in replay.replay_scoped(trace, 2).collect()}
    assert got == {(50, 6, (1, 2)), (51, 5, (1, 2)), (54, 8, (1,)), (55, 5, (1,))}
    inner = {(r["ptr"], tuple(r["ctx"])) for r in replay.replay_scoped(trace, 1, innermost=True).collect()}
    assert (50, (2,)) in inner
    assert replay.dump_lines(replay.replay_scoped(trace, 2)).where("ptr = 50").first()["line"] == "50 6 [{ 1 2 }]"
    with pytest.raises(Exception, match="unknown action"):
        replay.replay_scoped(trace.withColumn("action", F.lit(5)), 1).collect()


def test_batch_replay_equals_stateful(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3000):
        a = int(rng.choice([0, 1, 2, 3, 8, 8, 8]))
        rows.append((k, int(rng.integers(0, 4)), k if a != 8 else int(rng.integers(0, 9)), a, int(rng.integers(0, 400)), int(rng.integers(1, 150))))
    trace = spark.createDataFrame(rows, "seq long, stream_id long, vid int, action int, ptr long, size long")
    want = rows_of(replay.replay_scoped(trace).select("stream_id", "seq", "ptr", "site"))
    assert rows_of(replay.replay_batch(trace)) == want and want
    assert rows_of(replay.replay_batch(trace, width=7)) == want


def test_stream_of_many_batches_equals_one(spark, tmp_path):
    rows = [(k, k % 3, k, k % 2 * 8, k % 40 * 4, 6) for k in range(400)]
    schema = "seq long, stream_id long, vid int, action int, ptr long, size long"
    for b in range(4):
        spark.createDataFrame(rows[b * 100 : b * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    replay.replay_stream(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    want = rows_of(replay.replay_scoped(spark.createDataFrame(rows, schema)))
    assert rows_of(spark.read.schema(replay.HITS).parquet(out)) == want


def test_built_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert lineage.build_once(spark, ("t", 1), make, str(tmp_path)).count() == 3
    lineage.forget(spark, "t")
    lineage.build_once(spark, ("t", 1), make, str(tmp_path))
    assert len(made) == 2
    # an input that was written anew is not answered from what was built before
    (tmp_path / "more.parquet").write_text("x")
    lineage.build_once(spark, ("t", 1), make, str(tmp_path))
    assert len(made) == 3


def shortest(edges, source, target, ignore):
    """The path by breadth-first search over levels, smallest caller first, from the end back."""
    level, hops = {source}, {}
    via, blind, depth = {}, None, 0
    callers = {}
    for t, c, _, e in edges:
        callers.setdefault(c, []).append((t, e))
    while level:
        unknown = [n for n in level if any(t == "unknown" for t, _ in callers.get(n, []))]
        nxt = {}
        for n in sorted(level):
            for t, e in callers.get(n, []):
                if t != "unknown" and e not in hops and e not in nxt:
                    nxt[e] = n
        depth += 1
        for e, n in nxt.items():
            hops[e], via[(e, depth)] = depth, n
        if target in nxt:
            end = (target, depth)
            break
        if unknown and not ignore:
            blind, end = min(unknown), (min(unknown), depth - 1)
            break
        level = set(nxt)
    else:
        return []
    out = []
    node, depth = end
    while depth > 0:
        out.append((depth, via[(node, depth)], node))
        node, depth = via[(node, depth)], depth - 1
    return sorted(out) + ([(end[1] + 1, blind, None)] if blind is not None else [])


@pytest.mark.parametrize("ignore", [False, True])
def test_paths_of_pairs_against_breadth_first_search(spark, ignore):
    rng = random.Random(17 + ignore)
    for n, m, unknown in ((12, 20, 2), (40, 55, 3), (60, 62, 0)):
        edges = [("direct" if rng.random() < 0.5 else "indirect", rng.randrange(n), None if rng.random() < 0.2 else 1000 + i, rng.randrange(n)) for i in range(m)]
        edges += [("direct", i, 500 + i, i + 1) for i in range(n, n + 37)] + [("direct", 3, 499, n)]  # a chain: many jumps
        edges += [("unknown", rng.randrange(n), 2000 + i, None) for i in range(unknown)]
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(60)] + [(3, n + 37), (3, n + 37), (0, 0), (9999, 1), (1, 9999)]
        frame = spark.createDataFrame(edges, "type string, caller int, callsite int, callee int")
        got = callgraph.paths(frame, spark.createDataFrame(pairs, "source int, target int"), ignore).collect()
        by = {}
        for r in got:
            by.setdefault((r.source, r.target), []).append((r.hop, r.caller, r.callee))
            same = [(s is None, s or 0, t) for t, c, s, e in edges if c == r.caller and e == r.callee]
            assert (r.callsite is None, r.callsite or 0, r.type) == min(same)
        for p in set(pairs):
            assert sorted(by.get(p, []), key=lambda x: x[0]) == shortest(edges, *p, ignore), p


def test_paths_beyond_a_limit_raise(spark):
    chain = spark.createDataFrame([("direct", i, i, i + 1) for i in range(30)], "type string, caller int, callsite int, callee int")
    with pytest.raises(RuntimeError):
        callgraph.path(chain, 0, 30, most_hops=10)
    assert callgraph.path(chain, 5, 2).count() == 0 and callgraph.path(chain, 0, 9).count() == 9
    empty = chain.where("false")
    assert callgraph.paths(empty, empty.selectExpr("caller as source", "callee as target")).count() == 0
