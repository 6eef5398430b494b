"""Searches of call graphs in tasks against joins, on random graphs; long chains that took a job a few hops."""

import random

import pytest

from factloom import schemas
from factloom.operators import callgraph


def graph(seed, n=60, m=75):
    rng = random.Random(seed)
    edges = [("direct", rng.randrange(n), k, rng.randrange(n)) for k in range(m)] + [("unknown", rng.randrange(n, n + 9) if k else 3, 1000 + k, None) for k in range(3)]
    edges += [("direct", a, 2000 + a, a + 1) for a in range(n, n + 8)] + [edges[0], ("indirect", edges[1][1], None, edges[1][3])]
    return edges, [(rng.randrange(n + 9), rng.randrange(n + 12)) for _ in range(150)] + [(5, None), (None, 5), (3, 500), (700, 1)]


@pytest.mark.parametrize("ignore", [False, True])
def test_tasks_and_joins_answer_the_same(spark, ignore):
    edges, pairs = graph(4)
    e, p = spark.createDataFrame(edges, schemas.CALL_EDGE), spark.createDataFrame(pairs, "source int, target int")
    rows = lambda df: sorted(map(repr, df.collect()))
    a, b = callgraph.reachable(e, p, ignore), callgraph.reachable(e, p, ignore, most_edges=0)
    assert a.schema == b.schema and rows(a) == rows(b) and a.count() == len(pairs)
    a, b = callgraph.paths(e, p, ignore), callgraph.paths(e, p, ignore, most_edges=0)
    assert a.schema == b.schema and rows(a) == rows(b) and a.count() > 30


def test_reach_sets_in_tasks_and_by_joins(spark):
    e, s = spark.createDataFrame(graph(5)[0], schemas.CALL_EDGE), spark.createDataFrame([(k,) for k in [*range(0, 70, 3), 3, None, 900]], "vid int")
    a, b = callgraph.reach_set(e, s), callgraph.reach_set(e, s, most_edges=0)
    assert a.schema == b.schema and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_long_chains_take_no_rounds(spark, monkeypatch):
    """Two thousand hops took 500 jobs."""
    e = spark.range(2000).selectExpr("'direct' as type", "int(id) as caller", "int(id) as callsite", "int(id + 1) as callee")
    for name in ("reach_by_hops", "waves"):
        monkeypatch.setattr(callgraph, name, lambda *a, **k: pytest.fail("joins"))
    assert callgraph.reach_set(e, e.where("caller = 0").selectExpr("caller as vid")).count() == 2000
    ask = e.where("caller = 0").selectExpr("caller as source", "2000 as target")
    assert [r["reachable"] for r in callgraph.reachable(e, ask).collect()] == [True] and callgraph.paths(e, ask).count() == 2000
