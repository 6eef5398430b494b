"""Calls by layers against a plain reading of the rule, on random paths, escaping types and odd rows."""

import random

from factloom.operators import layers

PATH = "array<struct<type: long, field: long>>"


def plain(calls, stores, lost, most):
    def ended(path):
        path = (path or [])[:most]
        for i, (t, f) in enumerate(path):
            if t is None or f is None or t in lost:
                return tuple(path[:i]), True
        return tuple(path), False

    out = {}
    for c, sig, path in calls:
        p, _ = ended(path)
        at = [(ended(q), f) for f, s, q in stores if s is not None and s == sig]
        depth = max([k for k in range(len(p) + 1) if any(q[:k] == p[:k] and len(q) >= k for (q, _), _ in at)], default=0)
        out[c] = depth, {f for (q, e), f in at if q[:depth] == p[:depth] and len(q) >= depth or e and len(q) <= depth and p[: len(q)] == q}
    return out


def run(spark, calls, stores, lost, most=layers.LAYERS):
    of, members = layers.classes(spark.createDataFrame(calls, f"callsite int, signature int, path {PATH}"), spark.createDataFrame(stores, f"callee int, signature int, path {PATH}"), spark.createDataFrame([(t,) for t in lost], "type long"), most)
    sets = {}
    for r in members.collect():
        assert r["callee"] not in sets.setdefault(r["class"], set())
        sets[r["class"]].add(r["callee"])
    rows = of.collect()
    assert len({r["callsite"] for r in rows}) == len(rows) and all(r["class"] <= r["callsite"] for r in rows)
    return {r["callsite"]: (r["depth"], sets.get(r["class"], set())) for r in rows}


def test_random_paths(spark):
    rng = random.Random(8)
    path = lambda: [(rng.randrange(5), rng.randrange(2)) for _ in range(rng.randrange(7))]
    calls = [(i, rng.randrange(3), path()) for i in range(120)] + [(500, None, path()), (501, 9, path()), (502, 1, None), (503, 1, [(1, None), (2, 0)])]
    stores = [(i % 60, rng.randrange(3), path()) for i in range(90)] + [(70, None, path()), (71, 1, None), (72, 2, [(None, 1)])]
    for lost, most in (({4}, 10), (set(), 2), ({0, 1}, 0)):
        assert run(spark, calls + [calls[0]], stores + [stores[0], (None, 1, [])], lost, most) == plain(calls, stores, lost, most)


def test_escaping_types_follow_conversions(spark):
    conversions = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (6, 3), (None, 3), (7, None)], "type long, to long")
    types = lambda *t: sorted(r["type"] for r in layers.escaping(spark.createDataFrame([(x,) for x in t], "type long"), conversions).collect())
    assert types(3, None, 3) == [1, 2, 3, 6] and types(5) == [4, 5] and types() == []


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, [(1, 1)])], set()) == {}
    assert run(spark, [(1, 1, [(1, 1)])], [], set()) == {1: (0, set())}
