"""Unification over labelled edges against a plain union-find, on random graphs, lists, hot classes and odd rows."""

import random

from factloom.operators import dyck

EDGES, EQUAL = "src long, label int, dst long", "a long, b long"


def solved(edges, equal):
    up = {x: x for s, _, d in edges for x in (s, d)} | {x: x for p in equal for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = list(equal)
    while links:
        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        first, links = {}, []
        for s, k, d in edges:
            other = first.setdefault((find(s), k), d)
            if find(other) != find(d):
                links.append((other, d))
    return {(x, find(x)) for x in up}


def merged_first(edges):
    """A link that changes nothing, so that edges alone are looked at too."""
    return [(edges[0][0], edges[0][0])] if edges else []


def run(spark, edges, equal):
    rows = [tuple(r) for r in dyck.closure(spark.createDataFrame(edges, EDGES), spark.createDataFrame(equal, EQUAL)).select("node", "class").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_graphs(spark):
    rng = random.Random(5)
    for n, m, k in ((12, 10, 3), (60, 45, 12)):
        node = lambda: rng.randrange(-n // 2, n)  # noqa: B023, E731
        edges = [(node(), rng.randrange(3), node()) for _ in range(m)]
        equal = [(node(), node()) for _ in range(k)]
        noise = [(None, 0, 1), (1, None, 2), (1, 0, None), edges[0]]
        assert run(spark, edges + noise, equal + [(None, 3), equal[0]]) == solved(edges, equal + merged_first(edges))


def test_lists_fall_together_from_their_heads(spark):
    depth = 5
    edges = [(base + i, i % 2, base + i + 1) for base in (0, 100, 200) for i in range(depth)]
    got = dict(run(spark, edges, [(0, 100), (100, 200)]))
    assert all(got[base + i] == i for base in (0, 100, 200) for i in range(depth + 1))
    assert len(set(dict(run(spark, edges, [(0, 0)])).values())) == 3 * (depth + 1)


def test_one_class_with_most_terms(spark):
    n = 3000
    edges = [(i, 0, 10_000 + i) for i in range(n)] + [(10_000 + i, 1, 20_000 + i % 7) for i in range(n)]
    got = dict(run(spark, edges, [(0, i) for i in range(1, n)]))
    assert {got[i] for i in range(n)} == {0} and {got[10_000 + i] for i in range(n)} == {10_000} and {got[20_000 + i] for i in range(7)} == {20_000}


def test_constraints_and_empty_tables(spark):
    c = spark.createDataFrame([("ADDR", 1, -1, None), ("LOAD", 2, 1, None), ("GEP", 3, 1, 2), ("GEP", 1, 4, -2), ("GEP", 5, 1, None), ("COPY", None, 1, None)], "op string, dst long, src long, offset int")
    got = dict(run(spark, *[[tuple(r) for r in df.collect()] for df in dyck.of_constraints(c)]))
    assert got[2] == -1 and got[1] == got[5] == 1 and got[3] == got[4] == 3
    assert run(spark, [], []) == set()
