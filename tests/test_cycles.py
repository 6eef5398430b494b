"""Cycles of copies, and the solver that joins them, against brute force."""

import random

import numpy as np
import pytest
from test_graphs import andersen, random_constraints

from factloom import schemas
from factloom.operators import cycles

EDGES = "dst int, src int"


def mutual(edges):
    """The smallest node of all that a node reaches and is reached by, where there is another."""
    to = {}
    for d, s in edges:
        to.setdefault(s, set()).add(d)
    reach = {}
    for n in {x for e in edges for x in e if x is not None}:
        seen, todo = set(), [n]
        while todo:
            for m in to.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    both = {n: {m for m in seen if n in reach[m]} | {n} for n, seen in reach.items()}
    return {(n, min(ms)) for n, ms in both.items() if len(ms) > 1}


@pytest.mark.parametrize("at_once", [0, 30, 200_000])
@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_random_graphs(spark, seed, at_once):
    rng = random.Random(seed)
    edges = [(rng.randrange(-20, 40), rng.randrange(-20, 40)) for _ in range(60 + 15 * seed)]
    edges += [(100 + i, 101 + i) for i in range(9)] + [(200 + (i + 1) % 7, 200 + i) for i in range(7)] + [(5, 5)]  # a chain, a ring, a loop
    got = cycles.strong_components(spark.createDataFrame(edges, EDGES), edges_a_task=at_once).collect()
    assert len(got) == len({r["node"] for r in got}) and {tuple(r) for r in got} == mutual(edges)


def test_components_of_nothing_chains_and_repeated_edges(spark):
    of = lambda edges: sorted(tuple(r) for r in cycles.strong_components(spark.createDataFrame(edges, EDGES)).collect())
    assert of([]) == [] and of([(1, 2), (2, 3), (3, 3)]) == []
    assert of([(1, 2), (2, 1), (2, 1), (None, 2), (1, None)]) == [(1, 1), (2, 1)]


def test_one_task_finds_what_brute_force_finds():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 14)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 3 * n + 1))]
        d, s = (np.array(x) for x in zip(*edges, strict=True))
        label = cycles._components_of(n, s, d)
        assert {(i, min(j for j in range(n) if label[j] == label[i])) for i in range(n) if (label == label[i]).sum() > 1} == mutual(edges)
    chain = np.arange(100_000)
    assert len(set(cycles._components_of(100_001, chain, chain + 1).tolist())) == 100_001


@pytest.mark.parametrize("seed", range(3))
def test_points_to_sets_with_joined_cycles(spark, seed):
    cons = random_constraints(seed)
    got = cycles.inclusion(spark.createDataFrame(cons, schemas.CONSTRAINT), edges_a_task=0 if seed == 1 else 200_000).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == andersen(cons)


def test_a_ring_that_closes_through_memory(spark):
    """p = &a; *p = x; y = *p; x = y: x, y and a are one cycle, but only once p's set is known. z gets what they get."""
    cons = [("ADDR", 1, -1), ("ADDR", 2, -2), ("STORE", 1, 2), ("LOAD", 3, 1), ("COPY", 2, 3), ("COPY", 4, 3), ("ADDR", 3, -3), ("LOAD", 5, 4), ("COPY", None, 1)]
    got = {tuple(r) for r in cycles.inclusion(spark.createDataFrame(cons, schemas.CONSTRAINT)).collect()}
    assert got == andersen([c for c in cons if c[1] is not None]) and {o for v, o in got if v == 4} == {-2, -3}
    assert cycles.inclusion(spark.createDataFrame([], schemas.CONSTRAINT)).count() == 0
