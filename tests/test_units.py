"""Units of a graph, and solvers that solve them in tasks, against plain versions on random graphs."""

import random
import re

import numpy as np
import pytest

from factloom import schemas
from factloom.operators import fields, lineage, local, pointsto, units


def joined(links):
    """The smallest node that each node is linked with."""
    root = {}

    def of(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = of(a), of(a if b is None else b)
        root[max(a, b)] = min(a, b)
    return {x: of(x) for x in root}


@pytest.mark.parametrize("near", [True, False])
def test_units_of_random_graphs(spark, near):
    """Slices of a few rows, so that units lie in several."""
    rng = random.Random(5)
    links = [(a := rng.randrange(-300, 300), None if rng.random() < 0.1 else a + rng.randrange(3) if near else rng.randrange(-300, 300)) for _ in range(260)]
    with lineage.rounds(spark) as cut:
        rows = units.marked(spark.createDataFrame(links, "a long, b long"), "a", "b", cut, 7).collect()
    assert sorted((r["a"], r["b"] is None, r["b"] or 0) for r in rows) == sorted((a, b is None, b or 0) for a, b in links)
    want, found = joined(links), {}
    for r in rows:
        assert found.setdefault(want[r["a"]], r["unit"]) == r["unit"]
    assert len(set(found.values())) == len(found)


def test_roots_of_a_long_chain():
    n = 3000
    order = np.random.default_rng(1).permutation(n - 1)
    assert not units.roots(n, order, order + 1).any()
    assert list(units.roots(4, np.array([2]), np.array([3]))) == [0, 1, 2, 2]


def program(seed, parts):
    """Random constraints in parts without a link between them, of different sizes."""
    rng, out = random.Random(seed), []
    for k in range(parts):
        n = rng.choice([3, 8, 20])
        for _ in range(3 * n):
            op = rng.choice(["ADDR", "ADDR", "COPY", "COPY", "LOAD", "STORE"])
            out.append((op, 100 * k + rng.randrange(n), -1 - 10 * k - rng.randrange(4) if op == "ADDR" else 100 * k + rng.randrange(n)))
    return out


@pytest.mark.parametrize("most_cost", [units.MOST_COST, 1000, 0])
def test_inclusion_in_tasks_and_by_rounds(spark, most_cost):
    """Small units in tasks, large ones by rounds, or all by either: the same sets."""
    cons = program(2, 12)
    df = spark.createDataFrame(cons + cons[:5], schemas.CONSTRAINT)
    got = [tuple(r) for r in pointsto.inclusion(df, most_cost=most_cost).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in pointsto.inclusion_by_rounds(df).collect()}


@pytest.mark.parametrize("most_cost", [units.MOST_COST, 300, 0])
def test_unification_in_tasks_and_by_rounds(spark, most_cost):
    df = spark.createDataFrame(program(3, 12), schemas.CONSTRAINT)
    got = sorted(tuple(r) for r in pointsto.unification(df, most_cost=most_cost).collect())
    assert got == sorted(tuple(r) for r in pointsto.unification_by_rounds(df).collect())


def test_small_classes_take_no_rounds(spark, monkeypatch):
    """Pointees of pointees fall together along a chain that took a round a link."""
    chain = [(op, 100 * k + i + 1, 100 * k + i) for k in range(40) for i in range(30) for op in ("LOAD", "COPY")]
    monkeypatch.setattr(pointsto, "unification_by_rounds", lambda *a, **k: pytest.fail("rounds"))
    got = pointsto.unification(spark.createDataFrame(chain, schemas.CONSTRAINT))
    assert got.count() == 40 * 31 * 3 and got.schema.simpleString() == "struct<node:int,level:int,label:bigint>"


def test_small_units_take_no_rounds(spark, monkeypatch):
    """A chain of 60 copies in each of 50 units is solved without a round of joins a copy."""
    chain = [("ADDR", 100 * k, -1 - k) for k in range(50)] + [("COPY", 100 * k + i + 1, 100 * k + i) for k in range(50) for i in range(60)]
    monkeypatch.setattr(pointsto, "inclusion_by_rounds", lambda *a, **k: pytest.fail("rounds"))
    assert pointsto.inclusion(spark.createDataFrame(chain, schemas.CONSTRAINT)).count() == 50 * 61
    assert pointsto.inclusion(spark.createDataFrame([], schemas.CONSTRAINT)).count() == 0
    assert re.match(r"ptr int, site int", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pointsto.inclusion(spark.createDataFrame([], schemas.CONSTRAINT)).schema))


def test_products_are_made_in_pieces(monkeypatch):
    monkeypatch.setattr(local, "PIECE", 3)
    table = local.Index(np.array([5, 1, 5, 2, 5]), np.arange(5))
    got = sorted((int(i), int(c)) for part in table.join(np.array([5, 9, 1, 5])) for i, c in zip(*part, strict=True))
    assert got == [(0, 0), (0, 2), (0, 4), (2, 1), (3, 0), (3, 2), (3, 4)]


@pytest.mark.parametrize("most_cost", [units.MOST_COST, 2000, 0])
def test_fields_in_tasks_and_by_rounds(spark, most_cost):
    """Parts with objects of several fields, some of which meet in memory that nothing is known of."""
    rng = random.Random(8)
    cons = []
    for k in range(6):
        n = rng.choice([4, 12])
        for _ in range(4 * n):
            op = rng.choice(["ADDR", "COPY", "LOAD", "STORE", "GEP", "GEP"])
            src = (0 if k < 2 and rng.random() < 0.2 else -1 - 10 * k - rng.randrange(4)) if op == "ADDR" else 100 * k + rng.randrange(n)
            cons.append((op, 100 * k + rng.randrange(n), src, rng.choice([0, 1, 1, 2, -1, None]) if op == "GEP" else None))
    sizes = spark.createDataFrame([(-s, s % 5) for s in range(1, 60)], "site long, size int")
    df = spark.createDataFrame(cons, "op string, dst long, src long, offset int")
    key = lambda r: repr(tuple(r))
    got = sorted(map(key, fields.inclusion(df, sizes, most_cost=most_cost).collect()))
    assert len(got) == len(set(got)) and got == sorted(map(key, fields.inclusion(df, sizes, most_cost=-1).collect()))


def test_small_parts_with_fields_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(pointsto, "inclusion_by_rounds", lambda *a, **k: pytest.fail("rounds"))
    cons = [("ADDR", 0, -1, None)] + [("GEP", i + 1, i, 1) for i in range(40)]
    got = fields.inclusion(spark.createDataFrame(cons, "op string, dst long, src long, offset int"), spark.createDataFrame([(-1, 30)], "site long, size int"))
    assert {(r["ptr"], r["field"]) for r in got.collect()} == {(i, i if i < 30 else -1) for i in range(41)}
