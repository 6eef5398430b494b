"""Type-based targets on random calls, and what the product of calls and functions costs."""

import random

from factloom.operators import pointsto

SITES, FUNCTIONS = "callsite int, kind string, signature int, layer int", "vid int, is_taken boolean, signature int, layer int"


def test_random_calls_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(pointsto, "TOGETHER", 3)
    rng = random.Random(6)
    some = lambda n: rng.choice([None, *range(n)])
    sites = [(k, rng.choice(["direct", "indirect"]), some(3), some(6)) for k in range(80)] + [(7, "indirect", 1, 2), (7, "indirect", 1, None)]
    functions = [(k, rng.random() < 0.7, some(3), some(4)) for k in range(60)]
    want = {1: [], 2: []}
    pairs = [(c, f) for c in sites for f in functions if c[1] == "indirect" and f[1] and c[2] is not None and c[2] == f[2]]
    exact = {c[0] for c, f in pairs if c[3] is not None and c[3] == f[3]}
    want[1] = sorted((c[0], f[0]) for c, f in pairs)
    want[2] = sorted((c[0], f[0]) for c, f in pairs if c[0] not in exact or c[3] is not None and c[3] == f[3])
    for layers in (1, 2):
        got = pointsto.type_based(spark.createDataFrame(sites, SITES), spark.createDataFrame(functions, FUNCTIONS), layers)
        assert sorted(map(tuple, got.collect())) == want[layers] and got.columns == ["callsite", "callee"]


def test_pairs_are_not_shuffled(spark):
    """The pairs were shuffled twice, to tell which calls have functions of their layer."""
    sites = spark.range(100).selectExpr("int(id) as callsite", "'indirect' as kind", "int(id % 2) as signature", "int(id % 3) as layer")
    functions = spark.range(100).selectExpr("int(id) as vid", "true as is_taken", "int(id % 2) as signature", "int(id % 5) as layer")
    plan = pointsto.type_based(sites, functions)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Generate explode" in above and "Aggregate" not in above
