"""The registered queries ask what they say of tables of any size."""

from factloom.plans import catalog


def test_reach_asks_of_every_hundredth_function(spark, tmp_path):
    n = 200_100
    ids = "int(id) as c_custkey, int(id % 25) as c_nationkey, 'BUILDING' as c_mktsegment"
    spark.range(n).selectExpr(*ids.split(", ")).write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r["source"], r["target"]) for r in catalog._pairs(spark, str(tmp_path)).collect()}
    assert got == {(s, (s * 31 + k * 97 + 3) % n) for s in range(0, n, 100) for k in range(8)} and max(t for _, t in got) > 100_000


def test_pointers_are_told_from_line_items_in_one_pass(spark, sf_dir):
    """Constraints were made distinct twice before their pointers were."""
    df = catalog._status(spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    c = catalog.X.constraints(spark, sf_dir).collect()
    want = {r["dst"] for r in c} | {r["src"] for r in c if r["op"] != "ADDR"}
    assert sorted(map(tuple, df.collect())) == sorted((p, p % 97 != 5) for p in want if p >= 0)
