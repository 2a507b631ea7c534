from pyspark.sql import functions as F

import docquarry.store_queries  # noqa: F401  (registers its own)
from docquarry.operators import columnar as C
from docquarry.queries import QUERIES


def test_bloom_grows_with_its_rows(spark, tmp_path):
    """90,000 of 900,000 names: a filter of 2**20 bits lets 3 others through for 100 that it holds."""
    spark.range(900_000).selectExpr("id AS c_custkey", "'Customer#' || id AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in QUERIES["bloom_membership"](spark, str(tmp_path)).collect()] == [(90_000, True)]


def test_bloom_of_odd_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "s string")
    for bits in (C.bloom_bits(4), 1 << 27):  # broadcast and joined
        assert sorted(r.s for r in C.bloom_contains(df, "s", C.bloom(df, "s", bits), bits).collect()) == ["", "a", "a"]
        assert C.bloom_contains(df, "s", C.bloom(df.where("false"), "s", bits), bits).count() == 0


def test_runs_task_sizes(spark):
    """Tasks don't grow with the table, which is sorted once and not grouped."""
    df = spark.range(600_000).selectExpr("id % 1000 AS g", "id AS at", "id DIV 1000 % 7 < 3 AS v")
    out = C.runs(df, "v", ["at"], ["g"])
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
    got = [(r.run, r.v, r.first_row, r.rows) for r in out.where("g = 5").orderBy("run").collect()]
    values, want = [k % 7 < 3 for k in range(600)], []
    for k, v in enumerate(values):
        if k and values[k - 1] == v:
            want[-1][3] += 1
        else:
            want.append([len(want), v, k, 1])
    assert got == [tuple(x) for x in want]


def test_runs_of_odd_rows(spark):
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, None), (None, 1, "x"), (None, 2, "x")]
    df = spark.createDataFrame(rows, "g string, at int, v string")
    got = {(r.g, r.run, r.v, r.first_row, r.rows) for r in C.runs(df, "v", ["at"], ["g"]).collect()}
    assert got == {("a", 0, None, 0, 2), ("a", 1, "x", 2, 1), ("a", 2, None, 3, 1), (None, 0, "x", 0, 2)}
    assert C.runs(df.where("false"), "v", ["at"], ["g"]).count() == 0
