"""Sparse vectors: what they hold, and that no Python takes part."""

import math

from pyspark.sql import functions as F

from shelfspark.functions.vectors import bucket_of
from shelfspark.operators import sparse_embed as se

TEXTS = [("a", "red shoes red"), ("a", "blue shoes"), ("a", ""), ("a", None), ("b", "shoes"), ("b", "Shoes; SHOES")]


def test_weights_are_counts_times_inverse_frequencies(spark):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "id int, tenant string, text string")
    learned = se.learn(rows, dimensions=997)
    got = {r["id"]: dict((p["at"], p["w"]) for p in r["sparse"])
           for r in se.embed(rows, learned, dimensions=997).collect()}
    at = lambda word: bucket_of(word, 997)
    raw = {at("red"): 2 * (math.log(5 / 2) + 1), at("shoes"): math.log(5 / 3) + 1}
    length = math.sqrt(sum(w * w for w in raw.values()))
    assert {k: round(v, 9) for k, v in got[0].items()} == {k: round(v / length, 9) for k, v in raw.items()}
    assert got[2] == got[3] == {} and got[4] == got[5] == {at("shoes"): 1.0}
    # A word that the tenant never saw, and a tenant that was never learned.
    asked = spark.createDataFrame([("a", "green shoes"), ("c", "shoes")], "tenant string, text string")
    found = se.embed(asked, learned, dimensions=997, prefix="find ").collect()
    assert [len(r["sparse"]) for r in found] == [3]


def test_products_and_dense_vectors(spark):
    rows = spark.createDataFrame([("t", "one two three two"), ("t", "two four")], "tenant string, text string")
    both = se.embed(rows, se.learn(rows, dimensions=50), dimensions=50)
    pair = both.alias("l").crossJoin(both.alias("r")).select(
        se.product(F.col("l.sparse"), F.col("r.sparse")).alias("p"), se.dense(F.col("l.sparse"), 50).alias("a"),
        se.dense(F.col("r.sparse"), 50).alias("b")).collect()
    for r in pair:
        assert abs(r["p"] - sum(x * y for x, y in zip(r["a"], r["b"]))) < 1e-6 and len(r["a"]) == 50


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame(TEXTS, "tenant string, text string")
    plan = se.embed(rows, se.learn(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_counts_in_tasks_equal_those_of_the_column(spark):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "id int, tenant string, text string")
    for n, prefix in ((3, ""), (997, "find: ")):
        counts = se.counts_in_tasks(n, prefix)
        frames = [se.embed(rows, se.learn(rows, dimensions=n), dimensions=n, prefix=prefix),
                  se.embed(rows, se.learn(rows, dimensions=n, counts=se.counts_in_tasks(n)), dimensions=n, counts=counts)]
        want, got = [sorted((r["id"], r["sparse"]) for r in f.collect()) for f in frames]
        assert got == want and frames[0].columns == frames[1].columns


def test_rows_of_a_large_tenant_do_not_meet_in_one_task(spark, monkeypatch):
    rows = spark.createDataFrame(TEXTS, "tenant string, text string")
    learned = se.learn(rows)
    near = se.embed(rows, learned)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(se, "TENANTS", 0)
    assert sorted(se.embed(rows, learned).select("sparse").collect()) == sorted(near.select("sparse").collect())

