"""Quality index: saved values of the utilities, weights and the tree."""

from pyspark.sql import functions as F

from plainsight.operators import feeds as FE
from plainsight.operators import quality as QL


def test_saved_utilities(spark):
    bench = {"flat0": [0, 0], "flat3": [3, 3], "up": [0, 3], "down": [3, 0], "six": [0, 6]}
    rows = [(f"b{i}", m, v) for m, vs in bench.items() for i, v in enumerate(vs)]
    thresholds = QL.benchmark_thresholds(spark.createDataFrame(rows, "project string, measure string, value long"))
    values = spark.createDataFrame([("p", m, 0) for m in bench] + [("q", "six", 4)], "project string, measure string, value long")
    got = {(r["project"], r["measure"]): r["utility"] for r in QL.utility(values, thresholds, F.expr("threshold DIV 2")).collect()}
    assert got == {("p", "flat0"): 0.001, ("p", "flat3"): 0.999, ("p", "up"): 1.0, ("p", "down"): 1.0, ("p", "six"): 1.0, ("q", "six"): 0.5}


def test_tree_with_shared_and_uneven_children(spark):
    edges = spark.createDataFrame([("top", "m1", 0.5), ("top", "m2", 0.5), ("m1", "d1", 1.0), ("m1", "m2", 2.0), ("m2", "d1", 3.0), ("m2", "d2", None)],
                                  "parent string, child string, weight double")
    leaf = spark.createDataFrame([("p", "d1", 1.0), ("p", "d2", 4.0), ("q", "d2", 1.0)], "project string, node string, value double")
    got = {(r["project"], r["node"]): r["value"] for r in QL.rollup_tree(QL.fixed_weights(edges), leaf).collect()}
    assert got[("p", "m2")] == 7.0 and got[("p", "m1")] == 15.0 and got[("p", "top")] == 11.0
    assert got[("q", "m2")] == 1.0 and got[("q", "top")] == 1.5
    even = {(r["parent"], r["child"]): r["weight"] for r in QL.equal_weights(edges).collect()}
    assert even[("top", "m1")] == 0.5


def test_zero_rows_stay(spark):
    f = spark.createDataFrame([("p", "D1"), ("p", "D1"), ("p", "other")], "project string, diagnostic string")
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    got = {(r["project"], r["diagnostic"]): r["value"] for r in QL.diagnostics(f, projects, ["D1", "D2"]).collect()}
    assert got == {("p", "D1"): 2, ("p", "D2"): 0, ("q", "D1"): 0, ("q", "D2"): 0}


def test_feeds(spark):
    tries = spark.createDataFrame([("a", "8", 0, False, None), ("a", "11", 1, True, None), ("a", "17", 2, True, "17.0"), ("b", "8", 0, False, None), ("c", "8", 0, True, "9")],
                                  "project string, java_version string, rank int, ok boolean, detected string")
    got = {r["project"]: r["java_version"] for r in FE.first_success(tries).collect()}
    assert got == {"a": "11", "b": "DNB", "c": "9"}
    adv = spark.createDataFrame([("r2", "1"), ("r1", "1"), ("r1", "1"), ("r3", "1"), ("r3", "2")], "repo string, cve string")
    assert [(r["rank"], r["repo"]) for r in FE.top_repos(adv, "repo", "cve", 2).orderBy("rank").collect()] == [(1, "r3"), (2, "r1")]
