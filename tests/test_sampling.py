"""Splits, balancing, packing, scoring and training."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plainsight.operators import sampling as SA
from plainsight.operators import scoring as SC
from plainsight.operators import training as TR


def pack(files, budget, prompt):
    """Greedy packing, one project, as (path, batch)."""
    out, batch, used, n = [], 0, prompt, 0
    for path, tokens in files:
        w = tokens + prompt
        if w > budget:
            batch, used, n = batch + 1, None, 0
            out.append((path, batch))
            continue
        if used is None or used + w > budget or not out:
            batch, used = batch + 1, prompt
        used += w
        out.append((path, batch))
    return out


def test_packing_matches_greedy(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.choice([3, 5, 8, 13, 40, 95, 120])) for p in ("hot", "b") for i in range(150 if p == "hot" else 20)]
    df = spark.createDataFrame(rows, "project string, path int, tokens int")
    got = SA.token_batches(df, "project", "path", F.col("tokens"), 100, 4, F.expr("path DIV 10"))
    for p in ("hot", "b"):
        want = pack([(i, t) for q, i, t in rows if q == p], 100, 4)
        assert [(r["path"], r["batch_no"]) for r in got.filter(F.col("project") == p).orderBy("path").collect()] == want


def test_splits(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = SA.stratified_split(df, "y", "id", {"test": 0.15, "validation": 0.15})
    c = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(0, "test")] == 113 and c[(1, "test")] == 38 and c[(0, "train")] == 525
    assert s.count() == 1000
    sizes = Counter(r["split"] for r in SA.random_split(spark.range(103), "id").collect())
    assert sizes == {"train": 82, "validation": 10, "test": 11}
    folds = SA.k_folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds} == {50, 150} and len(folds) == 10


def test_balancing(spark):
    df = spark.createDataFrame([(i, int(i < 5), [float(i), float(i % 7)]) for i in range(60)], "id int, y int, v array<double>")
    out = SA.oversample(df, "y", "id", 1)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 55, 1: 55}
    made = SA.smote(df, "y", "id", "v", 1, per_row=3, k=2).collect()
    assert len(made) == 15
    by_id = {r["id"]: r["v"] for r in df.collect()}
    for r in made:
        a, b = np.array(by_id[r["origin"]]), np.array(by_id[r["neighbour"]])
        assert r["origin"] != r["neighbour"] and r["neighbour"] < 5
        assert np.all(np.array(r["v"]) >= np.minimum(a, b) - 1e-9) and np.all(np.array(r["v"]) <= np.maximum(a, b) + 1e-9)


def test_confidence_rules(spark):
    df = spark.createDataFrame([("variables", 0.75, 0), ("variables", 0.74, 0), ("strings", 0.94, 0), ("sinks", 0.2, 3), ("sinks", 0.99, 0)],
                               "category string, confidence double, sink_class int")
    assert [(r[0], r[1]) for r in SC.keep_confident(df).collect()] == [("variables", 0.75), ("sinks", 0.2)]
    assert SC.keep_confident(df, sink_threshold=True).count() == 1


def test_softmax_and_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "id int, v array<double>")
    for r in df.select("v", SC.softmax("v").alias("s"), SC.argmax("v").alias("a")).collect():
        e = np.exp(np.array(r["v"]) - max(r["v"]))
        assert np.allclose(r["s"], e / e.sum()) and r["a"] == int(np.argmax(r["v"]))
    got = SC.score_batches(df, lambda m: m.sum(axis=1), "v", ["id"], batch=3)
    assert sorted((r["id"], r["score"]) for r in got.collect()) == [(i, i + 3.0) for i in range(10)]


def test_training(spark):
    df = TR.as_vectors(spark.createDataFrame([(i, int(i % 10 < 5), [float(i % 10), 1.0]) for i in range(80)], "id int, y int, v array<double>"), "v")
    p = TR.predicted(TR.train_binary(df, "y"), df, ["y"])
    assert p.filter("y = prediction").count() > 70
    assert len(TR.draw_grid({}, 3)) == 1
