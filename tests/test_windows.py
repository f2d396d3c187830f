"""Bucketed windows give the results of plain ones, also with one hot key."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plainsight.operators import windows as X


def frame(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(60), i,
             rng.choice([None, i]), rng.randrange(5)) for i in range(400)]
    return spark.createDataFrame(rows, "k string, t int, id int, maybe int, v int")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


ORDER = ["t", "id"]


def test_next_and_previous(spark):
    df, w = frame(spark), W.partitionBy("k").orderBy(*ORDER)
    bucket = F.expr("t DIV 7")
    got = X.with_next(df, ["k"], ORDER, bucket, {"n": "id"})
    assert rows(got, "id", "n") == rows(df.withColumn("n", F.lead("id").over(w)), "id", "n")
    got = X.with_previous(df, ["k"], ORDER, bucket, {"n": "id"})
    assert rows(got, "id", "n") == rows(df.withColumn("n", F.lag("id").over(w)), "id", "n")


def test_running_sum_index_and_fill(spark):
    df, w = frame(spark), W.partitionBy("k").orderBy(*ORDER)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    bucket = F.expr("t DIV 5")
    assert rows(X.running_sum(df, ["k"], ORDER, bucket, "v", "s"), "id", "s") == rows(
        df.withColumn("s", F.sum("v").over(upto)), "id", "s")
    assert rows(X.row_index(df, ["k"], ORDER, bucket, "i"), "id", "i") == rows(
        df.withColumn("i", F.row_number().over(w)), "id", "i")
    assert rows(X.fill_forward(df, ["k"], ORDER, bucket, {"f": "maybe"}), "id", "f") == rows(
        df.withColumn("f", F.last("maybe", ignorenulls=True).over(upto)), "id", "f")


def test_first_rows(spark):
    df, w = frame(spark), W.partitionBy("k").orderBy(*ORDER)
    want = df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    assert rows(X.first_rows(df, ["k"], ORDER), *df.columns) == rows(want, *df.columns)
