"""Streams: progress over several batches, and arrivals analysed once."""

from pyspark.sql import functions as F

from plainsight.streaming import arrivals as AR
from plainsight.streaming import progress as PR


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_progress_over_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "type string, total int, step int, ts timestamp"
    first = [("a", 8, 1, 0), ("a", 8, 0, 1), ("a", 8, 1, 2), ("b", 0, 1, 3)]
    second = [("a", 8, 3, 4), ("a", 8, 9, 5), ("a", 8, 1, 6)]
    for rows in (first, second):
        spark.createDataFrame(rows, "type string, total int, step int, s long").select(
            "type", "total", "step", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        run(PR.progress_changes(spark.readStream.schema(schema).parquet(src)), out, state)
    got = sorted((r["type"], r["progress"]) for r in spark.read.parquet(out).collect())
    # 12.5 rounds to even; 25; 62.5 to even; capped at 100
    assert got == [("a", 12), ("a", 25), ("a", 62), ("a", 100), ("b", 100)]


def test_arrivals_once(spark, tmp_path):
    src, res, state = (str(tmp_path / n) for n in ("in", "res", "state"))
    schema = "project string, sent_at timestamp"

    def send(names, at="2024-01-01 12:00:00"):
        spark.createDataFrame([(n,) for n in names], "project string").withColumn(
            "sent_at", F.lit(at).cast("timestamp")).write.mode("append").json(src)
        q = AR.analyse_new_projects(AR.read_arrivals(spark, src, schema), lambda b: b.select("project"), res, state, ["project"])
        q.awaitTermination()
    send(["p1", "p2", "p1"])
    send(["p2", "p3"])
    send(["p4", "p1"], at="2023-06-01 09:00:00")  # long before the others: late, but without a result
    assert sorted(r["project"] for r in spark.read.parquet(res).collect()) == ["p1", "p2", "p3", "p4"]


def test_new_checkpoint_beside_old_results(spark, tmp_path):
    src, res = (str(tmp_path / n) for n in ("in", "res"))

    def send(names, state):
        spark.createDataFrame([(n,) for n in names], "project string").write.mode("append").json(src)
        stream = AR.read_arrivals(spark, src, "project string")
        AR.analyse_new_projects(stream, lambda b: b.select("project"), res, str(tmp_path / state), ["project"]).awaitTermination()
        return sorted(r["project"] for r in spark.read.parquet(res).collect())
    for i in range(3):
        assert send([f"p{i}"], "state") == [f"p{j}" for j in range(i + 1)]
    # all files come again, in batches that count from 0: nothing is lost, nothing is analysed twice
    assert send(["p9"], "new-state") == ["p0", "p1", "p2", "p9"]
    assert send(["p3"], "state") == ["p0", "p1", "p2", "p3", "p9"]
    assert AR.run_name(spark, str(tmp_path / "state")) != AR.run_name(spark, str(tmp_path / "new-state"))
    columns = spark.read.parquet(res).columns
    assert columns == ["project", "run", "batch"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    src, res, state = (str(tmp_path / n) for n in ("in", "res", "state"))
    spark.createDataFrame([("a",), ("b",), ("a",)], "project string").write.json(src)
    failed = []

    def analyse(batch):
        if not failed:
            failed.append(1)
            raise ValueError("lost")
        return batch.select("project")
    for attempt in range(2):
        q = AR.analyse_new_projects(AR.read_arrivals(spark, src, "project string"), analyse, res, state, ["project"])
        try:
            q.awaitTermination()
        except Exception:
            assert attempt == 0
    assert sorted(r["project"] for r in spark.read.parquet(res).collect()) == ["a", "b"]
