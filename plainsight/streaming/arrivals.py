"""Arriving project files are analysed once; what has a result is skipped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def pending(arrivals: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrivals without a result, each once."""
    return arrivals.dropDuplicates(list(keys)).join(done.select(*keys).distinct(), list(keys), "left_anti")


def read_arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint folder belongs to: made once and kept in the folder."""
    path = f"{checkpoint.rstrip('/')}/run-name"
    try:
        return spark.read.text(path).first()["value"]
    except AnalysisException:
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
        return spark.read.text(path).first()["value"]


def analyse_new_projects(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], results: str,
                         checkpoint: str, keys: Sequence[str]):
    """Start the job: of every batch, what no earlier batch of any run has analysed is analysed and written.

    A project that arrives late is analysed like any other; only what has a result is skipped.  Results, the keys of
    analysed projects and the rows taken from a batch are tables with a folder for each run and batch.  A run is known by
    its checkpoint folder, so that a start with a new one writes beside older results, never over them; a batch that is
    run again after a failure overwrites its own folders only.  The rows are written before they are analysed: a lost
    executor cannot pick others.
    """
    spark, names = stream.sparkSession, list(keys)
    root, run = results.rstrip("/"), run_name(stream.sparkSession, checkpoint)
    done_path = f"{root}-done"
    kept = StructType([*stream.select(*names).schema.fields, StructField("run", StringType()), StructField("batch", LongType())])
    spark.createDataFrame([], stream.select(*names).schema).write.mode("append").parquet(f"{done_path}/run=none/batch=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        session, own = batch.sparkSession, f"run={run}/batch={batch_id}"
        mine = (F.col("run") == run) & (F.col("batch") == batch_id)
        done = session.read.schema(kept).parquet(done_path).filter(~mine)
        pending(batch, done, names).write.mode("overwrite").parquet(f"{root}-taken/{own}")
        new = session.read.schema(batch.schema).parquet(f"{root}-taken/{own}")
        analyse(new).write.mode("overwrite").parquet(f"{root}/{own}")
        new.select(*names).write.mode("overwrite").parquet(f"{done_path}/{own}")

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
