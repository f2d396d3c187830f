"""Progress messages: the share done per type, put out only when it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plainsight.operators.windows import running_sum

OUT = "type string, progress int"
STATE = "done double, last int"


def _percent(done: Column, total: Column) -> Column:
    """Whole percent, halves to even, never above 100; a total of nothing is done."""
    return F.when(total > 0, F.least(F.bround(done / total * 100), F.lit(100.0))).otherwise(F.lit(100.0)).cast("int")


def progress_changes(stream: DataFrame) -> DataFrame:
    """``stream(type, total, step, ts)``; the state per type is two numbers.

    Messages count in the order of arrival; those that come together are ordered by time.
    """

    def changes(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, last = state.get if state.exists else (0.0, -1)
        for frame in frames:
            out = []
            for total, step in zip(frame.sort_values("ts")["total"], frame.sort_values("ts")["step"]):
                done += step
                now = min(round(done / total * 100), 100) if total > 0 else 100
                if now != last:
                    out.append(now)
                    last = now
            if out:
                yield pd.DataFrame({"type": key[0], "progress": out})
        state.update((done, last))
    return stream.groupBy("type").applyInPandasWithState(
        changes, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def progress_table(rows: DataFrame, order: list, bucket: Column) -> DataFrame:
    """The same over a stored table: first row at which each value is reached.

    Steps are not negative, so a value once left does not come back.
    """
    r = running_sum(rows, ["type"], order, bucket, "step", "done")
    r = r.withColumn("progress", _percent(F.col("done"), F.col("total")))
    return r.groupBy("type", "progress").agg(F.min(F.struct(*order)).alias("first"))
