"""What the operators share: held-out folds, text blocks, words in Arrow, joins on hot keys, bounded samples."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.session import scratch_path

#: Fixed pattern of a word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(key: str | Column, folds: int) -> Column:
    """crc32(key as text) mod ``folds``; a null key reads as the empty text, whose crc is 0."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))) % folds


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: what follows does not depend on any executor's memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
                budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``budget`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the index of each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    words = lists.flatten()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return words.filter(pa.array(there)), owner[there]


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums by text."""
    return np.bincount(owner, weights=values, minlength=n)[:n]


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: int, weight: str,
             how: str = "inner") -> DataFrame:
    """Equi-join in which hot keys of ``left`` never meet in one task.

    ``right`` has one row per key with the number of its rows in ``left`` as ``weight``. Keys that hold
    at least a 500th of the ``rows`` of ``left`` number 500 at most, so that they can be broadcast; the
    others are shuffled."""
    limit = max(10_000, rows // 500)
    flag = "_hot"
    hot = right.filter(F.col(weight) >= limit).withColumn(flag, F.lit(True))
    cold = right.filter(F.col(weight) < limit)
    rest = [c for c in right.columns if c not in on]
    marked = left.join(F.broadcast(hot.select(*on, *rest, flag)), on, "left")
    names = [*left.columns, *rest]
    done = marked.filter(F.col(flag)).select(*names)
    todo = marked.filter(F.col(flag).isNull()).drop(*rest, flag)
    return done.unionByName(todo.join(cold, on, how).select(*names))


def sample_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the key: the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(20240607), F.col(key)), F.col(key)).limit(most)


def row_parts(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows of known small width."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(rows / per_task))


def small_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def read_labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(doc_id, label) for rows with a label; labels that contradict each other are left out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
            .groupBy("doc_id").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
            .filter("_low = _high").select("doc_id", F.col("_low").cast("int").alias("label")))
