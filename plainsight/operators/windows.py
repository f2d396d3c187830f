"""Ordered computations over groups of any size.

A plain window puts a whole group into one task.  Here the group is first cut
into buckets by ``bucket``, an expression that never decreases along the order
(an hour of a timestamp, a block of line numbers, a prefix of a hash).  Rows are
only sorted within (keys, bucket); the link between buckets runs over one
summary row per bucket.  Results are the same as those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bucketed(df: DataFrame, keys, order, bucket):
    cut = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*[_col(o) for o in order])
    outer = W.partitionBy(*keys).orderBy("_bucket")
    return cut, inner, outer


def _neighbour(df, keys, order, bucket, outs, ahead: bool) -> DataFrame:
    cut, inner, outer = _bucketed(df, keys, order, bucket)
    shift = F.lead if ahead else F.lag
    edge = F.min_by if ahead else F.max_by
    cut = cut.withColumn("_pay", F.struct(*[_col(c).alias(n) for n, c in outs.items()]))
    edges = cut.groupBy(*keys, "_bucket").agg(
        edge("_pay", F.struct(*[_col(o) for o in order])).alias("_edge"))
    edges = edges.withColumn("_edge", shift("_edge").over(outer))
    joined = cut.withColumn("_near", shift("_pay").over(inner)).join(
        edges, [*keys, "_bucket"], "left")
    near = F.coalesce("_near", "_edge")
    return joined.select(*df.columns, *[near.getField(n).alias(n) for n in outs])


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
              outs: dict) -> DataFrame:
    """Values of the following row of the group; ``outs`` maps new name to column."""
    return _neighbour(df, keys, order, bucket, outs, True)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
                  outs: dict) -> DataFrame:
    """Values of the preceding row of the group."""
    return _neighbour(df, keys, order, bucket, outs, False)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
                value, out: str) -> DataFrame:
    """Sum of ``value`` from the first row of the group up to this one."""
    cut, inner, outer = _bucketed(df, keys, order, bucket)
    cut = cut.withColumn("_v", _col(value))
    before = (cut.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_s"))
              .withColumn("_before", F.sum("_s").over(
                  outer.rowsBetween(W.unboundedPreceding, -1)))
              .drop("_s"))
    own = F.sum("_v").over(inner.rowsBetween(W.unboundedPreceding, 0))
    return (cut.withColumn("_own", own).join(before, [*keys, "_bucket"], "left")
            .select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias(out)))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
              out: str) -> DataFrame:
    """1-based position in the group."""
    cut, inner, outer = _bucketed(df, keys, order, bucket)
    before = (cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(
                  outer.rowsBetween(W.unboundedPreceding, -1)))
              .drop("_n"))
    return (cut.withColumn("_own", F.row_number().over(inner))
            .join(before, [*keys, "_bucket"], "left")
            .select(*df.columns,
                    (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out)))


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
                 outs: dict) -> DataFrame:
    """Latest non-null value at or before each row; ``outs`` maps new name to column."""
    cut, inner, outer = _bucketed(df, keys, order, bucket)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    past = outer.rowsBetween(W.unboundedPreceding, -1)
    ordering = F.struct(*[_col(o) for o in order])
    names = list(outs)
    for n, c in outs.items():
        cut = cut.withColumn(f"_src_{n}", _col(c))
    tails = cut.groupBy(*keys, "_bucket").agg(*[
        F.max_by(f"_src_{n}", F.when(F.col(f"_src_{n}").isNotNull(), ordering)).alias(f"_tail_{n}")
        for n in names])
    tails = tails.select(*keys, "_bucket", *[
        F.last(f"_tail_{n}", ignorenulls=True).over(past).alias(f"_tail_{n}") for n in names])
    for n in names:
        cut = cut.withColumn(f"_own_{n}", F.last(f"_src_{n}", ignorenulls=True).over(upto))
    return cut.join(tails, [*keys, "_bucket"], "left").select(
        *df.columns, *[F.coalesce(f"_own_{n}", f"_tail_{n}").alias(n) for n in names])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per group, as an aggregate: partial on the map side, no sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[_col(o) for o in order])).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.`{c}`").alias(c)
                           for c in df.columns])


def hash_rank_key(col, seed: int = 42) -> Column:
    """Seeded pseudo-random order key, equal on every run: hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(col).cast("string")))


def hash_bucket(key: Column, width: int = 4) -> Column:
    """Prefix of a hex key: 16**width buckets that follow the key's order."""
    return F.substring(key, 1, width)
