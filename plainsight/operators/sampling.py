"""Splits, folds, balancing and packing; all seeded by hashes, all without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.operators.reach import reach_nodes
from plainsight.operators.windows import (fill_forward, hash_bucket, hash_rank_key, row_index, running_sum,
                                          with_next, with_previous)
from plainsight.session import cut_lineage


def hash_position(df: DataFrame, keys: Sequence[str], ident: str, seed: int, out: str = "position") -> DataFrame:
    """1-based place in a seeded random order within ``keys``."""
    h = df.withColumn("_h", hash_rank_key(ident, seed))
    return row_index(h, keys, ["_h", ident], hash_bucket(F.col("_h")), out).drop("_h")


def stratified_split(df: DataFrame, label: str, ident: str, fractions: dict[str, float], seed: int = 42,
                     rest: str = "train") -> DataFrame:
    """Named shares cut per label in the given order; what is left goes to ``rest``."""
    placed = hash_position(df, [label], ident, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # percent rank: 0 for the first, 1 for the last
    j = placed.join(sizes, label).withColumn(
        "_r", F.when(F.col("_n") > 1, (F.col("position") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0)))
    split, upto = None, 0.0
    for name, share in fractions.items():
        upto += share
        cond = F.col("_r") < upto
        split = F.when(cond, F.lit(name)) if split is None else split.when(cond, F.lit(name))
    return j.select(*df.columns, split.otherwise(F.lit(rest)).alias("split"))


def random_split(df: DataFrame, ident: str, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Floor sizes after a seeded shuffle: train, validation, test."""
    placed = hash_position(df.withColumn("_all", F.lit(1)), ["_all"], ident, seed)
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * validation)
    return placed.select(*df.columns, F.when(F.col("position") <= a, F.lit("train")).when(
        F.col("position") <= b, F.lit("validation")).otherwise(F.lit("test")).alias("split"))


def k_folds(df: DataFrame, label: str, ident: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds 1..k of equal size per label, the first ones larger by one."""
    placed = hash_position(df, [label], ident, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    i, big = F.col("position") - 1, (F.floor(F.col("_n") / k) + 1) * (F.col("_n") % k)
    fold = F.when(i < big, F.floor(i / (q + 1)) + 1).otherwise(
        r + F.floor((i - big) / F.greatest(F.lit(1), q)) + 1)
    return placed.join(sizes, label).select(*df.columns, fold.cast("bigint").alias("fold"))


def oversample(df: DataFrame, label: str, ident: str, minority, seed: int = 42) -> DataFrame:
    """Majority rows, and as many draws with replacement from the minority."""
    small, large = df.filter(F.col(label) == minority), df.filter(F.col(label) != minority)
    n, m = small.count(), large.count()
    if n == 0:
        return large
    numbered = hash_position(small.withColumn("_all", F.lit(1)), ["_all"], ident, seed).drop("_all")
    draws = df.sparkSession.range(m).select(
        (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) + 1).alias("position"))
    drawn = numbered.join(draws, "position").select(*df.columns)
    return large.unionByName(drawn)


def smote(df: DataFrame, label: str, ident: str, vector: str, minority, per_row: int = 1, k: int = 5,
          projections: int = 4, seed: int = 42) -> DataFrame:
    """Synthetic minority vectors between a row and one of its neighbours.

    Neighbours are looked for along seeded random directions: rows next to each other in the
    order of a projection are candidates, and the k nearest of them by distance stay.  The work
    is linear in the rows; the exact neighbours would need all pairs.
    """
    d = df.filter(F.col(label) == minority).select(ident, F.col(vector).cast("array<double>").alias("v"))
    d = cut_lineage(d)
    near = None
    for p in range(projections):
        def sign(i, p=p):
            return F.when(F.pmod(F.xxhash64(i, F.lit(p), F.lit(seed)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        proj = F.aggregate(F.transform("v", lambda x, i: x * sign(i)), F.lit(0.0), lambda a, x: a + x)
        o = d.withColumn("_x", proj).withColumn("_all", F.lit(p))
        bucket = F.floor(F.col("_x") * 16)
        for step in (with_next, with_previous):
            pairs = step(o, ["_all"], ["_x", ident], bucket, {"other": ident, "w": "v"})
            pairs = pairs.filter("other IS NOT NULL").select(ident, "v", "other", "w")
            near = pairs if near is None else near.unionByName(pairs)
    gap = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    # at most two candidates per projection and row
    best = near.dropDuplicates([ident, "other"]).withColumn("_d", gap).groupBy(ident).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("_d", "other", "v", "w"))), 1, k).alias("_near"))
    made = best.select(ident, "_near", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("draw"))
    pick = F.pmod(F.xxhash64(ident, "draw", F.lit(seed)), F.size("_near")) + 1
    made = made.withColumn("_c", F.element_at("_near", pick.cast("int"))).withColumn(
        "_t", F.pmod(F.xxhash64(ident, "draw", F.lit(seed + 1)), F.lit(1000)) / 1000.0)
    mixed = F.zip_with("_c.v", "_c.w", lambda a, b: a + F.col("_t") * (b - a))
    return made.select(F.col(ident).alias("origin"), F.col("_c.other").alias("neighbour"), "draw",
                       F.lit(minority).alias(label), mixed.alias(vector))


def chunk_large(df: DataFrame, keep: Sequence[str], text: str, n: int) -> DataFrame:
    """Fixed-width slices of a text, in order."""
    cuts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(n))
    pieces = F.transform(cuts, lambda s: F.substring(F.col(text), s, F.lit(n)))
    return df.select(*keep, F.posexplode(pieces).alias("chunk_no", "chunk"))


def token_batches(files: DataFrame, project: str, path: str, tokens: Column, budget: int, prompt_tokens: int,
                  block: Column) -> DataFrame:
    """Greedy packing of a project's files, in path order, into prompts of at most ``budget``.

    Every file costs its tokens and the prompt once more; a file over the budget stands alone
    (``oversized``) and closes the batch before it.  Packing looks sequential, but where the next
    batch would start depends only on where this one does: with prefix sums that is a pointer per
    file, and the batches are what is reached from the first file along the pointers.  ``block``
    must not decrease along the path.
    """
    room = budget - prompt_tokens
    f = files.select(project, path, (tokens + prompt_tokens).cast("bigint").alias("w"), block.alias("_blk"))
    f = f.withColumn("oversized", (F.col("w") > budget).cast("bigint"))
    f = running_sum(f, [project], [path], F.col("_blk"), "oversized", "part")
    f = running_sum(f, [project], [path], F.col("_blk"), "w", "upto")
    f = cut_lineage(row_index(f, [project], [path], F.col("_blk"), "no"))
    small = f.filter("oversized = 0")
    # for each file: the first later file whose prefix sum leaves the room of a batch that starts here
    wide = max(1, room * 64)
    items = small.select(project, "part", F.col("upto").alias("at"), F.lit(0).alias("kind"), F.col("no").alias("hit"), "no")
    ask = F.greatest(F.col("upto"), F.col("upto") - F.col("w") + room)
    asks = small.select(project, "part", ask.alias("at"), F.lit(1).alias("kind"),
                        F.lit(None).cast("bigint").alias("hit"), "no")
    both = items.unionByName(asks).withColumn("_down", -F.col("at")).withColumn("_kind", -F.col("kind"))
    found = fill_forward(both, [project, "part"], ["_down", "_kind", F.col("no")], F.floor(F.col("_down") / wide), {"next_no": "hit"})
    ident = F.concat_ws("\x1f", F.col(project).cast("string"), F.col("no").cast("string"))
    edges = found.filter("kind = 1 AND next_no IS NOT NULL").select(
        ident.alias("src"), F.concat_ws("\x1f", F.col(project).cast("string"), F.col("next_no").cast("string")).alias("dst"))
    firsts = small.groupBy(project, "part").agg(F.min("no").alias("no")).select(ident.alias("node"))
    starts = reach_nodes(edges, firsts, form="doubling").withColumn("_start", F.lit(1))
    marked = f.withColumn("node", ident).join(starts, "node", "left").withColumn(
        "_new", F.when((F.col("oversized") == 1) | F.col("_start").isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    out = running_sum(marked, [project], [path], F.col("_blk"), "_new", "batch_no")
    return out.select(project, path, "w", "oversized", "batch_no")
