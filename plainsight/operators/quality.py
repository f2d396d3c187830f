"""Quality index: findings per diagnostic, benchmark, utilities, weighted tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.operators.windows import running_sum
from plainsight.session import cut_lineage

MODEL_LIMIT = 10_000


def model_names(nodes: DataFrame, where: Column, limit: int = MODEL_LIMIT) -> list[str]:
    """Names of model nodes; a quality model is configuration, and its size is checked."""
    rows = nodes.filter(where).select("name").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"quality model with more than {limit} nodes of one kind")
    return sorted(r["name"] for r in rows)


def diagnostics(findings: DataFrame, projects: DataFrame, names: Sequence[str],
                project: str = "project", diagnostic: str = "diagnostic") -> DataFrame:
    """Findings per project and diagnostic of the model, zero rows kept."""
    counts = findings.filter(F.col(diagnostic).isin(list(names))).groupBy(project, diagnostic).agg(
        F.count(F.lit(1)).alias("n"))
    zero = projects.select(project).distinct().select(
        project, F.explode(F.array(*[F.lit(n) for n in names])).alias(diagnostic), F.lit(0).alias("n"))
    return counts.unionByName(zero).groupBy(project, diagnostic).agg(F.sum("n").alias("value"))


def with_descendants(values: DataFrame, pairs: DataFrame, project: str = "project") -> DataFrame:
    """Unweighted sums: a measure takes the findings of all diagnostics below it.

    ``values(project, diagnostic, value)``, ``pairs(measure, diagnostic)``.
    """
    return values.join(pairs.distinct(), "diagnostic").groupBy(project, "measure").agg(F.sum("value").alias("value"))


def benchmark_thresholds(values: DataFrame) -> DataFrame:
    """All benchmark values per measure, as (measure, threshold, projects): equal values once
    with their number, so that a benchmark of any size stays a table."""
    return values.groupBy("measure", F.col("value").alias("threshold")).agg(F.count(F.lit(1)).alias("projects"))


def threshold_range(thresholds: DataFrame) -> DataFrame:
    return thresholds.groupBy("measure").agg(
        F.min("threshold").alias("lo"), F.max("threshold").alias("hi"), F.sum("projects").alias("total"))


def utility(values: DataFrame, thresholds: DataFrame, bucket: Column, project: str = "project") -> DataFrame:
    """Share of benchmark values not below the finding count.

    Where all of them are equal: 0.999 below that value, 0.001 otherwise.  ``bucket`` is an
    expression over ``threshold`` that must not decrease with it.
    """
    asked = values.select("measure", F.col("value").alias("threshold"), F.lit(0).cast("bigint").alias("projects"))
    points = thresholds.select("measure", "threshold", "projects").unionByName(asked.distinct()).groupBy(
        "measure", "threshold").agg(F.sum("projects").alias("projects"))
    cum = running_sum(points, ["measure"], ["threshold"], bucket, "projects", "upto")
    below = cum.select("measure", F.col("threshold").alias("value"), (F.col("upto") - F.col("projects")).alias("below"))
    j = values.join(below, ["measure", "value"]).join(threshold_range(thresholds), "measure")
    flat = F.when(F.col("value") < F.col("hi"), F.lit(0.999)).otherwise(F.lit(0.001))
    share = (F.col("total") - F.col("below")) / F.col("total")
    return j.select(project, "measure", "value", F.when(F.col("lo") == F.col("hi"), flat).otherwise(share).alias("utility"))


def fixed_weights(edges: DataFrame) -> DataFrame:
    """Configured weights; 1.0 where none is given."""
    return edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def equal_weights(edges: DataFrame) -> DataFrame:
    """1/n over the n children of a parent."""
    n = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("_n"))
    return edges.drop("weight").join(n, "parent").withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")


def heights(edges: DataFrame) -> DataFrame:
    """(node, height): longest way down to a leaf, one round per level of the model.  A model has fewer
    levels than nodes; more rounds than that mean a cycle, which is an error."""
    e = cut_lineage(edges.select("parent", "child").distinct())
    level = e.select(F.col("child").alias("node")).join(
        e.select(F.col("parent").alias("node")), "node", "left_anti").distinct()
    out = level.withColumn("height", F.lit(0))
    most = e.select("parent").distinct().count()
    for h in range(1, most + 2):
        level = cut_lineage(e.join(level, e.child == level.node).select(F.col("parent").alias("node")).distinct())
        if level.isEmpty():
            return out.groupBy("node").agg(F.max("height").alias("height"))
        out = out.unionByName(level.withColumn("height", F.lit(h)))
    raise RuntimeError("the quality model is cyclic")


def rollup_tree(edges: DataFrame, leaf: DataFrame, project: str = "project") -> DataFrame:
    """(project, node, value): weight times child value, summed, level by level upwards.

    Children may be shared and may sit on different levels; ``leaf(project, node, value)``.  Each level is
    written once and read by the levels above it; the leaf table is never written again.
    """
    tall = cut_lineage(heights(edges))
    top = tall.agg(F.max("height")).first()[0] or 0
    levels = [leaf.select(project, "node", F.col("value").cast("double").alias("value"))]
    e = edges.join(tall.select(F.col("node").alias("parent"), "height"), "parent")
    for h in range(1, top + 1):
        step = e.filter(F.col("height") == h).select("parent", F.col("child").alias("node"), "weight")
        below = levels[0]
        for level in levels[1:]:
            below = below.unionByName(level)
        levels.append(cut_lineage(below.join(step, "node").groupBy(project, F.col("parent").alias("node")).agg(
            F.sum(F.col("weight") * F.col("value")).alias("value"))))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def compact_report(values: DataFrame, nodes: DataFrame, analysed: DataFrame, project: str = "project") -> DataFrame:
    """One JSON record per project with its values by level; projects without findings file out."""
    v = values.join(analysed.select(project).distinct(), project, "left_semi").join(
        nodes.select(F.col("name").alias("node"), "level"), "node")
    per = v.groupBy(project, "level").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("node", F.round("value", 6)))))).alias("values"))
    part = F.concat(F.lit('"'), "level", F.lit('":'), "values")
    return per.groupBy(project).agg(F.concat(
        F.lit("{"), F.array_join(F.sort_array(F.collect_list(part)), ","), F.lit("}")).alias("report"))
