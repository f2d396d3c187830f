"""Labels joined to items: training rows, flags, gaps and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.operators.windows import first_rows


def _trimmed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.trim(name)).filter(F.col(name) != "")


def label_join(items: DataFrame, labels: DataFrame, keys: Sequence[str], name: str, answer: str,
               order: Sequence[str]) -> DataFrame:
    """Items with a 0/1 label: first label of equal (keys, trimmed name), blank names out."""
    one = first_rows(_trimmed(labels, name).select(*keys, name, answer, *[c for c in order if c not in (*keys, name, answer)]),
                     [*keys, name], order)
    return (_trimmed(items, name).join(one.select(*keys, name, answer), [*keys, name])
            .withColumn("label", (F.lower(F.col(answer)) == "yes").cast("int")).drop(answer))


def flag_items(items: DataFrame, predicted: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct items with Yes when predicted, No otherwise."""
    hits = predicted.select(*keys, name).distinct().withColumn("_hit", F.lit(1))
    return (items.select(*keys, name).distinct().join(hits, [*keys, name], "left")
            .withColumn("flag", F.when(F.col("_hit").isNotNull(), F.lit("Yes")).otherwise(F.lit("No"))).drop("_hit"))


def combine_labelled(items: DataFrame, labels: DataFrame, graphs: DataFrame, keys: Sequence[str],
                     name: str, graph: str) -> DataFrame:
    """Items with yes/no by presence in the labels, and their merged graph or an empty one."""
    known = labels.select(*keys, name).distinct().withColumn("_hit", F.lit(1))
    one = graphs.groupBy(*keys, name).agg(F.min(graph).alias(graph))
    return (items.join(known, [*keys, name], "left").join(one, [*keys, name], "left")
            .withColumn("is_sensitive", F.when(F.col("_hit").isNotNull(), F.lit("yes")).otherwise(F.lit("no")))
            .withColumn(graph, F.coalesce(graph, F.array())).drop("_hit"))


def unlabelled_items(items: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    return items.join(labels.select(*on).distinct(), list(on), "left_anti")


def fill_missing_items(graphs: DataFrame, items: DataFrame, on: Sequence[str],
                       context: DataFrame) -> DataFrame:
    """Graph rows, and a one-node row for each item that has none.

    ``graphs(on, node, type, context, next_node)``; ``context(on, context)`` holds the lines
    that use the item.
    """
    gone = items.select(*on).distinct().join(graphs.select(*on).distinct(), list(on), "left_anti")
    filler = gone.join(context, list(on), "left").select(
        *on, F.col(on[-1]).alias("node"), F.lit("variable").alias("type"),
        F.coalesce("context", F.lit("")).alias("context"), F.lit("end").alias("next_node"))
    return graphs.select(*filler.columns).unionByName(filler)


def item_gaps(graphs: DataFrame, items: DataFrame, file_col: str, name: str) -> DataFrame:
    """Files whose number of graphed items is not the number of parsed items."""
    a = items.groupBy(file_col).agg(F.countDistinct(name).alias("parsed"))
    b = graphs.groupBy(file_col).agg(F.countDistinct(name).alias("graphed"))
    return (a.join(b, file_col, "left").withColumn("graphed", F.coalesce("graphed", F.lit(0)))
            .filter("parsed <> graphed"))


def merge_label_sets(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Union of two label tables, one row per (keys, name) with the number of mentions."""
    return (a.select(*keys, name).unionByName(b.select(*keys, name))
            .groupBy(*keys, name).agg(F.count(F.lit(1)).alias("mentions")))


def label_arrays(merged: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One array per key, for the reply of a training pair."""
    return merged.groupBy(*keys).agg(F.sort_array(F.collect_set(name)).alias("names"))


def training_pairs(prompts: DataFrame, labels: DataFrame, keys: Sequence[str], limit: int,
                   system: str, tokens: Column | None = None) -> DataFrame:
    """prompt with reply as JSON messages; unlabelled and oversized prompts are out.

    ``prompts(keys, prompt)`` and ``labels(keys, names)``.
    """
    j = prompts.join(labels, list(keys)).filter(F.size("names") > 0)
    reply = F.to_json(F.struct(F.col("names")))
    message = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
        F.struct(F.lit("assistant").alias("role"), reply.alias("content")))
    size = tokens if tokens is not None else F.size(F.split("prompt", r"\s+"))
    return j.filter(size <= limit).select(*keys, F.to_json(F.struct(message.alias("messages"))).alias("line"))


def pair_counts(prompts: DataFrame, pairs: DataFrame) -> DataFrame:
    """included and total prompts."""
    marks = pairs.select(F.lit(1).alias("included")).unionByName(prompts.select(F.lit(0).alias("included")))
    return marks.agg(F.count_if(F.col("included") == 1).alias("included"),
                     F.count_if(F.col("included") == 0).alias("total"))


def combine_formats(a: DataFrame, b: DataFrame, on: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Left rows with the arrays of the right ones; empty arrays where there are none."""
    return a.join(b.select(*on, *arrays), list(on), "left").select(
        *a.columns, *[F.coalesce(c, F.array().cast(b.schema[c].dataType)).alias(c) for c in arrays])


def path_lookup(items: DataFrame, tree: DataFrame, name: str = "file_name", path: str = "path") -> DataFrame:
    """Items with the path of their file; unknown files drop out; of equal names the smallest path."""
    one = tree.groupBy(name).agg(F.min(path).alias(path))
    return items.join(one, name)


def relation_rows(items: DataFrame, file_col: str, name: str, wanted: Column | None = None) -> DataFrame:
    """Rows of the sensitive relation from kept items, from labels, or from all items."""
    df = items if wanted is None else items.filter(wanted)
    return df.select(F.col(file_col).alias("file_name"), F.col(name).alias("name")).distinct()


def label_conflicts(sinks: DataFrame, kind: str = "type", answer: str = "is_sensitive") -> DataFrame:
    """Typed sinks labelled No, and sinks labelled Yes without a type."""
    typed = F.coalesce(F.col(kind), F.lit("N/A")) != "N/A"
    return sinks.withColumn("conflict", F.when((F.col(answer) == "No") & typed, F.lit("conflicting")).when(
        (F.col(answer) == "Yes") & ~typed, F.lit("missing type"))).filter("conflict IS NOT NULL")
