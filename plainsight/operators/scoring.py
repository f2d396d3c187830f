"""Scores, prompts and replies around a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.functions.text import join_name_context, json_from_reply, yes_no_from_reply  # noqa: F401
from plainsight.operators.windows import with_next
from plainsight.plans.catalog import SINK_CLASSES, THRESHOLDS


def attach_context(items: DataFrame, methods: DataFrame, file_cols: Sequence[str], name: str = "name") -> DataFrame:
    """"Type: t, Context: " and the code of the item's methods in their order.

    ``items(file, category, name, type, methods)``; method texts follow each other directly, a method
    without code adds nothing, and comments have no context.
    """
    keys = [*file_cols, "category", name, "type"]
    spread = items.select(*keys, F.posexplode_outer("methods").alias("pos", "method"))
    j = spread.join(methods, [*file_cols, "method"], "left")
    packed = F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code"))))
    out = j.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["code"]), "").alias("code"))
    kind = F.when(F.col("type").isNotNull(), F.concat(F.lit("Type: "), "type", F.lit(", "))).otherwise(F.lit(""))
    context = F.when(F.col("category") != "comments", F.concat(kind, F.lit("Context: "), "code"))
    return out.withColumn("context", context).drop("code")


def concat_vectors(a, b) -> Column:
    return F.concat(a, b)


def score_batches(df: DataFrame, score: Callable[[np.ndarray], np.ndarray], vector: str, keep: Sequence[str],
                  out: str = "score", batch: int = 64) -> DataFrame:
    """Model scores in Arrow batches; ``score`` maps a matrix to one number per row.

    The model travels once with the function, not with every row.
    """
    fields = [df.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            parts = [score(np.stack(frame[vector].iloc[i:i + batch].to_numpy()).astype(np.float64))
                     for i in range(0, len(frame), batch)]
            yield frame[list(keep)].assign(**{out: np.concatenate(parts)})
    return df.select(*keep, vector).mapInPandas(run, schema)


def softmax(logits) -> Column:
    col = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(col)
    raw = F.transform(col, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def argmax(vector) -> Column:
    """0-based place of the largest value, the first of equals."""
    col = F.col(vector) if isinstance(vector, str) else vector
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def sink_type_label(class_no) -> Column:
    names = F.array(*[F.lit(x) for x in SINK_CLASSES])
    col = F.col(class_no) if isinstance(class_no, str) else class_no
    return F.try_element_at(names, (col + 1).cast("int"))


def sink_type_number(label) -> Column:
    pairs = [F.lit(x) for i, name in enumerate(SINK_CLASSES) for x in (name, i)]
    return F.try_element_at(F.create_map(*pairs), F.col(label) if isinstance(label, str) else label)


def keep_confident(df: DataFrame, category: str = "category", confidence: str = "confidence",
                   sink_class: str | None = "sink_class", thresholds: dict | None = None,
                   sink_threshold: bool = False) -> DataFrame:
    """Items at or above the cut-off of their category.

    A sink is kept when its best class is not 0, whatever the confidence; with
    ``sink_threshold`` its cut-off counts too.
    """
    cut = F.create_map(*[F.lit(x) for pair in (thresholds or THRESHOLDS).items() for x in pair])
    above = F.col(confidence) >= F.try_element_at(cut, F.col(category))
    if sink_class is None:
        return df.filter(above)
    is_sink = F.col(category) == "sinks"
    sink = F.col(sink_class) != 0
    return df.filter(F.when(is_sink, sink & above if sink_threshold else sink).otherwise(above))


def segments(df: DataFrame, key: str, tokens: str, n: int = 512) -> DataFrame:
    """Token lists cut into pieces of at most n."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens)), F.lit(n))
    return df.select(key, F.posexplode(F.transform(starts, lambda s: F.slice(F.col(tokens), s, F.lit(n)))).alias("segment", "piece"))


def segment_pool(df: DataFrame, key: str, tokens: str, encode: Callable[[list], np.ndarray], n: int = 512) -> DataFrame:
    """Each piece encoded, then averaged element by element per key."""
    pieces = segments(df, key, tokens, n)
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = encode([np.asarray(p) for p in frame["piece"]])
                yield pd.DataFrame({key: frame[key].to_numpy(), "vector": [list(map(float, v)) for v in vectors]})
    encoded = pieces.mapInPandas(run, f"`{key}` {kind}, vector array<double>")
    mean = encoded.select(key, F.posexplode("vector").alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("pooled"))


def build_prompts(items: DataFrame, templates: DataFrame) -> DataFrame:
    """One prompt per item: its category's template with {kind}, {name}, {file}, {context} filled."""
    j = items.join(templates, "category")
    p = F.col("template")
    kind = F.expr("substring(category, 1, length(category) - 1)")
    for mark, value in (("{kind}", kind), ("{name}", F.col("name")), ("{file}", F.col("file_name")), ("{context}", F.trim("context"))):
        p = F.replace(p, F.lit(mark), value)
    return j.select("file_name", "category", "name", p.alias("prompt"))


REPLY_ITEM = "ARRAY<STRUCT<name STRING, type STRING, isSensitive STRING, isSink STRING, reason STRING>>"
REPLY = (f"files ARRAY<STRUCT<fileName STRING, variables {REPLY_ITEM}, strings {REPLY_ITEM}, "
         f"comments {REPLY_ITEM}, sinks {REPLY_ITEM}>>")


def ingest_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies whose file and item are those asked for, one per request."""
    r = replies.withColumn("_f", F.try_element_at(json_from_reply("reply", REPLY)["files"], F.lit(1)))
    item = None
    for cat in ("variables", "strings", "comments", "sinks"):
        first = F.try_element_at(F.col(f"_f.{cat}"), F.lit(1))
        item = F.when(F.col("category") == cat, first) if item is None else item.when(F.col("category") == cat, first)
    r = r.withColumn("_i", item)
    same = (F.col("_f.fileName") == F.col("file_name")) & (F.col("_i.name") == F.col("value_name"))
    answer = F.when(F.col("category") == "sinks", F.col("_i.isSink")).otherwise(F.col("_i.isSensitive"))
    good = r.filter(same).select("file_name", F.col("value_name").alias("name"), "category",
                                 F.col("_i.type").alias("type"), answer.alias("answer"))
    one = good.groupBy("file_name", "category", "name").agg(F.min(F.struct("answer", "type")).alias("_a"))
    return requests.join(one, ["file_name", "category", "name"]).select(
        *requests.columns, "_a.answer", "_a.type")


def merge_flow_graph(flows: DataFrame, lone: DataFrame | None = None, keys: Sequence[str] = ("variable", "file_name")) -> DataFrame:
    """Flows of one variable and file merged: equal node names collapse, contexts are gathered
    once each, the last next node counts, the last node of a flow leads to ``end``.

    ``flows(keys, flow_no, step, node, type, context)``; ``lone`` holds variables without a flow,
    used only for keys the flows do not have.
    """
    keys = list(keys)
    cols = [*keys, "flow_no", "step", "node", "type", "context"]
    f = flows.select(*cols)
    if lone is not None:
        f = f.unionByName(lone.select(*cols).join(f.select(*keys).distinct(), keys, "left_anti"))
    f = with_next(f, [*keys, "flow_no"], ["step"], F.expr("step DIV 1000"), {"next_node": "node"})
    at = F.struct("flow_no", "step")
    seen = f.groupBy(*keys, "node", "context").agg(F.min(at).alias("_at"))
    contexts = seen.groupBy(*keys, "node").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", "context"))), lambda x: x["context"]), " | ").alias("context"))
    nodes = f.groupBy(*keys, "node").agg(
        F.min(at).alias("_first"), F.min_by("type", at).alias("type"),
        F.max_by(F.coalesce("next_node", F.lit("end")), at).alias("next_node"))
    return nodes.join(contexts, [*keys, "node"]).select(*keys, "node", "type", "context", "next_node",
                                                       F.col("_first.flow_no").alias("flow_no"), F.col("_first.step").alias("step"))


def graph_context(graph, variable) -> Column:
    """Node types and first argument texts of a merged graph, as one string."""
    def text(n):
        arg = F.when(n["name"].contains("("), F.regexp_extract(n["name"], r"\(([^()]*)", 1)).otherwise(n["name"])
        own = F.trim(n["name"]) == F.trim(variable)
        return F.when(own, F.concat(n["type"], F.lit(" "))).otherwise(F.concat(n["type"], F.lit(" "), arg, F.lit(" ")))
    return F.array_join(F.transform(graph, text), "")
