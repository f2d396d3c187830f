"""Extra flow steps derived from typed fact columns, and exceptions that travel up the call graph.

A step leads from every tail to every head with an equal key.  Where one side's key is the node itself the
step is an edge; otherwise all rows of a key share one hub, so that edges stay linear in the rows.  Edges are
``(src, dst, kind, last)`` with text ids; ``last`` is false on the way into a hub.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.operators.reach import FOLD_EVERY, _rounds
from plainsight.session import cut_lineage

#: Columns of fact nodes that steps read; facts without one have none of its steps.
STEP_COLUMNS = {"qualifier_id": "bigint", "call_id": "bigint", "target_id": "bigint", "throw_id": "bigint",
                "expr_id": "bigint", "annotated": "int"}


@dataclass(frozen=True)
class StepRule:
    """Rows that match ``tails`` lead to rows that match ``heads`` where the keys are equal."""

    kind: str
    tails: str
    tail_key: str
    heads: str
    head_key: str


def with_step_columns(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({c: F.lit(None).cast(t) for c, t in STEP_COLUMNS.items() if c not in nodes.columns})


def _text(*columns: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def _hub(name: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(name), *[F.col(c).cast("string") for c in columns])


def _edge(src: Column, dst: Column, kind: str, last: bool) -> list[Column]:
    return [src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("kind"), F.lit(last).alias("last")]


def _through_hub(tails: DataFrame, heads: DataFrame, on: Sequence[str], kind: str) -> DataFrame:
    """tails(node, on) to heads(node, on) by way of a hub per group that both sides have."""
    on = list(on)
    hub = _hub(f"hub:{kind}", *on)
    into = tails.join(heads.select(*on).distinct(), on, "left_semi").select(*_edge(F.col("node"), hub, kind, False))
    out = heads.join(tails.select(*on).distinct(), on, "left_semi").select(*_edge(hub, F.col("node"), kind, True))
    return into.unionByName(out).distinct()


def derived_steps(nodes: DataFrame, rules: Sequence[StepRule]) -> DataFrame:
    """Edges of all rules over ``nodes(id, …)``; rows without a key take no part."""
    n, out = with_step_columns(nodes), None
    for rule in rules:
        tails = n.filter(rule.tails).select(F.col(rule.tail_key).alias("_key"), F.col("id").alias("node")).filter("_key IS NOT NULL")
        heads = n.filter(rule.heads).select(F.col(rule.head_key).alias("_key"), F.col("id").alias("node")).filter("_key IS NOT NULL")
        if "id" in (rule.tail_key, rule.head_key):
            ends = heads.withColumnRenamed("node", "_head")
            edges = tails.join(ends, "_key").select(*_edge(F.col("node"), F.col("_head"), rule.kind, True)).distinct()
        else:
            edges = _through_hub(tails, heads, ["_key"], rule.kind)
        out = edges if out is None else out.unionByName(edges)
    return out


def catch_uses(nodes: DataFrame) -> DataFrame:
    """(node, callable_id, type): accesses of a catch variable, and getMessage calls on one."""
    n = with_step_columns(nodes)
    caught = n.filter("kind = 'catch_var'").select(F.col("id").alias("node"), "callable_id", F.col("decl_type").alias("type"))
    asked = (n.filter("kind = 'call' AND callee = 'getMessage'").select(F.col("id").alias("asking"), F.col("qualifier_id").alias("node"))
             .join(caught, "node").select(F.col("asking").alias("node"), "callable_id", "type"))
    return caught.unionByName(asked)


def exception_steps(throws: DataFrame, uses: DataFrame, calls: DataFrame, closure: DataFrame, *,
                    deep: bool = True) -> DataFrame:
    """From thrown expressions to the uses of the caught exception.

    ``throws(node, callable_id, type)``, ``uses(node, callable_id, type)`` of a catch variable of that type,
    ``calls(caller_id, callee_id)``, ``closure(type, super_type)``.  Inside one callable every throw leads to
    every use (kind ``throw``).  Beyond it (kind ``throw_caller``) a pair of callable and thrown type is carried
    up the call graph; in a caller with a catch clause of the type or of a supertype it leads to the uses of that
    clause and goes no further.  Without ``deep`` only direct callers are looked at; pairs already seen end recursion.
    Work grows with the pairs, not with throws times catches.
    """
    inside = _through_hub(throws, uses, ["callable_id"], "throw")
    pairs = throws.filter("callable_id IS NOT NULL AND type IS NOT NULL").select("callable_id", "type").distinct()
    used = uses.filter("callable_id IS NOT NULL AND type IS NOT NULL").select("node", "callable_id", F.col("type").alias("caught"))
    clauses = used.select("callable_id", "caught").distinct()
    up = calls.select(F.col("callee_id").alias("callable_id"), F.col("caller_id").alias("caller")).distinct()
    above = closure.select("type", F.col("super_type").alias("caught"))

    def caught_by(arrived: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of ``right`` in the arrived callables that take the arrived type."""
        met = arrived.join(right, "callable_id")
        return met.filter("type = caught").unionByName(met.filter("type <> caught").join(above, ["type", "caught"], "left_semi"))

    kind, edges = "throw_caller", None
    seen = front = cut_lineage(pairs)
    taken = None
    for i in _rounds(None):
        moved = cut_lineage(front.join(up, "callable_id").select("callable_id", "type", "caller"))
        arrived = moved.select(F.col("caller").alias("callable_id"), "type").distinct()
        stop = cut_lineage(caught_by(arrived, clauses).select("callable_id", "type").distinct())
        there = stop.select(F.col("callable_id").alias("caller"), "type")
        here = _hub("thrown", "callable_id", "type")
        step = moved.join(there, ["caller", "type"], "left_semi").select(*_edge(here, _hub("caught", "caller", "type"), kind, False))
        taken = stop if taken is None else taken.unionByName(stop)
        rest = moved.join(there, ["caller", "type"], "left_anti")
        if deep:
            step = step.unionByName(rest.select(*_edge(here, _hub("thrown", "caller", "type"), kind, False)))
        edges = step if edges is None else edges.unionByName(step)
        if not deep:
            break
        front = cut_lineage(rest.select(F.col("caller").alias("callable_id"), "type").distinct()
                            .join(seen, ["callable_id", "type"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if i % FOLD_EVERY == 0:
            seen, edges, taken = cut_lineage(seen), cut_lineage(edges), cut_lineage(taken.distinct())
    first = throws.filter("callable_id IS NOT NULL AND type IS NOT NULL").select(
        *_edge(F.col("node"), _hub("thrown", "callable_id", "type"), kind, False))
    last = caught_by(taken.distinct(), used).select(*_edge(_hub("caught", "callable_id", "type"), F.col("node"), kind, True))
    return inside.unionByName(first.unionByName(edges).unionByName(last).distinct())
