"""Derived steps and exceptions carried up the call graph."""

import random

from plainsight.operators import reach as R
from plainsight.operators import steps as ST
from plainsight.session import fixed_table

TYPES = [("Locked", "Access"), ("Access", "Error"), ("Data", "Error")]


def brute(throws, uses, calls, levels):
    up = {}
    for t, s in TYPES:
        up.setdefault(t, set()).add(s)

    def takes(thrown, caught):
        return thrown == caught or any(takes(s, caught) for s in up.get(thrown, ()))
    pairs = {(n, u) for n, c, _ in throws for u, d, _ in uses if c == d}
    for node, start, thrown in throws:
        front, seen, level = {start}, {start}, 0
        while front and (levels is None or level < levels):
            level += 1
            fresh = set()
            for caller, callee in calls:
                if callee in front:
                    hit = [u for u, c, kind in uses if c == caller and takes(thrown, kind)]
                    pairs |= {(node, u) for u in hit}
                    if not hit:
                        fresh.add(caller)
            front = fresh - seen
            seen |= fresh
    return sorted(pairs)


def test_exceptions_equal_brute_force(spark):
    rng = random.Random(5)
    kinds = ["Locked", "Access", "Data", "Error", "Other"]
    closure = R.type_closure(fixed_table(spark, ["type", "super_type"], TYPES))
    calls = [(rng.randrange(12), rng.randrange(12)) for _ in range(25)]  # with recursion
    throws = [(f"t{i}", rng.randrange(12), rng.choice(kinds)) for i in range(15)]
    uses = [(f"u{i}", rng.randrange(12), rng.choice(kinds)) for i in range(10)]
    for levels in (1, None):
        edges = ST.exception_steps(spark.createDataFrame(throws, "node string, callable_id long, type string"),
                                   spark.createDataFrame(uses, "node string, callable_id long, type string"),
                                   spark.createDataFrame(calls, "caller_id long, callee_id long"), closure, deep=levels is None)
        edges = [(r["src"], r["dst"]) for r in edges.collect()]
        after = {}
        for a, b in edges:
            after.setdefault(a, set()).add(b)
        got = set()
        for node, _, _ in throws:
            todo, seen = [node], set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            got |= {(node, x) for x in seen if x.startswith("u")}
        assert sorted(got) == brute(throws, uses, calls, levels), levels


def test_nothing_thrown(spark):
    empty = spark.createDataFrame([], "node string, callable_id long, type string")
    uses = spark.createDataFrame([("u", 1, "Error"), ("v", None, None)], "node string, callable_id long, type string")
    calls = spark.createDataFrame([(1, 2)], "caller_id long, callee_id long")
    closure = R.type_closure(fixed_table(spark, ["type", "super_type"], TYPES))
    assert ST.exception_steps(empty, uses, calls, closure).collect() == []
    lone = spark.createDataFrame([("t", None, "Error"), ("s", 3, None)], "node string, callable_id long, type string")
    assert ST.exception_steps(lone, uses, calls, closure).filter("last").collect() == []


def test_steps_without_their_columns(spark):
    nodes = spark.createDataFrame([(1, "call_arg", "a", "T", 1)], "id long, kind string, callee string, decl_type string, callable_id long")
    rule = ST.StepRule("argument", "TRUE", "call_id", "kind = 'call'", "id")
    assert ST.derived_steps(nodes, [rule]).collect() == []


def test_hubs_keep_edges_linear(spark):
    rows = [(i, "return", 5, None) for i in range(40)] + [(100 + i, "call", 9, 5) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id long, kind string, callable_id long, target_id long")
    edges = ST.derived_steps(nodes, [ST.StepRule("return", "kind = 'return'", "callable_id", "kind = 'call'", "target_id")])
    assert edges.count() == 80 and edges.filter("last").count() == 40
