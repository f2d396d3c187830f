"""Reachability on hand-made graphs and against a breadth-first search."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plainsight.operators import reach as R

FORMS = ["frontier", "doubling"]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("source", "sink").collect())


def brute(es, sources, sinks, barriers=(), barrier_in=False):
    out = set()
    for s in set(sources) - set(barriers):
        seen, todo = {s}, deque([s])
        while todo:
            a = todo.popleft()
            for x, y in es:
                if x == a and y not in seen and y not in barriers and not (barrier_in and y in sources):
                    seen.add(y)
                    todo.append(y)
        out |= {(s, t) for t in seen if t in sinks}
    return sorted(out)


# 1-2-3 straight; 10-11(b)-12 cut; 20-21-22-20 cycle; 30-{31,32}-33 diamond; 40 both; 50-51-52 sources in a row
GRAPH = [(1, 2), (2, 3), (10, 11), (11, 12), (20, 21), (21, 22), (22, 20), (22, 23), (30, 31), (30, 32), (31, 33),
         (32, 33), (50, 51), (51, 52)] + [(60, 61)] + [(61, 100 + i) for i in range(40)]
SOURCES = [1, 10, 20, 30, 40, 50, 51, 60]
SINKS = [3, 12, 23, 33, 40, 52, 117]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("barrier_in", [False, True])
def test_cases(spark, form, barrier_in):
    got = R.reach(edges(spark, GRAPH), nodes(spark, SOURCES), nodes(spark, SINKS), nodes(spark, [11]),
                  form=form, barrier_in=barrier_in)
    want = brute(GRAPH, SOURCES, SINKS, {11}, barrier_in)
    assert pairs(got) == want
    assert (40, 40) in want and (10, 12) not in want and (20, 23) in want
    assert ((50, 52) in want) is not barrier_in


@pytest.mark.parametrize("form", FORMS)
def test_random_graphs(spark, form):
    rng = random.Random(3)
    es = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    s, t, b = ([rng.randrange(30) for _ in range(8)] for _ in range(3))
    b = b[:3]
    got = R.reach(edges(spark, es), nodes(spark, s), nodes(spark, t), nodes(spark, b), form=form, hub_salt=3)
    assert pairs(got) == brute(es, s, set(t), set(b))


def test_many_searches_in_one_loop(spark):
    src = nodes(spark, [1]).withColumn("rule", F.lit("a")).union(nodes(spark, [30]).withColumn("rule", F.lit("b")))
    snk = nodes(spark, [3]).withColumn("rule", F.lit("a")).union(nodes(spark, [3, 33]).withColumn("rule", F.lit("b")))
    for form in FORMS:
        got = R.reach(edges(spark, GRAPH), src, snk, by=["rule"], form=form)
        assert sorted(map(tuple, got.collect())) == [("a", 1, 3), ("b", 30, 33)]


@pytest.mark.parametrize("form", FORMS)
def test_states(spark, form):
    es = edges(spark, [(1, 2), (2, 3), (3, 4), (11, 12), (12, 13)])
    moves = spark.createDataFrame([(1, 1, 2, 2), (2, 2, 3, 3), (11, 1, 12, 2)], "src long, s1 int, dst long, s2 int")
    got = R.reach_states(es, moves, nodes(spark, [1, 11]), nodes(spark, [4, 13]), form=form)
    assert [(int(a), int(b)) for a, b in pairs(got)] == [(1, 4)]


def test_states_with_rules(spark):
    es = edges(spark, [(1, 2), (2, 3), (3, 4)])
    moves = spark.createDataFrame([("a", 1, 1, 2, 2), ("a", 2, 2, 3, 3), ("b", 1, 1, 2, 2)],
                                  "rule string, src long, s1 int, dst long, s2 int")
    both = [("a",), ("b",)]
    rules = spark.createDataFrame(both, "rule string")
    got = R.reach_states(es, moves, rules.withColumn("node", F.lit(1).cast("long")),
                         rules.withColumn("node", F.lit(4).cast("long")), by=["rule"])
    assert [tuple(r) for r in got.collect()] == [("a", 1, 4)]


@pytest.mark.parametrize("form", FORMS)
def test_states_of_many_searches(spark, form):
    es = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 3), (7, 8)])
    moves = spark.createDataFrame([("a", 1, 1, 2, 2), ("a", 4, 2, 5, 3), ("b", 2, 1, 3, 2), ("b", 5, 3, 6, 3), ("b", 3, 2, 4, 3), ("c", 7, 1, 8, 2)],
                                  "rule string, src long, s1 int, dst long, s2 int")
    rules = spark.createDataFrame([("a",), ("b",), ("c",)], "rule string")
    at = lambda *ids: rules.crossJoin(nodes(spark, ids))
    got = R.reach_states(es, moves, at(1, 7), at(3, 6, 8), by=["rule"], form=form)
    assert sorted((r["rule"], int(r["source"]), int(r["sink"])) for r in got.collect()) == [("a", 1, 3), ("b", 1, 3), ("b", 1, 6)]


def test_changes_that_follow_each_other_take_one_round(spark, monkeypatch):
    # source 1, changes 2 > hub 20 > 21 > hub 22 > 3 without an edge between them, sink 4; 30 goes round in a circle of changes
    es = edges(spark, [(1, 2), (3, 4), (5, 6)])
    moves = spark.createDataFrame([(2, 1, 20, 2), (20, 2, 21, 2), (21, 2, 22, 2), (22, 2, 3, 3), (30, 1, 31, 1), (31, 1, 30, 1), (30, 1, 4, 3), (1, 1, 5, 3)],
                                  "src long, s1 int, dst long, s2 int")
    tables, real = [], R.written
    monkeypatch.setattr(R, "written", lambda df: tables.append(1) or real(df))
    counts = []
    for ahead in (1, 3):
        tables.clear()
        got = R.reach_states(es, moves, nodes(spark, [1, 30]), nodes(spark, [4]), form="doubling", ahead=ahead)
        assert [(int(a), int(b)) for a, b in pairs(got)] == [(1, 4), (30, 4)]
        counts.append(len(tables))
    assert counts[1] < counts[0]


def test_searches_share_walks(spark):
    es, barriers = edges(spark, GRAPH), nodes(spark, [11])
    walks = R.doubled_walks(R.without_barriers(es, barriers))
    got = R.reach(es, nodes(spark, SOURCES), nodes(spark, SINKS), barriers, form="doubling", walks=walks)
    assert pairs(got) == brute(GRAPH, SOURCES, SINKS, {11})


def test_limit_is_an_error(spark):
    chain = edges(spark, [(i, i + 1) for i in range(9)])
    with pytest.raises(RuntimeError):
        R.reach(chain, nodes(spark, [0]), nodes(spark, [9]), max_iter=3)


def test_paths(spark):
    got = R.paths(edges(spark, GRAPH + [(33, 30)]), nodes(spark, [30]), nodes(spark, [33]))
    assert sorted(r["path"] for r in got.collect()) == [[30, 31, 33], [30, 32, 33]]
    one = R.paths(edges(spark, GRAPH), nodes(spark, [30]), nodes(spark, [33]), max_paths=1)
    assert [r["path"] for r in one.collect()] == [[30, 31, 33]]


def test_path_limit_holds_for_finished_paths_only(spark):
    graph = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 2), (6, 2), (2, 7), (7, 8), (4, 9), (9, 10), (10, 11), (11, 8)]
    for limit, n in ((1, 1), (2, 2), (3, 2)):
        assert R.paths(edges(spark, graph), nodes(spark, [1]), nodes(spark, [8]), max_paths=limit).count() == n


@pytest.mark.parametrize("seed", range(3))
def test_paths_like_brute_force(spark, seed):
    rng = random.Random(seed)
    graph = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(14)})
    starts, stops = [0, 1], [1, 5, 6]

    def walks(path):
        if path[-1] in stops:
            yield path
        for a, b in graph:
            if a == path[-1] and b not in path:
                yield from walks([*path, b])
    for limit in (1, 2, 100):
        want = {}
        for p in sorted((p for s in starts for p in walks([s])), key=lambda p: (len(p), p)):
            want.setdefault((p[0], p[-1]), []).append(p)
        got = {}
        for r in R.paths(edges(spark, graph), nodes(spark, starts), nodes(spark, stops), max_paths=limit).collect():
            got.setdefault((r["source"], r["sink"]), []).append(r["path"])
        assert {k: sorted(v, key=lambda p: (len(p), p)) for k, v in got.items()} == {k: v[:limit] for k, v in want.items()}


def test_paths_of_single_ways_follow_doubled_walks(spark):
    # two chains that meet, a cycle with a way in, nodes without edges
    chains = [(i, i + 1) for i in range(19)] + [(30, 31), (31, 12)] + [(40, 41), (41, 42), (42, 43), (43, 41)]
    starts, stops, barred = [0, 3, 30, 40, 42, 50, 7], [2, 5, 12, 18, 41, 43, 50, 3], {9}
    after = {a: b for a, b in chains if b not in barred}
    want = set()
    for s in starts:
        path = [s]
        while path:
            if path[-1] in stops:
                want.add((s, path[-1], tuple(path)))
            step = after.get(path[-1])
            path = [*path, step] if step is not None and step not in path else []
    spark.sparkContext.setJobGroup("single-ways", "single-ways")
    got = R.paths(edges(spark, chains), nodes(spark, starts), nodes(spark, stops), nodes(spark, barred), form="doubling")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("single-ways"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = [(r["source"], r["sink"], tuple(r["path"])) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    # a round for every step of the longest path took over 60 jobs
    assert jobs < 45
    # two ways on: as before
    both = R.paths(edges(spark, [*chains, (3, 5), (3, 4)]), nodes(spark, [3]), nodes(spark, [5]), form="doubling")
    assert sorted(r["path"] for r in both.collect()) == [[3, 4, 5], [3, 5]]


def test_long_chain_needs_no_limit(spark):
    chain = edges(spark, [(i, i + 1) for i in range(30)])
    assert R.reach(chain, nodes(spark, [0]), nodes(spark, [30])).count() == 1


def test_closure_containment_callers(spark):
    types = spark.createDataFrame([("C", "B"), ("B", "A")], "type string, super_type string")
    assert sorted(map(tuple, R.type_closure(types).collect())) == [
        ("A", "A"), ("B", "A"), ("B", "B"), ("C", "A"), ("C", "B"), ("C", "C")]
    assert R.type_closure(types, reflexive=False).count() == 3
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long")
    assert sorted(map(tuple, R.containment(tree, nodes(spark, [1])).collect())) == [(2, 1), (3, 1)]
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8)], "caller_id long, callee_id long")
    got = R.transitive_callers(calls, nodes(spark, [3]))
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3), (3, 3)]


def test_hub_steps_reach_like_all_pairs(spark):
    tails = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "node long, callable_id long")
    heads = spark.createDataFrame([(4, 7), (5, 7), (6, 9)], "node long, callable_id long")
    hubs = R.hub_steps(tails, heads, ["callable_id"], "throw")
    assert hubs.count() == 4
    text = lambda df: df.select(F.col("node").cast("string").alias("node"))
    assert pairs(R.reach(hubs, text(tails), text(heads))) == [("1", "4"), ("1", "5"), ("2", "4"), ("2", "5")]


def test_discrepancies_match_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(25), rng.randrange(3), rng.choice("ab")) for _ in range(60)]
    calls = spark.createDataFrame(rows, "switch int, case_no int, method string")
    want = sorted({a[0] for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] != b[2]})
    none = calls.withColumn("argument", F.lit("")).limit(0)
    assert sorted(r[0] for r in R.switch_discrepancies(calls, none).collect()) == want
    prints = calls.select("switch", "case_no", F.lit("println").alias("method"), F.col("method").alias("argument"))
    assert sorted(r[0] for r in R.switch_discrepancies(calls.limit(0), prints).collect()) == want
    out, inn = calls.filter("case_no = 0"), calls.filter("case_no > 0")
    got = R.nested_discrepancies(out.selectExpr("switch AS outer", "method AS message"), inn.selectExpr("switch AS outer", "method AS message"))
    want = sorted({a[0] for a in rows for b in rows if a[0] == b[0] and a[1] == 0 and b[1] > 0 and a[2] != b[2]})
    assert sorted(r[0] for r in got.collect()) == want


def test_marks_along_doubled_walks(spark):
    rng = random.Random(12)
    for edges in ([(i, i + 1) for i in range(21)] + [(3, 30), (30, 31)], [(rng.randrange(12), rng.randrange(12)) for _ in range(14)], [(1, 1)]):
        e = spark.createDataFrame(edges, "src long, dst long")
        walks = R.doubled_walks(e)
        starts = [(5, "x"), (0, "y"), (99, "y")]
        for back in (False, True):
            after = {}
            for a, b in edges:
                after.setdefault(b if back else a, set()).add(a if back else b)
            want = set()
            for node, name in starts:
                todo, seen = [node], set()
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += after.get(x, ())
                want |= {(name, x) for x in seen}
            got = R.reach_along(walks, spark.createDataFrame(starts, "node long, name string"), ["name"], back)
            assert {(r["name"], r["node"]) for r in got.collect()} == want


def test_marks_need_no_walks_through_a_start(spark, monkeypatch):
    made, plain = [], R.doubled_walks
    monkeypatch.setattr(R, "doubled_walks", lambda *a, **o: made.append(plain(*a, **o)) or made[-1])
    chain, starts = [(i, i + 1) for i in range(64)], list(range(8, 64, 4))
    got = R.reach_nodes(edges(spark, [*chain, (None, 12), (70, None)]), nodes(spark, [*starts, starts[0], None]), form="doubling")
    assert sorted(r.node for r in got.filter("node IS NOT NULL").collect()) == list(range(8, 65))
    assert sum(w.filter("src >= 8").count() for w in made[0]) < 2 * len(chain) and got.filter("node IS NULL").count() == 1
