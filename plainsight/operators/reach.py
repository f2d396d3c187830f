"""Reachability over node and edge tables, with barriers, states and path output.

``edges(src, dst)``, ``sources(node)``, ``sinks(node)`` and ``barriers(node)`` may be
of any size.  Barrier nodes leave the edge table before the loop, because a filter
cannot be pushed through it.  Each round is one distributed join whose result is
written to the shared checkpoint folder; only "is it empty" comes back to the driver.

Two forms give equal results:

* ``frontier``: one step per round from the nodes last reached.  For dense or cyclic
  graphs; as many rounds as the longest shortest path.
* ``doubling``: walks of length 2**k are composed from themselves and written, so the rounds
  are the logarithm of that length; searches then follow them in one job each.  For sparse,
  chain-like graphs, where the walks of one length are no more than the edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plainsight.session import cut_lineage, written

FOLD_EVERY = 8


def without_barriers(edges: DataFrame, barriers: DataFrame) -> DataFrame:
    """Edges that do not enter a barrier node.

    A search that starts outside the barriers then never stands on one, so edges leaving
    them need no second join.
    """
    cut = barriers.select(F.col("node").alias("_b")).distinct()
    return edges.join(cut, F.col("dst") == F.col("_b"), "left_anti")


def _rounds(most: int | None):
    """Round numbers from 1; without a limit the visited set ends the loop."""
    return itertools.count(1) if most is None else range(1, most + 1)


def _hub_join(left: DataFrame, edges: DataFrame, by: Sequence[str], hub_salt: int) -> DataFrame:
    """left.node = edges.src; with ``hub_salt`` the edges of one node go to that many tasks."""
    if hub_salt > 1:
        edges = edges.withColumn("_salt", F.pmod(F.xxhash64("dst"), F.lit(hub_salt)).cast("int"))
        left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(hub_salt - 1))))
        by = [*by, "_salt"]
    e = edges.select(F.col("src").alias("node"), *by, F.col("dst").alias("_to"))
    return left.join(e, ["node", *by])


def reach(edges: DataFrame, sources: DataFrame, sinks: DataFrame,
          barriers: DataFrame | None = None, *, by: Sequence[str] = (),
          barrier_in: bool = False, form: str = "frontier", max_iter: int | None = None,
          hub_salt: int = 1, prune: bool | None = None, walks: Sequence[DataFrame] | None = None) -> DataFrame:
    """Pairs (source, sink) joined by a path without barriers; a node reaches itself.

    ``by`` names columns (such as a rule id) carried by sources and sinks, and by the
    edges too where those have them: many searches then share one loop.  With
    ``barrier_in`` nothing flows into a source.  With ``prune`` (the default) a first search
    marks the nodes from which some sink can be reached, one row per node; the frontier form
    then follows pairs through those only, doubling follows the sources among them.
    ``walks`` are the ``doubled_walks`` of the edges without barriers, where the caller has them.
    """
    by = list(by)
    edge_by = [c for c in by if c in edges.columns]
    e = edges.select("src", "dst", *edge_by)
    src = sources.select(*by, "node").distinct()
    if barriers is not None:
        e = without_barriers(e, barriers)
        src = src.join(barriers.select("node").distinct(), "node", "left_anti")
    if barrier_in:
        if by and not edge_by:
            raise ValueError("barrier_in for several searches needs edges with the same by columns")
        entry = src.select(F.col("node").alias("dst"), *edge_by).distinct()
        e = e.join(entry, ["dst", *edge_by], "left_anti")
    if form == "doubling":
        ends = written(sinks.select(*by, "node").distinct())
        levels = doubled_walks(e, edge_by, hub_salt, max_iter) if walks is None else walks
        start = src.select(*by, F.col("node").alias("source"), "node")
        if prune is None or prune:
            start = start.join(reach_along(levels, ends, by, True, edge_by, hub_salt), [*by, "node"], "left_semi")
        start = written(start)
        if max_iter is not None and len(levels) >= max_iter:
            _still_growing(levels, start, by, edge_by, hub_salt, max_iter)
        return (reach_along(levels, start, [*by, "source"], False, edge_by, hub_salt)
                .join(ends, [*by, "node"], "left_semi").select(*by, "source", F.col("node").alias("sink")))
    e = cut_lineage(e)
    if prune is None or prune:
        useful = reach_nodes(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
                             sinks, form=form, max_iter=max_iter)
        e = cut_lineage(e.join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    start = cut_lineage(src.select(*by, F.col("node").alias("source"), "node"))
    found = _by_frontier(e, start, by, edge_by, max_iter, hub_salt)
    ends = sinks.select(*by, "node").distinct()
    return (found.join(ends, [*by, "node"], "left_semi")
            .select(*by, "source", F.col("node").alias("sink")))


def _step(left, edges, by, edge_by, hub_salt):
    return (_hub_join(left, edges, edge_by, hub_salt)
            .select(*by, "source", F.col("_to").alias("node")).distinct())


def _by_frontier(edges, start, by, edge_by, max_iter, hub_salt):
    """Sources that find nothing more leave the pairs that later rounds compare with."""
    done, live, front = [], start, start
    for i in _rounds(max_iter):
        front = written(_step(front, edges, by, edge_by, hub_salt).join(
            live, [*by, "source", "node"], "left_anti"))
        if front.isEmpty():
            for part in done:
                live = live.unionByName(part)
            return live
        live = live.unionByName(front)
        if i % FOLD_EVERY == 0 or i & (i - 1) == 0:
            going = front.select(*by, "source").distinct().withColumn("_going", F.lit(True))
            both = written(live.join(going, [*by, "source"], "left"))
            live = both.filter("_going").drop("_going")
            done.append(both.filter("_going IS NULL").drop("_going"))
    raise RuntimeError(f"reach: still growing after {max_iter} rounds")


def _still_growing(walks, start, by, edge_by, hub_salt, max_iter):
    """Raises if the last walks still lead to pairs that the shorter ones have not found."""
    keys = [*by, "source"]
    seen = written(reach_along(walks[:max_iter - 1], start, keys, False, edge_by, hub_salt))
    if not _step(seen, walks[max_iter - 1], by, edge_by, hub_salt).join(seen, [*keys, "node"], "left_anti").isEmpty():
        raise RuntimeError(f"reach: still growing after {max_iter} rounds")


def reach_nodes(edges: DataFrame, starts: DataFrame, *, by: Sequence[str] = (), form: str = "frontier",
                max_iter: int | None = None, walks: Sequence[DataFrame] | None = None) -> DataFrame:
    """Nodes reached from any start: one mark per node (and ``by`` columns of the starts), no pairs."""
    by = list(by)
    one = starts.select(*by, "node").distinct().withColumn("_all", F.lit(1))
    # one made-up source for all starts, of the type of the nodes
    found = one.select("_all", *by, F.lit("1").cast(one.schema["node"].dataType).alias("source"), "node")
    if form == "doubling":
        if walks is None and not by:
            # what is reached through a start is reached from that start: walks need not enter one
            edges = without_barriers(edges, starts)
        levels = doubled_walks(edges, max_iter=max_iter) if walks is None else walks
        if max_iter is not None and len(levels) >= max_iter:
            _still_growing(levels, found, ["_all", *by], [], 1, max_iter)
        return reach_along(levels, starts, by)
    return _by_frontier(cut_lineage(edges.select("src", "dst")), cut_lineage(found), ["_all", *by], [],
                        max_iter, 1).select(*by, "node")


def doubled_walks(edges: DataFrame, by: Sequence[str] = (), hub_salt: int = 1, max_iter: int | None = None) -> list[DataFrame]:
    """Ends of all walks of 1, 2, 4, … edges, each written once, for many searches over one chain-like graph.

    The list ends with the longest walks, after ``max_iter`` of them, or where a walk must pass an edge twice."""
    by = list(by)
    walk = written(edges.select("src", "dst", *by).distinct())
    n_edges = walk.count()
    out, length = [], 1
    while length <= n_edges and (max_iter is None or len(out) < max_iter) and not walk.isEmpty():
        out.append(walk)
        left = walk.select(F.col("src").alias("_from"), F.col("dst").alias("node"), *by)
        walk = written(_hub_join(left, walk, by, hub_salt).select(F.col("_from").alias("src"), F.col("_to").alias("dst"), *by).distinct())
        length *= 2
    return out


def reach_along(walks: Sequence[DataFrame], starts: DataFrame, by: Sequence[str] = (), back: bool = False,
                edge_by: Sequence[str] = (), hub_salt: int = 1) -> DataFrame:
    """Nodes reached from any start over ``doubled_walks``, in one job: a path is a sum of powers of two.

    The longest walks come first, as the fewest nodes have one: rows only grow with the last, short ones."""
    by, seen = list(by), starts.select(*by, "node").distinct()
    a, b = ("dst", "src") if back else ("src", "dst")
    for walk in reversed(walks):
        left, on = seen, ["node", *edge_by]
        step = walk.select(F.col(a).alias("node"), *edge_by, F.col(b).alias("_to"))
        if hub_salt > 1:
            step = step.withColumn("_salt", F.pmod(F.xxhash64("_to"), F.lit(hub_salt)).cast("int"))
            left, on = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(hub_salt - 1)))), [*on, "_salt"]
        ends = F.when(F.col("_to").isNull(), F.array("node")).otherwise(F.array("node", "_to"))
        seen = left.join(step, on, "left").select(*by, F.explode(ends).alias("node")).distinct()
    return seen


def local_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends lie in one callable."""
    at = nodes.select("id", "callable_id")
    a = at.select(F.col("id").alias("src"), F.col("callable_id").alias("_ca"))
    b = at.select(F.col("id").alias("dst"), F.col("callable_id").alias("_cb"))
    return edges.join(a, "src").join(b, "dst").filter("_ca = _cb").drop("_ca", "_cb")


def state_node(node: Column, state: Column) -> Column:
    return F.concat_ws("#", node.cast("string"), state.cast("string"))


def reach_states(edges: DataFrame, state_edges: DataFrame, sources: DataFrame, sinks: DataFrame,
                 barriers: DataFrame | None = None, *, by: Sequence[str] = (), n_states: int = 3,
                 form: str = "frontier", max_iter: int | None = None,
                 walks: Sequence[DataFrame] | None = None, ahead: int = 1) -> DataFrame:
    """Reachability over (node, state): starts in state 1, ends in the last state.

    Plain edges hold in every state; ``state_edges(src, s1, dst, s2)`` change it.  The
    state stays beside the node, so that the plain edges are neither copied per state nor per
    search of ``by``.  Doubling follows ``walks`` of the plain edges between two changes of
    state, so that it has a round for every change, or for up to ``ahead`` changes without an edge
    between them (as through a hub); with ``max_iter`` a round is one change.
    """
    by = list(by)
    edges = edges.select("src", "dst")
    if barriers is not None:
        edges = without_barriers(edges, barriers)
        state_edges = without_barriers(state_edges, barriers)
        sources = sources.join(barriers.select("node").distinct(), "node", "left_anti")
    if form == "doubling":
        pairs = _states_along(doubled_walks(edges) if walks is None else walks, state_edges, sources, sinks, by, n_states, max_iter, ahead)
        return pairs.select(*by, *[F.col(c).cast("string").alias(c) for c in ("source", "sink")])
    edges = cut_lineage(edges)
    moves = cut_lineage(state_edges.select(
        *by, F.col("src").alias("node"), F.col("s1").cast("int").alias("state"),
        F.col("dst").alias("_to"), F.col("s2").cast("int").alias("_s")).distinct())
    key = [*by, "source", "node", "state"]
    seen = cut_lineage(sources.select(*by, "node").distinct().select(
        *by, F.col("node").alias("source"), "node", F.lit(1).alias("state")))
    front = seen
    for i in _rounds(max_iter):
        kept = _hub_join(front, edges, [], 1).select(
            *by, "source", F.col("_to").alias("node"), "state")
        moved = front.join(moves, [*by, "node", "state"]).select(
            *by, "source", F.col("_to").alias("node"), F.col("_s").alias("state"))
        front = cut_lineage(kept.unionByName(moved).distinct().join(seen, key, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if i % FOLD_EVERY == 0:
            seen = cut_lineage(seen.hint("rebalance"))
    else:
        raise RuntimeError(f"reach_states: still growing after {max_iter} rounds")
    ends = sinks.select(*by, "node").distinct()
    return (seen.filter(F.col("state") == n_states).join(ends, [*by, "node"], "left_semi")
            .select(*by, "source", F.col("node").alias("sink")))


def _states_along(walks, state_edges, sources, sinks, by, n_states, max_iter, ahead=1) -> DataFrame:
    """(by, source, sink): marks of (node, state) from which a sink is reached first, then pairs through those only."""
    moves = written(state_edges.select(*by, "src", F.col("s1").cast("int").alias("s1"), "dst", F.col("s2").cast("int").alias("s2")).distinct())
    ends = written(sinks.select(*by, "node").distinct())

    def spread(front, more, a, s, b, t, back, among=None):
        """Rows reached from ``front`` by walks and changes of state: (a, s) leads to (b, t)."""
        key = [*by, *more, "node", "state"]
        step = moves.select(*by, F.col(a).alias("node"), F.col(s).alias("state"), F.col(b).alias("_to"), F.col(t).alias("_s"))
        seen = None
        for i in _rounds(max_iter):
            near = reach_along(walks, front, [*by, *more, "state"], back).select(*key)
            if among is not None:
                near = near.join(among, [*by, "node", "state"], "left_semi")
            near = written(near if seen is None else near.join(seen, key, "left_anti"))
            if near.isEmpty():
                return front.select(*key) if seen is None else seen
            seen = near if seen is None else seen.unionByName(near)
            if i % FOLD_EVERY == 0:
                seen = written(seen)
            front = near.join(step, [*by, "node", "state"]).select(
                *by, *more, F.col("_to").alias("node"), F.col("_s").alias("state")).distinct()
            for _ in range(ahead - 1 if max_iter is None else 0):
                here, there = F.struct("node", "state"), F.struct(F.col("_to").alias("node"), F.col("_s").alias("state"))
                front = front.join(step, [*by, "node", "state"], "left").select(*by, *more, F.explode(
                    F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_at"))
                front = front.select(*by, *more, "_at.*").distinct()
            front = front.join(seen, key, "left_anti")
        raise RuntimeError(f"reach_states: still growing after {max_iter} rounds")

    useful = spread(ends.withColumn("state", F.lit(n_states)), [], "dst", "s2", "src", "s1", True)
    start = sources.select(*by, "node").distinct().select(*by, F.col("node").alias("source"), "node", F.lit(1).alias("state"))
    start = written(start.join(useful, [*by, "node", "state"], "left_semi"))
    found = spread(start, ["source"], "src", "s1", "dst", "s2", False, useful)
    return (found.filter(F.col("state") == n_states).join(ends, [*by, "node"], "left_semi")
            .select(*by, "source", F.col("node").alias("sink")))


def transitive_callers(calls: DataFrame, targets: DataFrame, entries: DataFrame | None = None,
                       **options) -> DataFrame:
    """(caller, target) with at least one call between them, searched back from the targets."""
    back = calls.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    first = back.join(targets.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    starts = first.select(F.col("src").alias("target"), F.col("dst").alias("node")).distinct()
    everyone = back.select(F.col("dst").alias("node")).distinct() if entries is None else entries
    found = reach(back, starts.select("node"), everyone, prune=entries is not None, **options)
    return (found.select(F.col("source").alias("node"), F.col("sink").alias("caller"))
            .join(starts, "node").select("caller", "target").distinct())


def type_closure(types: DataFrame, reflexive: bool = True, **options) -> DataFrame:
    """(type, super_type) over any number of steps; with ``reflexive`` every type itself."""
    up = types.select(F.col("type").alias("src"), F.col("super_type").alias("dst")).distinct()
    every = up.select(F.col("src").alias("node")).union(up.select("dst")).distinct()
    pairs = reach(up, every, every, prune=False, **options).toDF("type", "super_type")
    return pairs if reflexive else pairs.filter("type <> super_type")


def containment(tree: DataFrame, blocks: DataFrame, **options) -> DataFrame:
    """(inner, outer): nodes inside one of ``blocks`` at any depth of ``tree(id, parent_id)``."""
    up = tree.filter("parent_id IS NOT NULL").select(
        F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    inner = tree.select(F.col("id").alias("node"))
    return (reach(up, inner, blocks, prune=False, **options).toDF("inner", "outer")
            .filter("inner <> outer"))


def paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame,
          barriers: DataFrame | None = None, *, max_paths: int = 100,
          form: str = "frontier") -> DataFrame:
    """(source, sink, path): simple paths, shortest first, ``max_paths`` per pair.

    Walks grow by one edge a round, over those nodes only that lie between a source and a sink.  Nothing
    is cut on the way: paths of one length are complete before longer ones begin, so the limit applies to
    finished paths alone.  A source whose pairs all have their paths is followed no further.  ``form`` is
    that of the searches that find the pairs and the nodes between them.  Where doubling finds that no node
    has two ways on, every pair has one path, and the walks are followed instead (``_only_paths``).
    """
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    src, ends = sources.select("node").distinct(), sinks.select("node").distinct()
    if barriers is not None:
        e = without_barriers(e, barriers)
        src = src.join(barriers.select("node").distinct(), "node", "left_anti")
    levels = doubled_walks(e) if form == "doubling" else None
    e = written(e) if levels is None else levels[0] if levels else e
    ends = written(ends)
    if levels is not None and max_paths > 0 and e.groupBy("src").count().filter("count > 1").isEmpty():
        return _only_paths(levels, src, ends)
    pairs = written(reach(e, src, ends, form=form, walks=levels))
    if levels is None:
        after = reach_nodes(e, pairs.select(F.col("source").alias("node")), form=form)
        before = reach_nodes(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
                             pairs.select(F.col("sink").alias("node")), form=form)
    else:
        after = reach_along(levels, pairs.select(F.col("source").alias("node")))
        before = reach_along(levels, pairs.select(F.col("sink").alias("node")), back=True)
    e = written(e.join(after.withColumnRenamed("node", "src"), "src", "left_semi")
                .join(before.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    walks = written(pairs.select("source").distinct().select(
        "source", F.col("source").alias("node"), F.array("source").alias("path")))
    step = e.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    # paths still wanted of every pair whose source is followed
    wanted = pairs.withColumn("_left", F.lit(max_paths).cast("long"))
    found = None
    for i in itertools.count(1):
        new = written(walks.join(ends, "node", "left_semi").select("source", F.col("node").alias("sink"), "path"))
        found = new if found is None else found.unionByName(new)
        if i % FOLD_EVERY == 0:
            found = written(found)
        counts = new.groupBy("source", "sink").agg(F.count(F.lit(1)).alias("_n"))
        wanted = written(wanted.join(walks.select("source").distinct(), "source", "left_semi")
                         .join(counts, ["source", "sink"], "left")
                         .withColumn("_left", F.col("_left") - F.coalesce("_n", F.lit(0))).filter("_left > 0").drop("_n"))
        walks = written(walks.join(wanted.select("source").distinct(), "source", "left_semi").join(step, "node")
                        .filter(~F.array_contains("path", F.col("_to")))
                        .select("source", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path")))
        if walks.isEmpty():
            break
    order = W.partitionBy("source", "sink").orderBy(F.size("path"), "path")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_paths).drop("_rank")


def _only_paths(walks: Sequence[DataFrame], sources: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, sink, path) over ``doubled_walks`` of edges of which no two leave one node.

    There is one way from a source, so the nodes that it reaches, in the order of their distance, are the path to the
    last of its sinks and begin with those to the others.  Walks that have gone round a cycle come back at a larger distance.
    """
    useful = written(reach_along(walks, ends, back=True).join(ends.withColumn("_end", F.lit(True)), "node", "left"))
    seen = (sources.join(useful, "node", "left_semi")
            .select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("_d")))
    for k, walk in reversed(list(enumerate(walks))):
        step = walk.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
        here = F.struct("node", "_d")
        ahead = F.struct(F.col("_to").alias("node"), (F.col("_d") + 2 ** k).alias("_d"))
        seen = (seen.join(step, "node", "left").select("source", F.explode(
            F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, ahead))).alias("_at"))
            .groupBy("source", F.col("_at.node").alias("node")).agg(F.min("_at._d").alias("_d")))
    marked = seen.join(useful, "node")
    way = F.sort_array(F.collect_list(F.struct("_d", "node", F.col("_end").isNotNull().alias("_end"))))
    found = marked.groupBy("source").agg(way.alias("_way"))
    path = F.transform("_way", lambda x: x["node"])
    return (found.select("source", path.alias("_path"), F.explode(F.filter("_way", lambda x: x["_end"])).alias("_e"))
            .select("source", F.col("_e.node").alias("sink"), F.expr("slice(_path, 1, int(_e._d) + 1)").alias("path")))


def hub_steps(tails: DataFrame, heads: DataFrame, on: Sequence[str], kind: str) -> DataFrame:
    """Every tail leads to every head with equal ``on`` values, through one hub per group.

    The same nodes are reached as with an edge for every pair, with edges linear in the rows.
    """
    hub = F.concat_ws(":", F.lit(f"hub:{kind}"), *[F.col(c).cast("string") for c in on])
    shared = heads.select(*on).distinct()
    into = tails.join(shared, list(on), "left_semi").select(
        F.col("node").cast("string").alias("src"), hub.alias("dst"))
    out = heads.join(tails.select(*on).distinct(), list(on), "left_semi").select(
        hub.alias("src"), F.col("node").cast("string").alias("dst"))
    return into.unionByName(out).distinct().withColumn("kind", F.lit(kind))


def nested_discrepancies(outer_messages: DataFrame, inner_messages: DataFrame) -> DataFrame:
    """Outer conditions whose else-branch and some nested else-branch hold unequal messages.

    Inputs are (outer, message).  A pair of unequal messages exists exactly when smallest and
    largest over both sides differ, so no pairs are formed.
    """
    def ends(df, tag):
        return df.groupBy("outer").agg(F.min("message").alias(f"{tag}_lo"),
                                       F.max("message").alias(f"{tag}_hi"))
    both = ends(outer_messages, "o").join(ends(inner_messages, "i"), "outer")
    return both.filter("least(o_lo, i_lo) <> greatest(o_hi, i_hi)").select("outer")


def switch_discrepancies(calls: DataFrame, prints: DataFrame) -> DataFrame:
    """Switches with two cases that call different methods, or print different arguments.

    ``calls(switch, case_no, method)`` and ``prints(switch, case_no, method, argument)``.  Two
    rows unequal in both columns exist exactly when each column takes two values.
    """
    def differ(df, keys, a, b):
        g = df.groupBy(*keys).agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"),
                                  F.min(b).alias("_b0"), F.max(b).alias("_b1"))
        return g.filter("_a0 <> _a1 AND _b0 <> _b1").select("switch")
    first = differ(calls, ["switch"], "case_no", "method")
    second = differ(prints, ["switch", "method"], "case_no", "argument")
    return first.union(second).distinct()
