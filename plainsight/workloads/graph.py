"""Reachability operators and the rule pack."""

from pyspark.sql import functions as F

from plainsight.functions.text import name_allowed
from plainsight.operators import facts as FA
from plainsight.operators import reach as R
from plainsight.operators import steps as ST
from plainsight.operators.extraction import WORD_BREAK, explode_lines
from plainsight.plans import catalog as C
from plainsight.plans import rules as RU
from plainsight.session import fixed_table, written
from plainsight.workloads import event_facts as EF
from plainsight.workloads import rule_sql as RS
from plainsight.workloads.registry import Tables, workload
from plainsight.workloads.text import LINES


def _typed(events, kind):
    return events.filter(F.col("event_type") == kind).select(F.col("event_id").alias("node"))


REACH_SQL = f"""
WITH RECURSIVE {RS.EDGES_SQL}, bar AS (SELECT event_id FROM events WHERE event_type = 'error'),
e AS (SELECT src, dst FROM edges WHERE dst IS NOT NULL AND src NOT IN (FROM bar) AND dst NOT IN (FROM bar) {{extra}}),
r(source, node) AS (SELECT event_id, event_id FROM events WHERE event_type = 'signup'
  UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node)
SELECT source, node AS sink FROM r WHERE node IN (SELECT event_id FROM events WHERE event_type = 'purchase')"""


@workload("reach", "G1", REACH_SQL.format(extra=""))
def _(spark, d):
    ev = Tables(spark, d).events
    return R.reach(EF.next_edges(ev), _typed(ev, "signup"), _typed(ev, "purchase"),
                   _typed(ev, "error"), form="doubling")


@workload("reach_by_frontier", "G1", REACH_SQL.format(extra=""))
def _(spark, d):
    ev = Tables(spark, d).events
    return R.reach(EF.next_edges(ev), _typed(ev, "signup"), _typed(ev, "purchase"),
                   _typed(ev, "error"), form="frontier", prune=False)


@workload("reach_barrier_in", "G2", REACH_SQL.format(
    extra="AND dst NOT IN (SELECT event_id FROM events WHERE event_type = 'signup')"))
def _(spark, d):
    ev = Tables(spark, d).events
    return R.reach(EF.next_edges(ev), _typed(ev, "signup"), _typed(ev, "purchase"),
                   _typed(ev, "error"), barrier_in=True, form="doubling")


@workload("reach_states", "G3", f"""
WITH RECURSIVE {RS.EDGES_SQL}, bar AS (SELECT event_id FROM events WHERE event_type = 'error'),
e AS (SELECT src, dst, t.event_type AS et FROM edges JOIN events t ON t.event_id = dst WHERE src NOT IN (FROM bar) AND dst NOT IN (FROM bar)),
mv AS (SELECT src, s AS s1, dst, s AS s2 FROM e, (VALUES (1), (2), (3)) AS v(s)
  UNION SELECT src, 1, dst, 2 FROM e WHERE et = 'view' UNION SELECT src, 2, dst, 3 FROM e WHERE et = 'click'),
r(source, node, st) AS (SELECT event_id, event_id, 1 FROM events WHERE event_type = 'signup'
  UNION SELECT r.source, m.dst, m.s2 FROM r JOIN mv m ON m.src = r.node AND m.s1 = r.st)
SELECT CAST(source AS VARCHAR) AS source, CAST(node AS VARCHAR) AS sink FROM r WHERE st = 3 AND node IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def _(spark, d):
    ev = Tables(spark, d).events
    edges = EF.next_edges(ev)
    into = edges.join(ev.select(F.col("event_id").alias("dst"), "event_type"), "dst")
    moves = into.filter("event_type = 'view'").selectExpr("src", "1 AS s1", "dst", "2 AS s2").unionByName(
        into.filter("event_type = 'click'").selectExpr("src", "2 AS s1", "dst", "3 AS s2"))
    return R.reach_states(edges, moves, _typed(ev, "signup"), _typed(ev, "purchase"),
                          _typed(ev, "error"), form="doubling")


@workload("extra_steps", "G4", """
WITH t AS (SELECT DISTINCT 'l' || l_orderkey || ':' || l_linenumber AS node, l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
h AS (SELECT DISTINCT 'l' || l_orderkey || ':' || l_linenumber AS node, l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT node AS src, 'hub:throw:' || l_orderkey AS dst, 'throw' AS kind FROM t WHERE l_orderkey IN (SELECT l_orderkey FROM h)
UNION SELECT 'hub:throw:' || l_orderkey, node, 'throw' FROM h WHERE l_orderkey IN (SELECT l_orderkey FROM t)
UNION SELECT DISTINCT 'l' || l_orderkey || ':' || l_linenumber, 'o' || l_orderkey, 'return' FROM lineitem WHERE l_returnflag = 'N'""")
def _(spark, d):
    li = Tables(spark, d).lineitem.selectExpr(
        "concat('l', l_orderkey, ':', l_linenumber) AS node", "l_orderkey", "l_returnflag")
    thrown = R.hub_steps(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"), ["l_orderkey"], "throw")
    returned = li.filter("l_returnflag = 'N'").selectExpr(
        "node AS src", "concat('o', l_orderkey) AS dst", "'return' AS kind").distinct()
    return thrown.unionByName(returned)


STEP_SQL = {
    "reader": "a.call_id = b.id AND b.kind = 'ctor' AND b.decl_type IN ('java.io.InputStreamReader', 'java.io.BufferedReader') AND a.kind IN ('call', 'call_arg', 'var_access', 'ctor')",
    "read_line": "b.qualifier_id = a.id AND b.kind = 'call' AND b.callee = 'readLine' AND b.decl_type = 'java.io.BufferedReader'",
    "operand": "a.expr_id = b.id AND b.kind = 'expr'",
    "return": "a.callable_id = b.target_id AND a.kind = 'return' AND b.kind = 'call'",
    "parameter": "a.target_id = b.callable_id AND a.kind = 'call_arg' AND b.kind = 'param'",
    "message_argument": "b.qualifier_id = a.id AND b.kind = 'call_arg' AND b.callee = 'getMessage'",
    "argument": "a.call_id = b.id AND b.kind IN ('call', 'ctor')",
}


def _ends_of(edges):
    """(src, dst) between real nodes: what goes through a hub is put together again."""
    into = edges.filter("NOT last").select(F.col("src").alias("from"), F.col("dst").alias("hub"))
    out = edges.filter("last").select(F.col("src").alias("hub"), "dst")
    through = into.join(out, "hub").select(F.col("from").alias("src"), "dst")
    return edges.filter("last AND src NOT LIKE '%:%'").select("src", "dst").unionByName(through).select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()


def _step_query(rule):
    def run(spark, d):
        return _ends_of(ST.derived_steps(EF.event_facts(spark, d).nodes, [rule]))
    workload(f"step_{rule.kind}", "G4", f"WITH RECURSIVE {RS.FACTS_SQL} SELECT DISTINCT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON {STEP_SQL[rule.kind]}")(run)


for _rule in RU.STEP_RULES:
    _step_query(_rule)


THROWN_SQL = """types AS (SELECT * FROM (VALUES ('app.LockedError', 'app.AccessError'), ('app.AccessError', 'app.Error'), ('app.DataError', 'app.Error')) AS t(type, super_type)),
up(type, super_type) AS (SELECT type, super_type FROM types UNION SELECT up.type, t.super_type FROM up JOIN types t ON up.super_type = t.type),
throws AS (SELECT 'l' || l_orderkey || ':' || l_linenumber AS node, 'o' || l_orderkey AS callable_id,
  ['app.LockedError', 'app.AccessError', 'app.DataError', 'app.Error', 'app.Other'][l_suppkey % 5 + 1] AS type FROM lineitem WHERE l_returnflag = 'R'),
uses AS (SELECT 'use' || o_orderkey AS node, 'o' || o_orderkey AS callable_id, 'app.DataError' AS caught FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'use' || c_custkey, 'c' || c_custkey, ['app.AccessError', 'app.Error', 'app.Other'][c_nationkey % 3 + 1] FROM customer WHERE c_custkey % 4 < 2
  UNION ALL SELECT 'use' || n_nationkey, 'n' || n_nationkey, ['app.Error', 'app.LockedError'][n_nationkey % 2 + 1] FROM nation
  UNION ALL SELECT 'region' || r_regionkey, 'r' || r_regionkey, 'app.Error' FROM region),
calls AS (SELECT DISTINCT 'c' || o_custkey AS caller, 'o' || o_orderkey AS callee FROM orders UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey < 5),
takes AS (SELECT DISTINCT callable_id, caught AS type FROM uses UNION SELECT callable_id, up.type FROM uses JOIN up ON up.super_type = uses.caught),
away(callable_id, type) AS (SELECT callable_id, type FROM throws UNION SELECT c.caller, a.type FROM away a JOIN calls c ON c.callee = a.callable_id
  WHERE (c.caller, a.type) NOT IN (SELECT (callable_id, type) FROM takes)),
met AS (SELECT DISTINCT c.caller, a.callable_id, a.type FROM away a JOIN calls c ON c.callee = a.callable_id)"""


@workload("exception_steps", "G4", f"""
WITH RECURSIVE {THROWN_SQL}
SELECT node AS src, 'hub:throw:' || callable_id AS dst, 'throw' AS kind FROM throws WHERE callable_id IN (SELECT callable_id FROM uses)
UNION SELECT 'hub:throw:' || callable_id, node, 'throw' FROM uses WHERE callable_id IN (SELECT callable_id FROM throws)
UNION SELECT node, 'thrown:' || callable_id || ':' || type, 'throw_caller' FROM throws
UNION SELECT 'thrown:' || callable_id || ':' || type, 'caught:' || caller || ':' || type, 'throw_caller' FROM met WHERE (caller, type) IN (SELECT (callable_id, type) FROM takes)
UNION SELECT 'thrown:' || callable_id || ':' || type, 'thrown:' || caller || ':' || type, 'throw_caller' FROM met WHERE (caller, type) NOT IN (SELECT (callable_id, type) FROM takes)
UNION SELECT 'caught:' || m.caller || ':' || m.type, u.node, 'throw_caller' FROM met m JOIN uses u ON u.callable_id = m.caller
  WHERE m.type = u.caught OR (m.type, u.caught) IN (SELECT (type, super_type) FROM up)""")
def _(spark, d):
    t = Tables(spark, d)
    closure = R.type_closure(fixed_table(spark, ["type", "super_type"], [
        ("app.LockedError", "app.AccessError"), ("app.AccessError", "app.Error"), ("app.DataError", "app.Error")]))
    throws = t.lineitem.filter("l_returnflag = 'R'").selectExpr(
        "concat('l', l_orderkey, ':', l_linenumber) AS node", "concat('o', l_orderkey) AS callable_id",
        "element_at(array('app.LockedError', 'app.AccessError', 'app.DataError', 'app.Error', 'app.Other'), CAST(l_suppkey % 5 + 1 AS INT)) AS type")
    uses = (t.orders.filter("o_orderstatus = 'P'").selectExpr("concat('use', o_orderkey) AS node", "concat('o', o_orderkey) AS callable_id", "'app.DataError' AS type")
            .union(t.customer.filter("c_custkey % 4 < 2").selectExpr("concat('use', c_custkey)", "concat('c', c_custkey)",
                   "element_at(array('app.AccessError', 'app.Error', 'app.Other'), CAST(c_nationkey % 3 + 1 AS INT))"))
            .union(t.nation.selectExpr("concat('use', n_nationkey)", "concat('n', n_nationkey)", "element_at(array('app.Error', 'app.LockedError'), CAST(n_nationkey % 2 + 1 AS INT))"))
            .union(t.region.selectExpr("concat('region', r_regionkey)", "concat('r', r_regionkey)", "'app.Error'")))
    calls = (t.orders.selectExpr("concat('c', o_custkey) AS caller_id", "concat('o', o_orderkey) AS callee_id")
             .union(t.customer.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)"))
             .union(t.nation.selectExpr("concat('r', n_regionkey)", "concat('n', n_nationkey)"))
             .union(t.nation.filter("n_nationkey < 5").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")))
    return ST.exception_steps(throws, uses, calls, closure).select("src", "dst", "kind")


@workload("reach_as_predicate", "G5", f"""
WITH RECURSIVE {RS.EDGES_SQL}, bar AS (SELECT event_id FROM events WHERE event_type = 'error'),
a(node) AS (SELECT event_id FROM events WHERE event_type = 'click' UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node WHERE dst IS NOT NULL),
e AS (SELECT src, dst FROM edges WHERE dst IS NOT NULL AND src NOT IN (FROM bar) AND dst NOT IN (FROM bar)),
r(source, node) AS (SELECT event_id, event_id FROM events WHERE event_type = 'signup' AND event_id IN (FROM a)
  UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node)
SELECT source, node AS sink FROM r WHERE node IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def _(spark, d):
    ev = Tables(spark, d).events
    edges = written(EF.next_edges(ev))
    after_click = R.reach_nodes(edges, _typed(ev, "click"), form="doubling")
    sources = _typed(ev, "signup").join(after_click, "node", "left_semi")
    return R.reach(edges, sources, _typed(ev, "purchase"), _typed(ev, "error"), form="doubling")


@workload("reach_local", "G6", f"""
WITH RECURSIVE {RS.EDGES_SQL}, e AS (SELECT src, dst FROM edges JOIN events a ON a.event_id = src JOIN events b ON b.event_id = dst WHERE day(a.ts) = day(b.ts)),
r(source, node) AS (SELECT event_id, event_id FROM events WHERE event_type = 'signup'
  UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node)
SELECT source, node AS sink FROM r WHERE node IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def _(spark, d):
    ev = Tables(spark, d).events
    nodes = ev.selectExpr("event_id AS id", "user_id * 100 + day(ts) AS callable_id")
    return R.reach(R.local_edges(EF.next_edges(ev).select("src", "dst"), nodes),
                   _typed(ev, "signup"), _typed(ev, "purchase"), form="doubling")


CALLS_SQL = """calls AS (SELECT DISTINCT 'c' || o_custkey AS caller_id, 'o' || o_orderkey AS callee_id FROM orders
  UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@workload("transitive_callers", "G7", f"""
WITH RECURSIVE {CALLS_SQL}, r(caller, target) AS (
  SELECT caller_id, callee_id FROM calls WHERE callee_id IN ('n3', 'n7')
  UNION SELECT c.caller_id, r.target FROM r JOIN calls c ON c.callee_id = r.caller)
SELECT caller, target FROM r WHERE caller LIKE 'c%'""")
def _(spark, d):
    t = Tables(spark, d)
    calls = t.orders.selectExpr("concat('c', o_custkey) AS caller_id", "concat('o', o_orderkey) AS callee_id").union(
        t.lineitem.filter("l_returnflag = 'R'").selectExpr("concat('o', l_orderkey)", "concat('s', l_suppkey)")).union(
        t.supplier.selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)"))
    targets = t.nation.filter("n_nationkey IN (3, 7)").selectExpr("concat('n', n_nationkey) AS node")
    entries = t.customer.selectExpr("concat('c', c_custkey) AS node")
    return R.transitive_callers(calls, targets, entries)


@workload("type_closure", "G8", """
WITH RECURSIVE up AS (SELECT s_name AS type, n_name AS super_type FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region),
r(type, super_type) AS (SELECT t, t FROM (SELECT type AS t FROM up UNION SELECT super_type FROM up)
  UNION SELECT r.type, up.super_type FROM r JOIN up ON up.type = r.super_type)
SELECT type, super_type FROM r""")
def _(spark, d):
    t = Tables(spark, d)
    types = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_name AS type", "n_name AS super_type")
             .union(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_name", "r_name"))
             .union(t.region.selectExpr("r_name", "'WORLD'")))
    return R.type_closure(types)


@workload("containment", "G9", """
SELECT 'o' || o_orderkey AS "inner", 'c' || c_custkey AS "outer" FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
UNION SELECT 'o' || o_orderkey, 'r' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation""")
def _(spark, d):
    t = Tables(spark, d)
    tree = (t.orders.selectExpr("concat('o', o_orderkey) AS id", "concat('c', o_custkey) AS parent_id")
            .union(t.customer.selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)"))
            .union(t.nation.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
            .union(t.region.selectExpr("concat('r', r_regionkey)", "CAST(NULL AS STRING)")))
    blocks = t.customer.filter("c_mktsegment = 'BUILDING'").selectExpr("concat('c', c_custkey) AS node").union(
        t.region.selectExpr("concat('r', r_regionkey)"))
    return R.containment(tree, blocks)


@workload("paths", "G10", REACH_SQL.format(extra="").replace(
    "r(source, node) AS (SELECT event_id, event_id FROM", "r(source, node, path) AS (SELECT event_id, event_id, CAST(event_id AS VARCHAR) FROM").replace(
    "UNION SELECT r.source, e.dst FROM", "UNION SELECT r.source, e.dst, r.path || '>' || e.dst FROM").replace(
    "SELECT source, node AS sink FROM", "SELECT source, node AS sink, path FROM"))
def _(spark, d):
    ev = Tables(spark, d).events
    found = R.paths(EF.next_edges(ev), _typed(ev, "signup"), _typed(ev, "purchase"), _typed(ev, "error"), form="doubling")
    return found.select("source", "sink", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


NESTED_SQL = f"""
WITH {LINES}, m AS (SELECT doc_id, line_no, regexp_extract(line, '^([A-Z][a-z]+)', 1) AS message FROM lines),
o AS (SELECT doc_id, message FROM m WHERE line_no = 1 AND message <> ''),
i AS (SELECT doc_id, message FROM m WHERE line_no > 1 AND message <> '')
SELECT DISTINCT o.doc_id AS "outer" FROM o JOIN i ON o.doc_id = i.doc_id AND o.message <> i.message"""


def _nested(spark, d):
    lines = explode_lines(Tables(spark, d).documents, "text", ["doc_id"])
    m = lines.select(F.col("doc_id").alias("outer"), "line_no", F.regexp_extract(
        "line", "^([A-Z][a-z]+)", 1).alias("message")).filter("message <> ''")
    return R.nested_discrepancies(m.filter("line_no = 1"), m.filter("line_no > 1"))


workload("sibling_pairs_nested", "G12", NESTED_SQL)(_nested)

OUTCOMES = C.OUTCOME_MESSAGES.replace("'", "''")
OUTCOME_WORDS = ["Login Successful", "Invalid password", "Access Denied to all", "nothing to see"]


@workload("rule_204_nested", "R2", f"""
WITH {LINES}, m AS (SELECT doc_id, line_no, ['{"', '".join(OUTCOME_WORDS)}'][(length(line) % 4) + 1] AS message FROM lines),
h AS (SELECT * FROM m WHERE regexp_matches(message, '{OUTCOMES}'))
SELECT DISTINCT o.doc_id AS "outer" FROM h o JOIN h i ON o.doc_id = i.doc_id AND o.line_no = 1 AND i.line_no > 1 AND o.message <> i.message""")
def _(spark, d):
    lines = explode_lines(Tables(spark, d).documents, "text", ["doc_id"])
    words = F.array(*[F.lit(w) for w in OUTCOME_WORDS])
    m = lines.select(F.col("doc_id").alias("outer"), "line_no",
                     F.element_at(words, (F.length("line") % 4 + 1).cast("int")).alias("message"))
    m = m.filter(F.col("message").rlike(f"(?:{C.OUTCOME_MESSAGES})"))
    return R.nested_discrepancies(m.filter("line_no = 1"), m.filter("line_no > 1"))


@workload("sibling_pairs_switch", "G13", """
SELECT DISTINCT a.l_orderkey AS switch FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND a.l_linenumber <> b.l_linenumber AND a.l_returnflag <> b.l_returnflag""")
def _(spark, d):
    calls = Tables(spark, d).lineitem.selectExpr(
        "l_orderkey AS switch", "l_linenumber AS case_no", "l_returnflag AS method")
    return R.switch_discrepancies(calls, calls.selectExpr("*", "'' AS argument").filter("FALSE"))


@workload("rule_204_switch", "R3", """
SELECT DISTINCT a.l_orderkey AS switch FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber
WHERE (a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_linestatus <> b.l_linestatus)
   OR (a.l_returnflag = 'N' AND b.l_returnflag = 'N' AND a.l_linestatus = b.l_linestatus AND a.l_suppkey <> b.l_suppkey)""")
def _(spark, d):
    li = Tables(spark, d).lineitem
    calls = li.filter("l_returnflag = 'R'").selectExpr("l_orderkey AS switch", "l_linenumber AS case_no", "l_linestatus AS method")
    prints = li.filter("l_returnflag = 'N'").selectExpr(
        "l_orderkey AS switch", "l_linenumber AS case_no", "l_linestatus AS method", "l_suppkey AS argument")
    return R.switch_discrepancies(calls, prints)


# --- predicates over the sink relation and the catalog ------------------------------------

TOK = """tok AS (SELECT DISTINCT doc_id, source AS file_name, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS callee FROM documents)"""
RULE_SINKS_SQL = f"""rk AS (SELECT 'src' || (p_partkey % 20) AS file_name, substr(p_name, 1, 1 + p_partkey % 3) AS sink_name,
  CASE p_size % 4 WHEN 0 THEN 'Log Sink' WHEN 1 THEN 'I/O Sink' WHEN 2 THEN 'Print Sink' ELSE 'Other' END AS sink_type FROM part)"""


def _words(spark, d):
    t = Tables(spark, d)
    calls = t.documents.select("doc_id", F.col("source").alias("file_name"), F.explode(
        F.array_distinct(F.split("text", WORD_BREAK))).alias("callee"))
    sinks = t.part.selectExpr(
        "concat('src', p_partkey % 20) AS file_name", "substr(p_name, 1, 1 + p_partkey % 3) AS sink_name",
        "CASE p_size % 4 WHEN 0 THEN 'Log Sink' WHEN 1 THEN 'I/O Sink' WHEN 2 THEN 'Print Sink' ELSE 'Other' END AS sink_type")
    return calls, sinks


@workload("sink_of_type", "P8", f"""
WITH {TOK}, {RULE_SINKS_SQL} SELECT doc_id, file_name, callee FROM tok
WHERE (file_name, callee) IN (SELECT (file_name, sink_name) FROM rk WHERE sink_type = 'Log Sink')""")
def _(spark, d):
    calls, sinks = _words(spark, d)
    return FA.sink_of_type(calls, sinks, "Log Sink")


@workload("sink_any", "P8", f"""
WITH {TOK}, {RULE_SINKS_SQL} SELECT doc_id, file_name, callee FROM tok
WHERE (file_name, callee) IN (SELECT (file_name, sink_name) FROM rk) AND (file_name, callee) NOT IN (SELECT (file_name, sink_name) FROM rk WHERE sink_type = 'Log Sink')""")
def _(spark, d):
    return FA.sink_any(*_words(spark, d))


@workload("detected_calls", "P9", f"""
WITH {TOK}, {RULE_SINKS_SQL} SELECT doc_id, file_name, callee FROM tok WHERE (file_name, callee) IN (SELECT (file_name, sink_name) FROM rk)""")
def _(spark, d):
    return FA.detected_calls(*_words(spark, d))


@workload("sink_names", "P9", f"""
WITH {TOK}, {RULE_SINKS_SQL} SELECT DISTINCT callee AS sink_name FROM tok
WHERE (file_name, callee) IN (SELECT (file_name, sink_name) FROM rk WHERE sink_type <> 'Other')""")
def _(spark, d):
    return FA.sink_names(*_words(spark, d))


@workload("literal_allowed", "P2", f"""
WITH {LINES}, v AS (SELECT doc_id, line_no, line, regexp_extract(line, '([a-z]+)', 1) AS w FROM lines),
keys AS (SELECT doc_id, line_no FROM v WHERE length(line) % 5 = 0)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(line) AS literal_md5 FROM v
WHERE NOT regexp_matches(line, 'example|test|demo|foo|bar|baz|secret') AND NOT regexp_matches(line, '^\\s*$') AND NOT regexp_matches(line, '^[^.]*\\.[0-9]+$')
AND (doc_id, line_no) NOT IN (SELECT (doc_id, line_no) FROM keys)""")
def _(spark, d):
    lines = explode_lines(Tables(spark, d).documents, "text", ["doc_id"])
    uses = lines.select("doc_id", "line_no", F.when(F.length("line") % 5 == 0, F.lit("getHeader")).otherwise(
        F.lit("print")).alias("callee"))
    out = FA.allowed_literals(lines, uses, "line", ["doc_id", "line_no"])
    return out.select("doc_id", F.col("line_no").cast("bigint"), F.md5("line").alias("literal_md5"))


@workload("is_barrier", "P6", f"""
WITH {TOK} SELECT doc_id, callee AS word FROM tok WHERE callee <> '' AND (
  {" OR ".join(f"lower(callee || CASE doc_id % 3 WHEN 0 THEN 'Hash' WHEN 1 THEN 'enc' ELSE '' END) LIKE '%{w}%'" for w in C.BARRIER_WORDS)})""")
def _(spark, d):
    calls, _ = _words(spark, d)
    n = calls.filter("callee <> ''").selectExpr(
        "doc_id", "callee AS word", "'call' AS kind", "CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS decl_type",
        "concat(callee, CASE doc_id % 3 WHEN 0 THEN 'Hash' WHEN 1 THEN 'enc' ELSE '' END) AS callee")
    return n.filter(FA.is_barrier()).select("doc_id", "word")


def _catalog_query(sets):
    likes = RU.in_set(*sets)

    def run(spark, d):
        f = EF.event_facts(spark, d)
        return FA.flag_nodes(f, EF.platform_closure(spark), False).filter(likes).select("id", "decl_type", "callee")
    sql = f"WITH RECURSIVE {RS.FACTS_SQL} SELECT id, decl_type, callee FROM nodes WHERE {RS.sink(*sets)}"
    return run, sql


for _name, _id, _sets in [("logging_sink", "P10", ["logging"]), ("servlet_sink", "P11", ["servlet"]),
                          ("print_sink", "P12", ["print"]), ("error_sink", "P14", ["error"]),
                          ("io_sink", "P15", ["io"]), ("spring_sink", "P16", ["spring"])]:
    _run, _sql = _catalog_query(_sets)
    workload(_name, _id, _sql)(_run)


@workload("err_print_sink", "P13", f"WITH RECURSIVE {RS.FACTS_SQL} SELECT id, callee FROM nodes WHERE {RS.SINKS['err_print']}")
def _(spark, d):
    f = EF.event_facts(spark, d)
    return FA.flag_nodes(f, EF.platform_closure(spark), True, "doubling").filter(RU.ERR_PRINT).select("id", "callee")


@workload("suppress_if_permission_checked", "P17", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (
  SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F') GROUP BY ALL""")
def _(spark, d):
    t = Tables(spark, d)
    calls = t.orders.selectExpr("o_orderkey AS callable_id", """CASE WHEN o_orderpriority = '1-URGENT' THEN 'checkPermission'
      WHEN o_orderstatus = 'F' THEN 'isAuthorized' ELSE 'run' END AS callee""")
    kept = FA.suppress_if_permission_checked(t.lineitem, calls, "l_orderkey")
    return kept.groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")).agg(F.count("*").alias("n"))


# --- rule pack ----------------------------------------------------------------------------

RULE_IDS = {"201": "R1", "208-header": "R4", "208-possible": "R5", "208-signature": "R6", "209": "R7",
            "209-direct": "R8", "214": "R9", "215-debug": "R10", "215-webview": "R12", "532": "R13",
            "535": "R14", "536": "R15", "536-direct": "R16", "537": "R17", "537-direct": "R18",
            "538": "R19", "550": "R20", "598": "R21", "548-listing": "R25"}


def _register(rule):
    def run(spark, d):
        return RU.run_rule(EF.prepared(spark, d), rule)
    workload(f"rule_{rule.rule_id.replace('-', '_')}", RULE_IDS[rule.rule_id], RS.RULE_SQL[rule.rule_id])(run)


for _rule in RU.RULES.values():
    _register(_rule)


@workload("run_rules", "R28", " UNION ALL ".join(
    f"SELECT *, '{r.message}' AS message FROM ({RS.RULE_SQL[r.rule_id]}) AS r" for r in RU.RULES.values()))
def _(spark, d):
    return RU.run_rules(EF.prepared(spark, d), list(RU.RULES.values()))


@workload("rule_215_manifest", "R11", """
SELECT page_id, url FROM pages WHERE html LIKE '%<html lang="en"%' AND page_id % 4 <> 0""")
def _(spark, d):
    t = Tables(spark, d).pages
    xml = F.replace("html", F.lit('<html lang="en"'), F.lit('<application android:debuggable="true"'))
    files = t.select("page_id", "url", xml.alias("xml"), F.when(F.col("page_id") % 4 == 0, F.lit("app/build/x.xml")).otherwise(
        F.lit("app/src/x.xml")).alias("path"))
    return RU.debuggable_manifests(files, "path", "xml").select("page_id", "url")


@workload("rule_548_config", "R26", """SELECT page_id, url FROM pages WHERE page_id % 3 = 0 AND html LIKE '%lang="en"%'""")
def _(spark, d):
    xml = F.concat(
        "html", F.lit("<web-app><servlet><servlet-class>"), F.when(
            F.col("page_id") % 3 == 0, F.lit("org.apache.catalina.servlets.DefaultServlet")).otherwise(F.lit("app.Own")),
        F.lit("</servlet-class><init-param><param-name>listings</param-name>\n<param-value>"),
        F.when(F.col("html").contains('lang="en"'), F.lit("True")).otherwise(F.lit("false")),
        F.lit("</param-value></init-param></servlet></web-app>"))
    files = Tables(spark, d).pages.select("page_id", "url", xml.alias("xml"))
    return RU.listing_enabled(files, "xml").select("page_id", "url")


@workload("rule_615_comments", "R22", f"""
WITH {LINES},
p AS (SELECT DISTINCT d.doc_id, '%' || unnest(list_distinct(regexp_extract_all(b.text, '[A-Za-z]{{6,}}'))) || '%' AS pattern
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  UNION SELECT d.doc_id, '%' || b.text || '%' FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT l.doc_id, md5(line) AS comment_md5, md5(pattern) AS pattern_md5 FROM lines l JOIN p ON l.doc_id = p.doc_id AND trim(line) LIKE trim(pattern)""")
def _(spark, d):
    t = Tables(spark, d)
    comments = explode_lines(t.documents, "text", ["doc_id"]).select("doc_id", F.col("line").alias("comment"))
    # a document's patterns: one benchmark text, whole, and its longer words
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)))
    items = t.benchmark.select("item_id", F.explode(F.array_distinct(F.concat(words, F.array("text")))).alias("part"))
    docs = t.documents.select("doc_id", (F.col("doc_id") % t.benchmark.count()).alias("item_id"))
    patterns = docs.join(items, "item_id").select(
        "doc_id", F.concat(F.lit("%"), "part", F.lit("%")).alias("pattern"))
    found = RU.commented_secrets(comments, patterns, ["doc_id"])
    return found.select("doc_id", F.md5("comment").alias("comment_md5"), F.md5("pattern").alias("pattern_md5"))


CLASS_EXPR = ["doc_id % 200 AS class_id",
              "CASE doc_id % 200 % 5 WHEN 0 THEN 'app.AcceptTest' ELSE 'app.Main' END AS class_name",
              "CASE doc_id % 200 % 7 WHEN 0 THEN 'org.junit.Test' ELSE '' END AS annotation",
              "CASE doc_id % 200 % 11 WHEN 0 THEN 'app.Case' ELSE 'app.Main' END AS class_type"]
IN_TEST = "(doc_id % 200 % 5 = 0 OR doc_id % 200 % 7 = 0 OR doc_id % 200 % 11 = 0)"
LITERALS_SQL = """lits AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]+[0-9]+', 0)) AS literal FROM documents)"""


def _literals(spark, d):
    docs = Tables(spark, d).documents
    lits = docs.select("doc_id", (F.col("doc_id") % 200).alias("class_id"), F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit("[a-z]+[0-9]+"), F.lit(0)))).alias("literal"))
    classes = docs.selectExpr(*CLASS_EXPR).distinct()
    closure = fixed_table(spark, ["type", "super_type"], [("app.Case", "junit.framework.TestCase"), ("app.Case", "app.Case")])
    return lits, RU.test_class_literals(lits, classes, closure)


@workload("rule_531_tests", "R23", f"WITH {LITERALS_SQL} SELECT doc_id, literal FROM lits WHERE {IN_TEST}")
def _(spark, d):
    return _literals(spark, d)[1].select("doc_id", "literal")


@workload("rule_540_source", "R24", f"WITH {LITERALS_SQL} SELECT doc_id, literal FROM lits WHERE NOT {IN_TEST}")
def _(spark, d):
    lits, tests = _literals(spark, d)
    return RU.source_literals(lits, tests, ["doc_id", "literal"]).select("doc_id", "literal")


@workload("backward_slice", "R27", f"""
WITH RECURSIVE {RS.EDGES_SQL}, bar AS (SELECT event_id FROM events WHERE event_type = 'error'),
e AS (SELECT src, dst FROM edges WHERE dst IS NOT NULL AND src NOT IN (FROM bar) AND dst NOT IN (FROM bar)),
r(variable, node) AS (SELECT event_id, event_id FROM events WHERE event_type = 'purchase'
  UNION SELECT r.variable, e.src FROM r JOIN e ON e.dst = r.node)
SELECT variable, node AS origin FROM r""")
def _(spark, d):
    ev = Tables(spark, d).events
    return RU.backward_slice(EF.next_edges(ev), ev.select(F.col("event_id").alias("id")), _typed(ev, "purchase"),
                             _typed(ev, "error"), form="doubling")


@workload("variable_list", "R27", f"""
WITH RECURSIVE {RS.FACTS_SQL} SELECT DISTINCT file_name, name, decl_type FROM nodes WHERE kind = 'var_access' AND {RS.NAME_OK}""")
def _(spark, d):
    n = EF.event_facts(spark, d).nodes.filter("kind = 'var_access'").withColumn(
        "file_name", F.substring_index("path", "/", -1))
    return n.filter(name_allowed("name")).select("file_name", "name", "decl_type").distinct()

