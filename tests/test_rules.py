"""Rule pack on small hand-made code facts."""

import pytest

from plainsight.operators import reach as R
from plainsight.operators.facts import Facts
from plainsight.plans import catalog as C
from plainsight.plans import rules as RU
from plainsight.session import fixed_table

NODES = "id long, path string, kind string, name string, callee string, decl_type string, callable_id long, parent_id long"
STEPS = ["qualifier_id", "call_id", "target_id", "throw_id", "expr_id", "annotated"]
STRING = "java.lang.String"
MAIN, TEST = "/src/main/A.java", "/src/test/A.java"
ROWS = [
    (1, MAIN, "var_access", "password", None, STRING, 1, None),
    (2, MAIN, "call_arg", None, "info", "org.slf4j.Logger", 1, None),
    (3, MAIN, "call_arg", None, "hashPassword", "app.Util", 1, None),
    (4, MAIN, "call_arg", None, "info", "org.slf4j.Logger", 1, None),
    (5, MAIN, "call_arg", None, "setText", "javax.mail.internet.MimeMessage", 1, None),
    (6, TEST, "call_arg", None, "setText", "javax.mail.internet.MimeMessage", 2, None),
    # exception flow: constructor, throw, catch, print
    (10, MAIN, "var_access", "password", None, STRING, 3, None),
    (11, MAIN, "ctor", None, "<init>", "java.io.IOException", 3, None),
    (12, MAIN, "catch_var", "e", None, "java.io.IOException", 3, None),
    (13, MAIN, "call_arg", None, "println", "java.io.PrintWriter", 3, None),
    (14, MAIN, "ctor", None, "<init>", "java.lang.IllegalStateException", 3, None),
    # blocks
    (20, MAIN, "catch_block", None, None, "java.io.IOException", 3, None),
    (21, MAIN, "then_block", "isDebug", None, None, 3, 20),
    (22, MAIN, "call_arg", None, "println", "System.out", 3, 21),
    (30, MAIN, "literal", "true", None, "boolean", 5, None),
    (31, MAIN, "call_arg", None, "setWebContentsDebuggingEnabled", "android.webkit.WebView", 5, None),
    (40, MAIN, "var_access", "apiToken", None, STRING, 6, None),
    (41, MAIN, "call_arg", None, "warn", "org.slf4j.Logger", 6, None),
    (42, MAIN, "call", None, "checkPermission", "app.Guard", 6, None),
]
# columns of single rows: what is thrown, what a call is made on, where an operand or an annotation stands
MORE = {11: {"throw_id": 11}, 14: {"throw_id": 14}}
EDGES = [(1, 2), (1, 3), (3, 4), (1, 5), (1, 6), (10, 11), (11, 12), (12, 13), (10, 14), (14, 12), (30, 31), (40, 41), (10, 22)]


def node_table(spark, rows, more):
    return spark.createDataFrame([(*r, *[more.get(r[0], {}).get(c) for c in STEPS]) for r in rows],
                                 NODES + ", " + ", ".join(f"{c} long" for c in STEPS[:-1]) + ", annotated int")


@pytest.fixture(scope="module")
def prepared(spark):
    types = fixed_table(spark, ["type", "super_type"], C.PLATFORM_TYPES)
    facts = Facts(node_table(spark, ROWS, MORE), spark.createDataFrame(EDGES, "src long, dst long"), types,
                  spark.createDataFrame([("A.java", "password"), ("A.java", "message")], "file_name string, name string"),
                  spark.createDataFrame([("A.java", "println", "Print Sink")], "file_name string, sink_name string, sink_type string"))
    return RU.prepare(facts, R.type_closure(types))


def found(prepared, rule_id):
    return sorted((r["source"], r["sink"]) for r in RU.run_rule(prepared, RU.RULES[rule_id]).collect())


def test_flags(prepared):
    n = {r["id"]: r for r in prepared.nodes.collect()}
    assert n[1]["sensitive"] == 1 and n[40]["sensitive"] == 0 and n[3]["barrier"] == 1
    assert n[6]["test_path"] == 1 and n[5]["test_path"] == 0
    assert "|print|" in n[13]["sinks"] and "|transmit|" in n[5]["sinks"] and n[11]["sinks"] == "|"
    assert n[22]["inside"] == "|catch|catch:checked|then:debug|"
    assert "|runtime+|" in n[14]["traits"] and "|throwable+|" in n[11]["traits"] and "|runtime" not in n[11]["traits"]


def test_one_state_rules(prepared):
    assert found(prepared, "201") == [(1, 5)]          # the sink in a test path is out
    assert found(prepared, "532") == [(1, 2)]          # 4 is behind a barrier, 41 beside a permission check
    assert found(prepared, "215-webview") == [(30, 31)]
    assert found(prepared, "215-debug") == [(10, 22)]
    assert found(prepared, "209-direct") == []


def test_state_rules(prepared):
    assert found(prepared, "209") == [(10, 13)]
    assert found(prepared, "537") == [(10, 13)]
    assert found(prepared, "536") == []


def test_all_rules_together(prepared):
    rules = list(RU.RULES.values())
    together = sorted((r["rule_id"], r["source"], r["sink"]) for r in RU.run_rules(prepared, rules).collect())
    apart = sorted((r.rule_id, a, b) for r in rules for a, b in found(prepared, r.rule_id))
    assert together == apart and together


def test_rules_pick_their_ends_in_one_pass(prepared):
    rules = [r for r in RU.RULES.values() if r.steps]
    sources, sinks = RU._pooled_ends(prepared, rules)
    for pooled, one in [(sources, RU._sources), (sinks, RU._sinks)]:
        assert pooled._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1  # one for every rule before
        alone = {(r.rule_id, x["node"]) for r in rules for x in one(prepared, r).collect()}
        assert {(x["rule_id"], x["node"]) for x in pooled.collect()} == alone and alone
    moves = RU._pooled_moves(prepared, rules)
    alone = {(r.rule_id, *x) for r in rules for x in RU._moves(prepared, r).select("src", "s1", "dst", "s2").collect()}
    assert {tuple(x) for x in moves.select("rule_id", "src", "s1", "dst", "s2").collect()} == alone and alone


def test_configuration_rules(spark):
    on = '<manifest><application android:name="x" android:debuggable="true"></application></manifest>'
    files = spark.createDataFrame([("app/src/A.xml", on), ("app/build/A.xml", on), ("app/src/B.xml", on.replace("true", "false"))],
                                  "path string, xml string")
    assert [r["path"] for r in RU.debuggable_manifests(files, "path", "xml").collect()] == ["app/src/A.xml"]
    web = ("<servlet><servlet-class>org.apache.catalina.servlets.DefaultServlet</servlet-class><init-param>"
           "<param-name>listings</param-name><param-value>TRUE</param-value></init-param></servlet>")
    files = spark.createDataFrame([("a", web), ("b", web.replace("TRUE", "false"))], "path string, xml string")
    assert [r["path"] for r in RU.listing_enabled(files, "xml").collect()] == ["a"]


def test_flagging_without_blocks(prepared, spark):
    assert prepared.nodes.filter("id = 22").first()["rule_types"] == "|Print Sink|"


# --- steps that need more than one edge: each rule with what it must find and near misses -----------------

def rule_pairs(spark, rows, edges, more, *rule_ids, sensitive=("password",), types=()):
    up = fixed_table(spark, ["type", "super_type"], [*C.PLATFORM_TYPES, *types])
    facts = Facts(node_table(spark, rows, more), spark.createDataFrame(edges, "src long, dst long"), up,
                  spark.createDataFrame([("A.java", n) for n in sensitive], "file_name string, name string"),
                  spark.createDataFrame([], "file_name string, sink_name string, sink_type string"))
    made = RU.prepare(facts, R.type_closure(up, form="doubling"), form="doubling")
    pairs = [found(made, rule_id) for rule_id in rule_ids]
    return pairs[0] if len(pairs) == 1 else pairs


def secret(i, callable_id=1):
    return (i, MAIN, "var_access", "password", None, STRING, callable_id, None)


def thrown(i, kind, callable_id=1):
    return (i, MAIN, "ctor", None, "<init>", kind, callable_id, None)


def caught(i, kind, callable_id):
    return (i, MAIN, "catch_var", "e", None, kind, callable_id, None)


def asked(i, callable_id):
    return (i, MAIN, "call", None, "getMessage", "java.lang.Throwable", callable_id, None)


def printed(i, callable_id):
    return (i, MAIN, "call_arg", None, "println", "java.io.PrintWriter", callable_id, None)


def test_550_throw_to_catch(spark):
    sql, io, bind = "java.sql.SQLException", "java.io.IOException", "java.net.BindException"
    rows = [
        secret(1), thrown(2, sql), asked(3, 1), printed(4, 1), caught(5, sql, 1), printed(6, 1),  # cases 1 and 2: same callable
        asked(7, 1), printed(8, 1),                                                               # getMessage on something else
        secret(11, 10), thrown(12, bind, 10),                                                      # thrown, not caught there
        (13, MAIN, "call", None, "run", "app.Job", 20, None), caught(14, io, 20), asked(15, 20), printed(16, 20), printed(17, 20),  # cases 3 and 4
        caught(18, sql, 20), printed(19, 20),                                                      # not a supertype of what is thrown
        caught(31, io, 30), printed(32, 30),                                                       # a callable that does not call it
        secret(41, 40), thrown(42, io, 40), caught(43, io, 40), printed(44, 40),                   # not a server exception
    ]
    edges = [(1, 2), (3, 4), (5, 6), (7, 8), (11, 12), (14, 17), (15, 16), (18, 19), (31, 32), (41, 42), (43, 44)]
    more = {i: {"throw_id": i} for i in (2, 12, 42)} | {3: {"qualifier_id": 5}, 13: {"target_id": 10}, 15: {"qualifier_id": 14}}
    server, checked = rule_pairs(spark, rows, edges, more, "550", "209")
    assert server == [(1, 4), (1, 6), (11, 16), (11, 17)]
    # inside one callable a rule for checked exceptions asks for no type, and for no caller
    assert checked == [(1, 4), (1, 6), (41, 44)]


def test_550_answers_of_frameworks(spark):
    sql = "java.sql.SQLException"
    rows = [secret(1), thrown(2, sql), caught(3, sql, 1),
            (4, MAIN, "call_arg", None, "getWriter", "app.LoginAction", 1, None),       # below the action type
            (5, MAIN, "call_arg", None, "getWriter", "app.Plain", 1, None),
            (6, MAIN, "call_arg", None, "com.vaadin.flow.component.notification.Notification.show", "@Route", 1, None),
            (7, MAIN, "call_arg", None, "show", "@Route", 1, None)]
    edges = [(1, 2), (3, 4), (3, 5), (3, 6), (3, 7)]
    types = [("app.LoginAction", "com.opensymphony.xwork2.ActionSupport"), ("app.Plain", "java.lang.Object")]
    assert rule_pairs(spark, rows, edges, {2: {"throw_id": 2}}, "550", types=types) == [(1, 4), (1, 6)]


def test_535_stream_steps(spark):
    rows = [secret(1), (2, MAIN, "call", None, "exec", "java.lang.Runtime", 1, None), (3, MAIN, "call", None, "getErrorStream", "java.lang.Process", 1, None),
            (4, MAIN, "ctor", None, "<init>", "java.io.InputStreamReader", 1, None), (5, MAIN, "ctor", None, "<init>", "java.io.BufferedReader", 1, None),
            (6, MAIN, "call", None, "readLine", "java.io.BufferedReader", 1, None), (7, MAIN, "expr", None, None, STRING, 1, None),
            (8, MAIN, "call_arg", None, "show", "app.Own", 1, None), (9, MAIN, "param", "p", None, STRING, 2, None), (10, MAIN, "return", None, None, STRING, 2, None),
            (11, MAIN, "call", None, "help", "app.Own", 3, None), printed(12, 3), (13, MAIN, "ctor", None, "<init>", "app.Reader", 1, None), printed(14, 1)]
    edges = [(1, 2), (2, 3), (7, 8), (9, 10), (11, 12), (13, 14)]
    more = {3: {"call_id": 4}, 4: {"call_id": 5}, 6: {"qualifier_id": 5, "expr_id": 7}, 8: {"target_id": 2}, 11: {"target_id": 2}, 5: {"call_id": 13}}
    # the whole once more for each link, without that link
    table, arcs, facts = list(rows), list(edges), dict(more)
    for n, lost in enumerate((3, 6, 8, 11), 1):
        table += [(r[0] + 100 * n, *r[1:6], r[6] + 100 * n, r[7]) for r in rows]
        arcs += [(x + 100 * n, y + 100 * n) for x, y in edges]
        facts |= {k + 100 * n: {c: v + 100 * n for c, v in link.items()} for k, link in more.items() if k != lost}
    assert rule_pairs(spark, table, arcs, facts, "535") == [(1, 12)]


def test_532_barriers_and_annotations(spark):
    log = [(i, MAIN, "call_arg", None, "info", "org.slf4j.Logger", i, None) for i in range(21, 28)]
    between = [(11, "literal", STRING, None), (12, "expr", "int", None), (13, "expr", "java.lang.Class", None), (14, "call", "app.Guard", "canAccess"), (15, "expr", STRING, None)]
    rows = [secret(i, 1) for i in range(1, 7)] + [(i, MAIN, kind, None, callee, t, 2, None) for i, kind, t, callee in between] + log
    edges = [(i, 10 + i) for i in range(1, 6)] + [(10 + i, 20 + i) for i in range(1, 6)] + [(6, 26)]
    assert rule_pairs(spark, rows, edges, {6: {"annotated": 1}}, "532") == [(5, 25)]


def test_538_file_writer_link(spark):
    rows = [secret(1), (2, MAIN, "call", "java.io.tmpdir", "getProperty", "java.lang.System", 1, None), (3, MAIN, "ctor", None, "<init>", "java.io.File", 1, None),
            (4, MAIN, "ctor", None, "<init>", "java.io.FileWriter", 1, None), (5, MAIN, "var_access", "w", None, "java.io.Writer", 1, None),
            (6, MAIN, "call_arg", None, "write", "java.io.Writer", 1, None), (7, MAIN, "call_arg", None, "write", "java.io.Writer", 1, None),
            (8, MAIN, "ctor", None, "<init>", "java.io.FileWriter", 1, None), (9, MAIN, "call_arg", None, "write", "java.io.Writer", 1, None),
            (10, MAIN, "var_access", "w", None, "java.io.Writer", 2, None), (11, MAIN, "call_arg", None, "write", "java.io.Writer", 2, None)]
    edges = [(2, 3), (3, 4), (4, 5), (4, 10), (1, 6), (1, 7), (1, 9), (1, 11)]
    more = {6: {"qualifier_id": 5}, 9: {"qualifier_id": 8}, 11: {"qualifier_id": 10}}
    # 7 has no qualifier, 8 writes to another file, 10 stands in another callable
    assert rule_pairs(spark, rows, edges, more, "538") == [(1, 6)]


def test_598_connections(spark):
    url, http = "java.net.URL", "java.net.HttpURLConnection"

    def case(i, method, address=url, opened=url, text="https://h/p?user="):
        """Address i, opened i+1, method set i+2."""
        return [(i, MAIN, "call_arg", text, "<init>", address, i, None), (i + 1, MAIN, "call", None, "openConnection", opened, i, None),
                *([(i + 2, MAIN, "call", method, "setRequestMethod", http, i, None)] if method else [])]
    rows = [secret(1), *case(10, None), *case(20, "GET"), *case(30, "POST"), *case(40, None, text="https://h/p"), *case(50, None, opened=http),
            *case(60, None, address="java.net.URI", opened=http), (63, MAIN, "call", None, "toURL", "java.net.URI", 60, None),
            (70, MAIN, "call_arg", "u?a=b", "<init>", "org.apache.http.client.methods.HttpGet", 70, None), (80, MAIN, "call_arg", "u?a=b", "<init>", url, 80, None),
            # a concatenation whose second operand's second operand holds the parameter
            (90, MAIN, "call_arg", None, "<init>", "org.apache.http.client.methods.HttpGet", 90, None), (91, MAIN, "expr", None, None, STRING, 90, None),
            (92, MAIN, "literal", "?key=", None, STRING, 90, None)]
    edges = [(1, i) for i in (10, 20, 30, 40, 50, 60, 70, 80, 90)]
    more = {i + 1: {"qualifier_id": i} for i in (10, 20, 30, 40, 50)} | {i + 2: {"qualifier_id": i + 1} for i in (20, 30)}
    more |= {63: {"qualifier_id": 60}, 61: {"qualifier_id": 63}, 92: {"expr_id": 91}, 91: {"expr_id": 90}}
    assert rule_pairs(spark, rows, edges, more, "598") == [(1, 10), (1, 20), (1, 60), (1, 70), (1, 90)]


def test_215_wants_the_direct_parent(spark):
    rows = [secret(1), (20, MAIN, "then_block", "isDebug", None, None, 1, None), (21, MAIN, "then_block", "isReady", None, None, 1, 20),
            (22, MAIN, "call_arg", None, "show", "app.Own", 1, 20), (23, MAIN, "call_arg", None, "show", "app.Own", 1, 21)]
    up = fixed_table(spark, ["type", "super_type"], C.PLATFORM_TYPES)
    facts = Facts(node_table(spark, rows, {}), spark.createDataFrame([(1, 22), (1, 23)], "src long, dst long"), up,
                  spark.createDataFrame([("A.java", "password")], "file_name string, name string"),
                  spark.createDataFrame([("A.java", "show", "Print Sink")], "file_name string, sink_name string, sink_type string"))
    assert found(RU.prepare(facts, R.type_closure(up)), "215-debug") == [(1, 22)]


def test_sinks_by_qualifier(spark):
    answer = "javax.servlet.http.HttpServletResponse"
    rows = [(1, MAIN, "call", None, "getWriter", answer, 1, None), (2, MAIN, "call", None, "getWriter", "app.Own", 1, None),
            *[(i, MAIN, "call_arg", None, "write", "java.lang.Object", 1, None) for i in (3, 4, 5)]]
    up = fixed_table(spark, ["type", "super_type"], C.PLATFORM_TYPES)
    empty = spark.createDataFrame([], "file_name string, name string, sink_name string, sink_type string")
    facts = Facts(node_table(spark, rows, {3: {"qualifier_id": 1}, 4: {"qualifier_id": 2}}), spark.createDataFrame([], "src long, dst long"), up, empty, empty)
    sinks = {r["id"]: r["sinks"] for r in RU.prepare(facts, R.type_closure(up)).nodes.filter("kind = 'call_arg'").collect()}
    assert all(f"|{s}|" in sinks[3] for s in ("servlet", "print", "transmit", "io"))
    assert sinks[4] == sinks[5] == "|io|"
