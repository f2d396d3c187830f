"""Code facts read off the events table; ``rule_sql`` has them in SQL.

Every event is a node and the next event of the same user its successor.  What the node
is follows from the event type and the number in ``props``.  Blocks enclose ten events
each, outer blocks a hundred.
"""

from functools import lru_cache

from pyspark.sql import functions as F

from plainsight.operators import reach as R
from plainsight.operators.facts import Facts
from plainsight.operators.steps import STEP_COLUMNS
from plainsight.operators.windows import with_next
from plainsight.plans import catalog as C
from plainsight.plans.rules import prepare
from plainsight.session import fixed_table, written
from plainsight.workloads.registry import Tables

NAMES = ["password", "apiKey", "userToken", "message", "ssn"]
CHECKED = ["java.lang.Exception", "java.io.IOException", "java.lang.IllegalStateException",
           "javax.servlet.UnavailableException", "java.net.BindException"]
CAUGHT = ["java.lang.Exception", "java.io.IOException", "java.net.SocketException", "java.sql.SQLException"]
WRITER_OWNERS = ["javax.servlet.http.HttpServletResponse", "jakarta.servlet.http.HttpServletResponse", "app.Own"]
# what stands for a root that holds for the classes below it
SUBTYPE = {"java.lang.Throwable": "java.io.IOException", "com.opensymphony.xwork2.Action": "com.opensymphony.xwork2.ActionSupport"}
BLOCK_TYPES = ["java.io.IOException", "javax.servlet.ServletException",
               "java.lang.IllegalStateException", "java.lang.Exception", None]


def _signature(kind: str, k: int):
    """(node kind, name, callee, declaring type) of an event."""
    d = k % 10
    if kind == "signup":
        if d < 5:
            return "var_access", NAMES[d], None, "java.lang.String"
        if d == 5:
            return "call", None, "listFiles", "java.io.File"
        if d == 6:
            return ("literal", "true", None, "boolean") if k < 40 else ("literal", "u?key=", None, "java.lang.String") if k < 60 else (
                "call", "q", "getParameter", "javax.servlet.http.HttpServletRequest")
        if d == 7:
            _, t, c = C.CRYPTO_RESULTS[(k // 10) % 3]
            return "call", None, c, t
        return "call", C.TOKEN_HEADERS[k // 10 % 8].upper(), "getHeader", "javax.servlet.http.HttpServletRequest"
    if kind == "click":
        if k < 40:
            return "ctor", None, "<init>", CHECKED[k % 5]
        if k < 56:
            return "call", None, "exec", "java.lang.Runtime"
        if k < 62:
            return "call", None, "openConnection", "java.net.URL" if k % 3 else "java.net.HttpURLConnection"
        if k < 72:
            return "call", "java.io.tmpdir" if k % 5 else "user.home", "getProperty", "java.lang.System"
        if k < 86:
            return "ctor", None, "<init>", "java.io.File" if k % 2 else "java.io.FileWriter"
        if k < 90:
            return "call", "ENCRYPT_MODE", "init", "javax.crypto.Cipher"
        if k < 97:
            return "call", "GET" if k < 94 else "POST", "setRequestMethod", "java.net.HttpURLConnection"
        return "call", None, "toURL", "java.net.URI"
    if kind == "view":
        if k < 40:
            return "catch_var", "e", None, CAUGHT[k % 4]
        if k < 58:
            return "call", None, "getMessage", "java.lang.Throwable"
        if k < 70:
            return "call", None, "getWriter", WRITER_OWNERS[k % 3]
        if k < 90:
            return "call", None, "getErrorStream", "java.lang.Process"
        if k < 95:
            return "call", None, "checkPermission", "app.Guard"
        return "call", None, "getAbsolutePath", "java.io.File"
    if kind == "purchase":
        if k % 8 == 4:
            callee = "write" if k % 16 == 4 else ["println", "print", "put"][k // 16 % 3]
            return "call_arg", None, callee, "java.io.Writer" if callee == "write" else "java.lang.Object"
        if k >= 90:
            t = ["org.apache.http.client.methods.HttpGet", "java.net.URL", "java.net.URI"][k % 3]
            return "call_arg", "https://h/p?user=" if k % 5 else "https://h/p", "<init>", t
        _, t, _, c = C.SINK_CATALOG[k % len(C.SINK_CATALOG)]
        name = "getName" if k % 7 == 0 else "https://h/p?user=" if k % 2 else "https://h/p"
        return "call_arg", name, c, "app.Any" if t == "*" else SUBTYPE.get(t, t)
    if k < 60:
        return "call_arg", None, C.BARRIER_WORDS[d] + "Value", "app.Util"
    if k < 72:
        return "call", None, "run", C.BARRIER_CALL_TYPES[k - 60]
    if k < 80:
        return "expr", None, None, "java.lang.String" if k < 77 else "int" if k < 79 else "java.lang.Class"
    if k < 84:
        return "param", "p", None, "java.lang.String"
    if k < 87:
        return "return", None, None, "java.lang.String"
    if k < 91:
        return "ctor", None, "<init>", "java.io.InputStreamReader" if k % 2 else "java.io.BufferedReader"
    if k < 95:
        return "call", None, "readLine", "java.io.BufferedReader" if k < 94 else "app.Lines"
    if k < 97:
        return "call_arg", None, "getMessage", "java.lang.Throwable"
    return "expr", None, None, "java.lang.String"


KINDS = ["signup", "click", "view", "purchase", "error"]
SIGNATURE_COLUMNS = ["event_type", "k", "kind", "name", "callee", "decl_type"]
SIGNATURES = [(e, k, *_signature(e, k)) for e in KINDS for k in range(100)]
HOUR = 3600


def next_edges(events):
    """src to dst: the next event of the same user, whatever share of all events is theirs."""
    bucket = (F.unix_micros(F.col("ts").cast("timestamp")) / (HOUR * 1_000_000)).cast("bigint")
    nxt = with_next(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"],
                    bucket, {"dst": "event_id"})
    return nxt.filter("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", "user_id")


# Typed fact columns of an event: the call it is an argument of or is made on, the callable it calls, whether it
# is thrown, the expression it is an operand of, and whether it stands in an annotation.
STEP_EXPR = [
    "CASE WHEN kind IN ('call', 'call_arg') AND k % 2 = 0 THEN before END AS qualifier_id",
    "CASE WHEN kind IN ('call', 'call_arg', 'var_access', 'ctor') AND k % 3 < 2 THEN after END AS call_id",
    "CASE WHEN kind IN ('call', 'ctor', 'call_arg') AND k % 5 < 2 THEN user_id * 100 + day(ts) DIV 8 - 1 END AS target_id",
    "CASE WHEN kind IN ('ctor', 'expr') AND k % 4 <> 1 THEN event_id END AS throw_id",
    "CASE WHEN kind IN ('literal', 'expr', 'var_access') AND k % 7 < 4 THEN after END AS expr_id",
    "CASE WHEN kind = 'var_access' AND user_id % 13 = 0 THEN 1 ELSE 0 END AS annotated"]


def event_nodes(spark, events, chain):
    sig = fixed_table(spark, SIGNATURE_COLUMNS, SIGNATURES)
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = (e.join(chain.select(F.col("src").alias("event_id"), F.col("dst").alias("after")), "event_id", "left")
         .join(chain.select(F.col("dst").alias("event_id"), F.col("src").alias("before")), "event_id", "left"))
    n = e.join(sig, ["event_type", "k"]).selectExpr(
        "event_id AS id", "user_id", "event_type", "k",
        "concat('/src/', CASE WHEN user_id % 9 = 0 THEN 'test/' ELSE 'main/' END, 'u', user_id, '.java') AS path",
        "kind", "name", "callee", "decl_type", "user_id * 100 + day(ts) DIV 8 AS callable_id",
        "1000000000 + event_id DIV 10 AS parent_id", *STEP_EXPR)
    inner = events.selectExpr("event_id DIV 10 AS b").distinct().selectExpr(
        "1000000000 + b AS id", "2000000000 + b DIV 10 AS parent_id", "b")
    outer = events.selectExpr("event_id DIV 100 AS b").distinct().selectExpr(
        "2000000000 + b AS id", "CAST(NULL AS BIGINT) AS parent_id", "b + 3 AS b")
    types = F.array(*[F.lit(t) for t in BLOCK_TYPES])
    blocks = inner.union(outer).withColumn("decl_type", F.element_at(types, (F.col("b") % 5 + 1).cast("int")))
    blocks = blocks.selectExpr(
        "id", "NULL AS user_id", "NULL AS event_type", "NULL AS k", "'/b' AS path",
        "CASE WHEN decl_type IS NULL THEN 'then_block' ELSE 'catch_block' END AS kind",
        "CASE WHEN decl_type IS NULL THEN 'isDebugOn' END AS name", "NULL AS callee", "decl_type",
        "NULL AS callable_id", "parent_id", *[f"CAST(NULL AS {t}) AS {c}" for c, t in STEP_COLUMNS.items()])
    return n.unionByName(blocks)


@lru_cache(maxsize=4)
def _closure(app_id, spark):
    types = fixed_table(spark, ["type", "super_type"], C.PLATFORM_TYPES)
    return written(R.type_closure(types, form="doubling"))


def platform_closure(spark):
    return _closure(spark.sparkContext.applicationId, spark)


def event_facts(spark, d) -> Facts:
    events = Tables(spark, d).events
    chain = written(next_edges(events))
    nodes = written(event_nodes(spark, events, chain))
    named = nodes.filter("event_type IS NOT NULL").withColumn(
        "file_name", F.substring_index("path", "/", -1))
    sensitive = named.filter("kind = 'var_access' AND user_id % 4 <> 0").select("file_name", "name").distinct()
    sinks = named.filter("event_type = 'purchase' AND user_id % 3 = 0").selectExpr(
        "file_name", "callee AS sink_name",
        "CASE k % 4 WHEN 0 THEN 'Log Sink' WHEN 1 THEN 'IPC Sink' WHEN 2 THEN 'Print Sink' ELSE 'Network Sink' END AS sink_type").distinct()
    return Facts(nodes.drop("user_id", "event_type", "k"), chain,
                 fixed_table(spark, ["type", "super_type"], C.PLATFORM_TYPES), sensitive, sinks)


@lru_cache(maxsize=4)
def _prepared(app_id, spark, d):
    return prepare(event_facts(spark, d), platform_closure(spark), form="doubling")


def prepared(spark, d):
    """Flags and edges of a data folder, written once per application and read by every rule."""
    return _prepared(spark.sparkContext.applicationId, spark, d)
