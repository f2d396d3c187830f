"""Driver tables in the shapes the operators read, with the same shapes in SQL."""

from pyspark.sql import functions as F

from plainsight.workloads.registry import Tables

# Three events make a flow and four flows a result; both follow from the event number.
STEP_COLUMNS = [
    "concat('p', event_id DIV 12 % 7) AS project",
    "element_at(array('201', '209', '532', '535', '550'), CAST(event_id DIV 12 % 5 AS INT) + 1) AS cwe",
    "CAST(event_id DIV 12 AS INT) AS result_index", "concat('F', event_id DIV 12 % 50, '.java') AS file_name",
    "CAST(event_id DIV 3 % 4 AS INT) AS flow_index", "CAST(event_id % 3 AS INT) AS step",
    "event_type AS variable_name", "concat('T', event_id DIV 3 % 2) AS type", "concat('/src/u', user_id, '.java') AS uri",
    "CAST(event_id % 500 AS INT) AS start_line", "CAST(user_id % 40 AS INT) AS start_col",
    "CAST(event_id % 500 AS INT) AS end_line", "CAST(user_id % 40 + 5 AS INT) AS end_col", "props AS code",
    "CASE WHEN event_id DIV 3 % 6 < 3 THEN 'Yes' WHEN event_id DIV 3 % 6 < 5 THEN 'No' END AS label",
    "round(event_id DIV 3 * 37 % 100 / 100, 2) AS probability",
]
STEPS_SQL = "steps AS (SELECT " + ", ".join(STEP_COLUMNS).replace(" DIV ", " // ").replace(
    "element_at(array('201', '209', '532', '535', '550'), CAST(event_id // 12 % 5 AS INT) + 1)",
    "['201', '209', '532', '535', '550'][CAST(event_id // 12 % 5 AS INT) + 1]") + " FROM events)"
FLOW_KEYS = ["project", "cwe", "result_index", "flow_index"]


def event_steps(spark, d):
    return Tables(spark, d).events.selectExpr(*STEP_COLUMNS)


# An order is a result, its lines the locations; lines of one return flag are a code flow.
LINE_COLUMNS = [
    "l_orderkey", "l_returnflag", "concat('src/f', l_suppkey, '.java') AS uri", "CAST(l_linenumber AS INT) AS line",
    "CASE WHEN l_tax > 0 THEN CAST(l_partkey % 30 AS INT) END AS col",
    "CASE WHEN l_discount > 0 THEN CAST(l_linenumber + 1 AS INT) END AS end_line", "CAST(l_quantity AS INT) AS end_col",
    "concat('v', l_partkey, ' : T', l_suppkey % 3) AS text",
    "CASE l_returnflag WHEN 'R' THEN ' YES ' WHEN 'N' THEN 'no' END AS label",
]
LINE_ORDER = "line, text, uri, end_col, col NULLS FIRST, end_line NULLS FIRST"
RULE_ROWS = [(0, "java/cwe/201", "error", "Sent data"), (1, "java/cwe/209", "warning", "Error message"),
             (2, "java/cwe/532", "error", "Log file"), (3, "java/cwe/535", "note", "Shell error"),
             (4, "java/cwe/209", "error", "Error message, direct")]
RULE_COLUMNS = ["rule_index", "rule_id", "level", "rule_message"]
RULE_IDS_ARRAY = ", ".join(f"'{r[1]}'" for r in RULE_ROWS)

RESULTS_SQL = f"""li AS (SELECT {", ".join(LINE_COLUMNS)} FROM lineitem),
loc AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {LINE_ORDER}) - 1 AS step,
  dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS flow_index,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS nth FROM li),
res AS (SELECT o_orderkey AS result_index, 'p' || (o_orderkey // 512) AS project, o_orderkey % 5 AS rule_index,
  [{RULE_IDS_ARRAY}][o_orderkey % 5 + 1] AS rule_id, o_orderstatus <> 'P' AS has_flows FROM orders),
flow_steps AS (SELECT result_index, project, rule_id, flow_index, step, label, uri, line, col, end_line, end_col, text
  FROM res JOIN loc ON l_orderkey = result_index WHERE has_flows
  UNION ALL SELECT result_index, project, rule_id, 0, 0, label, uri, line, col, end_line, end_col, text
  FROM res JOIN loc ON l_orderkey = result_index WHERE NOT has_flows AND nth = 1),
first_loc AS (SELECT * FROM res JOIN loc ON l_orderkey = result_index WHERE nth = 1)"""


ORDERS_TOGETHER = 64


def order_results(spark, d):
    """block, result_index, project, rule_index, rule_id, message, locations and code_flows.

    Orders and lines move once, as plain columns and by the ``block`` of ORDERS_TOGETHER orders, by which the result stays
    partitioned; the lines of an order become its locations and flows in its own row.
    """
    t = Tables(spark, d)
    lines = t.lineitem.filter("l_orderkey IS NOT NULL").select(
        F.col("l_orderkey").alias("result_index"), "l_orderkey", "l_returnflag", "l_suppkey", "l_linenumber", "l_tax", "l_discount",
        "l_partkey", "l_quantity", F.lit(True).alias("is_line"))
    orders = t.orders.select(F.col("o_orderkey").alias("result_index"), "o_orderstatus", F.lit(False).alias("is_line"))
    both = (lines.unionByName(orders, allowMissingColumns=True)
            .withColumn("block", F.expr(f"result_index DIV {ORDERS_TOGETHER}")).repartition("block")
            .selectExpr("block", "result_index", "is_line", "o_orderstatus <> 'P' AS has_flows", *LINE_COLUMNS))
    line = F.struct("line", "text", "uri", "end_col", "col", "end_line", "l_returnflag", "label")
    per = both.groupBy("block", "result_index").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_line"), line))).alias("lines"),
        F.collect_list(F.when(~F.col("is_line"), F.struct("has_flows"))).alias("orders"))

    def location(x, *more):
        region = F.struct(x["line"].alias("startLine"), x["col"].alias("startColumn"),
                          x["end_line"].alias("endLine"), x["end_col"].alias("endColumn"))
        physical = F.struct(F.struct(x["uri"].alias("uri")).alias("artifactLocation"), region.alias("region"))
        return F.struct(F.struct(x["text"].alias("text")).alias("message"), physical.alias("physicalLocation"), *more)

    flags = F.sort_array(F.array_distinct(F.transform("lines", lambda x: F.struct(x["l_returnflag"], x["label"]))))
    flows = F.transform(flags, lambda f: F.struct(f["label"].alias("label"), F.transform(
        F.filter("lines", lambda x: x["l_returnflag"].eqNullSafe(f["l_returnflag"])), lambda x: location(x)).alias("locations")))
    first = F.col("lines")[0]
    return per.select("*", F.inline("orders")).select(
        "block", "result_index", F.expr("concat('p', result_index DIV 512)").alias("project"),
        F.expr("CAST(result_index % 5 AS INT)").alias("rule_index"),
        F.expr(f"element_at(array({RULE_IDS_ARRAY}), CAST(result_index % 5 AS INT) + 1)").alias("rule_id"),
        F.lit("Exposed: value").alias("message"),
        F.when(F.size("lines") > 0, F.array(location(first, first["label"].alias("label")))).alias("locations"),
        F.when(F.col("has_flows") & (F.size("lines") > 0), flows).alias("code_flows"))
