"""Quality rollup and project feeds."""

from pyspark.sql import functions as F

from plainsight.operators import feeds as FE
from plainsight.operators import quality as QL
from plainsight.workloads.registry import Tables, workload

# Findings: a line item is a finding of diagnostic l_partkey % 40 in the project of its supplier.
FIND = ["concat('p', l_suppkey) AS project", "concat('D', l_partkey % 40) AS diagnostic"]
DIAG_SQL = """f AS (SELECT 'p' || l_suppkey AS project, 'D' || (l_partkey % 40) AS diagnostic FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 5 > 0),
names AS (SELECT DISTINCT 'D' || (p_partkey % 60) AS diagnostic FROM part WHERE p_partkey % 60 % 2 = 0), proj AS (SELECT 'p' || s_suppkey AS project FROM supplier),
d AS (SELECT proj.project, names.diagnostic, count(f.project)::BIGINT AS value FROM proj CROSS JOIN names LEFT JOIN f ON f.project = proj.project AND f.diagnostic = names.diagnostic GROUP BY ALL)"""


def _diag(spark, d):
    t = Tables(spark, d)
    findings = t.lineitem.filter("l_returnflag = 'R' AND l_suppkey % 5 > 0").selectExpr(*FIND)
    nodes = t.part.filter("p_partkey % 60 % 2 = 0").selectExpr("concat('D', p_partkey % 60) AS name")
    names = QL.model_names(nodes, F.lit(True))
    return QL.diagnostics(findings, t.supplier.selectExpr("concat('p', s_suppkey) AS project"), names)


@workload("diagnostics", "Q1", f"WITH {DIAG_SQL} SELECT * FROM d")
def _(spark, d):
    return _diag(spark, d)


MEAS_SQL = f"""{DIAG_SQL}, m AS (SELECT project, 'M' || (CAST(substr(diagnostic, 2) AS INT) % 6) AS measure, sum(value)::BIGINT AS value FROM d GROUP BY ALL
  UNION ALL SELECT project, 'M9', sum(value)::BIGINT FROM d WHERE diagnostic = 'D58' GROUP BY ALL)"""


def _measures(spark, d):
    values = _diag(spark, d)
    pairs = Tables(spark, d).part.filter("p_partkey % 60 % 2 = 0").selectExpr(
        "concat('M', p_partkey % 60 % 6) AS measure", "concat('D', p_partkey % 60) AS diagnostic")
    extra = pairs.filter("diagnostic = 'D58'").withColumn("measure", F.lit("M9"))
    return QL.with_descendants(values, pairs.union(extra))


@workload("benchmark_thresholds", "Q2", f"WITH {MEAS_SQL} SELECT measure, value AS threshold, count(*) AS projects FROM m GROUP BY ALL")
def _(spark, d):
    return QL.benchmark_thresholds(_measures(spark, d))


@workload("utility", "Q4", f"""
WITH {MEAS_SQL}, b AS (SELECT measure, value AS t FROM m WHERE substr(project, 2)::INT % 3 = 0), r AS (SELECT measure, min(t) AS lo, max(t) AS hi, count(*) AS n FROM b GROUP BY 1)
SELECT project, measure, value, round(CASE WHEN lo = hi THEN CASE WHEN value < hi THEN 0.999 ELSE 0.001 END
  ELSE (SELECT count(*) FROM b WHERE b.measure = m.measure AND b.t >= m.value)::DOUBLE / n END, 6) AS utility FROM m JOIN r USING (measure)""")
def _(spark, d):
    v = _measures(spark, d)
    bench = QL.benchmark_thresholds(v.filter("CAST(substr(project, 2) AS INT) % 3 = 0"))
    u = QL.utility(v, bench, F.expr("CAST(threshold AS BIGINT) DIV 4"))
    return u.withColumn("utility", F.round("utility", 6))


@workload("fixed_weights", "Q3", "SELECT r_name AS parent, n_name AS child, round(CASE WHEN n_nationkey % 4 = 0 THEN 1.0 ELSE n_nationkey / 100.0 END, 6)::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    e = _model_edges(spark, d, "CASE WHEN n_nationkey % 4 > 0 THEN CAST(round(n_nationkey / 100.0, 6) AS DOUBLE) END")
    return QL.fixed_weights(e)


@workload("equal_weights", "Q3", "SELECT r_name AS parent, n_name AS child, round(1.0 / count(*) OVER (PARTITION BY r_name), 6) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    return QL.equal_weights(_model_edges(spark, d, "1.0D")).select("parent", "child", F.round("weight", 6).alias("weight"))


def _model_edges(spark, d, weight):
    t = Tables(spark, d)
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "r_name AS parent", "n_name AS child", f"{weight} AS weight")


TREE_SQL = """leaf AS (SELECT 'y' || year(l_shipdate) AS project, l_suppkey, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL),
n AS (SELECT project, n_name, n_regionkey, sum(v * (s_suppkey % 4 + 1) / 10.0) AS v FROM leaf JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
r AS (SELECT project, r_name, sum(v * 0.5) AS v FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
i AS (SELECT r.project, 'index' AS node, sum(v) + coalesce(any_value(direct), 0) AS v FROM r LEFT JOIN (SELECT project, sum(v) * 0.1 AS direct FROM leaf WHERE l_suppkey = 3 GROUP BY 1) x ON x.project = r.project GROUP BY 1)"""


def _tree(spark, d):
    t = Tables(spark, d)
    edges = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "n_name AS parent", "s_name AS child", "CAST((s_suppkey % 4 + 1) / 10.0 AS DOUBLE) AS weight")
        .union(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("r_name", "n_name", "0.5D"))
        .union(t.region.selectExpr("'index'", "r_name", "1.0D"))
        .union(t.supplier.filter("s_suppkey = 3").selectExpr("'index'", "s_name", "0.1D")))
    leaf = t.lineitem.groupBy(F.concat(F.lit("y"), F.year("l_shipdate")).alias("project"), "l_suppkey").agg(
        F.count("*").alias("value")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "project", "s_name AS node", "value")
    return QL.rollup_tree(edges, leaf)


@workload("rollup_tree", "Q5", f"""
WITH {TREE_SQL} SELECT project, s_name AS node, round(v, 4) AS value FROM leaf JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT project, n_name, round(v, 4) FROM n UNION ALL SELECT project, r_name, round(v, 4) FROM r UNION ALL SELECT project, node, round(v, 4) FROM i""")
def _(spark, d):
    return _tree(spark, d).withColumn("value", F.round("value", 4))


@workload("compact_report", "Q6", f"""
WITH {TREE_SQL}, rep AS (SELECT r.project, '{{"factor":{{' || string_agg('"' || r_name || '":' || (round(v, 2)::DOUBLE)::VARCHAR, ',' ORDER BY r_name) || '}}}}' AS report FROM r GROUP BY 1)
SELECT project, report FROM rep WHERE project <> 'y1998'""")
def _(spark, d):
    t = Tables(spark, d)
    nodes = t.region.selectExpr("r_name AS name", "'factor' AS level")
    done = t.lineitem.selectExpr("concat('y', year(l_shipdate)) AS project").filter("project <> 'y1998'")
    return QL.compact_report(_tree(spark, d).withColumn("value", F.round("value", 2)), nodes, done)


# --- feeds ----------------------------------------------------------------------------------

@workload("unique_per_repo", "V1", """
SELECT 's' || l_suppkey AS repo, 'CVE-' || (l_partkey % 300) AS cve, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL""")
def _(spark, d):
    a = Tables(spark, d).lineitem.selectExpr("concat('s', l_suppkey) AS repo", "concat('CVE-', l_partkey % 300) AS cve", "l_orderkey AS first_order")
    return FE.unique_per_repo(a, "repo", "cve", ["first_order"])


@workload("top_repos", "V2", """
SELECT 's' || l_suppkey AS repo, count(DISTINCT l_partkey % 300) AS advisories, row_number() OVER (ORDER BY count(DISTINCT l_partkey % 300) DESC, 's' || l_suppkey) AS rank
FROM lineitem GROUP BY l_suppkey QUALIFY rank <= 40""")
def _(spark, d):
    a = Tables(spark, d).lineitem.selectExpr("concat('s', l_suppkey) AS repo", "concat('CVE-', l_partkey % 300) AS cve")
    return FE.top_repos(a, "repo", "cve", 40).withColumn("rank", F.col("rank").cast("bigint"))


@workload("latest_tag", "V4", """
SELECT user_id AS repo, arg_max(event_type || '-' || event_id, ts) AS tag, epoch_us(max(ts)) AS commit_us FROM events WHERE event_type <> 'error' GROUP BY 1""")
def _(spark, d):
    e = Tables(spark, d).events.selectExpr(
        "user_id AS repo", "concat(event_type, '-', event_id) AS tag", "CASE WHEN event_type <> 'error' THEN ts END AS ts", "event_id")
    return FE.latest_tag(e, "repo", "tag", "ts", ["event_id"]).selectExpr(
        "repo", "tag", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', commit_ts) AS commit_us")


ATTEMPTS = ["concat('c', o_custkey) AS project", "concat('java', o_orderkey % 5) AS java_version", "o_orderkey AS rank",
            "o_orderstatus = 'P' AS ok", "CASE WHEN o_orderkey % 3 = 0 THEN concat('detected', o_orderkey % 7) END AS detected"]
OUTCOME_SQL = """o AS (SELECT 'c' || o_custkey AS project, coalesce(arg_min(CASE WHEN o_orderkey % 3 = 0 THEN 'detected' || (o_orderkey % 7) ELSE 'java' || (o_orderkey % 5) END, o_orderkey) FILTER (o_orderstatus = 'P'), 'DNB') AS java_version FROM orders GROUP BY 1)"""


@workload("first_success", "V5", f"WITH {OUTCOME_SQL} SELECT * FROM o")
def _(spark, d):
    return FE.first_success(Tables(spark, d).orders.selectExpr(*ATTEMPTS))


@workload("buildable", "V6", f"WITH {OUTCOME_SQL} SELECT o.project, c_custkey AS place, java_version FROM o JOIN customer ON 'c' || c_custkey = o.project WHERE java_version <> 'DNB'")
def _(spark, d):
    t = Tables(spark, d)
    projects = t.customer.selectExpr("concat('c', c_custkey) AS project", "c_custkey AS place")
    return FE.buildable(projects, FE.first_success(t.orders.selectExpr(*ATTEMPTS)))


@workload("project_setting", "V7", f"WITH {OUTCOME_SQL}, s AS (SELECT * FROM o WHERE java_version <> 'DNB') SELECT 'c' || c_custkey AS project, coalesce(java_version, '11') AS java_version FROM customer LEFT JOIN s ON s.project = 'c' || c_custkey")
def _(spark, d):
    t = Tables(spark, d)
    known = FE.first_success(t.orders.selectExpr(*ATTEMPTS)).filter("java_version <> 'DNB'")
    return FE.project_setting(t.customer.selectExpr("concat('c', c_custkey) AS project"), known, "project", "java_version", "11")
