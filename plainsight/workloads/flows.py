"""Flow and result operators over events (steps) and orders with their lines (results)."""

from pyspark.sql import functions as F

from plainsight.operators import flows as FL
from plainsight.session import fixed_table, values_sql
from plainsight.sources import readers as RD
from plainsight.workloads import shapes as SH
from plainsight.workloads.registry import Tables, workload

KEYS = SH.FLOW_KEYS
STEPS = SH.STEPS_SQL


def _big(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


# Every supplier is a file; its code are the texts of the documents that share its number, counted round.
FILES_SQL = """n AS (SELECT count(*) AS suppliers FROM supplier),
files AS (SELECT 'src/f' || (doc_id % suppliers + 1) || '.java' AS uri, string_agg(text, chr(10) ORDER BY doc_id) AS code FROM documents, n GROUP BY 1)"""


@workload("build_flow_steps", "F1", f"""
WITH {SH.RESULTS_SQL}, {FILES_SQL}, j AS (SELECT s.*, coalesce(col, 0) AS c1, coalesce(end_col, col, 0) AS c2, string_split(code, chr(10)) AS lines FROM flow_steps s JOIN files USING (uri)),
k AS (SELECT *, lines[line] AS l FROM j WHERE line <= len(lines))
SELECT result_index, flow_index, step, uri, CAST(line AS BIGINT) AS start_line, CASE WHEN greatest(0, c1 - 1) <= least(c2 - 1, length(l))
  THEN substr(l, greatest(0, c1 - 1) + 1, least(c2 - 1, length(l)) - greatest(0, c1 - 1)) ELSE text END AS variable_name,
  md5(array_to_string(lines[greatest(1, line - 3):line + 3], chr(10))) AS code_md5, trim(substr(text, strpos(text, ':') + 1)) AS type, label FROM k""")
def _(spark, d):
    t = Tables(spark, d)
    suppliers = t.supplier.count()
    uri = F.concat(F.lit("src/f"), F.col("doc_id") % suppliers + 1, F.lit(".java"))
    texts = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    files = t.documents.groupBy(uri.alias("uri")).agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("code"))
    steps = RD.step_rows(SH.order_results(spark, d)).filter("step IS NOT NULL")
    out = FL.build_flow_steps(steps, files, [])
    return _big(out, "flow_index", "step", "start_line").select(
        "result_index", "flow_index", "step", "uri", "start_line", "variable_name", F.md5("code").alias("code_md5"), "type", "label")


@workload("keep_verified", "F2", f"""
WITH {SH.RESULTS_SQL} SELECT result_index, count(DISTINCT CASE WHEN has_flows THEN flow_index END)::BIGINT AS flows FROM (
  SELECT f.*, has_flows FROM flow_steps f JOIN res USING (result_index)) WHERE trim(label) = 'YES' GROUP BY 1""")
def _(spark, d):
    kept = FL.keep_verified(SH.order_results(spark, d))
    return kept.select("result_index", F.greatest(F.coalesce(F.size("code_flows"), F.lit(0)), F.lit(0)).cast("bigint").alias("flows"))


@workload("verified_counts", "F2", f"""
WITH {SH.RESULTS_SQL}, f AS (SELECT result_index, flow_index, any_value(label) AS label FROM flow_steps GROUP BY ALL)
SELECT count(*) AS total, count(*) FILTER (label IS NULL OR trim(label) <> 'YES') AS removed FROM f""")
def _(spark, d):
    return FL.verified_counts(SH.order_results(spark, d))


@workload("apply_flow_labels", "F3", f"""
WITH {SH.RESULTS_SQL}, f AS (SELECT result_index, has_flows, flow_index, any_value(trim(label)) AS old FROM (SELECT f.*, has_flows FROM flow_steps f JOIN res USING (result_index)) GROUP BY ALL),
new AS (SELECT o_orderkey AS result_index, i AS flow_index, CASE WHEN (o_orderkey + i) % 2 = 0 THEN 'Yes' ELSE 'No' END AS label FROM orders, (VALUES (0), (1)) AS v(i) WHERE o_orderkey % 3 > 0)
SELECT f.result_index, f.flow_index, CASE WHEN has_flows THEN coalesce(n.label, old) ELSE coalesce(m.label, old) END AS label FROM f
LEFT JOIN new n ON n.result_index = f.result_index AND n.flow_index = f.flow_index
LEFT JOIN new m ON m.result_index = f.result_index AND m.flow_index = 1""")
def _(spark, d):
    res = SH.order_results(spark, d)
    labels = Tables(spark, d).orders.filter("o_orderkey % 3 > 0").select(
        F.col("o_orderkey").alias("result_index"), F.explode(F.array(F.lit(0), F.lit(1))).alias("flow_index")).withColumn(
        "label", F.when((F.col("result_index") + F.col("flow_index")) % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")))
    out = FL.apply_flow_labels(res, labels, ["result_index"])
    return out.select("result_index", F.posexplode(F.when(F.size("code_flows") > 0, F.transform("code_flows", lambda x: x["label"])).otherwise(
        F.transform("locations", lambda x: x["label"]))).alias("flow_index", "label")).select(
        "result_index", F.col("flow_index").cast("bigint"), F.trim("label").alias("label"))


FLOWS_SQL = f"{STEPS}, flows AS (SELECT project, cwe, result_index, flow_index, any_value(label) AS label, any_value(probability) AS probability FROM steps GROUP BY project, cwe, result_index, flow_index)"


def _flows(spark, d):
    s = SH.event_steps(spark, d)
    return s.groupBy(*KEYS).agg(F.max("label").alias("label"), F.max("probability").alias("probability"))


@workload("apply_reviews", "F4", f"""
WITH {FLOWS_SQL} SELECT f.project, f.cwe, f.result_index, f.flow_index, CASE WHEN l.doc_id IS NULL THEN label WHEN toxic = 1 THEN label WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS label
FROM flows f LEFT JOIN labels l ON l.doc_id = f.result_index AND f.flow_index = 0""")
def _(spark, d):
    reviews = Tables(spark, d).labels.selectExpr(
        "CAST(doc_id AS INT) AS result_index", "0 AS flow_index",
        "CASE WHEN toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS label")
    return FL.apply_reviews(_flows(spark, d).drop("probability"), reviews, ["result_index", "flow_index"])


@workload("write_back_predictions", "F5", f"""
WITH {FLOWS_SQL} SELECT project, cwe, result_index, flow_index, CASE WHEN result_index % 2 = 0 THEN CASE WHEN round(1 - probability, 2) > 0.7 THEN 'Yes' ELSE 'No' END ELSE label END AS label,
  CASE WHEN result_index % 2 = 0 THEN round(1 - probability, 2) ELSE probability END AS probability FROM flows""")
def _(spark, d):
    f = _flows(spark, d)
    pred = f.filter("result_index % 2 = 0").selectExpr("cwe", "result_index", "flow_index", "round(1 - probability, 2) AS probability")
    return FL.write_back_predictions(f, pred)


NUMBERED = f"""WITH {SH.RESULTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY rule_index, result_index) - 1 AS idx FROM first_loc),
kept AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY project, uri, line ORDER BY idx) = 1)"""


def _located(spark, d):
    return FL.result_locations(SH.order_results(spark, d).filter("locations IS NOT NULL"), ["project"])


def _rules(spark):
    return fixed_table(spark, SH.RULE_COLUMNS, SH.RULE_ROWS).withColumn("cwe", F.element_at(F.split("rule_id", "/"), -1))


@workload("findings_by_rule", "F6", f"""
{NUMBERED}, r AS (SELECT *, list_last(string_split(rule_id, '/')) AS cwe FROM {values_sql(SH.RULE_COLUMNS, SH.RULE_ROWS)}),
f AS (SELECT cwe, arg_min(level, rule_index) AS level, arg_min(rule_message, rule_index) AS rule_message FROM r GROUP BY 1)
SELECT project, f.cwe, any_value(level) AS level, any_value(rule_message) AS rule_message, count(*) AS findings, min(idx) AS first_index, max(idx) AS last_index
FROM kept JOIN f ON f.cwe = list_last(string_split(rule_id, '/')) GROUP BY project, f.cwe""")
def _(spark, d):
    bucket = F.expr("rule_index * 1000000000L + result_index DIV 256")
    return FL.findings_by_rule(_located(spark, d), _rules(spark), ["project"], bucket)


@workload("findings_by_file", "F7", f"""
WITH {SH.RESULTS_SQL}, r AS (SELECT * FROM {values_sql(SH.RULE_COLUMNS, SH.RULE_ROWS)})
SELECT uri AS path, result_index // 4096 AS block, md5(string_agg(concat_ws(':', result_index, list_last(string_split(r.rule_id, '/')), level, rule_message, line, coalesce(end_line, line)), '|' ORDER BY result_index)) AS findings_md5, count(*) AS n
FROM first_loc JOIN r USING (rule_index) GROUP BY 1, 2""")
def _(spark, d):
    out = FL.findings_by_file(_located(spark, d), _rules(spark), [], 4096)
    text = F.transform("findings", lambda x: F.concat_ws(
        ":", x["result_index"].cast("string"), x["cwe"], x["level"], x["rule_message"], x["start_line"].cast("string"), x["end_line"].cast("string")))
    return out.select("path", "block", F.md5(F.array_join(text, "|")).alias("findings_md5"), F.size("findings").cast("bigint").alias("n"))


SIG_SQL = f"""{STEPS}, sig AS (SELECT project, cwe, result_index, flow_index, sha256('CWE=' || cwe || '|' || string_agg(variable_name || '::' || type, '→' ORDER BY step)) AS signature
  FROM steps WHERE label IN ('Yes', 'No') GROUP BY project, cwe, result_index, flow_index)"""


@workload("dedup_flows", "F8", f"""
WITH {SIG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY project, cwe, result_index, flow_index) AS rn, count(*) OVER (PARTITION BY signature) AS copies FROM sig)
SELECT signature, copies, project, cwe, result_index, flow_index FROM r WHERE rn = 1""")
def _(spark, d):
    return FL.dedup_flows(SH.event_steps(spark, d), KEYS)


@workload("dedup_counts", "F8", f"""
WITH {SIG_SQL} SELECT (SELECT count(*) FROM (SELECT DISTINCT project, cwe, result_index, flow_index FROM steps)) AS total, (count(*) - count(DISTINCT signature))::BIGINT AS duplicates, count(DISTINCT signature) AS kept FROM sig""")
def _(spark, d):
    return FL.dedup_counts(SH.event_steps(spark, d), KEYS)


@workload("flow_hash", "F9", f"""
WITH {STEPS} SELECT project, cwe, result_index, flow_index, md5(string_agg(concat(step, '|', variable_name, '|', uri, '|', type, '|', code), '~~' ORDER BY step)) AS flow_hash FROM steps GROUP BY project, cwe, result_index, flow_index""")
def _(spark, d):
    return FL.flow_hash(SH.event_steps(spark, d), KEYS)


@workload("flows_for_result", "F10", f"""
WITH {SH.RESULTS_SQL} SELECT result_index, flow_index, trim(any_value(label)) AS label, count(*) AS steps FROM flow_steps
WHERE result_index IN (SELECT result_index FROM res WHERE has_flows) GROUP BY ALL""")
def _(spark, d):
    f = FL.flows_for_result(SH.order_results(spark, d), F.lit(True))
    return f.select("result_index", F.col("flow_index").cast("bigint"), F.trim("flow.label").alias("label"),
                    F.size("flow.locations").cast("bigint").alias("steps"))


@workload("labelled_flow_counts", "F11", f"WITH {FLOWS_SQL} SELECT project, cwe, coalesce(label, '') AS label, count(*) AS flows FROM flows GROUP BY ALL")
def _(spark, d):
    return FL.labelled_flow_counts(_flows(spark, d), ["project", "cwe"])


@workload("contiguous_ranges", "F13", """
WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'N'), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM n)
SELECT l_orderkey, CAST(min(n) AS BIGINT) AS range_start, CAST(max(n) AS BIGINT) AS range_end, CAST(count(*) AS BIGINT) AS size FROM g GROUP BY l_orderkey, run""")
def _(spark, d):
    return FL.contiguous_ranges(Tables(spark, d).lineitem.filter("l_returnflag <> 'N'"), ["l_orderkey"], "l_linenumber", block=3)


@workload("flow_text", "C7", f"""
WITH {STEPS} SELECT project, cwe, result_index, flow_index, md5('CWE = ' || cwe || ', Flows = ' || string_agg('{{''step=' || step || ', variableName=' || variable_name || ', type=' || type || ', code=' || code || ', ''}}', '' ORDER BY step)) AS text_md5
FROM steps GROUP BY project, cwe, result_index, flow_index""")
def _(spark, d):
    t = FL.flow_text(SH.event_steps(spark, d), ["project", "result_index", "flow_index"])
    return t.select(*KEYS, F.md5("flow_text").alias("text_md5"))


@workload("label_flows", "C9", f"WITH {FLOWS_SQL} SELECT project, cwe, result_index, flow_index, CASE WHEN probability > 0.7 THEN 'Yes' ELSE 'No' END AS label FROM flows")
def _(spark, d):
    return _flows(spark, d).select(*KEYS, FL.label_flows("probability").alias("label"))
