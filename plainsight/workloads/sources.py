"""Readers and writers, each over whole driver tables written in the source format first."""

from pyspark.sql import functions as F

from plainsight.operators import feeds as FE
from plainsight.session import scratch_path
from plainsight.sources import readers as RD
from plainsight.sources import writers as WR
from plainsight.workloads import shapes as SH
from plainsight.workloads.registry import Tables, workload
from plainsight.workloads.text import LINES


@workload("read_source_tree", "S1", "SELECT CAST(doc_id AS VARCHAR) || '.java' AS doc, md5(text) AS code_md5 FROM documents")
def _(spark, d):
    out = scratch_path(spark, "source-tree")
    docs = Tables(spark, d).documents
    # one file per document in a folder per source; the key is the first line
    WR.write_source_tree(docs.select("source", F.concat("doc_id", F.lit("\n"), "text").alias("value")), out, "source")
    files = RD.read_source_tree(spark, out, "*.txt")
    code = F.regexp_extract(F.replace("code", F.lit("\x00"), F.lit("")), r"(?s)^\d+\n(.*)$", 1)
    return files.select(F.concat(F.regexp_extract("code", r"^(\d+)\n", 1), F.lit(".java")).alias("doc"),
                        F.md5(code).alias("code_md5"))


@workload("read_parsed_items", "S2", f"""
WITH {LINES}, w AS (SELECT DISTINCT doc_id, 'variables' AS category, unnest(regexp_extract_all(text, '[A-Za-z]{{10,}}')) AS name FROM documents),
s AS (SELECT DISTINCT doc_id, 'strings' AS category, unnest(regexp_extract_all(text, '[0-9]{{3,}}')) AS name FROM documents),
c AS (SELECT DISTINCT doc_id, 'comments' AS category, line AS name FROM lines),
i AS (SELECT *, source AS type, 'm1,m2' AS methods FROM w JOIN documents USING (doc_id) UNION ALL SELECT *, NULL, 'global' FROM s JOIN documents USING (doc_id)
  UNION ALL SELECT *, NULL, '' FROM c JOIN documents USING (doc_id))
SELECT doc_id || '.java' AS file_name, category, md5(name) AS name_md5, type, methods FROM i""")
def _(spark, d):
    docs = Tables(spark, d).documents
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{10,}"), F.lit(0)))
    digits = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0)))
    two = F.array(F.lit("m1"), F.lit("m2"))
    parsed = F.struct(
        F.transform(words, lambda x: F.struct(x.alias("name"), F.col("source").alias("type"), two.alias("methods"))).alias("variables"),
        F.transform(digits, lambda x: F.struct(x.alias("name"), F.array(F.lit("global")).alias("methods"))).alias("strings"),
        F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.struct(x.alias("name"), F.lit("").alias("methods"))).alias("comments"),
        F.array().cast("array<struct<name string, methods array<string>>>").alias("sinks"),
        F.create_map(F.lit("m1"), "text").alias("methodCodeMap"))
    out = scratch_path(spark, "parsed")
    docs.select(F.to_json(F.create_map(F.concat("doc_id", F.lit(".java")), parsed)).alias("value")).write.text(out)
    items = RD.read_parsed_items(spark, out)
    return items.select("file_name", "category", F.md5("name").alias("name_md5"), "type", F.array_join("methods", ",").alias("methods"))


@workload("read_results", "S3", f"""
WITH {SH.RESULTS_SQL} SELECT CAST(result_index % 64 AS BIGINT) AS result_index, rule_id, CAST(flow_index AS BIGINT) AS flow_index,
  label, CAST(step AS BIGINT) AS step, uri, CAST(line AS BIGINT) AS start_line, CAST(coalesce(end_line, line) AS BIGINT) AS end_line, count(*) AS n
FROM flow_steps GROUP BY ALL""")
def _(spark, d):
    res = SH.order_results(spark, d)
    flows = F.transform("code_flows", lambda c: F.struct(c["label"].alias("label"), F.array(F.struct(F.transform(
        c["locations"], lambda x: F.struct(x.alias("location"))).alias("locations"))).alias("threadFlows")))
    one = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"),
                   F.struct(F.col("message").alias("text")).alias("message"), "locations", flows.alias("codeFlows"))
    # one project file per block of 64 orders; as text they are many times the tables, so they are packed
    files = res.groupBy("block").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("result_index", one.alias("r")))), lambda x: x["r"]).alias("results"))
    out = scratch_path(spark, "results")
    files.select(F.array(F.struct("results")).alias("runs")).write.option("compression", "gzip").json(out)
    steps = RD.step_rows(RD.read_results(spark, out, multi_line=False)).filter("step IS NOT NULL")
    return steps.groupBy(F.col("result_index").cast("bigint").alias("result_index"), "rule_id",
                         F.col("flow_index").cast("bigint").alias("flow_index"), "label",
                         F.col("step").cast("bigint").alias("step"), "uri",
                         F.col("start_line").cast("bigint").alias("start_line"),
                         F.col("end_line").cast("bigint").alias("end_line")).agg(F.count("*").alias("n"))


@workload("read_flow_maps", "S4", f"""
WITH {SH.STEPS_SQL} SELECT project, cwe, CAST(result_index AS BIGINT) AS result_index, file_name, CAST(flow_index AS BIGINT) AS flow_index,
  CAST(step AS BIGINT) AS step, variable_name, type, uri, code, label, probability FROM steps""")
def _(spark, d):
    nested = WR.nest_flow_maps(SH.event_steps(spark, d), results_per_map=100)
    out = scratch_path(spark, "flow-maps")
    nested.select("project", F.to_json("flow_map").alias("value")).write.partitionBy("project").text(out)
    s = RD.read_flow_maps(spark, out)
    return s.select("project", "cwe", F.col("result_index").cast("bigint"), "file_name", F.col("flow_index").cast("bigint"),
                    F.col("step").cast("bigint"), "variable_name", "type", "uri", "code", "label", "probability")


LINE_FINDINGS = ["concat('CWE-', 200 + l_partkey % 50) AS cwe", "concat('src, \"a\"/f', l_suppkey, '.java') AS path",
                 "CAST(l_linenumber AS INT) AS line", "CAST(l_quantity AS INT) AS col", "concat('p', l_suppkey % 9) AS project"]


@workload("read_findings", "S5", f"""
SELECT cwe, path, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, project, count(*) AS n FROM (SELECT {", ".join(LINE_FINDINGS)} FROM lineitem) GROUP BY ALL""")
def _(spark, d):
    out = scratch_path(spark, "findings")
    f = Tables(spark, d).lineitem.selectExpr(*LINE_FINDINGS)
    f.write.partitionBy("project").option("quoteAll", "true").option("escape", '"').csv(out)
    r = RD.read_findings(spark, out)
    return r.groupBy("cwe", "path", F.col("line").cast("bigint").alias("line"), F.col("col").cast("bigint").alias("col"),
                     "project").agg(F.count("*").alias("n"))


@workload("read_advisories", "S6", """
SELECT 'CVE-' || p_partkey AS cve_id, p_name AS summary, p_brand || '/' || p_type AS package_name, 'GHSA-' || p_size AS identifier FROM part""")
def _(spark, d):
    out = scratch_path(spark, "advisories")
    Tables(spark, d).part.selectExpr(
        "concat('CVE-', p_partkey) AS cve_id", "p_name AS summary", "concat(p_brand, '/', p_type) AS package_name",
        "array(concat('GHSA-', p_size)) AS identifiers", "p_retailprice AS unknown_field").write.json(out)
    a = RD.read_advisories(spark, out)
    return a.select("cve_id", "summary", "package_name", F.element_at("identifiers", 1).alias("identifier"))


def _cve_json(spark, d):
    p = Tables(spark, d).part

    def cpe(c):
        return F.struct(F.array(F.struct(F.concat(F.lit("cpe:2.3:a:v:"), F.col(c), F.lit(":"), "p_size").alias("criteria"))).alias("cpeMatch"))
    nodes = F.array(cpe("p_type"), F.struct(F.array(F.struct(F.lit("cpe:2.3").alias("criteria"))).alias("cpeMatch")))
    cve = F.struct(
        F.concat(F.lit("CVE-"), "p_partkey").alias("id"),
        F.array(F.struct(F.col("p_name").alias("value")), F.struct(F.lit("es").alias("value"))).alias("descriptions"),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), F.col("p_partkey") % 50 + 200).alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(nodes.alias("nodes"))).alias("configurations"))
    return p.select(cve.alias("cve"))


@workload("read_cve_feed", "S7", "SELECT 'CVE-' || p_partkey AS id, p_name AS description, 'CWE-' || (p_partkey % 50 + 200) AS cwe FROM part")
def _(spark, d):
    out = scratch_path(spark, "cves")
    _cve_json(spark, d).write.json(out)
    c = RD.read_cve_feed(spark, out)
    return c.selectExpr("cve.id AS id", "cve.descriptions[0].value AS description", "cve.weaknesses[0].description[0].value AS cwe")


@workload("flatten_cves", "V3", """
SELECT 'CWE-' || (p_partkey % 50 + 200) AS cwe, 'CVE-' || p_partkey AS cve, p_name AS description,
  p_type || ' version ' || p_size || ' |Unknown' AS products, 'https://nvd.nist.gov/vuln/detail/CVE-' || p_partkey AS link FROM part""")
def _(spark, d):
    f = FE.flatten_cves(_cve_json(spark, d))
    return f.withColumn("products", F.array_join("products", "|"))


# One model per fifty suppliers: regions over nations over the suppliers of the block.
MODEL_ROWS = """m AS (SELECT s_suppkey // 50 AS model, s_suppkey, s_name, n_name, n_nationkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@workload("read_quality_model", "S8", f"""
WITH {MODEL_ROWS} SELECT DISTINCT model, 'edge' AS part, r_name AS a, n_name AS b, round(1.0 / (n_nationkey + 2), 6)::DOUBLE AS weight FROM m
UNION ALL SELECT model, 'edge', n_name, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 0.25 END FROM m
UNION ALL SELECT DISTINCT model, 'node', r_name, 'product_factor', NULL FROM m UNION ALL SELECT DISTINCT model, 'node', n_name, 'measure', NULL FROM m
UNION ALL SELECT model, 'node', s_name, 'diagnostic', NULL FROM m""")
def _(spark, d):
    t = Tables(spark, d)
    m = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("model", F.expr("s_suppkey DIV 50"))
    no_children = F.create_map().cast("map<string,string>")
    no_weights = F.create_map().cast("map<string,double>")

    def level(df, name, child, weight):
        pairs = df.select("model", name, child, weight.alias("w")).distinct()
        g = pairs.groupBy("model", name).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(child), F.lit("{}")))).alias("children"),
            F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct(F.col(child), "w")))).alias("weights"))
        node = F.struct(F.lit("false").alias("positive"), "children", "weights")
        return g.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(name, node))).alias(name))
    factors = level(m, "r_name", "n_name", F.round(1.0 / (F.col("n_nationkey") + 2), 6))
    measures = level(m, "n_name", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.lit(0.25)))
    leaf = F.struct(F.lit("false").alias("positive"), no_children.alias("children"), no_weights.alias("weights"))
    diag = m.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("s_name", leaf))).alias("s_name"))
    model = factors.join(measures, "model").join(diag, "model").select("model", F.to_json(F.struct(
        F.struct(F.col("r_name").alias("product_factors")).alias("factors"), F.col("n_name").alias("measures"),
        F.col("s_name").alias("diagnostics"))).alias("value"))
    out = scratch_path(spark, "model")
    model.write.partitionBy("model").text(out)
    back = spark.read.text(out).select(F.col("model").cast("bigint").alias("model"), "value")
    nodes, edges = RD.model_tables(back, "value", ["model"])
    return edges.selectExpr("model", "'edge' AS part", "parent AS a", "child AS b", "weight").union(
        nodes.selectExpr("model", "'node'", "name", "level", "CAST(NULL AS DOUBLE)"))


@workload("read_label_csv", "S9", """
WITH w AS (SELECT doc_id % 500 AS f, 'variables' AS category, ltrim(unnest(string_split(replace(replace(replace(text, '"', ''), chr(10), ' '), chr(13), ' '), ','))) AS name FROM documents
  UNION ALL SELECT doc_id % 500, 'strings', source FROM documents)
SELECT 'f' || f AS "fileName", category, name, count(*) AS n FROM w WHERE name <> '' GROUP BY ALL""")
def _(spark, d):
    out = scratch_path(spark, "labels")
    quoted = F.regexp_replace(F.translate(F.replace("text", F.lit('"'), F.lit("")), "\n\r", "  "), ", *", '", "')
    Tables(spark, d).documents.select(
        F.concat(F.lit("f"), F.col("doc_id") % 500).alias("fileName"), F.concat(F.lit('"'), quoted, F.lit('"')).alias("variables"),
        F.concat(F.lit(" '"), "source", F.lit("' ,, ")).alias("strings"), F.lit("").alias("comments"), F.lit("").alias("sinks")) \
        .write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false").csv(out)
    rows = RD.read_label_csv(spark, out)
    return rows.groupBy("fileName", "category", "name").agg(F.count("*").alias("n"))


@workload("sections_to_labels", "S10", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN ['Variables', 'Strings', 'Sinks'][turn // 4 % 3 + 1] END AS head,
  CASE WHEN turn % 4 > 0 AND length(text) % 5 > 0 THEN text END AS item, CASE WHEN length(text) % 7 > 0 THEN role END AS answer FROM conversations),
h AS (SELECT *, max(CASE WHEN head IS NOT NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS head_turn FROM s),
e AS (SELECT *, sum(CASE WHEN head IS NULL AND item IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, head_turn ORDER BY turn) AS empties,
  first_value(head) OVER (PARTITION BY conv_id, head_turn ORDER BY turn) AS category FROM h)
SELECT conv_id, turn, category, md5(trim(item)) AS name_md5, CASE WHEN answer = 'user' THEN 'Yes' ELSE 'No' END AS is_sensitive
FROM e WHERE head IS NULL AND head_turn IS NOT NULL AND empties = 0 AND item IS NOT NULL AND answer IS NOT NULL""")
def _(spark, d):
    c = Tables(spark, d).conversations
    heads = F.array(F.lit("Variables"), F.lit("Strings"), F.lit("Sinks"))
    section = F.when(F.col("turn") % 4 == 0, F.element_at(heads, F.expr("CAST(turn DIV 4 % 3 + 1 AS INT)")))
    item = F.when((F.col("turn") % 4 > 0) & (F.length("text") % 5 > 0), F.col("text"))
    answer = F.when(F.length("text") % 7 > 0, F.when(F.col("role") == "user", F.lit(" YES")).otherwise(F.lit("no")))
    out = RD.sections_to_labels(c, ["conv_id"], "turn", F.expr("turn DIV 3"), section, item, answer)
    return out.select("conv_id", "turn", "category", F.md5("name").alias("name_md5"), "is_sensitive")


@workload("write_findings", "S11", f"""
WITH {SH.RESULTS_SQL} SELECT project, list_last(string_split(rule_id, '/')) AS cwe, uri AS path, CAST(line AS BIGINT) AS line,
  CAST(coalesce(col, 0) AS BIGINT) AS col, count(*) AS n FROM first_loc GROUP BY ALL""")
def _(spark, d):
    rows = WR.finding_rows(SH.order_results(spark, d), ["project"])
    out = scratch_path(spark, "written-findings")
    WR.write_findings(rows, out, "project")
    back = RD.read_findings(spark, out)
    return back.groupBy("project", "cwe", "path", F.col("line").cast("bigint").alias("line"),
                        F.col("col").cast("bigint").alias("col")).agg(F.count("*").alias("n"))


@workload("write_jsonl", "S12", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def _(spark, d):
    out = scratch_path(spark, "jsonl")
    c = Tables(spark, d).conversations
    WR.write_jsonl(c, out)
    return spark.read.schema(c.schema).json(out).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@workload("write_rule_rows", "S13", """
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) AS v FROM documents),
c AS (SELECT doc_id, replace(regexp_replace(regexp_replace(v, '[^\\x00-\\x7F]', '', 'g'), '["''\\n]', '', 'g'), '\\', '\\\\') AS v FROM w)
SELECT doc_id || '.java' AS file_name, v AS name, count(*) AS n FROM c WHERE NOT regexp_matches(lower(v), 'example|test|demo|foo|bar|baz|secret')
AND NOT regexp_matches(v, '^\\s*$') AND NOT regexp_matches(v, '^[^.]*\\.[0-9]+$') GROUP BY ALL""")
def _(spark, d):
    words = Tables(spark, d).documents.select(F.concat("doc_id", F.lit(".java")).alias("file_name"), F.explode(
        F.array_distinct(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)))).alias("name"))
    out = scratch_path(spark, "rule-rows")
    WR.write_rule_rows(WR.rule_rows(words, "strings"), out)
    return spark.read.parquet(out).groupBy("file_name", "name").agg(F.count("*").alias("n"))


ITEMS_SQL = """items AS (SELECT DISTINCT doc_id || '.java' AS file_name, CASE doc_id % 4 WHEN 0 THEN 'sinks' WHEN 1 THEN 'comments' ELSE 'variables' END AS category,
  unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS name FROM documents)"""


def word_items(spark, d):
    return Tables(spark, d).documents.select(
        F.concat("doc_id", F.lit(".java")).alias("file_name"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'sinks' WHEN 1 THEN 'comments' ELSE 'variables' END").alias("category"),
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)))).alias("name"))


@workload("nest_by_file", "S14", f"""
WITH {ITEMS_SQL} SELECT file_name, coalesce(string_agg(name, ',' ORDER BY name) FILTER (category = 'variables'), '') AS variables,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (category = 'comments'), '') AS comments,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (category = 'sinks'), '') AS sinks FROM items GROUP BY 1""")
def _(spark, d):
    n = WR.nest_by_file(word_items(spark, d), "file_name", ["name"])
    return n.select("file_name", *[F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c)
                                   for c in ("variables", "comments", "sinks")])


@workload("nest_flow_maps", "S15", f"""
WITH {SH.STEPS_SQL}, f AS (SELECT project, cwe, result_index, flow_index, string_agg(variable_name, '>' ORDER BY step) AS t FROM steps GROUP BY ALL)
SELECT project, CAST(result_index // 100 AS BIGINT) AS block, cwe, count(DISTINCT result_index) AS results, md5(string_agg(t, '|' ORDER BY result_index, flow_index)) AS flows_md5 FROM f GROUP BY ALL""")
def _(spark, d):
    n = WR.nest_flow_maps(SH.event_steps(spark, d), results_per_map=100)
    e = n.select("project", "block", F.explode("flow_map").alias("cwe", "rs"))
    flows = F.flatten(F.transform("rs", lambda r: r["flows"]))
    text = F.array_join(F.transform(flows, lambda f: F.array_join(F.transform(f["flow"], lambda s: s["variableName"]), ">")), "|")
    return e.select("project", "block", "cwe", F.size("rs").cast("bigint").alias("results"), F.md5(text).alias("flows_md5"))


@workload("advisory_report", "S16", """
SELECT n_name AS repo, CAST(1 AS BIGINT) AS part, s_name AS cve_id, '  - ' || s_name || ' | ' || 'No summary available | Severity: ' || CASE WHEN s_acctbal > 0 THEN 'HIGH' ELSE 'Unknown' END || chr(10) ||
  '    Published: Unknown date' || chr(10) || '    Advisory: https://a/' || s_suppkey AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 0, '', 'Repository: ' || n_name || ' (' || count(*) || ' unique advisories)' FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def _(spark, d):
    t = Tables(spark, d)
    a = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "n_name AS repo", "s_name AS cve_id", "CAST(NULL AS STRING) AS summary", "CASE WHEN s_acctbal > 0 THEN 'HIGH' END AS severity",
        "CAST(NULL AS STRING) AS published_at", "concat('https://a/', s_suppkey) AS html_url")
    return WR.advisory_report(a).withColumn("part", F.col("part").cast("bigint"))
