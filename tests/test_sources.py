"""Readers and writers on small files."""

import glob
import json
import os

from pyspark.sql import functions as F

from plainsight.sources import readers as RD
from plainsight.sources import writers as WR


def test_source_tree_and_base_names(spark, tmp_path):
    for p, text in [("a/A.java", "one\n"), ("b/c/A.java", "two"), ("b/B.txt", "no")]:
        path = tmp_path / p
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = RD.read_source_tree(spark, str(tmp_path))
    assert sorted((os.path.basename(r["path"]), r["code"]) for r in files.collect()) == [("A.java", "one\n"), ("A.java", "two")]
    one = RD.one_per_base_name(files).collect()
    assert len(one) == 1 and one[0]["code"] == "two"


def test_parsed_items(spark, tmp_path):
    good = {"A.java": {"variables": [{"name": "x", "type": "int", "methods": ["run", "global"]}], "strings": [], "comments": [{"name": "note", "methods": ""}],
                       "sinks": [{"name": "log", "methods": ["run"]}], "methodCodeMap": {"run": "log(x)"}}}
    failed = {"B.java": {"variables": [], "strings": [], "comments": [], "sinks": [], "methodCodeMap": []}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(good) + "\n" + json.dumps(failed) + "\n")
    items = {(r["category"], r["name"], r["type"], tuple(r["methods"])) for r in RD.read_parsed_items(spark, str(path)).collect()}
    assert items == {("variables", "x", "int", ("run", "global")), ("comments", "note", None, ()), ("sinks", "log", None, ("run",))}
    methods = RD.parsed_methods(spark.read.text(str(path)), "value").collect()
    assert [tuple(r) for r in methods] == [("A.java", "run", "log(x)")]


def location(line, text="v : int", label=None, **region):
    return {"message": {"text": text}, "label": label, "physicalLocation": {"artifactLocation": {"uri": "src/A%20b.java"}, "region": {"startLine": line, **region}}}


def test_results(spark, tmp_path):
    flow = {"threadFlows": [{"locations": [{"location": location(3)}, {"location": location(4, "w", startColumn=2, endColumn=5)}]}]}
    doc = {"runs": [{"results": [
        {"ruleId": "java/cwe/201", "ruleIndex": 0, "message": {"text": "m"}, "locations": [location(9, startColumn=7)], "codeFlows": [flow, flow]},
        {"ruleId": "java/cwe/532", "ruleIndex": 1, "message": {"text": "m"}, "locations": [location(1, label="yes")]}]}]}
    path = tmp_path / "r.sarif"
    path.write_text(json.dumps(doc, indent=1))
    res = RD.read_results(spark, str(path))
    steps = RD.step_rows(res).orderBy("result_index", "flow_index", "step").collect()
    assert [(s["result_index"], s["flow_index"], s["step"], s["start_line"], s["end_line"], s["start_col"], s["end_col"], s["type"]) for s in steps] == [
        (0, 0, 0, 3, 3, 0, 0, "int"), (0, 0, 1, 4, 4, 2, 5, ""), (0, 1, 0, 3, 3, 0, 0, "int"), (0, 1, 1, 4, 4, 2, 5, ""), (1, 0, 0, 1, 1, 0, 0, "int")]
    assert steps[0]["uri"] == "src/A b.java" and steps[-1]["label"] == "yes"
    rows = WR.finding_rows(res).orderBy("cwe").collect()
    assert [tuple(r) for r in rows] == [("201", "src/A%20b.java", 9, 7), ("532", "src/A%20b.java", 1, 0)]


def test_findings_named_by_file(spark, tmp_path):
    (tmp_path / "jena-5.4.0.csv").write_text('"201","src/a, b.java","5","7"\n')
    r = RD.read_findings(spark, str(tmp_path)).collect()
    assert [tuple(x) for x in r] == [("201", "src/a, b.java", 5, 7, "jena-5.4.0")]


def test_flow_maps_round_trip(spark, tmp_path):
    rows = [("p", "201", i, "A.java", 0, s, f"v{s}", "T", "u", 1, 1, 1, 2, "c", "Yes", 0.5) for i in range(5) for s in (1, 0)]
    cols = ("project string, cwe string, result_index int, file_name string, flow_index int, step int, variable_name string, type string, uri string, "
            "start_line int, start_col int, end_line int, end_col int, code string, label string, probability double")
    steps = spark.createDataFrame(rows, cols)
    nested = WR.nest_flow_maps(steps, results_per_map=2)
    assert nested.count() == 3
    back = RD.flow_map_steps(nested.select("project", F.to_json("flow_map").alias("j")), "j", ["project"]).select(*steps.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, steps.collect()))


def test_quality_model(spark, tmp_path):
    model = {"factors": {"product_factors": {"P": {"positive": "false", "children": {"M1": {}, "M2": {}}, "weights": {"M1": 0.3}}}},
             "measures": {"M1": {"positive": "false", "children": {"D": {}}, "weights": {}}, "M2": {"positive": "true"}},
             "diagnostics": {"D": {"positive": "false", "toolName": "t"}}}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(model, indent=1))
    nodes, edges = RD.read_quality_model(spark, str(path))
    assert sorted((r["parent"], r["child"], r["weight"]) for r in edges.collect())[1:] == [("P", "M1", 0.3), ("P", "M2", None)]
    assert {(r["name"], r["level"], r["positive"], r["tool"]) for r in nodes.collect()} == {
        ("P", "product_factor", False, None), ("M1", "measure", False, None), ("M2", "measure", True, None), ("D", "diagnostic", False, "t")}


def test_sheet_sections(spark):
    sheet = spark.createDataFrame([
        (0, "Variables", None, None), (1, None, "a", "yes"), (2, None, " b ", "NO"), (3, None, "c", None), (4, None, None, None), (5, None, "late", "yes"),
        (6, "Sinks", None, None), (7, None, "d", " Yes "), (8, "Strings", None, None), (9, None, "e", "maybe")], "row_no int, head string, item string, answer string") \
        .withColumn("file", F.lit("A"))
    got = RD.sections_to_labels(sheet, ["file"], "row_no", F.expr("row_no DIV 2"), F.col("head"), F.col("item"), F.col("answer"))
    assert [(r["category"], r["name"], r["is_sensitive"]) for r in got.orderBy("row_no").collect()] == [
        ("Variables", "a", "Yes"), ("Variables", "b", "No"), ("Sinks", "d", "Yes"), ("Strings", "e", "No")]


def test_rule_rows_and_report(spark):
    items = spark.createDataFrame([("A", "{k: v1, l: v2}"), ("A", "a test"), ("A", 'say "x"')], "file_name string, name string")
    assert sorted(r["name"] for r in WR.rule_rows(items, "strings").collect()) == ["say x", "v1", "v2"]
    text = [r["line"] for r in WR.rule_row_text(WR.rule_rows(items, "strings")).orderBy("line").collect()]
    assert text[0] == '    - ["A", "say x"]'
    adv = spark.createDataFrame([("r", "CVE-1", None, "HIGH", None, None)], "repo string, cve_id string, summary string, severity string, published_at string, html_url string")
    assert [r["text"].split("\n")[0] for r in WR.advisory_report(adv).orderBy("part").collect()] == [
        "Repository: r (1 unique advisories)", "  - CVE-1 | No summary available | Severity: HIGH"]


def test_findings_of_a_project_come_together(spark, tmp_path):
    rows = [(f"p{i % 20}", "209", f"a{i}", i, 0) for i in range(400)]
    findings = spark.createDataFrame(rows, "project string, cwe string, path string, line int, col int").repartition(8)
    out = tmp_path / "findings"
    WR.write_findings(findings, str(out), "project")
    assert len(list(out.glob("project=*/*.csv"))) == 20  # not one per project and task
    assert sorted(r["path"] for r in RD.read_findings(spark, str(out)).collect()) == sorted(r[2] for r in rows)


def test_rule_rows_clean_each_value_once(spark):
    items = spark.createDataFrame([("f", "{a: b, c: d}"), ("f", "plain"), ("f", "my test"), ("f", None)], "file_name string, name string")
    rows = WR.rule_rows(items, "strings")
    assert sorted(r["name"] for r in rows.collect()) == ["b", "d", "plain"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("example|test") == 1


def test_source_tree_is_written_by_many_tasks(spark, tmp_path):
    from plainsight.workloads.registry import REGISTRY
    docs = [(i, f"line {i}\nend", f"src{i % 2}") for i in range(200)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = REGISTRY["read_source_tree"].run(spark, str(tmp_path))
    files = found.inputFiles()
    assert len(files) == 200
    assert len({f.rsplit("/", 1)[-1].split("-")[1] for f in files}) > 1  # task numbers
    assert sorted(int(r["doc"][:-5]) for r in found.collect()) == list(range(200))


def test_orders_and_lines_become_results_in_one_move(spark, tmp_path):
    from plainsight.session import checkpoint_root
    from plainsight.workloads import REGISTRY, shapes
    lines = [(1, "R", 5, 2, 0.0, 0.1, 7, 3.0), (1, "N", 6, 1, 0.1, 0.0, 8, 4.0), (1, "R", 5, 1, 0.1, 0.0, 9, 4.0), (1, "R", 5, 1, 0.1, 0.0, 9, 4.0),
             (2, None, 4, 3, 0.1, 0.0, 1, 1.0), (2, "A", 4, 2, 0.1, 0.0, 1, 1.0), (65, "N", 3, 1, 0.0, 0.0, 2, 2.0), (99, "R", 1, 1, 0.0, 0.0, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_suppkey long, l_linenumber int, l_tax double, l_discount double, "
                          "l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "O"), (2, "P"), (3, "O"), (65, "O"), (65, "O")], "o_orderkey long, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet"))
    res = shapes.order_results(spark, str(tmp_path))
    # the tables meet in one move, also for the files, where each grouping and join moved all rows
    plan = res.groupBy("block").agg(F.collect_list("code_flows"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "SortMergeJoin" not in plan
    got = {r["result_index"]: r for r in res.collect()}
    assert sorted(r["result_index"] for r in res.collect()) == [1, 2, 3, 65, 65]
    assert got[3]["locations"] is None and got[3]["code_flows"] is None
    assert [(f["label"], [(x["physicalLocation"]["region"]["startLine"], x["message"]["text"]) for x in f["locations"]]) for f in got[1]["code_flows"]] == [
        ("no", [(1, "v8 : T0")]), (" YES ", [(1, "v9 : T2"), (1, "v9 : T2"), (2, "v7 : T2")])]
    assert [x["message"]["text"] for x in got[1]["locations"]] == ["v8 : T0"] and got[1]["locations"][0]["label"] == "no"
    assert got[2]["code_flows"] is None and got[2]["locations"][0]["physicalLocation"]["region"]["startLine"] == 2
    rows = REGISTRY["read_results"].run(spark, str(tmp_path)).collect()
    assert sorted((r["result_index"], r["flow_index"], r["step"], r["start_line"], r["end_line"], r["n"]) for r in rows) == [
        (0, 0, 0, 1, 1, 1), (0, 0, 0, 1, 1, 1), (0, 1, 0, 1, 1, 1), (0, 1, 1, 1, 1, 1), (0, 1, 2, 2, 3, 1), (1, 0, 0, 1, 1, 1), (1, 0, 0, 2, 2, 1)]
    # the files are written packed
    folder = max(glob.glob(f"{checkpoint_root(spark)}/plainsight/results-*") or glob.glob("/tmp/plainsight-ckpt-*/plainsight/results-*"), key=os.path.getmtime)
    assert glob.glob(f"{folder}/*.json.gz") and not glob.glob(f"{folder}/*.json")


def test_source_tree_files_are_written_and_read_as_they_are(spark, tmp_path):
    import gzip
    tree = tmp_path / "tree"
    rows = [("a", "one\ntwo"), ("a", "one\ntwo"), ("b/c", "three\x00"), (None, "four"), ("", ""), ("a", None)]
    WR.write_source_tree(spark.createDataFrame(rows, "source string, value string"), str(tree), "source")
    # one complete file a row, equal rows too, and nothing beside them (Spark's writer leaves a checksum for every file)
    there = sorted((p.parent.name, p.read_bytes()) for p in tree.rglob("*") if p.is_file())
    none = "source=__HIVE_DEFAULT_PARTITION__"
    assert there == sorted([("source=a", b"one\ntwo\x00")] * 2 + [("source=b%2Fc", b"three\x00\x00"), (none, b"four\x00"), (none, b"\x00"), ("source=a", b"\x00")])
    found = RD.read_source_tree(spark, str(tree), "*.txt")
    assert "binaryFile" in found._jdf.queryExecution().executedPlan().toString()  # the text reader looks for a codec for every file
    WR.write_source_tree(spark.createDataFrame([], "source string, value string"), str(tmp_path / "none"), "source")
    assert RD.read_source_tree(spark, str(tmp_path / "none"), "*.txt").count() == 0

    def raw(rows):
        return sorted((r["path"], r["file_name"], bytes(r["c"])) for r in rows.withColumn("c", F.col("code").cast("binary")).collect())
    (tree / "source=a" / "Odd ü.java").write_bytes(b"\xef\xbb\xbf\xff\xfe bytes\r\n")
    (tree / "source=a" / "Empty.java").write_bytes(b"")
    (tree / "source=a" / "_hidden.java").write_text("no")
    (tree / "source=a" / "Packed.java.gz").write_bytes(gzip.compress(b"packed"))
    for glob_, n in [("*.txt", 6), ("*.java", 1), ("*.java.gz", 1), ("*.{java,txt}", 7), ("*", 8)]:
        text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob_).text(str(tree), wholetext=True)
        text = text.select(F.input_file_name().alias("path"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("code"))
        got = raw(RD.read_source_tree(spark, str(tree), glob_))
        assert len(got) == n and got == raw(text)
    assert [r["code"] for r in RD.read_source_tree(spark, str(tree), "*.java.gz").collect()] == ["packed"]
