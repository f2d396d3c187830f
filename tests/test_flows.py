"""Flow labels, keys, duplicates and findings."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from plainsight.operators import flows as FL
from plainsight.operators import scoring as SC

STEP = "project string, cwe string, result_index int, flow_index int, step int, variable_name string, type string, uri string, code string, label string"


def steps(spark, rows):
    return spark.createDataFrame(rows, STEP)


ROWS = [
    ("p2", "201", 0, 0, 0, "a ", "T", "u", "x", "Yes"), ("p2", "201", 0, 0, 1, "b", "T", "u", "y", "Yes"),
    ("p1", "201", 5, 0, 1, "b", "T", "u", "other", "No"), ("p1", "201", 5, 0, 0, "a", "T", "u", "code", "No"),
    ("p1", "209", 5, 1, 0, "a", "T", "u", "x", "Yes"), ("p1", "209", 6, 0, 0, "a", "T", "u", "x", "maybe"),
    ("p1", "209", 7, 0, None, None, None, None, None, "Yes"), ("p1", "209", 8, 0, 0, "q", "T", "u", "x", None),
]
KEYS = ["project", "cwe", "result_index", "flow_index"]


def test_dedup_keeps_first_in_key_order(spark):
    s = steps(spark, ROWS)
    got = sorted((r["project"], r["cwe"], r["result_index"], r["copies"]) for r in FL.dedup_flows(s, KEYS).collect())
    assert got == [("p1", "201", 5, 2), ("p1", "209", 5, 1)]
    assert FL.dedup_counts(s, KEYS).first() == Row(total=6, duplicates=1, kept=2)


def test_two_keys_differ(spark):
    s = steps(spark, ROWS[:4])
    assert FL.flow_signature(s, ["project"]).select("signature").distinct().count() == 1
    assert FL.flow_hash(s, ["project"]).select("flow_hash").distinct().count() == 2
    text = FL.flow_text(steps(spark, ROWS[4:5]), ["project"]).first()["flow_text"]
    assert text == "CWE = 209, Flows = {'step=0, variableName=a, type=T, code=x, '}"


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.7,), (0.70001,)], "p double")
    assert [r[0] for r in df.select(FL.label_flows("p")).collect()] == ["No", "Yes"]


RESULT = ("id int, locations array<struct<uri:string,label:string>>, "
          "code_flows array<struct<label:string,locations:array<string>>>")


def results(spark):
    return spark.createDataFrame([
        (1, [("u", "yes")], [(" YES ", []), ("no", []), (None, [])]),
        (2, [("u", " Yes"), ("w", "no")], None), (3, [("u", "yes")], [("no", [])]), (4, None, None), (5, [], []),
    ], RESULT)


def test_keep_verified(spark):
    got = {r["id"]: r for r in FL.keep_verified(results(spark)).collect()}
    assert sorted(got) == [1, 2] and len(got[1]["code_flows"]) == 1 and [x["uri"] for x in got[2]["locations"]] == ["u"]
    assert FL.verified_counts(results(spark)).first() == Row(total=6, removed=4)


def test_apply_flow_labels(spark):
    labels = spark.createDataFrame([(1, 1, "Yes"), (2, 0, "No"), (2, 1, "Yes"), (3, 7, "Yes")], "id int, flow_index int, label string")
    got = {r["id"]: r for r in FL.apply_flow_labels(results(spark), labels, ["id"]).collect()}
    assert [x["label"] for x in got[1]["code_flows"]] == [" YES ", "Yes", None]
    assert [x["label"] for x in got[2]["locations"]] == ["Yes", "Yes"]
    assert [x["label"] for x in got[3]["code_flows"]] == ["no"] and got[3]["locations"][0]["label"] == "Yes"


def test_reviews_and_predictions(spark):
    flows = spark.createDataFrame([("201", 1, 0, "No", 0.1), ("201", 2, 0, "No", 0.2)], "cwe string, result_index int, flow_index int, label string, probability double")
    rev = spark.createDataFrame([("201", 1, 0, "Yes"), ("201", 2, 0, "perhaps")], "cwe string, result_index int, flow_index int, label string")
    got = FL.apply_reviews(flows, rev, ["cwe", "result_index", "flow_index"]).orderBy("result_index").collect()
    assert [r["label"] for r in got] == ["Yes", "No"]
    pred = spark.createDataFrame([("201", 2, 0, 0.9)], "cwe string, result_index int, flow_index int, probability double")
    got = FL.write_back_predictions(flows, pred).orderBy("result_index").collect()
    assert [(r["label"], r["probability"]) for r in got] == [("No", 0.1), ("Yes", 0.9)]


def test_location_seen_under_two_rules(spark):
    located = spark.createDataFrame([
        ("p", 0, 1, "209", "A.java", 5), ("p", 1, 0, "201", "A.java", 5), ("p", 2, 1, "209", "B.java", 1)],
        "project string, result_index int, rule_index int, cwe string, path string, start_line int")
    got = FL.indexed_findings(located, ["project"], F.col("rule_index"))
    # numbers count in rule order before the duplicate goes
    assert sorted((r["path"], r["cwe"], r["index"]) for r in got.collect()) == [("A.java", "201", 0), ("B.java", "209", 2)]


def test_ranges(spark):
    df = spark.createDataFrame([("D", n) for n in (2, 3, 5, 6, 7, 9, 9, 100)] + [("E", 4)], "c string, n int")
    got = FL.contiguous_ranges(df, ["c"], "n", block=3)
    assert sorted((r["c"], r["range_start"], r["range_end"]) for r in got.collect()) == [
        ("D", 2, 3), ("D", 5, 7), ("D", 9, 9), ("D", 100, 100), ("E", 4, 4)]


def test_merged_graph(spark):
    cols = "variable string, file_name string, flow_no int, step int, node string, type string, context string"
    flows = spark.createDataFrame([
        ("v", "A", 0, 0, "x", "int", "c1"), ("v", "A", 0, 1, "y", "int", "c2"),
        ("v", "A", 1, 0, "x", "long", "c1"), ("v", "A", 1, 1, "z", "int", "c4"), ("v", "A", 2, 0, "y", "int", "c5")], cols)
    lone = spark.createDataFrame([("v", "A", 9, 0, "v", "t", "no"), ("w", "A", 9, 0, "w", "t", "yes")], cols)
    got = {(r["variable"], r["node"]): (r["type"], r["context"], r["next_node"]) for r in SC.merge_flow_graph(flows, lone).collect()}
    assert got == {("v", "x"): ("int", "c1", "z"), ("v", "y"): ("int", "c2 | c5", "end"), ("v", "z"): ("int", "c4", "end"), ("w", "w"): ("t", "yes", "end")}


def test_steps_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    line = F.udf(counted, "int").asNondeterministic()
    steps = spark.createDataFrame([(i, i % 7, f"f{i % 2}") for i in range(40)], "result_index long, n int, uri string").select(
        "result_index", "uri", line("n").alias("start_line"), *[F.lit(0).alias(c) for c in ("flow_index", "step")],
        *[F.lit(1).alias(c) for c in ("start_col", "end_col", "end_line")], *[F.lit("x").alias(c) for c in ("type", "label", "message")])
    files = spark.createDataFrame([("f0", "a\nb\nc\nd"), ("f1", "e\nf")], "uri string, code string")
    out = FL.build_flow_steps(steps, files, []).collect()
    want = [i for i in range(40) if 1 <= i % 7 <= (2 if i % 2 else 4)]
    assert sorted(r.result_index for r in out) == want and seen.value == 40
