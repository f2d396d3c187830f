"""Column functions on the cases that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from plainsight.functions import text as X
from plainsight.operators import extraction as E


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("name,want", [("cv", True), ("cvvv", True), ("cvvx", False), ("userPassword", True), ("passwordId", False),
                                       ("token", False), ("xtoken", True), ("tokens", False), ("pins", False)])
def test_sensitive_name_is_whole(spark, name, want):
    assert one(spark, X.sensitive_name("v"), name) is want


def test_name_allowed(spark):
    assert one(spark, X.name_allowed("v"), "password")
    for out in ("MSG", "userName", "nodeCount", "id"):
        assert not one(spark, X.name_allowed("v"), out)


def test_test_path_modes(spark):
    assert one(spark, X.is_test_path("v"), "/src/latest/Inspector.java")
    assert not one(spark, X.is_test_path("v", "segment"), "/src/latest/Inspector.java")
    assert one(spark, X.is_test_path("v", "segment"), "/src/test/A.java")


def test_sample_words_case(spark):
    assert one(spark, X.literal_allowed("v"), "A SECRET thing")
    assert not one(spark, X.literal_allowed("v"), "a secret thing")
    assert one(spark, X.clean_config_value("v"), "A SECRET thing") is None
    assert not one(spark, X.literal_allowed("v"), "1.5") and one(spark, X.literal_allowed("v"), "1.5.2")
    assert one(spark, X.clean_config_value("v"), 'a\\b"cé') == "a\\\\bc"


def test_compact_lines_parity(spark):
    code = "a {\n}\n}\n}\n\nb\n  );\nc"
    # each unfolded line swallows the closing (or blank) line after it
    lines, out, i = code.split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        if i < len(lines) - 1 and not lines[i + 1].strip(" });\t"):
            line += " " + lines[i + 1].strip()
            i += 1
        if line.strip():
            out.append(line)
        i += 1
    assert one(spark, E.compact_lines("v"), code) == "\n".join(out)


def test_slice_and_window(spark):
    assert one(spark, X.slice_columns("v", F.lit(3), F.lit(5), F.lit("m")), "abcdef") == "cd"
    assert one(spark, X.slice_columns("v", F.lit(9), F.lit(5), F.lit("m")), "abcdef") == "m"
    assert one(spark, X.slice_columns("v", F.lit(0), F.lit(99), F.lit("m")), "abc") == "abc"
    text = "\n".join("123456789")
    assert one(spark, X.line_window("v", F.lit(2), 3), text) == "1\n2\n3\n4\n5"
    assert one(spark, X.line_window("v", F.lit(9), 1), text) == "8\n9"


def test_values(spark):
    assert one(spark, X.clean_value("v"), " f(a, b); ,).") == "f(a, b) "
    assert one(spark, X.clean_value("v"), "g(x;") == "g(x)"
    assert one(spark, X.unpack_pairs("v"), "{a: 1, b: 2, c}") == ["1", "2", ""]
    assert one(spark, X.unpack_pairs("v"), "plain") is None
    assert one(spark, X.split_identifier("v"), "maxRetryCount") == "max retry count"
    assert one(spark, X.parse_cpe("v"), "cpe:2.3:a:acme:tool:1.2:*") == "tool version 1.2 "
    assert one(spark, X.parse_cpe("v"), "cpe:2.3") == "Unknown"
    assert one(spark, X.json_from_reply("v", "k INT")["k"], 'yes {"k": 3} bye') == 3
    assert one(spark, X.json_from_reply("v", "k INT")["k"], "no braces") is None
    assert one(spark, X.canonical_path("v"), "Files\\app\\app//src/A.java") == "app/src/A.java"
    assert one(spark, X.path_to_cwe("v"), "x/CWE-201/BAD/A.java") == "CWE-201"


def test_severity_stays_in_band(spark):
    df = spark.range(200).select(X.severity(F.lit("532"), "id").alias("s"), X.severity(F.lit("CWE-1"), "id").alias("t"))
    assert {r["s"] for r in df.collect()} == {8, 9, 10} and {r["t"] for r in df.collect()} == {3, 4, 5}


def test_restore_ids(spark):
    df = spark.createDataFrame([(1, "see ID-1.java, ID-11.java and ID-7.java"), (2, "none")], "k int, t string")
    names = spark.createDataFrame([("ID-1", "A.java"), ("ID-11", "B.java")], "id string, n string")
    got = {r["k"]: r["t"] for r in E.restore_ids(df, "t", "k", names, "id", "n").collect()}
    assert got == {1: "see A.java, B.java and undefined", 2: "none"}


def test_extraction(spark):
    code = 'int a = 1;\n/* one */\nvoid run() {\n  String key = "s3"; call(key); // two\n}\n'
    df = spark.createDataFrame([(1, code)], "id int, code string")
    assert sorted(r["comment"] for r in E.extract_comments(df, "code", ["id"]).collect()) == ["/* one */", "// two"]
    bodies = E.bodies_of(df, "code", ["id"], r"(?=\bvoid )", r"^void ([a-z]+)")
    assert {(r["literal"], r["methods"]) for r in E.extract_strings(bodies, ["id"]).collect()} == {("s3", "run")}
    assert {(r["name"], r["type"], r["methods"]) for r in E.extract_variables(bodies, ["id"]).collect()} >= {
        ("a", "int", "global"), ("key", "String", "run")}
    assert ("call", "run") in {(r["call"], r["methods"]) for r in E.extract_calls(bodies, ["id"]).collect()}
    usage = E.global_usage_lines(E.explode_lines(df, "code", ["id"]), spark.createDataFrame([("a",)], "name string"), ["id"], "name", "variables")
    assert [(r["method"], r["code"]) for r in usage.collect()] == [("a_global_lines_variables", "int a = 1;")]


def test_token_scan(spark):
    text = "\n".join(['String a = "no // comment /* here"; // real "quoted"', "char q = '\"'; /* \"in\" */ int x = 1;",
                      'f("a\\"b", "c"); // it\'s', "/* open \" // still", "int hidden; */ int y;", 'String bad = "open', 'String ok = "z";', "/* never closed \"w\""])
    row = spark.createDataFrame([(text,), (None,), ("",), ('"' + "x" * 200_000 + '"',)], "t string").select(
        E.comment_tokens("t").alias("c"), E.string_tokens("t").alias("s"), E.code_text("t").alias("code")).collect()
    assert row[0]["c"] == ['// real "quoted"', '/* "in" */', "// it's", '/* open " // still\nint hidden; */', '/* never closed "w"']
    assert row[0]["s"] == ["no // comment /* here", 'a\\"b', "c", "z"]
    code = row[0]["code"]
    assert "hidden" not in code and "no //" not in code and "int x = 1;" in code and "int y;" in code and 'f("" , "" )' in code
    assert row[1]["c"] is None and row[2]["c"] == [] and row[3]["s"] == ["x" * 200_000]
