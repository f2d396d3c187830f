"""Metrics against published counts and brute force."""

import random

from pyspark.sql import functions as F

from plainsight.operators import metrics as M


def counts(spark, tp, fp, fn, tn):
    return spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")


def test_published_matrix(spark):
    r = M.prf(counts(spark, 112, 24, 26, 653)).first()
    assert abs(r["accuracy"] - 0.93865) < 1e-5
    r = M.prf(counts(spark, 109, 1, 44, 0), scale=100.0).first()
    assert round(r["precision"], 2) == 99.09 and round(r["recall"], 2) == 71.24


def test_weighted_report_of_published_matrix(spark):
    cells = [(0, 0, 653), (0, 1, 24), (1, 0, 26), (1, 1, 112)]
    df = spark.createDataFrame([(t, p) for t, p, n in cells for _ in range(n)], "t int, p int")
    r = M.class_report(df, "t", "p").filter("class = 'weighted'").first()
    assert (round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4)) == (0.9383, 0.9387, 0.9385)


def test_empty_precision(spark):
    empty = counts(spark, 0, 0, 3, 4)
    assert M.prf(empty, 1.0).first()["precision"] == 1.0 and M.prf(empty).first()["precision"] == 0.0


def test_missing_labels(spark):
    cols = "project string, flow_hash string, label string, position int"
    truth = spark.createDataFrame([("p", "a", "Yes", 0), ("p", "a", "No", 1), ("p", "b", None, 0), ("p", "c", "Yes", 0), ("p", "d", "Yes", 0), ("q", "a", "Yes", 0)], cols)
    tool = spark.createDataFrame([("p", "a", None, 0), ("p", "b", "No", 0), ("p", "c", None, 0)], cols)
    got = {r["project"]: r for r in M.compare_runs(truth, tool).collect()}
    assert sorted(got) == ["(all)", "p"]            # q has no tool output
    p = got["p"]
    assert (p["wv_tp"], p["wv_fp"], p["wv_fn"], p["wv_tn"]) == (1, 1, 1, 1)
    assert (p["nv_tp"], p["nv_fp"], p["nv_fn"], p["nv_tn"]) == (1, 2, 1, 0)
    assert p["verdict"] == "improved"


def test_kappa_cases(spark):
    rows = [("f1", "v", a, b) for a, b in [(1, 1), (1, 0), (0, 0), (0, 0)]]
    rows += [("f2", "v", 1, 1)] * 3 + [("f3", "v", 1, 0)] * 2 + [("f3", "s", 0, 1)]
    df = spark.createDataFrame(rows, "f string, c string, a int, b int")
    got = {r["class"]: r for r in M.cohen_kappa(df, F.col("a") == 1, F.col("b") == 1, ["f"], "c").collect()}
    assert abs(got["v"]["kappa"] - (0.5 * 4 + 1.0 * 3) / 7) < 1e-12 and got["v"]["items"] == 9
    assert got["s"]["kappa"] is None
    assert abs(got["overall"]["kappa"] - got["v"]["kappa"]) < 1e-12 and got["overall"]["items"] == 9


def test_auc(spark):
    rng = random.Random(1)
    data = [(rng.random() < 0.4, rng.randrange(20)) for _ in range(200)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    got = M.roc_auc(spark.createDataFrame(data, "y boolean, s int"), F.col("y"), "s", F.expr("score DIV 3")).first()
    assert abs(got["auc"] - want) < 1e-12


def test_set_metrics_count_repeats(spark):
    cols = "file string, class string, name string"
    pred = spark.createDataFrame([("A", "v", "x"), ("A", "v", "x"), ("A", "v", "y"), ("Z", "v", "x")], cols)
    truth = spark.createDataFrame([("A", "v", "x"), ("A", "v", "w"), ("B", "v", "q"), ("B", "v", "r")], cols)
    r = M.set_metrics(pred, truth, "file", "class", "name").first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 3)


def test_substrings_match_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    texts = [(f"f{i % 3}", i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    labels = []
    for j in range(80):
        base = rng.choice(texts)[2]
        a = rng.randrange(len(base))
        labels.append((f"f{j % 3}", j, base[a:a + rng.randrange(1, 15)].upper()))
    labels += [("f0", 900, "nowhere at all"), ("f0", 901, "  ")]
    want = sorted((f, i, j) for f, i, t in texts for g, j, x in labels if f == g and x.strip() and x.lower() in t)
    got = M.substring_matches(spark.createDataFrame(texts, "file string, pid int, t string"),
                              spark.createDataFrame(labels, "file string, tid int, x string"), ["file"], "pid", "t", "tid", "x")
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_suite_metrics(spark):
    files = spark.createDataFrame([("CWE-1", "BAD_a"), ("CWE-1", "BAD_b"), ("CWE-1", "GOOD_a"), ("CWE-1", "Util")], "cwe string, file_name string")
    findings = spark.createDataFrame([("CWE-1", "CWE-1", "BAD_a"), ("CWE-1", "CWE-1", "BAD_a"), ("CWE-2", "CWE-1", "BAD_b"), ("CWE-1", "CWE-1", "Util")],
                                     "cwe string, file_cwe string, file_name string")
    rules = spark.createDataFrame([("CWE-1",), ("CWE-9",)], "cwe string")
    got = {r["cwe"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in M.suite_metrics(findings, files, rules).collect()}
    assert got == {"CWE-1": (1, 0, 1, 1), "CWE-9": (0, 0, 0, 0), "total": (1, 0, 1, 1)}


def test_substring_matches_take_whole_texts_and_their_parts(spark, tmp_path):
    from plainsight.workloads.registry import REGISTRY
    spark.createDataFrame([(4, "Alpha beta gamma"), (5, "xxmiddle piece end")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "say alpha twice"), (2, "an ALPHA BETA gamma here"), (3, "a middle piece")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = REGISTRY["substring_matches"].run(spark, str(tmp_path)).select("doc_id", "item_id", "part").collect()
    assert sorted(tuple(r) for r in got) == [(1, 4, 1), (2, 4, 0), (2, 4, 1), (3, 5, 1)]
