"""Label joins and evaluation metrics."""

from pyspark.sql import functions as F

from plainsight.operators import labels as LB
from plainsight.operators import metrics as M
from plainsight.workloads.registry import Tables, workload
from plainsight.workloads.sources import ITEMS_SQL, word_items

R6 = "round({}, 6)"


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


LABELS_SQL = """lab AS (SELECT DISTINCT doc_id || '.java' AS file_name, CASE doc_id % 4 WHEN 0 THEN 'sinks' WHEN 1 THEN 'comments' ELSE 'variables' END AS category,
  '  ' || w || ' ' AS name, CASE WHEN quality = 1 AND length(w) % 2 = 0 THEN 'Yes' ELSE 'no' END AS answer, length(w) AS pos
  FROM (SELECT doc_id, quality, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS w FROM documents JOIN labels USING (doc_id)))"""


def word_labels(spark, d):
    t = Tables(spark, d)
    w = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)))).alias("w"))
    return w.selectExpr(
        "concat(doc_id, '.java') AS file_name", "CASE doc_id % 4 WHEN 0 THEN 'sinks' WHEN 1 THEN 'comments' ELSE 'variables' END AS category",
        "concat('  ', w, ' ') AS name", "CASE WHEN quality = 1 AND length(w) % 2 = 0 THEN 'Yes' ELSE 'no' END AS answer", "length(w) AS pos")


KEYS = ["file_name", "category"]


@workload("label_join", "J1", f"""
WITH {ITEMS_SQL}, {LABELS_SQL} SELECT i.file_name, i.category, i.name, CAST(CASE WHEN answer = 'Yes' THEN 1 ELSE 0 END AS BIGINT) AS label
FROM items i JOIN lab l ON l.file_name = i.file_name AND l.category = i.category AND trim(l.name) = i.name""")
def _(spark, d):
    out = LB.label_join(word_items(spark, d), word_labels(spark, d), KEYS, "name", "answer", ["pos"])
    return out.withColumn("label", F.col("label").cast("bigint"))


@workload("flag_items", "J2", f"""
WITH {ITEMS_SQL}, {LABELS_SQL} SELECT file_name, category, name, CASE WHEN EXISTS (SELECT 1 FROM lab l WHERE l.file_name = i.file_name
  AND l.category = i.category AND trim(l.name) = i.name AND answer = 'Yes') THEN 'Yes' ELSE 'No' END AS flag FROM items i""")
def _(spark, d):
    pred = word_labels(spark, d).filter("answer = 'Yes'").withColumn("name", F.trim("name"))
    return LB.flag_items(word_items(spark, d), pred, KEYS, "name")


@workload("combine_labelled", "J3", f"""
WITH {ITEMS_SQL}, {LABELS_SQL} SELECT file_name, category, name, CASE WHEN (file_name, category, name) IN (SELECT (file_name, category, trim(name)) FROM lab)
  THEN 'yes' ELSE 'no' END AS is_sensitive, CASE WHEN length(name) % 2 = 0 THEN name || '>end' ELSE '' END AS graph FROM items""")
def _(spark, d):
    items = word_items(spark, d)
    graphs = items.filter("length(name) % 2 = 0").withColumn("graph", F.array("name", F.lit("end")))
    out = LB.combine_labelled(items, word_labels(spark, d).withColumn("name", F.trim("name")), graphs, KEYS, "name", "graph")
    return out.withColumn("graph", F.array_join("graph", ">")).select(*KEYS, "name", "is_sensitive", "graph")


@workload("unlabelled_items", "J4", f"""
WITH {ITEMS_SQL}, {LABELS_SQL} SELECT * FROM items WHERE (file_name, category, name) NOT IN (SELECT (file_name, category, trim(name)) FROM lab)""")
def _(spark, d):
    return LB.unlabelled_items(word_items(spark, d), word_labels(spark, d).withColumn("name", F.trim("name")), [*KEYS, "name"])


@workload("fill_missing_items", "J5", f"""
WITH {ITEMS_SQL}, g AS (SELECT file_name, name FROM items WHERE length(name) % 3 > 0),
c AS (SELECT file_name, name, 'uses ' || name AS context FROM items WHERE length(name) % 2 = 0)
SELECT file_name, name, name AS node, 'local' AS type, 'here' AS context, 'x' AS next_node FROM g
UNION ALL SELECT i.file_name, i.name, i.name, 'variable', coalesce(context, ''), 'end' FROM items i LEFT JOIN c ON c.file_name = i.file_name AND c.name = i.name
WHERE (i.file_name, i.name) NOT IN (SELECT (file_name, name) FROM g)""")
def _(spark, d):
    items = word_items(spark, d).select("file_name", "name")
    graphs = items.filter("length(name) % 3 > 0").selectExpr(
        "*", "name AS node", "'local' AS type", "'here' AS context", "'x' AS next_node")
    context = items.filter("length(name) % 2 = 0").selectExpr("*", "concat('uses ', name) AS context")
    return LB.fill_missing_items(graphs, items, ["file_name", "name"], context)


@workload("item_gaps", "J5", f"""
WITH {ITEMS_SQL}, n AS (SELECT file_name, count(DISTINCT name) AS parsed, count(DISTINCT name) FILTER (length(name) % 3 > 0) AS graphed FROM items GROUP BY 1)
SELECT * FROM n WHERE parsed <> graphed""")
def _(spark, d):
    items = word_items(spark, d).select("file_name", "name")
    return LB.item_gaps(items.filter("length(name) % 3 > 0"), items, "file_name", "name")


@workload("merge_label_sets", "J6", """
WITH u AS (SELECT doc_id // 10 AS file_no, 'quality' AS category, quality AS name FROM labels UNION ALL SELECT doc_id // 10, 'quality', toxic FROM labels)
SELECT file_no, category, CAST(name AS BIGINT) AS name, count(*) AS mentions FROM u GROUP BY ALL""")
def _(spark, d):
    lab = Tables(spark, d).labels
    a = lab.selectExpr("doc_id DIV 10 AS file_no", "'quality' AS category", "CAST(quality AS BIGINT) AS name")
    b = lab.selectExpr("doc_id DIV 10 AS file_no", "'quality' AS category", "CAST(toxic AS BIGINT) AS name")
    return LB.merge_label_sets(a, b, ["file_no", "category"], "name")


@workload("training_pairs", "J7", """
WITH l AS (SELECT doc_id AS conv_id, quality FROM labels WHERE toxic = 0), p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT p.conv_id, p.turn, md5('{"messages":[{"role":"system","content":"Find names"},{"role":"user","content":' || to_json(text) ||
 '},{"role":"assistant","content":' || to_json('{"names":["q' || quality || '"]}') || '}]}') AS line_md5
FROM p JOIN l USING (conv_id) WHERE len(regexp_split_to_array(text, '\\s+')) <= 30""")
def _(spark, d):
    t = Tables(spark, d)
    prompts = t.conversations.filter("role = 'user'").selectExpr("conv_id", "turn", "text AS prompt")
    names = LB.label_arrays(t.labels.filter("toxic = 0").selectExpr("doc_id AS conv_id", "concat('q', quality) AS name"), ["conv_id"], "name")
    pairs = LB.training_pairs(prompts, prompts.select("conv_id", "turn").join(names, "conv_id"), ["conv_id", "turn"], 30, "Find names")
    return pairs.select("conv_id", "turn", F.md5("line").alias("line_md5"))


@workload("training_pair_counts", "J7", """
SELECT (SELECT count(*) FROM conversations JOIN labels ON doc_id = conv_id WHERE role = 'user' AND toxic = 0 AND len(regexp_split_to_array(text, '\\s+')) <= 30) AS included,
 (SELECT count(*) FROM conversations WHERE role = 'user') AS total""")
def _(spark, d):
    t = Tables(spark, d)
    prompts = t.conversations.filter("role = 'user'").selectExpr("conv_id", "turn", "text AS prompt")
    names = LB.label_arrays(t.labels.filter("toxic = 0").selectExpr("doc_id AS conv_id", "concat('q', quality) AS name"), ["conv_id"], "name")
    pairs = LB.training_pairs(prompts, prompts.select("conv_id", "turn").join(names, "conv_id"), ["conv_id", "turn"], 30, "Find names")
    return LB.pair_counts(prompts, pairs)


@workload("combine_formats", "J8", """
WITH b AS (SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations WHERE turn > 3 GROUP BY 1)
SELECT c.conv_id, c.turn, coalesce(b.roles, '') AS roles FROM conversations c LEFT JOIN b USING (conv_id)""")
def _(spark, d):
    c = Tables(spark, d).conversations
    b = c.filter("turn > 3").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    out = LB.combine_formats(c.select("conv_id", "turn"), b, ["conv_id"], ["roles"])
    return out.withColumn("roles", F.array_join("roles", ","))


@workload("path_lookup", "J9", """
WITH tree AS (SELECT list_last(string_split(url, '/')) AS file_name, min(url) AS path FROM pages WHERE page_id % 3 > 0 GROUP BY 1)
SELECT page_id, list_last(string_split(url, '/')) AS file_name, path FROM pages JOIN tree ON tree.file_name = list_last(string_split(url, '/'))""")
def _(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url", F.element_at(F.split("url", "/"), -1).alias("file_name"))
    return LB.path_lookup(p.select("page_id", "file_name"), p.filter("page_id % 3 > 0").withColumnRenamed("url", "path")
                          .select("file_name", "path"))


@workload("rule_rows", "J10", f"""
WITH {ITEMS_SQL}, {LABELS_SQL} SELECT 'kept' AS origin, file_name, name FROM items WHERE length(name) > 11 UNION ALL
SELECT DISTINCT 'labels', file_name, trim(name) FROM lab WHERE answer = 'Yes' UNION ALL SELECT DISTINCT 'all', file_name, name FROM items""")
def _(spark, d):
    items, lab = word_items(spark, d), word_labels(spark, d).withColumn("name", F.trim("name"))
    parts = [("kept", LB.relation_rows(items, "file_name", "name", F.length("name") > 11)),
             ("labels", LB.relation_rows(lab, "file_name", "name", F.col("answer") == "Yes")),
             ("all", LB.relation_rows(items, "file_name", "name"))]
    out = None
    for tag, p in parts:
        p = p.withColumn("origin", F.lit(tag))
        out = p if out is None else out.unionByName(p)
    return out


@workload("label_conflicts", "J11", """
SELECT doc_id, CASE WHEN toxic = 0 THEN 'conflicting' ELSE 'missing type' END AS conflict FROM labels WHERE (toxic = 0 AND quality = 1 AND doc_id % 3 > 0) OR (toxic = 1 AND NOT (quality = 1 AND doc_id % 3 > 0))""")
def _(spark, d):
    s = Tables(spark, d).labels.selectExpr(
        "doc_id", "CASE WHEN quality = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'N/A' ELSE 'Log Sink' END END AS type",
        "CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS is_sensitive")
    return LB.label_conflicts(s).select("doc_id", "conflict")


# --- metrics ------------------------------------------------------------------------------

JOINED = "documents JOIN labels USING (doc_id)"
CONF_SQL = """sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS fp,
  sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS fn, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS tn"""


def _ratios_sql(empty_p="0.0", scale="1", tag=""):
    tp, fp, fn, tn = (f"{tag}{n}" for n in ("tp", "fp", "fn", "tn"))
    p = f"(CASE WHEN {tp} + {fp} = 0 THEN {empty_p} ELSE {tp}::DOUBLE / ({tp} + {fp}) END)"
    r = f"(CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE {tp}::DOUBLE / ({tp} + {fn}) END)"
    f = f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END)"
    a = f"({tp} + {tn})::DOUBLE / ({tp} + {fp} + {fn} + {tn})"
    s = f"(CASE WHEN {tn} + {fp} = 0 THEN 0.0 ELSE {tn}::DOUBLE / ({tn} + {fp}) END)"
    return {n: f"round({e} * {scale}, 6)" for n, e in (("precision", p), ("recall", r), ("f1", f), ("accuracy", a),
                                                       ("specificity", s), ("balanced_accuracy", f"({r} + {s}) / 2"))}


def _cols(ratios, names, prefix=""):
    return ", ".join(f"{ratios[n]} AS {prefix}{n}" for n in names)


PRF = ("precision", "recall", "f1", "accuracy")


def _rated(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id")


def _q():
    return F.col("quality") == 1


def _x():
    return F.col("toxic") == 1


@workload("confusion", "M1", f"SELECT lang, {CONF_SQL} FROM {JOINED} GROUP BY lang")
def _(spark, d):
    return M.confusion(_rated(spark, d), _q(), _x(), ["lang"])


@workload("prf", "M2", f"SELECT lang, tp, fp, fn, tn, {_cols(_ratios_sql('1.0'), PRF)} FROM (SELECT lang, {CONF_SQL} FROM {JOINED} GROUP BY lang)")
def _(spark, d):
    return _round(M.prf(M.confusion(_rated(spark, d), _q(), _x(), ["lang"]), 1.0), *PRF)


@workload("specificity", "M3", f"""SELECT lang, {_cols(_ratios_sql(), ("specificity", "balanced_accuracy"))} FROM (SELECT lang, {CONF_SQL} FROM {JOINED} GROUP BY lang)""")
def _(spark, d):
    c = M.confusion(_rated(spark, d), _q(), _x(), ["lang"])
    return _round(c.select("lang", M.specificity().alias("specificity"), M.balanced_accuracy().alias("balanced_accuracy")),
                  "specificity", "balanced_accuracy")


SIX = (*PRF, "specificity", "balanced_accuracy")


@workload("compare_runs", "M4", f"""
WITH t AS (SELECT source AS project, doc_id AS flow_hash, CASE WHEN doc_id % 9 = 0 THEN 'no' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label FROM {JOINED}),
p AS (SELECT source AS project, doc_id AS flow_hash, CASE WHEN doc_id % 5 = 0 THEN 'yes' WHEN toxic = 0 THEN 'yes' ELSE 'no' END AS label FROM {JOINED} WHERE n_chars % 4 > 0 AND source <> 'src3'),
j AS (SELECT t.project, t.label = 'yes' AS y, p.label IS NOT NULL AS s, coalesce(p.label = 'yes', FALSE) AS k FROM t LEFT JOIN p USING (project, flow_hash)
  WHERE t.project IN (SELECT project FROM p)),
c AS (SELECT coalesce(project, '(all)') AS project, sum((y AND k)::INT)::BIGINT AS wv_tp, sum((NOT y AND k)::INT)::BIGINT AS wv_fp, sum((y AND NOT k)::INT)::BIGINT AS wv_fn,
  sum((NOT y AND NOT k)::INT)::BIGINT AS wv_tn, sum((y AND s)::INT)::BIGINT AS nv_tp, sum((NOT y AND s)::INT)::BIGINT AS nv_fp, sum((y AND NOT s)::INT)::BIGINT AS nv_fn,
  sum((NOT y AND NOT s)::INT)::BIGINT AS nv_tn FROM j GROUP BY ROLLUP (j.project)),
r AS (SELECT *, {_cols(_ratios_sql("1.0", tag="wv_"), SIX, "wv_")}, {_cols(_ratios_sql("1.0", tag="nv_"), SIX, "nv_")} FROM c)
SELECT *, round(wv_f1 - nv_f1, 5) AS delta_f1, CASE WHEN wv_f1 > nv_f1 THEN 'improved' WHEN wv_f1 < nv_f1 THEN 'worse' ELSE 'same' END AS verdict FROM r""")
def _(spark, d):
    r = _rated(spark, d)
    base = ["source AS project", "doc_id AS flow_hash", "1 AS position"]
    truth = r.selectExpr(*base, "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS label")
    stale = r.selectExpr("source AS project", "doc_id AS flow_hash", "0 AS position", "'Yes' AS label")
    tool = r.filter("n_chars % 4 > 0 AND source <> 'src3'").selectExpr(
        *base, "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 0 THEN 'Yes' ELSE 'No' END AS label")
    out = M.compare_runs(truth.unionByName(stale), tool)
    out = _round(out, *[f"{t}_{n}" for t in ("wv", "nv") for n in SIX])
    return out.withColumn("delta_f1", F.round(F.col("wv_f1") - F.col("nv_f1"), 5))


@workload("class_report", "M5", f"""
WITH p AS (SELECT lang AS t, CASE WHEN toxic = 1 THEN 'en' ELSE lang END AS p FROM {JOINED}), c AS (SELECT t AS class FROM p UNION SELECT p FROM p),
m AS (SELECT class, (SELECT count(*) FROM p WHERE t = class AND p = class) AS tp, (SELECT count(*) FROM p WHERE t = class) AS support, (SELECT count(*) FROM p WHERE p = class) AS predicted FROM c),
r AS (SELECT class, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall, support FROM m),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""")
def _(spark, d):
    r = _rated(spark, d).withColumn("pred", F.when(_x(), F.lit("en")).otherwise(F.col("lang")))
    return _round(M.class_report(r, "lang", "pred"), "precision", "recall", "f1")


@workload("confusion_matrix", "M6", f"""SELECT lang, count(*) FILTER (quality = 0) AS "0", count(*) FILTER (quality = 1) AS "1" FROM {JOINED} GROUP BY lang""")
def _(spark, d):
    return M.confusion_matrix(_rated(spark, d), "lang", "quality", [0, 1])


@workload("roc_auc", "M7", f"""
WITH s AS (SELECT quality, n_chars // 50 AS score FROM {JOINED}), p AS (SELECT score FROM s WHERE quality = 1), n AS (SELECT score FROM s WHERE quality = 0)
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc,
  (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives FROM p, n""")
def _(spark, d):
    r = _rated(spark, d).withColumn("score", F.expr("n_chars DIV 50"))
    return _round(M.roc_auc(r, _q(), "score", F.expr("score DIV 20")), "auc")


@workload("cohen_kappa", "M8", f"""
WITH g AS (SELECT source, lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS a, sum(toxic)::DOUBLE AS b, sum((quality = toxic)::INT)::DOUBLE AS same FROM {JOINED} GROUP BY source, lang),
k AS (SELECT lang, n, CASE WHEN a IN (0, n) AND b IN (0, n) THEN CASE WHEN a = b THEN 1.0 END
  ELSE (same / n - (a * b + (n - a) * (n - b)) / (n * n)) / (1 - (a * b + (n - a) * (n - b)) / (n * n)) END AS kappa FROM g),
c AS (SELECT lang, sum(kappa * n) / sum(n) FILTER (kappa IS NOT NULL) AS kappa, sum(n) AS items FROM k GROUP BY lang)
SELECT lang AS class, round(kappa, 6) AS kappa, items::BIGINT AS items FROM c UNION ALL
SELECT 'overall', round(sum(kappa * items) / sum(items) FILTER (kappa IS NOT NULL), 6), (sum(items) FILTER (kappa IS NOT NULL))::BIGINT FROM c""")
def _(spark, d):
    return _round(M.cohen_kappa(_rated(spark, d), _q(), _x(), ["source"], "lang"), "kappa")


@workload("set_metrics", "M9", """
WITH p AS (SELECT doc_id, lang AS class, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS name FROM documents WHERE doc_id % 5 > 0),
t AS (SELECT DISTINCT doc_id, lang AS class, unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS name FROM documents WHERE doc_id % 7 > 0),
pp AS (SELECT *, (doc_id, class, name) IN (FROM (SELECT (doc_id, class, name) FROM t)) AS hit FROM p WHERE doc_id IN (SELECT doc_id FROM t)),
tt AS (SELECT *, (doc_id, class, name) IN (FROM (SELECT (doc_id, class, name) FROM p)) AS hit FROM t),
c AS (SELECT class, (SELECT count(*) FROM pp WHERE hit AND pp.class = k.class) AS tp, (SELECT count(*) FROM pp WHERE NOT hit AND pp.class = k.class) AS fp,
  (SELECT count(*) FROM tt WHERE NOT hit AND tt.class = k.class) AS fn FROM (SELECT DISTINCT lang AS class FROM documents) k)
SELECT class, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall,
 round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(spark, d):
    docs = Tables(spark, d).documents

    def words(n, where):
        return docs.filter(where).select("doc_id", F.col("lang").alias("class"), F.explode(
            F.regexp_extract_all("text", F.lit(f"[A-Za-z]{{{n},}}"), F.lit(0))).alias("name"))
    truth = words(9, "doc_id % 7 > 0").distinct()
    return _round(M.set_metrics(words(8, "doc_id % 5 > 0"), truth, "doc_id", "class", "name"), "precision", "recall", "f1")


SUB_SQL = """t AS (SELECT item_id, lower(text) AS t FROM benchmark WHERE trim(text) <> ''),
p AS (SELECT doc_id, lower(text) AS p FROM documents), hits AS (SELECT doc_id, item_id FROM p JOIN t ON contains(p, t))"""
# Labels of substring_matches: whole benchmark texts (part 0), and of each its first word, a piece of its middle or its beginning (part 1).
SUB_PART = "CASE WHEN item_id % 4 = 0 THEN regexp_extract(text, '^([A-Za-z]+)', 1) WHEN item_id % 4 = 1 THEN substr(text, 3, 9) ELSE substr(text, 1, 60) END"


def _sub(spark, d):
    t = Tables(spark, d)
    truth = t.benchmark.selectExpr("item_id", "text AS t")
    return t.documents.select("doc_id", "text"), truth


@workload("substring_matches", "M10", f"""
WITH t AS (SELECT item_id, part, lower(t) AS t FROM (SELECT item_id, 0 AS part, text AS t FROM benchmark UNION ALL SELECT item_id, 1, {SUB_PART} FROM benchmark) WHERE trim(t) <> ''),
p AS (SELECT doc_id, lower(text) AS p FROM documents) SELECT doc_id, item_id, part FROM p JOIN t ON contains(p, t)""")
def _(spark, d):
    docs, whole = _sub(spark, d)
    parts = whole.selectExpr("item_id", f"{SUB_PART.replace('text', 't')} AS t")
    truth = whole.withColumn("part", F.lit(0)).unionByName(parts.withColumn("part", F.lit(1))).withColumn("label", F.struct("item_id", "part"))
    return M.substring_matches(docs, truth, [], "doc_id", "text", "label", "t").select("doc_id", "label.item_id", "label.part")


@workload("substring_metrics", "M10", f"""
WITH {SUB_SQL}, c AS (SELECT (SELECT count(DISTINCT doc_id) FROM hits) AS tp, (SELECT count(*) FROM p) - (SELECT count(DISTINCT doc_id) FROM hits) AS fp,
  (SELECT count(*) FROM t) - (SELECT count(DISTINCT item_id) FROM hits) AS fn)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(spark, d):
    docs, truth = _sub(spark, d)
    return _round(M.substring_metrics(docs, truth, [], "doc_id", "text", "item_id", "t"), "precision", "recall", "f1")


FILES_SQL = """files AS (SELECT 'CWE-' || (p_partkey % 12) AS cwe, CASE p_partkey % 5 WHEN 0 THEN 'GOOD_' WHEN 1 THEN 'util' WHEN 2 THEN 'GOOD_' ELSE 'BAD_' END || p_partkey || '.java' AS file_name FROM part)"""
SUITE_FILES = ["concat('CWE-', p_partkey % 12) AS cwe", "concat(CASE p_partkey % 5 WHEN 0 THEN 'GOOD_' WHEN 1 THEN 'util' WHEN 2 THEN 'GOOD_' ELSE 'BAD_' END, p_partkey, '.java') AS file_name"]


@workload("suite_metrics", "M11", f"""
WITH {FILES_SQL}, own AS (SELECT DISTINCT 'CWE-' || (l_partkey % 12) AS cwe, CASE l_partkey % 5 WHEN 0 THEN 'GOOD_' WHEN 1 THEN 'util' WHEN 2 THEN 'GOOD_' ELSE 'BAD_' END || l_partkey || '.java' AS file_name
  FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 12 = l_suppkey % 12 AND l_partkey % 12 <> 4),
c AS (SELECT cwe, sum((file_name LIKE 'BAD%' AND hit)::INT)::BIGINT AS tp, sum((file_name LIKE 'GOOD%' AND hit)::INT)::BIGINT AS fp, sum((file_name LIKE 'BAD%' AND NOT hit)::INT)::BIGINT AS fn,
  sum((file_name LIKE 'GOOD%' AND NOT hit)::INT)::BIGINT AS tn FROM (SELECT *, (cwe, file_name) IN (SELECT (cwe, file_name) FROM own) AS hit FROM files WHERE file_name NOT LIKE 'util%') GROUP BY cwe),
z AS (SELECT 'CWE-' || n_nationkey AS cwe FROM nation), l AS (SELECT coalesce(z.cwe, c.cwe) AS cwe, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM z FULL JOIN c ON z.cwe = c.cwe),
a AS (SELECT * FROM l UNION ALL SELECT 'total', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(tn)::BIGINT FROM l)
SELECT cwe, tp, fp, fn, tn, {_cols(_ratios_sql("0.0", "100"), PRF).replace("(tp + tn)::DOUBLE / (tp + fp + fn + tn)", "(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / (tp + fp + fn + tn) END)")} FROM a""")
def _(spark, d):
    t = Tables(spark, d)
    files = t.part.selectExpr(*SUITE_FILES)
    findings = t.lineitem.filter("l_returnflag = 'R' AND l_partkey % 12 <> 4").selectExpr(
        "concat('CWE-', l_suppkey % 12) AS cwe", "concat('CWE-', l_partkey % 12) AS file_cwe",
        "concat(CASE l_partkey % 5 WHEN 0 THEN 'GOOD_' WHEN 1 THEN 'util' WHEN 2 THEN 'GOOD_' ELSE 'BAD_' END, l_partkey, '.java') AS file_name")
    rules = t.nation.selectExpr("concat('CWE-', n_nationkey) AS cwe")
    return _round(M.suite_metrics(findings, files, rules), *PRF)


REVIEW_SQL = f"""a AS (SELECT source AS file_name, lang AS class, doc_id AS key, CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END AS classification, 'L' || (doc_id % 3) AS label FROM {JOINED}),
j AS (SELECT *, key IN (SELECT doc_id FROM labels WHERE toxic = 0) AS hit FROM a)"""


def _reviews(spark, d):
    r = _rated(spark, d)
    agreed = r.selectExpr("source AS file_name", "lang AS class", "doc_id AS key",
                          "CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END AS classification", "concat('L', doc_id % 3) AS label")
    return agreed, r.filter("toxic = 0").selectExpr("source AS file_name", "lang AS class", "doc_id AS key")


@workload("reviewed_metrics", "M12", f"""
WITH {REVIEW_SQL}, c AS (SELECT file_name, class, label, sum((classification = 'Y' AND hit)::INT)::BIGINT AS tp, sum((classification = 'N' AND hit)::INT)::BIGINT AS fp,
  sum((classification = 'Y' AND NOT hit)::INT)::BIGINT AS fn, sum((classification = 'N' AND NOT hit)::INT)::BIGINT AS tn FROM j GROUP BY GROUPING SETS ((file_name, class), (class), (label), ()))
SELECT *, {_cols(_ratios_sql(), PRF)} FROM c""")
def _(spark, d):
    return _round(M.reviewed_metrics(*_reviews(spark, d)), *PRF)


@workload("missed_keys", "M12", f"WITH {REVIEW_SQL} SELECT DISTINCT label, class, key FROM j WHERE classification = 'Y' AND NOT hit")
def _(spark, d):
    return M.missed_keys(*_reviews(spark, d))


@workload("file_classification_accuracy", "M13", """
WITH f AS (SELECT page_id % 2 = 0 AS good, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS kind FROM pages),
r AS (SELECT CASE kind WHEN 0 THEN good WHEN 1 THEN TRUE WHEN 2 THEN good ELSE FALSE END AS ok FROM f)
SELECT count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS incorrect, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy FROM r""")
def _(spark, d):
    k = F.col("page_id") % 5
    cwe = F.concat(F.lit("CWE-"), F.col("page_id") % 30)
    names = F.when((k == 0) | (k == 2), F.array(F.lit("CWE-99"), cwe)).when(k == 1, F.array().cast("array<string>")).when(
        k == 3, F.array(F.lit("non-vulnerable"))).otherwise(F.array(F.lit("CWE-99")))
    files = Tables(spark, d).pages.select(
        cwe.alias("cwe"), names.alias("names"), F.when(F.col("page_id") % 2 == 0, F.lit("GOOD_a.java")).otherwise(F.lit("BAD_a.java")).alias("file_name"))
    return _round(M.file_classification_accuracy(files), "accuracy")


@workload("suite_counts", "M14", f"""
WITH {FILES_SQL} SELECT coalesce(cwe, '(all)') AS cwe, count(*) FILTER (file_name LIKE 'GOOD!_%' ESCAPE '!') AS good, count(*) FILTER (file_name LIKE 'BAD!_%' ESCAPE '!') AS bad,
 count(*) FILTER (file_name LIKE 'GOOD!_%' ESCAPE '!' OR file_name LIKE 'BAD!_%' ESCAPE '!') AS total FROM files GROUP BY ROLLUP (files.cwe)""")
def _(spark, d):
    return M.suite_counts(Tables(spark, d).part.selectExpr(*SUITE_FILES))


@workload("label_stats", "M15", f"""SELECT lang, count(*) FILTER (quality = 1) AS "Yes", count(*) FILTER (quality = 0) AS "No" FROM {JOINED} GROUP BY lang""")
def _(spark, d):
    r = _rated(spark, d).withColumn("answer", F.when(_q(), F.lit("Yes")).otherwise(F.lit("No")))
    return M.label_stats(r, "lang", "answer")


@workload("sample_counters", "M16", f"SELECT source, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative FROM {JOINED} GROUP BY source")
def _(spark, d):
    return M.sample_counters(_rated(spark, d), "source", _q())


AGREED_SQL = """r AS (SELECT doc_id, unnest([doc_id % 4, doc_id % 3, doc_id % 5, 1]) AS key, unnest([0, 1, 2, 3]) AS pos FROM labels),
z AS (SELECT doc_id, pos, 'k' || key AS key, CASE WHEN pos = 0 THEN 'x' WHEN pos = 1 AND quality = 1 THEN 'y' END AS label FROM r JOIN labels USING (doc_id)),
agreed AS (SELECT doc_id, pos, key, label, CASE WHEN pos >= 2 THEN 'None' WHEN label IS NULL THEN 'N' ELSE 'Y' END AS classification FROM z a
 WHERE pos < 2 OR NOT EXISTS (SELECT 1 FROM z b WHERE b.doc_id = a.doc_id AND b.key = a.key AND b.pos < a.pos))"""


def _agreed(spark, d):
    rows = Tables(spark, d).labels.select("doc_id", F.transform(F.array(
        F.col("doc_id") % 4, F.col("doc_id") % 3, F.col("doc_id") % 5, F.lit(1)), lambda x: F.concat(F.lit("k"), x)).alias("key_list"),
        F.array(F.lit("x"), F.when(_q(), F.lit("y"))).alias("label_list"))
    return M.agreed_classifications(rows, ["doc_id"])


@workload("agreed_classifications", "M17", f"WITH {AGREED_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, key, label, classification FROM agreed")
def _(spark, d):
    return _agreed(spark, d).withColumn("pos", F.col("pos").cast("bigint"))


@workload("files_with_positives", "M17", f"WITH {AGREED_SQL} SELECT doc_id, count(*) AS positives FROM agreed WHERE classification = 'Y' GROUP BY 1")
def _(spark, d):
    return M.files_with_positives(_agreed(spark, d), ["doc_id"])
