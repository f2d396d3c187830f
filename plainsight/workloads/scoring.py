"""Scoring, sampling, training and streaming."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plainsight.functions import text as X
from plainsight.operators import extraction as E
from plainsight.operators import sampling as SA
from plainsight.operators import scoring as SC
from plainsight.operators import training as TR
from plainsight.plans import catalog as C
from plainsight.session import fixed_table, scratch_path, values_sql
from plainsight.streaming import arrivals as AR
from plainsight.streaming import progress as PR
from plainsight.workloads import shapes as SH
from plainsight.workloads.registry import Tables, workload
from plainsight.workloads.text import BODIES


@workload("attach_context", "C1", f"""
WITH {BODIES}, code AS (SELECT doc_id, method, arg_max(body, ordinal) AS code FROM bodies WHERE method <> 'global' GROUP BY ALL),
items AS (SELECT doc_id, lang AS name, CASE WHEN quality = 1 THEN 'String' END AS type, ['The', 'In', 'Und', 'Le', 'The'] AS ms FROM documents JOIN labels USING (doc_id)),
s AS (SELECT doc_id, name, type, unnest(ms) AS method, unnest([0, 1, 2, 3, 4]) AS pos FROM items),
j AS (SELECT s.doc_id, s.name, s.type, string_agg(code, '' ORDER BY pos) FILTER (code IS NOT NULL) AS code FROM s LEFT JOIN code c ON c.doc_id = s.doc_id AND c.method = s.method GROUP BY ALL)
SELECT doc_id, name, md5(CASE WHEN type IS NULL THEN '' ELSE 'Type: ' || type || ', ' END || 'Context: ' || coalesce(code, '')) AS context_md5 FROM j""")
def _(spark, d):
    t = Tables(spark, d)
    methods = E.method_bodies(E.bodies_of(t.documents, "text", ["doc_id"]), ["doc_id"])
    items = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select(
        "doc_id", F.lit("variables").alias("category"), F.col("lang").alias("name"),
        F.when(F.col("quality") == 1, F.lit("String")).alias("type"),
        F.array(*[F.lit(m) for m in ("The", "In", "Und", "Le", "The")]).alias("methods"))
    out = SC.attach_context(items, methods, ["doc_id"])
    return out.select("doc_id", "name", F.md5("context").alias("context_md5"))


@workload("concat_vectors", "C2", "SELECT vec_id, CAST(len(embedding || list_reverse(embedding)) AS BIGINT) AS n, array_to_string(list_transform(embedding || list_reverse(embedding), lambda x: CAST(round(x::DOUBLE * 100000) AS BIGINT)), ',') AS all_values FROM embeddings")
def _(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", SC.concat_vectors(F.col("embedding"), F.reverse("embedding")).alias("v"))
    return e.select("vec_id", F.size("v").cast("bigint").alias("n"), F.array_join(F.transform("v", lambda x: F.round(x.cast("double") * 100000).cast("bigint")), ",").alias("all_values"))


WEIGHTS = np.arange(1, 65) / 64.0


def linear(matrix):
    return matrix @ WEIGHTS


@workload("score_batches", "C3", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i / 64)), 4) AS score FROM embeddings""")
def _(spark, d):
    s = SC.score_batches(Tables(spark, d).embeddings, linear, "embedding", ["vec_id"])
    return s.withColumn("score", F.round("score", 4))


@workload("softmax_argmax", "C4", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT *, list_transform(v, lambda q: exp(q)) AS ex FROM e)
SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS best, round(list_max(ex) / list_sum(ex), 5) AS confidence FROM x""")
def _(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = Tables(spark, d).embeddings.select("vec_id", v.alias("v"))
    return e.select("vec_id", SC.argmax("v").cast("bigint").alias("best"), F.round(F.array_max(SC.softmax("v")), 5).alias("confidence"))


@workload("keep_confident", "C5", """
WITH e AS (SELECT vec_id, ['variables', 'strings', 'comments', 'sinks'][vec_id % 4 + 1] AS category, round(vec_id % 100 / 100.0, 2) AS confidence, label % 8 AS sink_class FROM embeddings)
SELECT vec_id, category FROM e WHERE CASE category WHEN 'sinks' THEN sink_class <> 0 WHEN 'strings' THEN confidence >= 0.95 ELSE confidence >= 0.75 END""")
def _(spark, d):
    e = Tables(spark, d).embeddings.selectExpr(
        "vec_id", "element_at(array('variables', 'strings', 'comments', 'sinks'), CAST(vec_id % 4 + 1 AS INT)) AS category",
        "CAST(round(vec_id % 100 / 100.0, 2) AS DOUBLE) AS confidence", "label % 8 AS sink_class")
    return SC.keep_confident(e).select("vec_id", "category")


@workload("sink_type_label", "C6", f"""
SELECT event_id, {C.SINK_CLASSES!r}[event_id % 9 + 1] AS sink_type, CASE WHEN event_id % 9 < 8 THEN event_id % 9 END AS class_no FROM events""")
def _(spark, d):
    e = Tables(spark, d).events.select("event_id", SC.sink_type_label(F.col("event_id") % 9).alias("sink_type"))
    return e.withColumn("class_no", SC.sink_type_number("sink_type").cast("bigint"))


def spread_of(pieces):
    return np.array([[float(p.sum()), float(p.max()), float(p.min())] for p in pieces])


@workload("segment_pool", "C8", """
WITH s AS (SELECT vec_id, list_transform(embedding[i * 24 + 1:i * 24 + 24], lambda x: x::DOUBLE) AS p FROM embeddings, (VALUES (0), (1), (2)) AS v(i))
SELECT vec_id, round(avg(list_sum(p)), 4) AS a, round(avg(list_max(p)), 4) AS b, round(avg(list_min(p)), 4) AS c FROM s GROUP BY 1""")
def _(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("tokens"))
    p = SC.segment_pool(e, "vec_id", "tokens", spread_of, 24)
    return p.select("vec_id", *[F.round(F.element_at("pooled", i + 1), 4).alias(n) for i, n in enumerate("abc")])


TEMPLATES = [("variables", "Review the {kind} \"{name}\" in {file}:\n{context}\nSensitive?"),
             ("sinks", "Is \"{name}\" in {file} a sink?\n{context}"), ("comments", "Is this {kind} in {file} sensitive: {name}"),
             ("strings", "{file}: is the {kind} \"{name}\" sensitive?\n{context}")]


@workload("build_prompts", "C10", f"""
WITH t AS (SELECT * FROM {values_sql(["category", "template"], TEMPLATES)}), i AS (SELECT 'c' || conv_id AS file_name, ['variables', 'sinks', 'comments', 'strings'][turn % 4 + 1] AS category, 'n' || turn AS name, text FROM conversations)
SELECT file_name, category, name, md5(replace(replace(replace(replace(template, '{{kind}}', substr(category, 1, length(category) - 1)), '{{name}}', name), '{{file}}', file_name), '{{context}}', trim(text))) AS prompt_md5 FROM i JOIN t USING (category)""")
def _(spark, d):
    items = Tables(spark, d).conversations.selectExpr(
        "concat('c', conv_id) AS file_name", "element_at(array('variables', 'sinks', 'comments', 'strings'), CAST(turn % 4 + 1 AS INT)) AS category",
        "concat('n', turn) AS name", "text AS context")
    p = SC.build_prompts(items, fixed_table(spark, ["category", "template"], TEMPLATES))
    return p.select("file_name", "category", "name", F.md5("prompt").alias("prompt_md5"))


@workload("ingest_replies", "C11", """
SELECT 'F' || user_id || '.java' AS file_name, CASE event_id % 2 WHEN 0 THEN 'variables' ELSE 'sinks' END AS category, 'n' || event_id AS name,
 CASE event_id % 3 WHEN 0 THEN 'yes' ELSE 'no' END AS answer FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0""")
def _(spark, d):
    e = Tables(spark, d).events
    cat = F.when(F.col("event_id") % 2 == 0, F.lit("variables")).otherwise(F.lit("sinks"))
    base = e.select("event_id", F.concat(F.lit("F"), "user_id", F.lit(".java")).alias("file_name"), cat.alias("category"),
                    F.concat(F.lit("n"), "event_id").alias("name"))
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("yes")).otherwise(F.lit("no"))
    said_file = F.when(F.col("event_id") % 5 == 0, F.lit("Other.java")).otherwise(F.col("file_name"))
    said_name = F.when(F.col("event_id") % 7 == 0, F.lit("other")).otherwise(F.col("name"))
    key = F.when(F.col("category") == "sinks", F.lit("isSink")).otherwise(F.lit("isSensitive"))
    body = F.concat(F.lit('Here: {"files":[{"fileName":"'), said_file, F.lit('","'), "category", F.lit('":[{"name":"'), said_name,
                    F.lit('","'), key, F.lit('":"'), answer, F.lit('"}]}]} done'))
    reply = F.when(F.col("event_id") % 11 == 0, F.lit("no { json")).otherwise(body)
    replies = base.select("file_name", F.col("name").alias("value_name"), "category", reply.alias("reply"))
    out = SC.ingest_replies(base.drop("event_id"), replies.union(replies))
    return out.select("file_name", "category", "name", "answer")


@workload("yes_no_from_reply", "C12", """
SELECT conv_id, turn, CASE WHEN contains(lower(r), 'yes') THEN 'Yes' ELSE 'No' END AS anywhere,
 CASE WHEN regexp_matches(lower(r), '(^|[^a-z0-9_])yes([^a-z0-9_]|$)') THEN 'Yes' ELSE 'No' END AS whole_word
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' YES.' WHEN 1 THEN 'Yesterday ' || text ELSE text END AS r FROM conversations)""")
def _(spark, d):
    k = F.col("turn") % 3
    r = F.when(k == 0, F.concat("text", F.lit(" YES."))).when(k == 1, F.concat(F.lit("Yesterday "), "text")).otherwise(F.col("text"))
    return Tables(spark, d).conversations.select("conv_id", "turn", X.yes_no_from_reply(r).alias("anywhere"), X.yes_no_from_reply(r, True).alias("whole_word"))


GRAPH_SQL = f"""{SH.STEPS_SQL}, g AS (SELECT *, result_index * 4 + flow_index AS flow_no FROM steps WHERE flow_index < 3),
k AS (SELECT flow_no, arg_max(variable_name, step) AS variable, any_value(file_name) AS file_name FROM g GROUP BY 1),
f AS (SELECT k.variable, k.file_name, g.flow_no, step, variable_name AS node, type, code AS context, coalesce(lead(variable_name) OVER (PARTITION BY g.flow_no ORDER BY step), 'end') AS nxt FROM g JOIN k USING (flow_no)),
lone AS (SELECT DISTINCT variable_name AS variable, file_name, result_index * 4 + 3 AS flow_no, step, variable_name AS node, 'alone' AS type, code AS context FROM steps WHERE flow_index = 3),
free AS (SELECT *, coalesce(lead(node) OVER (PARTITION BY variable, file_name, flow_no ORDER BY step), 'end') AS nxt FROM lone WHERE (variable, file_name) NOT IN (SELECT (variable, file_name) FROM f)),
al AS (SELECT * FROM f UNION ALL SELECT variable, file_name, flow_no, step, node, type, context, nxt FROM free),
c AS (SELECT variable, file_name, node, context, min(flow_no * 1000 + step) AS seen_at FROM al GROUP BY ALL),
merged AS (SELECT variable, file_name, node, arg_min(type, flow_no * 1000 + step) AS type, arg_max(nxt, flow_no * 1000 + step) AS next_node,
  (SELECT string_agg(context, ' | ' ORDER BY seen_at) FROM c WHERE c.variable = al.variable AND c.file_name = al.file_name AND c.node = al.node) AS context, min(flow_no * 1000 + step) AS first FROM al GROUP BY variable, file_name, node)"""


def _graph(spark, d):
    g = SH.event_steps(spark, d).withColumn("flow_no", F.expr("result_index * 4 + flow_index"))
    flows = g.filter("flow_index < 3")
    keys = flows.groupBy("flow_no").agg(F.max_by("variable_name", "step").alias("variable"))
    f = flows.join(keys, "flow_no").selectExpr("variable", "file_name", "flow_no", "step", "variable_name AS node", "type", "code AS context")
    lone = g.filter("flow_index = 3").selectExpr(
        "variable_name AS variable", "file_name", "flow_no", "step", "variable_name AS node", "'alone' AS type", "code AS context")
    return SC.merge_flow_graph(f, lone)


@workload("merge_flow_graph", "G11", f"WITH {GRAPH_SQL} SELECT variable, file_name, node, type, next_node, md5(context) AS context_md5 FROM merged")
def _(spark, d):
    return _graph(spark, d).select("variable", "file_name", "node", "type", "next_node", F.md5("context").alias("context_md5"))


@workload("graph_context", "C13", f"""
WITH {GRAPH_SQL} SELECT variable, file_name, string_agg(type || ' ' || CASE WHEN node = variable THEN '' ELSE 'a' || node || ' ' END, '' ORDER BY first) AS context FROM merged GROUP BY ALL""")
def _(spark, d):
    g = _graph(spark, d)
    named = F.when(F.col("node") == F.col("variable"), F.col("node")).otherwise(F.concat(F.lit("call(a"), "node", F.lit(")")))
    graph = g.groupBy("variable", "file_name").agg(F.sort_array(F.collect_list(F.struct("flow_no", "step", named.alias("name"), "type"))).alias("g"))
    return graph.select("variable", "file_name", SC.graph_context(F.col("g"), F.col("variable")).alias("context"))


@workload("join_name_context", "C14", """
SELECT doc_id, md5(lower(regexp_replace(source || 'Name', '([a-z])([A-Z])', '\\1 \\2', 'g')) || ' [SEP] ' || lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'))) AS joined_md5 FROM documents""")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5(X.join_name_context(F.concat("source", F.lit("Name")), "text")).alias("joined_md5"))


# --- sampling ---------------------------------------------------------------------------------

@workload("stratified_split", "T1", """
WITH r AS (SELECT doc_id, quality, percent_rank() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS p FROM labels)
SELECT doc_id, quality, CASE WHEN p < 0.15 THEN 'test' WHEN p < 0.3 THEN 'validation' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    lab = Tables(spark, d).labels.select("doc_id", "quality")
    return SA.stratified_split(lab, "quality", "doc_id", {"test": 0.15, "validation": 0.15})


@workload("random_split", "T2", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || (conv_id * 1000 + turn)), conv_id) AS i, count(*) OVER () AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM r""")
def _(spark, d):
    c = Tables(spark, d).conversations.selectExpr("conv_id", "turn", "conv_id * 1000 + turn AS id")
    return SA.random_split(c, "id").select("conv_id", "turn", "split")


@workload("k_folds", "T5", "SELECT doc_id, quality, ntile(5) OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS fold FROM labels")
def _(spark, d):
    return SA.k_folds(Tables(spark, d).labels.select("doc_id", "quality"), "quality", "doc_id", 5)


@workload("oversample", "T3")
def _(spark, d):
    return SA.oversample(Tables(spark, d).labels, "toxic", "doc_id", 1)


@workload("smote", "T4")
def _(spark, d):
    e = Tables(spark, d).embeddings.withColumn("rare", (F.col("label") == 0).cast("int"))
    out = SA.smote(e, "rare", "vec_id", "embedding", 1, per_row=2)
    return out.select("origin", "neighbour", "draw", F.round(F.element_at("embedding", 1), 5).alias("first_value"))


@workload("chunk_large", "T10", """
WITH c AS (SELECT doc_id, i, substr(text, i * 700 + 1, 700) AS chunk FROM documents, range(0, 1000) AS r(i) WHERE i * 700 < greatest(length(text), 1))
SELECT doc_id, i AS chunk_no, md5(chunk) AS chunk_md5 FROM c""")
def _(spark, d):
    c = SA.chunk_large(Tables(spark, d).documents, ["doc_id"], "text", 700)
    return c.select("doc_id", F.col("chunk_no").cast("bigint"), F.md5("chunk").alias("chunk_md5"))


@workload("token_batches", "T9", """
WITH RECURSIVE f AS (SELECT source, doc_id, len(string_split(text, ' ')) + 20 AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS no FROM documents),
b(source, doc_id, no, w, used, batch) AS (SELECT source, doc_id, no, w, CASE WHEN w > 900 THEN 100000 ELSE 20 + w END, 1 FROM f WHERE no = 1
  UNION ALL SELECT f.source, f.doc_id, f.no, f.w, CASE WHEN f.w > 900 THEN 100000 WHEN b.used + f.w > 900 THEN 20 + f.w ELSE b.used + f.w END,
    CASE WHEN f.w > 900 OR b.used + f.w > 900 THEN b.batch + 1 ELSE b.batch END FROM b JOIN f ON f.source = b.source AND f.no = b.no + 1)
SELECT source, doc_id, CAST(w AS BIGINT) AS w, CAST((w > 900)::INT AS BIGINT) AS oversized, CAST(batch AS BIGINT) AS batch_no FROM b""")
def _(spark, d):
    docs = Tables(spark, d).documents
    return SA.token_batches(docs, "source", "doc_id", F.size(F.split("text", " ")), 900, 20, F.expr("doc_id DIV 100"))


# --- training ---------------------------------------------------------------------------------

def _vectors(spark, d):
    return TR.as_vectors(Tables(spark, d).embeddings.withColumn("rare", (F.col("label") < 3).cast("int")), "embedding")


@workload("train_binary", "T7")
def _(spark, d):
    v = _vectors(spark, d)
    return TR.predicted(TR.train_binary(v, "rare"), v, ["vec_id", "rare"])


@workload("train_multiclass", "T8")
def _(spark, d):
    v = _vectors(spark, d).withColumn("kind", F.col("label") % 8)
    return TR.predicted(TR.train_multiclass(v, "kind", [64, 16, 8]), v, ["vec_id", "kind"])


@workload("search", "T6")
def _(spark, d):
    v = _vectors(spark, d)
    lr = LogisticRegression(labelCol="rare", maxIter=5)
    best = TR.search(lr, v, {lr.regParam: [0.0, 0.01, 0.1], lr.elasticNetParam: [0.0, 0.5]}, 3, "rare", folds=3)
    return TR.predicted(best.bestModel, v, ["vec_id", "rare"])


@workload("hash_features", "T11")
def _(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    model = TR.hash_features(docs, "text")
    out = model.transform(docs).withColumn("v", vector_to_array("features"))
    return out.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).alias("non_zero"))


# --- streaming --------------------------------------------------------------------------------

PROGRESS = ["event_type AS type", "CAST(1200 AS INT) AS total", "CAST(event_id % 3 AS INT) AS step", "ts", "event_id"]


@workload("progress_table", "X1", """
WITH r AS (SELECT event_type AS type, ts, event_id, sum(event_id % 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done FROM events),
p AS (SELECT type, ts, event_id, CAST(least(round_even(done::DOUBLE / 1200 * 100, 0), 100) AS BIGINT) AS progress FROM r),
c AS (SELECT *, lag(progress) OVER (PARTITION BY type ORDER BY ts, event_id) AS before FROM p)
SELECT type, progress, event_id FROM c WHERE before IS NULL OR before <> progress""")
def _(spark, d):
    rows = Tables(spark, d).events.selectExpr(*PROGRESS)
    bucket = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600000000")
    t = PR.progress_table(rows, ["ts", "event_id"], bucket)
    return t.select("type", F.col("progress").cast("bigint"), F.col("first.event_id").alias("event_id"))


@workload("progress_changes", "X1", """
WITH r AS (SELECT event_type AS type, sum(event_id % 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done FROM events)
SELECT DISTINCT type, CAST(least(round_even(done::DOUBLE / 1200 * 100, 0), 100) AS BIGINT) AS progress FROM r""")
def _(spark, d):
    src, out = scratch_path(spark, "progress-in"), scratch_path(spark, "progress-out")
    e = Tables(spark, d).events.selectExpr("event_type AS type", "CAST(1200 AS INT) AS total", "CAST(event_id % 3 AS INT) AS step", "CAST(ts AS TIMESTAMP) AS ts")
    e.repartitionByRange(1 if e.rdd.getNumPartitions() == 1 else 8, "ts").write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = (PR.progress_changes(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "progress-state")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("type", F.col("progress").cast("bigint"))


@workload("pending_projects", "X2", """
SELECT DISTINCT event_id // 4 AS project_no FROM events WHERE event_id // 4 NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, d):
    t = Tables(spark, d)
    arrivals = t.events.selectExpr("event_id DIV 4 AS project_no", "ts")
    done = t.labels.filter("quality = 1").selectExpr("doc_id AS project_no")
    return AR.pending(arrivals, done, ["project_no"]).select("project_no")


@workload("analyse_new_projects", "X2", "SELECT event_id // 4 AS project_no, event_id // 4 % 7 AS analysed FROM events GROUP BY 1")
def _(spark, d):
    src, results, state = (scratch_path(spark, n) for n in ("arrivals", "results", "arrivals-state"))
    e = Tables(spark, d).events.selectExpr("event_id DIV 4 AS project_no", "CAST(ts AS TIMESTAMP) AS sent_at")
    e.write.json(src)
    stream = AR.read_arrivals(spark, src, "project_no BIGINT, sent_at TIMESTAMP")
    q = AR.analyse_new_projects(stream, lambda batch: batch.select("project_no", (F.col("project_no") % 7).alias("analysed")),
                                results, state, ["project_no"])
    q.awaitTermination()
    return spark.read.parquet(results).select("project_no", "analysed")
