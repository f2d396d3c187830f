"""Text extraction and rule predicates over documents, pages, parts and events."""

from pyspark.sql import functions as F

from plainsight.functions import text as X
from plainsight.operators import extraction as E
from plainsight.session import values_sql
from plainsight.workloads.registry import Tables, workload

LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"""
BODIES = f"""{LINES}, bodies AS (SELECT doc_id, line_no AS ordinal, line AS body,
  CASE WHEN regexp_extract(line, '^([A-Za-z_]+)', 1) = '' THEN 'global'
       ELSE regexp_extract(line, '^([A-Za-z_]+)', 1) END AS method FROM lines)"""


@workload("extract_comments", "E1", """
SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS comment FROM pages""")
def _(spark, d):
    return E.extract_comments(Tables(spark, d).pages, "html", ["page_id"], r"(?s)<!--(.*?)-->")


@workload("extract_strings", "E2", f"""
WITH {BODIES}, hits AS (SELECT doc_id, method, unnest(regexp_extract_all(body, '"([^"\\n]*)"', 1)) AS literal FROM bodies)
SELECT doc_id, literal, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM hits GROUP BY ALL""")
def _(spark, d):
    bodies = E.bodies_of(Tables(spark, d).documents, "text", ["doc_id"])
    return E.extract_strings(bodies, ["doc_id"], r'"([^"\n]*)"')


@workload("extract_variables", "E3", """
WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z]+ [^>]*>')) AS body,
    generate_subscripts(regexp_extract_all(html, '<[a-z]+ [^>]*>'), 1) AS ordinal FROM pages),
hits AS (SELECT page_id, ordinal, regexp_extract(body, '^<([a-z]+)', 1) AS method,
    unnest(regexp_extract_all(body, '([a-z-]+)="([^"]*)"', 1)) AS name,
    unnest(regexp_extract_all(body, '([a-z-]+)="([^"]*)"', 2)) AS type,
    generate_subscripts(regexp_extract_all(body, '([a-z-]+)="([^"]*)"', 1), 1) AS pos FROM tags)
SELECT page_id, name, arg_max(type, ordinal * 100000 + pos) AS type,
  string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM hits GROUP BY page_id, name""")
def _(spark, d):
    pages = Tables(spark, d).pages
    tags = F.regexp_extract_all("html", F.lit("<[a-z]+ [^>]*>"), F.lit(0))
    bodies = pages.select("page_id", F.posexplode(tags).alias("ordinal", "body")) \
        .withColumn("method", F.regexp_extract("body", "^<([a-z]+)", 1))
    return E.extract_variables(bodies, ["page_id"], r'([a-z-]+)="([^"]*)"', type_group=2, name_group=1)


# A document's lines as source text: marks of one kind of token inside another, a comment over two lines.
SOURCE_LINE = """CASE line_no % 6 WHEN 0 THEN concat('String s = "', clean, ' // /* no"; // c0')
 WHEN 1 THEN concat('// "', clean, '" int hidden;') WHEN 2 THEN concat('/* ', clean, ' " // int no;')
 WHEN 3 THEN concat(clean, ' */ int a', line_no, ' = 1;')
 WHEN 4 THEN concat('char c = Q"Q; String t = "xB"y // ', clean, '"; // end "') ELSE concat('call("/* ', clean, '", QBQQ); /* in */ int b;') END"""
CLEAN_SQL = f"""{LINES}, clean AS (SELECT doc_id, line_no, translate(line, '"/*\\' || chr(39), '') AS clean FROM lines)"""


def _source(spark, d):
    lines = E.explode_lines(Tables(spark, d).documents, "text", ["doc_id"]).withColumn(
        "clean", F.translate("line", "\"/*\\'", ""))
    made = lines.select("doc_id", "line_no", F.expr(SOURCE_LINE.replace("Q", "\\'").replace("xB", "x\\\\").replace("B", "\\\\")).alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return made.groupBy("doc_id").agg(joined.alias("text"))


@workload("scan_comments", "E1", f"""
WITH {CLEAN_SQL} SELECT DISTINCT doc_id, md5(comment) AS comment_md5 FROM (
  SELECT doc_id, '// c0' AS comment FROM clean WHERE line_no % 6 = 0
  UNION ALL SELECT doc_id, '// "' || clean || '" int hidden;' FROM clean WHERE line_no % 6 = 1
  UNION ALL SELECT a.doc_id, '/* ' || a.clean || ' " // int no;' || coalesce(chr(10) || b.clean || ' */', '') FROM clean a LEFT JOIN clean b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1
    WHERE a.line_no % 6 = 2
  UNION ALL SELECT doc_id, '// end "' FROM clean WHERE line_no % 6 = 4 UNION ALL SELECT doc_id, '/* in */' FROM clean WHERE line_no % 6 = 5)""")
def _(spark, d):
    return E.scan_comments(_source(spark, d), "text", ["doc_id"]).select("doc_id", F.md5("comment").alias("comment_md5"))


@workload("scan_strings", "E2", f"""
WITH {CLEAN_SQL} SELECT DISTINCT doc_id, md5(CASE line_no % 6 WHEN 0 THEN clean || ' // /* no' WHEN 4 THEN 'x\\"y // ' || clean ELSE '/* ' || clean END) AS literal_md5
FROM clean WHERE line_no % 6 IN (0, 4, 5)""")
def _(spark, d):
    return E.scan_strings(_source(spark, d), "text", ["doc_id"]).select("doc_id", F.md5("literal").alias("literal_md5"))


@workload("scan_variables", "E3", f"""
WITH {CLEAN_SQL} SELECT DISTINCT doc_id, CASE line_no % 6 WHEN 0 THEN 's' WHEN 3 THEN 'a' || line_no WHEN 5 THEN 'b' END AS name,
  CASE line_no % 6 WHEN 0 THEN 'String' ELSE 'int' END AS type FROM clean WHERE line_no % 6 IN (0, 3, 5)
UNION SELECT doc_id, 'c', 'char' FROM clean WHERE line_no % 6 = 4 UNION SELECT doc_id, 't', 'String' FROM clean WHERE line_no % 6 = 4""")
def _(spark, d):
    bodies = _source(spark, d).select("doc_id", F.lit("global").alias("method"), F.lit(0).alias("ordinal"), E.code_text("text").alias("body"))
    return E.extract_variables(bodies, ["doc_id"]).select("doc_id", "name", "type")


@workload("extract_calls", "E4", f"""
WITH {BODIES}, hits AS (SELECT doc_id, method, unnest(regexp_extract_all(replace(body, ', ', '( '), '([A-Za-z_][A-Za-z0-9_]*) ?[(]', 1)) AS call FROM bodies)
SELECT doc_id, call, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM hits GROUP BY ALL""")
def _(spark, d):
    bodies = E.bodies_of(Tables(spark, d).documents, "text", ["doc_id"])
    return E.extract_calls(bodies.withColumn("body", F.replace("body", F.lit(", "), F.lit("( "))), ["doc_id"])


@workload("method_bodies", "E5", f"""
WITH {BODIES} SELECT doc_id, method, md5(arg_max(body, ordinal)) AS code_md5
FROM bodies WHERE method <> 'global' GROUP BY ALL""")
def _(spark, d):
    bodies = E.bodies_of(Tables(spark, d).documents, "text", ["doc_id"])
    return E.method_bodies(bodies, ["doc_id"]).select("doc_id", "method", F.md5("code").alias("code_md5"))


@workload("global_usage_lines", "E6", f"""
WITH {LINES}, items AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS word FROM benchmark),
long_items AS (SELECT word FROM items WHERE length(word) >= 9),
tok AS (SELECT DISTINCT doc_id, trim(line) AS line, unnest(regexp_split_to_array(line, '[^A-Za-z0-9_]+')) AS word FROM lines)
SELECT doc_id, word, word || '_global_lines_variables' AS method,
  md5(string_agg(DISTINCT line, chr(10) ORDER BY line)) AS code_md5
FROM tok JOIN long_items USING (word) GROUP BY doc_id, word""")
def _(spark, d):
    t = Tables(spark, d)
    items = t.benchmark.select(F.explode(F.split("text", E.WORD_BREAK)).alias("word")) \
        .filter(F.length("word") >= 9)
    lines = E.explode_lines(t.documents, "text", ["doc_id"])
    out = E.global_usage_lines(lines, items, ["doc_id"], "word", "variables")
    return out.select("doc_id", "word", "method", F.md5("code").alias("code_md5"))


@workload("keyword_lines", "E7", f"""
WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(trim(line)) AS line_md5 FROM lines
WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])token([^A-Za-z0-9_]|$)')""")
def _(spark, d):
    hits = E.keyword_lines(Tables(spark, d).documents, "text", ["doc_id"], "token")
    return hits.select("doc_id", F.col("line_no").cast("bigint"), F.md5("line").alias("line_md5"))


@workload("code_window", "E8", f"""
WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
loc AS (SELECT doc_id, 1 + doc_id % n AS at_line FROM n)
SELECT l.doc_id, CAST(any_value(at_line) AS BIGINT) AS at_line, md5(string_agg(line, chr(10) ORDER BY line_no)) AS code_md5
FROM lines l JOIN loc ON l.doc_id = loc.doc_id AND line_no BETWEEN at_line - 3 AND at_line + 3 GROUP BY l.doc_id""")
def _(spark, d):
    docs = Tables(spark, d).documents
    at = 1 + F.col("doc_id") % F.size(F.split("text", "\n"))
    docs = docs.select("doc_id", "text", at.alias("at_line"))
    return docs.select("doc_id", "at_line", F.md5(X.line_window("text", "at_line", 3)).alias("code_md5"))


@workload("slice_columns", "E9", f"""
WITH {LINES}, s AS (SELECT *, doc_id % 40 AS c1, line_no * 13 % 90 AS c2 FROM lines)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CASE WHEN greatest(0, c1 - 1) <= least(c2 - 1, length(line))
       THEN substr(line, greatest(0, c1 - 1) + 1, least(c2 - 1, length(line)) - greatest(0, c1 - 1))
       ELSE 'message' END AS part FROM s""")
def _(spark, d):
    lines = E.explode_lines(Tables(spark, d).documents, "text", ["doc_id"])
    lines = lines.select("*", (F.col("doc_id") % 40).alias("c1"), (F.col("line_no") * 13 % 90).alias("c2"))
    return lines.select("doc_id", F.col("line_no").cast("bigint"),
                        X.slice_columns("line", "c1", "c2", F.lit("message")).alias("part"))


CODE_SQL = """code AS (SELECT doc_id, replace(replace(replace(text, ', ', chr(10) || '}' || chr(10)), '. ', chr(10) || ' ) ;' || chr(10) || chr(10) || '}}' || chr(10)), ' the ', chr(10)) AS text FROM documents)"""


@workload("compact_lines", "E10", f"""
WITH {CODE_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM code),
c AS (SELECT *, regexp_matches(line, '^[}});\\s]*$') AS closing FROM l),
g AS (SELECT *, coalesce(max(CASE WHEN NOT closing THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 1) AS anchor FROM c),
f AS (SELECT *, closing AND i > 1 AND (i - anchor) % 2 = 1 AS folded FROM g),
n AS (SELECT *, lead(folded) OVER w AS nf, lead(line) OVER w AS nl FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, i, CASE WHEN nf THEN line || ' ' || trim(nl) ELSE line END AS line FROM n WHERE NOT folded)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i) FILTER (trim(line) <> '')) AS text_md5 FROM o GROUP BY doc_id""")
def _(spark, d):
    nl = "\n"
    code = F.replace("text", F.lit(", "), F.lit(f"{nl}}}{nl}"))
    code = F.replace(code, F.lit(". "), F.lit(f"{nl} ) ;{nl}{nl}}}}}{nl}"))
    code = F.replace(code, F.lit(" the "), F.lit(nl))
    return Tables(spark, d).documents.select("doc_id", F.md5(E.compact_lines(code)).alias("text_md5"))


@workload("add_boundaries", "E11", """
SELECT doc_id, md5(concat(chr(10), chr(10), '-----BEGIN FILE: [', doc_id, ']----- ', chr(10), text, chr(10), '-----END FILE: [', doc_id, ']-----')) AS text_md5 FROM documents""")
def _(spark, d):
    return Tables(spark, d).documents.select(
        "doc_id", F.md5(X.add_boundaries("doc_id", "text")).alias("text_md5"))


@workload("split_identifier", "E12", """
SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_name, ' ', 'X'), 'X([a-z])', 'Id\\1', 'g') || p_brand,
  '([a-z])([A-Z])', '\\1 \\2', 'g')) AS words FROM part""")
def _(spark, d):
    camel = F.regexp_replace(F.replace("p_name", F.lit(" "), F.lit("X")), "X([a-z])", "Id$1")
    return Tables(spark, d).part.select(
        "p_partkey", X.split_identifier(F.concat(camel, F.col("p_brand"))).alias("words"))


@workload("drop_stop_words", "E13", f"""
WITH stops AS (SELECT list(w) AS ws FROM {values_sql(["w"], [(w,) for w in [*X.STOP_WORDS, "class", "return"]])})
SELECT doc_id, md5(array_to_string([x FOR x IN string_split(text, ' ') IF NOT list_contains(ws, lower(x))], ' ')) AS kept_md5
FROM documents, stops""")
def _(spark, d):
    kept = X.drop_stop_words(F.split("text", " "), ["class", "return"])
    return Tables(spark, d).documents.select("doc_id", F.md5(F.array_join(kept, " ")).alias("kept_md5"))


@workload("clean_value", "E14", f"""
WITH {LINES}, v AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(replace(replace(line, ', ', '; f('), ';', ''), '^\\s+|\\s+$', '', 'g'), '[,).]+$', '') AS v FROM lines)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(CASE WHEN length(v) - length(replace(v, '(', '')) > length(v) - length(replace(v, ')', '')) THEN v || ')' ELSE v END) AS value_md5 FROM v""")
def _(spark, d):
    lines = E.explode_lines(Tables(spark, d).documents, "text", ["doc_id"])
    v = X.clean_value(F.replace("line", F.lit(", "), F.lit("; f(")))
    return lines.select("doc_id", F.col("line_no").cast("bigint"), F.md5(v).alias("value_md5"))


@workload("json_from_reply", "E15", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(spark, d):
    wrapped = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("No object } here {"), "event_type")).otherwise(
        F.concat(F.lit("Sure, here it is:\n"), "props", F.lit("\nAnything else?")))
    return Tables(spark, d).events.select(
        "event_id", X.json_from_reply(wrapped, "k BIGINT").getField("k").alias("k"))


@workload("restore_ids", "E16", """
WITH n AS (SELECT 'ID-' || p_partkey AS id, p_name || '.java' AS name FROM part)
SELECT doc_id, md5(concat('See ', coalesce(a.name, 'undefined'), ' and ', coalesce(b.name, 'undefined'), ': ', text)) AS text_md5
FROM documents LEFT JOIN n a ON a.id = 'ID-' || doc_id LEFT JOIN n b ON b.id = 'ID-' || (n_chars * 3)""")
def _(spark, d):
    t = Tables(spark, d)
    docs = t.documents.select("doc_id", F.concat(
        F.lit("See ID-"), "doc_id", F.lit(".java and ID-"), F.col("n_chars") * 3, F.lit(".java: "), "text").alias("text"))
    names = t.part.select(F.concat(F.lit("ID-"), "p_partkey").alias("id"),
                          F.concat("p_name", F.lit(".java")).alias("file_name"))
    out = E.restore_ids(docs, "text", "doc_id", names, "id", "file_name")
    return out.select("doc_id", F.md5("text").alias("text_md5"))


@workload("parse_cpe", "E17", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE concat(p_type, ' version ', p_size, ' ') END AS product FROM part""")
def _(spark, d):
    uri = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("cpe:2.3:"), "p_brand")).otherwise(
        F.concat(F.lit("cpe:2.3:a:"), "p_brand", F.lit(":"), "p_type", F.lit(":"), "p_size", F.lit(":*")))
    return Tables(spark, d).part.select("p_partkey", X.parse_cpe(uri).alias("product"))


@workload("repo_name", "E18", """
WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)/', 1) AS host, regexp_extract(url, '//[^/]*/([a-z]*)', 1) AS lang FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN host || '/' || lang WHEN 1 THEN lang || '/' || host
  WHEN 2 THEN host || '/r' || page_id WHEN 3 THEN 'GHSA-' || page_id ELSE 'Unknown' END AS repo FROM p""")
def _(spark, d):
    kind = F.col("page_id") % 5
    p = Tables(spark, d).pages.select(
        "page_id", F.regexp_extract("url", "//([^/]*)/", 1).alias("host"),
        F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("lang"))
    github = F.lit("https://github.com/")
    code_url = F.when(kind == 0, F.concat(github, "host", F.lit("/"), "lang"))
    package = F.when(kind == 1, F.concat(F.lit(" "), "lang", F.lit("/"), "host")).otherwise(F.col("lang"))
    refs = F.when(kind == 2, F.array(F.concat(F.lit("https://"), "host"), F.concat(
        github, "host", F.lit("/r"), "page_id", F.lit("/commit/abc")))).otherwise(F.array(F.lit("none")))
    ids = F.when(kind == 3, F.array(F.concat(F.lit("GHSA-"), "page_id"))).otherwise(
        F.array().cast("array<string>"))
    return p.select("page_id", X.repo_name(code_url, package, refs, ids).alias("repo"))


@workload("cwe_of_rule_and_path", "E19", """
SELECT page_id, list_last(string_split(url, '/')) AS rule_cwe,
  CASE WHEN page_id % 3 = 0 THEN 'CWE-' || (page_id % 700) END AS path_cwe FROM pages""")
def _(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, F.concat(
        "url", F.lit("\\CWE-"), F.col("page_id") % 700, F.lit("/BAD/CWE-1.java"))).otherwise(F.col("url"))
    return Tables(spark, d).pages.select(
        "page_id", X.rule_to_cwe("url").alias("rule_cwe"), X.path_to_cwe(path).alias("path_cwe"))


@workload("split_sections", "E20", """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS prompt, CASE WHEN doc_id % 3 > 0 THEN source END AS items,
  CASE WHEN doc_id % 3 > 0 THEN md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS code_md5 FROM documents""")
def _(spark, d):
    text = F.when(F.col("doc_id") % 3 > 0, F.concat(
        "lang", F.lit("\n+++++ "), "source", F.lit("+++++"), "text")).otherwise(F.concat("lang", F.lit("+++++"), "text"))
    s = Tables(spark, d).documents.select("doc_id", X.split_sections(text).alias("s"))
    return s.select("doc_id", "s.prompt", "s.items", F.md5("s.code").alias("code_md5"))


@workload("location_fields", "E21", """
WITH p AS (SELECT *, page_id % 90 AS a, CASE WHEN page_id % 4 > 0 THEN page_id % 90 + 2 END AS b,
  CASE WHEN page_id % 3 > 0 THEN page_id % 20 END AS c, CASE WHEN page_id % 5 > 0 THEN page_id % 50 END AS e FROM pages)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'unknown' ELSE url END AS uri, CAST(a AS BIGINT) AS start_line,
  CAST(coalesce(c, 0) AS BIGINT) AS start_col, CAST(coalesce(b, a) AS BIGINT) AS end_line,
  CAST(coalesce(e, c, 0) AS BIGINT) AS end_col, CASE WHEN page_id % 2 = 0 THEN 'String : x' ELSE '' END AS type FROM p""")
def _(spark, d):
    k = F.col("page_id")

    def num(c):
        return c.cast("int")
    encoded = F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("="), F.lit("%3D"))
    loc = F.struct(
        F.struct(F.when(k % 2 == 0, F.lit("name: String : x")).otherwise(F.lit("plain")).alias("text")).alias("message"),
        F.struct(
            F.struct(F.when(k % 11 != 0, encoded).alias("uri")).alias("artifactLocation"),
            F.struct(num(k % 90).alias("startLine"), num(F.when(k % 3 > 0, k % 20)).alias("startColumn"),
                     num(F.when(k % 4 > 0, k % 90 + 2)).alias("endLine"),
                     num(F.when(k % 5 > 0, k % 50)).alias("endColumn")).alias("region"),
        ).alias("physicalLocation"))
    f = Tables(spark, d).pages.select("page_id", X.location_fields(loc).alias("f"))
    return f.select("page_id", "f.uri", *[F.col(f"f.{n}").cast("bigint").alias(n) for n in (
        "start_line", "start_col", "end_line", "end_col")], "f.type")


@workload("unpack_pairs", "E22", """
SELECT event_id, json_extract_string(props, '$.k') || '|' || event_type AS pair_values FROM events""")
def _(spark, d):
    packed = F.regexp_replace("props", r"\}", "")
    packed = F.concat(F.lit("x "), packed, F.lit(", t: "), "event_type", F.lit("} y"))
    return Tables(spark, d).events.select(
        "event_id", F.array_join(X.unpack_pairs(packed), "|").alias("pair_values"))


@workload("canonical_path", "E23", """
WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)/', 1) AS host, regexp_extract(url, '//[^/]*/(.*)$', 1) AS rest FROM pages)
SELECT page_id, host || '/' || regexp_replace(rest, '/+', '/', 'g') AS path FROM p""")
def _(spark, d):
    p = Tables(spark, d).pages.select(
        "page_id", F.regexp_extract("url", "//([^/]*)/", 1).alias("host"),
        F.regexp_extract("url", "//[^/]*/(.*)$", 1).alias("rest"))
    kind = F.col("page_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("Files/"), "host", F.lit("\\"), "host", F.lit("/"), "rest")) \
        .when(kind == 1, F.concat("host", F.lit("//"), "rest")).otherwise(F.col("rest"))
    return p.select("page_id", X.canonical_path(raw, "host").alias("path"))


# --- rule predicates --------------------------------------------------------------------

GENERIC = ", ".join(f"'{n}'" for n in X.GENERIC_NAMES)
PARTS = " AND ".join(f"n NOT LIKE '%{p}%'" for p in X.GENERIC_PARTS)
PART_NAME = """lower(CASE WHEN p_partkey % 6 = 0 THEN replace(p_name, ' ', 'Id')
  WHEN p_partkey % 10 = 1 THEN 'Message' WHEN p_partkey % 10 = 3 THEN 'json' ELSE replace(p_name, ' ', '_') END)"""


@workload("name_allowed", "P1", f"""
SELECT p_partkey, n FROM (SELECT p_partkey, {PART_NAME} AS n FROM part) WHERE n NOT IN ({GENERIC}) AND {PARTS}""")
def _(spark, d):
    named = Tables(spark, d).part.selectExpr("p_partkey", f"{PART_NAME} AS n")
    return named.filter(X.name_allowed("n"))


SAMPLE_RE = "|".join(X.SAMPLE_WORDS)


@workload("clean_config_value", "P3", f"""
WITH {LINES}, v AS (SELECT doc_id, line_no, replace(regexp_replace(regexp_replace(line, '[^\\x00-\\x7F]', '', 'g'), '["''\\n]', '', 'g'), '\\', '\\\\') AS v FROM lines)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(v) AS value_md5 FROM v
WHERE NOT regexp_matches(lower(v), '{SAMPLE_RE}') AND NOT regexp_matches(v, '^\\s*$') AND NOT regexp_matches(v, '^[^.]*\\.[0-9]+$')""")
def _(spark, d):
    lines = E.explode_lines(Tables(spark, d).documents, "text", ["doc_id"])
    cleaned = lines.select("doc_id", F.col("line_no").cast("bigint"), X.clean_config_value("line").alias("v"))
    return cleaned.filter("v IS NOT NULL").select("doc_id", "line_no", F.md5("v").alias("value_md5"))


@workload("clean_comment", "P4", """
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)<', 1)) AS c, generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)<', 1), 1) AS pos FROM pages),
q AS (SELECT page_id, pos, regexp_replace(CASE WHEN pos % 2 = 0 THEN ' "' || c || '" ' ELSE replace(c, ' ', chr(10) || '  "') END, '^\\s+|\\s+$', '', 'g') AS v FROM c),
u AS (SELECT page_id, pos, CASE WHEN v LIKE '"%"' AND length(v) >= 2 THEN substr(v, 2, length(v) - 2) ELSE v END AS v FROM q)
SELECT page_id, CAST(pos AS BIGINT) AS pos, md5(replace(regexp_replace(v, '\\r?\\n\\s*', ' ', 'g'), '"', '\\"')) AS comment_md5 FROM u""")
def _(spark, d):
    found = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)<"), F.lit(1))
    c = Tables(spark, d).pages.select("page_id", F.posexplode(found).alias("pos", "c"))
    c = c.withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    raw = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(' "'), "c", F.lit('" '))).otherwise(
        F.replace("c", F.lit(" "), F.lit('\n  "')))
    return c.select("page_id", "pos", F.md5(X.clean_comment(raw)).alias("comment_md5"))


NAME_RE = "|".join(X.SENSITIVE_NAME_PATTERNS)


@workload("sensitive_name", "P5", f"""
WITH w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+'))) AS word FROM documents)
SELECT doc_id, word FROM w WHERE regexp_full_match(word || CASE doc_id % 3 WHEN 0 THEN 'token' WHEN 1 THEN '' ELSE 'pwd' END, '{NAME_RE}') AND NOT (word LIKE '%id%')""")
def _(spark, d):
    words = Tables(spark, d).documents.select("doc_id", F.explode(F.array_distinct(F.split(
        F.lower("text"), "[^A-Za-z0-9_]+"))).alias("word"))
    k = F.col("doc_id") % 3
    name = F.concat("word", F.when(k == 0, F.lit("token")).when(k == 1, F.lit("")).otherwise(F.lit("pwd")))
    return words.filter(X.sensitive_name(name))


TEST_RE = "|".join(X.TEST_PATH_WORDS)


@workload("is_test_path", "P7", f"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '/en/', '/latest/') WHEN 1 THEN url || '/Inspector.java' ELSE url END AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(lower(path), '{TEST_RE}') THEN 'Yes' ELSE 'No' END AS by_substring,
  CASE WHEN regexp_matches(lower(path), '(^|[/\\\\._])({TEST_RE})($|[/\\\\._])') THEN 'Yes' ELSE 'No' END AS by_segment FROM p""")
def _(spark, d):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.replace("url", F.lit("/en/"), F.lit("/latest/"))) \
        .when(k == 1, F.concat("url", F.lit("/Inspector.java"))).otherwise(F.col("url"))
    p = Tables(spark, d).pages.select("page_id", path.alias("path"))

    def word(c):
        return F.when(c, F.lit("Yes")).otherwise(F.lit("No"))
    return p.select("page_id", word(X.is_test_path("path")).alias("by_substring"),
                    word(X.is_test_path("path", "segment")).alias("by_segment"))


@workload("has_query_param", "P18", """
SELECT page_id, url FROM pages WHERE regexp_matches(url, '[?&][^=\\n]*=')""")
def _(spark, d):
    return Tables(spark, d).pages.filter(X.has_query_param("url")).select("page_id", "url")


@workload("normalise_rating", "P19", """
SELECT doc_id, CASE quality WHEN 1 THEN 'Y' ELSE 'N' END AS r1, CASE WHEN toxic = 1 AND doc_id % 3 > 0 THEN 'Y' ELSE 'N' END AS r2 FROM labels""")
def _(spark, d):
    r1 = F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("No"))
    r2 = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 3 > 0), F.lit("Y!")).when(
        F.col("doc_id") % 3 == 0, F.lit("?")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    return Tables(spark, d).labels.select("doc_id", X.normalise_rating(r1).alias("r1"), X.normalise_rating(r2).alias("r2"))


BAND_ROWS = values_sql(["cwe", "low", "high"], [(c, lo, hi) for c, (lo, hi) in X.SEVERITY_BANDS.items()])
CWE_OF_LINE = "'CWE-' || (200 + (l_partkey % 50))"


@workload("severity_band", "P20", f"""
WITH f AS (SELECT {CWE_OF_LINE} AS cwe, count(*) AS findings FROM lineitem GROUP BY 1), b AS (SELECT * FROM {BAND_ROWS})
SELECT f.cwe, CAST(coalesce(low, 3) AS BIGINT) AS low, CAST(coalesce(high, 5) AS BIGINT) AS high, findings
FROM f LEFT JOIN b ON f.cwe = b.cwe""")
def _(spark, d):
    f = Tables(spark, d).lineitem.selectExpr(f"{CWE_OF_LINE} AS cwe").groupBy("cwe").agg(F.count("*").alias("findings"))
    b = X.severity_band("cwe")
    return f.select("cwe", b.getField("low").cast("bigint").alias("low"),
                    b.getField("high").cast("bigint").alias("high"), "findings")


@workload("severity_value", "P20")
def _(spark, d):
    return Tables(spark, d).lineitem.selectExpr(f"{CWE_OF_LINE} AS cwe", "l_orderkey", "l_linenumber").select(
        "cwe", "l_orderkey", "l_linenumber", X.severity("cwe", "l_orderkey", "l_linenumber").alias("severity"))
