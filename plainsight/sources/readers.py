"""Readers: source trees, parsed items, result files, flow maps, findings, feeds, models, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.functions.text import location_fields
from plainsight.operators.windows import fill_forward
from plainsight.sources import schemas as S

CATEGORIES = ("variables", "strings", "comments", "sinks")
#: Suffixes by which Hadoop finds a codec.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst", "passthrough")


def read_source_tree(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """path, file_name and whole text of every matching file below ``path``.

    Spark's text reader looks for a codec for every file.  Where the glob ends in a suffix that no codec has, the
    bytes are read as they are, which gives the same texts for a third of the time."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    dot, suffix = glob.rpartition(".")[1:]
    if dot and suffix.isalnum() and suffix.lower() not in PACKED:
        rows, code = files.format("binaryFile").load(path), F.col("content").cast("string")
    else:
        rows, code = files.text(path, wholetext=True), F.col("value")
    return rows.select(F.input_file_name().alias("path"),
                       F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), code.alias("code"))


def parsed_items(parsed: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """JSON text (file name to parsed file) to (file_name, category, name, type, methods).

    Comments carry their methods as text; other categories as an array.
    """
    files = parsed.select(*keep, F.explode(F.from_json(json_col, S.PARSED_FILES)).alias("file_name", "f"))

    def item(cat) -> Column:
        def shape(x):
            kind = x["type"] if cat == "variables" else F.lit(None).cast("string")
            methods = F.array().cast("array<string>") if cat == "comments" else x["methods"]
            return F.struct(F.lit(cat).alias("category"), x["name"].alias("name"),
                            kind.alias("type"), methods.alias("methods"))
        return F.coalesce(F.transform(f"f.{cat}", shape), F.array())
    return (files.select(*keep, "file_name", F.explode(F.concat(*[item(c) for c in CATEGORIES])).alias("i"))
            .select(*keep, "file_name", "i.*"))


def read_parsed_items(spark: SparkSession, path: str) -> DataFrame:
    return parsed_items(spark.read.text(path), "value")


def parsed_methods(parsed: DataFrame, json_col: str) -> DataFrame:
    """(file_name, method, code); a failed parse holds an array there and gives no rows."""
    files = parsed.select(F.explode(F.from_json(json_col, S.PARSED_FILES)).alias("file_name", "f"))
    code = F.from_json("f.methodCodeMap", "MAP<STRING, STRING>")
    return files.select("file_name", F.explode(code).alias("method", "code"))


def one_per_base_name(files: DataFrame, name: str = "file_name", path: str = "path") -> DataFrame:
    """One row per base name, the largest path: as when equal names overwrite each other."""
    rest = [c for c in files.columns if c != name]
    return files.groupBy(name).agg(F.max_by(F.struct(*rest), path).alias("_r")).select(name, "_r.*")


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per result: project file, index, rule, message, locations and code flows."""
    raw = spark.read.schema(S.RESULTS).option("multiLine", str(multi_line).lower()).json(path)
    return result_rows(raw)


def result_rows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    r = raw.select(*keep, F.element_at("runs", 1).alias("run")).select(
        *keep, F.posexplode("run.results").alias("result_index", "r"))
    flows = F.transform("r.codeFlows", lambda c: F.struct(
        c["label"].alias("label"), F.transform(
            F.element_at(c["threadFlows"], 1)["locations"], lambda x: x["location"]).alias("locations")))
    return r.select(*keep, "result_index", F.col("r.ruleId").alias("rule_id"),
                    F.col("r.ruleIndex").alias("rule_index"), F.col("r.message.text").alias("message"),
                    F.col("r.locations").alias("locations"), flows.alias("code_flows"))


def step_rows(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Results to one row per step; a result without code flows is one flow of its locations."""
    plain = F.transform("locations", lambda x: F.struct(
        x["message"].alias("message"), x["physicalLocation"].alias("physicalLocation")))
    label = F.element_at("locations", 1)["label"]
    alone = F.array(F.struct(label.alias("label"), plain.alias("locations")))
    flows = F.when(F.size("code_flows") > 0, F.col("code_flows")).when(F.size("locations") > 0, alone)
    rows = results.select(*keep, "result_index", "rule_id", F.posexplode_outer(flows).alias("flow_index", "f"))
    rows = rows.select(*keep, "result_index", "rule_id", "flow_index", F.col("f.label").alias("label"),
                       F.posexplode_outer("f.locations").alias("step", "loc"))
    return rows.withColumn("l", location_fields("loc")).select(
        *keep, "result_index", "rule_id", "flow_index", "label", "step", "l.*")


def flow_map_steps(maps: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Flow-map JSON (weakness to results) to one row per step."""
    m = maps.select(*keep, F.explode(F.from_json(json_col, S.FLOW_MAP)).alias("cwe", "rs"))
    m = m.select(*keep, "cwe", F.explode("rs").alias("r"))
    m = m.select(*keep, "cwe", F.col("r.resultIndex").alias("result_index"),
                 F.col("r.fileName").alias("file_name"), F.explode("r.flows").alias("f"))
    return m.select(*keep, "cwe", "result_index", "file_name", F.col("f.codeFlowIndex").alias("flow_index"),
                    "f.label", "f.probability", F.explode_outer("f.flow").alias("s")).select(
        *keep, "cwe", "result_index", "file_name", "flow_index", "label", "probability",
        F.col("s.step").alias("step"), F.col("s.variableName").alias("variable_name"),
        F.col("s.type").alias("type"), F.col("s.uri").alias("uri"),
        F.col("s.startLine").alias("start_line"), F.col("s.startColumn").alias("start_col"),
        F.col("s.endLine").alias("end_line"), F.col("s.endColumn").alias("end_col"),
        F.col("s.code").alias("code"))


def read_flow_maps(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; the project is the folder or file name."""
    raw = spark.read.text(path).withColumn(
        "project", F.regexp_extract(F.input_file_name(), r"(?:project=)?([^/]+?)(?:\.json)?(?:/part-[^/]*)?$", 1))
    return flow_map_steps(raw, "value", ["project"])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Headerless quoted CSV files, one or more per project; project from the file or folder."""
    name = F.input_file_name()
    folder = F.regexp_extract(name, r"project=([^/]+)/", 1)
    rows = (spark.read.schema(S.FINDINGS).option("recursiveFileLookup", "true")
            .option("quote", '"').option("escape", '"').csv(path))
    return rows.select("*", F.when(folder != "", folder).otherwise(
        F.regexp_extract(name, r"([^/]+?)(?:\.csv)?$", 1)).alias("project"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ADVISORY).json(path)


def read_cve_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CVE).json(path)


def model_tables(models: DataFrame, json_col: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Quality-model JSON to nodes(name, level, positive, tool) and edges(parent, child, weight)."""
    m = models.select(*keep, F.from_json(json_col, S.MODEL).alias("m"))
    levels = {"tqi": "m.factors.tqi", "quality_aspect": "m.factors.quality_aspects",
              "product_factor": "m.factors.product_factors", "measure": "m.measures",
              "diagnostic": "m.diagnostics"}
    nodes = None
    for level, col in levels.items():
        part = m.select(*keep, F.lit(level).alias("level"), F.explode(col).alias("name", "n"))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = nodes.select(*keep, F.col("name").alias("parent"), F.explode(F.map_keys("n.children")).alias("child"), "n") \
        .select(*keep, "parent", "child", F.try_element_at("n.weights", F.col("child")).alias("weight"))
    return (nodes.select(*keep, "name", "level", (F.lower("n.positive") == "true").alias("positive"),
                         F.col("n.toolName").alias("tool")), edges)


def read_quality_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return model_tables(spark.read.text(path, wholetext=True), "value")


def split_label_cell(cell) -> Column:
    """Comma list in a cell: trimmed, unquoted, empties dropped."""
    parts = F.transform(F.split(cell, ","), lambda p: F.regexp_replace(F.trim(p), "^[\"']+|[\"']+$", ""))
    return F.filter(parts, lambda p: p != "")


def merge_label_rows(rows: DataFrame, file_col: str, cells: Sequence[str]) -> DataFrame:
    """(file, category, pos-free name) rows: lists of repeated files appended."""
    out = None
    for c in cells:
        part = rows.select(file_col, F.lit(c).alias("category"), F.explode(split_label_cell(F.col(c))).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def read_label_csv(spark: SparkSession, path: str, file_col: str = "fileName",
                   cells: Sequence[str] = CATEGORIES) -> DataFrame:
    schema = ", ".join(f"{c} STRING" for c in [file_col, *cells])
    rows = spark.read.schema(schema).option("header", "true").option("escape", '"').option(
        "multiLine", "true").csv(path)
    return merge_label_rows(rows, file_col, cells)


def sections_to_labels(sheet: DataFrame, keys: Sequence[str], row: str, bucket: Column,
                       section: Column, item: Column, answer: Column,
                       kind: Column | None = None) -> DataFrame:
    """Sheet rows to label rows.

    ``section`` is the section name on its header row and null elsewhere.  A section stops at
    its first row without an item; rows without an answer are left out.
    """
    s = sheet.select(*keys, row, bucket.alias("_cut"), section.alias("_head"), item.alias("name"),
                     answer.alias("_answer"), (kind if kind is not None else F.lit(None)).cast("string").alias("type"))
    empty = F.col("_head").isNull() & F.col("name").isNull()
    s = s.withColumn("_mark", F.when(F.col("_head").isNotNull(), F.struct(F.col(row).alias("at"), F.lit(0).alias("stop"), F.col("_head").alias("h")))
                     .when(empty, F.struct(F.col(row).alias("at"), F.lit(1).alias("stop"), F.lit(None).cast("string").alias("h"))))
    # The latest header or empty row before a row says whether its block is still open.
    filled = fill_forward(s, keys, [row], F.col("_cut"), {"last_mark": "_mark"})
    kept = filled.filter("last_mark.stop = 0 AND _head IS NULL AND name IS NOT NULL AND _answer IS NOT NULL")
    return kept.select(*keys, row, F.col("last_mark.h").alias("category"), F.trim("name").alias("name"), "type",
                       F.when(F.lower(F.trim("_answer")) == "yes", F.lit("Yes")).otherwise(F.lit("No")).alias("is_sensitive"))


