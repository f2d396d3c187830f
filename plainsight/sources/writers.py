"""Writers, and the nested records they put out."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.functions.text import clean_comment, clean_config_value, rule_to_cwe, unpack_pairs
from plainsight.sources.readers import CATEGORIES


def write_source_tree(files: DataFrame, path: str, folder: str, text: str = "value") -> None:
    """One file per row, ``text`` and a closing NUL, in a folder per value of ``folder`` (as Spark names it) below ``path``.

    Rows are dealt out evenly, as a file costs the same whatever its size, and tasks write them by themselves: Spark's own
    writer starts two processes a file on a local disk.  Rows are in order and a file has its name once it is complete, so that
    a task run again, or twice, writes the same files.  ``path`` is new, a path or address that pyarrow can write everywhere."""
    here, base = pafs.FileSystem.from_uri(path)
    here.create_dir(base, recursive=True)

    def write(batches):
        task, made, n = TaskContext.get(), {}, 0
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, name in enumerate(names):
                if name not in made:
                    made[name] = f"{root}/{folder}={quote(name, safe='') if name else '__HIVE_DEFAULT_PARTITION__'}"
                    store.create_dir(made[name], recursive=True)
                file = f"part-{task.partitionId():05d}-{n:08d}.txt"
                temporary = f"{made[name]}/_{file}.{task.taskAttemptId()}"
                with store.open_output_stream(temporary, compression=None) as out:
                    if texts[i].is_valid:
                        out.write(texts[i].as_buffer())
                    out.write(b"\x00")
                store.move(temporary, f"{made[name]}/{file}")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows = files.select(F.col(folder).cast("string").alias(folder), F.col(text).cast("binary").alias(text))
    (rows.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, F.xxhash64(text)).sortWithinPartitions(text, folder)
     .mapInArrow(write, "files long").write.format("noop").mode("overwrite").save())


def finding_rows(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """cwe, path, line, col of the first location of each result; without one, no row."""
    first = F.try_element_at("locations", F.lit(1))["physicalLocation"]
    return (results.select(*keep, rule_to_cwe("rule_id").alias("cwe"),
                           first["artifactLocation"]["uri"].alias("path"),
                           first["region"]["startLine"].alias("line"),
                           F.coalesce(first["region"]["startColumn"], F.lit(0)).alias("col"))
            .filter("path IS NOT NULL"))


def write_findings(findings: DataFrame, path: str, project: str | None = None) -> None:
    """Headerless quoted CSV; one folder per project.

    Rows of a project come together first, so that files grow with the projects and not with projects times tasks;
    a project too large for one task is split."""
    if project:
        findings = findings.hint("rebalance", project)
    w = findings.write.option("header", "false").option("quoteAll", "true")
    (w.partitionBy(project) if project else w).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def rule_rows(items: DataFrame, category: str, file_col: str = "file_name",
              name_col: str = "name", type_col: str | None = None) -> DataFrame:
    """Kept items as rows of a rule relation: cleaned, sample data out, packed pairs opened."""
    kind = [F.col(type_col).alias("sink_type")] if type_col else []
    if category == "comments":
        return items.select(F.col(file_col).alias("file_name"), clean_comment(name_col).alias("name"), *kind)
    # a lambda holds each cleaned value, which plain column expressions would compute again wherever it is named
    kept = F.filter(F.array(clean_config_value(name_col)), lambda v: v.isNotNull())
    opened = F.flatten(F.transform(kept, lambda v: F.coalesce(
        F.when(v.contains("{"), unpack_pairs(v)), F.array(v))))
    return items.select(F.col(file_col).alias("file_name"), F.explode(opened).alias("name"), *kind)


def write_rule_rows(rows: DataFrame, path: str) -> None:
    """The relation as a Parquet table, ready for the rules."""
    rows.write.parquet(path)


def rule_row_text(rows: DataFrame) -> DataFrame:
    """Rows in the two- or three-column text form of a rule file."""
    cols = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in rows.columns]
    return rows.select(F.concat(F.lit("    - ["), F.concat_ws(", ", *cols), F.lit("]")).alias("line"))


def nest_by_file(items: DataFrame, file_col: str, fields: Sequence[str], category: str = "category") -> DataFrame:
    """Item rows to one record per file with an array per category, in the order of the fields."""
    one = F.struct(*fields)
    return items.groupBy(file_col).agg(*[
        F.sort_array(F.collect_list(F.when(F.col(category) == c, one))).alias(c) for c in CATEGORIES])


def _ordered(order: Sequence[str], payload: Column) -> Column:
    packed = F.sort_array(F.collect_list(F.struct(*order, payload.alias("_p"))))
    return F.transform(packed, lambda x: x["_p"])


def nest_flow_maps(steps: DataFrame, keys: Sequence[str] = ("project",), results_per_map: int = 1000) -> DataFrame:
    """Step rows to weakness, result and flow nesting: maps of at most ``results_per_map`` results.

    A project gets as many maps as its results need (``block`` tells them apart), so no row
    grows with the project; the reader takes any number of maps.
    """
    keys = [*keys, "block"]
    steps = steps.withColumn("block", F.floor(F.col("result_index") / results_per_map))
    step = F.struct(F.col("step"), F.col("variable_name").alias("variableName"),
                    F.col("start_line").alias("startLine"), F.col("start_col").alias("startColumn"),
                    F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn"),
                    "uri", "type", "code", F.col("flow_index").alias("flowIndex"),
                    F.col("result_index").alias("vulnerabilityIndex"))
    flows = steps.groupBy(*keys, "cwe", "result_index", "file_name", "flow_index", "label", "probability").agg(
        _ordered(["step"], step).alias("flow"))
    flow = F.struct(F.col("flow_index").alias("codeFlowIndex"), "flow", "label", "probability")
    results = flows.groupBy(*keys, "cwe", "result_index", "file_name").agg(
        _ordered(["flow_index"], flow).alias("flows"))
    result = F.struct(F.col("result_index").alias("resultIndex"), F.col("file_name").alias("fileName"), "flows")
    by_cwe = results.groupBy(*keys, "cwe").agg(_ordered(["result_index"], result).alias("results"))
    return by_cwe.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("cwe", "results")))).alias("flow_map"))


def advisory_report(advisories: DataFrame, repo: str = "repo") -> DataFrame:
    """Report lines per repository: ``part`` 0 is its head with the count, 1 an advisory.

    Sorted by (repo, part, cve_id) they are the text; a repository of any size is just rows.
    """
    entry = F.concat(
        F.lit("  - "), "cve_id", F.lit(" | "), F.coalesce("summary", F.lit("No summary available")),
        F.lit(" | Severity: "), F.coalesce("severity", F.lit("Unknown")),
        F.lit("\n    Published: "), F.coalesce("published_at", F.lit("Unknown date")),
        F.lit("\n    Advisory: "), F.coalesce("html_url", F.lit("No URL available")))
    heads = advisories.groupBy(repo).agg(F.count(F.lit(1)).alias("n")).select(
        repo, F.lit(0).alias("part"), F.lit("").alias("cve_id"),
        F.format_string("Repository: %s (%d unique advisories)", F.col(repo), F.col("n")).alias("text"))
    return heads.unionByName(advisories.select(repo, F.lit(1).alias("part"), "cve_id", entry.alias("text")))


def write_report(report: DataFrame, path: str, repo: str = "repo") -> None:
    """The lines in order, as text files that follow each other."""
    report.orderBy(repo, "part", "cve_id").select("text").write.text(path)
