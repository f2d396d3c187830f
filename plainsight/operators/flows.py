"""Flows of results: labels, verification, keys, duplicates, findings and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.functions.text import canonical_path, rule_to_cwe, slice_columns
from plainsight.operators.windows import first_rows, row_index, with_previous
from plainsight.plans.catalog import FLOW_THRESHOLD
from plainsight.session import cut_lineage, written


# --- text and keys of a flow ---------------------------------------------------------------

def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def joined_steps(steps: DataFrame, keys: Sequence[str], part: Column, sep: str, out: str,
                 order: str = "step") -> DataFrame:
    """One string per flow: ``part`` of each step in step order."""
    packed = F.sort_array(F.collect_list(F.struct(order, part.alias("_t"))))
    return steps.groupBy(*keys).agg(
        F.array_join(F.transform(packed, lambda x: x["_t"]), sep).alias(out))


def flow_text(steps: DataFrame, keys: Sequence[str], cwe: str = "cwe") -> DataFrame:
    """The verifier's input: weakness, then every step in braces."""
    part = F.concat(F.lit("{'step="), _text("step"), F.lit(", variableName="), _text("variable_name"),
                    F.lit(", type="), _text("type"), F.lit(", code="), _text("code"), F.lit(", '}"))
    body = joined_steps(steps, [*keys, cwe], part, "", "_body")
    return body.select(*keys, cwe, F.concat(F.lit("CWE = "), cwe, F.lit(", Flows = "), "_body").alias("flow_text"))


def flow_hash(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evaluation key: MD5 over all fields that tell two flows apart."""
    part = F.concat(*[x for c in ("step", "variable_name", "uri", "type", "code")
                      for x in (_text(c), F.lit("|"))][:-1])
    return joined_steps(steps, keys, part, "~~", "_t").select(*keys, F.md5("_t").alias("flow_hash"))


def flow_signature(steps: DataFrame, keys: Sequence[str], cwe: str = "cwe") -> DataFrame:
    """Duplicate key: SHA-256 over weakness, names and types only."""
    part = F.concat(F.trim(_text("variable_name")), F.lit("::"), F.trim(_text("type")))
    s = joined_steps(steps, [*keys, cwe], part, "→", "_t")
    return s.select(*keys, cwe, F.sha2(F.concat(F.lit("CWE="), cwe, F.lit("|"), "_t"), 256).alias("signature"))


def usable_flows(steps: DataFrame) -> DataFrame:
    """Steps of flows that have steps and a Yes or No label."""
    return steps.filter(F.col("step").isNotNull() & F.col("label").isin("Yes", "No"))


def dedup_flows(steps: DataFrame, order: Sequence[str], cwe: str = "cwe") -> DataFrame:
    """First flow per signature in the given key order, with the size of its group."""
    keys = [k for k in order if k != cwe]
    signed = flow_signature(usable_flows(steps), keys, cwe)
    rest = F.struct(*order)
    return (signed.groupBy("signature").agg(F.min(rest).alias("_first"), F.count(F.lit(1)).alias("copies"))
            .select("signature", "copies", "_first.*"))


def dedup_counts(steps: DataFrame, order: Sequence[str], cwe: str = "cwe") -> DataFrame:
    """total, duplicate and kept flows; total counts flows of every label."""
    total = steps.select(*order).distinct().select(F.lit(0).alias("copies"))
    rows = total.unionByName(dedup_flows(steps, order, cwe).select(F.col("copies").cast("int")))
    first = F.col("copies") > 0
    return rows.agg(F.count_if(~first).alias("total"),
                    F.coalesce(F.sum(F.when(first, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
                    F.count_if(first).alias("kept"))


# --- labels ----------------------------------------------------------------------------------

def label_flows(probability, threshold: float = FLOW_THRESHOLD) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p > threshold, F.lit("Yes")).otherwise(F.lit("No"))


def _is_yes(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x["label"])) == "yes", F.lit(False))


def keep_verified(results: DataFrame) -> DataFrame:
    """Flows labelled yes; code flows before locations; emptied results out."""
    has_flows = F.size("code_flows") > 0
    return (results
            .withColumn("_flows", F.when(has_flows, F.filter("code_flows", _is_yes)))
            .withColumn("_locs", F.when(~F.coalesce(has_flows, F.lit(False)), F.filter("locations", _is_yes)))
            .filter((F.size("_flows") > 0) | (F.size("_locs") > 0))
            .withColumn("locations", F.coalesce("_locs", "locations"))
            .withColumn("code_flows", F.coalesce("_flows", "code_flows")).drop("_flows", "_locs"))


def verified_counts(results: DataFrame) -> DataFrame:
    """Flows in all and flows removed."""
    flows = F.when(F.size("code_flows") > 0, F.transform("code_flows", lambda x: x["label"])).when(
        F.size("locations") > 0, F.transform("locations", lambda x: x["label"]))
    yes = F.size(F.filter(flows, lambda x: F.coalesce(F.lower(F.trim(x)) == "yes", F.lit(False))))
    return results.filter(flows.isNotNull()).agg(
        F.sum(F.size(flows)).alias("total"), F.sum(F.size(flows) - yes).alias("removed"))


def apply_flow_labels(results: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of (result, flow) into code flows; without code flows, the last one to all locations.

    ``labels(keys, flow_index, label)``; a label beyond the code flows goes to the locations.
    """
    packed = labels.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("flow_index", "label"))).alias("_by"))
    n_flows = F.greatest(F.coalesce(F.size("code_flows"), F.lit(0)), F.lit(0))
    flows = F.transform("code_flows", lambda x, i: x.withField("label", F.when(
        F.map_contains_key("_by", i), F.try_element_at("_by", i)).otherwise(x["label"])))
    beyond = F.array_max(F.filter(F.map_keys("_by"), lambda i: i >= F.col("_n")))
    locs = F.transform("locations", lambda x: x.withField(
        "label", F.try_element_at("_by", F.col("_beyond"))))
    return (results.join(packed, list(keys), "left").withColumn("_n", n_flows).withColumn("_beyond", beyond)
            .withColumn("code_flows", F.when(F.col("_by").isNotNull(), flows).otherwise(F.col("code_flows")))
            .withColumn("locations", F.when(F.col("_beyond").isNotNull(), locs).otherwise(F.col("locations")))
            .drop("_by", "_n", "_beyond"))


def apply_reviews(flows: DataFrame, reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviews that say Yes or No replace the label; others are ignored."""
    r = reviews.filter(F.col("label").isin("Yes", "No")).select(*keys, F.col("label").alias("_new"))
    return flows.join(r, list(keys), "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def write_back_predictions(flows: DataFrame, predictions: DataFrame, threshold: float = FLOW_THRESHOLD,
                           keys: Sequence[str] = ("cwe", "result_index", "flow_index")) -> DataFrame:
    """Probability and label by weakness, result and flow."""
    p = predictions.select(*keys, F.col("probability").alias("_p"))
    return (flows.join(p, list(keys), "left")
            .withColumn("label", F.when(F.col("_p").isNotNull(), label_flows("_p", threshold)).otherwise(F.col("label")))
            .withColumn("probability", F.coalesce("_p", "probability")).drop("_p"))


def labelled_flow_counts(flows: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Flows known per vulnerability and label; an empty label counts as its own."""
    return flows.groupBy(*keys, F.coalesce(label, F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("flows"))


# --- steps and findings -----------------------------------------------------------------------

def build_flow_steps(steps: DataFrame, files: DataFrame, keep: Sequence[str], k: int = 3) -> DataFrame:
    """Steps with the text between their columns and the lines around; files by (keys, uri).

    Steps in files that cannot be read are dropped.  A file is split once and meets the numbers of the lines
    that its steps name, not the steps; these get single lines, so that no text moves with every step.
    """
    steps = written(steps)
    on = [c for c in keep if c in files.columns] + ["uri"]
    texts = cut_lineage(files.select(*on, F.split("code", "\n").alias("_lines")))
    named = steps.filter("start_line >= 1").select(*on, "start_line").distinct().groupBy(*on).agg(
        F.collect_list("start_line").alias("_at"))
    inside = F.filter("_at", lambda x: x <= F.size("_lines"))
    lines = texts.join(named, on).select(*on, F.inline(F.transform(inside, lambda x: F.struct(
        x.alias("start_line"), F.element_at("_lines", x.cast("int")).alias("_line"),
        F.array_join(F.slice("_lines", F.greatest(F.lit(1), x - k).cast("int"),
                             (x + k - F.greatest(F.lit(1), x - k) + 1).cast("int")), "\n").alias("_around")))))
    j = steps.join(lines, [*on, "start_line"])
    return (j.select(*keep, "result_index", "flow_index", "step", "uri", "start_line", "start_col",
                    "end_line", "end_col", "type", "label",
                    slice_columns("_line", "start_col", "end_col", F.col("message")).alias("variable_name"),
                    F.col("_around").alias("code")))


def flows_for_result(results: DataFrame, where: Column) -> DataFrame:
    """All flows of the chosen results, by flow index."""
    return results.filter(where).select("*", F.posexplode("code_flows").alias("flow_index", "flow"))


def result_locations(results: DataFrame, keys: Sequence[str], project: str | None = None) -> DataFrame:
    """First location of each result with its weakness; one row per result."""
    first = F.try_element_at("locations", F.lit(1))["physicalLocation"]
    return results.select(
        *keys, "result_index", "rule_index", "message", rule_to_cwe("rule_id").alias("cwe"),
        canonical_path(first["artifactLocation"]["uri"], project).alias("path"),
        first["region"]["startLine"].alias("start_line"), first["region"]["startColumn"].alias("start_col"),
        F.coalesce(first["region"]["endLine"], first["region"]["startLine"]).alias("end_line"))


def indexed_findings(located: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Findings numbered in rule order before duplicates go; then the first per path and line.

    ``bucket`` must not decrease along (rule_index, result_index).
    """
    n = row_index(located, keys, ["rule_index", "result_index"], bucket, "number")
    n = n.withColumn("index", F.col("number") - 1).drop("number")
    return first_rows(n, [*keys, "path", "start_line"], ["index"])


def findings_by_rule(located: DataFrame, rules: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Per weakness: level and message of its first rule, and how many findings it keeps."""
    kept = indexed_findings(located, keys, bucket)
    first = rules.groupBy("cwe").agg(F.min_by("level", "rule_index").alias("level"),
                                     F.min_by("rule_message", "rule_index").alias("rule_message"))
    per = kept.groupBy(*keys, "cwe").agg(
        F.count(F.lit(1)).alias("findings"), F.min("index").alias("first_index"),
        F.max("index").alias("last_index"))
    return per.join(first, "cwe")


def findings_by_file(located: DataFrame, rules: DataFrame, keys: Sequence[str], block: int = 100_000) -> DataFrame:
    """Per file: its findings as lists ordered by result, one list per block of results.

    The blocks bound a list, whatever share of all findings one file has.
    """
    j = located.join(rules.select("rule_index", "level", "rule_message"), "rule_index")
    one = F.struct("result_index", "cwe", "level", "rule_message", "start_line", "end_line")
    return j.groupBy(*keys, "path", F.floor(F.col("result_index") / block).alias("block")).agg(
        F.sort_array(F.collect_list(one)).alias("findings"))


def contiguous_ranges(df: DataFrame, group: Sequence[str], n: str, block: int = 100_000) -> DataFrame:
    """Runs of consecutive numbers as (start, end, rows); repeated numbers count once.

    Starts and ends are found from the neighbour on either side, then paired by position,
    so a group of any size is cut into blocks of numbers.
    """
    d = df.select(*group, F.col(n).cast("bigint").alias("n")).distinct()
    bucket = F.floor(F.col("n") / block)
    d = with_previous(d, group, ["n"], bucket, {"before": "n"})
    starts = d.withColumn("is_start", (F.col("before").isNull() | (F.col("n") > F.col("before") + 1)).cast("int"))
    s = row_index(starts.filter("is_start = 1").select(*group, "n"), group, ["n"], bucket, "i")
    # the end of a run is the number before the next start; the last run ends at the maximum
    ends = starts.filter("is_start = 1 AND before IS NOT NULL").select(*group, F.col("before").alias("n"))
    last = d.groupBy(*group).agg(F.max("n").alias("n"))
    e = row_index(ends.unionByName(last), group, ["n"], bucket, "i")
    return (s.withColumnRenamed("n", "range_start").join(e.withColumnRenamed("n", "range_end"), [*group, "i"])
            .select(*group, "range_start", "range_end", (F.col("range_end") - F.col("range_start") + 1).alias("size")))
