"""Vulnerability and project feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plainsight.functions.text import parse_cpe
from plainsight.operators.windows import first_rows

DETAIL_URL = "https://nvd.nist.gov/vuln/detail/"


def unique_per_repo(advisories: DataFrame, repo: str, cve: str, order: Sequence) -> DataFrame:
    """One record per repository and id, the first in the given order."""
    return first_rows(advisories.filter(F.col(cve).isNotNull()), [repo, cve], order)


def top_repos(advisories: DataFrame, repo: str, cve: str, n: int = 150) -> DataFrame:
    """Repositories by distinct ids; equal counts by name."""
    counts = advisories.groupBy(repo).agg(F.countDistinct(cve).alias("advisories"))
    top = counts.orderBy(F.desc("advisories"), repo).limit(n)
    # the window sees at most n rows
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("advisories"), repo)))


def flatten_cves(feed: DataFrame) -> DataFrame:
    """First weakness and description, the product of each node, and the detail link."""
    nodes = F.try_element_at("cve.configurations", F.lit(1))["nodes"]
    first = F.lit(1)
    return feed.select(
        F.try_element_at(F.try_element_at("cve.weaknesses", first)["description"], first)["value"].alias("cwe"),
        F.col("cve.id").alias("cve"),
        F.try_element_at("cve.descriptions", first)["value"].alias("description"),
        F.transform(nodes, lambda x: parse_cpe(F.try_element_at(x["cpeMatch"], first)["criteria"])).alias("products"),
        F.concat(F.lit(DETAIL_URL), "cve.id").alias("link"))


def latest_tag(tags: DataFrame, repo: str, tag: str, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Newest tag per repository by commit time; tags without a time do not count."""
    order = F.struct(ts, *tie) if tie else F.col(ts)
    return tags.filter(F.col(ts).isNotNull()).groupBy(repo).agg(
        F.max_by(tag, order).alias("tag"), F.max(ts).alias("commit_ts"))


def first_success(attempts: DataFrame, project: str = "project") -> DataFrame:
    """First version that worked in the order of preference; a detected version goes first."""
    worked = F.when(F.col("ok"), F.coalesce("detected", "java_version"))
    return attempts.groupBy(project).agg(
        F.coalesce(F.min_by(worked, F.when(F.col("ok"), F.col("rank"))), F.lit("DNB")).alias("java_version"))


def buildable(projects: DataFrame, outcome: DataFrame, project: str = "project") -> DataFrame:
    """Projects that built, with their place in the input list."""
    return projects.join(outcome.filter("java_version <> 'DNB'"), project)


def project_setting(wanted: DataFrame, settings: DataFrame, key: str, value: str, default) -> DataFrame:
    """Setting per project; the default where there is none."""
    one = settings.groupBy(key).agg(F.max(value).alias(value))
    return wanted.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
