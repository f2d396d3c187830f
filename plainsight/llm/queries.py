"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.llm import (
    align,
    audit,
    bpe,
    line_dedup,
    lm,
    mixing,
    neighbours,
    packing,
    quality_model,
    quality_rules,
    simhash,
    toxicity,
    warc,
)
from plainsight.llm.common import read_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op2_packing(spark, sf_dir):
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), keep_ids=False)
    return packed.drop("ids")


@query
def op3_quality_rules(spark, sf_dir):
    trusted = quality_rules.trusted_ids(read_labels(spark, sf_dir, "quality"))
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted)


@query
def op4_mixing(spark, sf_dir):
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL["op4_mixing"] = mixing.MIX_SQL


@query
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


@query
def op6_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_warc"] = warc.WARC_SQL


@query
def op7_neighbours(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


@query
def op9_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), read_labels(spark, sf_dir, "toxic"))


@query
def op10_quality_model(spark, sf_dir):
    return quality_model.score(_table(spark, sf_dir, "documents"), read_labels(spark, sf_dir, "quality"))


@query
def op1_lm(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"))


@query
def op12_bpe(spark, sf_dir):
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file()), tokenizer_file())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))


@query
def op13_audit(spark, sf_dir):
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


SQL["op13_audit"] = audit.AUDIT_SQL


@query
def op11_align(spark, sf_dir):
    return align.align(_table(spark, sf_dir, "documents"), tokenizer_file(), piece_file())
