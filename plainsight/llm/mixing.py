"""Mixing sources to target weights by repeating whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import WORD, save
from plainsight.operators.windows import row_index

#: Fixed weights of the sources, repeating in the order of their names.
WEIGHTS = (5, 2, 1)
#: No target is above this multiple of a source's size.
MOST = 3
SEED = 42


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone; equal on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target): one row per source, from rows (source, size).

    Weights follow the code points of the names, null last. Each target is its weight times one level for
    all, but ``most`` times the source's size where that is less; the level is raised until the targets
    add up to all sizes. It needs the sums of the sources below and above their limit only. The joins on the
    result are left to Spark: it broadcasts a table of sources below its size threshold and otherwise splits
    the partitions of a hot source."""
    totals = save(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    ranked = row_index(totals.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"],
                       F.struct("_null", F.coalesce(F.substring(F.hex(F.encode("source", "UTF-8")), 1, 2), F.lit(""))), "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = save(ranked.select("source", "source_size", "n", weight.cast("long").alias("weight")), "weights")
    whole, level, before = None, 0.0, None
    while True:
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
        row = ranked.agg(F.sum("source_size"), F.sum(F.when(above, most * F.col("source_size")).otherwise(0)),
                         F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        whole, held, free = (int(x or 0) for x in row)
        if (held, free) == before or not free:
            break
        before, level = (held, free), (whole - held) / free
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each row of ``docs`` is taken.

    rate = target / source size; a document is taken floor(rate) times, and once more if the seeded chance
    of its id is below the fraction. Null texts and texts without words have size 0; a source of size 0 has
    target 0 and is not taken; a null source is a source; rows that repeat an id share its chance."""
    sizes = save(docs.select("doc_id", "source", words_in().alias("size")), "sizes")
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    targets = source_targets(sizes, weights, most).withColumn("_name", name).drop("source")
    joined = sizes.withColumn("_name", name).join(targets, "_name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (chance("doc_id", seed) < rate - F.floor(rate)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         F.when(F.col("source_size") > 0, F.floor(rate) + extra).otherwise(0).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with every row repeated as the plan says; columns as given, copies adjacent.

    Sizes are counted in one pass, copies are made in a second one that moves no text."""
    sizes = docs.select("source", words_in().alias("size"))
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = save(source_targets(sizes, weights, most).select(name("source").alias("_name"), rate.alias("_rate")), "rates")
    # the rows travel in one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name("source").alias("_name"))
    copies = (F.floor("_rate") + (chance("_row.doc_id", seed) < F.col("_rate") - F.floor("_rate")).cast("long")).cast("int")
    taken = rows.join(rates, "_name").withColumn("_copies", copies).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


#: The same mix in SQL, over the view ``documents``.
MIX_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
           WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM totals),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source_size, source NULLS LAST) AS k FROM weighted),
levels AS (
  SELECT k, weight, source_size,
         (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER w, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ordered WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE weight * level <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * level, 3.0 * source_size)::DOUBLE AS target
  FROM weighted, chosen),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('42:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS chance
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated"""
