"""How document filters interact: what each removes in every order, from a sparse document-term matrix.

Words get global numbers from their 128-bit hash: 63 bits are the number, the rest tells different words apart. A first
pass collects every number in use, by range and once a task, and finds those that two words share (expected: 5 of
10^10 words); these words are numbered anew. A second pass writes blocks of documents as CSR shards under the global
numbers. Row sums and counts of non-zeros decide the filters on words; the remaining flags are attached to the rows,
and counts by set of failed filters give every order.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import save, text_blocks, texts_of, words_of

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 2 << 20
#: Ranges of numbers; a task looks at the numbers of one range at a time: of 10^10 words at some 2.5 million.
RANGES = 4096
#: Numbers that a task remembers, so as to send each once; beyond that it starts anew.
SEEN = 500_000
FILTERS = "ABCDE"
_SYMBOLS = np.isin(np.arange(256), list(b"#$%&*|"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))


def _marked(texts: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """How many bytes of each text are wanted ones."""
    large = texts.cast(pa.large_string())
    _, offsets, data = large.buffers()
    if data is None or not len(texts):
        return np.zeros(len(texts), np.int64)
    ends = np.frombuffer(offsets, np.int64)[large.offset:large.offset + len(texts) + 1]
    there = wanted[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
    return np.diff(np.append(0, np.cumsum(there, dtype=np.int64))[ends - ends[0]])


def _numbers(names: pa.Array) -> np.ndarray:
    """(number, check) of each word: 63 and 64 bits of its hash."""
    digest, large = xxhash.xxh3_128_digest, names.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    ends = np.frombuffer(offsets, np.int64)[large.offset:large.offset + len(names) + 1].tolist() if len(names) else []
    view = memoryview(data) if data is not None else b""
    pairs = np.frombuffer(b"".join([digest(view[a:b]) for a, b in pairwise(ends)]), "<u8").reshape(-1, 2)
    return np.stack([pairs[:, 0] >> np.uint64(1), pairs[:, 1]], axis=1).view(np.int64)


def _csr(words: pa.Array, owner: np.ndarray, rows: int, shared: dict, numbers=_numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, word numbers and counts of the matrix of one shard."""
    coded = words.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    ids = numbers(coded.dictionary)
    if shared:
        ids[:, 0] = [shared.get((i, check), i) for i, check in ids.tolist()]
    cells, values = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
    row, column = np.divmod(cells, size)
    return np.searchsorted(row, np.arange(rows + 1)), ids[column, 0] if len(column) else column, values


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _different(pairs: np.ndarray) -> np.ndarray:
    """Different (number, check) pairs in order."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(pairs) else pairs


def shared_numbers(docs: DataFrame) -> dict[tuple[int, int], int]:
    """New numbers, below zero, of the words whose number another word has too, by (number, check)."""
    per_range = 63 - (RANGES - 1).bit_length()

    def collect(batches):
        seen = np.zeros((0, 2), np.int64)
        for block in text_blocks(batches, budget=SHARD):
            words, _ = words_of(texts_of(block), lower=False)
            pairs = _different(_numbers(words.dictionary_encode().dictionary))
            at = np.searchsorted(seen[:, 0], pairs[:, 0])
            if len(seen):
                new = (seen[np.minimum(at, len(seen) - 1)] != pairs).any(axis=1)
                pairs, at = pairs[new], at[new]
            seen = np.insert(seen, at, pairs, axis=0) if len(seen) < SEEN else pairs
            part = pairs[:, 0] >> per_range
            used, first = np.unique(part, return_index=True)
            bounds = pa.array(np.append(first, len(part)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.ListArray.from_arrays(bounds, pa.array(x)) for x in pairs.T.copy()]],
                                             names=["range", "numbers", "checks"])

    def find(batches):
        current, parts, size = None, [], 0

        def shared() -> pa.RecordBatch:
            pairs = _different(np.concatenate(parts)) if parts else np.zeros((0, 2), np.int64)
            twice = pairs[1:, 0] == pairs[:-1, 0]
            both = np.append(twice, False)[:len(pairs)] | np.append(False, twice)[:len(pairs)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[both].T.copy()], names=["number", "check"])

        for batch in batches:
            numbers, checks = (batch.column(c) for c in ("numbers", "checks"))
            bounds = numbers.offsets.to_numpy()
            pairs = np.stack([numbers.flatten().to_numpy(), checks.flatten().to_numpy()], axis=1)
            for own, a, b in zip(batch.column("range").to_pylist(), (bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist()):
                if own != current:
                    yield shared()
                    current, parts, size = own, [], 0
                parts.append(pairs[a:b])
                size += b - a
                if size > 2 * len(parts[0]) + 200_000:
                    parts = [_different(np.concatenate(parts))]
                    size = len(parts[0])
        yield shared()

    found = (docs.select("text").mapInArrow(collect, "range int, numbers array<bigint>, checks array<bigint>")
             .repartition("range").sortWithinPartitions("range").mapInArrow(find, "number long, check long"))
    return {pair: -1 - i for i, pair in enumerate(sorted((r["number"], r["check"]) for r in found.collect()))}


def term_matrix(docs: DataFrame, shared: dict | None = None) -> DataFrame:
    """The document-term matrix in CSR shards: doc_ids, parts (sources, null as ""), digests (SHA-256 of the texts),
    upper and symbols (counts of ``[A-Z]`` and ``[#$%&*|]``), points (code points), starts, word_ids, counts.

    Row r of a shard has the words ``word_ids[starts[r]:starts[r + 1]]``, each once, and how often it holds them. A word
    has the same number in all shards, and no other word has it. A null or empty text is an empty row; null and repeated
    doc_ids are rows of their own; other columns are not read. An empty table gives no shard."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = shared_numbers(docs) if shared is None else shared

    def cut(batches):
        for block in text_blocks(batches, budget=SHARD):
            texts = texts_of(block)
            starts, ids, values = _csr(*words_of(texts, lower=False), len(texts), shared, _numbers)
            cells = [*map(_one, _rest(block, texts)), _lists(starts, pa.int32()), _lists(ids, pa.int64()), _lists(values, pa.int32())]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_ids", "parts", "digests", "upper", "symbols", "points",
                                                           "starts", "word_ids", "counts"])

    return _read(docs).mapInArrow(
        cut, f"doc_ids array<{key}>, parts array<string>, digests array<binary>, upper array<bigint>, symbols array<bigint>, "
             "points array<bigint>, starts array<int>, word_ids array<bigint>, counts array<int>")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")


def _rest(block: pa.RecordBatch, texts: pa.Array) -> list[pa.Array]:
    """What is known of the documents beside their words."""
    digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts.cast(pa.binary())]
    return [block.column("doc_id"), pc.fill_null(block.column("source"), ""), pa.array(digests, pa.binary()),
            pa.array(_marked(texts, _UPPER)), pa.array(_marked(texts, _SYMBOLS)), pc.utf8_length(texts).cast(pa.int64())]


def document_facts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, digest, upper, symbols, points as in ``term_matrix``, and of the row of the
    matrix n_words (its sum) and n_distinct (its non-zeros). A shard is summed up where it is made."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = shared_numbers(docs)

    def rows(batches):
        for block in text_blocks(batches, budget=SHARD):
            texts = texts_of(block)
            starts, _, values = _csr(*words_of(texts, lower=False), len(texts), shared, _numbers)
            sums = np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[starts])
            facts = [*_rest(block, texts), pa.array(sums), pa.array(np.diff(starts).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(facts, names=["doc_id", "part", "digest", "upper", "symbols", "points", "n_words", "n_distinct"])

    return _read(docs).mapInArrow(rows, f"doc_id {key}, part string, digest binary, upper long, symbols long, points long, "
                                        "n_words long, n_distinct long")


def _bits(failed: list[Column]) -> Column:
    out = F.lit(0)
    for i, condition in enumerate(failed):
        out = out + F.when(condition, 1 << i).otherwise(0)
    return out


def failures(docs: DataFrame) -> DataFrame:
    """Documents counted by (doc_id, part, failed): ``failed`` has bit i for filter ``FILTERS[i]``, ``n`` the rows.

    A null doc_id is neither smaller nor greater than another, so that such a row never fails E."""
    facts = save(document_facts(docs), "document-facts")
    words = [F.col("n_words") < 50, 100 * F.col("n_distinct") < 65 * F.col("n_words"),
             100 * F.col("upper") > 5 * F.col("points"), F.col("symbols") > 0]
    # equal rows are counted before they are joined: a hot document is one row, a hot text is spread by doc_id
    rows = facts.groupBy("doc_id", "digest", "part", _bits(words).alias("four")).agg(F.count(F.lit(1)).alias("n"))
    first = (facts.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    later = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return (rows.join(first, ["digest", "doc_id"], "left").withColumn("failed", F.col("four") + later)
            .groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source, null as ""), order of the five filters and step; zeros are included.

    part, filter_order, step, and counts within the part: kept after this step, removed here, redundant (fails this
    filter, removed earlier), unique_fails (fails this filter only), good_lost and toxic_lost (removed here, with a
    label quality = 1 or toxic = 1), shapley (what this filter removes over all orders). Every row is a document of its
    own. Several labels of a document count as 1 if one of them does; a document without labels has neither. An empty
    table gives no rows. Nulls: see ``term_matrix`` and ``failures``."""
    marks = (labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    counts = (failures(docs).join(marks, "doc_id", "left").groupBy("part", "failed")
              .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
                   F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic")))
    # at most 32 sets of failed filters a part
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (cells.select("part", "cells", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("step")))
    earlier = F.expr("substr(filter_order, 1, step - 1)")
    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")
    steps = steps.withColumn("own", own).withColumn("before", _bits([F.instr(earlier, F.lit(f)) > 0 for f in FILTERS]))

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (t, c) -> t + c.{value})")

    fails, gone = "(c.failed & own) != 0", "(c.failed & before) != 0"
    share = "aggregate(filter(cells, c -> (c.failed & own) != 0), 0L, (t, c) -> t + c.n * (120 div bit_count(c.failed)))"
    here = f"{fails} AND NOT {gone}"
    return steps.select("part", "filter_order", "step",
                        total("n", "(c.failed & (own | before)) = 0").alias("kept"), total("n", here).alias("removed"),
                        total("n", f"{fails} AND {gone}").alias("redundant"), total("n", "c.failed = own").alias("unique_fails"),
                        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
                        F.expr(share).alias("shapley"))


AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
flags AS (
  SELECT x.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts x LEFT JOIN marks m ON x.doc_id = m.doc_id),
docs AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM flags GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE length(replace(replace(replace(replace(replace('ABCDE', p.f, ''), q.f, ''), r.f, ''), s.f, ''), u.f, '')) = 0),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
cells AS (
  SELECT d.part, s.filter_order, s.step, s.own, d.n, d.good, d.toxic, length(d.failed) = 1 AS only_one,
         contains(d.failed, s.own) AS fails, length(translate(d.failed, s.before, '')) < length(d.failed) AS gone
  FROM docs d, steps s),
counted AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND only_one THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
