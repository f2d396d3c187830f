"""Quality rules: counts of bad layout, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte trigrams: that of trusted documents (all that are labelled
as good) and that of the raw corpus (every document). Both are smoothed by the same number of trigrams, so that what the corpus holds rarely weighs
nothing. A document is kept if its ratio per trigram is at least ``LEAST``, whatever else is in the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import join_hot, save, text_blocks, texts_of, words_of

SLOTS = 1 << 15
BLOCKS = 32
SMOOTH = 200.0
LEAST = -0.3
SYMBOLS = "#*$%&|<>"
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.concat_arrays([texts.cast(pa.string())])
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.empty(0, np.uint8)), ends - ends[0]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


def _repeated_words(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words in five-word windows that a text holds twice or more."""
    if len(codes) < 5:
        return np.zeros(n, np.int64)
    k = np.uint64(0x9E3779B97F4A7C15)
    key = owner[4:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(5):
        key = (key ^ (key >> np.uint64(29)) ^ codes[j:len(codes) - 4 + j].astype(np.uint64)) * k
    whole = np.flatnonzero(owner[:-4] == owner[4:])
    key = key[whole]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    starts = whole[twice[at] == key]
    held = np.zeros(len(codes), bool)
    for j in range(5):
        held[starts + j] = True
    return np.bincount(owner[held], minlength=n)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    lines = lists.flatten()
    some = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)[some].astype(np.int64)
    owner = owner[some]
    once = np.unique(owner * (len(lines) + 1) + codes) // (len(lines) + 1)
    n = len(texts)
    return np.bincount(owner, minlength=n) - np.bincount(once, minlength=n)


def text_facts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the rules for each text."""
    n = len(texts)
    data, ends = _bytes(texts)
    words, owner = words_of(texts, lower=False)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    facts = {"n_words": np.bincount(owner, minlength=n),
             "word_chars": _sums(~_SPACE[data] & ((data & 0xC0) != 0x80), ends),
             "n_symbols": _sums(_SYMBOL[data], ends),
             "n_dup_lines": _repeated_lines(texts),
             "n_repeat_words": _repeated_words(codes, owner, n)}
    return {k: v.astype(np.int64) for k, v in facts.items()}


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte trigrams and the ends of each text's; trigrams do not cross texts."""
    data, ends = _bytes(texts)
    if len(data) < 3:
        return np.empty(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
    x = data.astype(np.uint32)
    gram = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.uint16)
    inside = np.ones(len(data), bool)
    starts = ends[:-1]
    for back in (1, 2):
        cut = ends[1:] - back
        inside[cut[cut >= starts]] = False
    return slot[inside[:-2]], np.concatenate(([0], np.cumsum(np.maximum(np.diff(ends) - 2, 0))))


def _count(batches):
    counts = np.zeros((2, SLOTS), np.int64)
    for block in text_blocks(batches):
        slots, ends = _slots(texts_of(block))
        good = np.repeat(block.column("_trusted").to_numpy(zero_copy_only=False), np.diff(ends))
        counts[0] += np.bincount(slots[~good], minlength=SLOTS)
        counts[1] += np.bincount(slots[good], minlength=SLOTS)
    width = SLOTS // BLOCKS
    if counts.any():
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(BLOCKS, dtype=np.int32)),
            *[pa.array([x[i * width:(i + 1) * width].tobytes() for i in range(BLOCKS)]) for x in counts]],
            names=["block", "raw", "good"])


def _add(table: pa.Table) -> pa.Table:
    sums = {c: np.sum([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()], axis=0).tobytes() for c in ("raw", "good")}
    return pa.table({"block": table.column("block")[:1], **{c: pa.array([v]) for c, v in sums.items()}})


def fit_ratio(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log ratio of each slot. ``trusted`` has the ids (doc_id) of good documents, each once, as many as there
    are. Counts are added up by blocks of slots, of fixed number and size."""
    texts = docs.select("doc_id", "text")
    ids = save(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(trusted.select("doc_id"), "doc_id"), "trusted")
    good = join_hot(texts, ids, ["doc_id"], texts.count(), "n")
    # the raw corpus is counted where it lies; only trusted documents move
    marked = texts.select("text", F.lit(False).alias("_trusted")).unionByName(good.select("text", F.lit(True).alias("_trusted")))
    rows = (marked.mapInArrow(_count, "block int, raw binary, good binary")
            .groupBy("block").applyInArrow(_add, "block int, raw binary, good binary").collect())
    raw, good = np.zeros(SLOTS), np.zeros(SLOTS)
    width = SLOTS // BLOCKS
    for row in rows:
        at = slice(row["block"] * width, (row["block"] + 1) * width)
        raw[at], good[at] = np.frombuffer(row["raw"], np.int64), np.frombuffer(row["good"], np.int64)
    if not good.sum():
        return np.zeros(SLOTS)
    raw *= good.sum() / raw.sum()
    return np.log((good + SMOOTH) / (raw + SMOOTH))


def verdicts(texts: pa.Array, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, base_failed, ratio and kept for each text."""
    out = text_facts(texts)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    slots, ends = _slots(texts)
    out["ratio"] = _sums(ratio[slots], ends) / np.maximum(np.diff(ends), 1)
    out["kept"] = ~out["base_failed"] & (out["ratio"] >= LEAST)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all rows (doc_id, label) with label 1."""
    return labels.filter("label = 1").select("doc_id").distinct()


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, ratio, kept) for each row of ``docs`` (doc_id, text).

    Null texts count as empty; they and texts of fewer than ten words fail. Without trusted documents every
    ratio is 0 and the base rules decide. Null ids are never trusted; repeated rows give repeated rows."""
    ratio = fit_ratio(docs, trusted)

    def rows(batches):
        for block in text_blocks(batches):
            found = verdicts(texts_of(block), ratio)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, ratio double, kept boolean")


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, with all their columns; no row is moved."""
    ratio = fit_ratio(docs, trusted)

    def rows(batches):
        for block in text_blocks(batches):
            yield block.filter(pa.array(verdicts(texts_of(block), ratio)["kept"]))

    return docs.mapInArrow(rows, docs.schema)
