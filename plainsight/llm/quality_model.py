"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are complete to a fixed depth and kept as arrays (feature, threshold, leaf value), so that a batch of
documents goes down all levels of a tree with a few numpy operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import fold, sample_rows, text_blocks, texts_of, words_of
from plainsight.llm.quality_rules import _bytes, _repeated_lines, _repeated_words, _sums

#: Labelled rows on which the trees are fitted at most.
LABELLED = 20_000
BINS = 64
TREES = 80
DEPTH = 5
RATE = 0.15
LAMBDA = 1.0
LEAST_HESSIAN = 1.0
ACCEPT = 0.3

_RANGE = np.arange(256)
_CLASSES = {
    "upper": (_RANGE >= 65) & (_RANGE <= 90), "lower": (_RANGE >= 97) & (_RANGE <= 122),
    "digit": (_RANGE >= 48) & (_RANGE <= 57), "blank": np.isin(_RANGE, [32, 9, 10, 11, 12, 13]),
    "stop": np.isin(_RANGE, [ord(c) for c in ".,;:?"]), "shout": _RANGE == ord("!"),
    "bar": _RANGE == ord("|"), "mark": np.isin(_RANGE, [ord(c) for c in "#*$%&<>^~_=+\\/@[]{}"]),
    "quote": np.isin(_RANGE, [ord(c) for c in "\"'()-"]), "beyond": _RANGE >= 128, "line": _RANGE == 10,
}
FEATURES = [*_CLASSES, "log_words", "log_bytes", "word_bytes", "distinct", "top_word", "stutter", "windows",
            "lines", "double_lines", "words_a_line"]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros."""
    n = len(texts)
    data, ends = _bytes(texts)
    size = np.diff(ends).astype(np.float64)
    words, owner = words_of(texts, lower=False)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(owner, minlength=n).astype(np.float64)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    columns = [_sums(member[data], ends) / per_byte for member in _CLASSES.values()]
    pair, times = np.unique(owner * (len(codes) + 1) + codes, return_counts=True)
    of = pair // (len(codes) + 1)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    again = (owner[1:] == owner[:-1]) & (codes[1:] == codes[:-1])
    lines = np.bincount(np.repeat(np.arange(n), pc.list_value_length(pc.split_pattern(texts, "\n")).to_numpy(zero_copy_only=False)), minlength=n)
    length = np.bincount(owner, weights=pc.binary_length(words).to_numpy(zero_copy_only=False), minlength=n)
    columns += [np.log1p(count), np.log1p(size), length / per_word, np.bincount(of, minlength=n) / per_word, top / per_word,
                np.bincount(owner[1:][again], minlength=n) / per_word, _repeated_words(codes, owner, n) / per_word,
                np.log1p(lines), _repeated_lines(texts) / np.maximum(lines, 1), count / np.maximum(lines, 1)]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Arrays over all trees: inner nodes in heap order, leaves left to right."""

    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting by Newton steps on histograms. One class only, or no row: a constant."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    width = x.shape[1]
    out, total = [], np.full(len(y), base)
    flat = binned + np.arange(width) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, many = 2 ** depth - 1, 2 ** depth
            slot = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (many, width, BINS)
            g = np.bincount(slot, weights=np.repeat(gradient, width), minlength=many * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(slot, weights=np.repeat(hessian, width), minlength=many * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + LAMBDA) + (all_g - g) ** 2 / (all_h - h + LAMBDA) - all_g ** 2 / (all_h + LAMBDA)
            gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for i in np.flatnonzero(gain.reshape(many, -1)[np.arange(many), best] > 1e-6):
                f, b = divmod(int(best[i]), BINS)
                if b < len(edges[f]):
                    feature[first + i], threshold[first + i], cut[first + i] = f, edges[f][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        value = -RATE * np.bincount(at, weights=gradient, minlength=leaves) / (np.bincount(at, weights=hessian, minlength=leaves) + LAMBDA)
        total += value[at]
        out.append((feature, threshold, value))
    return Trees(*(np.array(z) for z in zip(*out)), base)


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out fold; the ids are few enough to broadcast."""
    ids = sample_rows(labels.filter(fold("doc_id", folds) != 0), "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from the statistics of the labelled sample (a bounded table of numbers comes to the driver)."""

    def rows(batches):
        for block in text_blocks(batches):
            x = statistics(texts_of(block))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = labelled_sample(docs, labels).mapInArrow(rows, f"doc_id {kind}, label int, x array<double>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit_trees(x, got.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels are (doc_id, label).

    Null texts count as empty and are scored like any other; null ids are held out. Without labels the score
    is one constant for all. Only texts are inputs of a score. An empty table gives an empty one."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def rows(batches):
        for block in text_blocks(batches):
            s = trees.value.score(statistics(texts_of(block)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
