"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The frequent words (and the end of a text) are the core; they are dealt into classes of equal mass. All other
words fall into rest classes by their ending. P(word | history) = P(class | history) * P(word | class, history):
the first factor is a softmax over all classes, with hashed features of the history (last word, last two words,
and two features that skip a word); the second one is a softmax over the members of a core class with hashed
skip features, and in a rest class the smoothed share of the word's count, with one more event for all unknown
words. The weights start at the exact unigram model. Every round reads all training documents: every partition
makes gradient steps over its own documents, and the mean of the changes goes into the next round. The mean of
a slot's changes is weighted by the tokens that met the slot, so that partitions without it do not weaken it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import fold, save, text_blocks, texts_of, words_of

FOLDS = 10
SMOOTH = 0.1
#: Core words, with the end; classes of core words; rest classes.
CORE = 1024
CLASSES = 32
REST = 16
#: Words whose counts are known in every task; the counts of rarer ones are joined.
HEAD = 1 << 17
#: Rows of hashed history features for classes, and for words in a class.
SLOTS = 1 << 13
INNER = 128
ROUNDS = 2
RATE = 0.1
BATCH = 1 << 15
#: Numbers that are summed at a time.
CACHED = 1 << 16
START = -1


def rest_of(word: str) -> tuple[int, int]:
    """Rest class and history unit of a word that is not in the core: both follow from its last two letters."""
    h = xxhash.xxh32_intdigest(word[-2:])
    return h % REST, CORE + h % 4096


def rests_of(words: pa.Array) -> np.ndarray:
    """``rest_of`` of each word, a row for each: once for each ending."""
    coded = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    kinds = np.array([rest_of(x) for x in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)
    return kinds[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Lexicon:
    """Counts of the most frequent training words, and the sums over all."""

    words: pa.Array  # HEAD most frequent words, most frequent first
    counts: np.ndarray
    tokens: int  # N, ends included
    kinds: int  # V, the end included
    texts: int
    rest_tokens: np.ndarray
    rest_kinds: np.ndarray

    def __post_init__(self):
        core = min(CORE - 1, len(self.words))
        own = np.concatenate((self.counts[:core], [self.texts])).astype(np.float64)
        order = np.argsort(-own, kind="stable")
        mass = np.cumsum(own[order])
        cls = np.minimum((mass - own[order]) * CLASSES / max(1.0, mass[-1]), CLASSES - 1).astype(np.int64)
        cls = np.unique(cls, return_inverse=True)[1]
        #: Class and place in it of each core word; the end is the last one.
        self.core_class, self.core_place = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        self.core_class[order] = cls
        sizes = np.bincount(cls)
        self.core_place[order] = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.sizes, self.core_counts, self.core = sizes, own, core
        units = rests_of(self.words[core:])
        self.head_class = np.concatenate((self.core_class[:core], CLASSES + units[:, 0]))
        self.head_unit = np.concatenate((np.arange(core), units[:, 1]))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.kinds + 1)))

    def in_rest(self, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.rest_tokens[rest] + SMOOTH * (self.rest_kinds[rest] + 1)))


@dataclass
class Weights:
    outer: np.ndarray  # (SLOTS + 1, CLASSES + REST), the last row is the bias
    inner: list[np.ndarray]  # per core class (2 * INNER + 1, members), the last row is the bias

    @staticmethod
    def unigram(lex: Lexicon) -> Weights:
        outer = np.zeros((SLOTS + 1, CLASSES + REST), np.float32)
        mass = np.zeros(CLASSES + REST)
        mass[:len(lex.sizes)] = np.bincount(lex.core_class, weights=lex.core_counts)
        mass[CLASSES:] = lex.rest_tokens + SMOOTH
        outer[-1] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -60.0)
        inner = []
        for c, size in enumerate(lex.sizes):
            w = np.zeros((2 * INNER + 1, size), np.float32)
            own = lex.core_class == c
            w[-1, lex.core_place[own]] = np.log(np.maximum(lex.core_counts[own], 1e-9))
            inner.append(w)
        return Weights(outer, inner)

    def copy(self) -> Weights:
        return Weights(self.outer.copy(), [w.copy() for w in self.inner])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.outer.ravel(), *[w.ravel() for w in self.inner]])

    def widths(self) -> np.ndarray:
        """Weights in each row of all tables, in the order of ``flat``."""
        return np.concatenate([np.full(len(w), w.shape[1]) for w in (self.outer, *self.inner)])

    def put(self, flat: np.ndarray) -> Weights:
        at = self.outer.size
        outer = flat[:at].reshape(self.outer.shape).astype(np.float32)
        inner = []
        for w in self.inner:
            inner.append(flat[at:at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return Weights(outer, inner)


class Tokens:
    """All tokens of a block of texts: history units, classes and places, with an end after each text."""

    def __init__(self, texts: pa.Array, lex: Lexicon):
        words, owner = words_of(texts, lower=True)
        coded = words.dictionary_encode()
        codes, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        known = pc.fill_null(pc.index_in(kinds, lex.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(lex.words) else np.full(len(kinds), -1)
        rare = known < 0
        found = rests_of(kinds.filter(pa.array(rare)))
        # one entry for each kind of word, and the end at -1
        cls, unit, place = np.full(len(kinds) + 1, lex.core_class[-1]), np.full(len(kinds) + 1, START), np.full(len(kinds) + 1, -1)
        head, core = np.flatnonzero(~rare), np.flatnonzero(~rare & (known < lex.core))
        cls[head], unit[head] = lex.head_class[known[head]], lex.head_unit[known[head]]
        rare = np.flatnonzero(rare)
        cls[rare], unit[rare] = CLASSES + found[:, 0], found[:, 1]
        place[core], place[-1] = lex.core_place[known[core]], lex.core_place[-1]
        n = len(texts)
        count = np.bincount(owner, minlength=n)
        self.ends = np.cumsum(count + 1) - 1
        self.owner = np.repeat(np.arange(n), count + 1)
        self.kind = np.full(len(self.owner), -1)
        self.kind[np.arange(len(codes)) + owner] = codes
        self.cls, self.place = cls[self.kind], place[self.kind]
        # an end stands for START in what follows it; words of the text before lie behind that
        before = np.concatenate((np.full(3, START), unit[self.kind]))
        start = self.ends - count
        self.last, self.second, self.third = before[2:-1], before[1:-2].copy(), before[:-3].copy()
        self.second[start] = self.third[start] = self.third[start[count > 0] + 1] = START
        self.kinds, self.known = kinds, known

    def slots(self, at: slice) -> np.ndarray:
        """Hashed features of the history, one row for each."""
        a, b, c = (x[at].astype(np.uint64) + np.uint64(2) for x in (self.last, self.second, self.third))
        k = np.uint64(0x9E3779B97F4A7C15)
        columns = [a * k, (b * k + a) * k + np.uint64(1), b * k + np.uint64(0x5851F42D4C957F2D), ((c * k + np.uint64(3)) * k + a) * k]
        return np.stack([((x ^ (x >> np.uint64(32))) * k) >> np.uint64(64 - 13) for x in columns]).astype(np.int64)

    def inner_slots(self, at) -> tuple[np.ndarray, np.ndarray]:
        k = np.uint64(0xD6E8FEB86659FD93)
        a, b = ((x[at].astype(np.uint64) + np.uint64(2)) * k >> np.uint64(57) for x in (self.last, self.second))
        return a.astype(np.int64), INNER + b.astype(np.int64)


def _scores(table: np.ndarray, slots) -> np.ndarray:
    """Sum of the tables' rows of all features, and the bias in the last row, less the largest of each token."""
    z = table.take(slots[0], axis=0)
    for f in slots[1:]:
        z += table.take(f, axis=0)
    z += table[-1]
    z -= z.max(axis=1, keepdims=True)
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _sum_by_slot(values: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, sum of the rows of ``values`` with it); ``slots`` has a row per feature, all below 2**16.

    Rows are gathered for some slots at a time, so that they are still in the processor's cache when they are summed."""
    n, width = values.shape
    flat = slots.astype(np.uint16).ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    order -= order // n * n
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    bounds = np.append(first, len(flat))
    sums = np.empty((len(first), width), values.dtype)
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(flat), max(64, CACHED // width))))
    for a, b in zip(cuts, np.append(cuts[1:], len(first))):
        rows = values.take(order[bounds[a]:bounds[b]], axis=0)
        sums[a:b] = np.add.reduceat(rows.T, first[a:b] - bounds[a], axis=1).T
    return flat[first].astype(np.int64), sums


def log_probs(tokens: Tokens, w: Weights) -> np.ndarray:
    """log10 of the model's probability of each token; of a rest word only that of its class."""
    out = np.empty(len(tokens.cls))
    for start in range(0, len(out), BATCH):
        at = slice(start, min(start + BATCH, len(out)))
        z = _scores(w.outer, tokens.slots(at))
        out[at] = z[np.arange(len(z)), tokens.cls[at]] - np.log(np.exp(z).sum(axis=1))
    for c, table in enumerate(w.inner):
        mine = np.flatnonzero(tokens.cls == c)
        for start in range(0, len(mine), BATCH):
            rows = mine[start:start + BATCH]
            z = _scores(table, tokens.inner_slots(rows))
            out[rows] += z[np.arange(len(rows)), tokens.place[rows]] - np.log(np.exp(z).sum(axis=1))
    return out / np.log(10)


class Trainer:
    """AdaGrad steps on the log likelihood of batches of tokens."""

    def __init__(self, start: Weights):
        self.w = start.copy()
        self.speed = Weights(np.full_like(start.outer, 1.0), [np.full_like(x, 1.0) for x in start.inner])
        self.tokens = 0
        #: Tokens that met each row, by table.
        self.met = [np.zeros(len(x), np.int64) for x in (start.outer, *start.inner)]

    def step(self, tokens: Tokens, at: slice):
        w, n = self.w, at.stop - at.start
        f = tokens.slots(at)
        p = _softmax(_scores(w.outer, f))
        p[np.arange(n), tokens.cls[at]] -= 1
        rows, g = _sum_by_slot(p, f)
        speed = self.speed.outer[rows] + g * g
        self.speed.outer[rows] = speed
        w.outer[rows] -= RATE * g / np.sqrt(speed)
        self.met[0] += np.bincount(f.ravel(), minlength=len(w.outer))
        by_class = np.argsort(tokens.cls[at].astype(np.uint16), kind="stable")
        cut = np.searchsorted(tokens.cls[at][by_class], np.arange(len(w.inner) + 1))
        for c, table in enumerate(w.inner):
            mine = by_class[cut[c]:cut[c + 1]] + at.start
            if len(mine) and table.shape[1] > 1:
                f = np.stack(tokens.inner_slots(mine))
                q = _softmax(_scores(table, f))
                q[np.arange(len(mine)), tokens.place[mine]] -= 1
                rows, g = _sum_by_slot(q, f)
                speed = self.speed.inner[c][rows] + g * g
                self.speed.inner[c][rows] = speed
                table[rows] -= RATE * g / np.sqrt(speed)
                self.met[c + 1] += np.bincount(f.ravel(), minlength=len(table))
        self.tokens += n

    def learn(self, tokens: Tokens):
        for start in range(0, len(tokens.cls), BATCH):
            self.step(tokens, slice(start, min(start + BATCH, len(tokens.cls))))


def count_words(training: DataFrame) -> DataFrame:
    """(word, n, rest) over all training texts."""

    def rows(batches):
        for block in text_blocks(batches):
            words, _ = words_of(texts_of(block), lower=True)
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = training.select("text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def tagged(batches):
        for batch in batches:
            rest = rests_of(batch.column("word"))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rest, pa.int32())], names=["word", "n", "rest"])

    return save(counted.mapInArrow(tagged, "word string, n long, rest int"), "words")


def read_lexicon(words: DataFrame, texts: int) -> Lexicon:
    head = words.select("word", "n").orderBy(F.desc("n"), "word").limit(HEAD).toArrow().combine_chunks()
    names = pa.concat_arrays(head.column("word").chunks) if head.num_rows else pa.array([], pa.string())
    counts = head.column("n").to_numpy() if head.num_rows else np.empty(0, np.int64)
    rest_tokens, rest_kinds = np.zeros(REST), np.zeros(REST)
    for r in words.groupBy("rest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        rest_tokens[r["rest"]], rest_kinds[r["rest"]] = r["n"], r["k"]
    whole, kinds = int(rest_tokens.sum()), int(rest_kinds.sum())
    for word, n in zip(names[:CORE - 1].to_pylist(), counts[:CORE - 1].tolist()):
        rest = rest_of(word)[0]
        rest_tokens[rest] -= n
        rest_kinds[rest] -= 1
    return Lexicon(names, counts, whole + texts, kinds + bool(texts), texts, rest_tokens, rest_kinds)


def mean_change(changes: Iterable[tuple[np.ndarray, np.ndarray]], widths: np.ndarray) -> np.ndarray:
    """Mean of (tokens that met each row, change of each weight), weighted by row; a row that nobody met stays."""
    total, met = np.zeros(int(widths.sum())), np.zeros(len(widths))
    for n, x in changes:
        total += np.repeat(n, widths) * x.astype(np.float64)
        met += n
    return (total / np.repeat(np.maximum(met, 1), widths)).astype(np.float32)


def train(training: DataFrame, lex: Lexicon) -> Weights:
    """Each round runs over all training documents; changes travel in half precision, by blocks of rows."""
    spark = training.sparkSession
    weights = Weights.unigram(lex)
    widths, blocks = weights.widths(), 16
    starts = np.concatenate(([0], np.cumsum(widths)))
    rows = np.searchsorted(starts, np.linspace(0, starts[-1], blocks + 1))
    edge = starts[rows]
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast((weights, lex))

        def climb(batches):
            start, lexicon = held.value
            trainer = Trainer(start)
            for block in text_blocks(batches):
                trainer.learn(Tokens(texts_of(block), lexicon))
            if trainer.tokens:
                change = (trainer.w.flat() - start.flat()).astype(np.float16)
                met = np.concatenate(trainer.met)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.arange(blocks, dtype=np.int32)),
                                                  "met": [met[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])],
                                                  "change": [change[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]})

        def mean(table: pa.Table) -> pa.Table:
            k = table.column("block")[0].as_py()
            # one at a time: their number grows with the partitions
            total = mean_change(((np.frombuffer(n.as_py(), np.int64), np.frombuffer(x.as_py(), np.float16))
                                 for n, x in zip(table.column("met"), table.column("change"))), widths[rows[k]:rows[k + 1]])
            return pa.table({"block": table.column("block")[:1], "change": pa.array([total.tobytes()])})

        got = (training.select("text").mapInArrow(climb, "block int, met binary, change binary").groupBy("block")
               .applyInArrow(mean, "block int, change binary").collect())
        flat = weights.flat()
        for r in got:
            flat[edge[r["block"]]:edge[r["block"] + 1]] += np.frombuffer(r["change"], np.float32)
        weights = weights.put(flat)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Texts are whole (null: empty: one token, the end). Training texts are those whose crc32(doc_id) mod 10 is
    not 0; a null id is held out. Scores are log10. Rows that repeat are counted and scored as often as they
    are there. Without training texts both scores are those of a model that knows no word (0). The counts of
    rarer words are joined by the 64-bit hash of the word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    training = texts.filter(fold("doc_id", FOLDS) != 0)
    words = count_words(training)
    lex = read_lexicon(words, training.select("doc_id").count())
    weights = train(training, lex)
    held = docs.sparkSession.sparkContext.broadcast((weights, lex))

    def rows(batches):
        w, lexicon = held.value
        part, number = TaskContext.get().partitionId(), 0
        counts = np.append(lexicon.counts, 0)
        core_base = lexicon.base(np.float64(lexicon.texts))
        in_rest = np.zeros(len(counts))
        tail = np.arange(lexicon.core, len(lexicon.counts))
        in_rest[tail] = lexicon.in_rest(lexicon.counts[tail], lexicon.head_class[tail] - CLASSES)
        base = lexicon.base(counts.astype(np.float64))
        base[-1] = in_rest[-1] = 0
        for block in text_blocks(batches):
            t = Tokens(texts_of(block), lexicon)
            n = block.num_rows
            token = np.where(t.kind >= 0, np.append(t.known, -1)[t.kind], -1)  # place in the head, -1 for others
            value = log_probs(t, w) if lexicon.texts else np.zeros(len(t.cls))
            end = t.kind < 0
            own_base = np.where(end, core_base, base[token])
            model = np.bincount(t.owner, weights=value + np.where(end, 0, in_rest[token]), minlength=n)
            rare = ~end & (token < 0)
            pair, times = np.unique(t.owner[rare].astype(np.int64) * max(1, len(t.kinds)) + t.kind[rare], return_counts=True)
            of, what = pair // max(1, len(t.kinds)), pair % max(1, len(t.kinds))
            digest = xxhash.xxh64_intdigest
            used, back = np.unique(what, return_inverse=True)
            names = t.kinds.take(pa.array(used)).to_pylist()
            keys = np.array([digest(x, 42) for x in names], np.uint64).view(np.int64)[back]
            rest = rests_of(pa.array(names, pa.string()))[:, 0].astype(np.int32)[back]
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32))
            as_lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys, rest, times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([
                pa.array((part << 33) + number + np.arange(n)), block.column("doc_id"),
                pa.array(np.bincount(t.owner, minlength=n).astype(np.int64)),
                pa.array(np.bincount(t.owner, weights=~rare & ((~end) | (lexicon.texts > 0)), minlength=n).astype(np.int64)),
                pa.array(np.bincount(t.owner, weights=own_base, minlength=n)), pa.array(model), *as_lists],
                names=["row", "doc_id", "n_tokens", "known", "base", "model", "keys", "rest", "times"])
            number += n

    scored = save(texts.mapInArrow(rows, f"row long, doc_id {kind}, n_tokens long, known long, base double, model double, "
                                         "keys array<long>, rest array<int>, times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "rest", "times")).alias("x")).select(
        "row", F.col("x.keys").alias("key"), F.col("x.rest").alias("rest"), F.col("x.times").alias("times"))
    least = int(lex.counts[-1]) if len(lex.counts) else 0
    counted = words.filter(F.col("n") <= least).select(F.xxhash64("word").alias("key"), "n")
    sums = F.create_map(*[F.lit(x) for r in range(REST) for x in (
        r, float(lex.rest_tokens[r] + SMOOTH * (lex.rest_kinds[r] + 1)))])
    joined = rare.join(counted, "key", "left")
    c = F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)
    whole = lex.tokens + SMOOTH * (lex.kinds + 1)
    model_share = F.log10(c / sums[F.col("rest")]) if lex.texts else F.lit(0.0)
    tails = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(c / F.lit(whole))).alias("more_base"),
        F.sum(F.col("times") * model_share).alias("more_model"))
    out = scored.drop("keys", "rest", "times").join(tails, "row", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens",
                      (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(lex.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
                      (F.col("model") + F.coalesce("more_model", zero)).alias("score"))
