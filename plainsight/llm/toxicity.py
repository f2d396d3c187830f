"""Toxicity by weak supervision.

Voters come from three places: a lexicon of whole words, patterns of word beginnings, and patterns of layout.
Words and beginnings, present or dense, are mined from a bounded sample of labelled rows. A generative label model with a tree
of correlated voters is fitted by expectation maximisation on the votes of every training document: it
estimates accuracies and correlations and gives each document a posterior label. A linear classifier over hashed words and
beginnings learns those posteriors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import fold, save, text_blocks, texts_of, words_of
from plainsight.llm.quality_model import labelled_sample
from plainsight.llm.quality_rules import _bytes, _sums

#: Labelled rows from which voters are mined and on which the classifier is fitted, at most.
LABELLED = 12_000
#: Slots of words and beginnings; a second set of as many marks those that a text is dense with.
HASHED = 1 << 18
SLOTS = 2 * HASHED
#: Dense: at least one such word in so many.
DENSE = 80
VOTERS = 40
PREFIXES = (4, 5, 6)
#: Features that the classifier weighs.
TERMS = 4_000
ROUNDS = 8
ACCEPT = 0.5
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&-"
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SHOUT = np.arange(256) == ord("!")
_MARK = np.isin(np.arange(256), [ord(c) for c in "#*$%&|"])
LAYOUT = 3


def slots_of(words: list[str]) -> np.ndarray:
    """Slots of a word and of its beginnings (-1 where it has none)."""
    digest, out = xxhash.xxh32_intdigest, np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    for i, word in enumerate(words):
        word = word.strip(_EDGE)
        if word:
            out[i, 0] = digest("=" + word) % HASHED
            for j, n in enumerate(PREFIXES):
                if len(word) >= n:
                    out[i, 1 + j] = digest(f"{n}{word[:n]}") % HASHED
    return out


def features(texts: pa.Array, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot), each pair once; only the active slots if these are given.

    A slot that at least one in ``DENSE`` of the text's words falls into gives a second one, ``HASHED`` above."""
    words, owner = words_of(texts, lower=True)
    length = np.bincount(owner, minlength=len(texts))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    slots = slots_of(coded.dictionary.to_pylist())
    if active is not None:
        slots = np.where((slots >= 0) & (active[slots] | active[slots + HASHED]), slots, -1)
        there = (slots >= 0).any(axis=1)[codes]
        codes, owner = codes[there], owner[there]
    of, slot = np.repeat(owner, slots.shape[1]), slots[codes].ravel()
    pairs, times = np.unique(of[slot >= 0] * HASHED + slot[slot >= 0], return_counts=True)
    of, slot = pairs // HASHED, pairs % HASHED
    dense = times * DENSE >= length[of]
    of, slot = np.concatenate((of, of[dense])), np.concatenate((slot, slot[dense] + HASHED))
    if active is not None:
        of, slot = of[active[slot]], slot[active[slot]]
    order = np.lexsort((slot, of))
    return of[order], slot[order]


def layout_votes(texts: pa.Array) -> np.ndarray:
    data, ends = _bytes(texts)
    size = np.maximum(np.diff(ends), 1)
    return np.column_stack([_sums(_UPPER[data], ends) > 0.3 * size, _sums(_SHOUT[data], ends) > 0.02 * size,
                            _sums(_MARK[data], ends) > 0.05 * size])


def mine_voters(owner: np.ndarray, slot: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots that toxic rows hold far more often than others, chosen one after another.

    A slot's value is the lower bound of its log odds times the root of its toxic rows; rows that chosen slots
    hold already count a fifth for each, so that the voters cover rare kinds as well as frequent ones."""
    toxic = y[owner] == 1
    row, at = owner[toxic], slot[toxic]
    pos = np.bincount(at, minlength=SLOTS).astype(np.float64)
    neg = np.bincount(slot[~toxic], minlength=SLOTS).astype(np.float64)
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    odds = np.log((pos + 0.5) / n1) - np.log((neg + 0.5) / n0) - 1.5 / np.sqrt(pos + 0.5)
    odds[(pos < 3) | (odds < 1.0)] = 0
    weight, chosen = np.ones(len(y)), []
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(SLOTS + 1))
    while len(chosen) < VOTERS:
        value = odds * np.sqrt(np.bincount(at, weights=weight[row], minlength=SLOTS))
        value[chosen] = 0
        best = int(value.argmax())
        if value[best] <= 0:
            break
        chosen.append(best)
        weight[row[order[ends[best]:ends[best + 1]]]] *= 0.2
    return np.array(chosen, np.int64)


def votes_of(texts: pa.Array, voters: np.ndarray) -> np.ndarray:
    """Which voters speak for each text: lexicon and beginnings, one for silence of all these, layout."""
    active = np.zeros(SLOTS, bool)
    active[voters] = True
    owner, slot = features(texts, active)
    place = np.full(SLOTS, -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(texts), len(voters)), bool)
    votes[owner, place[slot]] = True
    return np.column_stack([votes, ~votes.any(axis=1), layout_votes(texts)])


class LabelModel:
    """Accuracies and correlations of voters that speak or abstain; an accuracy below the base rate speaks for clean.

    A voter that abstains says nothing about the label. A voter that speaks adds the log odds of its accuracy over
    those of what is known without it: the base rate, or, if the voter it is most correlated with (its parent
    in a tree over all voters) speaks as well, that voter's accuracy. So correlated voters do not count twice."""

    def __init__(self, totals: np.ndarray, joint: np.ndarray, prior: float = 2.0):
        """From weights by label: ``totals`` (2,) documents, ``joint`` (2, m, m) common votes, own ones on the diagonal."""
        m = joint.shape[1]
        self.rate = float(np.clip(totals[1] / max(totals.sum(), 1e-9), 1e-4, 0.9))
        share = joint / np.maximum(totals, 1e-9)[:, None, None]
        single = np.clip(np.diagonal(share, axis1=1, axis2=2), 1e-6, 1 - 1e-6)
        spread = single * (1 - single)
        bond = np.abs(share - single[:, :, None] * single[:, None, :]) / np.sqrt(spread[:, :, None] * spread[:, None, :])
        #: Correlation of each pair of voters among documents of the same label.
        self.correlation = np.maximum(bond[0], bond[1])
        self.parent = np.full(m, -1)
        reach, inside, via = self.correlation[0].copy(), np.zeros(m, bool), np.zeros(m, np.int64)
        inside[0] = True
        for _ in range(m - 1):
            i = int(np.where(inside, -1, reach).argmax())
            if reach[i] > 0.1:
                self.parent[i] = via[i]
            inside[i] = True
            closer = self.correlation[i] > reach
            reach, via = np.where(closer, self.correlation[i], reach), np.where(closer, i, via)
        own = np.diagonal(joint, axis1=1, axis2=2)
        #: Share of toxic documents among those for which a voter speaks.
        self.accuracy = (own[1] + prior * self.rate) / (own.sum(axis=0) + prior)
        up = np.maximum(self.parent, 0)
        both = joint[:, np.arange(m), up]
        alone = np.maximum(own - both, 0)
        with_parent = (both[1] + prior * self.accuracy[up]) / (both.sum(axis=0) + prior)
        without = (alone[1] + prior * self.rate) / (alone.sum(axis=0) + prior)
        logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(x, 1e-6, 1 - 1e-6))
        base = float(logit(self.rate))
        #: Log odds that a speaking voter adds, by whether its parent speaks.
        self.adds = np.stack([np.where(self.parent >= 0, logit(without), logit(self.accuracy)) - base,
                              logit(with_parent) - logit(self.accuracy[up])])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        held = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], False).astype(np.int64)
        added = np.where(votes, self.adds[held, np.arange(votes.shape[1])], 0.0).sum(axis=1)
        odds = added + np.log(self.rate) - np.log1p(-self.rate)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _moments(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = votes.astype(np.float64)
    return weight.sum(), v.T @ (v * weight[:, None])


def fit_label_model(patterns: DataFrame, votes: np.ndarray, y: np.ndarray) -> LabelModel:
    """``patterns`` (votes binary, n) are the votes of all training documents; ``votes`` and ``y`` of the labelled ones.

    The labelled rows start the model and stay in every step; each step adds up one matrix of voters by voters."""
    m = votes.shape[1]
    known = [_moments(votes, (y == c).astype(np.float64)) for c in (0, 1)]
    t0, j0 = np.array([k[0] for k in known]), np.stack([k[1] for k in known])
    model = LabelModel(t0, j0)
    for _ in range(ROUNDS):
        held = patterns.sparkSession.sparkContext.broadcast(model)

        def step(batches):
            total, joint = np.zeros(2), np.zeros((2, m, m))
            for batch in batches:
                if batch.num_rows:
                    bits = np.frombuffer(b"".join(batch.column("votes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    v = np.unpackbits(bits, axis=1, count=m).astype(bool)
                    n, p = batch.column("n").to_numpy(), held.value.posterior(v)
                    for c, w in enumerate((n * (1 - p), n * p)):
                        t, j = _moments(v, w)
                        total[c] += t
                        joint[c] += j
            yield pa.RecordBatch.from_pydict({"x": [np.concatenate((total, joint.ravel())).tobytes()]})

        def add(batches):
            x = sum((np.frombuffer(b, np.float64) for batch in batches for b in batch.column("x").to_pylist()),
                    np.zeros(2 + 2 * m * m))
            yield pa.RecordBatch.from_pydict({"x": [x.tobytes()]})

        sums = patterns.mapInArrow(step, "x binary").coalesce(8).mapInArrow(add, "x binary").collect()
        x = np.sum([np.frombuffer(r["x"], np.float64) for r in sums], axis=0) if sums else np.zeros(2 + 2 * m * m)
        new = LabelModel(t0 + x[:2], j0 + x[2:].reshape(2, m, m))
        change = np.abs(new.accuracy - model.accuracy).max()
        model = new
        if change < 1e-4:
            break
    return model


def fit_linear(owner: np.ndarray, slot: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on the ``TERMS`` slots that tell the targets apart best; others weigh nothing."""
    n = len(target)
    rate = float(np.clip(target.mean(), 1e-4, 1 - 1e-4)) if n else 0.01
    weights, bias = np.zeros(SLOTS), float(np.log(rate / (1 - rate)))
    if not n or target.max() < 0.5 or target.min() >= 0.5:
        return weights, bias
    pos = np.bincount(slot, weights=target[owner], minlength=SLOTS)
    every = np.bincount(slot, minlength=SLOTS)
    expected = every * rate
    chi = np.where(pos >= 2.5, (pos - expected) ** 2 / (expected * (1 - rate) + 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[:TERMS]
    chosen = chosen[chi[chosen] > 10]
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[slot] >= 0
    row, col = owner[keep], place[slot[keep]]
    w, speed, speed_b = np.zeros(len(chosen)), np.full(len(chosen), 1e-8), 1e-8
    for _ in range(300):
        z = bias + np.bincount(row, weights=w[col], minlength=n)
        d = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.bincount(col, weights=d[row], minlength=len(chosen)) + 0.3 * w
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
        speed_b += d.sum() ** 2
        bias -= 0.5 * d.sum() / np.sqrt(speed_b)
    weights[chosen] = w
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, LabelModel | None]:
    """Weights of the slots, bias, and the label model (None without a voter)."""

    def sparse(batches):
        for block in text_blocks(batches):
            texts = texts_of(block)
            owner, slot = features(texts)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
            marks = np.packbits(layout_votes(texts), axis=1)
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), block.column("label"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32))),
                pa.array([m.tobytes() for m in marks], pa.binary())], names=["doc_id", "label", "slots", "layout"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, most=LABELLED).mapInArrow(
        sparse, f"doc_id {kind}, label int, slots array<int>, layout binary").toArrow().sort_by("doc_id").combine_chunks()
    if not sample.num_rows:
        return np.zeros(SLOTS), float(np.log(0.01 / 0.99)), None
    lists = sample.column("slots").combine_chunks()
    slot = lists.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(sample.num_rows), lists.value_lengths().to_numpy())
    y = sample.column("label").to_numpy().astype(np.int64)
    voters = mine_voters(owner, slot, y)
    if not len(voters):
        return *fit_linear(owner, slot, y.astype(np.float64)), None
    place = np.full(SLOTS, -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(y), len(voters)), bool)
    spoken = place[slot] >= 0
    votes[owner[spoken], place[slot[spoken]]] = True
    layout = np.unpackbits(np.frombuffer(b"".join(sample.column("layout").to_pylist()), np.uint8).reshape(len(y), -1), axis=1, count=LAYOUT)
    votes = np.column_stack([votes, ~votes.any(axis=1), layout.astype(bool)])

    def speak(batches):
        for block in text_blocks(batches):
            bits = np.packbits(votes_of(texts_of(block), voters), axis=1)
            kinds, n = np.unique(bits, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(n)], names=["votes", "n"])

    training = docs.filter(fold("doc_id", 5) != 0).select("text")
    patterns = save(training.mapInArrow(speak, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")), "votes")
    model = fit_label_model(patterns, votes, y)
    return *fit_linear(owner, slot, model.posterior(votes)), model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels are (doc_id, label).

    Whole texts only are inputs of a score; case of A-Z and punctuation around words do not count. Null texts
    count as empty, null ids are held out, repeated rows give repeated rows. Without labels, or without a word
    that marks toxic rows, every score is one small constant. An empty table gives an empty one."""
    weights, bias, _ = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def rows(batches):
        w, b = held.value
        active = w != 0
        for block in text_blocks(batches):
            owner, slot = features(texts_of(block), active)
            z = b + np.bincount(owner, weights=w[slot], minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))],
                                             names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
