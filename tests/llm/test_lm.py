import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plainsight.llm import lm
from tests.llm import brute

SCHEMA = "doc_id long, text string, row long, n string, base double"


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0


def some_rows(n=300):
    rng = random.Random(7)
    tongues = [[f"{c}{i}" for i in range(40)] for c in ("Un", "été", "x")]
    rows = []
    for i in range(n):
        own = rng.choice(tongues)
        rows.append((i, " ".join(rng.choice(own[:10] if rng.random() < 0.7 else own) + ("" if rng.random() < 0.95 else str(rng.randint(0, 9999)))
                                 for _ in range(rng.randint(0, 80)))))
    return rows + [(None, "un1 xyz"), (900, None), (901, " \n"), (3, "again un2"), (3, "again un2")]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)


@pytest.mark.parametrize("head", [5, 1 << 17])
def test_base_score(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = some_rows()
    words = [brute.WORD.findall(brute.lower(t or "")) for _, t in rows]
    counts = Counter(w for (d, _), own in zip(rows, words) if not held(d) for w in [*own, None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (d, _), own in zip(rows, words):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*own, None])
        want.append((d, held(d), len(own) + 1, sum(counts[w] > 0 for w in [*own, None]), n, round(base, 6)))
    out = lm.score(table(spark, rows)).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in out), key=str) == sorted(want, key=str)
    mine = [r for r in out if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert all(r.score < 0 for r in out)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    words = [f"w{i}{'ab'[i % 2]}" for i in range(3000)]
    counts = np.sort(rng.integers(1, 500, 3000))[::-1]
    rest, kinds = np.zeros(lm.REST), np.zeros(lm.REST)
    for w, c in list(zip(words, counts.tolist()))[lm.CORE - 1:]:
        rest[lm.rest_of(w)[0]] += c
        kinds[lm.rest_of(w)[0]] += 1
    lex = lm.Lexicon(pa.array(words), counts, int(counts.sum()) + 50, 3001, 50, rest, kinds)
    w = lm.Weights.unigram(lex)
    w.outer += rng.standard_normal(w.outer.shape).astype(np.float32) / 3
    w.inner = [x + rng.standard_normal(x.shape).astype(np.float32) / 3 for x in w.inner]
    # every possible third token after two given ones
    for history in ("w5b w2000a", "new w1b"):
        texts = pa.array([f"{history} {x}" for x in words] + [history])
        t = lm.Tokens(texts, lex)
        p = 10 ** lm.log_probs(t, w)
        third = np.array([t.ends[i] - 1 for i in range(len(words))] + [t.ends[-1]])
        p = p[third]
        total = 0.0
        for i, x in enumerate(words):
            total += p[i] * (1 if i < lex.core else 10 ** lex.in_rest(counts[i], lm.rest_of(x)[0]))
        total += p[-1]
        # unknown words: one event in each rest class
        by = {lm.rest_of(x)[0]: p[i] for i, x in enumerate(words) if i >= lex.core}
        empty = [r for r in range(lm.REST) if r not in by]
        total += sum(q * 10 ** lex.in_rest(0, r) for r, q in by.items())
        f = t.slots(slice(int(third[0]), int(third[0]) + 1))[:, 0]
        z = w.outer[f].sum(axis=0) + w.outer[-1]
        z = np.exp(z - z.max())
        total += sum(z[lm.CLASSES + r] / z.sum() for r in empty)
        assert total == pytest.approx(1, abs=1e-4)


def test_tokens_follow_plain_rules_and_endings_are_hashed_once(monkeypatch):
    words = ["the", "of", "été", "a"] + [f"w{i}ing" for i in range(400)]
    lex = lm.Lexicon(pa.array(words), np.arange(len(words), 0, -1), 90000, 500, 7, np.ones(lm.REST), np.ones(lm.REST))
    texts = ["the of été", "", "new9ing", "a w399ing 木木木 the", "", "of xing yé ying"]
    calls, plain = [], lm.rest_of
    monkeypatch.setattr(lm, "rest_of", lambda w: calls.append(w) or plain(w))
    t = lm.Tokens(pa.array(texts), lex)
    assert sorted(calls) == sorted({"ng", "木木", "yé"})
    want = []
    for i, text in enumerate(texts):
        units = [lm.START] * 3
        for w in [*text.split(), None]:
            k = lex.core if w is None else words.index(w) if w in words else -1
            core = w is None or 0 <= k < lex.core
            own = (lex.core_class[k], lex.core_place[k]) if core else (lm.CLASSES + plain(w)[0], -1)
            want.append((i, *own, *units[:-4:-1], w is None))
            units.append(k if core else plain(w)[1])
    assert [*zip(*(x.tolist() for x in (t.owner, t.cls, t.place, t.last, t.second, t.third, t.kind < 0)))] == want


def test_sums_by_slot_hold_few_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "CACHED", 1000)
    rng = np.random.default_rng(3)
    values, slots = rng.integers(-50, 50, (2000, 10)).astype(np.float32), rng.integers(0, 300, (4, 2000))
    slots[1] = 7
    rows, got = lm._sum_by_slot(values, slots)
    want = np.zeros((300, 10))
    for f in slots:
        np.add.at(want, f, values)
    assert rows.tolist() == np.unique(slots).tolist() and np.array_equal(got, want[rows])


def test_what_one_partition_learns_is_not_shrunk(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROUNDS", 1)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcd" if i < 10 else "wxyz") for _ in range(40))) for i in range(80)]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), schema)
    lex = lm.read_lexicon(lm.count_words(docs), len(rows))
    start, among = lm.Weights.unigram(lex).outer, lm.train(docs, lex).outer
    alone = lm.train(spark.createDataFrame(spark.sparkContext.parallelize(rows[:10], 1), schema), lex).outer
    own, others = (np.unique(t.slots(slice(0, len(t.cls)))) for t in (
        lm.Tokens(pa.array([x for _, x in part]), lex) for part in (rows[:10], rows[10:])))
    only = np.setdiff1d(own, others)
    assert len(only) > 20 and np.abs(alone[only] - start[only]).max() > 0.05
    assert np.allclose(among[only], alone[only], atol=1e-3)


def test_every_round_reads_every_document(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b a c")], "doc_id long, text string")
    lex = lm.read_lexicon(lm.count_words(docs), 1)
    got = []
    for rounds in (1, 2, 3):
        monkeypatch.setattr(lm, "ROUNDS", rounds)
        got.append(lm.train(docs, lex).flat())
    assert np.abs(got[1] - got[0]).max() > 0.01 and np.abs(got[2] - got[1]).max() > 0.01


def test_no_training_text(spark):
    own = next(i for i in range(100) if held(i))
    out = lm.score(table(spark, [(own, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert lm.score(table(spark, [])).collect() == []
