import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plainsight.llm import align
from plainsight.llm.bpe import byte_signs
from plainsight.llm.queries import QUERIES, piece_file, tokenizer_file

A = Tokenizer.from_file(tokenizer_file())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=piece_file())
SIGNS = byte_signs()


def tokens(text):
    """(id, bytes) of both sides by the libraries on the whole text; none if the bytes are not the text's."""
    if not text:
        return [], []
    a = [(i, bytes(SIGNS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    data = (" " + text).encode()
    if any(b"".join(x for _, x in side) != data for side in (a, b)):
        return [], []
    return a, b


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    found = []
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(i, k) for i, p, q in a for k, r, s in b if p < s and r < q]
        joint = sorted({q for _, _, q in a} & {s for _, _, s in b})
        groups, last = [], 0
        for end in joint:
            groups.append(tuple(",".join(str(i) for i, p, _ in side if last <= p < end) for side in (a, b)))
            last = end
        found.append((len(a), len(b), groups, links))
    count = Counter(pair for *_, links in found for pair in links)
    best = Counter()
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    return [(na, nb, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if na else "") for na, nb, groups, links in found]


def some_texts(rng, n):
    pieces = ["word", "été", "日本語", "1234", "  ", "\n", "don't", "<s>", "<|endoftext|>", "x" * 30, "\U0001f600", "\x00", "\x85", "\xa0 \xa0",
              "<0x41>", "internationalisation", "́", " ", "a.b", "\t"]
    return [rng.choice([" ", " ", ""]).join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 4, 30]))) for _ in range(n)]


ODD = [None, "", " ", "  ", "▁", "a ▁ b", "ends ", "ends  ", " begins", "\n", "x\r\ny", "one  two   three", "a \x1c b"]


@pytest.mark.parametrize("block,lane", [(4 << 20, 400), (200, 10)])
def test_equals_brute_force(spark, monkeypatch, tmp_path, block, lane):
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "LANE", lane)
    rng = random.Random(4)
    texts = some_texts(rng, 120) + ODD + ["repeated text here"] * 40
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pair string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_align"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t  \x85\xa0ab'sdeté9٣.!<|>▁s")) | st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=5))
def test_pieces_and_groups_of_any_text(texts):
    own = align.sides(tokenizer_file(), piece_file())
    plain = [t for t in texts if t and "▁" not in t]
    assert [x.tolist() for x in own.b.encode_all([" " + t for t in plain])[0]] == [B.encode(t) for t in plain]
    got = align.Block(own, texts)
    want = brute(texts)
    assert list(zip(got.n_a.tolist(), got.n_b.tolist(), got.n_groups.tolist(), got.n_links.tolist(), got.hashes)) == [(*w[:4], w[6]) for w in want]


def test_lanes_change_nothing(monkeypatch):
    own = align.sides(tokenizer_file(), piece_file())
    rng = random.Random(9)
    texts = [" ".join(some_texts(rng, 300)), "", "x" * 5000, "ab " * 4000]
    whole = align.Block(own, texts)
    monkeypatch.setattr(align, "LANE", 7)
    cut = align.Block(own, texts)
    assert whole.hashes == cut.hashes and whole.n_links.tolist() == cut.n_links.tolist()
    assert sorted(whole.pairs.tolist()) == sorted(cut.pairs.tolist())
    assert len(align._lanes(texts)[0]) > 1000


def test_lockstep_by_hand():
    # A: [0,2) [2,5) | [5,6)   B: [0,1) [1,3) [3,5) | [5,6);   a second lane of one token each
    a, b, cut_a, cut_b = align.lockstep(np.array([2, 5, 6, 9]), np.array([1, 3, 5, 6, 9]), np.array([0, 3]), np.array([0, 4]),
                                        np.array([3, 4]), np.array([4, 5]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (3, 4)]
    assert sorted(zip(cut_a.tolist(), cut_b.tolist())) == [(1, 2), (2, 3), (3, 4)]


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert align.align(docs, tokenizer_file(), piece_file()).collect() == []
