import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plainsight.llm import packing
from plainsight.llm.queries import tokenizer_file

WHOLE = Tokenizer.from_file(tokenizer_file())
CUT = packing.Encoder(tokenizer_file())


def ids(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t  \x85ab'sé9.!<|>")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    texts = [*texts, "a <|endoftext|> b", " x", "x ", ""]
    assert CUT.encode(texts) == [ids(t) for t in texts]


@pytest.mark.parametrize("length", [64, 1024])
def test_every_id_once(spark, length):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["some", "words", "été", "1234", "\n"]) for _ in range(rng.choice([0, 3, 40, 200, 900, 3000])))) for i in range(150)]
    rows += [(5000, None), (5001, ""), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, part int, ids string").repartition(5)
    got = packing.pack(docs, tokenizer_file(), length).collect()
    pieces, windows = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids) and r.length >= 1
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in rows:
        whole = ids(text) + b"\0\0\0\0"
        own = sorted(pieces[doc])
        assert b"".join(x for _, x, _ in own) == whole
        assert [s for s, _, _ in own] == [sum(len(x) // 4 for _, x, _ in own[:k]) for k in range(len(own))]
        assert {t for _, _, t in own} == {len(whole) // 4}
    filled = 0
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
        filled += at
    assert filled / (len(windows) * length) > (0.97 if length == 64 else 0.95)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.length) for r in packing.pack(docs, tokenizer_file()).collect()) == [(1, 0, 4), (1, 0, 4)]
    assert packing.pack(docs.limit(0), tokenizer_file()).collect() == []


def test_open_windows_stay_bounded():
    rng = random.Random(3)
    w, closed, total = packing.Windows(100, 4), [], 0
    for doc in range(500):
        n = rng.randint(1, 250)
        total += n
        closed += w.add(doc, 0, b"abcd" * n, n)
        assert len(w.open) <= 4
    closed += w.run_together()
    sizes = [sum(len(p[2]) // 4 for p in c) for c in closed]
    assert max(sizes) <= 100 and sum(sizes) == total and not w.open
