import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from plainsight.llm import bpe
from plainsight.llm.queries import QUERIES, tokenizer_file

LIBRARY = Library.from_file(tokenizer_file())
OWN = bpe.Tokenizer(tokenizer_file())


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by_scan(merges, word):
    """Merge the leftmost pair of the lowest rank until none is left."""
    out = [int(merges.first[b]) for b in word]
    while True:
        found = [(merges.ranks[a << 17 | b], i) for i, (a, b) in enumerate(zip(out, out[1:])) if a << 17 | b in merges.ranks]
        if not found:
            return out
        rank, i = min(found)
        out[i:i + 2] = [merges.made_list[rank]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t  \x85\xa0ab'sdeté9٣.!<|>")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_equals_the_library(texts):
    texts = [*texts, "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", " x", "x ", "", "\u0558\U0003d000 new signs"]
    got = OWN.encode_all(texts)
    assert [g.tolist() for g in got] == [ids(t) for t in texts] == [OWN.encode(t).tolist() for t in texts]
    assert [OWN.decode(g) for g in got] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=8))
def test_decodes_any_ids_as_the_library(some):
    assert OWN.decode(np.array(some, np.int64)) == LIBRARY.decode(some, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=40), st.integers(1, 30))
def test_trees_equal_a_scan(words, few):
    """A small table with many ties and overlaps; one tree, trees side by side, and a plain scan agree."""
    first = list(range(256))
    pairs = [(97, 97, 256), (97, 98, 257), (256, 256, 258), (98, 97, 259), (257, 257, 260), (258, 97, 261), (0, 0, 262)]
    merges, old = bpe.Merges(first, pairs), bpe.FEW
    words = [bytes(97 + b % 3 if b > 40 else 0 for b in w) for w in words]
    try:
        bpe.FEW = few
        got = merges.words(words)
    finally:
        bpe.FEW = old
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [merges.one(w) for w in words] == [by_scan(merges, w) for w in words]


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 7000 + " x", "中文" * 4000, " " * 3000 + "x", "word " * 9000])
def test_very_long_texts_and_words(text, monkeypatch):
    assert OWN.encode(text).tolist() == ids(text)
    monkeypatch.setattr(bpe, "PIECE", 100)
    assert OWN.encode(text).tolist() == ids(text)


def test_store_starts_anew(monkeypatch):
    own = bpe.Tokenizer(tokenizer_file())
    monkeypatch.setattr(bpe, "STORE", 3)
    for text in ["one two three four", "five <|endoftext|> six", "one seven", ""] * 2:
        assert [g.tolist() for g in own.encode_all([text, text])] == [ids(text)] * 2


def test_special_tokens_as_text():
    library = Library.from_file(tokenizer_file())
    library.encode_special_tokens = True
    own = bpe.Tokenizer(tokenizer_file(), special=False)
    text = "a<|endoftext|> b"
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids != OWN.encode(text).tolist()


def test_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_file(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Tokenizer(str(tmp_path / "t.json"))


def test_query(spark, tmp_path):
    rows = [(1, "one two  three\n<|endoftext|>été"), (1, "one two  three\n<|endoftext|>été"), (2, None), (None, ""), (3, "long " * 20_000)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, key int, ids string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op12_bpe"](spark, str(tmp_path)).collect()), key=repr)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert got == sorted([(i, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or "")) for i, t in rows], key=repr)
    bpe_docs = bpe.encode(docs.limit(0), tokenizer_file())
    assert bpe_docs.columns == ["doc_id", "ids"] and bpe_docs.collect() == []
