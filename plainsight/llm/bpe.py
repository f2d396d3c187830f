"""Byte-level BPE: ids of whole texts by a segment tree over adjacent pair ranks, and texts from ids.

A word's leaves are its adjacent symbol pairs, each with the key rank * leaves + position, so that the root
holds the leftmost pair of the lowest rank. A merge changes three leaves (the merged pair, the one before it and
the one it swallows) and the nodes above them. Words of about one length are merged side by side, one tree a row;
long or rare lengths use one tree of plain lists. Vocabulary, merges and special tokens come from the tokenizer's
file; nothing is trained.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from plainsight.llm.common import text_blocks, texts_of

#: Fixed pattern of byte-level BPE words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A word begins at a blank between two characters that are no white space: texts can be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are split into words at once.
PIECE = 1 << 20
#: Words whose ids are kept; beyond that the store starts anew.
STORE = 250_000
#: Fewer words of one tree size than this are merged one by one.
FEW = 24
#: Cells of the trees that are merged side by side.
CELLS = 1 << 19
_SHIFT = 17  # ids are below 2 ** 17
_NONE = np.iinfo(np.int64).max


def byte_signs() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves,
    the others follow from U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class Merges:
    """The merge table: ranks of pairs, and the two forms of the segment tree over it."""

    def __init__(self, first: list[int], pairs: list[tuple[int, int, int]]):
        """``first``: id of each byte; ``pairs``: left id, right id and merged id in order of rank."""
        a, b, made = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = a << _SHIFT | b
        order = np.argsort(keys, kind="stable")
        self.first = np.array(first, np.int64)
        self.keys, self.rank, self.made = keys[order], order, made
        self.ranks = {k: r for r, k in reversed(list(enumerate(keys.tolist())))}
        self.made_list = made.tolist()
        left, right = np.meshgrid(self.first, self.first, indexing="ij")
        self.byte_pairs = self.lookup(left, right)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE for pairs that do not merge. A negative id belongs to no pair."""
        keys = a << _SHIFT | np.where(b < 0, (1 << _SHIFT) - 1, b)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def one(self, word: bytes) -> list[int]:
        """Ids of one word, the tree in a list."""
        ids, none = self.first[np.frombuffer(word, np.uint8)].tolist(), _NONE
        n = len(ids)
        size = 1 << max(n - 2, 0).bit_length()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, made = self.ranks, self.made_list

        def leaf(i: int, j: int) -> int:
            rank = ranks.get(ids[i] << _SHIFT | ids[j])
            return none if rank is None else rank * size + i

        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            gone, before = right[i], left[i]
            after = right[gone]
            ids[i], ids[gone], right[i] = made[rank], -1, after
            if after < n:
                left[after] = i
            changed = [(i, leaf(i, after) if after < n else none)]
            if gone < n - 1:
                changed.append((gone, none))
            if before >= 0:
                changed.append((before, leaf(before, i)))
            for at, value in changed:
                node = size + at
                tree[node] = value
                while node > 1:
                    node >>= 1
                    low = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == low:
                        break
                    tree[node] = low
        return [i for i in ids if i >= 0]

    def many(self, raw: np.ndarray) -> np.ndarray:
        """Ids of words of at most leaves + 1 bytes, one a row (padding -1); merged symbols leave a -1 behind."""
        rows, leaves = raw.shape[0], raw.shape[1] - 1
        ids = np.full((rows, leaves + 2), -1, np.int64)  # the last column stands for "no symbol"
        ids[:, :-1] = np.where(raw < 0, -1, self.first[raw])
        place = np.arange(leaves)
        tree = np.full((rows, 2 * leaves), _NONE)
        rank = self.byte_pairs[raw[:, :-1], raw[:, 1:]]
        tree[:, leaves:] = np.where((raw[:, 1:] < 0) | (rank == _NONE), _NONE, rank * leaves + place)
        level = leaves
        while level > 1:
            level >>= 1
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        width = leaves + 2
        left = np.tile(np.arange(-1, leaves + 1), (rows, 1)).ravel()
        right = np.tile(np.arange(1, leaves + 3), (rows, 1)).ravel()
        flat, nodes = ids.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            row, root = live * width, live * (2 * leaves)
            rank, i = np.divmod(nodes[root + 1], leaves)
            gone, before = right[row + i], left[row + i]
            after = right[row + gone]
            made = self.made[rank]
            flat[row + i], flat[row + gone] = made, -1
            right[row + i] = after
            left[row + after] = i
            none_before = before < 0
            a = np.where(none_before, -1, flat[row + before])
            pairs = self.lookup(np.stack([a, made]), np.stack([made, flat[row + after]]))
            start = np.where(none_before, i, before)
            node = np.stack([np.minimum(gone, leaves - 1), start, i]) + leaves
            # the last write to a leaf counts: a pair without one before it is written over by its own leaf
            nodes[root + node[0]] = _NONE
            nodes[root + node[1]] = np.where(pairs[0] == _NONE, _NONE, pairs[0] * leaves + start)
            nodes[root + node[2]] = np.where(pairs[1] == _NONE, _NONE, pairs[1] * leaves + i)
            for _ in range(leaves.bit_length() - 1):
                node >>= 1
                at = root + 2 * node
                nodes[root + node] = np.minimum(nodes[at], nodes[at + 1])
            live = live[nodes[root + 1] < _NONE]
        return ids[:, :-1]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian bytes, four an id."""
        lengths = np.array([len(w) for w in words], np.int64)
        sizes = np.left_shift(1, np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        out: list[bytes] = [b""] * len(words)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if len(own) < FEW or size > 1024:
                for w in own.tolist():
                    out[w] = np.array(self.one(words[w]), "<u4").tobytes()
                continue
            step = max(CELLS // size, FEW)
            for at in range(0, len(own), step):
                some = own[at:at + step]
                place = np.arange(size + 1)
                there = place < lengths[some, None]
                source = np.minimum((ends - lengths)[some, None] + place, len(data) - 1)
                ids = self.many(np.where(there, data[source].astype(np.int64), -1))
                kept = ids >= 0
                flat = ids[kept].astype("<u4").tobytes()
                stops = [0, *(4 * np.cumsum(kept.sum(axis=1))).tolist()]
                for w, (a, b) in zip(some.tolist(), pairwise(stops)):
                    out[w] = flat[a:b]
        return out


class Tokenizer:
    """A byte-level BPE tokenizer file: ids of texts and texts of ids.

    With ``special`` the file's special tokens are found inside texts, as its library does by default."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec.get("added_tokens") or []
        if (model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer")
                or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
            raise ValueError("only plain byte-level BPE files are read")
        vocab, signs = model["vocab"], byte_signs()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        by_byte = {b: vocab[c] for c, b in signs.items()}
        self.merges = Merges([by_byte[b] for b in range(256)], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.tokens: dict[int, bytes] = {i: bytes(signs[c] for c in t) for t, i in vocab.items()}
        self.tokens.update({t["id"]: t["content"].encode() for t in added})
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added} if special else {}
        names = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.path, self.known, self.usual = path, dict(self.special), set()
        self._library = None

    def _words(self, text: str) -> list[str]:
        """Words of a text; if Python's tables do not know a character of it, on which libraries may disagree,
        the library's own splitter finds them."""
        if not text.isascii():
            fresh = set(text) - self.usual
            if fresh:
                odd = {c for c in fresh if unicodedata.category(c) == "Cn"}
                self.usual |= fresh - odd
                if odd:
                    return self._library_words(text)
        return WORDS.findall(text)

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Library

            self._library = Library.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _parts(self, text: str):
        """Words of a text in lists of bounded length; a special token is a list of its own."""
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                yield [part]
                continue
            start = 0
            while start < len(part):
                cut = _CUT.search(part, start + PIECE) if len(part) - start > PIECE else None
                end = cut.start() if cut else len(part)
                yield self._words(part[start:end] if cut or start else part)
                start = end

    def _learn(self, words: set[str]):
        if len(self.known) > STORE:
            self.known = dict(self.special)
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.merges.words([w.encode() for w in new])))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        out = []
        for words in self._parts(text):
            self._learn(set(words))
            out.append(b"".join(map(self.known.__getitem__, words)))
        return np.frombuffer(b"".join(out), "<u4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the new words of all short ones merged side by side."""
        parts = [list(self._parts(t)) if len(t) <= PIECE else None for t in texts]
        self._learn(set().union(*[words for own in parts if own for words in own]))
        get = self.known.__getitem__
        short = [None if own is None else np.frombuffer(b"".join([b"".join(map(get, words)) for words in own]), "<u4") for own in parts]
        return [self.encode(t) if ids is None else ids for t, ids in zip(texts, short)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; ids that are no token are left out, bytes that are no text become U+FFFD."""
        get = self.tokens.get
        return b"".join([get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str, special: bool = True) -> Tokenizer:
    return Tokenizer(path, special)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text, without tokens added around it.

    A null text is an empty one and has an empty array. Null and repeated keys are kept, other columns are not,
    whatever their names. An empty table gives an empty one. Texts of any length are split into words about
    ``PIECE`` characters at a time. ``path`` is a tokenizer file that every executor can read."""

    def run(batches):
        own = tokenizer(path, special)
        for block in text_blocks(batches, "text"):
            texts = texts_of(block).to_pylist()
            ids = own.encode_all(texts)
            offsets = np.cumsum([0, *map(len, ids)])
            if offsets[-1] >= 1 << 31:
                raise ValueError("a text of over two thousand million tokens")
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.ListArray.from_arrays(offsets.astype(np.int32), flat)],
                                             names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns and ``out``, the text of each row's ids (a null array: the empty text); the other way round from
    ``encode``. A column that has the name ``out`` already is replaced."""
    kept = encoded.drop(out)
    at = kept.columns.index(ids)

    def run(batches):
        own = tokenizer(path, True)
        for batch in batches:
            lists = batch.column(at)
            flat = np.asarray(lists.values.fill_null(-1))
            offsets = lists.offsets.to_numpy()
            texts = [own.decode(flat[a:b]) if ok else ""
                     for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out, StringType())]))
