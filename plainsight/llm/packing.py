"""Packing of token sequences with a bounded number of open windows.

Each partition keeps ``OPEN`` windows. A piece goes to the window it fits best; if it fits none, the fullest
window is topped up with its beginning (if that is no crumb) and emitted, and the rest is placed in turn. The
windows still open at the end of the partitions travel with their ids; groups of them are packed once more in
the same way, and what then remains is run together into full windows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import save, text_blocks, texts_of

LENGTH = 1024
OPEN = 32
#: No cut leaves fewer ids than this on either side while windows are being filled.
CRUMB = 16
#: Partitions whose open windows are merged together.
MERGED = 64
#: Words whose ids are kept; beyond that the store starts anew.
STORE = 600_000
_END = (0).to_bytes(4, "little")
#: A blank before other white space is part of a run, which no cut may part.
_RUN = re.compile(r" \s")


class Encoder:
    """Ids of texts as little-endian bytes, four a token, equal to those of the tokenizer on the whole text.

    The tokenizer's pattern starts a new token at every blank that a non-blank follows, so that texts can be
    cut there and each different word behind a blank is encoded once. New words are encoded many at a time: a
    token that begins with a blank begins a word. Texts with white space behind a blank are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")  # the byte-level sign of a blank

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]):
        """Ids of each word behind a blank."""
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(self.begins[ids])[1:], len(ids)) * 4
            data, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.known[word] = data[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > STORE:
            self.known = {}
        cut = [None if _RUN.search(t) else t.split(" ") for t in texts]
        firsts = [None if words is None else words.pop(0) for words in cut]
        new = set().union(*[words for words in cut if words]) - self.known.keys()
        if "" in new:  # a blank at the end of a text
            new.remove("")
            self.known[""] = self._whole(" ")
        self._learn(list(new))
        get = self.known.__getitem__
        return [self._whole(text) if words is None else self._whole(first) + b"".join(map(get, words))
                for text, first, words in zip(texts, firsts, cut)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """Open windows of pieces (document, start, ids, document's ids in all)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[tuple[int, list]] = []  # (filled, pieces)

    def add(self, doc, start: int, ids: bytes, total: int):
        """Place a piece; yields the windows that this closes."""
        n = len(ids) // 4
        while n:
            if n >= self.length:
                yield [(doc, start, ids[:4 * self.length], total)]
                start, ids, n = start + self.length, ids[4 * self.length:], n - self.length
                continue
            fits = [(self.length - filled - n, i) for i, (filled, _) in enumerate(self.open) if self.length - filled >= n]
            if fits:
                _, i = min(fits)
                filled, pieces = self.open[i]
                pieces.append((doc, start, ids, total))
                self.open[i] = (filled + n, pieces)
                if filled + n == self.length:
                    yield self.open.pop(i)[1]
                return
            if len(self.open) < self.most:
                self.open.append((n, [(doc, start, ids, total)]))
                return
            i = max(range(len(self.open)), key=lambda j: self.open[j][0])
            filled, pieces = self.open.pop(i)
            gap = self.length - filled
            if gap >= CRUMB and n - gap >= CRUMB:
                pieces.append((doc, start, ids[:4 * gap], total))
                start, ids, n = start + gap, ids[4 * gap:], n - gap
            yield pieces

    def run_together(self):
        """Everything still open in full windows and a last one, pieces cut where a window is full."""
        pieces, filled = [], 0
        for _, own in sorted(self.open, key=lambda x: -x[0]):
            for doc, start, ids, total in own:
                while ids:
                    take = min(self.length - filled, len(ids) // 4)
                    pieces.append((doc, start, ids[:4 * take], total))
                    start, ids, filled = start + take, ids[4 * take:], filled + take
                    if filled == self.length:
                        yield pieces
                        pieces, filled = [], 0
        if pieces:
            yield pieces
        self.open = []


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _rows(windows: list[tuple[int, list]], kind: pa.DataType, keep_ids: bool) -> pa.RecordBatch:
    rows = []
    for number, pieces in windows:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, number, offset, ids if keep_ids else None))
            offset += n
    cols = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]],
                                       pa.array(cols[7], pa.binary())], names=_NAMES)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless kept).

    A document is the ids of its whole text (null: empty) and then id 0, so that every row gives at least one
    piece; each id is in exactly one. Sequences hold at most ``length`` ids and are padded to that, except one
    that ends at a power of two. Null and repeated ids are kept: every row is a document of its own. An empty
    table gives an empty one. ``tokenizer`` is the path of a tokenizer file that every executor can read."""
    field = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {field}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, ids binary")

    def fill(batches):
        enc, windows = encoder(tokenizer), Windows(length, OPEN)
        part, done, kind = TaskContext.get().partitionId(), 0, None
        for block in text_blocks(batches):
            ids = block.column("doc_id")
            kind = ids.type
            closed = []
            for doc, data in zip(ids.to_pylist(), enc.encode(texts_of(block).to_pylist())):
                data += _END
                for pieces in windows.add(doc, 0, data, len(data) // 4):
                    closed.append((part << 33 | done, pieces))
                    done += 1
            if closed:
                yield _rows(closed, kind, keep_ids)
        if windows.open:
            # a negative number marks a window that is still open
            yield _rows([(-1 - (part << 33 | i), pieces) for i, (_, pieces) in enumerate(windows.open)], kind, True)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("sequence_id", "descending"), ("offset", "ascending")]).to_pylist()
        group, windows, closed = rows[0]["part"], Windows(length, OPEN), []
        for r in sorted(rows, key=lambda r: -r["length"]):
            closed += windows.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        closed += windows.run_together()
        out = _rows([((group << 33 | 1 << 32 | i), pieces) for i, pieces in enumerate(closed)],
                    table.column("doc_id").type, keep_ids)
        return pa.Table.from_batches([out])

    first = save(docs.select("doc_id", "text").mapInArrow(fill, schema), "packed")
    part = F.shiftright(-1 - F.col("sequence_id"), 33)
    left = (first.filter("sequence_id < 0").withColumn("part", part - part % MERGED)
            .groupBy("part").applyInArrow(merge, schema))
    return first.filter("sequence_id >= 0").unionByName(left)
