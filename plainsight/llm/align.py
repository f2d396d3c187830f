"""Alignment of two tokenizers over the same texts: links between tokens that share bytes, and joint cuts.

Both tokenizers of this module begin a token at a blank between two characters that are no white space, so that a
long text is cut there into several lanes. The lanes of a block are merged in lockstep: one NumPy state holds the A
and B pointers of all of them; every step emits each lane's link and, where both tokens end together, its cut, and
advances what ended first. Finished lanes leave the state.

Each block keeps its different id pairs; only those travel to be counted over the corpus, one row a block and pair,
and come back to the block that holds the links.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.bpe import tokenizer
from plainsight.llm.common import join_hot, save, text_blocks, texts_of

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 2 << 20
#: Characters after which a lane ends at the next blank where both tokenizers begin a token.
LANE = 400
#: Words whose pieces are kept; beyond that the store starts anew.
STORE = 200_000
_UNIT = re.compile(r" +[^ ]+| +\Z")
_JOINT = re.compile(r"(?<=\S) (?=\S)")
_PIECES = 1 << 16  # ids of B are below


class Pieces:
    """Ids of a SentencePiece model, word by word; no piece of it may hold a blank behind another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = self.model.id_to_piece(list(range(size)))
        if size > _PIECES or any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("pieces must not span words")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                      for i, n in enumerate(names)]
        # a last blank alone: the model gives nothing for an empty text
        self.blank = {" ": array("I", [names.index("▁")]).tobytes()}
        self.known, self.lossy = dict(self.blank), set()

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text, and the texts with a word whose pieces do not give its bytes.

        Each text begins with a blank, which the model puts there."""
        units = [_UNIT.findall(t) for t in texts]
        if len(self.known) > STORE:
            self.known, self.lossy = dict(self.blank), set()
        new = [u for u in set().union(*units) if u not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            ids, piece = self.model.encode([u[1:] for u in some], num_threads=1), self.bytes.__getitem__
            self.known.update(zip(some, [array("I", x).tobytes() for x in ids]))
            self.lossy.update(u for u, x in zip(some, ids) if b"".join(map(piece, x)) != u.encode())
        get = self.known.__getitem__
        lossy = [i for i, own in enumerate(units) if not self.lossy.isdisjoint(own)] if self.lossy else []
        return [np.frombuffer(b"".join(map(get, own)), "<u4") for own in units], lossy


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Sides:
    """Both tokenizers, with the length and the bytes of every token."""

    def __init__(self, a: str, b: str):
        self.a, self.b = tokenizer(a, special=False), pieces(b)
        size = max(self.a.tokens) + 1
        self.bytes = [[self.a.tokens.get(i, b"") for i in range(size)], self.b.bytes]
        self.lengths = [np.array([len(t) for t in own]) for own in self.bytes]
        self.digits = Digits(max(size, len(self.b.bytes)))

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text behind a blank; none for a text whose tokens do not give its bytes."""
        whole = [" " + t if t else "" for t in texts]
        a, (b, lossy) = self.a.encode_all(whole), self.b.encode_all(whole)
        # byte-level tokens always give the bytes of the text
        for i in lossy:
            if b"".join(map(self.bytes[1].__getitem__, b[i].tolist())) != whole[i].encode():
                a[i] = b[i] = np.zeros(0, "<u4")
        return a, b


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


class Digits:
    """Decimal ids with a sign behind each, as one run of bytes."""

    def __init__(self, size: int):
        self.width = len(str(size)) + 1
        text = [str(i) for i in range(size)]
        self.count = np.array([len(t) for t in text])
        self.table = np.frombuffer("".join(t.ljust(self.width) for t in text).encode(), np.uint8).reshape(size, -1)

    def join(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each id begins in them (and the end)."""
        n = self.count[ids]
        cells = self.table[ids]
        cells[np.arange(len(ids)), n] = signs
        return cells[np.arange(self.width) <= n[:, None]], np.append(0, np.cumsum(n + 1))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
             last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (positions in A and B) and cuts (positions of the last A and B token of a group) of all lanes.

    ``ends_a`` and ``ends_b`` are byte offsets behind each token; lane i holds the tokens from ``first`` up to and
    without ``last``, which cover the same bytes on both sides."""
    full = first_a < last_a
    i, j, stop = first_a[full], first_b[full], last_a[full]
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        a, b = ends_a[i], ends_b[j]
        both = a == b
        cuts.append((i[both], j[both]))
        i, j = i + (a <= b), j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not links:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(own) for both in (links, cuts) for own in zip(*both))


def _lanes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the lanes of each text (behind its blank) end, and the text of each lane."""
    ends, owner = [], []
    for t, text in enumerate(texts):
        at, done, size = LANE, 0, 0
        while at < len(text):
            cut = _JOINT.search(text, at)
            if not cut:
                break
            size += len(text[done:cut.start()].encode())
            done = cut.start()
            ends.append(size + 1)
            owner.append(t)
            at = done + LANE
        ends.append(size + len(text[done:].encode()) + 1)
        owner.append(t)
    return np.array(ends), np.array(owner)


class Block:
    """Links, cuts and group texts of some texts."""

    def __init__(self, own: Sides, texts: list[str]):
        tokens = own.tokens(texts)
        counts = [np.array([len(x) for x in side]) for side in tokens]
        ids = [np.concatenate(side).astype(np.int64) for side in tokens]
        texts = [t if n else "" for t, n in zip(texts, counts[0].tolist())]
        # offsets of the block: those of a text lie behind all texts before it
        ends = [np.cumsum(length[x]) for length, x in zip(own.lengths, ids)]
        sizes = np.array([len(t.encode()) + 1 if t else 0 for t in texts])
        lane_ends, lane_owner = _lanes(texts)
        full = sizes[lane_owner] > 0
        stops = np.append(0, (np.cumsum(sizes) - sizes)[lane_owner[full]] + lane_ends[full])
        bounds = [np.searchsorted(e, stops, side="right") for e in ends]
        if any(not np.array_equal(e[x[1:] - 1], stops[1:]) for e, x in zip(ends, bounds)):
            raise ValueError("a lane does not end at the end of a token")
        a, b, cut_a, cut_b = lockstep(*ends, bounds[0][:-1], bounds[1][:-1], bounds[0][1:], bounds[1][1:])
        starts = [np.append(0, np.cumsum(c)) for c in counts]
        cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
        self.n_a, self.n_b = counts
        self.owner = np.searchsorted(starts[0], a, side="right") - 1
        self.n_links = np.bincount(self.owner, minlength=len(texts))
        at = np.searchsorted(cut_a, starts[0])
        self.n_groups = np.diff(at)
        self.pairs = ids[0][a] * _PIECES + ids[1][b]
        self.hashes = self._groups(own.digits, ids, cut_a, cut_b, at)

    @staticmethod
    def _groups(digits: Digits, ids, cut_a, cut_b, at) -> list[str]:
        """Hashes of the group texts: A ids, then B ids of each group."""
        n_a, n_b = len(ids[0]), len(ids[1])
        signs = [np.full(n_a, ord(","), np.uint8), np.full(n_b, ord(","), np.uint8)]
        signs[0][cut_a], signs[1][cut_b] = ord("|"), ord(";")
        groups = np.arange(len(cut_a))
        group_a, group_b = (np.repeat(groups, np.diff(cut, prepend=-1)) for cut in (cut_a, cut_b))
        place_a = np.arange(n_a) + np.append(0, cut_b + 1)[group_a]
        place_b = np.arange(n_b) + np.append(cut_a + 1, n_a)[group_b]
        mixed, between = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8)
        mixed[place_a], mixed[place_b], between[place_a], between[place_b] = *ids, *signs
        data, begins = digits.join(mixed, between)
        tokens = np.append(0, cut_a + cut_b + 2)  # tokens before each group
        places = begins[tokens[at]].tolist()
        text = data.tobytes()
        return [hashlib.sha256(text[p:q - 1]).hexdigest() if q > p else "" for p, q in pairwise(places)]


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are all pairs of an A and a B token that overlap, groups the tokens between two offsets at which tokens of
    both sides end. The count of an id pair is the number of its links in all documents; ``count_sum`` adds it up over
    the document's links, ``n_best`` counts the links whose pair has the highest count of its B id, ties included.
    Texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty hash. Null and repeated doc_ids are documents of their own; other columns are not read; an empty table gives
    an empty one. ``a`` (byte-level BPE) and ``b`` (SentencePiece) are files that every executor can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = "n_a long, n_b long, n_groups long, n_links long"
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times", "place", "pair", "n"]

    def link(batches):
        part, done, own = TaskContext.get().partitionId(), 0, sides(a, b)
        for rows in text_blocks(batches, budget=BLOCK):
            n, block = rows.num_rows, part << 32 | done
            done += 1
            got = Block(own, texts_of(rows).to_pylist())
            pairs, place = np.unique(got.pairs, return_inverse=True)
            cells, times = np.unique(got.owner * max(len(pairs), 1) + place, return_counts=True)
            owner, place = np.divmod(cells, max(len(pairs), 1))
            total = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
            bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            columns = [pa.array(x.astype(np.int64)) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
            lists = [pa.ListArray.from_arrays(bounds, x.astype(np.int32)) for x in (place, times)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), rows.column("doc_id"), *columns, pa.array(got.hashes), *lists,
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            for at in range(0, len(pairs), 100_000):
                some = slice(at, at + 100_000)
                m = len(pairs[some])
                empty = [pa.nulls(m, t) for t in [rows.column("doc_id").type, *[pa.int64()] * 4, pa.string(), lists[0].type, lists[0].type]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), *empty, pa.array(np.arange(at, at + m, dtype=np.int32)),
                                                  pa.array(pairs[some]), pa.array(total[some])], names=names)

    def attach(own: pa.Table, counted: pa.Table) -> pa.Table:
        total, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
        place = counted.column("place").to_numpy()
        total[place] = counted.column("total").to_numpy()
        best[place] = counted.column("best").to_numpy()
        links = own.column("links").combine_chunks()
        bounds = links.offsets.to_numpy() - links.offsets[0].as_py()
        at, times = links.flatten().to_numpy(), own.column("times").combine_chunks().flatten().to_numpy()
        sums = [np.diff(np.append(0, np.cumsum(times * x[at], dtype=np.int64))[bounds]) for x in (best, total)]
        kept = [own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*kept, *map(pa.array, sums), own.column("groups_sha256")], names=[*out])

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    linked = save(docs.select("doc_id", "text").mapInArrow(
        link, f"block long, doc_id {kind}, {facts}, groups_sha256 string, links array<int>, times array<int>, place int, pair long, n long"),
        "linked")
    counts = pair_counts(linked.filter("pair IS NOT NULL"))
    blocks = linked.filter("pair IS NOT NULL").select("block", "place", "pair")
    told = join_hot(blocks, counts.select("pair", "total", "best", "blocks"), ["pair"], blocks.count(), "blocks")
    return (linked.filter("pair IS NULL").select("block", *out[:5], "groups_sha256", "links", "times").groupBy("block")
            .cogroup(told.select(F.col("block").alias("of"), "place", "total", F.col("best").cast("long").alias("best")).groupBy("of"))
            .applyInArrow(attach, f"doc_id {kind}, {facts}, n_best long, count_sum long, groups_sha256 string"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, total (its links in all blocks), blocks (that hold it), best (no pair of its B id has more)."""
    counted = save(pairs.groupBy("pair").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("blocks"))
                   .withColumn("b", F.col("pair") % _PIECES), "pair-counts")
    # one row for each id of B, which are below 65,536
    highest = counted.groupBy("b").agg(F.max("total").alias("highest"))
    return counted.join(F.broadcast(highest), "b").select("pair", "total", "blocks", (F.col("total") == F.col("highest")).alias("best"))
