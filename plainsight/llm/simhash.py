"""SimHash near-duplicates, found with hierarchical indexes over fingerprints in Gray order.

Fingerprints that differ in at most ``BITS`` bits agree on one of three parts of the 64 bits. Each
fingerprint therefore goes to three groups, one per part. Within a group the fingerprints are sorted by
Gray rank, so that neighbours share many bits; the bits shared by a run of them (mask and pattern) move
up into a node, those shared by a run of nodes into the next level. A search goes down from the root,
adds up the differences on the masked bits and leaves a node with everything below it as soon as the
sum exceeds the limit. Groups with very many fingerprints are parted again by the bits that are still
free: after three levels at most 2**21 different fingerprints can meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import join_hot, row_parts, save, small_components, text_blocks, texts_of
from plainsight.llm.components import components

BITS = 2
SHINGLE = 3
SEED = 42
FANOUT = 8
#: A group with more fingerprints is parted by further bits.
GROUP = 20_000


def fingerprint(text: str) -> int:
    """Majority bits over the XXH64 of all shingles; no words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[s:e], SEED)
                            for s, e in zip(starts[:1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        block = rows[at:at + (1 << 14)]
        # up to 255 rows of bits add up in bytes before they are widened
        bits = np.unpackbits(block, axis=1)
        full = len(bits) // 255 * 255
        if full:
            ones += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes that are sorted by (group, Gray rank); one root for each group.

    Of each level: mask (bits that all codes below share and that no node above holds), pattern (their
    values), and the range of children one level below; level 0 are the codes."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes = codes
        full = ~np.uint64(0)
        mask, pattern = np.full(len(codes), full), codes
        own, size = group, np.ones(len(codes), np.int64)
        self.levels = []
        while True:
            starts_of_group = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            counts = np.diff(np.append(starts_of_group, len(own)))
            place = np.arange(len(own)) - np.repeat(starts_of_group, counts)
            first = np.flatnonzero(place % FANOUT == 0)
            lead = np.repeat(first, np.diff(np.append(first, len(own))))
            differ = np.bitwise_or.reduceat((pattern ^ pattern[lead]) | ~mask, first)
            size = np.add.reduceat(size, first)
            shared = ~differ
            above = np.repeat(shared, np.diff(np.append(first, len(own))))
            self.levels.append((mask & ~above, pattern, first, np.append(first[1:], len(own))))
            mask, pattern, own = shared, pattern[first] & shared, own[first]
            if len(np.unique(own)) == len(own):
                break
        self.roots = own
        self.last = np.cumsum(size) - 1

    def neighbours(self, most: int, block: int = 4096):
        """Pairs (i, j), i < j, of the same group with at most ``most`` differing bits, block by block."""
        root_of = np.repeat(np.arange(len(self.roots)), np.diff(np.append(-1, self.last)))
        for at in range(0, len(self.codes), block):
            query = np.arange(at, min(at + block, len(self.codes)))
            node, sums = root_of[query], np.zeros(len(query), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern, begin, end = self.levels[depth]
                width = end[node] - begin[node]
                child = np.repeat(begin[node] - np.cumsum(width) + width, width) + np.arange(width.sum())
                query, sums = np.repeat(query, width), np.repeat(sums, width)
                sums = sums + np.bitwise_count((self.codes[query] ^ pattern[child]) & mask[child])
                keep = sums <= most
                if depth == 0:
                    keep &= child > query
                query, node, sums = query[keep], child[keep], sums[keep]
            yield query, node


def _links(batches):
    """(a, b) ties of a spanning forest of each group's links; whole groups are in one partition."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.concat_tables(tables).combine_chunks()
    path = table.column("path").to_numpy()
    bits = table.column("bits").to_numpy().view(np.uint64)
    codes = table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(codes), bits, path))
    path, bits, codes = path[order], bits[order], codes[order]
    new = np.concatenate(([True], (path[1:] != path[:-1]) | (bits[1:] != bits[:-1])))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    codes, group = codes[many], group[many]
    if not len(codes):
        return
    label = np.arange(len(codes))
    for i, j in GrayIndex(codes, group).neighbours(BITS):
        if len(i):
            label = small_components(len(codes), np.concatenate((np.arange(len(codes)), i)),
                                     np.concatenate((label, j)))
    tied = label != np.arange(len(codes))
    yield pa.RecordBatch.from_arrays([pa.array(codes[tied].view(np.int64)), pa.array(codes[label[tied]].view(np.int64))],
                                     names=["a", "b"])


def _parts(mask: int) -> list[int]:
    """The bits of ``mask`` in three parts of about equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [len(bits) * k // 3 for k in range(4)]
    return [sum(1 << i for i in bits[cut[k]:cut[k + 1]]) for k in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_edges(codes: DataFrame, rows: int) -> DataFrame:
    """Edges between different fingerprints (column ``fp``, distinct) whose components are those of all links."""
    masks = _parts((1 << 64) - 1)
    cur = codes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for k, m in enumerate(masks)])).alias("g")).select("fp", "g.path", "g.bits")
    found = None
    for depth in range(3):
        ready = cur
        if depth < 2:
            sizes = save(cur.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP), "hot-groups")
            if not sizes.isEmpty():
                ready = cur.join(sizes, ["path", "bits"], "left_anti")
                inner = [_parts(((1 << 64) - 1) ^ m) for m in masks]
                split = F.array(*[F.array(*[
                    F.struct(F.lit(3 * k + j).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m | s))).alias("bits"))
                    for j, s in enumerate(subs)]) for k, (m, subs) in enumerate(zip(masks, inner))])
                hot = join_hot(cur, sizes, ["path", "bits"], 3 * rows, "n")
                cur = (hot.select("fp", F.explode(F.element_at(split, F.col("path") + 1)).alias("g"))
                       .select("fp", "g.path", "g.bits"))
                masks = [m | s for m, subs in zip(masks, inner) for s in subs]
                more = True
            else:
                more = False
        else:
            more = False
        edges = (ready.repartition(row_parts(codes, 3 * rows, 1_000_000), "path", "bits")
                 .mapInArrow(_links, "a long, b long"))
        found = edges if found is None else found.unionByName(edges)
        if not more:
            return found
    return found


def _fingerprints(batches):
    for block in text_blocks(batches):
        codes = np.array([fingerprint(t) for t in texts_of(block).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(codes)], names=["doc_id", "fp"])


def _hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, fingerprint, component_id.

    Texts are used whole. A null or wordless text has fingerprint zero and is linked like any other. Equal
    fingerprints are one node, whatever the number of their rows. component_id is the smallest doc_id in
    reach; null ids are kept as rows and name no component. Repeated rows give repeated rows; an empty
    table gives an empty one; further columns are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = save(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "fingerprints")
    nodes = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    tied = components(link_edges(nodes.select("fp"), nodes.count()))
    named = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    sized = save(join_hot(named.select("fp", "n", "component"), least, ["component"], nodes.count(), "k")
                 .select("fp", "n", "component_id"), "named")
    return join_hot(marked, sized, ["fp"], marked.count(), "n").select(
        "doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group stays, with all columns.

    Rows without an id stay. Of rows that repeat an id the copies of a kept id all stay."""
    found = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti")
