"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines are compared by the set of their 8-character shingles; two lines are alike from a Jaccard
similarity of 0.8. A signature has 40 places, cut into 10 bands of 4: a pair at exactly 0.8 is found with
a probability of 99.5 %, one at 0.9 with over 99.99 %. In lines of up to ``FEW`` different shingles each place
is the minimum of a hash of its own over all shingles. Longer lines have 40 bins (one-permutation MinHash: a
shingle's hash names a bin and a rank in it, an empty bin borrows from the next one), which needs some 100
shingles to be as good. Lines within the similarity of ``FEW`` have both. Every candidate is checked exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import join_hot, row_parts, save, small_components, text_blocks, texts_of
from plainsight.llm.components import components

WIDTH = 8
BINS = 40
ROWS = 4
SIMILARITY = 0.8
#: Different shingles up to which a line has 40 hashes a shingle. Lines from 0.8 of that on have bins.
FEW = 120
#: Lines of fewer words, of at most so many characters and of fewer letters of scripts without blanks are no
#: boilerplate and are left alone.
MIN_WORDS = 5
MOST_CHARS = 40
MIN_LETTERS = 10
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_NO_BLANKS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Lines of a bucket that one task compares; a larger bucket is dealt into shares, two of which meet in a task.
WHOLE = 20_000
#: Buckets up to this size are compared pair by pair, larger ones as matrices.
SMALL = 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, and the index of each one's line; a short line is one shingle."""
    sizes = np.array([max(len(x), WIDTH) for x in lines], np.int64)
    codes = np.frombuffer("".join([x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in lines])
                          .encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    two = codes[:-1] * odd + codes[1:]
    four = _mix(two[:-2]) * odd + two[2:]
    eight = _mix(four[:-4] * odd + _mix(four[4:]))
    counts = sizes - WIDTH + 1
    owner = np.repeat(np.arange(len(lines)), counts)
    first = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return eight[at], owner


def band_keys(lines: list[str], room: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all lines' bands, line by line, and their number by line; lines go in groups of about ``room``
    characters, whose arrays stay in the cache."""
    keys, counts, start, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= room or i == len(lines) - 1:
            for out, x in zip((keys, counts), _bands(lines[start:i + 1])):
                out.append(x)
            start, size = i + 1, 0
    return np.concatenate(keys), np.concatenate(counts)


def _bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = shingle_hashes(lines)
    # each shingle once: alike lines differ by a fifth at most in the number of different ones
    own = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    own = own[np.concatenate(([True], own[1:] != own[:-1]))]
    sizes = np.bincount((own >> np.uint64(48)).astype(np.int64), minlength=len(lines))
    few, many = sizes <= FEW, sizes * 5 >= FEW * 4
    bands = BINS // ROWS
    keys = np.zeros((len(lines), 2 * bands), np.uint64)
    if few.any():
        keys[few, :bands] = _keys(_minima(own[np.repeat(few, sizes)], sizes[few]), 1)
    if many.any():
        mine = many[owner]
        keys[many, bands:] = _keys(_bins(hashes[mine], (np.cumsum(many) - 1)[owner[mine]], int(many.sum())), bands + 1)
    there = np.repeat(np.stack([few, many], axis=1), bands, axis=1)
    return keys[there], there.sum(axis=1)


def _minima(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Smallest value of each of BINS hashes over the shingles of each line."""
    own = _mix(own << np.uint64(16))
    low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    factors = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sizes), BINS), np.uint64)
    for i in range(BINS):
        out[:, i] = np.minimum.reduceat(low * factors[i] + high * factors[BINS + i], first)
    return out


def _bins(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Smallest rank in each of BINS bins; an empty bin borrows from the next one."""
    least = np.full(n * BINS, _EMPTY)
    slot = owner * BINS + ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, slot, hashes & np.uint64(0xFFFFFFFF))
    least = least.reshape(n, BINS)
    step = 1
    while (empty := least == _EMPTY).any():
        lent = np.roll(least, -1, axis=1)
        least = np.where(empty & (lent != _EMPTY), lent + np.uint64(step << 33), least)
        step += 1
    return least


def _keys(least: np.ndarray, first: int) -> np.ndarray:
    bands = np.zeros((len(least), BINS // ROWS), np.uint64)
    # the bins of a band lie far apart: neighbours often borrow the same rank
    for r in range(ROWS):
        own = least[:, r * (BINS // ROWS):(r + 1) * (BINS // ROWS)]
        bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(r + 1))
    return _mix(bands + np.arange(first, first + BINS // ROWS, dtype=np.uint64))


def jaccard_at_least(left: list[str], right: list[str], block: int = 256) -> np.ndarray:
    """Whether the exact similarity of each pair of lines is SIMILARITY or more.

    A shingle is one number: the pair in the top 8 bits, 56 bits of its hash below."""
    out = [np.empty(0, bool)]
    for at in range(0, len(left), block):
        n, sets = min(block, len(left) - at), []
        for lines in (left, right):
            hashes, owner = shingle_hashes(lines[at:at + block])
            own = np.sort((owner.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8)))
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        own = np.sort(np.concatenate(sets))
        both = np.bincount((own[1:][own[1:] == own[:-1]] >> np.uint64(56)).astype(np.int64), minlength=n)
        total = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=n) - both
        # whole numbers: 5 * both >= 4 * total is exactly 0.8
        out.append(both * 5 >= total * 4)
    return np.concatenate(out)


def text_key(text: str) -> int:
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64).item()


def compared(line: str) -> bool:
    """Whether a line is long enough to be compared: by words, characters, or letters of scripts without blanks."""
    if len(line) < 2 * MIN_WORDS - 1:
        return False
    # a run of white space is no text
    return (len(line) > MOST_CHARS and not line.isspace() or len(line.encode().split()) >= MIN_WORDS
            or not line.isascii() and len(_NO_BLANKS.findall(line)) >= MIN_LETTERS)


def _occurrences(kind: str):
    """Rows (doc_id, text_key, line_no, lid, bands) of the lines that are long enough."""
    def rows(batches):
        digest = xxhash.xxh64_intdigest
        for block in text_blocks(batches):
            texts = texts_of(block).to_pylist()
            doc, number, lines, keys = [], [], [], []
            for d, text in enumerate(texts):
                keys.append(digest(text.encode(), 42))
                for i, line in enumerate(text.split("\n")):
                    if compared(line):
                        doc.append(d)
                        number.append(i)
                        lines.append(line)
            if not lines:
                continue
            lids = [digest(x.encode(), 7) for x in lines]
            once = {}
            for lid, line in zip(lids, lines):
                once.setdefault(lid, line)
            place = {lid: i for i, lid in enumerate(once)}
            bands, counts = band_keys(list(once.values()))
            doc = np.array(doc)
            # the first line of the block among equal ones carries the bands
            first = np.zeros(len(lids), bool)
            first[np.unique([place[x] for x in lids], return_index=True)[1]] = True
            own = np.zeros(len(lids), np.int64)
            own[first] = counts
            ends = np.concatenate(([0], np.cumsum(own))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id").take(pa.array(doc)),
                pa.array(np.array(keys, np.uint64).view(np.int64)[doc]),
                pa.array(np.array(number, np.int32)),
                pa.array(np.array(lids, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.view(np.int64)))],
                names=["doc_id", "text_key", "line_no", "lid", "bands"])
    return rows, f"doc_id {kind}, text_key long, line_no int, lid long, bands array<long>"


def _buckets(batches):
    """Rows come sorted by (key, lid); leaves each line once per bucket, in buckets with two lines or more."""
    last = ahead = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, lids = batch.column("key").to_numpy(), batch.column("lid").to_numpy()
        if ahead is not None:
            keys, lids = np.append(ahead[0], keys), np.append(ahead[1], lids)
        once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (lids[1:] != lids[:-1])))
        keys, lids = keys[once], lids[once]
        # the last row waits for its successor
        same = keys[1:] == keys[:-1]
        before = np.concatenate(([last is not None and last == keys[0]], same[:-1])) if len(keys) > 1 else np.empty(0, bool)
        keep = before | same
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][keep]), pa.array(lids[:-1][keep])], names=["key", "lid"])
        if len(keys) > 1:
            last = keys[-2]
        ahead = keys[-1:], lids[-1:]
    if ahead is not None and last is not None and last == ahead[0][0]:
        yield pa.RecordBatch.from_arrays([pa.array(ahead[0]), pa.array(ahead[1])], names=["key", "lid"])


def bucket_links(lines: list[str], block: int = 64, chunk: int = 512) -> np.ndarray:
    """Smallest index of each line's component under all links between the lines.

    Shingles that two lines share are counted as a product of 0/1 matrices over the shingles of one block; blocks
    whose lines are already in one component with all later ones are passed over."""
    n = len(lines)
    hashes, owner = shingle_hashes(lines)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
    hashes, owner = hashes[new], owner[new]
    size = np.bincount(owner, minlength=n).astype(np.float32)
    ends = np.searchsorted(owner, np.arange(n + 1))
    label = np.arange(n)
    for s in range(0, n, block):
        e = min(s + block, n)
        if (label[s:] == label[s]).all():
            break
        own = hashes[ends[s]:ends[e]]
        kinds = np.unique(own)
        left = np.zeros((e - s, len(kinds)), np.float32)
        left[owner[ends[s]:ends[e]] - s, np.searchsorted(kinds, own)] = 1
        for t in range(s, n, chunk):
            u = min(t + chunk, n)
            if (label[t:u] == label[s]).all() and (label[s:e] == label[s]).all():
                continue
            other = hashes[ends[t]:ends[u]]
            at = np.minimum(np.searchsorted(kinds, other), len(kinds) - 1)
            there = kinds[at] == other
            right = np.zeros((u - t, len(kinds)), np.float32)
            right[owner[ends[t]:ends[u]][there] - t, at[there]] = 1
            both = left @ right.T
            # whole numbers, exact in single precision
            i, j = np.nonzero(both * 5 >= (size[s:e, None] + size[None, t:u] - both) * 4)
            label = small_components(n, np.concatenate((np.arange(n), i + s)), np.concatenate((label, j + t)))
    return label


def _compare(batches):
    """Rows (key, i, j, lid, line) come sorted by the first three; yields (a, b), a spanning star of each
    component of alike lines of a bucket."""
    pairs: list[tuple[int, int, str, str]] = []
    edges: list[tuple[int, int]] = []
    key, lids, lines = None, [], []

    def verified():
        good = jaccard_at_least([p[2] for p in pairs], [p[3] for p in pairs])
        edges.extend((p[0], p[1]) for p, ok in zip(pairs, good) if ok)
        pairs.clear()

    def close():
        if len(lids) > SMALL:
            label = bucket_links(lines)
            edges.extend((lids[i], lids[r]) for i, r in enumerate(label.tolist()) if i != r)
        else:
            pairs.extend((lids[i], lids[j], lines[i], lines[j]) for i in range(len(lids)) for j in range(i))

    for batch in batches:
        for k, i, j, lid, line in zip(*[c.to_pylist() for c in batch.columns]):
            if (k, i, j) != key:
                close()
                key, lids, lines = (k, i, j), [], []
                if len(pairs) >= 500:
                    verified()
            lids.append(lid)
            lines.append(line)
        if len(edges) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])
            edges.clear()
    close()
    if pairs:
        verified()
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])


def _bitmap(df: DataFrame, column: str, bits: int = 22) -> bytes:
    """Bits that the values' hashes set: 2**bits at most, whatever the number of rows."""
    slots = df.select((F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))).cast("int").alias("s")).distinct()
    held = np.zeros(1 << bits, np.uint8)
    held[slots.toArrow().column("s").to_numpy()] = 1
    return np.packbits(held).tobytes()


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, line) of the wanted lines. A bitmap of fixed size keeps most of the others out of the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "lid"))

    def rows(batches):
        held = np.unpackbits(np.frombuffer(shared.value, np.uint8))
        top = len(held) - 1
        digest = xxhash.xxh64_intdigest
        for block in text_blocks(batches):
            once = {}
            for text in texts_of(block).to_pylist():
                for line in text.split("\n"):
                    if len(line) >= 2 * MIN_WORDS - 1:
                        lid = digest(line.encode(), 7)
                        # Spark's xxhash64 of a long is XXH64 of its eight bytes
                        if lid not in once and held[digest(lid.to_bytes(8, "little"), 42) & top]:
                            once[lid] = line
            if once:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(once), np.uint64).view(np.int64)),
                                                  pa.array(list(once.values()))], names=["lid", "line"])

    lines = docs.select("text").mapInArrow(rows, "lid long, line string")
    return (lines.join(wanted, "lid", "left_semi").groupBy("lid").agg(F.first("line").alias("line")))


def _shares(found: DataFrame) -> DataFrame:
    """(key, i, j, lid): the task group or groups in which a line of a bucket is compared.

    A bucket of up to ``WHOLE`` lines is one group. A larger one has shares of half that size, and a group for
    each two of them: every pair of lines meets in one, and no task holds more."""
    large = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE)
    large = save(large.select("key", F.ceil(F.col("n") / (WHOLE // 2)).cast("int").alias("shares")), "large-buckets")
    one = lambda df: df.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "lid")
    if large.isEmpty():
        return one(found)
    dealt = found.join(large, "key").withColumn("own", F.pmod(F.xxhash64("lid"), F.col("shares")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return one(found.join(large, "key", "left_anti")).unionByName(dealt.filter("own <> with").select(
        "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "lid"))


def line_groups(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(node, component) of the lines that are alike but not equal to another line.

    All pairs of lines that meet in a bucket are compared by their exact shingle sets, within tasks of bounded
    size; only ties that change a component leave a task."""
    parts = row_parts(occurrences, occurrences.count() * (BINS // ROWS), 1_500_000)
    rows = occurrences.select(F.explode("bands").alias("key"), "lid")
    found = save(rows.repartition(parts, "key").sortWithinPartitions("key", "lid")
                 .mapInArrow(_buckets, "key long, lid long"), "buckets")
    wanted = save(found.select("lid").distinct(), "wanted-lines")
    texts = save(_line_texts(docs, wanted), "line-texts")
    grouped = _shares(found).join(texts, "lid").select("key", "i", "j", "lid", "line")
    links = (grouped.repartition(row_parts(found, found.count(), 100_000), "key", "i", "j").sortWithinPartitions("key", "i", "j")
             .mapInArrow(_compare, "a long, b long"))
    return components(links)


def _named(rows: DataFrame, column: str, groups: DataFrame, out: str) -> DataFrame:
    """``rows`` with the component of a line; a line without a link is its own."""
    joined = rows.join(groups.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left")
    return joined.withColumn(out, F.coalesce(out, column))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, drop): the numbers of the lines that repeat an earlier line, by document.

    Order is doc_id (nulls last), then text_key, then line number. The first line of a component stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    make, schema = _occurrences(kind)
    found = save(docs.select("doc_id", "text").mapInArrow(make, schema), "lines")
    groups = line_groups(docs, found)
    lines = found.select("doc_id", "text_key", "line_no", "lid")
    counts = lines.groupBy("lid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(
        F.col("doc_id").isNull().alias("z"), "doc_id", "text_key", "line_no")).alias("first"))
    counts = save(_named(counts, "lid", groups, "component"), "line-counts")
    best = counts.groupBy("component").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("k"),
                                           F.sum("n").alias("total")).filter("total > 1")
    named = save(join_hot(counts.select("lid", "n", "component"), best, ["component"], counts.count(), "k")
                 .select("lid", "n", "best"), "line-groups")
    gone = join_hot(lines, named, ["lid"], found.count(), "n").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
          & (F.col("line_no") == F.col("best.line_no"))))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one line per component left in all texts together; all columns and rows stay.

    n_chars, if there, is counted anew. Lines stay that have fewer than five words, at most 40 characters and
    fewer than ten letters of scripts without blanks. Rows with equal id and text are
    one document: their lines count once and each copy loses the same lines. Null texts stay null; texts that
    lose all lines become empty; an empty table gives an empty one. Works on whole texts of any length."""
    drops = dropped_lines(docs).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("drop").alias("_drop"))
    # the rows travel in one column, so that no name of theirs can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_key"))
    joined = keyed.join(drops.hint("shuffle_hash"),
                        keyed["_row.doc_id"].eqNullSafe(drops["_d"]) & (keyed["_key"] == drops["_k"]), "left")
    text = F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(F.array_join(F.filter(
        F.split("_row.text", "\n", -1), lambda x, i: ~F.array_contains("_drop", i)), "\n"))
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_drop").isNull(), F.col("_row.n_chars")).otherwise(
            F.length(text).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return joined.select(*[new.get(c, F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])
