"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts; a small network
learns in which parts a vector's neighbours lie. Every row is put into its most probable part. A query is
compared exactly, in double precision, with the rows of its most probable parts; a query that finds too few
there is compared with all parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plainsight.llm.common import sample_rows, save

#: Rows on which the index is fitted, parts, parts that a query visits, neighbours in the graph. Vectors without
#: clusters need three parts of four for a recall over 0.9; clustered ones need a few.
SAMPLE = 10_000
PARTS = 32
PROBES = 24
DEGREE = 10
#: Rows and queries that meet in one task.
BLOCK = 50_000
QUERIES = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by cosine."""
    unit, out = _unit(x.astype(np.float32)), []
    for at in range(0, len(unit), 128):
        near = unit[at:at + 128] @ unit.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out.append(np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:].copy())
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 8) -> np.ndarray:
    """Parts of about equal size with few edges between them.

    Halves are split at the median of a smooth vector over the graph (power iteration), level by level; then
    nodes move to the part that holds most of their neighbours as long as it has room."""
    n, k = graph.shape
    rng = np.random.default_rng(7)
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    part = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        inside = part[a] == part[b]
        u, v = a[inside], b[inside]
        degree = np.bincount(u, minlength=n) + 1
        size = np.bincount(part)
        x = rng.standard_normal(n)
        for _ in range(40):
            x = (x + np.bincount(u, weights=x[v], minlength=n)) / degree
            x -= (np.bincount(part, weights=x) / size)[part]
            x /= np.sqrt(np.bincount(part, weights=x * x) + 1e-30)[part]
        order = np.lexsort((x, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        part = 2 * part + (rank >= (size[part] + 1) // 2)
    room = math.ceil(slack * n / parts)
    size = np.bincount(part, minlength=parts)
    by_node = np.argsort(a, kind="stable")
    ends = np.searchsorted(a[by_node], np.arange(n + 1))
    near = b[by_node]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[near[ends[i]:ends[i + 1]]], minlength=parts)
            own, best = part[i], int(votes.argmax())
            if votes[best] > votes[own] and size[best] < room:
                part[i] = best
                size[own] -= 1
                size[best] += 1
                moved += 1
        if moved < n // 500:
            break
    return part


class Router:
    """One hidden layer; gives the probability of each part."""

    def __init__(self, dim: int, parts: int, hidden: int = 128):
        rng = np.random.default_rng(11)
        self.w = [rng.standard_normal((dim, hidden)) / math.sqrt(dim), np.zeros(hidden),
                  rng.standard_normal((hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return h, z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.003):
        rng = np.random.default_rng(13)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                h, p = self.forward(x[rows])
                d = (p - target[rows]) / len(rows)
                e = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[rows].T @ e, e.sum(0), h.T @ d, d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        return self


def fit_router(sample: np.ndarray) -> Router:
    """Learn parts from a sample of usable vectors; copies of a vector count once."""
    x = np.unique(sample, axis=0)
    parts = 1 << max(0, min(int(math.log2(PARTS)), int(math.log2(max(1, len(x) // 64)))))
    unit = _unit(x.astype(np.float64))
    if parts == 1:
        return Router(x.shape[1], 1, 1)
    graph = neighbour_graph(x, min(DEGREE, len(x) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    for column in graph.T:
        target[np.arange(len(x)), part[column]] += 1
    target[np.arange(len(x)), part] += 2
    return Router(x.shape[1], parts).fit(unit, target / target.sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, all components finite, not all zero."""
    as_double = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return as_double.filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))


def _best(q_id, q, v_id, v, k: int):
    """The k nearest of each query among the rows, exactly; ties go to the smaller id.

    Of equal vectors only the k + 1 smallest ids can be among the k nearest of a query."""
    order = np.argsort(v_id, kind="stable")
    v_id, v = v_id[order], v[order]
    _, same = np.unique(np.ascontiguousarray(v).view([("", v.dtype)] * v.shape[1]).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    counts = np.bincount(same)
    place = np.empty(len(v), np.int64)
    place[by] = np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts)
    v_id, v = v_id[place <= k], v[place <= k]
    length, unit = np.sqrt((v * v).sum(axis=1)), _unit(v)
    for at in range(0, len(q), 128):
        some, ids = q[at:at + 128], q_id[at:at + 128]
        near = _unit(some) @ unit.T
        near[ids[:, None] == v_id[None, :]] = -np.inf
        if near.shape[1] > k:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        else:
            least = np.full(len(some), -2.0)
        row, col = np.nonzero((near >= np.maximum(least, -2.0)[:, None] - 1e-9))
        # scores come from the same sums whatever block the two vectors met in
        score = (some[row] * v[col]).sum(axis=1) / (np.sqrt((some * some).sum(axis=1))[row] * length[col])
        order = np.lexsort((v_id[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(len(some)))
        keep = np.arange(len(row)) - first[row] < k
        yield ids[row[keep]], v_id[col[keep]], score[keep]


def _search(rows: DataFrame, queries: DataFrame, counts: dict[int, int], asked: dict[int, int], dim: int, k: int) -> DataFrame:
    """Best of each block. ``rows`` (part, vec_id, embedding), ``queries`` (part, query_id, asked)."""
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(p, math.ceil(n / BLOCK), math.ceil(asked.get(p, 0) / QUERIES)) for p, n in counts.items()],
                                 "part int, blocks int, shares int")
    rows = (rows.join(F.broadcast(cuts), "part")
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .filter("shares > 0")
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("blocks", "shares"))
    queries = (queries.join(F.broadcast(cuts), "part")
               .withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "shares"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            found += _best(right.column("query_id").to_numpy(), _matrix(right.column("asked").combine_chunks(), dim),
                           left.column("vec_id").to_numpy(), _matrix(left.column("embedding").combine_chunks(), dim), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    keys = ["part", "block", "share"]
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of each row whose id ``every`` divides.

    Vectors that are null, zero or empty, or hold null or non-finite components, and rows without an id take
    no part, nor do vectors of another length than the most frequent one of the sample. A row never answers
    a query with its own id; of rows that repeat an id the smallest vector counts. An empty table gives an
    empty one. Recall is approximate, scores are exact."""
    spark = vectors.sparkSession
    usable_rows = usable(vectors)
    sample = [r for r in sample_rows(usable_rows, "vec_id", SAMPLE).toArrow().column("embedding").to_pylist()]
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    sizes = np.bincount([len(x) for x in sample])
    dim = int(sizes.argmax())
    router = fit_router(np.array([x for x in sample if len(x) == dim]))
    weights = spark.sparkContext.broadcast(router)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                _, p = weights.value.forward(_unit(_matrix(batch.column("embedding"), dim)))
                most = np.argsort(-p, axis=1, kind="stable")[:, :probes].astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, most.size + 1, most.shape[1], dtype=np.int32)),
                                                 pa.array(most.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), parts],
                                                 names=["vec_id", "embedding", "parts"])

    one = (usable_rows.filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    placed = save(one.mapInArrow(place, "vec_id long, embedding array<double>, parts array<int>"), "placed")
    rows = placed.select(F.col("parts")[0].alias("part"), "vec_id", "embedding")
    asking = placed.filter(F.col("vec_id") % every == 0)
    queries = asking.select(F.explode("parts").alias("part"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    found = save(_top(_search(rows, queries, counts, asked, dim, k), k), "found")
    want = min(k, sum(counts.values()) - 1)
    held = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("held"))
    short = asking.join(held, "vec_id", "left").filter(F.coalesce("held", F.lit(0)) < want)
    short = save(short.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "short")
    n = short.count()
    if n:
        everywhere = short.withColumn("part", F.explode(F.array(*[F.lit(p) for p in counts]))).select("part", "query_id", "asked")
        more = _top(_search(rows, everywhere, counts, dict.fromkeys(counts, n), dim, k), k)
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
