import numpy as np
import pytest

from plainsight.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, part int, score double"


def table(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5) for i, v in zip(ids, x)], SCHEMA)


def brute(ids, x, k=5):
    x = np.array(x, np.float32).astype(np.float64)
    ids = np.array(ids)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[q] * x[q]).sum()))
        s[q] = -9
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((20, 16)), 150, axis=0) + 0.6 * rng.standard_normal((3000, 16))
    ids = rng.permutation(3000)
    got, want = found(neighbours.nearest(table(spark, ids.tolist(), x), probes=6)), brute(ids, x)
    assert got.keys() == want.keys()
    exact = {q: dict(v) for q, v in want.items()}
    hits = sum(len(dict(got[q]).keys() & exact[q].keys()) for q in got)
    assert hits >= 0.9 * 5 * len(want)
    for q in got:
        for i, s in got[q]:
            if i in exact[q]:
                assert s == pytest.approx(exact[q][i], abs=1e-15)


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8))
    x[100:300] = x[0]
    assert found(neighbours.nearest(table(spark, range(400), x), probes=99)) == brute(range(400), x)


def test_what_takes_no_part(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [1.0, 1.0]]
    rows = {0: good[0], 50: None, 100: [0.0, 0.0], 150: [1.0, None], 200: [float("nan"), 1.0], 250: [float("inf"), 1.0],
            300: [], 350: [1.0, 2.0, 3.0], 7: good[1], 8: good[2], None: good[0]}
    got = found(neighbours.nearest(table(spark, rows, rows.values())))
    assert got == brute([0, 7, 8], good)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_small_tables(spark, n):
    x = np.random.default_rng(3).standard_normal((n, 4))
    got = found(neighbours.nearest(table(spark, range(n), x)))
    assert got == ({k: v for k, v in brute(range(n), x).items() if v} if n else {})


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((8, 16)) * 3, 100, axis=0) + 0.3 * rng.standard_normal((800, 16))
    graph = neighbours.neighbour_graph(x, 8)
    part = neighbours.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= 1.06 * 100
    assert (part[graph] == part[:, None]).mean() > 0.8
