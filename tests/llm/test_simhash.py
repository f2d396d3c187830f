import random

import numpy as np
import pytest

from plainsight.llm import simhash
from plainsight.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, fp string, component long, path int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def expected(rows):
    prints = [brute.fingerprint(t or "") for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    root = brute.smallest_of_component(len(rows), links)
    least = {}
    for r, (doc, _) in zip(root, rows):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, f"{p:016x}", least.get(r)) for (doc, _), p, r in zip(rows, prints, root)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def some_rows(n=120):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "été", "zeta", "eta", "theta", "Iota", "kappa"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            own = rng.choice(rows)[1].split(" ")
            if len(own) > 30:
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 - i, " ".join(own)))
        else:
            rows.append((1000 - i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300])))))
    return rows


def test_same_as_brute_force(spark):
    rows = some_rows() + [(5, None), (6, ""), (7, " \n "), (None, "alpha beta"), (None, None), (8, "one"), (8, "one"), (9, "ONE")]
    assert got(simhash.near_duplicates(table(spark, rows))) == expected(rows)


def test_groups_are_parted_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 3)
    rows = some_rows(80)
    assert got(simhash.near_duplicates(table(spark, rows))) == expected(rows)


def test_empty_table_and_long_text(spark):
    assert got(simhash.near_duplicates(table(spark, []))) == []
    rows = [(1, "word " * 200_000), (2, "word word word")]
    assert got(simhash.near_duplicates(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_neighbours(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (90, 3), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for c in centres]))
    group = rng.integers(0, 3, len(codes))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    found = {(int(a), int(b)) for i, j in simhash.GrayIndex(codes, group).neighbours(2, block=50) for a, b in zip(i, j)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
            if group[i] == group[j] and bin(int(codes[i] ^ codes[j])).count("1") <= 2}
    assert found == want


def test_one_document_of_each_group_stays(spark):
    rows = some_rows(60)
    kept = {r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()}
    assert kept == {c for _, _, c in expected(rows)}
    assert simhash.keep_one(table(spark, rows)).columns == ["doc_id", "text", "fp", "component", "path"]


@pytest.mark.parametrize("task", [20, 500_000])
@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, monkeypatch, shape, task):
    monkeypatch.setattr("plainsight.llm.components.TASK", task)
    rng = random.Random(2)
    edges = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
             "chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(100)]}[shape] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = brute.smallest_of_component(200, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in components(df).collect()} == {(x, root[x]) for x in nodes}
