import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plainsight.llm import mixing, quality_rules
from tests.llm import brute

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def texts():
    rng = random.Random(4)
    words = ["so", "été", "Big", "x|y", "#", "line", " ", "end."]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    return [None, "", "   ", "\n\n", "a b c d e a b c d e a b c d e", "x " * 50_000, "same line\nsame line\n \n ", *made]


def test_counts(spark):
    rows = list(enumerate(texts())) + [(None, "word " * 12), (3, "\n\n")]
    docs = spark.createDataFrame([(i, t, True, 1.0) for i, t in rows], "doc_id long, text string, _trusted boolean, ratio double")
    out = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long"))
    got = sorted(((r.doc_id, *[r[c] for c in COUNTS]) for r in out.collect()), key=str)
    want = sorted(((i, *[brute.rule_counts(t or "")[c] for c in COUNTS]) for i, t in rows), key=str)
    assert got == want
    assert all(r.kept == (not r.base_failed) and r.ratio == 0 for r in out.collect())


def prose(rng):
    return " ".join(rng.choice(["the", "river", "runs", "past", "green", "hills", "and", "old", "stone", "walls", "slowly"]) + str(rng.randint(0, 99)) for _ in range(60))


def test_all_trusted_documents_are_counted(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "int(id % 5 > 0) AS label")
    labels = labels.union(labels.selectExpr("doc_id + 25000", "label"))
    assert quality_rules.trusted_ids(labels).count() == 40_000
    rows = [(1, "good words here"), (1, "good words here"), (2, "junk ## ## junk"), (None, "no id at all"), (3, None), (4, "more good words")]
    trusted = spark.createDataFrame([(1,), (4,), (9,)], "doc_id long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slots = lambda own: np.bincount(quality_rules._slots(pa.array(own))[0], minlength=quality_rules.SLOTS).astype(float)
    raw, good = slots([t or "" for _, t in rows]), slots([t for d, t in rows if d in (1, 4)])
    raw *= good.sum() / raw.sum()
    want = np.log((good + quality_rules.SMOOTH) / (raw + quality_rules.SMOOTH))
    assert np.allclose(quality_rules.fit_ratio(docs, trusted), want)


def test_verdict(spark):
    rng = random.Random(6)
    good = [(i, prose(rng)) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "$$$ &&&" for w in prose(rng).split())) for i in range(80)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, trusted).collect()}
    assert kept == {i for i, _ in good}
    assert {r.doc_id for r in quality_rules.judge(docs, trusted).collect() if r.kept} == kept
    assert quality_rules.keep_good(docs.limit(0), trusted).collect() == []


def sized(rng, n):
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 300])), rng.choice(["b", "a", "ä", "C", "", None, "tiny"] if i % 40 else ["solo"]))
            for i in range(n)]
    return rows + [(None, "no id", "a"), (7, None, "a"), (7, "same id", "b"), (8, "only", "zero "), (9, "", "void")]


@pytest.mark.parametrize("n", [0, 400])
def test_mix(spark, n):
    rows = sized(random.Random(9), n)
    docs = spark.createDataFrame([(i, t, s, 0, "c") for i, t, s in rows], "doc_id long, text string, source string, copies int, _rate string")
    plan = mixing.mix_plan(docs).withColumnRenamed("copies", "k")
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.size * r.k) for r in plan.collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(mixing.MIX_SQL).fetchall(), key=str)
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r.k for r in plan.collect())
    by = {}
    for r in plan.collect():
        by.setdefault(r.source, [0, 0, r.source_size, r.target])
        by[r.source][0] += r.size * r.k
        by[r.source][1] += r.size ** 2
        assert r.size * r.k <= 3 * r.size
    for taken, squares, size, target in by.values():
        # four standard deviations of the last copies
        assert abs(taken - target) <= 2 * squares ** 0.5
        assert target <= 3 * size + 1e-9
    assert sum(target for *_, target in by.values()) == pytest.approx(sum(size for _, _, size, _ in by.values()))


def test_empty_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).collect() == [] and mixing.mix(docs).collect() == []
