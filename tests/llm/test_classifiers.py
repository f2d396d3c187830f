import zlib

import numpy as np
import pyarrow as pa
import pytest

from plainsight.llm import quality_model, toxicity
from plainsight.llm.common import read_labels

SF = "/root/testdata/sf0.1"


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 0


@pytest.mark.parametrize(("model", "column", "least"), [(quality_model, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, model, column, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), read_labels(spark, SF, column)
    got = model.score(docs, labels).join(labels, "doc_id").collect()
    rows = [r for r in got if r.held_out]
    assert len(rows) > 500 and all(r.held_out == held(r.doc_id) for r in got)
    true = sum(r.predicted and r.label for r in rows)
    assert true / sum(r.label for r in rows) >= least
    assert true / sum(r.predicted for r in rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("model", [quality_model, toxicity])
def test_odd_rows(spark, model):
    rows = [(i, "a good long text about trees" if i % 2 else "you idiot !!!", "de", "s", 1.5) for i in range(60)]
    rows += [(None, "no id", "", None, None), (70, None, None, None, None), (71, "", "x", "y", 0.0), (1, rows[1][1], "z", "z", 1.0),
             (72, "word " * 100_000, "e", "e", 2.0)]
    schema = "doc_id long, text string, lang string, label string, score double"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 60)] + [(999, 1)], "doc_id long, label int")
    out = model.score(docs, labels).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.held_out) for r in out} == {(r[0], held(r[0])) for r in rows}
    by = {r.doc_id: r.score for r in out}
    if model is toxicity:
        assert by[2] > 0.5 > by[3]
    assert by[70] == by[71] and all(0 <= s <= 1 for s in by.values())
    # other columns are no inputs
    again = spark.createDataFrame([(*r[:2], None, None, None) for r in rows], schema)
    assert {(r.doc_id, r.score) for r in model.score(again, labels).collect()} == {(r.doc_id, r.score) for r in out}
    none = model.score(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert model.score(docs.limit(0), labels).collect() == []


def test_trees_go_down_like_single_rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, len(quality_model.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = quality_model.fit_trees(x, y)
    for i in range(20):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[i, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert trees.score(x[i:i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_label_model_counts_correlated_voters_once():
    rng = np.random.default_rng(6)
    y = rng.random(20_000) < 0.2
    one = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.1)
    other = np.where(y, rng.random(len(y)) < 0.5, rng.random(len(y)) < 0.05)
    votes = np.column_stack([one, one, one, other])
    moments = [toxicity._moments(votes, (y == c).astype(float)) for c in (0, 1)]
    model = toxicity.LabelModel(np.array([m[0] for m in moments]), np.stack([m[1] for m in moments]))
    assert model.accuracy[0] == pytest.approx(0.6, abs=0.03)
    assert model.correlation[0, 1] > 0.95 > 0.1 > model.correlation[0, 3]
    got = model.posterior(np.array([[True, True, True, False], [True, True, True, True]]))
    assert got[0] == pytest.approx(model.accuracy[0], abs=0.02) and got[1] > 0.9


def test_statistics_of_a_text():
    x = dict(zip(quality_model.FEATURES, quality_model.statistics(pa.array(["Ab ab! ab\nab", ""]))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(4)) and x["distinct"] == 3 / 4 and x["top_word"] == 2 / 4
    assert x["stutter"] == 1 / 4 and x["lines"] == pytest.approx(np.log1p(2)) and x["upper"] == 1 / 12
