"""The driver contract."""

import re
import sys

import __spark_entry__ as entry
from plainsight.workloads import REGISTRY


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # the training-data queries are there only where their subpackage is
    own = {n for n in q if not re.match(r"pipeline$|op\d+_", n)}
    assert own == set(REGISTRY) and len(own) > 180
    assert own - set(o) == {"severity_value", "oversample", "smote", "train_binary", "train_multiclass", "search", "hash_features"}


def test_works_without_the_training_data_queries(monkeypatch):
    for name in ("corpus_pipeline", "plainsight.llm"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(REGISTRY) and set(entry.oracle_sql()) <= set(REGISTRY)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "sink"] and df.count() > 0
