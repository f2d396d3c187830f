import random
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from plainsight.llm import audit
from tests.llm.brute import WORD

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows):
    """The set of failed filters of each (doc_id, source, text)."""
    out = []
    for doc, _, text in rows:
        text = text or ""
        words = WORD.findall(text)
        own = set()
        if len(words) < 50:
            own.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            own.add("C")
        if set(text) & set("#$%&*|"):
            own.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in rows):
            own.add("E")
        out.append(own)
    return out


def brute(rows, labels):
    fails = failing(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = [], Counter()
    parts = sorted({s or "" for _, s, _ in rows})
    for part in parts:
        mine = [(d, f) for (d, s, _), f in zip(rows, fails) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                failed = sum(f in x for _, x in mine)
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), failed - len(gone), sum(x == {f} for _, x in mine),
                            sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def texts(rng):
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "A", "BB", " ", "日本", "x y"]
    made = [None, "", " \n\t", "#", "\x1c" * 3, "Z", "z" * 20 + "Z", "z" * 19 + "Z"]
    for n in [1, 49, 50, 51, 80, 120]:
        for different in [1, 5, 32, 33, 34, 65, 100]:
            some = rng.sample(vocabulary, min(different, n))
            words = some + [rng.choice(some) for _ in range(n - len(some))]
            made.append(rng.choice([" ", "  ", "\n", "\t \r"]).join(words) + rng.choice(["", "", "#", "$", " |", "C" * 40]))
    return made


@pytest.fixture()
def rows():
    rng = random.Random(11)
    made = texts(rng)
    out = [(i, rng.choice(["a", "b", None, "", "hot"]), rng.choice(made)) for i in range(220)]
    out += [(5, "a", out[5][2]), (7, "hot", "other text"), (None, "b", made[20]), (None, None, made[20]), (900, "only", made[20])]
    out += [(1000 + i, "hot", made[21]) for i in range(150)]
    return out


LABELS = [(i, i % 2, (i // 2) % 3) for i in range(0, 260, 3)] + [(3, 1, 1), (6, None, None), (None, 1, 1), (1001, 1, 1)]


@pytest.mark.parametrize("shard", [100, 8 << 20])
def test_equals_brute_force_and_sql(spark, monkeypatch, rows, shard):
    monkeypatch.setattr(audit, "SHARD", shard)
    docs = spark.createDataFrame([(i, s, t, 1, "x") for i, s, t in rows], "doc_id long, source string, text string, shard int, word string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.audit(docs.repartition(5), labels)
    assert got.columns == COLUMNS
    want = brute(rows, LABELS)
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({audit.AUDIT_SQL})").fetchall()) == want


def test_matrix_holds_every_word_under_one_number(spark, monkeypatch, rows):
    monkeypatch.setattr(audit, "SHARD", 300)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    shards = audit.term_matrix(docs).collect()
    assert len(shards) > 20
    got, numbers = [], {}
    for s in shards:
        assert len(s.word_ids) == len(s.counts) == s.starts[-1] and len(s.starts) == len(s.doc_ids) + 1
        for r, (doc, part) in enumerate(zip(s.doc_ids, s.parts)):
            own = dict(zip(s.word_ids[s.starts[r]:s.starts[r + 1]], s.counts[s.starts[r]:s.starts[r + 1]]))
            assert len(own) == s.starts[r + 1] - s.starts[r]
            got.append((str(doc), part, sorted(own.values())))
            numbers.setdefault((str(doc), part), []).append(own)
    counted = [(str(d), s or "", Counter(WORD.findall(t or ""))) for d, s, t in rows]
    assert sorted(got) == sorted((d, s, sorted(c.values())) for d, s, c in counted)
    # rows that are known by their key tell which number each word has
    known = {}
    for d, s, c in counted:
        if len(numbers[d, s]) == 1:
            own = numbers[d, s][0]
            for word, n in c.items():
                mine = {i for i, k in own.items() if k == n}
                known[word] = known[word] & mine if word in known else mine
    assert all(known.values())
    single = [min(v) for v in known.values() if len(v) == 1]
    assert len(single) > 50 and len(set(single)) == len(single)


def test_empty_table_and_empty_labels(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert sorted(map(tuple, audit.audit(docs, labels).collect())) == brute([(1, None, None)], [])


def test_very_long_text(spark):
    text = "\n".join(f"word{i % 70_000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, "a", text), (2, "a", text)], "doc_id long, source string, text string")
    facts = audit.document_facts(docs).collect()
    assert [(f.n_words, f.n_distinct, f.points) for f in facts] == [(200_000, 70_000, len(text))] * 2


def test_marked_bytes_of_slices():
    import pyarrow as pa

    some = pa.array(["AbC#", "", "日本A", "||", "x"])
    assert audit._marked(some.slice(1, 3), audit._UPPER).tolist() == [0, 1, 0]
    assert audit._marked(some, audit._SYMBOLS).tolist() == [1, 0, 0, 2, 0]
    assert np.array_equal(audit._marked(some.slice(0, 0), audit._UPPER), [])


@pytest.mark.parametrize("seen", [3, 500_000])
def test_words_that_share_a_number_get_new_ones(spark, monkeypatch, seen):
    def three(names):
        words = names.to_pylist()
        return np.array([[len(w) % 3, hash_of(w)] for w in words], np.int64).reshape(-1, 2)

    def hash_of(word):
        return int.from_bytes(word.encode()[:7].ljust(7, b"\0"), "little")

    monkeypatch.setattr(audit, "_numbers", three)
    monkeypatch.setattr(audit, "SHARD", 30)
    monkeypatch.setattr(audit, "SEEN", seen)
    rows = [(i, "s", t) for i, t in enumerate(["a bb ccc dddd a", "eeeee a bb", "", "z ccc", "bb " * 9, "only a z"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    shared = audit.shared_numbers(docs)
    words = {"a", "bb", "ccc", "dddd", "eeeee", "z", "only"}
    by_number = Counter(len(w) % 3 for w in words)
    assert set(shared) == {(len(w) % 3, hash_of(w)) for w in words if by_number[len(w) % 3] > 1}
    assert sorted(shared.values()) == [-n for n in range(len(shared), 0, -1)]
    for s in audit.term_matrix(docs, shared).collect():
        for r, doc in enumerate(s.doc_ids):
            own = dict(zip(s.word_ids[s.starts[r]:s.starts[r + 1]], s.counts[s.starts[r]:s.starts[r + 1]]))
            text = Counter(rows[doc][2].split())
            assert own == {shared.get((len(w) % 3, hash_of(w)), len(w) % 3): n for w, n in text.items()}
