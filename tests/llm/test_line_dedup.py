import random

import pyarrow as pa
import pytest

from plainsight.llm import line_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, _key string, n_chars long, bands string"


def run(spark, rows):
    df = spark.createDataFrame([(d, t, f"r{i}", len(t or ""), "x") for i, (d, t) in enumerate(rows)], SCHEMA)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.schema == df.schema
    got = {r["_key"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert r.n_chars == len(r.text or "")
    return [got[f"r{i}"].text for i in range(len(rows))]


def some_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(lines)
            if rng.random() < 0.4:
                parts = line.split(" ")
                parts[rng.randrange(len(parts))] = word()
                line = " ".join(parts)
            own.append(rng.choice([line, line, "too short here", ""]))
        rows.append((100 - i, "\n".join(own)))
    return rows


def test_same_as_brute_force(spark):
    rows = some_rows() + [(3, None), (4, ""), (None, "a line that has no id but five words"),
                          (5, "a line that has no id but five words"), (6, "été à la même ligne encore"), (7, "été à la même ligne encore")]
    assert run(spark, rows) == brute.dedup_lines(rows)


@pytest.mark.parametrize("whole", [2, 6])
def test_large_buckets_are_dealt_into_shares(spark, monkeypatch, whole):
    monkeypatch.setattr(line_dedup, "WHOLE", whole)
    rows = some_rows()
    assert run(spark, rows) == brute.dedup_lines(rows)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_bucket_links_are_all_links(block):
    rng = random.Random(block)
    start = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 120))) for _ in range(4)]
    lines = list(start)
    while len(lines) < 90:
        x = list(rng.choice(lines))
        x[rng.randrange(len(x))] = rng.choice("xyz")
        lines.append("".join(x))
    links = [(i, j) for i in range(90) for j in range(i) if brute.alike(lines[i], lines[j])]
    assert line_dedup.bucket_links(lines, block, 10).tolist() == brute.smallest_of_component(90, links)


def test_buckets_across_batches():
    rng = random.Random(4)
    rows = sorted((rng.randrange(30), rng.randrange(6)) for _ in range(90))
    want = [r for r in sorted(set(rows)) if sum(k == r[0] for k, _ in set(rows)) > 1]
    for size in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + size]], pa.int64()) for c in (0, 1)], names=["key", "lid"])
                   for i in range(0, 90, size)]
        got = [r for b in line_dedup._buckets(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == want


def test_repeated_rows_lose_the_same_lines(spark):
    a, b = "one two three four five six seven", "another line with more than five words"
    rows = [(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, f"{b}\nshort")]
    assert run(spark, rows) == [f"{a}\n{b}", f"{a}\n{b}", "short"]


def test_long_lines_of_few_words_are_compared(spark):
    url = "https://example.org/a/long/address/of/a/page/that/repeats?in=all&texts=1"
    chinese, thai = "版权所有未经书面授权不得转载或复制", "สงวนลิขสิทธิ์ห้ามทำซ้ำ"
    short = ["too short here", "目录", "a_name_of_forty_characters_and_no_more_x", " " * 60]
    rows = [(i, "\n".join([url, f"code_{url}", chinese, thai, *short])) for i in range(3)]
    assert run(spark, rows) == [rows[0][1].replace(f"\ncode_{url}", "")] + ["\n".join(short)] * 2


def test_empty_table_and_long_line(spark):
    assert run(spark, []) == []
    long = "many words in a very long line " * 20_000
    assert run(spark, [(1, long), (2, long + "x")]) == [long, ""]


@pytest.mark.parametrize("size", [4, 8, 12, 20, 28, 40, 80, 96, 116, 120, 160])
def test_recall_at_least_similarity_by_length(size):
    rng = random.Random(size)
    left = ["".join(rng.choices("abcdefghijklmnop ", k=size + 7)) for _ in range(1000)]
    right = [x + "".join(rng.choices("abcdefghijklmnop ", k=size // 4)) for x in left]
    keys, counts = line_dedup.band_keys(left + right)
    bands, at = [], 0
    for n in counts.tolist():
        bands.append(set(keys[at:at + n].tolist()))
        at += n
    alike = [i for i in range(1000) if brute.alike(left[i], right[i])]
    assert len(alike) > 900
    assert sum(bool(bands[i] & bands[1000 + i]) for i in alike) >= 0.985 * len(alike)


def test_similarity_is_exact():
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    other = [x if rng.random() < 0.5 else x + rng.choice(["a", "bb", "abba b"]) for x in lines]
    assert line_dedup.jaccard_at_least(lines, other).tolist() == [brute.alike(a, b) for a, b in zip(lines, other)]
