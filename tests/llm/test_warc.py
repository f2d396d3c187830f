import base64
import hashlib
import io
import random
import struct

import duckdb
import zstandard

from plainsight.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, least long"


def some_pages():
    rng = random.Random(1)
    rows = [(i, f"https://e.net/{i}", "<p>" + " ".join(rng.choice(["a", "été", "page", "of", "text"]) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    rows += [(200 + i, "https://e.net/copy", rows[3][2]) for i in range(30)]
    return rows + [(300, None, None), (301, "https://e.net/a b\r\nX: y", ""), (None, "https://e.net/none", rows[3][2]),
                   (None, "https://e.net/new", "only without id"), (303, "u", "twice"), (303, "u", "twice"), (304, "u", "\r\n\r\n" * 3)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_round_trip(spark):
    rows = some_pages()
    out = warc.round_trip(table(spark, rows).repartition(3)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = []
    for i, _, html in rows:
        data, first = (html or "").encode(), least.get(html or "")
        own = first is None or i == first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert got == sorted(want, key=str)
    texts = {i: html or "" for i, _, html in rows}
    assert all(r.payload.decode() == texts[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)
    assert all(r.payload is None for r in out if r.record_type == "revisit")


def test_same_as_sql(spark):
    rows = some_pages()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cur = con.execute(warc.WARC_SQL)
    names = [c[0] for c in cur.description]
    out = warc.round_trip(table(spark, rows)).select(*names).collect()
    assert sorted(map(tuple, out), key=str) == sorted(cur.fetchall(), key=str)


def test_empty_table(spark):
    assert warc.round_trip(table(spark, [])).collect() == []


def test_records_are_compressed_one_by_one_with_the_leading_dictionary():
    records = [warc.record(i, f"https://e.net/{i}", f"<html>page {i}</html>".encode() * 30, 21 * 30, "D", None) for i in range(50)]
    data = b"".join(warc.archive_bytes(iter(records)))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    rest, got = data[8 + size:], []
    while rest:
        frame = reader.decompressobj()
        got.append(frame.decompress(rest))
        assert frame.eof
        rest = frame.unused_data
    assert got == records
    assert len(list(warc.read_archive(io.BytesIO(data), step=7))) == 50
    plain = zstandard.ZstdCompressor(level=3)
    assert len(data) - size < sum(len(plain.compress(r)) for r in records)
