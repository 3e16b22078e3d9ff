"""WARC bundles: round trips, seek tables and index, against SQL and by hand."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from tessella.llm import warc
from tessella.llm.oracle import ORACLE
from tessella.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, latest int, n int"


def pages(spark, rows):
    """Rows with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 5, 6) for r in rows], PAGES)


def expected(rows):
    best = {}
    for page_id, _, html in rows:
        h = html or ""
        best[h] = max((x for x in (best.get(h), page_id) if x is not None), default=None)
    out = []
    for page_id, _, html in rows:
        h, data = best[html or ""], (html or "").encode()
        again = h is not None and (page_id is None or page_id < h)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if again else "response", h if again else None, True))
    return sorted(out, key=str)


def test_query_matches_sql(spark, duck, sf_dir):
    df = QUERIES["op12_warc"](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert got == sorted(duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['op12_warc']})").fetchall(), key=str)


ODD = [
    (1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/3 x\r\ny", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"),
    (6, "u", "alone é 中 🎉\r\n\r\nWARC/1.1\r\n\0"), (7, "u", "twice"), (7, "u", "twice"), (None, "v", "nobody"), (None, "w", "nobody"), (9, "u", "x" * 3_000_000),
]


def test_odd_pages(spark):
    got = warc.page_records(pages(spark, ODD).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ODD)
    assert warc.page_records(pages(spark, [])).collect() == []


def test_small_payloads_are_written_each_time(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r.page_id: r.refers_to for r in warc.page_records(pages(spark, rows), least=4).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_frequent_payloads_are_dealt(spark):
    rows = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(900)]
    df = warc.with_latest(pages(spark, rows))
    latest = {r.page_id: r.latest for r in df.collect()}
    assert all(latest[i] == (899 if i % 3 else None) for i in range(900))


def test_bundles_can_be_read_without_the_library(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (50 * i % 4000)) for i in range(200)]
    index = warc.write_archives(pages(spark, rows).coalesce(1), path=str(tmp_path))
    bundles = [r[0] for r in index.select("bundle").distinct().collect()]
    assert len(bundles) == 1 and index.count() == 200
    data = open(bundles[0], "rb").read()
    # an ordinary reader goes through all frames, and skips the seek table
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC-Type: response\r\n") + whole.count(b"WARC-Type: revisit\r\n") == 200 and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and n > 3
    size = 12 * n + 9
    assert struct.unpack("<II", data[-size - 8 : -size]) == (0x184D2A5E, size)
    assert sum(struct.unpack_from("<I", data, len(data) - size + 12 * k)[0] for k in range(n)) == len(data) - size - 8
    # each record alone, by its place in its frame
    for r in index.collect():
        frame = zstandard.ZstdDecompressor().decompress(data[r.frame_at : r.frame_at + r.frame_bytes], max_output_size=r.frame_raw)
        assert f"WARC-Record-ID: <urn:page:{r.page_id}>".encode() in frame[r.record_at : r.record_at + r.record_bytes]


def test_fetch_reads_only_what_is_wanted(spark):
    rows = [(i, f"http://a/{i}", f"text {i} " * 5000) for i in range(300)]
    index = warc.write_archives(pages(spark, rows).repartition(2))
    wanted = spark.createDataFrame([(7,), (7,), (250,), (1000,)], "page_id long")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.fetch(index, wanted).collect()}
    assert got == {i: rows[i][2] for i in (7, 250)}
    whole = {r.page_id: (bytes(r.payload).decode(), r.url) for r in warc.read_archives(index, payload=True).collect()}
    assert whole == {i: (h, u) for i, u, h in rows}


def test_frames_are_cut_and_damage_is_seen(spark, tmp_path):
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 3000) for i in range(40)]
    index = warc.write_archives(pages(spark, rows).coalesce(1), path=str(tmp_path))
    path = index.first().bundle
    data = bytearray(open(path, "rb").read())
    data[-3] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="seek table"):
        warc.seek_table(path)
    bundle = warc.Bundle(str(tmp_path / "small.warc.zst"), "1970-01-01T00:00:00Z")
    for i in range(3):
        list(bundle.add(i, "response", warc.record(i, "u", b"x" * (warc.FRAME_BYTES // 2 + 1), None, "1970-01-01T00:00:00Z")))
    index_rows = list(bundle.close())
    assert len(bundle.entries) == 3 and [r[0] for r in index_rows] == [2]
    assert len(warc.seek_table(bundle.path)) == 3
