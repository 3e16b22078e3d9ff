"""Boxes from whole files, from prefixes and from streams; table functions in SQL."""

import random
import struct

import pytest

from tessella.functions import tables
from tessella.operators import files
from tessella.sources import rasters
from tessella.streaming import containers


def box(tag, payload, wide=False, last=False):
    size = len(payload) + (16 if wide else 8)
    return (struct.pack(">I4sQ", 1, tag, size) if wide else struct.pack(">I4s", 0 if last else size, tag)) + payload


WHOLE = {
    1: containers.SIGNATURE + box(b"ftyp", b"jxl \0\0\0\0") + box(b"jxlp", b"\0\0\0\0abc") + box(b"Exif", b"x" * 40, wide=True) + box(b"jxlp", b"\x80\0\0\1defgh", last=True),
    2: b"\xff\x0a" + b"y" * 50,
    3: containers.SIGNATURE + box(b"jxlc", b"z" * 9) + box(b"empt", b""),
    4: b"GIF89a and more",
    5: containers.SIGNATURE + struct.pack(">I4s", 5, b"jxlc") + b"zz",
    6: containers.SIGNATURE + box(b"jxlp", b"abc"),
    7: containers.SIGNATURE[:7],
    8: b"",
}
BOXES = {1: [(0, "ftyp", 12, 16), (1, "jxlp", 28, 15), (2, "Exif", 43, 56), (3, "jxlp", 99, None)], 3: [(0, "jxlc", 12, 17), (1, "empt", 29, 8)]}
ENDS = {1: (8, "codestream"), 2: (52, "bare"), 3: (9, "boxes"), 4: (0, "invalid"), 5: (0, "invalid"), 6: (0, "invalid"), 7: (0, "needs_bytes"), 8: (0, "needs_bytes")}


def test_whole_files(spark):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in WHOLE.items()] + [(9, None)], "image_id long, content binary")
    got = {}
    for r in containers.boxes(df).collect():
        got.setdefault(r.image_id, []).append(tuple(r)[1:])
    assert got == BOXES


def test_any_cut_gives_the_same_boxes():
    r = random.Random(2)
    for key, data in WHOLE.items():
        for _ in range(60):
            walk, found, at = containers.Walk(), [], 0
            while at < len(data):
                n = r.choice((1, 2, 3, 7, 30))
                found += walk.feed(data[at : at + n])
                at += n
            assert found == BOXES.get(key, []) and (walk.codestream, walk.kind) == ENDS[key]
            assert walk.received == len(data) or walk.kind == "invalid"


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_gives_each_box_once(spark, store, tmp_path):
    r = random.Random(3)
    chunks = []
    for key, data in WHOLE.items():
        parts, at = [], 0
        while at < len(data):
            n = r.choice((1, 5, 12))
            parts.append(data[at : at + n])
            at += n
        chunks += [(key, seq, bytearray(p)) for seq, p in enumerate(parts)]
    # any order, some of them twice, in three triggers
    chunks += r.sample(chunks, 10)
    r.shuffle(chunks)
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(chunks[k::3], containers.PARTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(containers.PARTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = containers.arriving_boxes(stream).writeStream.format("memory").queryName("seen_boxes").outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got, ends = {}, {}
    for x in spark.table("seen_boxes").collect():
        if x.event == "box":
            got.setdefault(x.stream_id, []).append((x.n, x.tag, x.at, x.size))
        elif x.received >= ends.get(x.stream_id, (-1,))[0]:
            ends[x.stream_id] = (x.received, x.codestream, x.state)
    assert {k: sorted(v) for k, v in got.items()} == BOXES
    assert {k: v[1:] for k, v in ends.items()} == {k: v for k, v in ENDS.items() if k != 8}


def test_silent_streams_are_abandoned(spark, store, tmp_path):
    import time

    source = tmp_path / "in"
    spark.createDataFrame([(1, 0, bytearray(WHOLE[1][:40]))], containers.PARTS).write.parquet(str(source))
    stream = spark.readStream.schema(containers.PARTS).parquet(str(source))
    query = containers.arriving_boxes(stream, "1 second").writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("silent").where("state = 'abandoned'").count():
            time.sleep(1)
        assert [tuple(x) for x in spark.table("silent").where("state = 'abandoned'").select("stream_id", "received").collect()] == [(1, 40)]
    finally:
        query.stop()


def test_table_functions(spark, sf_dir):
    tables.register(spark)
    made = files.write_all(rasters.lineitem_pixels(spark, sf_dir).where("image_id <= 3"))
    made.createOrReplaceTempView("tf_files")
    got = spark.sql("SELECT image_id, n, name, size, ok FROM image_chunks(TABLE(tf_files) PARTITION BY image_id)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, files.chunks(made).collect())) and got.count() == 12
    pixels = spark.sql("SELECT image_id, y, x, r, g, b, a FROM image_pixels(TABLE(SELECT * FROM tf_files WHERE format = 'tga') PARTITION BY image_id)")
    assert sorted(map(tuple, pixels.collect())) == sorted(map(tuple, files.read_tga(made).select(*pixels.columns).collect()))
    assert spark.sql("SELECT count(*) FROM image_pixels(TABLE(tf_files) PARTITION BY (image_id), 5)").first()[0] == 0
    for bad, words in (("image_chunks(5)", "table"), ("image_chunks(TABLE(SELECT 1 AS image_id))", "content")):
        with pytest.raises(Exception, match=words):
            spark.sql(f"SELECT * FROM {bad}").collect()
