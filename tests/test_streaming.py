"""Streams run as streams."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import files
from tessella.streaming import ingest


def ran(df, tmp_path, mode):
    """Rows that a stream wrote, by batch."""
    out = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda batch, i: out.extend((i, r) for r in batch.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_watermarked_windows_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "props").orderBy("ts").toPandas()
    n = len(events)
    for k in range(4):
        spark.createDataFrame(events[k * n // 4 : (k + 1) * n // 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = [(r["w"]["start"], r["event_type"], r["n"], r["bytes"]) for _, r in ran(ingest.arriving_totals(stream), tmp_path, "append")]
    batch = ingest.arriving_totals(spark.read.parquet(str(tmp_path / "in"))).collect()
    last = events.ts.max()
    closed = [(r["w"]["start"], r["event_type"], r["n"], r["bytes"]) for r in batch if r["w"]["end"] <= (last - __import__("datetime").timedelta(minutes=10)).to_pydatetime()]
    assert len(got) == len(set(got)) > 0 and sorted(got) == sorted(closed)


@pytest.mark.parametrize("size", [7, 1000])
def test_bitmaps_in_chunks(spark, tmp_path, size):
    p = spark.range(3).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), (F.col("id") + 1).cast("int"))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(4))))
    p = p.select("image_id", "y", "x", *(F.lit(v).alias(c) for c, v in zip("rgba", (1, 2, 3, 255))))
    data = {r["image_id"]: bytes(r["content"]) for r in files.write_bmp(p).collect()} | {7: b"no bitmap at all", 8: b"B"}
    chunks = [(i, k, d[k * size : (k + 1) * size]) for i, d in data.items() for k in range(-(-len(d) // size))]
    random.Random(1).shuffle(chunks)
    for k in range(3):
        spark.createDataFrame(chunks[k::3], "stream_id long, seq long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = ran(ingest.bitmap_progress(stream), tmp_path, "update")
    final = {}
    for i, r in sorted(rows, key=lambda x: x[0]):
        before = final.get(r["stream_id"])
        assert before is None or before["state"] == "invalid" or r["bytes_received"] >= before["bytes_received"]
        final[r["stream_id"]] = r
    for i in range(3):
        r = final[i]
        assert (r["state"], r["bytes_received"], r["width"], r["height"], r["rows_ready"]) == ("complete", len(data[i]), 5, i + 2, i + 2)
    assert final[8]["state"] == "needs_bytes" and final[7]["state"] == "invalid"
