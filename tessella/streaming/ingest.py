"""Streams: arriving files, files that arrive in chunks, windowed totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schema of a stream of binary files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive in a folder; each is seen once."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(path)


def stream_progress(chunks: DataFrame, needed: int) -> DataFrame:
    """How much of ``needed`` bytes each byte stream has after each chunk: (stream_id, seq, size) to bytes_received, state and progress.

    Works on a batch; chunks are put in order of ``seq``, whatever order they came in.
    The states are parts of the byte count: 16 bytes, an eighth, all.
    """
    so_far = F.sum("size").over(Window.partitionBy("stream_id").orderBy("seq"))
    out = chunks.withColumn("bytes_received", so_far.cast("long"))
    state = F.when(F.col("bytes_received") < 16, "needs_bytes").when(F.col("bytes_received") < needed / 8, "headers_ready").when(F.col("bytes_received") < needed, "dc_ready").otherwise("complete")
    return out.select("stream_id", "seq", "bytes_received", state.alias("state"), F.least(F.lit(1.0), F.round(F.col("bytes_received") / needed, 6)).alias("progress"))


PROGRESS = "stream_id long, bytes_received long, width long, height long, rows_ready long, state string"
KEPT = "next_seq long, received long, header binary, early_seq array<long>, early_chunk array<binary>"
#: Bytes of a bitmap's header that are looked at: up to the end of its sizes and depth.
HEADER = 30


def bitmap_progress(chunks: DataFrame, give_up: str | None = None) -> DataFrame:
    """Bitmaps that arrive in chunks (stream_id, seq, chunk), in any order: after each trigger how far each one is.

    ``bytes_received`` counts the bytes without a gap. From the header come the
    size, and from it how many whole rows of pixels are there. States are
    needs_bytes, rows_ready, complete, and ``invalid`` for one that doesn't begin as
    a bitmap. With ``give_up`` (for queries
    that run on), a stream from which nothing has come for so long ends as
    ``abandoned``. The state kept for a stream is
    its header and the chunks that came too early, not the pixels.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, received, header, early = 0, 0, b"", {}
        if state.exists:
            seq, received, header, at, data = state.get
            early = dict(zip(at, data))
        if not state.hasTimedOut:
            for frame in frames:
                early |= {int(s): bytes(c) for s, c in zip(frame["seq"], frame["chunk"]) if s >= seq}
            while seq in early:
                chunk = early.pop(seq)
                header += chunk[: max(0, HEADER - len(header))]
                seq, received = seq + 1, received + len(chunk)
        width = height = rows = None
        step = "needs_bytes"
        if header[:2] != b"BM"[: len(header)]:
            step = "invalid"
        elif len(header) == HEADER:
            number = lambda a, b, signed=False: int.from_bytes(header[a:b], "little", signed=signed)
            width, height, bits, first = number(18, 22), abs(number(22, 26, True)), number(28, 30), number(10, 14)
            line = (width * bits + 31) // 32 * 4
            rows = min(height, max(0, received - first) // line) if line else height
            step = "complete" if rows == height else "rows_ready" if rows else "needs_bytes"
        if state.hasTimedOut:
            step = "abandoned"
        if step == "abandoned":
            state.remove()
        else:
            if step in ("complete", "invalid"):
                early = {}
            state.update((seq, received, header, list(early), list(early.values())))
            if give_up:
                state.setTimeoutDuration(int(pd.Timedelta(give_up).total_seconds() * 1000))
        yield pd.DataFrame({"stream_id": [key[0]], "bytes_received": [received], "width": [width], "height": [height], "rows_ready": [rows], "state": [step]}).astype({"width": "Int64", "height": "Int64", "rows_ready": "Int64"})

    return chunks.groupBy("stream_id").applyInPandasWithState(advance, PROGRESS, KEPT, "update", "ProcessingTimeTimeout" if give_up else "NoTimeout")


def arriving_totals(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Bytes and chunks per stream kind and window with a watermark; the same on batches and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.length("props").cast("long")).alias("bytes"))
