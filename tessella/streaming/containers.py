"""Boxes of ISO containers out of whole files or out of a growing prefix.

A container is a row of boxes: a size of four bytes (1: eight more bytes have it, 0: up
to the end), a tag of four, the payload. ``Walk`` takes a file in pieces of any size and
knows each box as soon as its header is there; payloads are counted, not kept. Batches
feed it a whole file, streams what has come so far, so both give the same boxes.

Boxes tagged jxlc and jxlp carry parts of a codestream, the latter after four bytes of
their own; a file may also be a bare codestream, which has no boxes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How a container and a bare codestream begin.
SIGNATURE, BARE = bytes.fromhex("0000000C4A584C200D0A870A"), b"\xff\x0a"
CODESTREAM = (b"jxlc", b"jxlp")
BOXES = "n int, tag string, at long, size long"
STATE = "next_seq long, received long, head binary, wanted long, skipped long, boxes int, codestream long, kind string"
STREAM = "stream_id long, event string, n int, tag string, at long, size long, received long, codestream long, state string"
PARTS = "stream_id long, seq long, chunk binary"


@dataclass
class Walk:
    """Where a file stands: bytes received, the header that is being read, payload bytes to come (-1: all), bytes of them that are no codestream."""

    received: int = 0
    head: bytes = b""
    wanted: int = 0
    skipped: int = 0
    boxes: int = 0
    codestream: int = 0
    kind: str = "needs_bytes"

    def feed(self, data: bytes) -> Iterator[tuple[int, str, int, int | None]]:
        """Takes the next bytes; gives (number, tag, place, size or None for the rest) of each box whose header is complete now."""
        at = 0
        while at < len(data) and self.kind != "invalid":
            if self.kind in ("bare", "codestream", "payload"):
                n = len(data) - at if self.wanted < 0 else min(self.wanted, len(data) - at)
                if self.kind != "payload":
                    own = min(n, self.skipped)
                    self.skipped -= own
                    self.codestream += n - own
                self.received, at = self.received + n, at + n
                if self.wanted > 0:
                    self.wanted -= n
                if self.wanted == 0:
                    self.kind = "boxes"
                continue
            need = self._need()
            n = min(need - len(self.head), len(data) - at)
            self.head += data[at : at + n]
            self.received, at = self.received + n, at + n
            if len(self.head) == self._need():
                yield from self._header()

    def _need(self) -> int:
        if self.kind == "needs_bytes":
            return 2 if len(self.head) < 2 or self.head[:2] == BARE else len(SIGNATURE)
        return 16 if len(self.head) >= 8 and self.head[:4] == b"\0\0\0\1" else 8

    def _header(self) -> Iterator[tuple[int, str, int, int | None]]:
        head = self.head
        if self.kind == "needs_bytes":
            if head == BARE:
                self.kind, self.wanted, self.codestream, self.head = "bare", -1, 2, b""
            elif len(head) == len(SIGNATURE):
                self.kind, self.head = "boxes" if head == SIGNATURE else "invalid", b""
            return
        size, tag, place = int.from_bytes(head[:4], "big"), head[4:8], self.received - len(head)
        if len(head) == 16:
            size = int.from_bytes(head[8:], "big")
        payload = size - len(head)
        if size and payload < (4 if tag == b"jxlp" else 0):
            self.kind = "invalid"
            return
        yield self.boxes, tag.decode("latin-1"), place, size or None
        self.boxes, self.head = self.boxes + 1, b""
        self.wanted, self.skipped = payload if size else -1, 4 if tag == b"jxlp" else 0
        self.kind = "codestream" if tag in CODESTREAM else "payload"
        if self.wanted == 0:
            self.kind = "boxes"


def boxes(files: DataFrame) -> DataFrame:
    """image_id, n, tag, at, size of the boxes of every file (image_id, content), up to the first one that can't be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist()):
                rows += [(image, *box) for box in Walk().feed(content or b"")]
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["image_id", "n", "tag", "at", "size"])

    return files.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(run, f"image_id long, {BOXES}")


class BoxProcessor(StatefulProcessor):
    """Chunks of a stream in any order, each of them once or several times; a timer ends a stream from which nothing comes any more."""

    def __init__(self, give_up_ms: int | None):
        self.give_up_ms = give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", STATE)
        self.early = handle.getMapState("early", "seq long", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, walk = 0, Walk()
        if self.place.exists():
            seq, *fields = self.place.get()
            walk = Walk(*fields)
        for frame in rows:
            for s, chunk in zip(frame["seq"], frame["chunk"]):
                if s >= seq:
                    self.early.updateValue((int(s),), (bytes(chunk),))
        found = []
        while self.early.containsKey((seq,)):
            found += walk.feed(bytes(self.early.getValue((seq,))[0]))
            self.early.removeKey((seq,))
            seq += 1
        self.place.update((seq, *astuple(walk)))
        if self.give_up_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.give_up_ms)
        yield self._frame(key[0], [("box", *box) for box in found] + [("progress", None, None, None, None)], walk)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        walk = Walk(*self.place.get()[1:]) if self.place.exists() else Walk()
        self.place.clear()
        self.early.clear()
        walk.kind = "abandoned"
        yield self._frame(key[0], [("progress", None, None, None, None)], walk)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(stream: int, events: list[tuple], walk: Walk) -> pd.DataFrame:
        rows = [(stream, *e, walk.received, walk.codestream, walk.kind) for e in events]
        frame = pd.DataFrame(rows, columns=["stream_id", "event", "n", "tag", "at", "size", "received", "codestream", "state"])
        return frame.astype({"n": "Int32", "at": "Int64", "size": "Int64"})


def arriving_boxes(chunks: DataFrame, give_up: str | None = None) -> DataFrame:
    """Events of containers that arrive in chunks (stream_id, seq from 0, chunk): each box once, and how far the stream is after each trigger.

    What is kept of a stream: its place, a header that is not complete, and chunks that
    came too early. ``give_up``: a stream that is silent for so long ends as ``abandoned``.
    Needs a state store with several column families (RocksDB).
    """
    wait = int(pd.Timedelta(give_up).total_seconds() * 1000) if give_up else None
    grouped = chunks.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "chunk").groupBy("stream_id")
    return grouped.transformWithStateInPandas(BoxProcessor(wait), outputStructType=STREAM, outputMode="Update", timeMode="ProcessingTime" if wait else "None")
