"""Substring dedup: words covered by a window of 20 words that starts earlier in the corpus.

The index of what has been seen is log-structured. It is a bucketed table whose
rows are window fingerprints (see slices.py: an anchor hash and a digest of the
windows that share it) with the place where each was first seen. A batch of
documents is exchanged into the ranges of the index and merge-joined there with
its sorted runs, which stay where they are: a fingerprint that a run or an
earlier place of the batch has is a repeat. The first places of new
fingerprints are appended as an immutable sorted run, one file a bucket. When
there are ``fan_in`` runs they are compacted into one, bucket by bucket. A
manifest beside the table says which runs are whole, so that another job can go
on from there. Fingerprints that share an anchor but differ are verified on the
words themselves, window by window; those with equal anchor and digest agree in
two 64-bit hashes of their words and are taken as equal.

In ``substring_dedup`` batches follow each other in doc_id order, so what the
index holds is earlier. Null texts have no words. A null doc_id takes no part
and is kept whole. Equal rows that share a doc_id are one place; different texts
with one doc_id are documents of their own, in the order of a hash.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.packed import Texts, pieces, sequence_hashes
from tessella.llm.slices import COLUMNS, JUDGED, RANGES, Layout, first_of, per_document, removed_units, settled, slice_contents, slice_rows, tag_of, verdicts, whole_slices
from tessella.llm.store import deleted, folder, small_batches, stored
from tessella.llm.suffixes import BATCH, _anchor_batches, ranges_of

U64 = np.uint64
LENGTH, GRAM = 20, 6
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def merged(key: tuple[pa.Scalar, ...], new: pa.Table, old: pa.Table) -> pa.Table:
    """Verdicts and news of one range: the batch's rows merged with those of the runs, which come first among equals."""
    x = {c: np.concatenate([t.column(c).to_numpy() for t in (old, new)]) for c in ("anchor", "digest", "doc_id", "at")}
    x["old"] = np.arange(len(x["anchor"])) < old.num_rows
    order = np.lexsort((x["at"], x["doc_id"], ~x["old"], x["digest"], x["anchor"]))
    x = {c: v[order] for c, v in x.items()}
    x["range"] = np.full(len(order), key[0].as_py())
    return pa.Table.from_batches(list(verdicts(x, (x["range"] & 1) == 1, True, news=True)), MERGED)


MERGED = pa.schema([("range", pa.int64()), ("kind", pa.int32()), *((c, pa.bool_() if c == "old" else pa.int64()) for c in COLUMNS), ("many", pa.bool_()), ("classes", pa.int32())])


class FingerprintIndex:
    """Sorted immutable runs of the first places of fingerprints, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout, buckets: int, fan_in: int = 4):
        self.spark, self.path, self.layout, self.buckets, self.fan_in = spark, path, layout, buckets, fan_in
        self.version, self.generation, self.runs, self.next = 0, 0, [], 0
        self._name = None

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its last manifest has it."""
        last = max((json.loads(r[0]) for r in spark.read.text(f"{path}/manifest/*").collect()), key=lambda m: m["version"])
        salts = np.ones(1 << 16, np.int32)
        for at, n in last["salts"]:
            salts[at] = n
        index = cls(spark, path, Layout(last["bits"], salts), last["buckets"], last["fan_in"])
        index.version, index.generation, index.runs, index.next = last["version"], last["generation"], last["runs"], last["next"]
        return index

    def _committed(self) -> None:
        self.version += 1
        salts = [[int(i), int(self.layout.salts[i])] for i in np.flatnonzero(self.layout.salts > 1)]
        text = json.dumps({"version": self.version, "generation": self.generation, "runs": self.runs, "next": self.next, "buckets": self.buckets, "fan_in": self.fan_in, "bits": self.layout.bits, "salts": salts})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version}")

    def _table(self) -> str:
        """The name of the table of the current generation in the session's catalog."""
        if self._name is None:
            self._name = f"fingerprints_{uuid.uuid4().hex}"
            columns = "run INT, range BIGINT, kind INT, anchor BIGINT, digest BIGINT, doc_id BIGINT, at BIGINT, old BOOLEAN, many BOOLEAN, classes INT"
            where = f"{self.path}/runs-{self.generation}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self._name} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (range) SORTED BY (range, anchor, digest) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self._name

    def _forgotten(self) -> None:
        if self._name is not None:
            self.spark.sql(f"DROP TABLE {self._name}")
            self._name = None

    def history(self) -> DataFrame:
        """The first places of all fingerprints of whole runs."""
        return self.spark.table(self._table()).where(F.col("kind") == 3).where(F.col("run").isin(self.runs)).select("range", "anchor", "digest", "doc_id", "at")

    def add(self, docs: DataFrame) -> DataFrame:
        """Judges a batch against the index and takes it in as a new run: rows JUDGED of kind 0 and 1, stored."""
        new = slice_rows(docs, True, LENGTH, GRAM, self.layout)
        rows = new.groupBy("range").cogroup(self.history().groupBy("range")).applyInArrow(merged, f"range long, {JUDGED}")
        run, self.next = self.next, self.next + 1
        with small_batches(self.spark):
            rows.select(F.lit(run).alias("run"), "range", "kind", *COLUMNS, "many", "classes").write.insertInto(self._table())
        here = self.spark.table(self._table()).where((F.col("run") == run) & (F.col("kind") < 3))
        found = stored(settled(here.select("kind", *COLUMNS, "many", "classes"), True))
        self.runs.append(run)
        self._committed()
        if len(self.runs) >= self.fan_in:
            self.compact()
        return found

    def compact(self) -> None:
        """All runs as one, in a new generation of the table; its buckets are those of the runs, so rows stay in place."""
        one = self.history().groupBy("range", "anchor", "digest").agg(F.min(F.struct("doc_id", "at")).alias("m"))
        run, self.next = self.next, self.next + 1
        rows = one.select(F.lit(run).alias("run"), "range", F.lit(3).alias("kind"), "anchor", "digest", "m.doc_id", "m.at", F.lit(False).alias("old"), F.lit(False).alias("many"), F.lit(0).alias("classes"))
        before, name = f"{self.path}/runs-{self.generation}", self._name
        self._name, self.generation = None, self.generation + 1
        rows.write.insertInto(self._table())
        self.runs = [run]
        self._committed()
        self.spark.sql(f"DROP TABLE {name}")
        deleted(self.spark, before)

    def dropped(self) -> None:
        """Deletes the index."""
        self._forgotten()
        deleted(self.spark, self.path)


def _window_names(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of ``length`` words, the same for the same words: names of 2, 4, 8, ... words from pairs of names."""
    name, span = ids, 1
    pair = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
    while 2 * span <= length:
        name, span = pair(name[:-span], name[span:]), 2 * span
    rest = length - span
    return pair(name[:-rest], name[rest:]) if rest else name


def later_windows(content: list[bytes], anchor: np.ndarray, doc_id: np.ndarray, at: np.ndarray, old: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each slice: which of its windows have the words of an earlier window."""
    lines = [c.split() for c in content]
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for line in lines for w in line], np.int64)
    words = np.fromiter(map(len, lines), np.int64, len(lines))
    base = np.concatenate([[0], np.cumsum(words)])
    count = words - length + 1
    owner = np.repeat(np.arange(len(words)), count)
    shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    key = _window_names(ids, length)[base[owner] + shift]
    place = first_of(at)[owner] + shift
    # texts with one doc_id are told apart by their tags
    ids, tag = doc_id[owner], tag_of(at)[owner]
    order = np.lexsort((place, tag, ids, ~old[owner], key))
    k, p, d, g = key[order], place[order], ids[order], tag[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    head = np.repeat(head, np.diff(np.append(head, len(k))))
    out = np.zeros(len(owner), bool)
    out[order] = (d != d[head]) | (p != p[head]) | (g != g[head])
    out &= ~old[owner]
    return np.split(out, np.cumsum(count)[:-1])


def _compare(batches):
    for table in _anchor_batches(batches, ("anchor",)):
        flags = later_windows(table.column("content").to_pylist(), *(table.column(c).to_numpy() for c in ("anchor", "doc_id", "at", "old")))
        yield ranges_of(table, flags, LENGTH)


def _window_rows(batches):
    """Every window of a crowded anchor's slices by its hash."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            content = part.column("content").to_pylist()
            t = Texts(pa.array([b" ".join(content)], pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
            words = np.fromiter((c.count(b" ") + 1 for c in content), np.int64, len(content))
            base = np.concatenate([[0], np.cumsum(words)])
            count = words - LENGTH + 1
            owner = np.repeat(np.arange(len(words)), count)
            shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = base[owner] + shift
            key = sequence_hashes(t.word_hashes(), start, start + LENGTH)
            low = shift + first_of(part.column("at").to_numpy())[owner]
            tag = tag_of(part.column("at").to_numpy())[owner].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part.column("anchor").to_numpy()[owner]), pa.array(key.view(np.int64)), pa.array(part.column("doc_id").to_numpy()[owner]), pa.array(tag), pa.array(low), pa.array(part.column("old").to_numpy(zero_copy_only=False)[owner])], names=["anchor", "key", "doc_id", "tag", "low", "old"])


def _kept(batches):
    for batch in batches:
        for part in pieces(batch):
            t = Texts(part.column("text"))
            gone = removed_units(part, t, t.first)
            removed, digest = [], []
            raw = t.raw.tobytes()
            for i in range(t.n):
                words = raw[t.offsets[i] : t.offsets[i + 1]].split()
                flags = gone[t.first[i] : t.first[i + 1]]
                removed.append(int(flags.sum()))
                if removed[-1]:
                    words = [words[j] for j in np.flatnonzero(~flags).tolist()]
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(t.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(docs: DataFrame, batches: int = 5) -> DataFrame:
    """RANGES of words covered by a window that starts earlier, taking ``docs`` in as so many batches in doc_id order."""
    spark = docs.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the first batch holds most of the corpus; the others come to it as news does
    cuts = docs.agg(F.percentile_approx("doc_id", [1 - i / (4 * batches) for i in range(batches - 1, 0, -1)] or [1.0], 1000)).first()[0] or []
    cuts = sorted(set(cuts[: batches - 1]))
    index = FingerprintIndex(spark, folder(spark), Layout.planned(docs, True, LENGTH, GRAM, partitions), partitions)
    found = None
    for i in range(len(cuts) + 1):
        own = docs
        if i:
            own = own.where(F.col("doc_id") > cuts[i - 1])
        if i < len(cuts):
            own = own.where(F.col("doc_id") <= cuts[i])
        judged_now = index.add(own)
        found = judged_now if found is None else found.unionByName(judged_now)
    index.dropped()
    contested = found.where("kind = 1").groupBy("anchor", "digest", "doc_id", "at").agg(F.min("old").alias("old"), F.max("classes").alias("classes"), F.lit(False).alias("many"))
    contents = slice_contents(contested, docs, True, LENGTH, GRAM)
    contents = stored(contents.repartition(partitions, F.when(F.col("classes") <= BATCH, F.col("anchor")).otherwise(F.xxhash64("anchor", "doc_id", "at"))).sortWithinPartitions("anchor"))
    compared = contents.where(F.col("classes") <= BATCH).mapInArrow(_compare, RANGES)
    windows = contents.where(F.col("classes") > BATCH).mapInArrow(_window_rows, "anchor long, key long, doc_id long, tag int, low long, old boolean")
    # the order of later_windows: what is old, then by doc_id, text and place
    place = F.struct((~F.col("old")).alias("new"), "doc_id", "tag", "low")
    first = windows.groupBy("anchor", "key").agg(F.min(place).alias("m"), F.count("*").alias("n")).where("n > 1")
    crowded = windows.join(first, ["anchor", "key"]).where(~F.col("old") & (place != F.col("m"))).select("doc_id", "tag", "low", (F.col("low") + LENGTH).alias("high"))
    return whole_slices(found, LENGTH).unionByName(compared).unionByName(crowded)


def substring_dedup(docs: DataFrame, batches: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    ranges = per_document(repeated_ranges(docs, batches))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ranges, "doc_id", "left")
    return both.select("doc_id", "text", "ranges").mapInArrow(_kept, RESULT)
