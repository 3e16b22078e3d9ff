"""Repeated windows of a fixed length, found through a few positions per document.

The units of a text are its bytes or its words. Every window of ``length``
units has one anchor: the k-unit gram in it with the smallest hash, the
leftmost if several tie. Which position that is depends on the window's content
only, so equal windows have equal anchors at equal places. Neighbouring windows
mostly share their anchor; a maximal run of windows with one anchor position is
a slice, on average about half as many windows as there are grams in a window.

If two slices have the same units (the same digest), all their windows are
equal. If an anchor occurs in slices with different digests, those slices may
still share some windows; such contested slices are compared window by window.
Every window of every text is in exactly one slice, so nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.packed import Texts, mix, pieces, sequence_hashes, window_starts

U64 = np.uint64
ROWS = "range long, anchor long, digest long, doc_id long, at long"
#: ``at`` holds the number of windows of a slice in its low bits, above them its first window,
#: and on top a few bits of the text's hash, which tell texts of one doc_id apart.
COUNT_BITS, FIRST_BITS, TAG_BITS = 12, 36, 15
#: Windows of which the anchors are sought together; their places fit into 24 bits.
STRETCH = 1 << 23


def first_of(at: np.ndarray) -> np.ndarray:
    """First window of slices."""
    return (at >> COUNT_BITS) & ((1 << FIRST_BITS) - 1)


def count_of(at: np.ndarray) -> np.ndarray:
    """Number of windows of slices."""
    return at & ((1 << COUNT_BITS) - 1)


def tag_of(at: np.ndarray) -> np.ndarray:
    """The bits of the text's hash."""
    return at >> (COUNT_BITS + FIRST_BITS)


def text_tags(t: Texts) -> np.ndarray:
    return (t.hash_ranges(t.offsets[:-1], t.offsets[1:]) >> U64(64 - TAG_BITS)).astype(np.int64)


class Units:
    """Bytes or words of a few texts, with hashes of ranges of them."""

    def __init__(self, texts: pa.Array, words: bool):
        self.texts = Texts(texts)
        self.words = words
        self.first = self.texts.first if words else self.texts.offsets
        self._symbols = self.texts.word_hashes() if words else None
        self.size = len(self._symbols) if words else len(self.texts.data)

    def hash(self, a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
        if self.words:
            return sequence_hashes(self._symbols, a, b, seed)
        return mix(self.texts.hash_ranges(a, b) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


def smallest_grams(u: Units, begin: int, end: int, length: int, k: int) -> np.ndarray:
    """Position of the anchor of every window that starts in ``begin`` to ``end``; at most 2^24 - length windows."""
    span = length - k + 1
    at = np.arange(begin, end + span - 1)
    # the place in this stretch in the low bits
    low = (u.hash(at, at + k) & U64(0xFFFFFFFFFF000000)) | (at - begin).astype(U64)
    # minimum over the grams of each window, by doubling
    reach = 1
    while 2 * reach <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    rest = span - reach
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & U64(0xFFFFFF)).astype(np.int64) + begin


def cut(u: Units, length: int, k: int, stretch: int = STRETCH):
    """(document, first window, number of windows, anchor position) of each slice; positions count over the whole piece.

    stretch: so many windows are looked at together; where a stretch ends doesn't change the anchors.
    """
    starts, doc = window_starts(u.first, length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    windows = u.size - length + 1
    anchor = np.concatenate([smallest_grams(u, b, min(b + stretch, windows), length, k) for b in range(0, windows, stretch)])[starts]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], starts[new], np.diff(np.append(new, len(starts))), anchor[new]


class Layout:
    """Ranges of anchors, by the leading bits of their hash. All rows of a range meet in one task.

    A range with a frequent anchor is salted: its rows are dealt by their own hash, and
    what meets there is settled in a second step. ``salts``: parts of the ranges by their first
    16 bits. A range id ends in 1 if its anchors may go on in another range.
    """

    def __init__(self, bits: int, salts: np.ndarray):
        self.bits, self.salts = bits, salts

    def ranges(self, anchor: np.ndarray, digest: np.ndarray, doc_id: np.ndarray, at: np.ndarray) -> np.ndarray:
        # anchors are smallest hashes, so their leading bits are mostly zeros
        a = mix(anchor.view(U64) + U64(0x9E3779B97F4A7C15))
        parts = self.salts[(a >> U64(48)).astype(np.int64)]
        salt = mix(digest.view(U64) + mix(doc_id.view(U64) + mix(at.view(U64)))) % parts.astype(U64)
        return ((a >> U64(64 - self.bits)).astype(np.int64) << 20) + (salt.astype(np.int64) << 1) + (parts > 1)

    @classmethod
    def planned(cls, docs: DataFrame, words: bool, length: int, k: int, partitions: int, one_of: int = 64, most: int = 1 << 18) -> Layout:
        """For the slices of ``docs``, from the counts of those of every 64th document (by a hash of its id).

        The sample decides where rows meet, not what is found.
        """
        seen = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(one_of)) == 0)
        plain = cls(16, np.ones(1 << 16, np.int32))
        counted = slice_rows(seen, words, length, k, plain).groupBy(F.shiftright("range", 20).cast("int").alias("first")).count().toArrow()
        rows = np.zeros(1 << 16)
        rows[counted.column("first").to_numpy()] = counted.column("count").to_numpy() * one_of
        share = min(most, max(1.0, rows.sum() / (4 * partitions)))
        bits = min(40, int(np.ceil(np.log2(max(4 * rows.sum() / share, 16 * partitions)))))
        # ranges by 16 bits hold this much without frequent anchors
        usual = max(share, rows.mean())
        return cls(bits, np.minimum(np.ceil(np.maximum(rows, 1) / (2 * usual)), 1 << 18).astype(np.int32))


def slice_rows(docs: DataFrame, words: bool, length: int, k: int, layout: Layout) -> DataFrame:
    """A row for each slice of each document (doc_id, text): range, anchor and digest hashes, doc_id, and ``at``."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, budget=1 << 19):
                u = Units(part.column("text"), words)
                doc, first, count, anchor = cut(u, length, k)
                keys = u.hash(anchor, anchor + k).view(np.int64)
                digest = (u.hash(first, first + count - 1 + length, 7) + (anchor - first).astype(U64)).view(np.int64)
                at = (text_tags(u.texts)[doc] << (COUNT_BITS + FIRST_BITS)) | ((first - u.first[doc]) << COUNT_BITS) | count
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                ranges = layout.ranges(keys, digest, ids, at)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ranges, keys, digest, ids, at)], names=["range", "anchor", "digest", "doc_id", "at"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").mapInArrow(run, ROWS)


#: kind 0: a slice whose windows all start elsewhere (or earlier); 1: a slice to compare
#: window by window; 2: the first row of a class whose anchor may go on in another
#: range, with the rows that the class has here in ``classes``; 3: the first row of a class
#: that history doesn't have here.
JUDGED = "kind int, anchor long, digest long, doc_id long, at long, old boolean, many boolean, classes int"


def judge(rows: dict[str, np.ndarray], earlier: bool):
    """Verdicts over whole anchor groups of rows sorted by (anchor, digest, old first, doc_id, at): (row indices removed, indices of contested slices, is its class repeated, classes of its anchor)."""
    anchor, digest, old = rows["anchor"], rows["digest"], rows["old"]
    n = len(anchor)
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_class = new_anchor | np.append(True, digest[1:] != digest[:-1])
    start = np.flatnonzero(new_class)
    size = np.diff(np.append(start, n))
    group = np.cumsum(new_anchor) - 1
    classes = np.bincount(group[start])[group[start]]
    if earlier:
        # the first of a class stays; rows at the very same place are one
        head = np.repeat(start, size)
        gone = ~((rows["doc_id"] == rows["doc_id"][head]) & (rows["at"] == rows["at"][head])) & ~old
    else:
        gone = np.repeat(size > 1, size) & ~old
    contested = start[classes > 1]
    return np.flatnonzero(gone), contested, size[classes > 1] > 1, classes[classes > 1]


def _sorted_groups(batches, columns, most: int = 1 << 20):
    """Runs of whole groups of one range and anchor from a sorted partition, and for each row a mark: does its anchor go on elsewhere.

    Such are the anchors of salted ranges, and one with more than ``most`` rows, which is
    handed out in several runs. All its rows have the mark.
    """
    held, cut = None, None

    def marked(x):
        edge = (x["range"] & 1) == 1
        return x, edge if cut is None else edge | ((x["range"] == cut[0]) & (x["anchor"] == cut[1]))

    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in columns}
        n = len(held["anchor"])
        if not n:
            continue
        last = (held["range"][-1], held["anchor"][-1])
        other = np.flatnonzero((held["range"] != last[0]) | (held["anchor"] != last[1]))
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield marked({c: x[:end] for c, x in held.items()})
            held = {c: x[end:] for c, x in held.items()}
        if n - end > most or cut == last:
            cut = last
            yield marked(held)
            held = None
    if held is not None and len(held["anchor"]):
        yield marked(held)


COLUMNS = ("anchor", "digest", "doc_id", "at", "old")


def verdicts(x: dict[str, np.ndarray], edge: np.ndarray, earlier: bool, news: bool = False):
    """JUDGED rows, with their range, for sorted whole groups; news: also those of kind 3."""

    def rows_of(kind, y, i, many, classes):
        n = len(i)
        return pa.RecordBatch.from_arrays([pa.array(y["range"][i]), pa.array(np.full(n, kind, np.int32)), *(pa.array(y[c][i], pa.bool_() if c == "old" else pa.int64()) for c in COLUMNS), pa.array(many, pa.bool_()), pa.array(classes, pa.int32())], names=["range", "kind", *COLUMNS, "many", "classes"])

    for part in (~edge, edge):
        if not part.any():
            continue
        y = x if part.all() else {c: v[part] for c, v in x.items()}
        gone, contested, many, classes = judge(y, earlier)
        none = lambda i, v: np.full(len(i), v)
        yield rows_of(0, y, gone, none(gone, False), none(gone, 0))
        turn = (y["anchor"][1:] != y["anchor"][:-1]) | (y["digest"][1:] != y["digest"][:-1])
        first = np.flatnonzero(np.append(True, turn))
        if part is edge:
            yield rows_of(2, y, first, none(first, False), np.diff(np.append(first, len(y["anchor"]))))
        else:
            yield rows_of(1, y, contested, many, classes)
        if news:
            new = first[~y["old"][first]]
            yield rows_of(3, y, new, none(new, False), none(new, 0))


def judged(rows: DataFrame, earlier: bool, partitions: int) -> DataFrame:
    """Verdicts for slices of ``rows`` (ROWS, placed by a layout), as JUDGED.

    Ranges are dealt by hash and sorted; what is equal within a range is settled there.
    """

    def run(batches):
        for x, edge in _sorted_groups(batches, ("range", *COLUMNS)):
            for out in verdicts(x, edge, earlier):
                yield out.drop_columns(["range"])

    order = ("range", "anchor", "digest", "doc_id", "at")
    return rows.withColumn("old", F.lit(False)).repartition(partitions, "range").sortWithinPartitions(*order).mapInArrow(run, JUDGED)


def settled(found: DataFrame, earlier: bool) -> DataFrame:
    """Rows of kind 0 and 1 only: those of kind 2, one for each class and range, are settled among themselves."""
    edge = found.where("kind = 2")
    classes = edge.groupBy("anchor", "digest").agg(F.min(F.struct((~F.col("old")).alias("new"), "doc_id", "at", "old")).alias("m"), F.sum("classes").alias("n"))
    per_anchor = classes.groupBy("anchor").agg(F.count("*").cast("int").alias("n_classes"))
    marked = edge.select("anchor", "digest", "doc_id", "at", "old").join(classes, ["anchor", "digest"])
    here = (F.col("doc_id") == F.col("m.doc_id")) & (F.col("at") == F.col("m.at"))
    gone = marked.where(~F.col("old") & (~here if earlier else F.col("n") > 1))
    gone = gone.select(F.lit(0).alias("kind"), "anchor", "digest", "doc_id", "at", "old", F.lit(False).alias("many"), F.lit(0).alias("classes"))
    contested = classes.join(per_anchor.where("n_classes > 1"), "anchor").select(F.lit(1).alias("kind"), "anchor", "digest", "m.doc_id", "m.at", "m.old", (F.col("n") > 1).alias("many"), F.col("n_classes").alias("classes"))
    return found.where("kind < 2").unionByName(gone).unionByName(contested)


SLICE = "anchor long, doc_id long, at long, old boolean, many boolean, classes int, place int, content binary"


def slice_contents(contested: DataFrame, docs: DataFrame, words: bool, length: int, k: int) -> DataFrame:
    """The contested slices with their bytes (words: joined by one space) and the place of the anchor in them."""
    wanted = contested.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "old", "many", "classes")).alias("slices"))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").join(wanted, "doc_id")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                u = Units(part.column("text"), words)
                lists = part.column("slices")
                flat = lists.flatten()
                at = flat.field("at").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                first = u.first[doc] + first_of(at)
                last = first + count_of(at) - 1 + length
                # slices of another text with this doc_id are not in this one
                mine = np.flatnonzero((tag_of(at) == text_tags(u.texts)[doc]) & (last <= u.first[doc + 1]))
                flat, first, last = flat.take(pa.array(mine)), first[mine], last[mine]
                keys = flat.field("anchor").to_numpy(zero_copy_only=False)
                # the anchor's place: the gram with its hash, leftmost among those of every window
                grams = u.hash(np.arange(max(u.size - k + 1, 0)), np.arange(max(u.size - k + 1, 0)) + k).view(np.int64)
                place = np.full(len(mine), -1, np.int32)
                raw = u.texts.raw.tobytes()
                content = []
                low, high = (u.texts.starts[first], u.texts.ends[last - 1]) if words else (first, last)
                for i in range(len(mine)):
                    here = np.flatnonzero(grams[first[i] : last[i] - k + 1] == keys[i])
                    place[i] = here[0] if len(here) else -1
                    s = raw[low[i] : high[i]]
                    content.append(b" ".join(s.split()) if words else s)
                ids = np.asarray(part.column("doc_id"))[doc[mine]]
                out = pa.RecordBatch.from_arrays([flat.field("anchor"), pa.array(ids, pa.int64()), *(flat.field(c) for c in ("at", "old", "many", "classes")), pa.array(place), pa.array(content, pa.binary())], names=["anchor", "doc_id", "at", "old", "many", "classes", "place", "content"])
                yield out.filter(pa.array(place >= 0))

    return both.select("doc_id", "text", "slices").mapInArrow(run, SLICE)


#: Removed units of a document, half-open ranges, and the tag of its text.
RANGES = "doc_id long, tag int, low long, high long"


def first_column() -> Column:
    """First window of a slice, from the column ``at``."""
    return F.shiftright("at", COUNT_BITS).bitwiseAND((1 << FIRST_BITS) - 1)


def tag_column() -> Column:
    return F.shiftright("at", COUNT_BITS + FIRST_BITS).cast("int")


def whole_slices(found: DataFrame, length: int) -> DataFrame:
    """RANGES of the slices of kind 0."""
    count = F.col("at").bitwiseAND((1 << COUNT_BITS) - 1)
    return found.where("kind = 0").select("doc_id", tag_column().alias("tag"), first_column().alias("low"), (first_column() + count - 1 + length).alias("high"))


def per_document(ranges: DataFrame) -> DataFrame:
    """One row for each document: its ranges as a list (no longer than the document has windows)."""
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "low", "high")).alias("ranges"))


def removed_units(part: pa.RecordBatch, t: Texts, bounds: np.ndarray) -> np.ndarray:
    """Flags over all units of a piece from its column ``ranges``; ``bounds``: where each document's units begin."""
    lists = part.column("ranges").fill_null([])
    flat = lists.flatten()
    doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    mine = flat.field("tag").to_numpy(zero_copy_only=False) == text_tags(t)[doc]
    doc = doc[mine]
    low, high = (np.minimum(flat.field(c).to_numpy(zero_copy_only=False)[mine] + bounds[doc], bounds[doc + 1]) for c in ("low", "high"))
    size = int(bounds[-1])
    edge = np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0
