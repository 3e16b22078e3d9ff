"""Suffix-array dedup: bytes covered by a string of 200 bytes that also starts elsewhere.

Suffix arrays are built by linear grouping. Suffixes start in groups by first
symbol. Groups are taken in descending order; each suffix of a group points to
the nearest position before it whose group is smaller, and the suffixes pointed
at leave their group for a new one right above it, the more pointers the
higher. In the end a group holds the suffixes with one longest Lyndon prefix.
A second pass over the growing array writes each group's order: a suffix, once
placed, places those before it that point past it. No names, no recursion.

At scale: all windows of 200 bytes are grouped into slices (see slices.py), which
are the bounded texts that suffix arrays are built over. Equal slices are one,
with a multiplicity. Slices that share an anchor go to one batch. There they
are laid out as symbols of 24 bytes, aligned to the anchor and numbered in
lexical order, so that the suffix array of the symbols has the order of the
byte strings. The common prefix of neighbours in the array is counted in bytes.
A window begins less than a symbol before one of these suffixes: it occurs
twice if another suffix in the unbroken stretch of the array, whose common
prefixes reach the window's end, has the same bytes before it.

An anchor with more slices than a batch holds is split by the bytes around it:
windows that begin within 8 bytes of each other share 193 bytes, which make the
anchor of a shorter slice; what is still crowded is split into single windows,
and equal ones are one again. All parts go through the same suffix arrays.

Null texts are empty. A null doc_id takes no part and is kept whole. Rows that
share a doc_id count as separate places, also with different texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.packed import Texts, mix, pieces
from tessella.llm.slices import COUNT_BITS, RANGES, Layout, first_column, first_of, judged, per_document, removed_units, settled, slice_contents, slice_rows, tag_column, tag_of, whole_slices
from tessella.llm.store import stored

U64 = np.uint64
LENGTH, GRAM, SYMBOL = 200, 64, 24
#: Slices of one anchor that a batch may hold; windows of a crowded anchor that stay together, step by step.
BATCH, STEPS = 8_192, (8, 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes of a sequence of non-negative integers in lexical order."""
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)
    where, start, size = [0] * n, [0] * n, [0] * (n + 1)  # place in order; group of a suffix; members of a group
    group, last = 0, None
    for i, s in enumerate(order):
        if text[s] != last:
            group, last = i, text[s]
        where[s], start[s] = i, group
        size[group] += 1
    before = [-1] * n
    end = n
    while end > 0:
        g = start[order[end - 1]]
        members = sorted(order[g:end]) if end - g > 1 else order[g:end]
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and start[p] >= g:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = g
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for p, c in pointed.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[c]:
                moved.setdefault(start[p], []).append(p)
            for old, ps in moved.items():
                k = len(ps)
                if k == size[old]:
                    continue  # all of the group: it stays as it is
                top = old + size[old]
                new = top - k
                # the members that leave change places with those at the end
                leaving = set(ps)
                stay = [q for q in order[new:top] if q not in leaving]
                for p in ps:
                    if where[p] < new:
                        q = stay.pop()
                        i, j = where[p], where[q]
                        order[i], order[j], where[p], where[q] = q, p, j, i
                for p in ps:
                    start[p] = new
                size[old] -= k
                size[new] = k
    # order of each group, from the smallest suffix on
    free = {}
    out = [-1] * n
    placed = bytearray(n)
    first = [s for s in _sentinel_chain(before, n)]
    for p in first:
        at = free.get(start[p], start[p])
        out[at], placed[p], free[start[p]] = p, 1, at + 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = start[p]
            at = free.get(g, g)
            out[at], placed[p], free[g] = p, 1, at + 1
            p = before[p]
    return out


def _sentinel_chain(before: list[int], n: int):
    """The suffixes that the end of the text, smaller than any symbol, places first."""
    p = n - 1
    while p >= 0:
        yield p
        p = before[p]


def _words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of 24 bytes as three numbers each, whose order is that of the bytes."""
    wide = np.ascontiguousarray(rows).view(">u8")
    return [wide[:, i].astype(U64) for i in range(wide.shape[1])]


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Number of each row among the distinct rows in lexical order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def common_prefixes(data: np.ndarray, begin: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, ``most`` at most; 0 for the first."""
    out = np.zeros(len(begin), np.int64)
    reach = np.arange(most)
    for low in range(1, len(begin), 1 << 14):
        i = np.arange(low, min(low + (1 << 14), len(begin)))
        lines = [data[np.minimum(begin[j][:, None] + reach, len(data) - 1)] for j in (i - 1, i)]
        differ = lines[0] != lines[1]
        first = np.where(differ.any(1), differ.argmax(1), most)
        out[i] = np.minimum(first, np.minimum(room[i - 1], room[i]))
    return out


def repeated_windows(content: list[bytes], place: np.ndarray, many: np.ndarray, length: int = LENGTH, g: int = SYMBOL) -> list[np.ndarray]:
    """For each slice: which of its windows occur in another slice, or in a repeated slice.

    place: the anchor's place in each slice; equal windows have it at the same distance.
    """
    size = np.fromiter(map(len, content), np.int64, len(content))
    base = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(content), np.uint8)
    # symbols: blocks of g bytes at the anchor and at multiples of g from it; zeros fill up the last one, which comes before a block with as many zero bytes
    offset = place % g
    blocks = np.maximum(-(-(size - offset) // g), 0)
    which = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = base[which] + offset[which] + number * g
    at = begin[:, None] + np.arange(g)
    room = base[which + 1] - begin
    names = _ranks([*_words_of(np.where(np.arange(g) < room[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)), np.minimum(room, g)])
    # one text with an end mark of its own after each slice, smaller than all symbols
    ends = np.cumsum(blocks + 1) - 1
    text = np.empty(len(which) + len(size), np.int64)
    text[ends] = np.arange(len(size))
    text[np.arange(len(which)) + which] = names + len(size)
    block = np.full(len(text), -1)
    block[np.arange(len(which)) + which] = np.arange(len(which))
    order = block[np.array(suffix_array(text.tolist()), np.int64)]
    # suffixes long enough to hold the rest of a window, in lexical order
    order = order[order >= 0]
    order = order[room[order] > length - g]
    begin, room, which = begin[order], room[order], which[order]
    prefix = common_prefixes(data, begin, room, length)
    # the g bytes before each suffix, the nearest last
    back = begin[:, None] - np.arange(g, 0, -1)
    before = _words_of(np.where(back >= base[which][:, None], data[np.maximum(back, 0)], 0).astype(np.uint8))
    windows = size - length + 1
    start = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    for lead in range(g):
        # windows that begin so many bytes before a suffix
        shift = begin - base[which] - lead
        here = (shift >= 0) & (shift < windows[which])
        stretch = np.cumsum(prefix < length - lead)
        i = np.flatnonzero(here)
        i = i[np.bincount(stretch[i], minlength=1)[stretch[i]] > 1] if len(i) else i
        if not len(i):
            continue
        keep = [min(max(lead - 8 * (2 - w), 0), 8) for w in range(3)]
        columns = [stretch[i].astype(U64)] + [before[w][i] & U64((1 << 8 * keep[w]) - 1) for w in range(3) if keep[w]]
        same = _ranks(columns)
        out[(start[which] + shift)[i[np.bincount(same)[same] > 1]]] = True
    out |= np.repeat(many, windows)
    return np.split(out, np.cumsum(windows)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _anchor_batches(batches, columns, budget: int = 1 << 21):
    """Whole anchor groups from a partition sorted by anchor, some megabytes at a time."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            size += part.nbytes
            if size > budget:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column("anchor").to_numpy()
                end = int(np.searchsorted(anchor, anchor[-1]))
                if end:
                    yield table.slice(0, end)
                    held = table.slice(end).to_batches()
                    size = sum(b.nbytes for b in held)
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def ranges_of(table: pa.Table, flags: list[np.ndarray], length: int) -> pa.RecordBatch:
    """RANGES of the flagged windows of each slice."""
    ids, at = (table.column(c).to_numpy() for c in ("doc_id", "at"))
    first, tags = first_of(at), tag_of(at)
    doc, tag, low, high = [], [], [], []
    for i, f in enumerate(flags):
        if f.any():
            a, b = _runs(f)
            doc += [ids[i]] * len(a)
            tag += [tags[i]] * len(a)
            low += (a + first[i]).tolist()
            high += (b + first[i] - 1 + length).tolist()
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["doc_id", "tag", "low", "high"])


def _flags(table: pa.Table) -> list[np.ndarray]:
    return repeated_windows(table.column("content").to_pylist(), table.column("place").to_numpy().astype(np.int64), table.column("many").to_numpy(zero_copy_only=False))


def _compare(batches):
    for table in _anchor_batches(batches, ("anchor",)):
        yield ranges_of(table, _flags(table), LENGTH)


def _compare_classes(batches):
    """Runs of repeated windows of each class: their first and last, from the first of the slice on."""
    for table in _anchor_batches(batches, ("anchor",)):
        flags = _flags(table)
        runs = [_runs(f) for f in flags]
        which = pa.array(np.repeat(np.arange(len(runs)), [len(a) for a, _ in runs]))
        low, high = (np.concatenate([r[j] for r in runs]).astype(np.int64) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(which) for c in ("anchor", "digest")] + [pa.array(low), pa.array(high - 1 + LENGTH)], names=["anchor", "digest", "low", "high"])


PART = "anchor long, digest long, doc_id long, at long, many boolean, place int, content binary"


def narrowed(step: int):
    """A kernel that splits slices: windows that begin within ``step`` bytes, counted from the anchor, stay together.

    The bytes that they share are the anchor of the part.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                content = part.column("content").to_pylist()
                size = np.fromiter(map(len, content), np.int64, len(content))
                base = np.concatenate([[0], np.cumsum(size)])
                t = Texts(pa.array([b"".join(content)], pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
                count = size - LENGTH + 1
                owner = np.repeat(np.arange(len(size)), count)
                shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                place = part.column("place").to_numpy().astype(np.int64)
                group = (place[owner] - shift) // step
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])))
                own, first, many = owner[new], shift[new], np.diff(np.append(new, len(owner)))
                # what all windows of the group have, whether or not the slice has all of them
                core = place[own] - group[new] * step
                a = base[own] + core
                shared = t.hash_ranges(a, a + LENGTH - step + 1)
                anchor = mix(part.column("anchor").to_numpy()[own].view(U64) + mix(shared + group[new].astype(U64)))
                begin = base[own] + first
                digest = mix(t.hash_ranges(begin, begin + many - 1 + LENGTH) + (core - first).astype(U64))
                at = part.column("at").to_numpy()[own]
                at = (at >> COUNT_BITS << COUNT_BITS) + (first << COUNT_BITS) + many
                pieces_ = [content[o][f : f + m - 1 + LENGTH] for o, f, m in zip(own.tolist(), first.tolist(), many.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), part.column("doc_id").take(pa.array(own)), pa.array(at), part.column("many").take(pa.array(own)), pa.array((core - first).astype(np.int32)), pa.array(pieces_, pa.binary())], names=["anchor", "digest", "doc_id", "at", "many", "place", "content"])

    return run


def _crowded(rows: DataFrame, partitions: int) -> list[DataFrame]:
    """RANGES of the repeated windows of crowded anchors, by shorter and shorter parts."""
    out = []
    for step in STEPS:
        parts = stored(rows.mapInArrow(narrowed(step), PART))
        classes = parts.groupBy("anchor", "digest").agg(F.min(F.struct("place", "content")).alias("m"), F.count("*").alias("n"), F.max("many").alias("any_many"))
        classes = stored(classes.select("anchor", "digest", "m.place", "m.content", (F.col("any_many") | (F.col("n") > 1)).alias("many")))
        full = classes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BATCH).select("anchor")
        fine = classes.join(full, "anchor", "left_anti").repartition(partitions, "anchor").sortWithinPartitions("anchor")
        found = fine.mapInArrow(_compare_classes, "anchor long, digest long, low long, high long")
        out.append(parts.select("anchor", "digest", "doc_id", tag_column().alias("tag"), first_column().alias("first")).join(found, ["anchor", "digest"]).select("doc_id", "tag", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")))
        if step == 1 or full.isEmpty():
            break
        rows = parts.join(full, "anchor", "left_semi").select("anchor", "doc_id", "at", "many", "place", "content")
    return out


def _kept(batches):
    for batch in batches:
        for part in pieces(batch):
            t = Texts(part.column("text"))
            gone = removed_units(part, t, t.offsets)
            removed, spans, digest = [], [], []
            for i in range(t.n):
                a, b = t.offsets[i], t.offsets[i + 1]
                flags = gone[a:b]
                removed.append(int(flags.sum()))
                spans.append(int(flags[:1].sum()) + int(np.count_nonzero(flags[1:] & ~flags[:-1])))
                digest.append(hashlib.sha256(t.raw[a:b][~flags].tobytes() if removed[-1] else t.raw[a:b].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(t.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """RANGES of bytes covered by a string of 200 bytes that starts at two places or more."""
    spark = docs.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    layout = Layout.planned(docs, False, LENGTH, GRAM, partitions)
    found = stored(judged(slice_rows(docs, False, LENGTH, GRAM, layout), False, partitions))
    found = settled(found, False)
    contents = slice_contents(found.where("kind = 1"), docs, False, LENGTH, GRAM)
    contents = stored(contents.repartition(partitions, F.when(F.col("classes") <= BATCH, F.col("anchor")).otherwise(F.xxhash64("anchor", "doc_id", "at"))).sortWithinPartitions("anchor"))
    ranges = whole_slices(found, LENGTH).unionByName(contents.where(F.col("classes") <= BATCH).mapInArrow(_compare, RANGES))
    crowded = contents.where(F.col("classes") > BATCH).select("anchor", "doc_id", "at", "many", "place", "content")
    if not crowded.isEmpty():
        for more in _crowded(crowded, partitions):
            ranges = ranges.unionByName(more)
    return ranges


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    ranges = per_document(repeated_ranges(docs))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ranges, "doc_id", "left")
    return both.select("doc_id", "text", "ranges").mapInArrow(_kept, RESULT)
