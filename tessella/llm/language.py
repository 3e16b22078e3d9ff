"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3
characters, lower case, runs of anything but letters as one space) in rank
order. Profiles of languages come from all learning documents. A text gets the
language whose profile has the smallest out-of-place distance: the sum over the
text's own most frequent n-grams of how far their rank is from the rank in the
profile, with the profile's length for n-grams that it lacks.

score: 1 less the distance as a share of the largest possible one.
A null text and a text without letters give ``und`` with score 0; so does
everything if there is nothing to learn from. Ties between languages go to the
name that sorts first, ties between n-grams to a fixed order of their hashes.
Rows are judged one by one, so repeated rows are no matter.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.packed import mix, pieces

U64 = np.uint64
PROFILE = 400
RESULT = "doc_id long, lang_pred string, score double"


@functools.lru_cache(1)
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, their documents, whether each document has a letter)."""
    strings = texts.fill_null("").to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    # each document stands between two separators
    n = len(strings)
    total = len(points) + n + 1
    at = np.arange(len(points)) + np.repeat(np.arange(n) + 1, sizes)
    letters, doc = np.zeros(total, np.uint32), np.zeros(total, np.int64)
    letters[at] = _folding()[points]
    ends = np.cumsum(sizes + 1)
    doc[1:] = np.repeat(np.arange(n), sizes + 1)
    edge = np.zeros(total, bool)
    edge[ends] = edge[0] = True
    keep = (letters > 0) | edge
    keep[1:] |= letters[:-1] > 0  # one space after a run of letters
    letters, doc, edge = letters[keep].astype(U64), doc[keep], edge[keep]
    has = np.zeros(n, bool)
    has[doc[letters > 0]] = True
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    one = letters > 0
    two = np.zeros(len(letters), bool)
    two[:-1] = (letters[:-1] > 0) | (letters[1:] > 0)
    if len(letters) < 3:
        return np.zeros(0, U64), np.zeros(0, np.int64), has
    three = (b > 0) & ((a > 0) | (c > 0))
    pair = (letters[:-1] << U64(21)) | letters[1:]
    own = np.where(one, doc, 0)
    # an n-gram belongs to the document of its letters
    pair_doc = np.where(letters[:-1] > 0, doc[:-1], doc[1:])
    keys = np.concatenate([letters[one] | U64(1 << 62), (pair | U64(2 << 62))[two[:-1]], ((a << U64(42)) | (b << U64(21)) | c)[three]])
    return mix(keys), np.concatenate([own[one], pair_doc[two[:-1]], doc[1:-1][three]]), has


def _counts(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """Distinct (document, n-gram) with counts; hashes keep as many high bits as there is room for."""
    bits = max(1, int(n - 1).bit_length())
    own = np.sort((doc.astype(U64) << U64(64 - bits)) | (keys >> U64(bits)))
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(own)))
    own = own[start]
    return (own >> U64(64 - bits)).astype(np.int64), own & U64((1 << (64 - bits)) - 1), count, U64(bits)


def top_ranks(texts: pa.Array, size: int):
    """(document, n-gram hash, rank) of each text's ``size`` most frequent n-grams; shift of the hashes; which texts have letters."""
    keys, doc, has = grams(texts)
    doc, key, count, bits = _counts(keys, doc, len(texts))
    order = np.lexsort((key, -count, doc))
    doc, key = doc[order], key[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    near = rank < size
    return doc[near], key[near], rank[near], bits, has


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> hashes of its most frequent n-grams in rank order, from the rows (lang, text) of ``docs``."""

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[start], np.add.reduceat(n, start)

        for batch in batches:
            for part in pieces(batch):
                names = part.column("lang").to_pylist()
                keys, doc, _ = grams(part.column("text"))
                code = {x: i for i, x in enumerate(dict.fromkeys(names))}
                own = np.array([code[x] for x in names], np.int64)[doc]
                for name, i in code.items():
                    if len(k := np.sort(keys[own == i])):
                        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                        parts = held.setdefault(name, [])
                        parts.append((k[start], np.diff(np.append(start, len(k)))))
                        if len(parts) > 16:
                            held[name] = [merged(parts)]
        for name, parts in held.items():
            k, c = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["lang", "gram", "n"])

    parts = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in best.collect():  # profile size times the number of languages
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {k: np.array([g for _, g in sorted(v)], np.int64).view(U64) for k, v in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for every row (doc_id, text) of ``docs``, with the columns in ``keep``."""
    names = list(profiles)
    everything = np.unique(np.concatenate([np.zeros(0, U64), *profiles.values()]))
    ranks = np.full((len(everything) + 1, len(names)), -1, np.int64)
    for j, name in enumerate(names):
        ranks[np.searchsorted(everything, profiles[name]), j] = np.arange(len(profiles[name]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                pred, score = np.full(n, "und", object), np.zeros(n)
                doc, key, rank, bits, has = top_ranks(part.column("text"), size)
                if len(doc) and names:
                    table = everything >> bits
                    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                    found = np.where((table[at] == key)[:, None], ranks[at], -1)
                    out = np.where(found >= 0, np.minimum(np.abs(found - rank[:, None]), size), size)
                    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    share = np.add.reduceat(out, start, axis=0) / (np.diff(np.append(start, len(doc))) * size)[:, None]
                    best = share.argmin(1)
                    pred[doc[start]] = np.array(names, object)[best]
                    score[doc[start]] = 1 - share[np.arange(len(best)), best]
                pred[~has], score[~has] = "und", 0.0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *(part.column("text" if c == "_keep_text" else c) for c in extra)], names=["doc_id", "lang_pred", "score", *extra])

    extra = [f"_keep_{c}" for c in keep]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in keep if c != "text"))
    kinds = "".join(f", `_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, RESULT + kinds).withColumnsRenamed({f"_keep_{c}": c for c in keep})


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
