"""Language-model scoring by deleted interpolation.

p(w | v) = a0 / (V + 1) + a1 c(w) / N + a2 c(vw) / c(v), where c counts the
learning documents and the weights a depend on the bucket of c(v), the floor of
its binary logarithm. One part of the learning documents is deleted: its tokens
are predicted from the counts of the rest, and expectation-maximisation fits
the weights to them. Scoring then uses the counts of all learning documents.

Counting and looking up are one exchange. Documents form blocks of a few
megabytes. A block sends the hashes of its distinct words and word pairs, with
its counts, to ranges of the hash space; each range adds up the counts of equal
hashes and sends every block the totals of just what it asked for, in the same
order. A frequent word or pair costs one entry a block. There are as many ranges
as keep the questions to one within ``RANGE_BYTES``, so a group doesn't grow with
the corpus. Word hashes have 64 bits, pair hashes 48 below the range. Blocks are named by
the partition that made them and their number there, never by what they hold.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end;
a null or empty text is the end alone. Repeated rows count and are scored as
often as they occur. With nothing to learn from, N is 0 and all mass is uniform.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.packed import Texts, mix, pieces
from tessella.llm.store import stored

U64 = np.uint64
LEARN, DELETED, HELD_OUT = 0, 1, 2
#: Text bytes of a block; bytes of questions that one range gets at most, about.
BLOCK, RANGE_BYTES = 8 << 20, 32 << 20
END, BEGIN = U64(0x1D872B41A5C3E907), U64(0xC2B2AE3D27D4EB4F)
BLOCKS = "block long, kind int, doc_ids array<long>, sizes array<int>, words binary, tokens binary"
ASKED = "range int, block long, kind int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWER = "block long, kind int, range int, words binary, pairs binary, n_all long, n_deleted long, v_all long, v_rest long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
BUCKETS, STEP = 40, 8


def _blocks(batches):
    """Documents as positions in the block's sorted distinct word hashes."""
    held = {kind: [] for kind in (LEARN, DELETED, HELD_OUT)}
    size = defaultdict(int)
    # no two blocks of the stored table have one name, whatever ids they hold
    names = itertools.count(TaskContext.get().partitionId() << 32)

    def flush(kind):
        ids, sizes, hashes = (np.concatenate(x) for x in zip(*held[kind]))
        words, tokens = np.unique(hashes, return_inverse=True)
        name = next(names)
        held[kind], size[kind] = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([kind], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary()), pa.array([tokens.astype("<u4").tobytes()], pa.binary())],
            names=["block", "kind", "doc_ids", "sizes", "words", "tokens"],
        )

    for batch in batches:
        for part in pieces(batch):
            kinds = part.column("kind").to_numpy()
            t = Texts(part.column("text"), lower=True)
            # every document's words, then its end
            n_words = np.diff(t.first)
            hashes = np.full(len(t.starts) + t.n, END, U64)
            ends = np.cumsum(n_words + 1) - 1
            inner = np.ones(len(hashes), bool)
            inner[ends] = False
            hashes[inner] = t.word_hashes()
            ids = part.column("row").to_numpy()
            for kind in np.unique(kinds).tolist():
                mine = kinds == kind
                held[kind].append((ids[mine], (n_words[mine] + 1).astype(np.int32), hashes[np.repeat(mine, n_words + 1)]))
                size[kind] += int(np.diff(t.offsets)[mine].sum()) + 16 * int(mine.sum())
                if size[kind] >= BLOCK:
                    yield flush(kind)
    for kind in held:
        if held[kind]:
            yield flush(kind)


def _pairs(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
    """(distinct pair hashes, position of each token's pair, contexts and words of the pairs as positions in words + BEGIN)."""
    before = np.append(0, tokens[:-1]).astype(np.int64)
    before[np.cumsum(sizes) - sizes] = len(words)  # the beginning of a text
    context = np.append(words, BEGIN)
    keys = mix(context[before] * U64(0x9E3779B97F4A7C15) + mix(words[tokens]))
    pairs, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return pairs, which, before[at], tokens[at]


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"], "<u8"), np.frombuffer(row["tokens"], "<u4").astype(np.int64), np.array(row["sizes"], np.int64)


def _with_begin(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted hashes with BEGIN among them, and its position."""
    at = int(np.searchsorted(words, BEGIN))
    return np.insert(words, at, BEGIN), at


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash space begins in sorted hashes."""
    edge = np.array([i * (1 << 64) // ranges for i in range(ranges)], U64)
    return np.append(np.searchsorted(keys, edge), len(keys))


def _six(keys: np.ndarray) -> bytes:
    """The low six bytes of hashes."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _ask(ranges: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens, sizes = _unpack(row)
                pairs, which, _, _ = _pairs(words, tokens, sizes)
                full, begin = _with_begin(words)
                word_counts = np.insert(np.bincount(tokens, minlength=len(words)), begin, len(sizes)).astype("<u4")
                pair_counts = np.bincount(which, minlength=len(pairs)).astype("<u4")
                wc, pc = _cuts(full, ranges), _cuts(pairs, ranges)
                cols = [[], [], [], []]
                for r in range(ranges):
                    w, p = slice(wc[r], wc[r + 1]), slice(pc[r], pc[r + 1])
                    for c, x in zip(cols, (full[w].tobytes(), word_counts[w].tobytes(), _six(pairs[p]), pair_counts[p].tobytes())):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges), pa.int32()), pa.array([row["block"]] * ranges), pa.array([row["kind"]] * ranges, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["range", "block", "kind", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray], kinds: list[int]):
    """Sums over blocks of equal keys: (distinct keys, per learning count, per deleted count, position of every key)."""
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    kind = np.repeat(kinds, [len(k) for k in keys])
    n = np.concatenate(counts).astype(np.float64)
    everything = np.bincount(which, weights=n * (kind != HELD_OUT), minlength=len(distinct)).astype(np.int64)
    deleted = np.bincount(which, weights=n * (kind == DELETED), minlength=len(distinct)).astype(np.int64)
    return distinct, everything, deleted, which


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Totals for each block in the order of its question: all learning counts, then the deleted ones."""
    kinds = table.column("kind").to_pylist()
    out = {}
    n = table.num_rows
    stats = np.zeros((n, 4), np.int64)
    for name, counts, wide in (("words", "word_counts", True), ("pairs", "pair_counts", False)):
        keys = [np.frombuffer(b, "<u8") if wide else _from_six(b) for b in table.column(name).to_pylist()]
        distinct, everything, deleted, which = _totals(keys, [np.frombuffer(b, "<u4") for b in table.column(counts).to_pylist()], kinds)
        if wide:
            token = distinct != BEGIN
            stats[0] = everything[token].sum(), deleted[token].sum(), (everything[token] > 0).sum(), (everything[token] > deleted[token]).sum()
        ends = np.cumsum([len(k) for k in keys])
        # deleted counts are asked for by deleted blocks only
        out[name] = [np.concatenate([everything[w], deleted[w]] if kind == DELETED else [everything[w]]).astype("<i8" if everything.max(initial=0) >= 1 << 31 else "<i4").tobytes() for w, kind in zip(np.split(which, ends[:-1]), kinds)]
    return pa.table({"block": table.column("block"), "kind": pa.array(kinds, pa.int32()), "range": pa.array([key[0].as_py()] * n, pa.int32()), "words": pa.array(out["words"], pa.binary()), "pairs": pa.array(out["pairs"], pa.binary()), **{c: pa.array(stats[:, i]) for i, c in enumerate(("n_all", "n_deleted", "v_all", "v_rest"))}})


class _Block:
    """A block with the totals that came back."""

    def __init__(self, row, answers: pa.Table, deleted: bool):
        words, tokens, self.sizes = _unpack(row)
        pairs, self.which, context, word = _pairs(words, tokens, self.sizes)
        self.tokens = tokens
        full, begin = _with_begin(words)
        answers = answers.sort_by("range")
        wc, pc = _cuts(full, answers.num_rows), _cuts(pairs, answers.num_rows)

        def read(column, cuts):
            parts = []
            for r, data in enumerate(answers.column(column).to_pylist()):
                n = cuts[r + 1] - cuts[r]
                width = len(data) // max(n * (2 if deleted else 1), 1)
                x = np.frombuffer(data, "<i8" if width == 8 else "<i4").astype(np.int64)
                parts.append(x[:n] - x[n:] if deleted else x)
            return np.concatenate(parts)

        counts = read("words", wc)
        self.begin = counts[begin]
        self.words = np.delete(counts, begin)  # c(w) of each distinct word
        self.pairs = read("pairs", pc)
        self.context = np.append(self.words, self.begin)[context]
        self.word = self.words[word]


def _estimates(b: _Block, n: int, v: int):
    """Bucket of each distinct pair's context and its three estimates."""
    bucket = np.minimum(np.log2(b.context + 1).astype(np.int64), BUCKETS - 1)
    return bucket, np.full(len(b.pairs), 1 / (v + 1)), b.word / max(n, 1), b.pairs / np.maximum(b.context, 1)


def fit_weights(rows: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation from rows (bucket, q1, q2, tokens).

    q1, q2: binary logarithms of the second and third estimate over the first, in steps of 1/8; the least value stands for no mass.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(rows):
        return weights
    bucket, count = rows[:, 0], rows[:, 3].astype(float)
    ratio = np.stack([np.ones(len(rows)), *(np.where(rows[:, i] == NONE, 0, np.exp2(rows[:, i] / STEP)) for i in (1, 2))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * ratio
        share *= (count / share.sum(1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(3)], axis=1)
        seen = total.sum(1) > 0
        weights[seen] = total[seen] / total[seen].sum(1)[:, None]
    return np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum(1)[:, None]


NONE = -100_000


def lm_scores(docs: DataFrame, learns: Column, deleted: Column, ranges: int | None = None) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    learns: rows to count; deleted: those of them that the weights are fitted on.
    """
    spark = docs.sparkSession
    kind = F.when(~F.coalesce(learns, F.lit(False)), HELD_OUT).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(LEARN)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("row"), F.col("text").cast("string").alias("text"), kind.cast("int").alias("kind"))
    blocks = stored(slim.mapInArrow(_blocks, BLOCKS))
    if ranges is None:
        # a question has ten bytes a pair and twelve a word, of which a block has no more than tokens (of four bytes) and words (of eight)
        size = blocks.agg(F.sum(10 / 4 * F.octet_length("tokens") + 12 / 8 * F.octet_length("words"))).first()[0] or 0
        ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // RANGE_BYTES))
    asked = blocks.select("block", "kind", "sizes", "words", "tokens").mapInArrow(_ask(ranges), ASKED)
    answers = stored(asked.groupBy("range").applyInArrow(_answer, ANSWER))
    n, n_deleted, v, v_rest = (int(x or 0) for x in answers.agg(*(F.sum(c) for c in ("n_all", "n_deleted", "v_all", "v_rest"))).first())
    lean = answers.select("block", "kind", "range", "words", "pairs")

    def held_out_counts(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        for row in left.to_pylist():  # one block
            b = _Block(row, right, True)
            bucket, p0, p1, p2 = _estimates(b, n - n_deleted, v_rest)
            with np.errstate(divide="ignore"):
                q = [np.where(p > 0, np.rint(STEP * np.log2(np.where(p > 0, p, 1) / p0)), NONE).astype(np.int64) for p in (p1, p2)]
            count = np.bincount(b.which, minlength=len(b.pairs))
            distinct, which = np.unique(np.stack([bucket, *q], axis=1), axis=0, return_inverse=True)
            rows = np.column_stack([distinct, np.bincount(which.ravel(), count).astype(np.int64)])
        return pa.table({c: pa.array(rows[:, i]) for i, c in enumerate(("bucket", "q1", "q2", "n"))})

    side = blocks.where(F.col("kind") == DELETED)
    counted = side.groupBy("block").cogroup(lean.where(F.col("kind") == DELETED).groupBy("block")).applyInArrow(held_out_counts, "bucket long, q1 long, q2 long, n long")
    # a grid of buckets and ratios, of a size that doesn't depend on the corpus
    table = counted.groupBy("bucket", "q1", "q2").agg(F.sum("n").alias("n")).collect()
    weights = fit_weights(np.array([tuple(r) for r in table], np.int64).reshape(-1, 4))

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        for row in left.to_pylist():  # one block
            b = _Block(row, _all_only(right, row["kind"]), False)
            bucket, p0, p1, p2 = _estimates(b, n, v)
            a = weights[bucket]
            one = np.log10(a[:, 0] * p0 + a[:, 1] * p1 + a[:, 2] * p2)
            starts = np.cumsum(b.sizes) - b.sizes
            base = np.log10((b.words + 1) / (n + v + 1))
            out = [np.array(row["doc_ids"], np.int64), b.sizes, np.add.reduceat((b.words > 0)[b.tokens].astype(np.int64), starts), np.add.reduceat(base[b.tokens], starts), np.add.reduceat(one[b.which], starts)]
        return pa.table({c: pa.array(x) for c, x in zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), out)})

    scored = blocks.groupBy("block").cogroup(lean.groupBy("block")).applyInArrow(score, SCORES)
    return scored.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


#: Stands for a null doc_id inside blocks.
NULL_ID = -(1 << 63)


def _all_only(answers: pa.Table, kind: int) -> pa.Table:
    """Answers to a deleted block without the deleted counts."""
    if kind != DELETED:
        return answers
    cols = {c: [b[: len(b) // 2] for b in answers.column(c).to_pylist()] for c in ("words", "pairs")}
    return pa.table({"range": answers.column("range"), **{c: pa.array(x, pa.binary()) for c, x in cols.items()}})
