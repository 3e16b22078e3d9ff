"""Alignment of two tokenizers by the bytes where their tokens end.

A is a byte-level vocabulary of the tokenizers library, given a space and the text;
B is a sentencepiece model, which adds that space itself. Strings of special tokens
in a text are plain text. Every byte of the text gets a label: no token ends there,
one of A, one of B, or both. A regular expression finds the spans up to each byte
where both end, and the counts of labels in a span say how many tokens of A and of B
form a group. The last tokens of a group are linked.

A long text is cut at single spaces between two ASCII letters and its parts are
encoded on their own, each with the space before it. That changes no id: no match of
A's splitter goes on over such a space (its expression has white space inside a match
only after white space, and looks at nothing on its left), and no piece of B has a
space after another character (``Aligner`` checks the vocabulary). It bounds what the
libraries hold at a time.

How often a pair of ids is linked in the corpus is counted once for each block of
texts, then by pair; blocks ask for the counts of their distinct pairs, so a pair
has a row for each block at most, however frequent it is.

Null and empty texts, and texts that the tokens of A or of B don't give back byte
for byte (B cannot tell U+2581 from a space), have no tokens: zeros and ''.
Repeated rows count as often as they occur. Other columns are ignored. A stretch
without a cut, however long, is encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import byte_symbols
from tessella.llm.packed import pieces
from tessella.llm.store import stored

CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters whose classes (letter, number, white space) have not changed since they were assigned.
PLAIN = re.compile("[\\x00-\u024f\u2010-\u2027]*")
#: Fixed value: how byte-level vocabularies of this kind split a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labels of a byte, and the spans up to a byte where both tokenizers end a token.
NONE, A_ENDS, B_ENDS, BOTH = b"-ab*"
SPAN = re.compile(rb"[^*]*\*")
#: Characters of a part, at least, and of the parts that are encoded at once.
PART, AT_ONCE = 32 << 10, 1 << 20
#: Ids of B, which the lower bits of a pair hold.
B_BITS = 20
#: Bytes of texts in a block.
BLOCK_BYTES = 8 << 20
SIZES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ENCODED = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # tasks run side by side already
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        plain = self.a.get_vocab_size(with_added_tokens=False)
        names = [self.a.id_to_token(i) if i < plain else "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else b"" for t in names]
        self.fast = self._merger(a_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: cuts keep the ids of B only if no piece has a space after another character
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        # decimal digits of all ids, with room for a separator
        numbers = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.array([len(x) for x in numbers])
        self.width = int(self.digits.max()) + 1
        self.decimals = np.frombuffer(b"".join(x.ljust(self.width) for x in numbers), np.uint8).reshape(-1, self.width)

    def _merger(self, path: str):
        """The same vocabulary for a quicker library; None unless ids go by the ranks of merges and words are split as usual."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits, merges = spec["pre_tokenizer"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {t: i for i, t in enumerate(self.a_bytes) if t}
        usual = spec["normalizer"] is None and splits["type"] == "ByteLevel" and splits.get("use_regex", True) and not splits["add_prefix_space"]
        plain = len(ranks) - len(merges)
        vocab = spec["model"]["vocab"]
        if not usual or plain != 256 or any(vocab[a + b] != plain + i for i, (a, b) in enumerate(merges)):
            return None
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def left(self, parts: list[str]) -> list[list[int]]:
        """Ids of A. Parts of plain characters, on whose classes all libraries agree, take the quicker way."""
        out: list[list[int] | None] = [self.fast.encode_ordinary(" " + p) if self.fast and len(p) <= 2 * PART and PLAIN.fullmatch(p) else None for p in parts]
        other = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(other, self.a.encode_batch([" " + parts[i] for i in other], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of PART characters or, where no cut follows, more."""
        at = 0
        while self.cuts and len(text) - at > PART:
            cut = CUT.search(text, at + PART)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of every text; none for a text that they don't give back byte for byte."""
        waiting: list[tuple[int, str]] = []
        held, size = {}, 0

        def run():
            parts = [p for _, p in waiting]
            for (i, p), a, b in zip(waiting, self.left(parts), self.b.encode(parts, num_threads=1)):
                raw = b" " + p.encode()
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                # a vocabulary of bytes can lose some but not change any
                fits = self.a_size[a].sum() == len(raw) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
                held.setdefault(i, []).append((a, b) if fits else None)
            waiting.clear()

        done = 0
        nothing = np.zeros(0, np.int64)

        def results(to):
            nonlocal done
            while done < to:
                got = held.pop(done, [])
                # a part that isn't given back has lost bytes, and no other part can make up for them
                yield tuple(map(np.concatenate, zip(*got))) if got and None not in got else (nothing, nothing)
                done += 1

        for i, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                waiting.append((i, part))
                size += len(part)
                if size >= AT_ONCE:
                    run()
                    size = 0
            if not waiting:
                yield from results(i + 1)
        run()
        yield from results(len(texts))

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes, np.ndarray]:
        """(number of groups, the groups written out, linked pairs) of the ids of a text."""
        if not len(a):
            return 0, b"", np.zeros(0, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]) - 1, np.cumsum(self.b_size[b]) - 1
        labels = np.full(ends_a[-1] + 1, NONE, np.uint8)
        labels[ends_a] = A_ENDS
        labels[ends_b] = np.where(labels[ends_b] == A_ENDS, BOTH, B_ENDS)
        spans = SPAN.findall(labels.tobytes())
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans))) - 1
        # labels of either kind up to the end of each span are the tokens up to the end of its group
        both = labels == BOTH
        to_a, to_b = (np.cumsum((labels == one) | both)[ends] for one in (A_ENDS, B_ENDS))
        pairs = a[to_a - 1] << B_BITS | b[to_b - 1]
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        at_a = np.arange(len(a)) + np.repeat(to_b - n_b, n_a)
        at_b = np.arange(len(b)) + np.repeat(to_a, n_b)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[to_a - 1]], mark[at_b[to_b - 1]] = ord("|"), ord(";")
        digits = self.digits[ids]
        shown = self.decimals[ids]
        shown[np.arange(len(ids)), digits] = mark
        return len(spans), shown[np.arange(self.width) <= digits[:, None]].tobytes()[:-1], pairs

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
        """(tokens of A, of B, groups, the groups written out, linked pairs) of whole texts."""
        for a, b in self.encode(texts):
            yield len(a), len(b), *self.align(a, b)


@functools.lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and the token groups of every text: array of (ids of A, ids of B) in order. The vocabulary files must exist on every executor."""

    def run(batches):
        c = aligner(a_path, b_path)
        for batch in batches:
            for part in pieces(batch):
                out = []
                for _, _, _, written, _ in c.texts(part.column("text").to_pylist()):
                    written = written.decode()
                    sides = [g.split("|") for g in written.split(";")] if written else []
                    out.append([{"a": [int(x) for x in a.split(",")], "b": [int(x) for x in b.split(",")]} for a, b in sides])
                ids = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.struct([("a", ids), ("b", ids)])))], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of kind 0, one for each text with its distinct linked pairs, and of kind 1, one for each block with those of all its texts."""

    def run(batches):
        c, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        number = part << 32
        for batch in batches:
            for piece in pieces(batch, budget=BLOCK_BYTES):
                rows, pairs, times = [], [], []
                texts = c.texts(piece.column("text").to_pylist())
                for doc_id, (n_a, n_b, n_groups, written, links) in zip(piece.column("doc_id").to_pylist(), texts):
                    rows.append((0, number, doc_id, n_a, n_b, n_groups, hashlib.sha256(written).hexdigest() if n_groups else ""))
                    distinct, counts = np.unique(links, return_counts=True)
                    pairs.append(distinct)
                    times.append(counts)
                rows.append((1, number, None, 0, 0, 0, None))
                distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
                sums = np.zeros(len(distinct), np.int64)
                np.add.at(sums, place, np.concatenate(times))
                columns = [pa.array(v, t) for v, t in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 5, pa.string()])]
                names = ["kind", "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([*columns, _lists([*pairs, distinct]), _lists([*times, sums])], names=names)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (links of the corpus with it) and top (no pair of its B id has more), of rows (pairs, times)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    # as many rows as A has ids meet in a window at most
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    return each.withColumn("top", F.col("n") == F.max("n").over(of_b))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Sizes, links and the digest of the groups of every text (columns ALIGNED)."""
    table = stored(encoded(docs, a_path, b_path))
    blocks = table.where("kind = 1").select("block", "pairs", "times")
    asked = blocks.select(F.col("block").alias("asking"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(blocks), "pair")
    texts = table.where("kind = 0").drop("kind")

    def answer(key, left, right):
        order = np.argsort(pair := right.column("pair").to_numpy())
        pair, n, top = pair[order], right.column("n").to_numpy()[order], right.column("top").to_numpy()[order]
        lists, times = left.column("pairs").combine_chunks(), left.column("times").combine_chunks()
        bounds = lists.offsets.to_numpy()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        many = times.flatten().to_numpy()
        bounds = bounds - bounds[0]

        def per_text(values):
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[bounds]))

        sums = {"n_links": per_text(many), "n_best": per_text(many * top[at]), "count_sum": per_text(many * n[at])}
        data = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | sums
        return pa.table({c: data[c] for c in ["doc_id", *SIZES, "groups_sha256"]})

    return texts.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(answer, ALIGNED)
