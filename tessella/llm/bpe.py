"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the encoding has one last token. It is found among
the tokens that end there (an automaton over the vocabulary yields them) as the
one that can follow the last token of the prefix before it: two tokens can
stand side by side if merging the symbols of both gives back just those two.
Following the back-pointers from the whole word gives its ids.

The vocabulary is a file of the tokenizers library with word ends (its path is
a parameter). The driver reads it and broadcasts its few megabytes. Each Python
worker keeps the encodings of a bounded number of words; others are worked out
anew, so the bound changes only the time.

Null and empty texts have no tokens. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.packed import pieces

#: Words and token pairs that a worker remembers.
KEPT_WORDS, KEPT_PAIRS = 200_000, 600_000
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class _Words(dict):
    """word -> ids as bytes, for as many words as may be kept."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.codec.encode_word(word), "<u4").tobytes()
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


class Codec:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.suffix = suffix
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split").replace(r"\s", _SPACE))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # one character per symbol: a byte's own, and 1024 + byte for the last of a word
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.ranks: dict[tuple[str, str], int] = {}

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            body = "".join(chr(byte_of[c]) for c in (token[: -len(suffix)] if ends else token))
            return body[:-1] + chr(1024 + ord(body[-1])) if ends else body

        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[symbols(a), symbols(b)] = rank
        self.automaton = ahocorasick.Automaton()
        self.strings: dict[int, str] = {}
        for token, i in model["vocab"].items():
            s = symbols(token)
            self.strings[i] = s
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)

    def merged(self, s: str) -> list[str]:
        """The parts that the merges, applied in order of rank, leave of a string of symbols."""
        parts = list(s)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Can b stand after a (a = -1: at the start)?"""
        left = [self.strings[a]] if a >= 0 else []
        want = [*left, self.strings[b]]
        fits = self.merged("".join(want)) == want
        if len(self.pairs) < KEPT_PAIRS:
            self.pairs[(a << 20) + b] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        s = data[:-1].decode("latin-1") + chr(1024 + data[-1])
        known = self.pairs.get
        back, last = [0] * (len(s) + 1), [-2] * (len(s) + 1)  # -2: no encoding of this prefix yet
        last[0] = -1
        for end, (token, length) in self.automaton.iter(s):
            if last[end + 1] == -2:
                before = last[end + 1 - length]
                if before != -2:
                    fits = known((before << 20) + token)
                    if fits or fits is None and self.follows(before, token):
                        last[end + 1], back[end + 1] = token, end + 1 - length
        out, i = [], len(s)
        while i > 0:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.cut is None or "<|" not in text:
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), int(self.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a space between them, as a vocabulary without a decoder has it."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


#: White space as the vocabulary's own splitter takes it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(2)
def codec(text: str) -> Codec:
    return Codec(text)


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) of every text."""
    shared = _shared(docs, path)

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            for part in pieces(batch):
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                sizes = [len(x) for x in ids]
                flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give the empty text."""
    shared = _shared(encoded, path)

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            text = [c.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and returns digests of both."""
    shared = _shared(docs, path)

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            for part in pieces(batch):
                count, first, second = [], [], []
                for t in part.column("text").to_pylist():
                    ids = c.encode(t or "")
                    count.append(len(ids))
                    first.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    second.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)
