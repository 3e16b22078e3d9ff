"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a document. The cost of a rule (seconds per
document) and its selectivity (share of documents that it rejects) are measured
on a bounded sample; rules then run in the order of rejections per second, and
a document that one rule has rejected is not shown to later ones. The verdict
does not depend on the order, only the work does.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.packed import Texts, covered, mix, pack, per_doc, pieces, sequence_hashes, window_starts

U64 = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: The columns of the contract.
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more in its document; does it occur earlier there."""
    own = mix(keys + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    k = own[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    t = Texts(texts)
    n_words = np.diff(t.first)
    in_word = np.ones(len(t.data), bool)
    in_word = covered(t.starts, t.ends - t.starts, len(t.data)) if len(t.starts) else ~in_word
    chars = per_doc(in_word & ((t.data & 0xC0) != 0x80), t.offsets)
    symbols = per_doc(_SYMBOL[t.data], t.offsets)
    # lines: pieces between line feeds and document boundaries
    feeds = np.flatnonzero(t.data == 10)
    begin = np.concatenate([t.offsets[:-1], feeds + 1])
    doc = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, feeds, "right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.concatenate([begin[1:] - 1, t.offsets[-1:]])
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = t.offsets[doc[last] + 1]
    words_before = np.searchsorted(t.starts, np.stack([begin, end]))
    has_word = words_before[1] > words_before[0]
    begin, end, doc = begin[has_word], end[has_word], doc[has_word]
    _, later = _repeats(t.hash_ranges(begin, end), doc)
    dup_lines = np.bincount(doc[later], minlength=t.n)
    # words in five-word windows that the text has twice
    s, sdoc = window_starts(t.first, 5)
    twice, _ = _repeats(sequence_hashes(t.word_hashes(), s, s + 5), sdoc)
    repeat_words = per_doc(covered(s[twice], 5, len(t.starts)), t.first)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "n_lines": np.bincount(doc, minlength=t.n)}


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


# Rules of the cascade: each gets the texts still in play with their base
# measures and says which it rejects. The limits are wide: ordinary prose is far inside.
def symbol_heavy(texts: pa.Array, f: dict) -> np.ndarray:
    """More than a tenth as many symbols as characters in words."""
    return 10 * f["n_symbols"] > f["word_chars"]


def odd_word_length(texts: pa.Array, f: dict) -> np.ndarray:
    """Words of under 2 or over 20 characters on average."""
    return (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])


def duplicate_lines(texts: pa.Array, f: dict) -> np.ndarray:
    """More than half of the lines repeat an earlier one."""
    return 2 * f["n_dup_lines"] > f["n_lines"]


def few_letters(texts: pa.Array, f: dict) -> np.ndarray:
    """Under half of the characters in words are letters or belong to other scripts."""
    raw, offsets = pack(texts)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 0xC0)
    return 2 * per_doc(letter, offsets) < f["word_chars"]


def one_word_dominates(texts: pa.Array, f: dict) -> np.ndarray:
    """One word makes up more than half of the text."""
    t = Texts(texts)
    key = mix(t.word_hashes() + t.word_doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(t.n, np.int64)
    np.maximum.at(most, t.word_doc[at], count)
    return 2 * most > f["n_words"]


RULES = (symbol_heavy, odd_word_length, duplicate_lines, few_letters, one_word_dominates)


def cascade(texts: pa.Array, f: dict[str, np.ndarray], rules, alive: np.ndarray) -> np.ndarray:
    """Which of the documents in ``alive`` pass all rules; each rule sees only what the earlier ones left."""
    alive = alive.copy()
    for rule in rules:
        at = np.flatnonzero(alive)
        if not len(at):
            break
        rejected = rule(texts.take(pa.array(at)), {k: v[at] for k, v in f.items()})
        alive[at[rejected]] = False
    return alive


def plan_order(docs: DataFrame, rules=RULES, sample_rows: int = 2000, sample_bytes: int = 4 << 20) -> list[int]:
    """Rule indices by rejections per second, measured on the first documents: at most ``sample_rows`` and about ``sample_bytes``, whole texts.

    take() reads as many partitions as it needs, which is one for most tables.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = [r[0] for r in docs.select(F.octet_length(text)).take(sample_rows)]
    rows = int(np.searchsorted(np.cumsum(sizes), sample_bytes)) + 1
    sample = [r[0] for r in docs.select(text).take(min(rows, len(sizes)))] if sizes else []
    if not len(sample):
        return list(range(len(rules)))
    texts = pa.array(sample, pa.string())
    f = features(texts)
    rate = []
    for i, rule in enumerate(rules):
        began = time.perf_counter()
        rejected = int(rule(texts, f).sum())
        rate.append(((rejected + 0.5) / max(time.perf_counter() - began, 1e-9), i))
    return [i for _, i in sorted(rate, key=lambda x: (-x[0], x[1]))]


def quality_rules(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """Base measures of every document and the verdict of the cascade."""
    ordered = [rules[i] for i in plan_order(docs, rules, sample_rows)]

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text").fill_null("")
                f = features(texts)
                failed = base_failed(f)
                kept = cascade(texts, f, ordered, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(f[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
