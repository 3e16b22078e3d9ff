"""Token groups of two vocabularies, against both libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tessella.llm import align
from tessella.llm.queries import QUERIES, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_decoder():
    """The printable stand-ins of bytes, by the rule that byte-level vocabularies use."""
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(libraries, rows):
    a, b = libraries
    bytes_of = byte_decoder()
    found, counts = [], Counter()
    for doc_id, text in rows:
        groups, links, ia, ib = [], [], [], []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(bytes_of[c] for c in a.id_to_token(i)) for i in ia]
            tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            raw = (" " + text).encode()
            if b"".join(ta) != raw or b"".join(tb) != raw:
                ia, ib = [], []
            else:
                ends = defaultdict(lambda: ([], []))
                for side, ids, tokens in ((0, ia, ta), (1, ib, tb)):
                    at = 0
                    for i, t in zip(ids, tokens):
                        at += len(t)
                        ends[at][side].append(i)
                ga, gb = [], []
                for at in sorted(ends):
                    ga += ends[at][0]
                    gb += ends[at][1]
                    if ends[at][0] and ends[at][1]:
                        groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                        links.append((ga[-1], gb[-1]))
                        ga, gb = [], []
        counts.update(links)
        found.append((doc_id, ia, ib, groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for doc_id, ia, ib, groups, links in found:
        best = sum(counts[p] == top[p[1]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(ia), len(ib), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, sf_dir, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_alignment"](spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(libraries, rows)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "▁x and y"), (6, "<|endoftext|> <s> </s> <unk> a"), (7, "it's a b  c\td\n\n e ﬁ é 中文 🎉 x y"), (8, "a b " * 20000),
    (9, "same words"), (9, "same words"), (None, "no id"), (10, "\0 a\x00b \x85 　 ½"), (11, "中" * 3000), (12, " lead and trail "), (13, "x" * 5000),
]


def test_odd_texts(spark, libraries):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, pair int, block string").repartition(4)
    assert sorted(map(tuple, align.aligned(df, *PATHS).collect()), key=str) == brute(libraries, ODD)
    assert align.aligned(df.limit(0), *PATHS).collect() == []


@pytest.mark.parametrize("part, at_once", [(1, 1), (3, 40), (10, 1 << 20)])
def test_parts_give_the_ids_of_the_whole(libraries, monkeypatch, part, at_once):
    monkeypatch.setattr(align, "PART", part)
    monkeypatch.setattr(align, "AT_ONCE", at_once)
    r = random.Random(7)
    pool = ["a", "b", "Z", "the", "ing", " ", " ", "  ", "\n", "'s", "'", "é", "中", "1", ".", "<s>", "<|endoftext|>", "🎉", "\u00a0", "İ", "ſ", "▁"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(1500)] + [None, "", "a b"]
    c = align.Aligner(*PATHS)
    assert c.cuts
    want = {x[0]: x for x in brute(libraries, list(enumerate(texts)))}
    for i, (n_a, n_b, n_groups, written, _) in enumerate(c.texts(texts)):
        assert (n_a, n_b, n_groups, hashlib.sha256(written).hexdigest() if n_groups else "") == (*want[i][1:4], want[i][7]), texts[i]


def test_the_quicker_library_gives_the_same_ids(libraries):
    """Every plain character among letters, digits, spaces and signs, and at random."""
    c, r = align.Aligner(*PATHS), random.Random(3)
    assert c.fast is not None
    plain = [x for x in map(chr, range(0x2030)) if align.PLAIN.fullmatch(x)]
    assert len(plain) == 0x250 + 0x18
    texts = [t for x in plain for t in (x, f"a{x}b", f"1{x}2", f" {x} ", f".{x}.", f"{x}{x} {x}'s", f"\n{x}\n\n{x}")]
    texts += ["".join(r.choice(plain[:128] if r.random() < 0.7 else plain) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += [" " * 5000, "\n \t" * 3000, "x" * 5000, "'" * 900]
    want = [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert c.left(texts) == want
    c.fast = None
    assert c.left(texts[:50]) == want[:50]


def test_groups_are_the_written_ones(spark):
    rows = [(1, "hello world, indeed"), (2, None)]
    got = {r.doc_id: r.groups for r in align.groups(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()}
    c = align.aligner(*PATHS)
    assert ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in got[1]) == next(c.texts([rows[0][1]]))[3].decode() and got[2] == []
