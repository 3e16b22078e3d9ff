"""Exact, near and substring duplicates against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.minhash import near_duplicates
from tessella.llm.substrings import substring_dedup
from tessella.llm.suffixes import suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, n_removed int"  # one extra column with a clashing name


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(12)
    docs = [prose(r.randint(0, 150)) for _ in range(12)]
    docs += [f"{prose(30)} {passage} {prose(20)}" for _ in range(6)]
    docs += [f"{prose(15)}\n{line}\n{prose(15)}" for _ in range(6)]
    docs += [docs[12]] * 3 + [docs[12].replace(passage[-9:], "X y z")]
    docs += ["", "   \t\n", "a", "a b", "ab " * 200, "ab " * 200 + "c", "é" * 150, "x" * 600]
    base = prose(80).split()
    for k in range(30):
        w = list(base)
        w[r.randrange(len(w))] = word()
        docs.append(" ".join(w) if k % 2 else " ".join(w).upper())
    return list(enumerate(docs))


def rows(docs):
    return [(i, t, 0) for i, t in docs]


def test_suffix_array_by_linear_grouping():
    r = random.Random(5)
    for n in range(40):
        t = [r.randint(0, r.choice([1, 3, 60])) for _ in range(n)]
        assert suffix_array(t) == sorted(range(n), key=lambda i: t[i:])


def test_suffix_dedup_matches_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup(spark.createDataFrame(rows(docs), SCHEMA).repartition(5)).collect()}
    assert got == brute.suffix_dedup(docs)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_matches_brute_force(spark, batches):
    docs = corpus(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(spark.createDataFrame(rows(docs), SCHEMA).repartition(5), batches).collect()}
    assert got == brute.substring_dedup(docs)


def test_crowded_anchors_go_the_other_way(spark, monkeypatch):
    from tessella.llm import substrings, suffixes

    monkeypatch.setattr(suffixes, "BATCH", 2)
    monkeypatch.setattr(substrings, "BATCH", 2)
    docs = corpus(3)
    df = spark.createDataFrame(rows(docs), SCHEMA)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup(df).collect()} == brute.suffix_dedup(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(df).collect()} == brute.substring_dedup(docs)


def test_two_texts_of_one_id_at_one_place_whatever_the_bound(spark, monkeypatch):
    """The same words at the same place in both texts of an id are two places, above the bound and below."""
    from tessella.llm import substrings, suffixes

    r = random.Random(21)
    line = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    shared = line(40)
    docs = [(1, shared + " " + line(30)), (1, shared + " " + line(25)), (2, line(7) + " " + shared), (3, line(60))]
    seen = []
    for bound in (8192, 0):
        monkeypatch.setattr(suffixes, "BATCH", bound)
        monkeypatch.setattr(substrings, "BATCH", bound)
        seen.append(sorted(tuple(x)[:3] for x in substring_dedup(spark.createDataFrame(rows(docs), SCHEMA)).collect()))
    # one text of id 1 keeps all, the other one and doc 2 lose the shared words
    assert seen[0] == seen[1] and sorted(x[2] for x in seen[0]) == [0, 0, 40, 40]


def test_near_duplicates_match_brute_force(spark):
    docs = corpus(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(rows(docs), SCHEMA).repartition(3)).collect()}
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("f", [suffix_dedup, substring_dedup, near_duplicates])
def test_empty_and_null(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
    out = f(spark.createDataFrame([(1, None, 0), (None, "some text", 0), (2, "some text", 0)], SCHEMA)).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in out) == [(False, 1), (False, 2), (True, 0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 2) for i in range(100, 130)] + [(7, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components(edges)
    assert got == {n: c for n, c in want.items() if n != c}


def test_most_alike_within_reach():
    import numpy as np

    from tessella.llm.minhash import GLANCE, REACH, _most_alike

    rng = np.random.Generator(np.random.PCG64(5))
    n = 300
    region, comp = np.sort(rng.integers(0, 4, n)), rng.integers(0, 30, n)
    glance = rng.integers(0, 3, (n, GLANCE)).astype(np.uint8)
    at = _most_alike(region, comp, glance)
    for i in range(n):
        near = [j for j in range(max(0, i - REACH), min(n, i + REACH + 1)) if region[j] == region[i] and comp[j] != comp[i]]
        most = max(((glance[i] == glance[j]).sum() for j in near), default=0)
        assert at[i] == -1 if most == 0 else at[i] in near and (glance[i] == glance[at[i]]).sum() == most
    assert _most_alike(region[:1], comp[:1], glance[:1]).tolist() == [-1]
    assert len(_most_alike(region[:0], comp[:0], glance[:0])) == 0


def hot_template(seed=7, many=600):
    """Texts of one template about 0.7 alike, and a few pairs at 0.76 among them."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    new = iter(range(10**9))

    def changed(words, n):
        out = list(words)
        for at in r.sample(range(5, len(words) - 5), n):
            out[at] = f"x{next(new)}"
        return out

    docs = [changed(base, 5) for _ in range(many)]
    for k in range(30):
        near = changed(base, 14)
        docs += [near, changed(near, 5)]
    r.shuffle(docs)
    return list(enumerate(" ".join(d) for d in docs))


def test_links_of_a_crowded_region_are_all_found(spark):
    docs = hot_template()
    got = {r["doc_id"]: tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(rows(docs), SCHEMA).repartition(3)).collect()}
    want = brute.near_duplicates(docs)
    assert len({c for _, c, _ in want.values()}) > 100
    assert got == want


def test_rows_without_an_id_and_two_texts_with_one_id(spark):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    a, b, c = text(30), text(30), text(30)
    docs = [(None, a), (None, b), (None, ""), (None, None), (5, a), (7, a + " tail"), (9, c), (9, c), (9, text(20)), (3, ""), (4, None)]
    got = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"] or 0, x["kept"]) for x in near_duplicates(spark.createDataFrame(rows(docs), SCHEMA)).collect())
    want = [(0, 26, 5, False), (0, 26, 0, True), (0, 0, 0, True), (0, 0, 0, True), (5, 26, 5, True), (7, 27, 5, False), (9, 26, 9, True), (9, 26, 9, True), (9, 16, 9, True), (3, 0, 3, True), (4, 0, 4, True)]
    assert got == sorted(want)


def test_clashing_ids_do_not_depend_on_the_order(spark):
    """Texts with one id are one document: it links if any of them does."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    a, b, d = text(40), text(40), text(40)
    docs = [(1, b), (1, a), (2, a + " tail"), (3, b + " end"), (4, d), (9, d), (9, text(12))]
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (9, 4, False), (9, 4, False)]
    for parts in (1, 3):
        for _ in range(2):
            r.shuffle(docs)
            got = near_duplicates(spark.createDataFrame(rows(docs), SCHEMA).repartition(parts)).collect()
            assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in got) == want


def test_large_regions_go_deeper():
    import numpy as np
    import pyarrow as pa

    from tessella.llm.minhash import _propose

    # one region of 20 rows between two others; by the second value of the tail it falls into parts of 3
    value = lambda *v: sum(x << (16 * (3 - i)) for i, x in enumerate(v))
    region = np.repeat([1, 2, 3], [1, 20, 1])
    tail = np.array([0, *(value(1, k // 3, k % 3, 0) for k in range(20)), 0])
    table = pa.table({"region": region, "tail": tail, "rep": np.arange(22)})
    got = {(a, b) for t in _propose(iter(table.to_batches())) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())}
    inside = {(a, b) for a in range(1, 21) for b in range(a + 1, 21) if (a - 1) // 3 == (b - 1) // 3}
    assert inside <= got and {(a, a + 1) for a in range(1, 20)} <= got and {(a, a) for a in range(1, 21)} <= got
    assert len({(a, b) for a, b in got if a != b}) == len(inside | {(a, a + 1) for a in range(1, 20)})


def test_regions_at_an_edge_count_as_large():
    import numpy as np

    from tessella.llm.minhash import _with_edges

    piece = lambda *x: [np.array(x), np.zeros(len(x)), np.arange(len(x))]
    got = [cut.tolist() for *_, cut in _with_edges(iter([piece(1, 1, 2, 3), piece(4, 5, 5), piece(5, 6), piece(7, 8)]))]
    assert got == [[True, True, False, False], [False, True, True], [True, False], [False, True]]
    assert [c.tolist() for *_, c in _with_edges(iter([piece(1, 2, 2)]))] == [[True, True, True]]


def test_every_link_across_components_is_compared(spark):
    from tessella.llm.minhash import _across

    docs = hot_template(8, 60)
    text = dict(docs)
    df = spark.createDataFrame([(i, t, i % 3) for i, t in docs], "doc_id long, text string, component long")
    got = {tuple(r) for r in _across(df.repartition(3)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in text.items())}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    # also a document's second and later partners
    assert {(a, b) for a, b in links if a % 3 != b % 3} <= got
    assert all(a < b and a % 3 != b % 3 for a, b in got)


@pytest.mark.parametrize("words", [False, True])
def test_anchors_do_not_depend_on_the_stretch(words):
    import numpy as np
    import pyarrow as pa

    from tessella.llm.slices import Units, cut

    u = Units(pa.array([t for _, t in corpus(5)]), words)
    length, k = (20, 6) if words else (200, 64)
    whole = cut(u, length, k)
    for stretch in (1, 7, 1000):
        assert all(np.array_equal(a, b) for a, b in zip(whole, cut(u, length, k, stretch)))


def test_anchors_of_a_very_long_text_lie_in_their_windows():
    import numpy as np
    import pyarrow as pa

    from tessella.llm.slices import Units, cut

    part = "".join(random.Random(6).choices("abcdefgh ", k=3000))
    u = Units(pa.array([part + "".join(map(chr, range(97, 123))) * ((1 << 24) // 26 + 200) + part]), False)
    _, first, count, anchor = cut(u, 200, 64)
    assert int(count.sum()) == u.size - 199
    assert ((anchor >= first + count - 1) & (anchor + 64 <= first + 200)).all()
    # the same slices on both sides, but for those at the joint
    last = u.size - 3000
    early = {(int(a), int(f), int(c)) for f, c, a in zip(first, count, anchor) if f + c + 199 < 3000 and f > 200}
    late = {(int(a) - last, int(f) - last, int(c)) for f, c, a in zip(first, count, anchor) if f > last + 200}
    assert early and early <= late


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_all_rows_of_a_cut_or_salted_anchor_go_the_other_way(size):
    import numpy as np
    import pyarrow as pa

    from tessella.llm.slices import _sorted_groups

    for counts in ([2, 1, 9, 1, 1], [9, 1, 1, 8, 2], [1, 9, 9, 3], [3], [9], [1] * 6, [2, 12]):
        anchor = np.repeat(np.arange(len(counts)), counts)
        # the last anchor's range is salted
        table = pa.table({"range": np.where(anchor == len(counts) - 1, 5, 2), "anchor": anchor, "at": np.arange(len(anchor))})
        ways, seen = {}, []
        for x, edge in _sorted_groups(table.to_batches(size), ("range", "anchor", "at"), 3):
            seen += x["at"].tolist()
            for a, e in zip(x["anchor"].tolist(), edge.tolist()):
                ways.setdefault(a, []).append(e)
            # whole anchors, but for those that are cut
            assert all(counts[a] == n or edge[x["anchor"] == a].all() for a, n in zip(*map(np.ndarray.tolist, np.unique(x["anchor"], return_counts=True))))
        assert seen == list(range(len(anchor)))
        assert all(len(set(w)) == 1 for w in ways.values()), (counts, ways)
        assert ways[len(counts) - 1][0]


def test_compacted_runs_match_brute_force(spark, monkeypatch):
    from tessella.llm.substrings import FingerprintIndex

    ran, compact = [], FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (ran.append(len(self.runs)), compact(self)))
    docs = corpus(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(spark.createDataFrame(rows(docs), SCHEMA).repartition(5)).collect()}
    assert ran and got == brute.substring_dedup(docs)


def test_a_second_job_goes_on_from_the_manifest(spark):
    from tessella.llm.slices import Layout
    from tessella.llm.store import folder
    from tessella.llm.substrings import GRAM, LENGTH, FingerprintIndex

    docs = corpus(9)
    df = spark.createDataFrame(rows(docs), SCHEMA)
    parts = [df.where(f"doc_id % 6 = {k}") for k in range(6)]
    path = folder(spark)
    index = FingerprintIndex(spark, path, Layout.planned(df, True, LENGTH, GRAM, 4), 4)
    for p in parts[:3]:
        index.add(p)
    assert index.generation == 0 and len(index.runs) == 3
    index.add(parts[3])
    assert index.generation == 1 and len(index.runs) == 1  # compacted
    again = FingerprintIndex.opened(spark, path)
    assert again.history().count() == index.history().count()
    moved = parts[4].withColumn("doc_id", F.col("doc_id") + 1000)
    again.add(parts[4])
    # the same texts once more are repeats from end to end
    alone = FingerprintIndex(spark, folder(spark), Layout.planned(df, True, LENGTH, GRAM, 4), 4)
    repeats = alone.add(moved).where("kind = 0").count()
    assert again.add(moved).where("kind = 0").count() == repeats + alone.history().count() > repeats


def test_history_is_not_shuffled(spark):
    from tessella.llm.slices import JUDGED, Layout, slice_rows
    from tessella.llm.store import folder
    from tessella.llm.substrings import GRAM, LENGTH, FingerprintIndex, merged

    df = spark.createDataFrame(rows(corpus(9)), SCHEMA)
    index = FingerprintIndex(spark, folder(spark), Layout.planned(df, True, LENGTH, GRAM, 4), 4)
    index.add(df)
    new = slice_rows(df, True, LENGTH, GRAM, index.layout)
    plan = new.groupBy("range").cogroup(index.history().groupBy("range")).applyInArrow(merged, f"range long, {JUDGED}")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_windows_are_named_by_their_words():
    import numpy as np

    from tessella.llm.substrings import _window_names

    r = np.random.default_rng(3)
    for length in (1, 2, 3, 7, 20):
        ids = r.integers(0, 2, 400)
        names = _window_names(ids, length)
        words = [tuple(ids[i : i + length].tolist()) for i in range(400 - length + 1)]
        assert len(names) == len(words) and len(set(zip(names.tolist(), words))) == len(set(words)) == len(set(names.tolist()))


def slices_about_one_anchor(seed=11, n=60):
    """Byte strings around a shared core, with its place, where windows start at every distance from the symbols."""
    r = random.Random(seed)
    core = bytes(r.choices(b"abc", k=64))
    parts = [bytes(r.choices(b"abc\0", k=140)) for _ in range(4)]
    content, place = [], []
    for _ in range(n):
        left = bytearray(r.choice(parts)[: r.randint(0, 136)])[::-1]
        right = bytearray(r.choice(parts)[: 136 + r.randint(0, 3)])
        for side in (left, right):
            if side and r.random() < 0.4:
                side[r.randrange(len(side))] = r.choice(b"abcd")
        content.append(bytes(left) + core + bytes(right))
        place.append(len(left))
    return content, place


def test_windows_are_judged_by_the_suffix_array(monkeypatch):
    import numpy as np

    from tessella.llm import suffixes

    content, place = slices_about_one_anchor()
    count = {}
    for c, p in zip(content, place):
        for s in range(len(c) - 199):
            count[c[s : s + 200]] = count.get(c[s : s + 200], 0) + 1
    want = [[count[c[s : s + 200]] > 1 for s in range(len(c) - 199)] for c in content]
    judge = lambda: [f.tolist() for f in suffixes.repeated_windows(content, np.array(place), np.zeros(len(content), bool))]
    assert any(map(any, want)) and not all(map(all, want))
    assert judge() == want
    # any other order than the lexical one loses repeats
    def by_hash(text):
        return sorted(range(len(text)), key=lambda i: hash(tuple(text[i : i + 7])))

    monkeypatch.setattr(suffixes, "suffix_array", by_hash)
    assert judge() != want


def test_common_prefixes_are_counted_in_bytes():
    import numpy as np

    from tessella.llm.suffixes import common_prefixes

    r = random.Random(2)
    text = bytes(r.choices(b"ab", k=300))
    order = sorted(range(300), key=lambda i: text[i:])
    got = common_prefixes(np.frombuffer(text, np.uint8), np.array(order), 300 - np.array(order), 12)
    for k in range(1, 300):
        a, b = text[order[k - 1] :][:12], text[order[k] :][:12]
        assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("f", [suffix_dedup, substring_dedup])
def test_two_texts_with_one_id(spark, f):
    r = random.Random(12)
    line = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    shared = line(60)
    docs = [(1, shared + " " + line(50)), (1, line(300)), (1, "short"), (2, line(5) + " " + shared), (3, line(200))]
    want = getattr(brute, f.__name__)([(10 * i + k, t) for k, (i, t) in enumerate(docs)])
    got = sorted(tuple(x)[:3] for x in f(spark.createDataFrame(rows(docs), SCHEMA)).collect())
    # each text loses its own repeats only
    assert got == sorted((k // 10, *v[:2]) for k, v in want.items())


@pytest.mark.parametrize("f", [suffix_dedup, substring_dedup])
def test_a_very_long_text(spark, f):
    r = random.Random(13)
    text = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(200_000))
    docs = [(1, text), (2, text[700_000:701_000]), (3, text[1_300_000:] + " end")]
    got = {x["doc_id"]: x for x in f(spark.createDataFrame(rows(docs), SCHEMA)).collect()}
    total = got[1][1]
    if f is suffix_dedup:
        assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (1000 + total - 1_300_000, 1000, total - 1_300_000)
    else:
        assert (got[1]["n_removed"], total) == (0, 200_000) and got[2]["n_removed"] >= got[2]["n_words"] - 2 and got[3]["n_words"] - got[3]["n_removed"] <= 2
