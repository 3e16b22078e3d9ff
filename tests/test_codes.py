"""Code lengths, normalised counts and context trees against plain versions."""

import itertools
import math
import random

import pytest

from tessella.operators import codes


def best_cost(counts, limit):
    """Cheapest lengths by trying all that fit into the code space (Kraft sum of 1 at most), longest for the rarest."""
    n, counts = len(counts), sorted(counts, reverse=True)
    best = math.inf
    for lengths in itertools.combinations_with_replacement(range(1, limit + 1), n):
        if sum(2.0**-x for x in lengths) <= 1:
            best = min(best, sum(c * x for c, x in zip(counts, lengths)))
    return best


def test_lengths_are_optimal():
    r = random.Random(1)
    for _ in range(120):
        n = r.randint(2, 6)
        limit = r.randint(math.ceil(math.log2(n)), 5)
        counts = [r.choice((1, 2, r.randint(1, 1000))) for _ in range(n)]
        got = codes.code_lengths(counts, limit)
        assert max(got) <= limit and sum(2.0**-x for x in got) == 1
        assert sum(c * x for c, x in zip(counts, got)) == best_cost(counts, limit)
    assert codes.code_lengths([7]) == [1]
    with pytest.raises(ValueError, match="more symbols"):
        codes.code_lengths([1] * 5, 2)
    # Fibonacci counts need long codes, which the limit cuts
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    assert max(codes.code_lengths(fib, 15)) == 15 and sum(2.0**-x for x in codes.code_lengths(fib, 15)) == 1
    assert max(codes.code_lengths(fib, 40)) == 29


def plain_normalise(counts, precision=4096):
    total, out = sum(counts.values()), {}
    if len(counts) == 1:
        return {k: precision for k in counts}
    for k, n in counts.items():
        out[k] = min(max(n * precision // total, 1), precision - 1)
    top = min(k for k in out if out[k] == max(out.values()))
    rest = precision - sum(out.values())
    return {k: v + (rest if k == top else 0) for k, v in out.items()} if out[top] + rest >= 1 else dict.fromkeys(out)


def test_counts_sum_to_the_precision(spark):
    r = random.Random(2)
    groups = {0: {5: 3}, 1: {0: 1, 1: 10**9}, 2: {k: 1 for k in range(256)}, 3: {k: 2 for k in range(5000)}, 4: {1: 7, 2: 7, 3: 7}}
    groups |= {g: {k: r.choice((1, 5, r.randint(1, 9999))) for k in r.sample(range(256), r.randint(2, 200))} for g in range(5, 15)}
    rows = [(g, k, n) for g, c in groups.items() for k, n in c.items()] + [(4, 9, 0)]
    got = {}
    for x in codes.normalised(spark.createDataFrame(rows, "grp int, symbol int, n long"), ["grp"]).collect():
        got.setdefault(x.grp, {})[x.symbol] = x.frequency
    assert got == {g: plain_normalise(c) for g, c in groups.items()}
    assert all(sum(v.values()) == 4096 for g, v in got.items() if g != 3)


def test_lengths_of_groups(spark):
    rows = [(1, 3, 10), (1, 4, 0), (1, 9, 5), (1, 200, 5), (2, 7, 1)]
    got = codes.with_lengths(spark.createDataFrame(rows, "grp int, symbol int, n long"), ["grp"]).collect()
    assert sorted((x.grp, x.symbol, x.length) for x in got) == [(1, 3, 1), (1, 9, 2), (1, 200, 2), (2, 7, 1)]


def bits(tokens):
    n = len(tokens)
    return sum(math.log2(n / tokens.count(t)) for t in tokens)


def plain_tree(samples, contexts, least_gain, least_samples):
    """samples: [(properties, token)]; nodes {path: (n, property, threshold, gain, context)}."""

    def look(own):
        best = (0.0, -1, 0)
        if len(own) >= least_samples:
            whole = bits([t for _, t in own])
            for p in range(len(own[0][0])):
                for t in codes.THRESHOLDS:
                    up, low = [x for v, x in own if v[p] > t], [x for v, x in own if v[p] <= t]
                    gain = round(whole - bits(up) - bits(low), 9) if up and low else 0.0
                    if gain > best[0] + 1e-7:
                        best = gain, p, t
        return best if best[0] >= least_gain else (best[0], -1, 0)

    frontier, nodes = [("", samples, look(samples))], {}
    while len(frontier) < contexts:
        able = [f for f in frontier if f[2][1] >= 0]
        if not able:
            break
        pick = max(able, key=lambda f: f[2][0])
        frontier.remove(pick)
        path, own, (gain, p, t) = pick
        nodes[path] = (len(own), p, t, gain, -1)
        for bit in (1, 0):
            part = [s for s in own if (s[0][p] > t) == bool(bit)]
            frontier.append((f"{path}{bit}", part, look(part)))
    order = sorted(frontier, key=lambda f: (len(f[0]), [c == "0" for c in f[0]]))
    return nodes | {path: (len(own), -1, 0, 0.0, i) for i, (path, own, _) in enumerate(order)}


def test_context_trees_match_a_plain_learner(spark):
    r = random.Random(4)
    data = {}
    for g, n in ((1, 900), (2, 300), (3, 1), (4, 150)):
        rows = []
        for _ in range(n):
            p = (r.randint(-80, 80), r.choice((-3, 0, 5, 200)), r.randint(0, 9))
            token = (0 if p[0] > 8 else 3 if p[1] > 2 else 1 + (p[2] > 4)) if g != 4 else 0
            rows.append((p, token if r.random() < 0.9 else r.randint(0, 5) * (g != 4)))
        data[g] = rows
    df = spark.createDataFrame([(g, *p, t) for g, rows in data.items() for p, t in rows] + [(None, 1, 1, 1, 1), (1, None, 1, 1, 1)], "g int, p0 int, p1 int, p2 int, token int").repartition(3)
    for contexts in (2, 4, 12):
        got = {}
        for x in codes.context_tree(df, "g", ["p0", "p1", "p2"], "token", contexts, 8.0, 20).collect():
            got.setdefault(x.grp, {})[x.path] = (x.n, x.property, x.threshold, round(x.gain, 5), x.context)
        want = {g: {k: (*v[:3], round(v[3], 5), v[4]) for k, v in plain_tree(rows, contexts, 8.0, 20).items()} for g, rows in data.items()}
        assert got == want
    assert any(len(v) > 5 for v in want.values())
    assert codes.context_tree(df.limit(0), "g", ["p0"], "token").collect() == []
