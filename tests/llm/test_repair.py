"""Conversation repair against SQL and against all edit sequences of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessella.llm import repair
from tessella.llm.oracle import ORACLE
from tessella.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string, kind int, dropped string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(spark, rows):
    """Rows with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        if how:
            out += [(conv, turn, role, text)] * (2 if how == 3 else 1)
    return out


def best_edits(rows, faults):
    """(cost, edits, repaired rows) over all edit sequences, by dynamic programming on whole role strings instead of states."""
    ways = {"": (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for roles, (cost, audit, kept) in list(out.items()):
                for role in ("user", "assistant"):
                    if re.fullmatch("s?(ua)*u?", roles + role[0]):
                        way = cost + 2, audit + "I", (*kept, (role, ""))
                        out[roles + role[0]] = min(out.get(roles + role[0], way), way)
        return out

    for (role, text), fault in zip(rows, faults):
        after = {}

        def offer(roles, way, after=after):
            if re.fullmatch("s?(ua)*u?", roles):
                after[roles] = min(after.get(roles, way), way)

        for roles, (cost, audit, kept) in inserted(ways).items():
            offer(roles, (cost + 3, audit + "D", kept))
            if fault in (0, 3):
                late = cost + (fault == 3)
                if role[:1]:
                    offer(roles + role[:1], (late, audit + "K", (*kept, (role, text))))
                for to in ("user", "assistant"):
                    offer(roles + to[0], (late + 2, audit + "R", (*kept, (to, text))))
        ways = after
    return min(w for roles, w in inserted(ways).items() if re.fullmatch("(s?(ua)+)?", roles))


def brute(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        of = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in of:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {r[1] for r in of if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(of)]
        cost, audit, kept = best_edits([r[2:] for r in of], faults)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=str)


def test_query_matches_sql(spark, duck, sf_dir):
    df = QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert df.columns == COLUMNS
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_conversation_repair']})").fetchall(), key=str)


def made(seed, conversations, longest):
    r = random.Random(seed)
    out = []
    for conv in [*range(conversations), None]:
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "super"])
            text = r.choice(["Yes.", "No?", "fine", "", None, "\t \n", f"what {r.randint(0, 3)}!", " ends. \n", "日本。", "x" * 70 + r.choice("ab")])
            out.append((conv, r.choice([turn, turn, turn, turn, turn + 5, None]), role, text))
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_equals_brute_force(spark, block):
    rows = made(3, 40, 9)
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = repair.repaired(repair.damaged(table(spark, rows)), "dropped", block)
            assert sorted(map(tuple, got.collect()), key=str) == brute(rows, damage(rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_conversations_that_lose_all_rows(spark):
    rows = [(c, 0, "user", "Hi.") for c in range(200)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(repair.damaged(table(spark, rows)), "dropped").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(got) == 200 and gone and all(got[c] == (0, 0, 0, 0, 0, 0, "", empty) for c in gone)
    assert repair.repaired(table(spark, [])).collect() == []


def test_a_long_conversation_is_cut_and_put_together(spark):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "no", f"well {t % 900}.", f"{t}!"])) for t in range(5000)]
    rows += [(c, t, "user", f"{t}.") for c in (0, 2) for t in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        got = {x.conv_id: tuple(x) for x in repair.repaired(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    seen, faults = set(), []
    for _, _, role, text in rows[:5000]:
        faults.append(2 if (role, text) in seen else 3 if text[-1] not in ".!" else 0)
        seen.add((role, text))
    initials = tuple(x[2][0] for x in rows[:5000])
    best = [(0, ""), None, None, None]
    for initial, fault in zip(initials, faults):  # a forward pass, row by row
        after = [None] * 4
        for s, way in enumerate(best):
            for e, (cost, audit) in repair.search((initial,), (fault,), s, (0, 1, 2, 3)).items() if way else ():
                new = way[0] + cost, way[1] + audit
                after[e] = new if after[e] is None else min(after[e], new)
        best = after
    cost, audit = min(best[s] for s in (0, 3) if best[s])
    assert got[1][2:8] == (0, faults.count(2), faults.count(3), sum(a + b not in ("ua", "au") for a, b in itertools.pairwise(initials)), cost, audit)
    kept = repair.edited(audit, (x[2:] for x in rows[:5000]))
    assert got[1][8] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
    assert {*got} == {0, 1, 2}
