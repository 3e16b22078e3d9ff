"""Repair of the structure of conversations by a cheapest sequence of edits.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its
rows are taken by turn, nulls first, ties by the first 64 characters of role and
text, then by both whole. The first of these faults of a row counts: ``blank`` (no
character but white space), ``duplicate`` (role and text stood in an earlier row),
``truncated`` (the last character but white space is none of ``.!?``). Edits: K keeps
a row (0), R makes its role user or assistant (2), D deletes it (3; the only edit for
blank and duplicate rows), I inserts an empty user or assistant row (2); a truncated
row that stays costs 1 more.

``search`` is Dijkstra's algorithm on the implicit lattice of (rows taken, state of
the grammar) with (cost, edits so far) as the key, which ends at the first accepting
end node that leaves the queue: the cheapest edits, ties to the least string. Paths
to one node with one cost have as many letters but I and as many I, so neither is a
prefix of the other, and what follows keeps their order.

Rows are sorted over the cluster by conversation and turn. A conversation within one
partition is settled there. One that reaches the edge of its partition, or has more
rows than BLOCK, is cut into blocks: for each block a search from each of the four
states gives a table of (cost, edits) to each state, and a fold along the blocks puts
tables together. So no task holds a long conversation, only its edits, a byte a row,
which are a value of the result. The digest of a repaired conversation is a SHA-256,
which can only be taken in order: the rows of a long conversation pass through one
task for it, one at a time.

Null role and text count as one space, a null conv_id is a conversation of its own,
repeated rows are duplicates, other columns are ignored. A conversation without rows
has zeros, empty edits and the digest of the empty string.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import stored

#: Rows and characters of a conversation that are taken at once.
BLOCK, BLOCK_CHARS = 512, 4 << 20
#: Longest conversation whose edits a worker remembers by its shape.
SHORT = 64
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
NAMED, SOUND, BLANK, DUPLICATE, TRUNCATED = range(-1, 4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "kind int, part int, seq long, turn long, role string, text string, fault int, digest binary, " + REPAIRED
BLOCKS = (
    "conv_id long, part int, block long, first string, last string, turns long, first_turn long, last_turn long, low long, high long, "
    "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that the check sum of ``conv_id:turn`` modulo 20 says.

    0 drops the row (it stays with ``dropped`` set, so that its conversation is known),
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    how = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat("how", F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("dropped"), twice.alias("how")).drop("how")


def advance(state: int, initial: str) -> int | None:
    """The state after a row with this initial, if the grammar allows one."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def search(initials: tuple[str, ...], faults: tuple[int, ...], start: int, goals: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """(cost, edits) of the first end node popped, by its state; of all goals if there is more to come after these rows."""
    n, open_goals, found = len(initials), set(goals), {}
    queue, done = [(0, "", 0, start)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in open_goals:
            found[state] = cost, audit
            open_goals.remove(state)
            if goals == ENDS or not open_goals:
                break
        forced = AFTER_A if state == AFTER_U else AFTER_U
        heapq.heappush(queue, (cost + 2, audit + "I", i, forced))
        if i < n:
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if faults[i] in (SOUND, TRUNCATED):
                stays = cost + (faults[i] == TRUNCATED)
                heapq.heappush(queue, (stays + 2, audit + "R", i + 1, forced))
                kept = advance(state, initials[i])
                if kept is not None:
                    heapq.heappush(queue, (stays, audit + "K", i + 1, kept))
    return found


@functools.lru_cache(1 << 15)
def _of_shape(initials: tuple[str, ...], faults: tuple[int, ...]) -> tuple[int, str]:
    return min(search(initials, faults, START, ENDS).values())


def cheapest(initials: tuple[str, ...], faults: tuple[int, ...]) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return (_of_shape if len(initials) <= SHORT else _of_shape.__wrapped__)(initials, faults)


class Walk:
    """Role and text of the rows of a repaired conversation, while the rows before the repair come one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _step(self, row: tuple[str, str]) -> tuple[str, str]:
        letter, (role, text) = self.audit[self.at], row
        self.at += 1
        if letter == "K":
            self.state = advance(self.state, role[:1])
            return role, text
        self.state = AFTER_A if self.state == AFTER_U else AFTER_U
        return ("assistant" if self.state == AFTER_A else "user"), text

    def take(self, row: tuple[str, str]):
        """Rows up to and with the one that has come."""
        yield from self.rest()
        if self.audit[self.at] == "D":
            self.at += 1
        else:
            yield self._step(row)

    def rest(self):
        """Rows that are inserted next."""
        while self.audit[self.at : self.at + 1] == "I":
            yield self._step(("", ""))


def edited(audit: str, rows):
    """(role, text) of the repaired conversation."""
    walk = Walk(audit)
    for row in rows:
        yield from walk.take(row)
    yield from walk.rest()


class _Digest:
    """SHA-256 of ``role:text`` of rows that come one at a time, newlines between them."""

    def __init__(self):
        self.sum, self.empty = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sum.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False


def _digest(rows) -> str:
    out = _Digest()
    for role, text in rows:
        out.add(role, text)
    return out.sum.hexdigest()


def _fault(role: str, text: str, seen: set[bytes]) -> tuple[int, bytes]:
    """Fault of a row and the digest of its role and text."""
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    body = text.rstrip(SPACE)
    if not body:
        return BLANK, key
    if key in seen:
        return DUPLICATE, key
    seen.add(key)
    return (SOUND if body[-1] in ".!?" else TRUNCATED), key


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _counts(faults) -> list[int]:
    return [faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.strip().split(" ") for c in schema.split(",")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


class _Partition:
    """Goes through the sorted rows of a partition; holds one conversation, and no more than a block of it."""

    def __init__(self, part: int, block: int):
        self.part, self.block, self.seq, self.out = part, block, 0, []
        self.begun = False
        self.begin(None, cut=False)

    def begin(self, conv: int | None, cut: bool) -> None:
        self.conv, self.held, self.size, self.seen, self.cut = conv, [], 0, set(), cut

    def pieces(self) -> None:
        """Hands on what is held of a conversation that is not settled here."""
        for turn, role, text, fault, key in self.held:
            self.out.append((1, self.part, self.seq, turn, role, text, fault, key, self.conv, *[None] * 8))
            self.seq += 1
        self.held, self.size = [], 0

    def settle(self) -> None:
        rows = [r for r in self.held if r[3] != NAMED]
        initials, faults = tuple(r[1][:1] for r in rows), tuple(r[3] for r in rows)
        cost, audit = cheapest(initials, faults)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = _digest(edited(audit, (r[1:3] for r in rows)))
        self.out.append((0, *[None] * 7, self.conv, gaps, *_counts(faults), _illegal(initials), cost, audit, digest))

    def add(self, conv, turn, role, text, dropped) -> None:
        if not self.begun:
            # it may have begun in the partition before
            self.begin(conv, cut=True)
            self.begun = True
        elif conv != self.conv:
            self.pieces() if self.cut else self.settle()
            self.begin(conv, cut=False)
        fault, key = (NAMED, None) if dropped else _fault(role, text, self.seen)
        self.held.append((turn, role, text, fault, key))
        self.size += len(text) + len(role)
        if self.cut or len(self.held) > self.block or self.size > BLOCK_CHARS:
            self.cut = True
            self.pieces()


def _settled(rows: DataFrame, block: int) -> DataFrame:
    """Results (kind 0) of the conversations that lie within a partition, and the rows (kind 1) of all others with their places."""
    short = [F.substring(c, 1, 64) for c in ("role", "text")]
    ordered = rows.repartitionByRange("conv_id", "turn", *short).sortWithinPartitions("conv_id", "turn", *short, "role", "text")

    def run(batches):
        work = _Partition(TaskContext.get().partitionId(), block)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                work.add(*row)
                if len(work.out) >= 4096:
                    yield _batch(work.out, ROWS)
                    work.out = []
        # the last conversation may go on in the next partition
        work.pieces()
        yield _batch(work.out, ROWS)

    return ordered.mapInArrow(run, ROWS)


def _block(key, table):
    """Table of costs and edits, and the counts, of a block."""
    conv, part, block = (v.as_py() for v in key)
    found_rows = zip(*(table.column(c).to_pylist() for c in ("seq", "turn", "initial", "fault")))
    rows = sorted((r for r in found_rows if r[3] != NAMED), key=lambda r: r[0])
    initials, faults = tuple(r[2] for r in rows), tuple(r[3] for r in rows)
    turns = [r[1] for r in rows if r[1] is not None]
    costs, audits = [], []
    for start in range(4):
        found = search(initials, faults, start, (START, AFTER_S, AFTER_U, AFTER_A))
        for end in range(4):
            cost, audit = found.get(end, (None, None))
            costs.append(cost)
            audits.append(audit)
    ends = (initials[0], initials[-1]) if initials else (None, None)
    of_turns = (len(set(turns)), turns[0], turns[-1], min(turns), max(turns)) if turns else (0, None, None, None, None)
    return pa.Table.from_batches([_batch([(conv, part, block, *ends, *of_turns, *_counts(faults), _illegal(list(initials)), costs, audits)], BLOCKS)])


class _Fold:
    """Puts the blocks of a conversation together, in order."""

    def __init__(self, conv):
        self.conv, self.settled = conv, []
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.last, self.last_turn, self.low, self.high, self.turns = None, None, None, None, 0
        self.counts = [0, 0, 0, 0]

    def add(self, r: dict) -> None:
        self.counts = [x + r[c] for x, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"))]
        if r["first"] is not None:
            self.counts[3] += self.last is not None and self.last + r["first"] not in LEGAL
            self.last = r["last"]
        if r["turns"]:
            self.turns += r["turns"] - (self.last_turn is not None and r["first_turn"] == self.last_turn)
            self.low = r["low"] if self.low is None else self.low
            self.high, self.last_turn = r["high"], r["last_turn"]
        after: list[tuple[int, str] | None] = [None] * 4
        for start, so_far in enumerate(self.best):
            for end in range(4):
                cost = r["costs"][4 * start + end]
                if so_far is not None and cost is not None:
                    way = so_far[0] + cost, so_far[1] + r["audits"][4 * start + end]
                    after[end] = way if after[end] is None else min(after[end], way)
        # what all ways share decides nothing any more
        shared = os.path.commonprefix([w[1] for w in after if w is not None])
        self.settled.append(shared)
        self.best = [w and (w[0], w[1][len(shared) :]) for w in after]

    def row(self) -> tuple:
        cost, rest = min(self.best[s] for s in ENDS if self.best[s] is not None)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return -1, -1, None, None, None, self.conv, gaps, *self.counts, cost, "".join(self.settled) + rest


PLACED = "part int, seq long, role string, text string, fault int, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _folded(blocks: DataFrame) -> DataFrame:
    """A row for each conversation with counts, cost and edits, placed before the rows of the conversation."""

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Fold(r["conv_id"])
                now.add(r)
            yield _batch(out, PLACED)
        if now is not None:
            yield _batch([now.row()], PLACED)

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, PLACED)


def _digested(placed: DataFrame) -> DataFrame:
    """Results of conversations whose edits come first and whose rows follow in order."""

    def result(head, walk, digest) -> tuple:
        for row in walk.rest():
            digest.add(*row)
        return *head, digest.sum.hexdigest()

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for part, _, role, text, fault, *head in zip(*(c.to_pylist() for c in batch.columns)):
                if part == -1:
                    if now is not None:
                        out.append(result(*now))
                    now = head, Walk(head[-1]), _Digest()
                elif fault != NAMED:
                    for row in now[1].take((role, text)):
                        now[2].add(*row)
            yield _batch(out, REPAIRED)
        if now is not None:
            yield _batch([result(*now)], REPAIRED)

    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, REPAIRED)


def repaired(rows: DataFrame, dropped: str | None = None, block: int = BLOCK) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every conversation (columns REPAIRED).

    rows: conv_id, turn, role, text. dropped: a boolean column; where it is true a row only names its conversation.
    block: rows of a conversation that are taken at once; it changes no result.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    table = stored(_settled(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text, gone.alias("dropped")), block))
    pieces = table.where("kind = 1")
    # a text seen in an earlier partition; the others of a partition are known to be repeated there
    own = F.concat_ws(":", "part", "seq").cast("binary")
    key = F.when(F.col("fault").isin(SOUND, TRUNCATED), F.col("digest")).otherwise(own)
    slim = pieces.select("conv_id", "part", "seq", "turn", F.substring("role", 1, 1).alias("initial"), "fault", key.alias("key"))
    earliest = F.min("part").over(Window.partitionBy("conv_id", "key"))
    slim = slim.withColumn("fault", F.when(earliest < F.col("part"), DUPLICATE).otherwise(F.col("fault"))).drop("key")
    blocks = slim.withColumn("block", F.floor(F.col("seq") / block)).groupBy("conv_id", "part", "block").applyInArrow(_block, BLOCKS)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in [(c, "long") for c in COUNTS] + [("audit", "string")]]
    placed = _folded(blocks).unionByName(pieces.select("part", "seq", "role", "text", "fault", "conv_id", *nothing))
    columns = [c.split(" ")[0] for c in REPAIRED.split(", ")]
    return table.where("kind = 0").select(*columns).unionByName(_digested(placed).select(*columns))
