"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full sets.

A document's set is its distinct five-word shingles, lower case; a text with
fewer words is one shingle; a null text or one without words has the empty set
and links with nothing. Documents link when 100 * |A and B| >= 75 * |A or B|;
groups are the connected components.

1. Equal sets are found by digest and represented by their smallest doc_id.
2. Forest: each of 32 trees orders the representatives by its own sequence of
   signature values. A global sort per tree puts those with long common
   prefixes side by side. Documents that share the first four values form a
   region. Its depth adapts to what it holds: a small region proposes all its
   pairs; a larger one is split by the next value, and the next, up to eight,
   until its parts are small. In a large region a document is also proposed with
   its neighbour in the order, which shares the longest prefix.
3. Proposals that the signatures put far under the threshold go. Of the rest
   each document's most similar one is confirmed on the full texts first; links
   make components; then every proposal that still joins two components is
   confirmed.
4. Large regions that still hold several components propose again, each
   document with its neighbour in another component and with the most similar
   one of another component within reach, until no link is found.
5. What still could link two components is found exactly: all documents of
   large regions are joined on the rarest shingles of their sets. Two sets at
   the threshold share one among them, early enough in both that the rest can
   reach the threshold. A shingle whose documents are one component is left
   out; of the others only pairs across components are compared.

Rows with one doc_id are one document, whatever their order: it links with another if
any of its texts does, and all its rows have one component. A row without a doc_id is
compared for equality only: it is kept unless a document with an id has the same set,
whose component it gets. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.packed import Texts, mix, pieces, sequence_hashes, window_starts
from tessella.llm.store import dropped, stored

U64 = np.uint64
TREES, DEPTH = 32, 4
HASHES = TREES * DEPTH
SMALL_REGION, NEIGHBOURS = 8, 1
#: Rows of a part of a large region that proposes all its pairs; parts of the rows of a class when labels are given out.
SMALL_PART, SALTS = 4, 16
#: Rows before and after one in a tree's order among which the most alike is sought, by the low bytes of so many values.
REACH, GLANCE = 32, 64
#: Equal signature values (of 128) below which a pair of 0.75 is five standard errors away.
LEAST_EQUAL = 72
#: Counters of shingles by hash, from which the order of rarity is taken; any order gives the same links.
COUNTERS = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(99))
_A = _RNG.integers(0, 1 << 64, HASHES, dtype=U64) | U64(1)
_B = _RNG.integers(0, 1 << 64, HASHES, dtype=U64)
PAIRS = "a long, b long"
SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"


def shingles(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of all distinct shingles, ordered by document."""
    t = Texts(texts, lower=True)
    w = t.word_hashes()
    s, doc = window_starts(t.first, words)
    keys = sequence_hashes(w, s, s + words)
    count = np.diff(t.first)
    few = np.flatnonzero((count > 0) & (count < words))
    keys = np.concatenate([keys, sequence_hashes(w, t.first[few], t.first[few + 1], seed=2)])
    doc = np.concatenate([doc, few])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], keys[new]


def _sketches(batches):
    for batch in batches:
        for part in pieces(batch):
            n = part.num_rows
            doc, keys = shingles(part.column("text"))
            size = np.bincount(doc, minlength=n)
            full = np.flatnonzero(size)
            start = np.searchsorted(doc, full)
            sig = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
            d1, d2 = np.zeros(n, U64), np.zeros(n, U64)
            if len(full):
                for j in range(HASHES):
                    sig[full, j] = np.minimum.reduceat((keys * _A[j] + _B[j]) >> U64(32), start)
                d1[full] = np.add.reduceat(mix(keys), start)
                d2[full] = np.add.reduceat(mix(keys ^ U64(0x5851F42D4C957F2D)), start)
            # low bytes of all values, then high bytes
            both = np.concatenate([sig.astype(np.uint8), (sig >> np.uint32(8)).astype(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([x.tobytes() for x in both], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "signature"],
            )


def _forest_rows(batches):
    """A row per tree: the first values, 16 bits each, with the tree in the lowest, and the next values."""
    extra = None
    for batch in batches:
        extra = [c for c in batch.schema.names if c in ("component", "glance")]
        ids = np.repeat(batch.column("rep").to_numpy(), TREES)
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, 2 * HASHES)
        values = raw[:, :HASHES].astype(U64) | (raw[:, HASHES:].astype(U64) << U64(8))

        def packed(first):
            out = np.zeros((len(values), TREES), U64)
            for k in range(DEPTH):
                out = (out << U64(16)) | values[:, (np.arange(TREES) * DEPTH + first + k) % HASHES]
            return out

        region = mix(packed(0) * U64(0x9E3779B97F4A7C15) + np.arange(TREES, dtype=U64)).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(packed(DEPTH).ravel().view(np.int64)), pa.array(ids), *(batch.column(c).take(pa.array(np.repeat(np.arange(batch.num_rows), TREES))) for c in extra)], names=["region", "tail", "rep", *extra])


def _regions(batches, columns):
    """Sorted rows, cut so that a region is whole; only one longer than 100,000 rows is cut."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GLANCE) if c == "glance" else batch.column(c).to_numpy() for c in columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        end = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if end == 0 and len(held[0]) > 100_000:
            end = len(held[0])
        if end:
            yield [x[:end] for x in held]
            held = [x[end:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _with_edges(regions):
    """(region, tail, rep, may the row's region go on elsewhere): the first and the last region of a partition, and one that was cut."""
    held, before = None, None
    for region, tail, rep in regions:
        if held is not None:
            yield *held, (held[0] == held[0][-1]) & (held[0][-1] == region[0]) | (True if before is None else held[0] == before) & (held[0] == held[0][0])
            before = held[0][-1]
        held = (region, tail, rep)
    if held is not None:
        yield *held, (held[0] == held[0][-1]) | (True if before is None else held[0] == before) & (held[0] == held[0][0])


def _propose(batches):
    """Pairs from sorted (region, tail, rep); a document with itself marks that it stands in a large region, or one that may go on in another partition."""
    for region, tail, rep, cut in _with_edges(_regions(batches, ("region", "tail", "rep"))):
        start = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(start, len(region)))
        many = (np.repeat(size, size) > SMALL_REGION) | cut
        at = np.arange(len(region)) - np.repeat(start, size)
        a, b = [], []
        for k in range(1, SMALL_REGION):
            i = np.flatnonzero((at >= k) & (~many | (k <= NEIGHBOURS)))
            a.append(rep[i]), b.append(rep[i - k])
        # large regions, deeper and deeper until a part is small
        open_ = many & ~cut
        for depth in range(1, DEPTH + 1):
            if not open_.any():
                break
            prefix = tail.view(U64) >> U64(16 * (DEPTH - depth))
            start = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (prefix[1:] != prefix[:-1])))
            size = np.diff(np.append(start, len(region)))
            at = np.arange(len(region)) - np.repeat(start, size)
            small = open_ & (np.repeat(size, size) <= SMALL_PART)
            for k in range(1, SMALL_PART):
                i = np.flatnonzero(small & (at >= k))
                a.append(rep[i]), b.append(rep[i - k])
            open_ &= ~small
        a.append(rep[many]), b.append(rep[many])
        yield _pairs(np.concatenate(a), np.concatenate(b))


def _most_alike(region: np.ndarray, comp: np.ndarray, glance: np.ndarray) -> np.ndarray:
    """For each row the row of another component in its region, within reach in the order, with most equal values; -1 if there is none."""
    n = len(region)
    best, at = np.zeros(n, np.int64), np.full(n, -1)
    for k in range(1, min(REACH + 1, n)):
        i = np.flatnonzero((region[k:] == region[:-k]) & (comp[k:] != comp[:-k]))
        equal = np.count_nonzero(glance[i + k] == glance[i], axis=1)
        for one, other in ((i + k, i), (i, i + k)):
            more = equal > best[one]
            best[one[more]], at[one[more]] = equal[more], other[more]
    return at


def _propose_across(batches):
    """Pairs of different components, from large regions in sorted (region, tail, rep, component, glance)."""
    for region, _, rep, comp, glance in _regions(batches, ("region", "tail", "rep", "component", "glance")):
        start = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(start, len(region)))
        head = np.repeat(start, size)
        many = np.repeat(size, size) > SMALL_REGION
        # the last row before each one that has another component
        turn = np.append(False, comp[1:] != comp[:-1])
        before = np.maximum.accumulate(np.where(turn, np.arange(len(comp)), 0)) - 1
        i = np.flatnonzero(many & (before >= head))
        alike = _most_alike(region, comp, glance)
        j = np.flatnonzero(many & (alike >= 0))
        yield _pairs(np.concatenate([rep[i], rep[j]]), np.concatenate([rep[before[i]], rep[alike[j]]]))


def _equal_values(batches):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
        equal = (x == y).sum(1)
        near = pa.array(equal >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal, pa.int32())], names=["a", "b", "equal"]).filter(near)


def _near_enough(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs with the number of equal signature values (their low bytes), without the hopeless ones."""
    s = reps.select("rep", F.substring("signature", 1, HASHES).alias("sketch"))
    both = pairs.join(s.withColumnsRenamed({"rep": "a", "sketch": "sa"}).hint("merge"), "a").join(s.withColumnsRenamed({"rep": "b", "sketch": "sb"}).hint("merge"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_equal_values, "a long, b long, equal int")


def _confirm(batches):
    for batch in batches:
        for part in pieces(batch, "ta", 1 << 19):
            da, ka = shingles(part.column("ta"))
            db, kb = shingles(part.column("tb"))
            n = part.num_rows
            both = np.sort(np.concatenate([mix(k + d.astype(U64) * U64(0x9E3779B97F4A7C15)) for k, d in ((ka, da), (kb, db))]))
            common = both[:-1][both[1:] == both[:-1]]
            own = mix(ka + da.astype(U64) * U64(0x9E3779B97F4A7C15))
            shared = np.bincount(da[np.isin(own, common)], minlength=n)
            union = np.bincount(da, minlength=n) + np.bincount(db, minlength=n) - shared
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array((union > 0) & (100 * shared >= 75 * union))], names=["a", "b", "linked"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked, from full sets."""
    t = texts.select("doc_id", "text")
    both = pairs.select("a", "b").join(t.withColumnsRenamed({"doc_id": "a", "text": "ta"}).hint("merge"), "a").join(t.withColumnsRenamed({"doc_id": "b", "text": "tb"}).hint("merge"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long, linked boolean")


def _shingle_counts(batches):
    """Counters of the shingles of all texts."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for part in pieces(batch):
            _, keys = shingles(part.column("text"))
            total += np.bincount((keys % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])


def _rarest(counts: np.ndarray):
    """The rarest shingles of each text with their place i among its n: those that can be the first one shared with a set of the least size that still links."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                doc, keys = shingles(part.column("text"))
                often = counts[(keys % U64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((keys, often, doc))
                doc, keys, often = doc[order], keys[order], often[order]
                size = np.bincount(doc, minlength=part.num_rows)
                i = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
                # a counter of 1 is a shingle that no other text has
                at = np.flatnonzero((4 * i <= size[doc]) & (often > 1))
                d = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), part.column("doc_id").take(d), part.column("component").take(d), pa.array(size[doc[at]].astype(np.int32)), pa.array(i[at].astype(np.int32))], names=["shingle", "rep", "component", "n", "i"])

    return run


def _across(texts: DataFrame) -> DataFrame:
    """All pairs of (doc_id, text, component) across components that can link: a superset of the links, without a signature.

    Sets of n and m shingles link if they share 3/7 of n + m. The first shared one in the
    order of rarity, at places i and j, leaves n - i and m - j at most.
    """
    counts = np.zeros(COUNTERS, np.int32)
    sums = texts.mapInArrow(_shingle_counts, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts[sums.column("counter").to_numpy()] = np.minimum(sums.column("n").to_numpy(), (1 << 31) - 1)
    rows = stored(texts.mapInArrow(_rarest(counts), "shingle long, rep long, component long, n int, i int"))
    shared = rows.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.count("*").alias("k"), F.max_by("component", "c").alias("main"))
    mixed = stored(rows.join(shared.where("k > 1").select("shingle", "main").hint("merge"), "shingle"))
    # every pair has an end outside the shingle's largest component
    x, y = mixed.where("component <> main").drop("main").alias("x"), mixed.drop("main").alias("y")
    fits = F.expr("x.shingle = y.shingle and x.component <> y.component and 7 * x.i <= 4 * x.n - 3 * y.n and 7 * y.i <= 4 * y.n - 3 * x.n")
    out = stored(x.join(y.hint("merge"), fits).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), slim=True)
    dropped(rows, mixed)
    return out


def _best_partners(near: DataFrame) -> DataFrame:
    """a, b: the pair of each document with most equal values."""
    best = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b", "equal"), F.struct(F.col("b").alias("node"), "a", "b", "equal"))).alias("x")).select("x.*")
    return best.groupBy("node").agg(F.max(F.struct("equal", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


def _crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    c = comps.select("node", "component")
    out = pairs.join(c.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(c.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(slim.mapInArrow(_sketches, SKETCH))
    slices = max(1, slim.sparkSession.sparkContext.defaultParallelism, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal sets are brought together before they are shuffled
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "signature")).alias("m"), F.count("*").alias("n"))
    classes = stored(classes.select("d1", "d2", F.col("m.doc_id").alias("rep"), "m.signature", "n"))
    # texts that share an id may make two classes: both stand for it
    reps = classes.select("rep", "signature")
    # an id with several sets brings the classes of all of them together
    several = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high"))
    several = several.where("low <> high").select("doc_id")
    same = sketched.where("n_shingles > 0").join(several, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    same = stored(same.where("a <> b").distinct(), slim=True)

    def sorted_forest(rows: DataFrame, kept: str) -> DataFrame:
        trees = rows.mapInArrow(_forest_rows, kept)
        return trees.repartitionByRange(slices, "region", "tail", "rep").sortWithinPartitions("region", "tail", "rep")

    proposed = stored(sorted_forest(reps, "region long, tail long, rep long").mapInArrow(_propose, PAIRS).distinct(), slim=True)
    near = stored(_near_enough(proposed.where("a <> b"), reps), slim=True)
    crowded = proposed.where("a = b").select(F.col("a").alias("rep"))
    # only texts that a proposal needs, now or later
    ends = near.select(F.explode(F.array("a", "b")).alias("doc_id")).union(crowded).distinct()
    texts = stored(slim.where("doc_id is not null").join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    # the most similar partner of each document first
    tried = stored(_confirmed(_best_partners(near), texts), slim=True)
    # two rounds find most of the components, which is enough to see what is left to try
    rough = components(tried.where("linked"), rounds=2)
    rest = _crossing(near.join(tried.select("a", "b"), ["a", "b"], "left_anti"), rough)
    tried_more = stored(_confirmed(rest, texts), slim=True)
    links = tried.where("linked").select("a", "b").union(tried_more.where("linked").select("a", "b")).union(same)
    known = proposed.where("a <> b")
    comps = components(links)
    crowd = stored(reps.join(crowded.hint("merge"), "rep", "left_semi"))
    while True:
        labelled = crowd.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("glance", F.substring("signature", 1, GLANCE))
        forest = sorted_forest(labelled, "region long, tail long, rep long, component long, glance binary")
        # what the signatures put under the threshold once is not compared again
        asked = stored(forest.mapInArrow(_propose_across, PAIRS).distinct().join(known, ["a", "b"], "left_anti"), slim=True)
        known = known.union(asked)
        more = stored(_near_enough(asked, reps), slim=True)
        if more.isEmpty():
            break
        found = stored(_confirmed(more, texts), slim=True)
        if found.where("linked").isEmpty():
            break
        links = links.union(found.where("linked").select("a", "b"))
        comps = components(links)
    # what no proposal brought up, exactly
    labelled = texts.join(crowded.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    unmet = _across(stored(labelled.select("doc_id", "text", "component"))).join(known, ["a", "b"], "left_anti")
    last = stored(_near_enough(unmet, reps), slim=True)
    if not last.isEmpty():
        tried = stored(_confirmed(_best_partners(last), texts), slim=True)
        links = links.union(tried.where("linked").select("a", "b"))
        rest = _crossing(last.join(tried.select("a", "b"), ["a", "b"], "left_anti"), components(links))
        links = links.union(stored(_confirmed(rest, texts), slim=True).where("linked").select("a", "b"))
        comps = components(links)
    # only classes of several rows or links; a frequent class is dealt to several tasks
    label = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), (F.col("component").isNotNull() | (F.col("n") > 1)).alias("told"))
    nameless = sketched.where("doc_id is null and n_shingles > 0").select("d1", "d2").distinct()
    label = label.where("told").drop("told").unionByName(label.where("not told").drop("told").join(nameless, ["d1", "d2"], "left_semi"))
    label = label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt"))
    # rows without words have no key to meet under
    full = own.where("d1 is not null").join(label, ["d1", "d2", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = full.unionByName(own.where("d1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    dropped(texts, near, proposed, crowd)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
