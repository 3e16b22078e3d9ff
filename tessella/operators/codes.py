"""What entropy coders need of a corpus: code lengths, normalised counts, context trees.

Counting symbols is an aggregate over all images at once. What is left of a group is as
many rows as its alphabet has symbols, or a histogram of bins and tokens, whatever the
size of its images; lengths and splits are worked out on those bounded groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import stored

#: What normalised counts sum to, and the longest code.
PRECISION, LONGEST = 4096, 15
#: Where properties may be cut.
THRESHOLDS = (-64, -32, -16, -8, -4, -2, -1, 0, 1, 2, 4, 8, 16, 32, 64, 128)


def symbol_counts(pixels: DataFrame, channels: tuple[str, ...] = tuple("rgba")) -> DataFrame:
    """image_id, channel, symbol, n."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("symbol")) for c in channels)))
    return pixels.select("image_id", each.alias("s")).groupBy("image_id", "s.channel", "s.symbol").agg(F.count("*").alias("n"))


def code_lengths(counts: list[int], limit: int = LONGEST) -> list[int]:
    """Lengths of an optimal prefix code of at most ``limit`` bits for positive counts; a single symbol has length 1.

    Package-merge: ``limit`` times, the symbols are merged with pairs of the packages before,
    symbols first on a tie. A symbol's length is the number of the cheapest packages that hold
    it: the cheapest of a round are its first symbols and pairs of the cheapest of the round before.
    """
    n = len(counts)
    if n == 1:
        return [1]
    if n > 1 << limit:
        raise ValueError("more symbols than codes")
    counts = np.asarray(counts, np.int64)
    by_count = np.argsort(counts, kind="stable")
    single = counts[by_count]
    packages, rounds = single[:0], []
    for _ in range(limit):
        both = np.concatenate([single, packages[: len(packages) // 2 * 2].reshape(-1, 2).sum(1)])
        order = np.argsort(both, kind="stable")
        packages = both[order]
        rounds.append(np.concatenate([[0], np.cumsum(order < n)]))
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for singles in reversed(rounds):
        symbols = int(singles[taken])
        lengths[by_count[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths.tolist()


def with_lengths(counts: DataFrame, keys: list[str], limit: int = LONGEST) -> DataFrame:
    """Adds ``length`` to symbol, n of each group; symbols that don't occur are left out."""
    kept = counts.where("n > 0").select(*keys, F.col("symbol").cast("int").alias("symbol"), F.col("n").cast("long").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("symbol")
        return table.append_column("length", pa.array(code_lengths(table.column("n").to_numpy(), limit), pa.int32()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return kept.groupBy(*keys).applyInArrow(run, f"{fields}, length int")


def normalised(counts: DataFrame, keys: list[str], precision: int = PRECISION) -> DataFrame:
    """keys, symbol, n, frequency: counts scaled to sum to ``precision``, at least 1 each.

    What rounding leaves goes to the most frequent symbol, the first one on a tie. A group
    with more symbols than that can bear has ``frequency`` null. Windows only.
    """
    of, first = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("f"), "symbol")
    seen = counts.where("n > 0").withColumns({"total": F.sum("n").over(of), "used": F.count("*").over(of)})
    scaled = F.expr(f"n * {precision} div total")
    seen = seen.withColumn("f", F.least(F.greatest(scaled, F.lit(1)), F.lit(precision - 1)))
    seen = seen.withColumns({"left": precision - F.sum("f").over(of), "top": F.row_number().over(first) == 1, "most": F.max("f").over(of)})
    value = F.when(F.col("used") == 1, precision).when(F.col("most") + F.col("left") >= 1, F.col("f") + F.when(F.col("top"), F.col("left")).otherwise(0))
    return seen.select(*keys, "symbol", "n", value.cast("int").alias("frequency"))


# --- context trees ------------------------------------------------------------------


def bin_of(value: Column) -> Column:
    """How many thresholds lie below a value."""
    return sum(((value > t).cast("int") for t in THRESHOLDS), F.lit(0))


def _bits(h: np.ndarray) -> np.ndarray:
    """Bits that counts along the last axis cost at their own entropy."""
    total = h.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, total * np.log2(total) - np.where(h > 0, h * np.log2(h), 0).sum(-1), 0.0)


def best_split(histogram: np.ndarray) -> tuple[float, int, int]:
    """(gain in bits, property, threshold number) of the best cut of a histogram (property, bin, token); the first one on a tie."""
    low = np.cumsum(histogram, axis=1)[:, :-1]
    whole = histogram[0].sum(0)
    high = whole - low
    gain = np.round(_bits(whole) - _bits(low) - _bits(high), 9)
    gain[(low.sum(-1) == 0) | (high.sum(-1) == 0)] = 0.0
    at = int(gain.argmax())
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


NODES = "grp long, path string, n long, property int, threshold int, gain double"
CHOSEN = NODES + ", split boolean, open boolean, context int"


def _choose(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Which known nodes of a group are split when the one with the most gain is split next, until there are ``most`` leaves; ``open``: its children are not known."""
    known = {r.path: r for r in frame.itertuples()}
    frontier, split = [""], set()
    while len(frontier) < most:
        able = [p for p in frontier if p in known and known[p].property >= 0]
        if not able:
            break
        # the earliest one of equal gain
        pick = max(able, key=lambda p: known[p].gain)
        split.add(pick)
        frontier.remove(pick)
        frontier += [pick + "1", pick + "0"]
    leaves = sorted((p for p in frontier if p in known), key=lambda p: (len(p), [c == "0" for c in p]))
    context = {p: i for i, p in enumerate(leaves)}
    return frame.assign(
        split=[p in split for p in frame["path"]],
        open=[p in split and p + "1" not in known for p in frame["path"]],
        context=np.array([context.get(p, -1) for p in frame["path"]], np.int32),
    )


def context_tree(samples: DataFrame, group: str, properties: list[str], token: str, contexts: int = 64, least_gain: float = 96.0, least_samples: int = 1024) -> DataFrame:
    """A tree of cuts of properties for each group that makes tokens cheapest: grp, path, n, property, threshold, gain, context.

    path: 1 for a property above its threshold, 0 otherwise, from the root down; context
    numbers the leaves level by level, above before below, and is -1 for a cut; property is
    -1 for a leaf. A node is cut if it has ``least_samples`` and gains ``least_gain`` bits,
    the one that gains most first, until there are ``contexts`` leaves.

    Samples are counted by bins once, which loses nothing, as cuts lie between bins. Each
    round then counts the new nodes of all groups in one aggregate, so there are as many
    rounds as the deepest tree has levels. Samples with nulls are left out.
    """
    spark = samples.sparkSession
    bins = [f"b{k}" for k in range(len(properties))]
    seen = samples.dropna(subset=[group, token, *properties]).select(F.col(group).cast("long").alias("grp"), F.col(token).cast("int").alias("token"), *(bin_of(F.col(p)).cast("int").alias(b) for p, b in zip(properties, bins)))
    cells = stored(seen.groupBy("grp", "token", *bins).agg(F.count("*").alias("n")).withColumn("path", F.lit("")), "cells")
    nodes = spark.createDataFrame([], NODES)
    fresh = cells

    def evaluate(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((len(properties), len(THRESHOLDS) + 1, int(frame["token"].max()) + 1))
        np.add.at(h, (frame["p"].to_numpy(), frame["bin"].to_numpy(), frame["token"].to_numpy()), frame["n"].to_numpy())
        n = int(h[0].sum())
        gain, prop, cut = best_split(h) if n >= least_samples else (0.0, 0, 0)
        cut_it = gain >= least_gain and gain > 0
        return pd.DataFrame([(frame["grp"].iloc[0], frame["path"].iloc[0], n, prop if cut_it else -1, THRESHOLDS[cut] if cut_it else 0, gain)], columns=["grp", "path", "n", "property", "threshold", "gain"])

    while True:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("p"), F.col(b).alias("bin")) for k, b in enumerate(bins))))
        counted = fresh.select("grp", "path", "token", "n", each.alias("e")).groupBy("grp", "path", "token", "e.p", "e.bin").agg(F.sum("n").alias("n"))
        found = counted.groupBy("grp", "path").applyInPandas(evaluate, NODES)
        chosen = stored(nodes.unionByName(found).groupBy("grp").applyInPandas(lambda frame: _choose(frame, contexts), CHOSEN), "nodes")
        grow = chosen.where("open").select("grp", "path", "property", "threshold")
        if grow.isEmpty():
            break
        nodes = chosen.select("grp", "path", "n", "property", "threshold", "gain")
        # the cells of new nodes; cells of others stay where they are
        value = F.get(F.array(*bins), F.col("property"))
        cut = sum(((F.col("threshold") > t).cast("int") for t in THRESHOLDS), F.lit(0))
        moved = cells.join(grow, ["grp", "path"], "left").withColumn("new", F.col("property").isNotNull())
        moved = moved.withColumn("path", F.concat("path", F.when(F.col("new"), F.when(value > cut, "1").otherwise("0")).otherwise("")))
        cells = stored(moved.select("grp", "token", *bins, "n", "path", "new"), "cells")
        fresh = cells.where("new")
        cells = cells.drop("new")
    # what was looked at but not reached is no node
    reached = chosen.where("split or context >= 0")
    leaf = ~F.col("split")
    return reached.select("grp", "path", "n", F.when(leaf, -1).otherwise(F.col("property")).alias("property"), F.when(leaf, 0).otherwise(F.col("threshold")).alias("threshold"), F.when(leaf, 0.0).otherwise(F.col("gain")).alias("gain"), "context")
