"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is root, domain, language, source. A token budget flows down from the
root in proportion to integer weights. No node takes more than its capacity,
``max_epochs`` times the tokens of its leaves. What a node can't take goes to
its siblings first (a water level among the children of one parent); only when
all children of a parent are full does the parent pass the rest to its own
siblings, because the parent's capacity is the sum of theirs.

Each leaf then reads its documents in seeded epochs: epoch ``e`` orders them by
``md5(seed:e:doc_id)`` and the leaf takes whole epochs first and then the
prefix of the next one that meets its budget. The prefix sums are taken over
hash ranges first and within one range after, so a leaf that holds a third of
all rows is spread over thousands of groups.

Null or unknown names form nodes of their own (``?``). Null texts have no
tokens. Repeated rows are documents of their own. A document that crosses the
budget is taken with ``take_tokens`` below its ``tokens``. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import stored

#: Production weights; names not listed weigh 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
SEED = 17
LEAF = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null counts as none."""
    # each word, with the space before it, becomes one character; the added word leaves no space at the end
    marks = F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" x")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return (F.length(marks) - 1).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, joined by one space."""
    return F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, n.cast("int")), " ")


def source_domain(source: Column) -> Column:
    """``domain0`` to ``domain3`` by the number at the end of a source's name."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("?")).otherwise(F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        out = F.when(name == key, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def water_fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``budget``: how ``parent_budget`` splits over siblings with ``weight`` and ``cap``, in whole tokens.

    The siblings of one parent are ordered by capacity for their weight, so they
    meet in one window: a row for each name, not for each document.
    """
    of = Window.partitionBy(*parent)
    fill = [F.expr("cap div weight"), F.col("cap") % F.col("weight") / F.col("weight"), F.col(child)]
    by = of.orderBy(*fill).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.col("parent_budget") - F.coalesce(F.sum("cap").over(by), F.lit(0)), F.lit(0))
    weight_left = F.sum("weight").over(of) - F.coalesce(F.sum("weight").over(by), F.lit(0))
    nodes = nodes.withColumns({"_left": left, "_weight_left": weight_left, "_rank": F.row_number().over(of.orderBy(*fill))})
    # products of tokens and weights can pass 2^63
    tokens, weights = "decimal(22,0)", "decimal(16,0)"
    nodes = nodes.withColumn("_full", F.col("cap").cast(tokens) * F.col("_weight_left").cast(weights) <= F.col("_left").cast(tokens) * F.col("weight").cast(weights))
    level = F.min(F.when(~F.col("_full"), F.struct("_rank", "_left", "_weight_left"))).over(of)
    nodes = nodes.withColumn("_level", level)
    share = F.expr(f"cast(_level._left as {tokens}) * cast(weight as {weights}) div _level._weight_left")
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share.cast("long"))).drop("_left", "_weight_left", "_rank", "_full", "_level")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, domain_weights, language_weights, source_weights) -> DataFrame:
    """Rows (domain, lang, source, leaf_tokens) to the same with ``budget``; ``budget`` may use ``total``, all tokens."""
    leaves = leaves.withColumn("cap", F.col("leaf_tokens") * max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("leaf_tokens").alias("tokens"))
    everything = Window.partitionBy()
    domains = domains.withColumn("total", F.sum("tokens").over(everything)).withColumn("parent_budget", budget.cast("long")).withColumn("weight", _weight(F.col("domain"), domain_weights))
    domains = water_fill(domains.drop("tokens", "total"), [], "domain").select("domain", F.col("budget").alias("parent_budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("weight", _weight(F.col("lang"), language_weights))
    langs = water_fill(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    leaves = leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), source_weights))
    return water_fill(leaves, ["domain", "lang"], "source").select(*LEAF, "leaf_tokens", "budget")


def mix_sources(
    docs: DataFrame,
    domain: Column | None = None,
    budget: Column | None = None,
    max_epochs: int = 2,
    seed: int = SEED,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    language_weights: Mapping[str, int] = LANGUAGE_WEIGHTS,
    source_weights: Mapping[str, int] = SOURCE_WEIGHTS,
    keep: tuple[str, ...] = (),
    range_digits: int = 3,
) -> DataFrame:
    """One row for each chosen document and epoch: doc_id, domain, lang, source, epoch, tokens, before_tokens, take_tokens and the columns in ``keep``.

    budget: tokens to choose, an expression that may use ``total`` (all tokens
    of ``docs``); half of them by default. range_digits: each leaf's order is
    cut into 16 to that power hash ranges. keep: columns to carry, under their
    names with ``keep_`` before them.

    Words are counted once, into a stored table of a few numbers a document;
    with ``keep`` they are counted a second time instead, so that the carried
    columns are not stored.
    """
    domain = source_domain(F.col("source")) if domain is None else domain
    budget = F.expr("total div 2") if budget is None else budget
    name = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), n_words(F.col("text")).alias("tokens"), *(F.col(f"`{c}`").alias(f"keep_{c}") for c in keep)
    )
    if not keep:
        slim = stored(slim)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    def in_epochs(rows: DataFrame, last: Column) -> DataFrame:
        return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), last))).withColumn("_key", order).withColumn("_range", F.substring("_key", 1, range_digits))

    # tokens of each hash range of each leaf and epoch; from them the leaf totals and budgets
    ranges = stored(in_epochs(slim, F.lit(max_epochs - 1)).groupBy(*LEAF, "epoch", "_range").agg(F.sum("tokens").alias("range_tokens")), slim=True)
    leaves = ranges.where("epoch = 0").groupBy(*LEAF).agg(F.sum("range_tokens").alias("leaf_tokens"))
    budgets = leaf_budgets(leaves, budget, max_epochs, domain_weights, language_weights, source_weights).where("budget > 0")
    # the last epoch that a leaf's budget reaches
    budgets = stored(budgets.withColumn("last_epoch", F.expr("(budget - 1) div leaf_tokens").cast("int")), slim=True)
    up_to = Window.partitionBy(*LEAF, "epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_tokens").over(up_to), F.lit(0)))
    ranges = ranges.join(budgets, list(LEAF)).withColumn("range_before", F.col("range_before") + F.col("epoch") * F.col("leaf_tokens")).where("range_before < budget").select(*LEAF, "epoch", "_range", "range_before", "budget")
    rows = in_epochs(slim.join(budgets.select(*LEAF, "last_epoch"), list(LEAF)), F.col("last_epoch")).drop("last_epoch")
    within = Window.partitionBy(*LEAF, "epoch", "_range").orderBy("_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    chosen = rows.join(ranges, [*LEAF, "epoch", "_range"]).withColumn("before_tokens", F.col("range_before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return chosen.where("before_tokens < budget").select("doc_id", *LEAF, "epoch", "tokens", "before_tokens", F.least("tokens", F.col("budget") - F.col("before_tokens")).alias("take_tokens"), *(f"`keep_{c}`" for c in keep))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The chosen rows of ``docs`` with all its columns, once for each epoch.

    The document that crosses its leaf's budget is cut after ``take_tokens``
    words, joined by one space; ``n_chars`` follows where it exists.
    """
    kept = lambda c: F.col(f"`keep_{c}`")
    cut = F.col("take_tokens") < F.col("tokens")
    text = F.when(cut, first_words(kept("text"), F.col("take_tokens"))).otherwise(kept("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(kept("n_chars"))
    return mix_sources(docs, keep=tuple(docs.columns), **options).select(*(changed.get(c, kept(c)).alias(c) for c in docs.columns))
