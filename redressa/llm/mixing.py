"""Mixing sources to target weights: token budgets down a tree, and a token-prefix of seeded epochs per leaf.

DataFrame functions only. The tree's levels are columns of the documents, such as domain, language and
source. From the root down, each node's budget is shared among its children by weight, but no child gets
more than its subtree holds in all epochs; what one cannot use goes to its siblings in proportion, and
only what all of them cannot use was never given to their parent. A leaf goes through its documents in a
seeded order, anew in every epoch, and takes whole documents while they fit its budget.

No leaf is ordered as a whole: tokens are summed over bins of the order, the bin in which the budget
ends is found from these sums, and only that bin's documents are put in order, to find the last one that
fits; rows that share an id, which no bin parts, are cut again by their length and their tag. Every document is then compared with its leaf's last one where it is read; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.operators.lookup import lookup_join
from redressa.operators.ordering import running_total

#: Documents a bin should have, the binary digits of the order that bins are cut from, and bins that are summed together.
BIN, BIN_BITS, STRETCH = 2000, 32, 4096
#: Budgets are rounded to this many digits before they are cut to whole tokens.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def level_of(column: Column) -> Column:
    """A tree level's value; null is a value of its own."""
    return F.coalesce(column.cast("string"), F.lit("unknown"))


def domain_of(source: Column) -> Column:
    """Sources are numbered; their remainder by three stands for the domain."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % 3, F.lit(0)).cast("string"))


def water_fill(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Children (parent columns, ``name``, capacity, weight, budget of the parent) with their share of that budget.

    The children whose capacity is least for their weight are full first; the rest share what is left
    by weight. A weight of 0 gives nothing.
    """
    least = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    level = children.withColumn("_least", least)
    order = Window.partitionBy(*parent).orderBy("_least", name)
    group = Window.partitionBy(*parent)
    earlier = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = (F.col("weight") > 0) & (earlier + F.col("_least") * later <= F.col("budget") + 1e-6)
    level = level.withColumn("_full", full)
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0.0))
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(group)
    share = F.when(F.col("_full"), F.col("capacity")).when(F.col("weight") <= 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.col("budget") - taken) / open_weight * F.col("weight")
    )
    return level.withColumn("budget", share).drop("_least", "_full")


def _weight(column: str, weights: Mapping[str, float]) -> Column:
    """The weight given to a value; 1 for one that is not listed."""
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(column) == value, F.lit(float(weight))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int) -> DataFrame:
    """Leaves (levels, tokens, n) with their budget in whole tokens: ``share`` of all tokens, dealt down the tree.

    There is one row per node of the tree, far fewer than documents; no node's children leave Spark.
    """
    given = leaves.groupBy(F.lit(0).alias("_root")).agg((F.sum("tokens") * share).alias("budget"))
    above: list[str] = ["_root"]
    rooted = leaves.withColumn("_root", F.lit(0))
    for depth, level in enumerate(levels):
        keys = [*above, level]
        children = rooted.groupBy(*keys).agg((F.sum("tokens") * epochs).cast("double").alias("capacity"))
        children = children.withColumn("weight", _weight(level, weights.get(level, {}))).join(given, above)
        given = water_fill(children, above, level).select(*keys, "budget")
        above = keys
    return rooted.join(given, above).drop("_root").withColumn("budget", F.floor(F.round("budget", DIGITS)).cast("long"))


def _first_beyond(rows: DataFrame, levels: Sequence[str], piece: Column, numbered: bool = False) -> DataFrame:
    """Per leaf of rows (levels, n_tokens, _rest, _before) the first piece of their order with which the tokens exceed _rest.

    Result: levels, _piece, _before (the tokens up to it), _n (its rows); none if all rows fit. Pieces that are
    ``numbered`` may be very many: their sums run within stretches of them.
    """
    pieces = rows.withColumn("_piece", piece).groupBy(*levels, "_rest", "_before", "_piece").agg(
        F.sum("n_tokens").alias("_in"), F.count(F.lit(1)).alias("_n")
    )
    if numbered:
        summed = running_total(pieces, "_in", "_piece", levels, F.floor(F.col("_piece") / STRETCH), "_sum")
    else:
        summed = pieces.withColumn("_sum", F.sum("_in").over(Window.partitionBy(*levels).orderBy("_piece")))
    beyond = summed.withColumn("_upto", F.col("_before") + F.col("_sum")).filter(F.col("_upto") > F.col("_rest"))
    first = beyond.groupBy(*levels).agg(F.min(F.struct("_piece", (F.col("_upto") - F.col("_in")).alias("_before"), "_n")).alias("cut"))
    return written(first.select(*levels, "cut.*"), "mix-cut")


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int = 1, seed: int = 0
) -> DataFrame:
    """How often each document is taken: ``docs`` (levels, doc_id, tag, n_tokens, others) with budget and copies.

    ``tag`` tells rows of one id apart. A leaf's budget first buys whole epochs; in the next one the
    documents come in the order of md5(seed, epoch, doc_id), then id, length and tag, as long as the sum of
    their tokens stays within the rest. The columns named others are only carried along; the plan reads the rest.
    """
    narrow = docs.select(*levels, "doc_id", "tag", "n_tokens")
    leaves = written(narrow.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-leaves")
    budgets = leaf_budgets(leaves, levels, weights, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))
    plan = (
        budgets.withColumn("_whole", F.least(whole, F.lit(epochs)).cast("long"))
        .withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
        .withColumn("_bins", F.ceil(F.col("n") / BIN))
    )
    plan = written(plan.select(*levels, "budget", "_whole", "_rest", "_bins"), "mix-plan")

    def drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows with their leaf's plan, their place in the order, and their bin."""
        place = F.md5(F.concat_ws(":", F.lit(seed), F.col("_whole"), F.col("doc_id")))
        placed = lookup_join(rows, plan, list(levels), "inner").withColumn("_place", place)
        head = F.conv(F.substring("_place", 1, BIN_BITS // 4), 16, 10).cast("long")
        order = F.struct("_place", "doc_id", "n_tokens", "tag")
        return placed.withColumns({"_bin": F.floor(head * F.col("_bins") / F.lit(1 << BIN_BITS)), "_order": order})

    binned = written(drawn(narrow, plan).select(*levels, "n_tokens", "_rest", "_bin", "_order"), "mix-drawn")
    cut = _first_beyond(binned.withColumn("_before", F.lit(0).cast("long")), levels, F.col("_bin"), numbered=True)
    bin_cut = cut.select(*levels, F.col("_piece").alias("_cut"))
    # Rows of one id share a bin; where the budget ends in it is found by id and length, by tag, and row by row.
    spread = F.floor((F.col("_order.tag").cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("_n") / BIN))
    edge = binned.withColumns({"_at": F.col("_bin"), "_n": F.lit(0)})
    for piece in (F.struct("_order._place", "_order.doc_id", "n_tokens"), spread, F.col("_order")):
        inside = lookup_join(edge.drop("_before", "_n"), cut, list(levels), "inner").filter("_at = _piece")
        edge = written(inside.drop("_piece").withColumn("_at", piece), "mix-edge")
        cut = _first_beyond(edge, levels, F.col("_at"))
    last = cut.select(*levels, F.col("_piece").alias("_stop"), F.col("_before").alias("_upto"))
    ends = plan.join(bin_cut, list(levels), "left").join(last, list(levels), "left")
    ends = written(ends.select(*levels, "budget", "_whole", "_rest", "_bins", "_cut", "_stop", "_upto"), "mix-ends")
    all_rows = drawn(docs, ends)
    first = F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut"))
    fitting = (F.col("_order") < F.col("_stop")) | ((F.col("_order") == F.col("_stop")) & (F.col("_upto") + F.col("n_tokens") <= F.col("_rest")))
    fits = first | ((F.col("_bin") == F.col("_cut")) & fitting)
    copies = F.col("_whole") + F.when(fits & (F.col("_whole") < epochs), 1).otherwise(0)
    return all_rows.select(*docs.columns, "budget", copies.cast("long").alias("copies"))


def described(docs: DataFrame) -> DataFrame:
    """Documents by domain, language and source with their number of words."""
    return docs.select(
        "doc_id", F.xxhash64("text").alias("tag"), domain_of(F.col("source")).alias("domain"), level_of(F.col("lang")).alias("lang"),
        level_of(F.col("source")).alias("source"), count_words(F.col("text")).alias("n_tokens"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float, seed: int = 0) -> DataFrame:
    """The documents of one epoch that fit the budgets of the domain-language-source tree, with their own columns only."""
    # The documents travel in one column, so that none of theirs meets a column of the plan.
    rows = docs.select(
        F.struct(*docs.columns).alias("_document"), "doc_id", F.xxhash64("text").alias("tag"), count_words(F.col("text")).alias("n_tokens"),
        domain_of(F.col("source")).alias("domain"), level_of(F.col("lang")).alias("lang"), level_of(F.col("source")).alias("source"),
    )
    return mix(rows, ["domain", "lang", "source"], weights, share, seed=seed).filter("copies > 0").select("_document.*")
