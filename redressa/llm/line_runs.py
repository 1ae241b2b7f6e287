"""Repeated runs of lines, by a suffix array over line ids; DataFrame functions only.

Every line that is not blank is a place; blank lines go with the line before them. A line that occurs
again gets an id, the start of its class; all others have an id of their own and take no part in the sorting. Prefix
doubling refines the classes: round k knows the order of places by their first 2**k lines, as an offset within the
class of their first line, and sorts the members of a class by the place 2**k lines on. The ids of a text are one
array, so that place is looked up in the same row; only members that are still level with others and have
lines left are taken out, sorted, and put back. A text without such members leaves the rounds. Small
classes are sorted by a window each, larger ones spread over many tasks. Suffixes end with their text.

Where a class splits, the longest common prefix of the neighbours on both sides is 2**k if the next lines differ;
else the lines after them tell, which are compared once the array is sorted, and only if the lines before
differ, as a prefix that could begin earlier is a part of a longer one. Later copies of runs are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.operators.lookup import lookup_join
from redressa.operators.ordering import with_position

#: Lines that a run has at least; members of a class that one task sorts at most.
LEAST_LINES, LARGE = 1, 1 << 16
#: What follows the last line of a text; it is before all ids.
END = -(1 << 63)
DOC = ["_doc", "_tag"]
PLACE = [*DOC, "pos"]


def lines_of(text: Column) -> Column:
    """The lines of a text; none for null or empty."""
    return F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("_tag"), "text"
    )


def places_of(docs: DataFrame) -> DataFrame:
    """(_doc, _tag, pos, line, next, a, b): every line that is not blank, with a 128-bit hash of it, white space at its end aside.

    ``pos`` counts these lines, ``line`` all; ``next`` is the line of the one after, or how many there are. Rows of one id
    and text are one document here. A text is split once.
    """
    hashed = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (x == "").alias("blank"))
    lines = F.transform(F.transform(lines_of(F.col("text")), lambda x: F.rtrim(x)), hashed)
    rows = _keyed(docs).select(*DOC, F.size(lines_of(F.col("text"))).alias("n"), F.filter(lines, lambda s: ~s["blank"]).alias("solid"))
    one = rows.groupBy(*DOC).agg(F.any_value("n").alias("n"), F.any_value("solid").alias("solid"))
    place = lambda s, i: F.struct(
        i.alias("pos"), s["line"].alias("line"), F.coalesce(F.get("solid", i + 1)["line"], F.col("n")).alias("next"), s["a"].alias("a"), s["b"].alias("b")
    )
    return one.select(*DOC, F.inline(F.transform("solid", place)))


def line_classes(places: DataFrame) -> DataFrame:
    """One row per text: ``lines``, an array of (pos, start, off, size) by pos, and ``spans``, its (line, next).

    ``start`` is the id of the line, not negative if it occurs again, ``size`` how many places have it; ``off`` is 0.
    """
    places = written(places, "line-places")
    counts = places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    ids = written(counts.withColumn("start", F.monotonically_increasing_id()), "line-ids")
    named = lookup_join(places, ids, ["a", "b"], "left")
    own = -F.shiftrightunsigned("a", 2) - 1
    number = F.struct(F.coalesce("start", own).alias("start"), F.lit(0).cast("long").alias("off"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    rows = named.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("pos", number.alias("number"), "line", "next"))).alias("all"))
    lines = F.transform("all", lambda p: F.struct(p["pos"].alias("pos"), p["number"]["start"].alias("start"), p["number"]["off"].alias("off"), p["number"]["size"].alias("size")))
    spans = F.transform("all", lambda p: F.struct(p["line"].alias("line"), p["next"].alias("next")))
    return written(rows.select(*DOC, lines.alias("lines"), spans.alias("spans")), "line-classes")


def _is_open(place: Column, step: int) -> Column:
    """Whether a place is level with others by its first ``step`` lines, and not because all of them end before."""
    return (place["size"] > 1) & (place["pos"] + step <= F.size("lines"))


def _by_window(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("start", "off").orderBy("start2", "off2")
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = pairs.withColumns({
        "_rank": F.rank().over(order), "_row": F.row_number().over(order), "_before": F.lag("start2").over(order), "_peers": F.count(F.lit(1)).over(peers)
    })
    fresh = (F.col("_row") == F.col("_rank")) & (F.col("_rank") > 1)
    return ranked.select(
        *PLACE, "start", (F.col("off") + F.col("_rank") - 1).alias("off"), F.col("_peers").alias("size"), F.when(fresh, F.col("_before")).alias("before"), "start2"
    )


def _by_position(pairs: DataFrame) -> DataFrame:
    """The same for classes of any size."""
    own, second = ["start", "off"], ["start2", "off2"]
    placed = with_position(pairs.drop("size"), [*second, *PLACE], own, "_at")
    parts = placed.groupBy(*own, *second).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("size"), F.min(F.struct(*PLACE)).alias("_one"))
    parts = written(parts, "line-parts")
    previous = parts.select(*own, (F.col("_first") + F.col("size")).alias("_first"), F.col("start2").alias("before"))
    rows = lookup_join(placed, parts.join(previous, [*own, "_first"], "left"), [*own, *second], "inner")
    first = F.struct(*PLACE) == F.col("_one")
    return rows.select(*PLACE, "start", (F.col("off") + F.col("_first") - 1).alias("off"), "size", F.when(first, F.col("before")).alias("before"), "start2")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def suffix_array(classes: DataFrame, snapshot: int = 0, large: int = LARGE) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(array, borders, level): the sorted places, where neighbours differ, and the classes by the first 2**snapshot lines.

    ``array`` and ``level`` have one row per text with a line that occurs again: ``lines`` as in ``classes``; ``off`` is where in
    the order of the places of its first line a place stands, which suffixes that are equal to their end share.
    ``borders`` has (start, at, least, exact): the place at ``at`` and the one before it share ``least`` lines, or at least so many if
    not ``exact``; None if no class has split.
    """
    state = classes.select(*DOC, "lines").filter(F.exists("lines", lambda p: p["size"] > 1))
    finished, borders, level, k = [], [], None, 0
    while True:
        if k == snapshot:
            level = _union([*finished, state])
        step = 1 << k
        is_open = lambda p: _is_open(p, step)  # noqa: B023, E731
        there = lambda p: F.get("lines", p["pos"] + step)  # noqa: B023, E731
        pair = lambda p: F.struct(
            p["pos"].alias("pos"), p["start"].alias("start"), p["off"].alias("off"), p["size"].alias("size"),
            F.coalesce(there(p)["start"], F.lit(END)).alias("start2"), F.coalesce(there(p)["off"], F.lit(0)).alias("off2"),
        )
        pairs = state.select(*DOC, F.inline(F.transform(F.filter("lines", is_open), pair)))
        n, largest = pairs.agg(F.count(F.lit(1)), F.max("size")).first()
        split = None
        if n:
            split = _by_window(pairs.filter(F.col("size") <= large))
            if largest > large:
                split = split.unionByName(_by_position(pairs.filter(F.col("size") > large)))
            split = written(split, "line-split")
            fresh = split.filter("before IS NOT NULL")
        if split is None or fresh.isEmpty():
            # Where no class splits, more lines split none either.
            array = _union([*finished, state])
            return array, _union(borders) if borders else None, array if level is None else level
        other = F.col("before") != F.col("start2")
        borders.append(fresh.select(
            "start", F.col("off").alias("at"), F.when(other, step).otherwise(step + 1).cast("int").alias("least"), (other | F.lit(k == 1)).alias("exact")
        ))
        moved = split.groupBy(*DOC).agg(F.collect_list(F.struct("pos", "start", "off", "size")).alias("moved"))
        finished.append(state.filter(~F.exists("lines", is_open)))
        merged = F.array_sort(F.concat(F.filter("lines", lambda p: ~is_open(p)), "moved"))
        state = written(state.join(moved, DOC).select(*DOC, merged.alias("lines")), "line-state")
        k += 1


def longest_runs(classes: DataFrame, array: DataFrame, borders: DataFrame | None) -> DataFrame:
    """(_doc, _tag, longest): lines of the longest run in a text that occurs anywhere else, for texts that have one."""
    before = lambda p: F.get("lines", p["pos"] - 1)["start"]
    place = lambda p: F.struct(
        p["pos"].alias("pos"), p["start"].alias("start"), p["off"].alias("off"), p["size"].alias("size"),
        F.when(p["pos"] > 0, before(p)).alias("before"), (F.size("lines") - p["pos"]).alias("left"),
    )
    places = array.select(*DOC, F.inline(F.transform(F.filter("lines", lambda p: p["start"] >= 0), place)))
    places = written(places, "line-array")
    level = places.filter("size > 1")
    found = level.groupBy(*DOC).agg(F.max("left").alias("longest"))
    if borders is None:
        return found
    one = F.min(F.struct(*PLACE, "before")).alias("one")
    shown = level.groupBy("start", "off", "size").agg(one).select("start", "off", "size", "one.*")
    shown = places.filter("size = 1").select("start", "off", "size", *PLACE, "before").unionByName(shown)
    side = lambda name, at: shown.select(
        "start", at.alias("at"), F.struct(*PLACE).alias(name), (F.col("size") == 1).alias(f"{name}_alone"), F.col("before").alias(f"{name}_before")
    )
    pairs = borders.join(side("two", F.col("off")), ["start", "at"]).join(side("one", F.col("off") + F.col("size")), ["start", "at"])
    # Where the lines before are equal too, both texts have a longer run.
    inner = F.coalesce(F.col("one_before") == F.col("two_before"), F.lit(False))
    pairs = written(pairs.filter(~inner).drop("one_before", "two_before"), "line-pairs")
    known = pairs.filter("exact").withColumn("lcp", F.col("least")).unionByName(_compared(classes, pairs.filter("NOT exact")))
    both = F.array(*[F.when(F.col(f"{name}_alone"), F.struct(F.col(f"{name}._doc"), F.col(f"{name}._tag"))) for name in ("one", "two")])
    told = known.select(F.inline(F.filter(both, lambda d: d.isNotNull())), F.col("lcp").alias("longest"))
    return found.unionByName(told).groupBy(*DOC).agg(F.max("longest").alias("longest"))


def _compared(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with lcp, the lines that both places share: those from ``least`` on are compared, up to twice as many."""
    ids = classes.select(*DOC, F.transform("lines", lambda p: p["start"]).alias("ids"))

    def ahead(name: str) -> DataFrame:
        # A text's requests come together, so its ids are moved once.
        asked = pairs.select(f"{name}.*", "start", "at", "least").groupBy(*DOC).agg(F.collect_list(F.struct("start", "at", "pos", "least")).alias("asked"))
        cut = lambda r: F.struct(r["start"].alias("start"), r["at"].alias("at"), F.slice("ids", r["pos"] + r["least"] + 1, r["least"]).alias(f"{name}_ids"))
        return asked.join(ids, DOC).select(F.inline(F.transform("asked", cut)))

    whole = pairs.join(ahead("one"), ["start", "at"]).join(ahead("two"), ["start", "at"])
    same = F.zip_with("one_ids", "two_ids", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    more = F.when(first > 0, first - 1).otherwise(F.size(same))
    return whole.withColumn("lcp", (F.col("least") + more).cast("int")).drop("one_ids", "two_ids")


def _later_copies(level: DataFrame, least: int, snapshot: int) -> DataFrame:
    """(_doc, _tag, pos) of every line in a run of ``least`` lines that begins in an earlier place too.

    Two overlapping runs of 2**snapshot lines cover a run, so their classes tell.
    """
    ahead = least - (1 << snapshot)
    second = lambda p: F.get("lines", p["pos"] + ahead)
    whole = F.filter("lines", lambda p: (p["size"] > 1) & (p["pos"] + least <= F.size("lines")))
    run = lambda p: F.struct(
        p["pos"].alias("pos"), p["start"].alias("s1"), p["off"].alias("o1"), second(p)["start"].alias("s2"), second(p)["off"].alias("o2")
    )
    runs = written(level.select(*DOC, F.inline(F.transform(whole, run))), "line-runs")
    name = ["s1", "o1", "s2", "o2"]
    leader = runs.groupBy(*name).agg(F.min(F.struct(*PLACE)).alias("_leader"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = lookup_join(runs, leader, name, "inner").filter(F.struct(*PLACE) != F.col("_leader"))
    if least == 1:
        return later.select(*PLACE)
    return later.select(*DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + least - 1)).alias("pos")).distinct()


def remove_runs(docs: DataFrame, least: int = LEAST_LINES, large: int = LARGE) -> DataFrame:
    """Texts without later copies of runs of ``least`` lines or more.

    Result: doc_id, n_lines, n_removed, longest_run (lines of the longest run in the text that occurs
    anywhere else, 0 if none), kept_text (the other lines, unchanged, with a line end between them).
    The copy that stays is the one in the document with the smallest id (null first, then by a hash of
    the text), the earliest line in it. Lines are equal if they are up to spaces at their end. A blank line
    is no line of a run: it goes with the one before it, and stays at the start of a text; n_lines and n_removed count it. A null or
    empty text has no lines. Every row is a document; rows of one id and text count as one copy. A class of more than
    ``large`` places is sorted by many tasks.
    """
    snapshot = least.bit_length() - 1
    classes = line_classes(places_of(docs))
    array, borders, level = suffix_array(classes, snapshot, large)
    cut = _later_copies(level, least, snapshot).groupBy(*DOC).agg(F.collect_list("pos").alias("_pos"))
    span = lambda i: F.get("spans", i)
    lost = F.flatten(F.transform("_pos", lambda i: F.sequence(span(i)["line"], span(i)["next"] - 1)))
    gone = classes.join(cut, DOC).select(*DOC, lost.alias("_gone"))
    most = longest_runs(classes, array, borders)
    whole = _keyed(docs).join(gone, DOC, "left").join(most, DOC, "left").withColumn("_lines", lines_of(F.col("text")))
    none = F.array().cast("array<int>")
    numbers = F.when(F.size("_lines") > 0, F.sequence(F.lit(0), F.size("_lines") - 1)).otherwise(none)
    stay = F.array_except(numbers, F.coalesce("_gone", none))
    return whole.select(
        "doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.concat_ws("\n", F.transform(stay, lambda i: F.get("_lines", i)))
        ).alias("kept_text"),
    )
