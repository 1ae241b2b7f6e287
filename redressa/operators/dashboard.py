"""Figures over the ticket warehouse and its log, for a dashboard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.functions.status import RESOLVED, is_open
from redressa.operators.lookup import lookup_join
from redressa.operators.ordering import running_total, with_position
from redressa.session import materialized

#: Size of the quantile sketches, and the share of ranks by which their answers may be off at that size.
SKETCH_SIZE, SKETCH_ERROR = 800, 0.01


def open_backlog(tickets: DataFrame) -> DataFrame:
    """(team_name, day, opened, closed, open): tickets raised and resolved on each day, and open at its end.

    Every day from a team's first to the last of all teams has a row, also without an event. A ticket closes at its
    resolved time; one without a raised time is in no day.
    """
    opened = F.struct(F.to_date("raised_ts").alias("day"), F.lit(1).alias("opened"), F.lit(0).alias("closed"))
    closed = F.struct(F.to_date("resolved_ts").alias("day"), F.lit(0).alias("opened"), F.lit(1).alias("closed"))
    moves = tickets.filter("raised_ts IS NOT NULL").select("team_name", F.inline(F.array(opened, closed))).filter("day IS NOT NULL")
    daily = materialized(moves.groupBy("team_name", "day").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed")), "daily-moves")
    last = F.lit(daily.agg(F.max("day")).first()[0]).cast("date")
    spans = daily.groupBy("team_name").agg(F.min("day").alias("first"))
    days = spans.select("team_name", F.explode(F.sequence("first", last)).alias("day"))
    none = F.lit(0).cast("long")
    every = daily.select("team_name", "day", "opened", "closed").unionByName(days.withColumns({"opened": none, "closed": none}))
    per_day = every.groupBy("team_name", "day").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    net = per_day.withColumn("_net", F.col("opened") - F.col("closed"))
    return running_total(net, "_net", "day", ["team_name"], F.trunc("day", "month"), "open").drop("_net")


def _resolve_seconds(tickets: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp("resolved_ts") - F.unix_timestamp("raised_ts")
    return tickets.select("team_name", "ticket_id", "raised_ts", seconds.alias("seconds")).filter("seconds IS NOT NULL")


def resolve_times(tickets: DataFrame, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(team_name, n, mean_s, p50_s, p95_s): exact times to resolve, quantiles interpolated between neighbours.

    A quantile is found by the position of its neighbours in the team's order, which is spread over many tasks, so a
    team with most of the tickets is sorted like any other data.
    """
    times = materialized(_resolve_seconds(tickets).drop("raised_ts"), "resolve-times")
    sums = materialized(times.groupBy("team_name").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total")), "resolve-sums")
    wanted = sums.select("team_name", F.explode(F.array(*[F.struct(F.lit(p).alias("share"), ((F.col("n") - 1) * F.lit(p)).alias("rank")) for p in shares])).alias("w"))
    sides = wanted.select("team_name", "w.*", F.explode(F.array_distinct(F.array(F.floor("w.rank"), F.ceil("w.rank")))).alias("at"))
    placed = with_position(times, ["seconds", "ticket_id"], ["team_name"], "position")
    group = lambda df: df.withColumn("_group", F.struct(F.lit(0).alias("_"), "team_name"))
    # A handful of positions per team.
    asked = materialized(group(sides).withColumn("position", F.col("at") + 1).drop("team_name"), "resolve-ranks")
    found = lookup_join(group(placed), asked.select("_group", "position").distinct(), ["_group", "position"], "left_semi", unique_facts=True)
    pairs = asked.join(found.select("_group", "position", "seconds"), ["_group", "position"])
    low, high = F.min(F.struct("at", "seconds")), F.max(F.struct("at", "seconds"))
    ends = pairs.groupBy("_group", "share", "rank").agg(low.alias("low"), high.alias("high"))
    value = F.col("low.seconds") + (F.col("high.seconds") - F.col("low.seconds")) * (F.col("rank") - F.col("low.at"))
    names = {p: f"p{round(100 * p)}_s" for p in shares}
    wide = ends.withColumn("value", value).groupBy("_group").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(names[p]) for p in shares])
    out = group(sums).join(wide, "_group")
    return out.select("team_name", "n", (F.col("total") / F.col("n")).alias("mean_s"), *[F.round(names[p], 3).alias(names[p]) for p in shares])


def resolve_states(tickets: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(team_name, day, n, total, sketch): times to resolve of each day as states that can be merged later.

    A sketch is of bounded size whatever it has seen; days are added without reading the tickets again.
    """
    times = _resolve_seconds(tickets).withColumn("day", F.to_date("raised_ts"))
    return times.groupBy("team_name", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.kll_sketch_agg_bigint("seconds", size).alias("sketch")
    )


def merged_times(states: DataFrame, by: Sequence[str], shares: Sequence[float] = (0.5, 0.95), size: int = SKETCH_SIZE) -> DataFrame:
    """(by, n, mean_s, p50_s, p95_s) of :func:`resolve_states`; quantiles are off by at most ``SKETCH_ERROR`` of the ranks."""
    merged = states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_bigint("sketch", size).alias("sketch")
    )
    quantile = lambda p: F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{round(100 * p)}_s")
    return merged.select(*by, "n", (F.col("total") / F.col("n")).alias("mean_s"), *[quantile(p) for p in shares])


def drift(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, found, differing): where two stores disagree; found is ``left only``, ``right only`` or ``both``.

    ``differing`` lists the fields, in the order given, that are not equal; nulls are equal to each other only. One row
    per key on each side. Both sides send a 128-bit digest per row to the full outer join; only rows whose
    digests differ meet again with their fields.
    """
    digest = F.struct(F.xxhash64(*_marked(fields)).alias("a"), F.xxhash64(F.lit(1), *_marked(fields)).alias("b"))
    one = left.filter(F.col(key).isNotNull()).select(key, digest.alias("_left"))
    two = right.filter(F.col(key).isNotNull()).select(key, digest.alias("_right"))
    apart = materialized(one.join(two, key, "full_outer").filter(~F.col("_left").eqNullSafe(F.col("_right"))), "drift")
    found = F.when(F.col("_right").isNull(), "left only").when(F.col("_left").isNull(), "right only").otherwise("both")
    state = apart.select(key, found.alias("found"))
    both = state.filter("found = 'both'").select(key)
    side = lambda df, name: lookup_join(df.select(key, *fields), both, [key], "left_semi", unique_facts=True).select(
        key, F.struct(*fields).alias(name)
    )
    unequal = [F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in fields]
    fieldwise = side(left, "_l").join(side(right, "_r"), key).select(key, F.concat_ws(",", *unequal).alias("differing"))
    return state.join(fieldwise, key, "left").withColumn("differing", F.coalesce("differing", F.lit("")))


def _marked(fields: Sequence[str]) -> list[Column]:
    """Each field with whether it is null: hashing alone would take a null for nothing."""
    return [c for f in fields for c in (F.col(f).isNull(), F.col(f))]


def funnel(log: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(step_no, step, reached, mean_s): keys that took the steps in this order, and the mean time since the step before.

    Takes (key, ts, event_id, event). A step counts if it comes after the one before it; others may lie between. A key's
    events are not gathered: each step keeps the first event after the last one's time, combined within tasks.
    """
    at = F.struct("ts", "event_id")
    events = log.filter(F.col("event").isin(*steps) & F.col("key").isNotNull() & F.col("ts").isNotNull()).select("key", "event", at.alias("at"))
    reached, counts = None, []
    for number, step in enumerate(steps, 1):
        taken = events.filter(F.col("event") == step)
        if reached is None:
            first = taken.groupBy("key").agg(F.min("at").alias("at")).withColumn("since", F.lit(0).cast("long"))
        else:
            before = reached.select("key", F.col("at").alias("before"))
            after = lookup_join(taken, before, ["key"], "inner").filter(F.col("at") > F.col("before"))
            first = after.groupBy("key").agg(F.min("at").alias("at"), F.min("before").alias("before"))
            first = first.withColumn("since", F.unix_micros("at.ts") - F.unix_micros("before.ts")).drop("before")
        reached = materialized(first, "funnel-step")
        mean = F.when(F.lit(number > 1), F.round(F.sum("since") / F.count(F.lit(1)) / 1e6, 3))
        counts.append(reached.agg(F.count(F.lit(1)).alias("reached"), mean.alias("mean_s")).select(
            F.lit(number).alias("step_no"), F.lit(step).alias("step"), "reached", "mean_s"
        ))
    return reduce(DataFrame.unionByName, counts)


def team_severity(tickets: DataFrame) -> DataFrame:
    """(team_name, severity_level, level, tickets, open, resolved) by team and severity, by team, and in all.

    ``level`` tells a subtotal from a team or severity that is null: 0 a team's severity, 1 a team, 3 all.
    """
    counted = lambda what: F.count(F.when(what, 1))
    return tickets.rollup("team_name", "severity_level").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("tickets"),
        counted(is_open(F.col("status"))).alias("open"), counted(F.col("status") == RESOLVED).alias("resolved"),
    )


def oldest_open(tickets: DataFrame, k: int = 3) -> DataFrame:
    """(team_name, place, ticket_id, raised_ts): the ``k`` open tickets of each team that were raised first, ties by id.

    The rank is limited before the shuffle, so a task sends at most ``k`` rows a team.
    """
    order = Window.partitionBy("team_name").orderBy("raised_ts", "ticket_id")
    opened = tickets.filter(is_open(F.col("status")) & F.col("raised_ts").isNotNull()).select("team_name", "ticket_id", "raised_ts")
    return opened.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
