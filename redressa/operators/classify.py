"""Team, severity and intent of a text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.functions.status import DEFAULT_SEVERITY, DEFAULT_TEAM, TEAMS
from redressa.operators.lookup import BROADCAST_ROWS, lookup_join

# Keyword rules for the three words a model may answer, tried in this order.
INTENT_KEYWORDS = {
    "check_status": ["status", "check", "track", "progress", "update"],
    "resolve_status": ["resolve", "resolved", "close", "closed", "fixed", "solved"],
    "new_complaint": ["new", "complaint", "complain", "submit", "report", "problem", "issue"],
}


def classify_lexicon(
    cleaned: DataFrame, lexicon: DataFrame, carry: Sequence[str] = (), broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Best team per ticket by lexicon hits: (ticket_id, *carry, team, severity).

    Takes (ticket_id, cleaned text) and a lexicon of (word, team), one row per word. Words
    are matched where they are read; only six counts per ticket are shuffled. ``carry`` names
    columns fixed by the ticket that later steps need, which saves joining them back.
    """
    words = cleaned.select(
        "ticket_id", *carry, F.explode_outer(F.split(F.lower("cleaned"), " ")).alias("word")
    )
    hits = lookup_join(words, lexicon.select("word", "team"), ["word"], "left", broadcast_rows)
    counts = [F.count(F.when(F.col("team") == team, 1)).alias(f"n{i}") for i, team in enumerate(TEAMS)]
    # Ties go to the team listed first: its rank is the larger one.
    best = F.greatest(
        *[
            F.struct(F.col(f"n{i}").alias("n"), F.lit(len(TEAMS) - i).alias("rank"), F.lit(team).alias("team"))
            for i, team in enumerate(TEAMS)
        ]
    )
    scored = hits.groupBy("ticket_id", *carry).agg(*counts).withColumn("best", best)
    found = F.col("best.n") > 0
    severity = F.least(F.lit(5), 1 + F.floor(F.col("best.n") / 25)).cast("int")
    return scored.select(
        "ticket_id",
        *carry,
        F.when(found, F.col("best.team")).otherwise(DEFAULT_TEAM).alias("team"),
        F.when(found, severity).otherwise(DEFAULT_SEVERITY).alias("severity"),
    )


def classify_intent(text: Column, keywords: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The first intent one of whose keywords is a word of the text; null when none is."""
    words = F.split(F.lower(text), "[^a-z]+")
    rules = [
        F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed])), intent)
        for intent, listed in (keywords or INTENT_KEYWORDS).items()
    ]
    return F.coalesce(*rules)
