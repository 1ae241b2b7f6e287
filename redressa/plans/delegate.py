"""The delegation batch: queue messages to classified tickets, digests and store changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.functions.status import DELEGATED
from redressa.functions.text import preprocess
from redressa.operators import packing
from redressa.operators.classify import classify_lexicon
from redressa.operators.ledger import score_once
from redressa.operators.predictions import Scorer, default_predictions, parse_answers, score_prompts, zip_predictions
from redressa.operators.stores import dedupe_tickets
from redressa.session import work_folder
from redressa.sources.queue import parse_complaints

# A classifier takes complaints with ``cleaned`` and gives (ticket_id, raised_ts, user_id, team, severity).
Classifier = Callable[[DataFrame], DataFrame]


def clean(complaints: DataFrame, stop_words=None, table=None) -> DataFrame:
    text = F.coalesce("complaint_text", F.lit(""))
    return complaints.withColumn("cleaned", preprocess(text, stop_words, table))


def by_lexicon(lexicon: DataFrame) -> Classifier:
    return lambda cleaned: classify_lexicon(cleaned, lexicon, carry=["raised_ts", "user_id"])


def pack(cleaned: DataFrame, token_limit: int = packing.TOKEN_LIMIT, run_size: int = packing.RUN_SIZE) -> DataFrame:
    """Place every complaint in a prompt.

    Putting rows in order reads them more than once, so only the keys go through it; the
    texts are cleaned once, and no more than their lengths is shuffled.
    """
    order = ["raised_ts", "ticket_id"]
    runs = packing.with_runs(cleaned.select(*order), order, run_size).drop("raised_ts")
    lengths = cleaned.select("ticket_id", F.length("cleaned").alias("chars"))
    return packing.pack_batches(lengths.join(runs, "ticket_id"), token_limit)


def write_cleaned(cleaned: DataFrame, folder: str) -> DataFrame:
    """Cleaned texts, written once: lengths and prompts both need them, and cleaning costs more than a read."""
    cleaned.select("ticket_id", "raised_ts", "cleaned").write.parquet(f"{folder}/cleaned")
    return cleaned.sparkSession.read.parquet(f"{folder}/cleaned")


def prompts_of(items: DataFrame, cleaned: DataFrame) -> DataFrame:
    return packing.build_prompts(items.join(cleaned.select("ticket_id", F.col("cleaned").alias("text")), "ticket_id"))


def score_packed(cleaned: DataFrame, make_scorer: Callable[[], Scorer], attempts: int = 3,
                 token_limit: int = packing.TOKEN_LIMIT, run_size: int = packing.RUN_SIZE,
                 ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, answers) of one scoring round; answers are written once, before anyone reads them.

    With ``ledger``, a folder, prompts that were answered in an earlier round are not asked again.
    """
    spark = cleaned.sparkSession
    folder = work_folder(spark, "scored")
    written = write_cleaned(cleaned, folder)
    pack(written, token_limit, run_size).write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    prompts = prompts_of(items, written)
    answers = score_once(prompts, make_scorer, ledger, attempts) if ledger else score_prompts(prompts, make_scorer, attempts)
    answers.write.parquet(f"{folder}/answers")
    return items, spark.read.parquet(f"{folder}/answers")


def by_scorer(make_scorer: Callable[[], Scorer], attempts: int = 3,
              token_limit: int = packing.TOKEN_LIMIT, ledger: str | None = None) -> Classifier:
    """Classification by a remote model behind ``make_scorer``; a ``ledger`` keeps its answers for replays."""

    def classify(cleaned: DataFrame) -> DataFrame:
        items, answers = score_packed(cleaned, make_scorer, attempts, token_limit, ledger=ledger)
        paired = zip_predictions(items, parse_answers(answers))
        return cleaned.select("ticket_id", "raised_ts", "user_id").join(paired, "ticket_id", "left").select(
            "ticket_id", "raised_ts", "user_id", *default_predictions()
        )

    return classify


def ticket_rows(classified: DataFrame) -> DataFrame:
    """Warehouse rows: a ticket is born delegated and unresolved."""
    return classified.select(
        "ticket_id",
        "raised_ts",
        F.col("team").alias("team_name"),
        F.col("severity").alias("severity_level"),
        F.lit(DELEGATED).alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_ts"),
    )


def delegate_batch(complaints: DataFrame, classify: Classifier, stop_words=None, table=None) -> DataFrame:
    """Complaint records to classified complaints, ready for the warehouse and the digests."""
    return classify(clean(complaints, stop_words, table))


def read_complaints(messages: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The well-formed complaints of a batch of queue messages (body), each once; with ``among`` those of its ids only."""
    return dedupe_tickets(parse_complaints(messages), among)
