"""Answers of a model, kept by the hash of their prompt: what has been answered is not asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from redressa.operators.lookup import lookup_join
from redressa.operators.predictions import CALL_SECONDS, Scorer, score_prompts
from redressa.session import materialized

LEDGER = "prompt_key string, answer string, tokens_used long"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(prompt_key, answer, tokens_used) of all prompts answered so far; none before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LEDGER)
        raise


def score_once(
    prompts: DataFrame, make_scorer: Callable[[], Scorer], folder: str, attempts: int = 3, timeout: float = CALL_SECONDS,
    callers: int | None = None,
) -> DataFrame:
    """As :func:`score_prompts`, but asks only what the ledger at ``folder`` does not know, and adds the answers to it.

    Equal prompts of a batch are asked once. ``status`` is ``ok`` for what was asked now, ``known`` for what
    the ledger or an equal prompt had, ``failed`` as before; a failed prompt is not kept and will be asked again. ``tokens_used``
    counts only what was asked now. A batch that is replayed after its answers were written asks nothing.
    Only the ledger's keys are read to find out, and the answers of the batch's own prompts. One writer at a time.
    """
    spark = prompts.sparkSession
    keyed = materialized(prompts.select("run", "batch", F.sha2("prompt", 256).alias("prompt_key"), "prompt"), "prompts")
    place = F.struct("run", "batch")
    first = keyed.groupBy("prompt_key").agg(F.min(place).alias("first"))
    ledger = read_ledger(spark, folder)
    # The batch's keys go to the ledger, not the ledger to the batch.
    had = materialized(lookup_join(ledger, first.select("prompt_key"), ["prompt_key"], "left_semi", unique_facts=True), "known-answers")
    fresh = lookup_join(first, had.select("prompt_key").distinct(), ["prompt_key"], "left_anti", unique_facts=True).select("prompt_key", "first.*")
    asked = lookup_join(keyed, fresh, ["prompt_key", "run", "batch"], "left_semi", unique_facts=True)
    scored = score_prompts(asked.select("run", "batch", "prompt"), make_scorer, attempts, timeout, callers)
    # Written before it is used: a lost task asks its own prompts again, never those of the others.
    answers = materialized(scored.join(keyed.select("run", "batch", "prompt_key"), ["run", "batch"]), "answers")
    answers.filter("status = 'ok'").select("prompt_key", "answer", "tokens_used").write.mode("append").parquet(folder)
    now = answers.select("prompt_key", "answer", "status", "error", place.alias("asked_at"), "tokens_used")
    before = had.dropDuplicates(["prompt_key"]).select(
        "prompt_key", "answer", F.lit("known").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast(keyed.select(place.alias("p")).schema["p"].dataType).alias("asked_at"), F.lit(0).cast("long").alias("tokens_used"),
    )
    told = keyed.select("run", "batch", "prompt_key").join(now.unionByName(before), "prompt_key")
    here = F.col("asked_at").eqNullSafe(place)
    return told.select(
        "run", "batch", "answer", F.when(here, F.col("tokens_used")).otherwise(F.lit(0)).cast("long").alias("tokens_used"),
        F.when((F.col("status") == "ok") & ~here, "known").otherwise(F.col("status")).alias("status"), "error",
    )
