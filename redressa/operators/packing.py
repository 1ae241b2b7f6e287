"""Packing complaints into prompts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.functions.status import TEAMS
from redressa.operators.ordering import with_position

# Messages drained per run, tokens per prompt, characters per token.
RUN_SIZE = 1000
TOKEN_LIMIT = 15000

PROMPT_HEAD = (
    "You sort customer complaints. For each numbered complaint below name the team in charge ("
    + ", ".join(TEAMS)
    + ") and how severe it is, from 1 to 5. Reply with one line each, such as: 1. Team, 3. Complaints:\n"
)


def line_text(item: Column, text: Column) -> Column:
    return F.concat(item.cast("string"), F.lit(". "), text, F.lit("\n"))


def with_runs(df: DataFrame, order: Sequence[str], run_size: int = RUN_SIZE) -> DataFrame:
    """Cut the queue, in arrival order, into the runs a bounded drain would make of it."""
    return with_position(df, order).select(
        "*",
        F.floor((F.col("position") - 1) / run_size).cast("long").alias("run"),
        (F.pmod(F.col("position") - 1, F.lit(run_size)) + 1).cast("int").alias("run_position"),
    ).drop("position")


def pack_batches(df: DataFrame, token_limit: int = TOKEN_LIMIT, head_chars: int = len(PROMPT_HEAD)) -> DataFrame:
    """Greedy packing of the lines of each run: (ticket_id, run, batch, item, tokens).

    Takes (ticket_id, run, run_position, chars). A line joins the open batch while the
    running tokens stay within the limit; the line that does not fit opens the next batch,
    and a line larger than a whole prompt is alone in its batch. No line is lost.

    A running sum that restarts is not a window frame, so each sorted partition is walked
    once; runs are bounded, one partition holds many of them, and memory stays at one
    Arrow batch.
    """

    def pack(frames):
        run, batch, item, tokens = None, 0, 0, 0
        for frame in frames:
            out = []
            for this_run, chars in zip(frame["run"].tolist(), frame["chars"].tolist()):
                if this_run != run:
                    run, batch, item, tokens = this_run, 1, 0, head_chars // 4
                line = (chars + len(str(item + 1)) + 3) // 4
                if item and tokens + line > token_limit:
                    batch, item, tokens = batch + 1, 0, head_chars // 4
                    line = (chars + 4) // 4
                item += 1
                tokens += line
                out.append((batch, item, line))
            for column, values in zip(("batch", "item", "tokens"), zip(*out)):
                frame[column] = values
            if out:
                yield frame[["ticket_id", "run", "batch", "item", "tokens"]]

    return (
        df.select("ticket_id", "run", "run_position", "chars")
        .repartition("run")
        .sortWithinPartitions("run", "run_position")
        .mapInPandas(pack, "ticket_id string, run long, batch int, item int, tokens int")
    )


def build_prompts(items: DataFrame, head: str = PROMPT_HEAD) -> DataFrame:
    """(run, batch, prompt) from (run, batch, item, text); a batch is bounded by its tokens."""
    lines = F.array_sort(F.collect_list(F.struct("item", line_text(F.col("item"), F.col("text")).alias("line"))))
    return (
        items.groupBy("run", "batch")
        .agg(lines.alias("lines"))
        .select("run", "batch", F.concat(F.lit(head), F.array_join(F.col("lines.line"), "")).alias("prompt"))
    )


def sum_tokens(items: DataFrame, head_tokens: int = len(PROMPT_HEAD) // 4) -> DataFrame:
    """Tokens of all prompts: every line once, and the head once per batch."""
    return items.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("line_tokens"),
        F.coalesce(F.sum(F.when(F.col("item") == 1, head_tokens)), F.lit(0)).cast("long").alias("head_tokens"),
    )
