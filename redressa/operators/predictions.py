"""Calling a scorer on prompts, reading its answers, pairing them with tickets."""

from __future__ import annotations

from collections.abc import Callable
from queue import Empty, SimpleQueue
from threading import Thread

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.functions.status import DEFAULT_SEVERITY, DEFAULT_TEAM

ANSWER_LINE = r"^\s*(\d+)\.\s*(.+?)\s*,\s*([1-5])\s*$"

Scorer = Callable[[str], tuple[str, int]]


#: Seconds a call may take: what the replaced system meant to allow its clients.
CALL_SECONDS = 60.0


def _answer_of(scorer: Scorer, prompt: str, timeout: float) -> tuple[str, int]:
    """One call in a thread of its own, which ends with the process at the latest: a call that hangs holds up no other."""
    box: SimpleQueue = SimpleQueue()

    def call() -> None:
        try:
            box.put((scorer(prompt), None))
        except BaseException as failure:  # handed on to the task
            box.put((None, failure))

    Thread(target=call, daemon=True).start()
    try:
        answer, failure = box.get(timeout=timeout)
    except Empty:
        raise TimeoutError(f"no answer within {timeout} s") from None
    if failure is not None:
        raise failure
    return answer


def score_prompts(
    prompts: DataFrame, make_scorer: Callable[[], Scorer], attempts: int = 3, timeout: float = CALL_SECONDS, callers: int | None = None
) -> DataFrame:
    """Call the scorer for every prompt: (run, batch, answer, tokens_used, status, error).

    ``make_scorer`` runs once per task, so a task opens one connection, and again after a call that hung, whose
    connection is not used any more. There are as many calls at a time as the prompts have partitions, at most ``callers`` if
    that is given; the cores per task (``spark.task.cpus``) bound those of an executor.
    A call that fails or takes longer than ``timeout`` seconds is repeated up to ``attempts`` times. A
    prompt without an answer then has the status ``failed``, the last error, a null answer and zero
    tokens; its tickets get the default prediction, and :func:`run_counts` shows how many. Write the
    result before using it twice: Spark may call again when a task is repeated, unless a ledger knows the
    answers (:mod:`redressa.operators.ledger`).
    """

    def call(frames):
        scorer = None

        def ask(prompt):
            nonlocal scorer
            error = None
            for _ in range(attempts):
                try:
                    scorer = scorer or make_scorer()
                    return (*_answer_of(scorer, prompt, timeout), "ok", None)
                except Exception as failure:
                    error = f"{type(failure).__name__}: {failure}"
                    if isinstance(failure, TimeoutError):  # the thread that hangs keeps its connection
                        scorer = None
            return None, 0, "failed", error

        for frame in frames:
            rows = [ask(prompt) for prompt in frame["prompt"]]
            names = ["answer", "tokens_used", "status", "error"]
            yield frame[["run", "batch"]].assign(**{name: [row[i] for row in rows] for i, name in enumerate(names)})

    asked = prompts if callers is None else prompts.repartition(callers, "run", "batch")
    return asked.mapInPandas(call, "run long, batch int, answer string, tokens_used long, status string, error string")


def tokens_used(answers: DataFrame) -> DataFrame:
    """What all calls have used, as reported by the model: one row."""
    return answers.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_used"))


def run_counts(paired: DataFrame, answers: DataFrame) -> DataFrame:
    """(outcome, n) of one scoring round: tickets classified, those that got the default for want of a
    usable line, and prompts answered and failed."""
    tickets = paired.select(F.when(F.col("team").isNull(), "tickets defaulted").otherwise("tickets classified").alias("outcome"))
    prompts = answers.select(F.when(F.col("status") == "failed", "prompts failed").otherwise("prompts answered").alias("outcome"))
    return tickets.unionByName(prompts).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """(run, batch, item, team, severity) for every well-formed line of an answer.

    Lines are known by their own number, so a missing or bad line costs only its ticket. When
    a number comes twice the first line counts.
    """
    lines = answers.select("run", "batch", F.posexplode(F.split("answer", "\n")).alias("line_no", "line")).filter(
        F.col("line").rlike(ANSWER_LINE)
    )
    part = lambda i: F.regexp_extract("line", ANSWER_LINE, i)
    parsed = lines.select(
        "run", "batch", part(1).try_cast("int").alias("item"), "line_no",
        part(2).alias("team"), part(3).cast("int").alias("severity"),
    ).filter(F.col("item").isNotNull())
    first = F.min(F.struct("line_no", "team", "severity")).alias("first")
    return parsed.groupBy("run", "batch", "item").agg(first).select(
        "run", "batch", "item", "first.team", "first.severity"
    )


def default_predictions(team: str | F.Column = "team", severity: str | F.Column = "severity") -> list[F.Column]:
    return [
        F.coalesce(team, F.lit(DEFAULT_TEAM)).alias("team"),
        F.coalesce(severity, F.lit(DEFAULT_SEVERITY)).alias("severity"),
    ]


def zip_predictions(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each packed ticket with its prediction: (ticket_id, team, severity); nulls when it has none."""
    return items.join(predictions, ["run", "batch", "item"], "left").select("ticket_id", "team", "severity")
