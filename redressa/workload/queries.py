"""Every registered query: a job of the library over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.functions import chat, text
from redressa.operators import classify, dashboard, digests, packing, predictions, service, stores
from redressa.plans import delegate, dialog, intake, progress
from redressa.schemas import COMPLAINT, DIALOG_ACTION
from redressa.session import materialized, prepare, work_folder
from redressa.sources import buckets, queue
from redressa.sources.tables import read_batches, read_table, write_batch
from redressa.streaming import drain, lifecycle, volume
from redressa.workload import views

EXTRA_EXPANSIONS = {"it": "that thing", "les": "toutes les", "und": "und auch"}
INTENT_KEYWORDS = {"check_status": ["the", "le"], "resolve_status": ["of", "und"], "new_complaint": ["to", "de"]}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(prepare(spark), folder)

    QUERIES[query.__name__] = run
    return query


def _as_of() -> F.Column:
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


def _time(name: str) -> F.Column:
    return chat.format_time(F.col(name)).alias(name)


def _ticket_columns(df: DataFrame) -> DataFrame:
    return df.select("ticket_id", _time("raised_ts"), "team_name", "severity_level", "status", _time("resolved_ts"))


# --- sources and sinks ---------------------------------------------------------------


def _publish_files(spark, folder):
    target = work_folder(spark, "queue")
    views.messages(spark, folder).select("body").write.text(f"{target}/in")
    return target


@registered
def src_complaint_stream(spark, folder):
    target = _publish_files(spark, folder)
    drain.drain(drain.read_queue(spark, f"{target}/in"), drain.store_complaints(target), f"{target}/offsets")
    return read_batches(spark, f"{target}/complaints").select(
        "ticket_id", "user_id", "order_id", F.md5("complaint_text").alias("text_md5"), "status", "timestamp"
    )


@registered
def parse_complaint_json(spark, folder):
    return queue.parse_complaints(views.messages(spark, folder), keep=["doc_id"]).select(
        "doc_id", *COMPLAINT.fieldNames(), _time("raised_ts")
    )


@registered
def requeue_failed(spark, folder):
    return queue.quarantine(views.messages(spark, folder)).select("doc_id", "lang")


@registered
def publish_json(spark, folder):
    bodies = queue.publish(views.complaints(spark, folder), keep=["doc_id"])
    return queue.parse_complaints(bodies, keep=["doc_id"]).drop("raised_ts")


@registered
def parse_chat_envelope(spark, folder):
    return queue.parse_chat_envelope(views.chat_requests(spark, folder), "unknown", keep=["conv_id", "turn"])


@registered
def cap_batch(spark, folder):
    capped = queue.cap_messages(views.requests(spark, folder), ["ts", "event_id"])
    return capped.select("event_id", "ticket_id", "taken")


@registered
def append_tickets(spark, folder):
    target = work_folder(spark, "tickets")
    rows = delegate.ticket_rows(views.classified(spark, folder))
    for _ in range(2):  # the second write is the replay of the first
        write_batch(rows, target, 0)
    return _ticket_columns(read_batches(spark, target))


# --- store ---------------------------------------------------------------------------


@registered
def scan_open_tickets(spark, folder):
    return stores.scan_open(views.store(spark, folder))


@registered
def batch_get_new(spark, folder):
    found = stores.batch_get_new(views.store(spark, folder), views.requests(spark, folder))
    return found.select("ticket_id", "user_id", "order_id", "status", "timestamp")


@registered
def status_lookup(spark, folder):
    asked = views.requests(spark, folder).select("event_id", "ticket_id")
    return service.status_lookup(asked, views.store(spark, folder))


@registered
def resolve_found(spark, folder):
    return service.resolve_found(views.resolve_requests(spark, folder), views.store(spark, folder))


@registered
def resolve_missing(spark, folder):
    return service.resolve_missing(views.resolve_requests(spark, folder), views.store(spark, folder))


@registered
def upsert_delegated(spark, folder):
    records = views.store(spark, folder).select(
        "ticket_id", "user_id", "order_id", F.md5("complaint_text").alias("text_md5"), "status", "timestamp"
    )
    old = records.withColumn("version", F.lit(0))
    fresh = records.filter(F.col("status") == "new").withColumns({"status": F.lit("delegated"), "version": F.lit(1)})
    return stores.upsert(old, fresh, "version")


def _bucketed_store(spark, folder):
    """The store's records in buckets, without their texts, which are hashed."""
    target = work_folder(spark, "bucket-store")
    records = views.store(spark, folder).select(
        "ticket_id", "user_id", "order_id", F.md5("complaint_text").alias("text_md5"), "status", "timestamp"
    )
    buckets.create_store(records, target, buckets=16)
    return target, records


@registered
def bucket_upsert(spark, folder):
    """New tickets become delegated by a batch of changes, which is delivered twice; every fifth user's records change once more."""
    target, records = _bucketed_store(spark, folder)
    delegated = records.filter(F.col("status") == "new").withColumn("status", F.lit("delegated"))
    for _ in range(2):
        buckets.append_changes(delegated, target, 0)
    buckets.compact(spark, target)
    again = buckets.read_store(spark, target).filter(F.col("user_id").like("user%0@%"))
    buckets.append_changes(again.withColumn("order_id", F.lit("moved")), target, 1)
    return buckets.read_store(spark, target)


@registered
def bucket_status_updates(spark, folder):
    """User resolve requests as changes of the bucketed store, read after its compaction."""
    target, records = _bucketed_store(spark, folder)
    asked = views.resolve_requests(spark, folder).select(F.lower("ticket_id").alias("ticket_id")).distinct()
    buckets.change_status(asked.withColumn("status", F.lit("resolved")), target, 0)
    buckets.compact(spark, target)
    return buckets.read_store(spark, target)


@registered
def apply_status_updates(spark, folder):
    asked = service.resolve_found(views.resolve_requests(spark, folder), views.store(spark, folder))
    return _ticket_columns(progress.resolve(views.tickets(spark, folder), asked, _as_of()))


@registered
def dedupe_tickets(spark, folder):
    kept = stores.dedupe_tickets(queue.parse_complaints(views.messages(spark, folder)))
    return kept.select("ticket_id", "user_id", "order_id", F.md5("complaint_text").alias("text_md5"), "timestamp")


@registered
def sample_open(spark, folder):
    return stores.sample_open(views.store(spark, folder), k=2, seed="7")


@registered
def advance_status(spark, folder):
    moved = stores.advance_status(stores.scan_open(views.store(spark, folder)), _as_of())
    return moved.select("ticket_id", "status", _time("resolved_ts"))


@registered
def lifecycle_state(spark, folder):
    return stores.lifecycle_state(views.ticket_log(views.events(spark, folder)))


#: Longer than the given events and complaints span, so that none of them is too late.
ALL_TIMES = "4000 days"
#: More files than a queue has: a batch takes all that wait.
WHOLE_QUEUE = 1_000_000


def _track_lifecycle(log, target):
    drain.drain(lifecycle.lifecycle_changes(log, ALL_TIMES), lifecycle.store_changes(target, ALL_TIMES), f"{target}/offsets", "update")
    return lifecycle.read_lifecycle(log.sparkSession, target)


@registered
def lifecycle_stream(spark, folder):
    """The log as a stream of several files whose times overlap, every event delivered twice."""
    target = work_folder(spark, "lifecycle")
    given = views.ticket_log(views.events(spark, folder))
    given.unionByName(given).repartition(3).write.parquet(f"{target}/in")
    log = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/in")
    return _track_lifecycle(log, target)


@registered
def lifecycle_stream_table(spark, folder):
    """The same, straight from the given table, a file or a folder of part files."""
    target = work_folder(spark, "lifecycle")
    # A pattern that fits this one name: a stream takes a pattern for a file as well as for a folder.
    log = spark.readStream.schema(read_table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]")
    return _track_lifecycle(views.ticket_log(log), target)


def _drain_complaints(spark, target, horizon, *parts):
    """Complaints as JSON files, one part after the other, drained by one stream with a batch for each part.

    A part is as many files as it has tasks. What the batches see is as in one run: none is without rows.
    """
    for part in parts:
        queue.publish(part).select("body").write.mode("append").text(f"{target}/in")
        stream = queue.parse_complaints(drain.read_queue(spark, f"{target}/in", WHOLE_QUEUE))
        drain.drain(drain.first_complaints(stream, horizon), drain.store_first(target, horizon), f"{target}/offsets", idle_batches=False)


@registered
def dedupe_stream(spark, folder):
    """All complaints in three parts, English ones again in each: every complaint once."""
    target = work_folder(spark, "first")
    given = views.complaints(spark, folder)
    again = given.filter(F.col("lang") == "en")
    parts = [given.filter(F.col("lang") == "de").unionByName(again), given.filter("lang IS NULL OR lang <> 'de'"), again]
    _drain_complaints(spark, target, ALL_TIMES, *parts)
    return read_batches(spark, f"{target}/complaints").select(
        "ticket_id", "user_id", "order_id", F.md5("complaint_text").alias("text_md5"), "timestamp"
    )


@registered
def dedupe_late(spark, folder):
    """The French complaints come after all others, and English ones in between again; most French ones are more than an hour behind."""
    target = work_folder(spark, "late")
    given = views.complaints(spark, folder)
    late = F.coalesce(F.col("lang") == "fr", F.lit(False))
    _drain_complaints(spark, target, "1 hour", given.filter(~late), given.filter(F.col("lang") == "en"), given.filter(late))
    outcome = lambda name: read_batches(spark, f"{target}/{name}").select("ticket_id", F.lit(name).alias("outcome"))
    return outcome("complaints").unionByName(outcome("late"))


@registered
def daily_volume(spark, folder):
    """Events per day and kind from three files in mixed order; a sign of life at the end closes the last day."""
    target = work_folder(spark, "volume")
    given = views.events(spark, folder).select("ts", F.col("event_type").alias("kind"))
    given.repartition(3).write.parquet(f"{target}/in")
    silence = given.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 40 days")).alias("ts"), F.lit(None).cast("string").alias("kind"))
    silence.write.mode("append").parquet(f"{target}/in")
    events = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/in")
    drain.drain(volume.daily_volume(events, "32 days"), volume.store_volume(target, "32 days"), f"{target}/offsets")
    return volume.read_volume(spark, target)


# --- text ----------------------------------------------------------------------------


def _documents(spark, folder, spread_by="doc_id"):
    return read_table(spark, folder, "documents", spread_by)


@registered
def remove_stopwords(spark, folder):
    words = text.effective_stop_words()
    return _documents(spark, folder).select("doc_id", text.remove_stopwords(F.col("text"), words).alias("text"))


@registered
def expand_contractions(spark, folder):
    spoken = F.col("text")
    for ending, short in {"tion ": "n't ", "ou ": "'ve ", "que ": "'d ", " it ": " it's ", " la ": " can’t "}.items():
        spoken = F.replace(spoken, F.lit(ending), F.lit(short))
    return _documents(spark, folder).select("doc_id", text.expand_contractions(spoken, EXTRA_EXPANSIONS).alias("text"))


@registered
def remove_special(spark, folder):
    return _documents(spark, folder).select("doc_id", text.remove_special_characters(F.col("text")).alias("text"))


@registered
def preprocess_text(spark, folder):
    return _documents(spark, folder).select("doc_id", text.preprocess(F.col("text")).alias("text"))


@registered
def preprocess_table(spark, folder):
    """Cleaning with a table of expansions of one's own: what it expands is not dropped as a stop word."""
    cleaned = text.preprocess(F.col("text"), table=EXTRA_EXPANSIONS)
    return _documents(spark, folder).select("doc_id", cleaned.alias("text"))


@registered
def estimate_tokens(spark, folder):
    return _documents(spark, folder).select("doc_id", text.estimate_tokens(F.col("text")).alias("n"))


@registered
def effective_stopwords(spark, folder):
    """How often each word that is dropped as a stop word occurs in the documents."""
    words = _documents(spark, folder).select(F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    return words.filter(F.col("word").isin(text.effective_stop_words())).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@registered
def filter_nonblank(spark, folder):
    blank = F.when(F.col("role") == "system", F.lit(" \t\n ")).otherwise(F.col("text"))
    return views.turns(spark, folder).withColumn("text", blank).filter(text.is_nonblank(F.col("text"))).select(
        "conv_id", "turn", "text"
    )


# --- classification ------------------------------------------------------------------


def _cleaned(spark, folder):
    return delegate.clean(views.complaints(spark, folder, spread=True))


@registered
def classify_lexicon(spark, folder):
    return views.classified(spark, folder).select("ticket_id", "team", "severity")


@registered
def ticket_rows(spark, folder):
    return _ticket_columns(delegate.ticket_rows(views.classified(spark, folder)))


@registered
def pack_batches(spark, folder):
    return delegate.pack(_cleaned(spark, folder))


@registered
def build_prompts(spark, folder):
    cleaned = delegate.write_cleaned(_cleaned(spark, folder), work_folder(spark, "prompts"))
    return delegate.prompts_of(delegate.pack(cleaned), cleaned)


def _scored(spark, folder):
    return delegate.score_packed(_cleaned(spark, folder), views.word_count_scorer())


@registered
def sum_tokens(spark, folder):
    """Tokens as estimated for the prompts and as reported by the model; both are one row."""
    items, answers = _scored(spark, folder)
    estimated = packing.sum_tokens(items).withColumn("one", F.lit(1))
    return estimated.join(predictions.tokens_used(answers).withColumn("one", F.lit(1)), "one").drop("one")


@registered
def run_counts(spark, folder):
    items, answers = _scored(spark, folder)
    return predictions.run_counts(predictions.zip_predictions(items, predictions.parse_answers(answers)), answers)


@registered
def parse_predictions(spark, folder):
    return predictions.parse_answers(_scored(spark, folder)[1])


@registered
def zip_predictions(spark, folder):
    items, answers = _scored(spark, folder)
    return predictions.zip_predictions(items, predictions.parse_answers(answers))


@registered
def default_predictions(spark, folder):
    items, answers = _scored(spark, folder)
    paired = predictions.zip_predictions(items, predictions.parse_answers(answers))
    return paired.select("ticket_id", *predictions.default_predictions())


@registered
def classify_with_scorer(spark, folder):
    by_scorer = delegate.by_scorer(views.word_count_scorer())
    return by_scorer(_cleaned(spark, folder)).select("ticket_id", "user_id", "team", "severity")


@registered
def answer_ledger(spark, folder):
    """Two rounds over the same complaints with one ledger: the second asks nothing and ends in the same predictions."""
    ledger = work_folder(spark, "ledger")
    rounds = []
    for number in (1, 2):
        items, answers = delegate.score_packed(_cleaned(spark, folder), views.word_count_scorer(), ledger=ledger)
        paired = predictions.zip_predictions(items, predictions.parse_answers(answers))
        asked = answers.agg(F.count(F.when(F.col("status") == "ok", 1)).alias("asked"), F.sum("tokens_used").alias("tokens_used"))
        told = paired.agg(F.count("team").alias("classified"))
        rounds.append(asked.withColumn("round", F.lit(number)).join(told.withColumn("round", F.lit(number)), "round"))
    return rounds[0].unionByName(rounds[1])


@registered
def map_intent(spark, folder):
    return views.dialog_events(spark, folder).select(
        "event_id", "answer", chat.map_intent(F.col("answer")).alias("intent_word")
    )


@registered
def classify_intent(spark, folder):
    word = classify.classify_intent(F.col("text"), INTENT_KEYWORDS)
    return views.turns(spark, folder).select("conv_id", "turn", word.alias("word"), chat.map_intent(word).alias("intent_word"))


# --- digests -------------------------------------------------------------------------


@registered
def group_by_team(spark, folder):
    return digests.group_by_key(views.written_classified(spark, folder), "team")


@registered
def group_by_user(spark, folder):
    return digests.group_by_key(views.written_classified(spark, folder), "user_id", page_size=5)


@registered
def first_seen_keys(spark, folder):
    return digests.first_seen_keys(views.written_classified(spark, folder), "team")


@registered
def first_seen_users(spark, folder):
    return digests.first_seen_keys(views.written_classified(spark, folder), "user_id")


@registered
def team_digest(spark, folder):
    return digests.team_digest(views.classified_texts(spark, folder))


@registered
def user_digest(spark, folder):
    return digests.user_digest(views.classified_texts(spark, folder), page_size=5)


@registered
def outbox_digests(spark, folder):
    return digests.outbox(views.classified_texts(spark, folder)).withColumn("body", F.md5("body"))


# --- chat ----------------------------------------------------------------------------


@registered
def submit_complaints(spark, folder):
    return intake.submit_complaints(views.submit_dialogs(spark, folder))


@registered
def route_intents(spark, folder):
    events = views.dialog_events(spark, folder)
    return events.select("event_id", chat.route_intent(F.col("sessionState.intent.name")).alias("handler"))


@registered
def extract_slot(spark, folder):
    slots = F.col("sessionState.intent.slots")
    return views.dialog_events(spark, folder).select(
        "event_id",
        chat.email_of_session(F.col("sessionId")).alias("user_id"),
        chat.slot_value(slots, "ticket_id").alias("ticket_id"),
        chat.slot_value(slots, "order_id").alias("order_id"),
    )


@registered
def set_slot(spark, folder):
    slots = dialog.set_intent_word(views.dialog_events(spark, folder))
    return slots.select(
        "event_id",
        chat.slot_value(F.col("slots"), "intent_word").alias("intent_word"),
        chat.slot_value(F.col("slots"), "ticket_id").alias("ticket_id"),
        F.size("slots").alias("n_slots"),
    )


@registered
def dialog_actions(spark, folder):
    events = views.dialog_events(spark, folder)
    asked = events.select("event_id", chat.slot_value(F.col("sessionState.intent.slots"), "ticket_id").alias("ticket_id"))
    known = service.status_lookup(asked, views.store(spark, folder)).select(
        "event_id", "status_text", (F.col("status_text") != service.NOT_FOUND).alias("found")
    )
    # Users whose number ends in seven find the store out of reach.
    out_of_reach = chat.email_of_session(F.col("sessionId")).rlike("^user[0-9]*7@")
    turns = events.join(known, "event_id").withColumns({
        "new_ticket_id": F.concat(F.lit("c"), F.col("event_id").cast("string")), "failed": out_of_reach
    })
    read_back = F.inline_outer(F.array(F.from_json(F.to_json("action"), DIALOG_ACTION)))
    state = F.col("sessionState")
    return dialog.dialog_actions(turns).select("event_id", read_back).select(
        "event_id",
        state["dialogAction"]["type"].alias("type"),
        state["dialogAction"]["slotToElicit"].alias("slot_to_elicit"),
        state["intent"]["name"].alias("intent"),
        state["intent"]["state"].alias("state"),
        chat.slot_value(state["intent"]["slots"], "ticket_id").alias("ticket_id"),
        chat.slot_value(state["dialogAction"]["slots"], "ticket_id").alias("offered_ticket_id"),
        state["sessionAttributes"]["lang"].alias("lang"),
        F.get("messages", F.lit(0))["content"].alias("content"),
    )


@registered
def derive_reply(spark, folder):
    message = lambda kind: F.struct(F.lit(kind).alias("contentType"), F.col("text").alias("content"))
    replies = views.turns(spark, folder).select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, "InProgress").otherwise("Fulfilled").alias("state"),
        F.when(F.col("role") != "system", "ticket_id").alias("slot"),
        F.when(F.col("role") == "user", F.array(F.struct(F.lit("ImageCard").alias("contentType"), F.lit("card").alias("content")),
                                                message("PlainText")))
        .when(F.col("role") == "assistant", F.array(message("CustomPayload")))
        .alias("messages"),
    )
    return replies.select("conv_id", "turn", chat.derive_reply(F.col("state"), F.col("slot"), F.col("messages")).alias("reply"))


@registered
def flatten_messages(spark, folder):
    return service.flatten_messages(views.chat_responses(spark, folder), ["conv_id", "turn"])


@registered
def minute_markers(spark, folder):
    return stores.minute_markers(views.events(spark, folder).withColumnRenamed("user_id", "key"))


def _addresses(spark, folder):
    address = F.concat_ws("@", "lang", "source", F.lit("example.com"))
    return _documents(spark, folder, None).select("doc_id", address.alias("address"))


@registered
def session_key(spark, folder):
    key = chat.session_key(F.col("address"))
    return _addresses(spark, folder).select("doc_id", key.alias("key"), chat.email_of_session(key).alias("address"))


@registered
def session_key_first(spark, folder):
    return _addresses(spark, folder).select("doc_id", chat.session_key_first(F.col("address")).alias("key"))


@registered
def mint_session_id(spark, folder):
    session = chat.mint_session_id(F.col("ts"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return views.events(spark, folder).select("event_id", session.alias("session_id"))


@registered
def format_raised_ts(spark, folder):
    raised = chat.format_time(F.col("ts"))
    return views.events(spark, folder).select(
        "event_id", raised.alias("raised"), F.unix_timestamp(chat.parse_time(raised)).alias("seconds")
    )


# --- dashboard -----------------------------------------------------------------------


@registered
def open_backlog(spark, folder):
    return dashboard.open_backlog(views.tickets(spark, folder)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@registered
def resolve_times(spark, folder):
    return dashboard.resolve_times(views.tickets(spark, folder))


@registered
def resolve_time_sketch(spark, folder):
    """Merged daily sketches against the exact ranks of what they answer."""
    tickets = views.tickets(spark, folder).select("team_name", "ticket_id", "raised_ts", "resolved_ts")
    written = materialized(tickets, "tickets")
    merged = dashboard.merged_times(dashboard.resolve_states(written), ["team_name"])
    seconds = F.unix_timestamp("resolved_ts") - F.unix_timestamp("raised_ts")
    ranks = written.filter("resolved_ts IS NOT NULL").join(merged, "team_name").groupBy("team_name", "n", "mean_s")
    share = lambda what: F.avg(what.cast("int"))
    error = dashboard.SKETCH_ERROR
    within = lambda name, p: (
        (share(seconds < F.col(name)) <= p + error) & (share(seconds <= F.col(name)) >= p - error)
    ).alias(f"{name}_within")
    return ranks.agg(within("p50_s", 0.5), within("p95_s", 0.95))


@registered
def store_drift(spark, folder):
    """The store, where users have resolved tickets, against a warehouse that has no new tickets and has lost none."""
    store = views.store(spark, folder).filter("status IS NOT NULL")
    asked = service.resolve_found(views.resolve_requests(spark, folder), store)
    resolved = stores.apply_status_updates(
        store.withColumn("resolved_ts", F.lit(None).cast("timestamp")),
        asked.select(F.col("key").alias("ticket_id")).distinct().select("ticket_id", F.lit("resolved").alias("status"), F.lit(None).cast("timestamp").alias("resolved_ts")),
    )
    tickets = views.tickets(spark, folder).filter("status IS NULL OR status <> 'new'")
    # Times of Spanish complaints were taken down wrongly.
    slow = F.when(F.col("lang") == "es", F.col("raised_ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("raised_ts"))
    return dashboard.drift(
        resolved.select("ticket_id", "status", slow.alias("raised_ts")), tickets.select("ticket_id", "status", "raised_ts"),
        "ticket_id", ["status", "raised_ts"],
    )


@registered
def status_funnel(spark, folder):
    return dashboard.funnel(views.ticket_log(views.events(spark, folder)), ["submit", "delegate", "advance", "resolve"])


@registered
def team_severity(spark, folder):
    """Tickets without a status have lost their team here, to tell null teams from subtotals."""
    team = F.when(F.col("status").isNotNull(), F.col("team_name"))
    return dashboard.team_severity(views.tickets(spark, folder).withColumn("team_name", team))


@registered
def oldest_open(spark, folder):
    return dashboard.oldest_open(views.tickets(spark, folder)).withColumn("raised_ts", chat.format_time(F.col("raised_ts")))


# --- whole jobs ----------------------------------------------------------------------


@registered
def delegate_batch(spark, folder):
    received = delegate.read_complaints(views.messages(spark, folder))
    by_lexicon = delegate.by_lexicon(views.lexicon(spark, folder))
    return _ticket_columns(delegate.ticket_rows(delegate.delegate_batch(received, by_lexicon)))


def _delegate_stream(spark, folder, files=8):
    target = _publish_files(spark, folder)
    # A quarter of a long queue at a time: a batch has work for every core, and its fixed cost is paid four times.
    files = max(files, -(-len(spark.read.text(f"{target}/in").inputFiles()) // 4))
    # Written once: every micro-batch looks words up in the same lexicon.
    views.lexicon(spark, folder).write.parquet(f"{target}/lexicon")
    by_lexicon = delegate.by_lexicon(spark.read.parquet(f"{target}/lexicon"))
    # A few files at a time: most second deliveries come in a later batch than the first.
    bodies = drain.fresh_tickets(drain.read_queue(spark, f"{target}/in", files))
    drain.drain(bodies, drain.delegate(target, by_lexicon), f"{target}/offsets")
    return target


@registered
def delegate_stream(spark, folder):
    target = _delegate_stream(spark, folder)
    status = read_batches(spark, f"{target}/store").groupBy("ticket_id").agg(
        F.max("status").alias("store_status"), F.count(F.lit(1)).alias("store_rows")
    )
    return _ticket_columns(drain.read_tickets(spark, target)).join(status, "ticket_id")


@registered
def delegate_outputs(spark, folder):
    """What the other outputs of the stream hold; mails are by batch, so those are in ``delegate_outbox``."""
    target = _delegate_stream(spark, folder)
    read = lambda name, row_id, *fields: read_batches(spark, f"{target}/{name}").select(
        F.lit(name).alias("output"), F.col(row_id).alias("id"), F.md5(F.to_json(F.array(*[F.col(f).cast("string") for f in fields]))).alias("content")
    )
    # A body that was cut short still begins with its ticket.
    aside = read_batches(spark, f"{target}/quarantine").select(
        F.lit("quarantine").alias("output"), F.regexp_extract("body", '"ticket_id":"([^"]*)"', 1).alias("id"),
        F.md5(F.regexp_replace("body", '"complaint_text":".*', "")).alias("content"),
    )
    return (
        read("complaints", "ticket_id", "user_id", "order_id", "complaint_text", "status", "timestamp")
        .unionByName(read("classified", "ticket_id", "user_id", "team", "severity"))
        .unionByName(read("store", "ticket_id", "user_id", "order_id", "complaint_text", "status", "timestamp"))
        .unionByName(aside)
    )


@registered
def delegate_outbox(spark, folder):
    """The mails of a drain that takes the whole queue in one batch."""
    target = _delegate_stream(spark, folder, WHOLE_QUEUE)
    return read_batches(spark, f"{target}/outbox").select("recipient", "subject", "page", F.md5("body").alias("body"))


@registered
def delegate_nothing(spark, folder):
    """A queue that holds nothing but bodies that were cut short: every batch is put aside, no output gets a row."""
    target = work_folder(spark, "nothing")
    bodies = queue.publish(views.complaints(spark, folder, spread=True)).withColumn("body", F.expr("substring(body, 1, length(body) - 7)"))
    bodies.write.text(f"{target}/in")
    files = len(spark.read.text(f"{target}/in").inputFiles())
    views.lexicon(spark, folder).write.parquet(f"{target}/lexicon")
    by_lexicon = delegate.by_lexicon(spark.read.parquet(f"{target}/lexicon"))
    fresh = drain.fresh_tickets(drain.read_queue(spark, f"{target}/in", (files + 1) // 2))  # two batches, whatever the size
    drain.drain(fresh, drain.delegate(target, by_lexicon), f"{target}/offsets")
    counts = [
        read_batches(spark, f"{target}/{name}").agg(F.count(F.lit(1)).alias("n")).withColumn("output", F.lit(name))
        for name in ("quarantine", "complaints", "classified", "tickets", "outbox", "store")
    ]
    return reduce(DataFrame.unionByName, counts)


def _progressed(spark, folder):
    target = work_folder(spark, "progress")
    progress.progress(stores.sample_open(views.store(spark, folder), k=None), _as_of(), target, 0)
    return target


@registered
def progress_open(spark, folder):
    return _ticket_columns(progress.progressed_tickets(views.tickets(spark, folder), _progressed(spark, folder)))


@registered
def progress_store(spark, folder):
    kept = progress.progressed_store(views.store(spark, folder), _progressed(spark, folder))
    return kept.select("ticket_id", "user_id", "order_id", "status", "timestamp")


@registered
def submit_stream(spark, folder):
    """Submit dialogs as a stream of files; the result is what the next stage reads off the queue."""
    target = work_folder(spark, "intake")
    dialogs = views.submit_dialogs(spark, folder)
    dialogs.write.parquet(f"{target}/dialogs")
    stream = spark.readStream.schema(dialogs.schema).parquet(f"{target}/dialogs")
    drain.drain(stream, drain.submit(target), f"{target}/offsets")
    bodies = spark.read.text(f"{target}/queue").select(F.col("value").alias("body"))
    return queue.parse_complaints(bodies).select(*COMPLAINT.fieldNames())


@registered
def submit_blank(spark, folder):
    """Submissions without a text, put aside by the stream: first turns are sent blank here."""
    target = work_folder(spark, "blank")
    dialogs = views.submit_dialogs(spark, folder, blank_first=True)
    dialogs.write.parquet(f"{target}/dialogs")
    stream = spark.readStream.schema(dialogs.schema).parquet(f"{target}/dialogs")
    drain.drain(stream, drain.submit(target), f"{target}/offsets")
    kept = lambda name: read_batches(spark, f"{target}/{name}").select(F.lit(name).alias("output"), "user_id", "order_id", "timestamp")
    return kept("blank").unionByName(kept("complaints"))
