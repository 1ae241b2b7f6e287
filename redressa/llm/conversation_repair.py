"""Repair of conversations by the cheapest edits, found by depth-first branch-and-bound.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn.
Every row is kept, given another role, or deleted, and empty turns may be inserted; the cheapest edits
win, ties by the audit, the edits' initials in order. A node of the search is a row and what the repaired
turns so far end with. An explicit stack holds open nodes with their cost and audit; children are visited from the
lowest bound up, ties in the order of the audit. The bound of a node is its cost and the least cost of the rows that are
left, a suffix bound worked out from the end which knows nothing of audits. A node falls if its bound is
above the incumbent's cost, or equal with an audit that is no smaller, or if its dominance table holds a prefix
as cheap with an audit as small; when the stack is empty the incumbent is proved best.

Rows of one conversation are read in order from a sorted partition. What a task holds of a conversation is one byte
a row and its audit, which the result has to hold anyway: suffix bounds are kept at every ``BLOCK``
rows and worked out again within the block that is searched. Texts are only streamed, once, through the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.llm.words import row_groups
from redressa.operators.lookup import lookup_join

#: Cost of the edits, and of leaving a truncated row in.
RENAME, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Rows searched at a time.
BLOCK = 1024
NEVER = 1 << 60
#: What the repaired turns end with.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or an assistant turn may follow, and the turn that an insertion adds.
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row's code: 4 x its first fault + its role's initial (s, u, a, other); ``GONE`` marks a row that is not there.
FINE, MUST_GO, TRUNCATED, GONE = 0, 1, 2, 255


def _moves() -> list[list[list[tuple[str, int, int]]]]:
    """For every code and state: (initial, next state, cost) of the edits that consume the row, by initial."""
    table = []
    for code in range(12):
        fault, initial = divmod(code, 4)
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
        states = []
        for state in range(4):
            moves = [("D", state, DELETE)]
            if fault != MUST_GO:
                if initial == 0 and state == START:
                    moves.append(("K", SYSTEM, extra))
                for turn, letter in ((USER, 1), (ASSISTANT, 2)):
                    if state in BEFORE[turn]:
                        if initial == letter:
                            moves.append(("K", turn, extra))
                        moves.append(("R", turn, RENAME + extra))
            states.append(moves)
        table.append(states)
    return table


MOVES = _moves()
Bounds = tuple[int, int, int, int]


def _inserting(base: list[int]) -> Bounds:
    """Least costs from each state when turns may be inserted first; two insertions return to where one led from."""
    once = [INSERT + base[INSERTED[s]] for s in range(4)]
    return tuple(min(base[s], once[s], INSERT + once[INSERTED[s]]) for s in range(4))


#: At the end the turns must be complete.
END: Bounds = _inserting([0, NEVER, NEVER, 0])


def suffix_bounds(codes: bytes, end: Bounds = END) -> list[Bounds]:
    """For every row and the end: the least cost to repair what is left, from each state."""
    known: dict[tuple[Bounds, int], Bounds] = {}
    out = [end]
    # Costs less their smallest fall into few patterns, so most rows are looked up.
    low = min(end)
    shape = tuple(x - low for x in end)
    for code in reversed(codes):
        after = known.get((shape, code))
        if after is None:
            after = known[shape, code] = _inserting([min(cost + shape[t] for _, t, cost in moves) for moves in MOVES[code]])
        least = min(after)
        low += least
        shape = tuple(x - least for x in after)
        out.append(tuple(x + low for x in shape))
    return out[::-1]


def search(codes: bytes, state: int, rest: list[Bounds]) -> tuple[str, int]:
    """(audit, state at the end) of the cheapest way through ``codes`` from ``state``, the smallest audit among equals.

    ``rest`` are suffix bounds for every row and for the end; what an exit costs later is the last of them.
    """
    last = len(codes)
    best_cost, best_audit, best_state = NEVER, "", state
    dominant: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, state, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        bound = cost + rest[row][state]
        if bound > best_cost or (bound == best_cost and audit > best_audit[: len(audit)]):
            continue
        held = dominant.get((row, state))
        if held is not None and held <= (cost, audit):
            continue
        dominant[row, state] = cost, audit
        if row == last:
            if (bound, audit) < (best_cost, best_audit) or best_cost == NEVER:
                best_cost, best_audit, best_state = bound, audit, state
            continue
        children = [(row + 1, after, cost + price, audit + letter) for letter, after, price in MOVES[codes[row]][state]]
        children.append((row, INSERTED[state], cost + INSERT, audit + "I"))
        # Pushed from the worst to the best: the next to be visited has the lowest bound, then the smallest audit.
        children.sort(key=lambda c: (c[2] + rest[c[0]][c[1]], c[3]), reverse=True)
        stack.extend(children)
    return best_audit, best_state


def repair(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of the rows ``codes``."""
    borders = {}
    bounds = END
    for at in range(len(codes) - len(codes) % block, -1, -block):
        borders[at + block] = bounds
        bounds = suffix_bounds(codes[at : at + block], bounds)[0]
    cost, state, audit = bounds[START], START, []
    for at in range(0, len(codes), block):
        part = codes[at : at + block]
        edits, state = search(part, state, suffix_bounds(part, borders[at + block]))
        audit.append(edits)
    while state not in (START, ASSISTANT):
        audit.append("I")
        state = INSERTED[state]
    return cost, "".join(audit)


class Turns:
    """Writes the repaired turns of one conversation, row by row, along its audit."""

    def __init__(self, audit: str, write: Callable[[str], None]):
        self.audit, self.write, self.at, self.state, self.some = audit, write, 0, START, False

    def _turn(self, role: str, text: str) -> None:
        self.write("\n" + role + ":" + text if self.some else role + ":" + text)
        self.some = True

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = INSERTED[self.state]
            self._turn(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else INSERTED[self.state]
        self._turn(role if edit == "K" else ROLES[self.state], text)


_CONV = [("named", pa.bool_()), ("conv", pa.int64())]
_AUDITS = pa.schema([*_CONV, *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_AUDIT_KINDS = "named boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPAIRED = pa.schema([*_CONV, ("repaired", pa.string())])
LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Conversation:
    """What is gathered of one conversation while its rows pass by."""

    def __init__(self, key: tuple):
        self.key, self.codes, self.counts, self.illegal = key, bytearray(), [0, 0, 0], 0
        self.least = self.most = self.last = self.row = None
        self.turns = 0

    def add(self, turn, row: tuple, code: int, again: bool) -> None:
        if code == GONE:
            return
        fault, initial = divmod(code, 4)
        # Rows of one turn that are equal stand side by side; ``again``: seen in an earlier turn.
        copy = again or row == self.row
        self.row = row
        blank = fault == MUST_GO
        kind = 0 if blank else 1 if copy else 2 if fault == TRUNCATED else None
        if kind is not None:
            self.counts[kind] += 1
        if copy and not blank:
            code = 4 * MUST_GO + initial
        if self.codes and (self.codes[-1] % 4, initial) not in LEGAL:
            self.illegal += 1
        self.codes.append(code)
        if turn is not None:
            self.turns += turn != self.last
            self.least = turn if self.least is None else self.least
            self.most = self.last = turn

    def result(self) -> tuple:
        cost, audit = repair(bytes(self.codes))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (*self.key, gaps, *self.counts, self.illegal, cost, audit)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a partition that is sorted by conversation, turn and row."""
    now, done = None, []
    for batch in batches:
        for named, conv, turn, role, digest, code, again in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.key != (named, conv):
                if now is not None:
                    done.append(now.result())
                now = _Conversation((named, conv))
            now.add(turn, (turn, role, digest), code, again)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _AUDITS)], schema=_AUDITS)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.result(), _AUDITS)], schema=_AUDITS)


def _walk(start: Callable, finish: Callable, kind: pa.DataType):
    """Replays audits over sorted rows (named, conv, audit, role, text): an audit comes before its rows."""
    schema = pa.schema([*_CONV, ("result", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sink, turns = None, None, None
        for batch in batches:
            done = []
            rows = (row for part in row_groups(batch) for row in zip(*(c.to_pylist() for c in part.columns)))
            for named, conv, audit, role, text in rows:
                if audit is not None:
                    if turns is not None:
                        turns.inserted()
                        done.append((*key, finish(sink)))
                    key, sink = (named, conv), start()
                    turns = Turns(audit, sink[1])
                else:
                    turns.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if turns is not None:
            turns.inserted()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, finish(sink)), schema)], schema=schema)

    return run


def _hashing() -> tuple:
    digest = hashlib.sha256()
    return digest, lambda piece: digest.update(piece.encode())


def _collecting() -> tuple:
    pieces: list[str] = []
    return pieces, pieces.append


def has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost) after the damage that the remainder of crc32(``conv_id:turn``) by 20 decides.

    0 loses the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes its role user.
    A null is one space, in the hash too; conv_id and turn stay null.
    """
    blank = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(times).alias("_")).drop("_")


def _coded(rows: DataFrame) -> DataFrame:
    """Rows with the code of their role and own fault, and a digest of their text."""
    fault = F.when(~has_word(F.col("text")), MUST_GO).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select(
        F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"), "role", F.md5("text").alias("digest"),
        F.when(F.col("lost"), GONE).otherwise(4 * fault + letter).cast("int").alias("code"), "text",
    )


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("named", "conv").sortWithinPartitions("named", "conv", *order)


def repair_conversations(rows: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, lost), also where all rows are lost.

    Rows stand by turn (nulls first), then by role and by a hash of the text. A row's first fault counts: blank (no
    character but white space), duplicate (role and text seen earlier in the conversation), truncated
    (the last such character is none of ``.!?``). Keeping a row costs 0, giving it the role user or assistant 1, deleting it 2
    (a must for blank and duplicate rows), an inserted empty turn of user or assistant 5, a truncated row that is
    not deleted 5 more; the roles' initials must then read ``(s?(ua)+)?``.

    Result: conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated,
    illegal (neighbouring rows whose roles do not follow each other), cost, audit (K, R, D, I), and repaired_sha256, the
    hash of the repaired ``role:text`` with a line feed between, or with ``texts`` these turns themselves as
    ``repaired``. Null ids are one conversation. A conversation is repaired by one task, as its audit
    and its hash are each one value over its rows in order.
    """
    coded = written(_coded(rows), "conversation-rows")
    same = ["named", "conv", "role", "digest"]
    when = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    often = coded.filter(F.col("code") != GONE).groupBy(*same).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = lookup_join(coded.drop("text"), often, same, "left").withColumn("again", F.coalesce(when > F.col("first"), F.lit(False)))
    order = ["turn", "role", "digest"]
    narrow = marked.select("named", "conv", *order, "code", "again")
    audits = written(_sorted(narrow, *order).mapInArrow(_audits, _AUDIT_KINDS), "conversation-audits")
    walked = coded.filter(F.col("code") != GONE).select("named", "conv", F.lit(None).cast("string").alias("audit"), *order, "text")
    heads = audits.select("named", "conv", "audit", *[F.lit(None).cast(walked.schema[c].dataType).alias(c) for c in [*order, "text"]])
    both = _sorted(walked.unionByName(heads).withColumn("row", F.col("audit").isNull()), "row", *order).select("named", "conv", "audit", "role", "text")
    if texts:
        name, run = "repaired", _walk(_collecting, lambda sink: "".join(sink[0]), pa.string())
    else:
        name, run = "repaired_sha256", _walk(_hashing, lambda sink: sink[0].hexdigest(), pa.string())
    repaired = both.mapInArrow(run, "named boolean, conv long, result string").withColumnRenamed("result", name)
    return audits.join(repaired, ["named", "conv"]).select(
        F.when(F.col("named"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", name
    )
