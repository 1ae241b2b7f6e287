"""Text probability by context-tree weighting over bytes.

A text is its words, A-Z folded, with one space between them and a line end after the last. Each byte is
eight binary decisions; a decision's context is the bytes before it, at every depth from none to DEPTH.
At each depth a Krichevsky-Trofimov estimate from the training counts gives the chance of a bit. Bottom
up, a context's weight against all its longer ones is the ratio of what both give the training data;
top to bottom, the chances of the depths are mixed with these weights. A path ends at the deepest
context that training has seen, so the chances of a decision always sum to one.

The counts are of (context, next byte). They are gathered per task, dealt by the last CUT context bytes and
summed, so that all longer contexts of a part of the tree lie together; only the few depths above come to
the driver, at most 256 ** CUT rows. Texts are scored in groups: the distinct words and contexts of a group
are sent to the parts of the model, and their values come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import id_remainder, shuffle_parts, written
from redressa.llm.words import Words, mix, row_groups, words_of

#: Keys are 48 bits: the context, last byte first, and the next byte.
DEPTH, CUT = 5, 2
END = np.uint64(0x2545F4914F6CDD1D)
SLICE = 2 << 20
#: A task sends on what it has counted beyond so many distinct keys.
HELD = 4_000_000
#: Bytes of text that a group has at most, and groups whose questions to one part of the model go to one task.
GROUP_BYTES, ANSWERED = 32 << 20, 64
WORD, GRAM = 0, 1
_COUNTS = "kind int, bucket int, keys binary, counts binary"
_ASKED = "kind int, bucket int, grp int, keys binary"
_ANSWERS = "kind int, bucket int, grp int, value binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"


class Level(NamedTuple):
    """One depth: (context, decision) keys, ascending, counts of both bits, and the weight against longer contexts."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray | None
    log_weighted: np.ndarray


def serial(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the texts, and how many each text has."""
    docs, counts, lengths = len(words.counts), words.counts, words.ends - words.starts
    after = np.cumsum(lengths + 1)
    # Each word with the byte after it, which becomes a space, or a line end after the last.
    source = np.repeat(words.starts - (after - lengths - 1), lengths + 1)
    source += np.arange(len(source))
    text = words.data.take(source, mode="clip") if len(source) else np.zeros(0, np.uint8)
    text[after - 1] = 32
    upto = np.concatenate([[0], after])[words.first]
    if not counts.all():
        text = np.insert(text, upto[1:][counts == 0], 10)
    size = np.diff(upto) + (counts == 0)
    begin = np.cumsum(size) - size
    text[begin + size - 1] = 10
    # A number that starts DEPTH + 1 bytes before a byte has its context in place.
    held = np.full(len(text) + 8, 10, np.uint8)
    held[DEPTH + 1 : DEPTH + 1 + len(text)] = text
    keys = np.ndarray(len(text), "<u8", held, strides=(1,)) & np.uint64((1 << 8 * (DEPTH + 1)) - 256)
    keys |= text
    for at in range(min(DEPTH, int(size.max(initial=0)))):  # before a text there are line ends
        place, none = begin[size > at] + at, (1 << 8 * (DEPTH + 1 - at)) - 256
        keys[place] = keys[place] & np.uint64((1 << 64) - 1 - none) | np.uint64(0x0A0A0A0A0A0A0A0A & none)
    return keys, size


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of the texts, and how many each text has."""
    counts = words.counts + 1
    out = np.full(counts.sum(), END)
    doc = np.repeat(np.arange(len(counts)), words.counts)
    out[np.arange(len(doc)) + doc] = words.hashes
    return out, counts


def bucket_of(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    held = keys if kind == WORD else mix(keys >> np.uint64(8 * (DEPTH + 1 - CUT)))
    return (held % np.uint64(parts)).astype(np.int64)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Places where another key begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    # Sums of whole numbers are the same in any order.
    whole = all(v.dtype.kind == "i" for v in values)
    order = np.argsort(keys, kind=None if whole else "stable")
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def _unique(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, ascending; sorting numbers takes a small part of the time of ``np.unique``, which hashes them."""
    keys = np.sort(keys)
    return keys[_firsts(keys)]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys))


def _places(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where in the ascending ``among`` each key is; looked up in order, so that neighbours are close."""
    order, out = np.argsort(keys), np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(among, keys[order])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series eight steps up."""
    z, low = x + 8.0, np.zeros(len(x))
    for k in range(8):
        low += np.log(x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _up(level: Level) -> tuple[np.ndarray, ...]:
    """Keys, counts and weighted logarithms of the longer contexts, summed by the context without its oldest byte."""
    keys = (level.keys >> np.uint64(16) << np.uint64(8)) | (level.keys & np.uint64(255))
    return _summed(keys, level.zeros, level.ones, level.log_weighted)


def _level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> Level:
    own = _log_kt(zeros, ones)
    weight = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
    return Level(keys, zeros, ones, weight, np.logaddexp(own, longer) - np.log(2))


def decisions(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of the next byte: (context and decision, bit)."""
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    for k in range(8):
        yield context | np.uint64(1 << k) | byte >> np.uint64(8 - k), (byte >> np.uint64(7 - k)) & np.uint64(1)


def deep_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Depths DEPTH down to CUT + 1 of the part of the tree that the keys belong to."""
    nodes, zeros, ones = [], [], []
    for node, bit in decisions(keys):
        nodes.append(node)
        ones.append(np.where(bit == 1, counts, 0).astype(np.float64))
        zeros.append(np.where(bit == 1, 0, counts).astype(np.float64))
    node, zero, one = _summed(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))
    levels = [Level(node, zero, one, None, _log_kt(zero, one))]
    for _ in range(DEPTH - CUT - 1):
        levels.append(_level(*_up(levels[-1])))
    return levels


def chances(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Base-10 logarithm of the chance of each key's byte; ``levels`` from the deepest to depth 0."""
    total = np.zeros(len(keys))
    for node, bit in decisions(keys):
        chance = np.full(len(keys), 0.5)
        deeper = np.zeros(len(keys), bool)
        for up, level in enumerate(levels):
            if not len(level.keys):
                continue
            here = (node >> np.uint64(8 * (up + 1)) << np.uint64(8)) | (node & np.uint64(255))
            at = np.minimum(np.searchsorted(level.keys, here), len(level.keys) - 1)
            seen = level.keys[at] == here
            zeros, ones = level.zeros[at], level.ones[at]
            own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
            mixed = own if level.weight is None else np.where(deeper, level.weight[at] * own + (1 - level.weight[at]) * chance, own)
            chance = np.where(seen, mixed, chance)
            deeper |= seen
        total += np.log10(chance)
    return total


def _runs(kind: int, keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) in a fixed order."""
    bucket = bucket_of(kind, keys, parts)
    # Stable sorts of small numbers take one pass.
    order = np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(order)]):
        yield int(bucket[order[lo]]), order[lo:hi]


def _pack(kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    rows = [(kind, b, keys[at].tobytes(), counts[at].astype(np.int64).tobytes()) for b, at in _runs(kind, keys, parts)]
    for lo in range(0, len(rows), 64):
        columns = list(zip(*rows[lo : lo + 64]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
            names=["kind", "bucket", "keys", "counts"],
        )


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(*[np.concatenate(x) for x in zip(*parts)])


def _count(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        for batch in batches:
            for rows in row_groups(batch, limit=SLICE):
                words = words_of(rows.column("text"), lower=True)
                for kind, keys in ((WORD, tokens(words)[0]), (GRAM, serial(words)[0])):
                    held[kind].append(_counted(keys))
                    if sum(len(k) for k, _ in held[kind]) > HELD:
                        held[kind] = [_merged(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from _pack(kind, *held[kind].pop(), parts)
        for kind, found in held.items():
            if found:
                yield from _pack(kind, *_merged(found), parts)

    return run


def _arrays(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _merge(part: pa.Table) -> pa.Table:
    keys, counts = _summed(_arrays(part["keys"], np.uint64), _arrays(part["counts"], np.int64))
    return pa.table({
        "kind": part["kind"][:1], "bucket": part["bucket"][:1],
        "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
        "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
    })


def _top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts")):
            levels = deep_levels(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64))
            node, zeros, ones, longer = _up(levels[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(longer)], names=["node", "zeros", "ones", "longer"]
            )


class Model(NamedTuple):
    """Counts by part in a table; the depths from CUT to 0; numbers of training tokens and distinct ones."""

    parts: DataFrame
    top: list[Level]
    tokens: int
    distinct: int
    buckets: int


def fit(texts: DataFrame) -> Model:
    """Count all of (text); null is a text without words."""
    buckets = shuffle_parts(texts.sparkSession)
    counted = texts.select("text").mapInArrow(_count(buckets), _COUNTS)
    parts = written(
        counted.groupBy("kind", "bucket").applyInArrow(_merge, f"{_COUNTS}, distinct long, total long"), "context-counts"
    )
    sizes = parts.filter(F.col("kind") == WORD).agg(F.sum("total"), F.sum("distinct")).first()
    rows = (
        parts.filter(F.col("kind") == GRAM).select("keys", "counts")
        .mapInArrow(_top_rows, "node long, zeros double, ones double, longer double")
        .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("longer").alias("longer"))
        .orderBy("node").toArrow()
    )  # at most 256 ** CUT contexts with 255 decisions
    node, zeros, ones, longer = (rows[c].to_numpy() for c in ("node", "zeros", "ones", "longer"))
    top = [_level(node.astype(np.uint64), zeros, ones, longer)]
    for _ in range(CUT):
        top.append(_level(*_up(top[-1])))
    return Model(parts, top, sizes[0] or 0, sizes[1] or 0, buckets)


def _ordered(docs: pa.Table) -> pa.RecordBatch:
    """Texts of a group in an order any task finds again."""
    docs = docs.sort_by([("doc_id", "ascending"), ("tag", "ascending")]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) for c in docs.columns], names=docs.column_names)


def _distinct(rows: pa.RecordBatch) -> dict[int, np.ndarray]:
    found = {WORD: [np.zeros(0, np.uint64)], GRAM: [np.zeros(0, np.uint64)]}
    for part in row_groups(rows, limit=SLICE):
        words = words_of(part.column("text"), lower=True)
        found[WORD].append(_unique(tokens(words)[0]))
        found[GRAM].append(_unique(serial(words)[0]))
    return {k: _unique(np.concatenate(v)) for k, v in found.items()}


def _ask(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        group, rows = docs["grp"][0].as_py(), []
        for kind, keys in _distinct(_ordered(docs)).items():
            rows += [(kind, b, group, keys[at].tobytes()) for b, at in _runs(kind, keys, parts)]
        columns = list(zip(*rows))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "bucket", "grp", "keys"), columns, kinds)})

    return run


def _answer(top):
    def run(asked: pa.Table, part: pa.Table) -> pa.Table:
        """Counts of words, or logarithms of chances, in the order asked."""
        known = [_arrays(part["keys"], np.uint64), _arrays(part["counts"], np.int64)]
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in asked["keys"]]
        distinct = _unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        if not each:
            values = distinct
        elif asked["kind"][0].as_py() == WORD:
            values = np.zeros(len(distinct), np.int64)
            if len(known[0]):
                at = np.minimum(np.searchsorted(known[0], distinct), len(known[0]) - 1)
                values = np.where(known[0][at] == distinct, known[1][at], 0)
        else:
            levels = (deep_levels(*known) if len(known[0]) else [Level(*[np.zeros(0)] * 5)] * (DEPTH - CUT)) + top.value
            values = chances(distinct, levels)
        return pa.table({
            "kind": asked["kind"], "bucket": asked["bucket"], "grp": asked["grp"],
            "value": pa.array([values[np.searchsorted(distinct, x)].tobytes() for x in each], pa.binary()),
        })

    return run


def _score(parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        slices = []
        for part in row_groups(_ordered(docs), limit=SLICE):
            words = words_of(part.column("text"), lower=True)
            found = {WORD: tokens(words), GRAM: serial(words)}
            # Distinct keys, where each key of the texts is among them, and how many each text has.
            placed = {k: (*pd.factorize(keys), sizes) for k, (keys, sizes) in found.items()}
            slices.append((part, {k: (own, back.astype(np.int32), sizes) for k, (back, own, sizes) in placed.items()}))
        came = {(k, b): v for k, b, v in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["value"])}
        keys, value = {}, {}
        for kind, number in ((WORD, np.int64), (GRAM, np.float64)):
            keys[kind] = _unique(np.concatenate([s[kind][0] for _, s in slices]))
            value[kind] = np.zeros(len(keys[kind]), number)
            for bucket, at in _runs(kind, keys[kind], parts):
                value[kind][at] = np.frombuffer(came[kind, bucket].as_buffer(), number)
        out = []
        for part, found in slices:
            n = len(part)
            each = {k: value[k][_places(own, keys[k])][back] for k, (own, back, _) in found.items()}
            text = {k: np.repeat(np.arange(n), sizes) for k, (_, _, sizes) in found.items()}
            seen = each[WORD]
            out.append(pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(found[WORD][2], pa.int64()),
                pa.array(np.bincount(text[WORD], seen > 0, n).astype(np.int64)),
                pa.array(np.bincount(text[WORD], np.log10(seen + 0.1), n)),
                pa.array(np.bincount(text[GRAM], each[GRAM], n)), pa.array(found[GRAM][2], pa.int64()),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score", "n_bytes"]))
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, model: Model, groups: int | None = None) -> DataFrame:
    """Score (doc_id, held_out, text): the counts a word model needs, score and n_bytes, the code length being -score * log2(10) bits."""
    session, buckets = docs.sparkSession, model.buckets
    tag = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.coalesce("text", F.lit("")).alias("text"), tag.alias("tag"))
    if groups is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        groups = max(shuffle_parts(session), -(-size // GROUP_BYTES))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(groups)).cast("int"))
    by_group, top = rows.groupBy("grp"), session.sparkContext.broadcast(model.top)
    # What all groups ask of the commonest ending grows with the texts, the part that answers does not: it is sent to several tasks.
    share = F.floor(F.col("grp") / ANSWERED).cast("int")
    asked = by_group.applyInArrow(_ask(buckets), _ASKED).withColumn("share", share)
    shares = F.sequence(F.lit(0), F.lit((groups - 1) // ANSWERED))
    parts = model.parts.withColumn("share", F.explode(shares))
    place = ["kind", "bucket", "share"]
    answers = asked.groupBy(*place).cogroup(parts.groupBy(*place)).applyInArrow(_answer(top), _ANSWERS)
    return by_group.cogroup(answers.groupBy("grp")).applyInArrow(_score(buckets), _SCORES)


def language_model(docs: DataFrame) -> DataFrame:
    """Word-model and context-tree scores of all texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the documents whose id leaves a remainder other than 0 modulo 10; a null id is learnt from.
    Null and empty texts have the end token only. Every row is a text.
    """
    rows = docs.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "text")
    model = fit(rows.filter(~F.col("held_out")))
    whole = model.tokens + 0.1 * (model.distinct + 1)
    scored = score(rows, model)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(whole)))).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
