"""Periodic runs of words, by a dictionary of basic factors.

A basic factor is a stretch of 2**k words; equal factors of one text have one name, made of the names of
its halves. Where the occurrences of a name follow each other at the same distance p, at most twice the
factor's length apart, three in a row are an arithmetic progression and propose the period p. A run of
period q that is at least 4q words long holds such a progression at the level whose factors are at least q and
less than 2q words long: its first three occurrences begin at the run's start, and since the period is
the smallest one no other occurrence lies between them. A proposal is extended both ways
by comparing factors from the longest down, so a run of any length takes as many steps as there are levels.
A factor that occurs once in its text can be in no longer repetition, so the levels thin out quickly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.llm.words import Words, mix, row_groups, words_of

#: A run has at least so many words, and its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4


def _named(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names for ``places`` (ascending) with equal ``keys``: (name of every place of the chunk, distance to the next of the name, places whose name occurs again).

    A place without a name, or with one of its own, gets a negative number that no other place has.
    """
    order = np.argsort(keys, kind="stable")
    ranked, spots = keys[order], places[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    first = np.ones(len(keys), bool)
    first[1:] = ~same
    names = np.arange(-1, -size - 1, -1, dtype=np.int32)
    names[spots[again]] = (np.cumsum(first) - 1)[again]
    ahead = np.zeros(size, np.int32)
    ahead[spots[:-1][same]] = (spots[1:] - spots[:-1])[same]
    return names, ahead, np.sort(spots[again])


def _proposals(ahead: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) where an arithmetic progression of three begins; of a stretch of such places the first."""
    step = ahead[places]
    near = (step > 0) & (step <= 2 * length)
    start, step = places[near], step[near]
    three = ahead[start + step] == step
    start, step = start[three], step[three]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1] + 1) | (step[1:] != step[:-1])
    return start[fresh], step[fresh].astype(np.int64)


def _extended(levels: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch (begin, end) around each place in which words a period apart are equal."""
    size = len(levels[0])
    right, left = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for k in reversed(range(len(levels))):
        names = levels[k]
        one = start + right
        two = one + period
        fits = two < size
        right += (fits & (names[np.where(fits, one, 0)] == names[np.where(fits, two, 0)])).astype(np.int64) << k
        one = start - left - (1 << k)
        fits = one >= 0
        left += (fits & (names[np.where(fits, one, 0)] == names[np.where(fits, one + period, 0)])).astype(np.int64) << k
    return start - left, start + right + period


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period; ``text`` numbers the text each word is in."""
    size = len(words)
    none = np.zeros((0, 3), np.int64)
    if size < least:
        return none
    keys = mix(words ^ mix(text.astype(np.uint64) + np.uint64(1)))
    places, levels, found, k = np.arange(size), [], [], 0
    while len(places):
        names, ahead, places = _named(keys, places, size)
        levels.append(names)
        found.append(_proposals(ahead, places, 1 << k))
        # The next level's factors: two of this one, both of which occur again.
        second = places + (1 << k)
        places = places[second < size]
        second = places + (1 << k)
        whole = names[second] >= 0
        places, second = places[whole], second[whole]
        keys = names[places].astype(np.int64) << 32 | names[second]
        k += 1
    start, period = (np.concatenate(part) for part in zip(*found))
    if not len(start):
        return none
    begin, end = _extended(levels, start, period)
    length = end - begin
    held = (length >= least) & (length >= times * period)
    runs = np.unique(np.stack([begin, length, period], axis=1)[held], axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_part(n: int, number: int) -> tuple[int, int]:
    """(a, p): from word ``a`` on, a text of ``n`` words goes on with its next ``p`` words over and over; ``number`` decides."""
    a = number % n
    return a, 1 + (n - a) // (3 + number % 8)


def _sources(words: Words, numbers: np.ndarray) -> np.ndarray:
    """For every word the one that stands there after the damage: a tenth of the texts repeat a part."""
    source = np.arange(len(words.hashes))
    counts = words.counts
    for d in np.flatnonzero((numbers >= 0) & (numbers % 10 == 0) & (counts > 0)):
        a, p = repeated_part(int(counts[d]), int(numbers[d]) // 10)
        lo, hi = int(words.first[d]) + a, int(words.first[d + 1])
        source[lo:hi] = lo + np.arange(hi - lo) % p
    return source


def _kept_texts(words: Words, source: np.ndarray, kept: np.ndarray) -> Iterator[bytes]:
    """The kept words of each text, with one space between them."""
    first, starts, ends = words.first, words.starts, words.ends
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    changed = np.concatenate([[0], np.cumsum((source != np.arange(len(source))) | ~kept)])
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if lo == hi:
            yield b""
        elif changed[hi] == changed[lo] and ends[hi - 1] - starts[lo] == total[hi] - total[lo] + hi - lo - 1:
            # Nothing is cut and one white byte stands between all words.
            part = words.data[starts[lo] : ends[hi - 1]].copy()
            part[(ends[lo : hi - 1] - starts[lo])] = 32
            yield part.tobytes()
        else:
            at = source[lo:hi][kept[lo:hi]]
            low = int(starts[lo])
            data = words.data[low : ends[hi - 1]].tobytes()
            yield b" ".join(data[s:e] for s, e in zip((starts[at] - low).tolist(), (ends[at] - low).tolist()))


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string()),
])
RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def _detect(part: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    words = words_of(part.column("text"))
    counts, first = words.counts, words.first
    source = _sources(words, part.column("number").fill_null(-1).to_numpy())
    text = np.repeat(np.arange(len(counts)), counts)
    runs = runs_of(words.hashes[source], text, least, times)
    home = text[runs[:, 0]]
    begin, length, period = runs[:, 0] - first[home], runs[:, 1], runs[:, 2]
    # What follows the first period of a run goes.
    cut = np.zeros(len(source) + 1, np.int64)
    np.add.at(cut, runs[:, 0] + period, 1)
    np.add.at(cut, runs[:, 0] + length, -1)
    kept = np.cumsum(cut[:-1]) == 0
    bounds = np.searchsorted(home, np.arange(len(counts) + 1))
    # Longest first, then earliest, then of the shortest period: the first of each text is its best.
    order = np.lexsort((period, begin, -length, home))
    some = bounds[1:] > bounds[:-1]
    best = order[np.where(some, np.minimum(bounds[:-1], max(len(order) - 1, 0)), 0)] if len(order) else np.zeros(len(counts), np.int64)
    pick = lambda values: pa.array(values[best] if len(values) else np.zeros(len(counts), np.int64), pa.int64(), mask=~some)
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], names=["start", "length", "period"]
    ))
    return pa.RecordBatch.from_arrays([
        part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pick(begin), pick(length), pick(period), pick(1000 * length // period),
        listed, pa.array(list(_kept_texts(words, source, kept)), pa.binary()).cast(pa.string()),
    ], schema=SCHEMA)


def periodic_runs(docs: DataFrame, number: Column | None = None, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """The periodic runs of every whole text, and the text without their repetitions.

    A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at least
    ``least`` words and ``times`` q, that no neighbouring word extends. Result: doc_id; n_runs; start (word
    number from 0), length, period and exponent_milli (floor of 1000 length / period) of the longest run,
    ties by smaller start, then period, null without runs; runs (all, by start, then period);
    collapsed (the words that no run holds after its first period, one space between them).

    ``number``, if given, is a long that damages a text first: where it is a multiple of 10, a part chosen by the rest
    repeats to the end (see :func:`repeated_part`); a null damages nothing. Null and empty texts have no
    words. Every row is a document, repeated ids and texts too; other columns are not looked at. A text
    is handled by one task, about 4 MB of short texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_groups(batch):
                yield _detect(part, least, times)

    chosen = F.lit(None) if number is None else number
    return docs.select("doc_id", "text", chosen.cast("long").alias("number")).mapInArrow(run, RESULT)


def run_lines(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
