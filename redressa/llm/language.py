"""Language identification by unigrams over pieces of a fixed vocabulary, with all segmentations summed.

Each language has a probability for every piece of a public vocabulary. The probability of a word is the
sum, over all ways to cut it into pieces, of the product of their probabilities, by the forward
algorithm; a text is the product of its words. The piece probabilities are fitted by
expectation-maximisation with the same sum, over words of up to 32 bytes and such parts of longer ones.
Predictions sum over whole words. Every single byte is a piece, so any text has a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import bounded_sample, id_remainder, written
from redressa.llm.words import mix, powers, row_groups, words_of

#: Bounds of the labelled sample the probabilities are fitted on, for each language.
FIT_DOCS, FIT_BYTES, ROUNDS = 3000, 24 << 20, 3
#: The fit takes longer words in parts of so many bytes; predictions take whole words.
PART = 32
#: Bytes of words that are scored at a time, and below which chances are scaled up.
AT_ONCE, FAINT = 600_000, 1e-150
PRIOR_COUNT = 0.02
SLICE = 8 << 20
_BASE = 0xD6E8FEB86659FD93
_BITS = 20


class Pieces:
    """The vocabulary as byte strings, found by hash; a leading space marks the start of a word."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                found.add(model.id_to_piece(i).replace("▁", " ").encode())
        pieces = sorted(found)
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        hashes = np.array([self.hash(np.frombuffer(p, np.uint8)) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.slots = np.zeros(1 << _BITS, bool)
        self.slots[hashes >> np.uint64(64 - _BITS)] = True

    @staticmethod
    def hash(part: np.ndarray) -> np.uint64:
        power, _ = powers(_BASE, len(part))
        return mix(np.array([((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum()], np.uint64))[0]

    def found(self, text: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of words of equal length, one a row: (from, to, rows, piece ids), with ascending ``to``."""
        m, n = text.shape
        power, inverse = powers(_BASE, n + 2)
        total = np.zeros((n + 1, m), np.uint64)
        np.cumsum((text.T.astype(np.uint64) + np.uint64(1)) * power[:n, None], axis=0, out=total[1:])
        ends, sizes, rows, ids = [], [], [], []
        for size in range(1, min(self.longest, n) + 1):
            h = mix((total[size:] - total[:-size]) * inverse[: n - size + 1, None])
            start, row = np.nonzero(self.slots[h >> np.uint64(64 - _BITS)])
            sought = h[start, row]
            at = np.searchsorted(self.hashes, sought)
            at[at == self.size] = 0
            same = self.hashes[at] == sought
            ends.append(start[same] + size)
            sizes.append(np.full(int(same.sum()), size))
            rows.append(row[same])
            ids.append(self.ids[at[same]])
        end, size, row, piece = (np.concatenate(x) for x in (ends, sizes, rows, ids))
        order = np.lexsort((row, -size, end))
        end, size, row, piece = end[order], size[order], row[order], piece[order]
        edges = np.flatnonzero(np.concatenate([[True], (end[1:] != end[:-1]) | (size[1:] != size[:-1])])) if len(end) else []
        for lo, hi in zip(edges, [*edges[1:], len(end)]):
            yield int(end[lo] - size[lo]), int(end[lo]), row[lo:hi], piece[lo:hi]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _parts(words, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal-length parts of the picked words: (index into ``pick``, byte matrix), the first with a leading space."""
    lengths = words.ends[pick] - words.starts[pick]
    cuts = -(-lengths // PART)
    index = np.repeat(np.arange(len(pick)), cuts)
    place = np.arange(len(index)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = words.starts[pick][index] + place * PART
    length = np.minimum(PART, words.ends[pick][index] - begin)
    lead = place == 0
    kind = length * 2 + lead
    order = np.argsort(kind, kind="stable")
    edges = np.flatnonzero(np.diff(kind[order], prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(order)]):
        for at in range(lo, hi, 20_000):
            rows = order[at : min(hi, at + 20_000)]
            text = words.data[begin[rows][:, None] + np.arange(length[rows[0]])]
            if lead[rows[0]]:
                text = np.concatenate([np.full((len(rows), 1), 32, np.uint8), text], axis=1)
            yield index[rows], text


def _whole(words, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal-length picked words: (index into ``pick``, byte matrix with a leading space)."""
    lengths = words.ends[pick] - words.starts[pick]
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(order)]):
        length = int(lengths[order[lo]])
        step = max(1, AT_ONCE // (length + 1))
        for at in range(lo, hi, step):
            rows = order[at : min(hi, at + step)]
            text = np.full((len(rows), length + 1), 32, np.uint8)
            text[:, 1:] = words.data[words.starts[pick][rows][:, None] + np.arange(length)]
            yield rows, text


def log_likelihood(pieces: Pieces, chance: np.ndarray, words, pick: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each picked word under each language; ``chance`` is pieces x languages.

    Sums reach back over the longest piece only, so a word of any length is summed over all its segmentations; where
    they get faint they are scaled up.
    """
    out = np.zeros((len(pick), chance.shape[1]))
    reach = pieces.longest + 1
    for index, text in _whole(words, pick):
        # Sums of the last positions, in turn; a position is cleared when it is reached again.
        forward = np.zeros((reach, len(text), chance.shape[1]))
        forward[0], scaled, now = 1, np.zeros(forward.shape[1:]), 0
        for i, j, rows, ids in pieces.found(text):
            if j != now:
                now = j
                forward[j % reach] = 0
                if j % 8 == 0:
                    largest = forward.max(axis=0)
                    faint = largest < FAINT
                    if faint.any():
                        forward[:, faint] /= largest[faint]
                        scaled[faint] += np.log(largest[faint])
            forward[j % reach, rows] += forward[i % reach, rows] * chance[ids]
        out[index] = np.log(np.maximum(forward[text.shape[1] % reach], 1e-300)) + scaled
    return out


def expected_counts(pieces: Pieces, chance: np.ndarray, words, pick: np.ndarray, lang: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Pieces x languages: how often each piece is used, over all segmentations of the words of each language."""
    out = np.zeros_like(chance)
    for index, text in _parts(words, pick):
        own, hits = lang[index], list(pieces.found(text))
        forward = np.zeros((text.shape[1] + 1, len(text)))
        backward = np.zeros_like(forward)
        forward[0] = backward[-1] = 1
        for i, j, rows, ids in hits:
            forward[j, rows] += forward[i, rows] * chance[ids, own[rows]]
        for i, j, rows, ids in sorted(hits, key=lambda x: -x[0]):
            backward[i, rows] += backward[j, rows] * chance[ids, own[rows]]
        weight = times[index] / np.maximum(forward[-1], 1e-300)
        for i, j, rows, ids in hits:
            used = forward[i, rows] * chance[ids, own[rows]] * backward[j, rows] * weight[rows]
            np.add.at(out, (ids, own[rows]), used)
    return out


def fit(docs: DataFrame, vocabulary: str, max_docs: int = FIT_DOCS, max_bytes: int = FIT_BYTES) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from (text, lang) with both present.

    The sample per language is bounded by ``max_docs`` and ``max_bytes``; the model has one number per
    piece and language, whatever the input.
    """
    sample = bounded_sample(docs.select("lang", "text").dropna(), "lang", "text", max_docs, max_bytes)
    sample = written(sample.repartition(F.xxhash64("text")), "language-sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    pieces = pieces_of(vocabulary)
    chance = np.full((pieces.size, len(langs)), 1 / pieces.size)
    for _ in range(ROUNDS if langs else 0):
        shared = docs.sparkSession.sparkContext.broadcast(chance)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total = pieces_of(vocabulary), np.zeros_like(shared.value)
            place = {x: i for i, x in enumerate(langs)}
            for batch in batches:
                for rows in row_groups(batch, limit=SLICE):
                    words = words_of(rows.column("text"), lower=True)
                    lang = np.repeat([place[x] for x in rows.column("lang").to_pylist()], words.counts).astype(np.int64)
                    for code in range(len(langs)):
                        mine = np.flatnonzero(lang == code)
                        if len(mine):
                            _, at, times = np.unique(words.hashes[mine], return_index=True, return_counts=True)
                            total += expected_counts(own, shared.value, words, mine[at], np.full(len(at), code), times)
            piece, code = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int64()), pa.array(code, pa.int64()), pa.array(total[piece, code])], names=["piece", "code", "used"]
            )

        sums = sample.mapInArrow(count, "piece long, code long, used double").groupBy("piece", "code").agg(F.sum("used").alias("used"))
        rows = sums.toArrow()  # at most pieces x languages
        used = np.full(chance.shape, PRIOR_COUNT)
        used[rows["piece"].to_numpy(), rows["code"].to_numpy()] += rows["used"].to_numpy()
        chance = used / used.sum(axis=0)
        shared.unpersist()
    return langs, chance


def predict(docs: DataFrame, vocabulary: str, langs: list[str], chance: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text and others) with lang_pred and score, the probability of that language given the text."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(chance)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for batch in batches:
            for rows in row_groups(batch, limit=SLICE):
                words = words_of(rows.column("text"), lower=True)
                _, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                likely = log_likelihood(pieces, shared.value, words, at)
                text = np.repeat(np.arange(len(rows)), words.counts)
                total = np.stack([np.bincount(text, likely[back, k], len(rows)) for k in range(len(langs))], axis=1)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                keep = np.array(rows.column("_has_letter").to_pylist(), bool)
                pred = [langs[b] if k else "und" for b, k in zip(best, keep)]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in names if c != "text"], pa.array(pred, pa.string()), pa.array(np.where(keep, share, 0.0))],
                    names=[*[c for c in names if c != "text"], "lang_pred", "score"],
                )

    kept = docs.drop("text")
    if not langs:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.withColumn("_has_letter", has_letter).mapInArrow(score, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score.

    Documents whose id leaves remainder 1 modulo 3 are held out of the fit, as are those without lang or
    text; a null id is not held out. ``und`` with score 0 where the text is null or has no letter, or nothing could be fitted. Ties go to the
    language that sorts first.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    langs, chance = fit(rows.filter(~F.col("held_out")), vocabulary)
    return predict(rows.select("doc_id", "held_out", "text"), vocabulary, langs, chance)
