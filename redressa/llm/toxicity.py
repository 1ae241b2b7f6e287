"""Toxicity by two Kneser-Ney models of words, one fitted on the texts of each class.

The chance of a word after another in a class is its discounted share among the words that follow there. What is
left goes to the same share over both classes, times what the class makes of the word by itself (marginal
adaptation); then to the class's continuation counts (how many different words a word follows), to those of the
word's stem, and to all stems alike. Discounts are those of modified Kneser-Ney smoothing, from how many units
occur once, twice, three and four times. Copies of a text count once.

Every word of a text has a ratio, its chance in the toxic class over that in the other. As a toxic text is toxic in
some of its words only, its likelihood is that of a mixture: each word comes from the toxic class's model with a
small chance, else from the other. The mean logarithm per word is put on a scale of 0 to 1 by a logistic curve,
fitted on the same texts with each one's own counts taken out of the models.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import bounded_sample, id_remainder, shuffle_parts, written
from redressa.llm.words import NOT_LETTER, Words, mix, row_groups, words_of

#: Bounds of the labelled sample, for each class.
FIT_DOCS, FIT_BYTES = 6000, 24 << 20
STEM_BYTES = 5
#: Words after another count together with so many that follow the classes' common chances.
STRENGTH = 50.0
#: Shares of a toxic text's words that come from the toxic class's model; the fit takes the one that fits best.
SHARES = (0.001, 0.003, 0.01, 0.03, 0.1)
#: ``ratios`` lists what differs by so many standard errors and by this much.
ERRORS, LEAST_RATIO = 4.0, 1.0
#: Bytes of text whose words are scored at a time; a score holds many numbers for each word.
AT_ONCE = 1 << 20
START, SHORT = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


class Counts(NamedTuple):
    """Counts by class of units with ascending hashes, and the discounts of a count of 0, 1, 2 and more.

    ``total`` and ``left`` are the sums of the counts and of what is taken off, where they are needed.
    """

    keys: np.ndarray
    n: np.ndarray
    off: np.ndarray
    total: np.ndarray | None = None
    left: np.ndarray | None = None

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def look(self, keys: np.ndarray) -> np.ndarray:
        place, there = self.at(keys)
        if not len(self.keys):
            return np.zeros((len(self.n), len(keys)), np.int64)
        return np.where(there, self.n[:, place], 0).astype(np.int64)


class Model(NamedTuple):
    """What both classes' models need.

    ``pairs`` counts texts, with the discounts of both classes together in a third row of ``off``. ``before`` has the
    sums over what follows a word, ``left`` what the discounts take off there, for each class and for both, and
    ``norm`` what makes the adapted chances one. ``words`` and ``stems`` are continuation counts; ``kinds`` is how
    many words a stem has, with one that was not seen unless the word is short.
    """

    pairs: Counts
    before: Counts
    left: np.ndarray
    norm: np.ndarray
    words: Counts
    stems: Counts
    kinds: np.ndarray


class Fitted(NamedTuple):
    """The models, as every task has them, the mixture's share, and the curve over (mean, mean * sqrt(words))."""

    shared: Broadcast
    share: float
    curve: tuple[float, float, float]


def _short(word: np.ndarray) -> np.ndarray:
    """Stems of short words, which are stems of their own."""
    return mix(word ^ np.uint64(SHORT))


def _stems(words: Words) -> np.ndarray:
    """Hash of the first bytes of each word; see :func:`_short` for a shorter one."""
    out = _short(words.hashes)
    long = np.flatnonzero(words.ends - words.starts >= STEM_BYTES)
    value = np.zeros(len(long), np.uint64)
    for k in range(STEM_BYTES):
        value = value << np.uint64(8) | words.data[words.starts[long] + k].astype(np.uint64)
    out[long] = mix(value + np.uint64(1))
    return out


def _words(rows: pa.RecordBatch) -> Words:
    """Runs of letters in lower case; all characters beyond ASCII count as letters."""
    return words_of(pc.utf8_lower(rows.column("text")), gap=NOT_LETTER)


def _before(words: Words) -> np.ndarray:
    """Hash of the word before each word, or of the start of its text."""
    before = np.empty(len(words.hashes), np.uint64)
    before[1:] = words.hashes[:-1]
    before[words.first[:-1][words.counts > 0]] = START
    return before


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word + mix(before))


def _in_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that differ from text to text."""
    return mix(keys + mix(text.astype(np.uint64)))


def _texts(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.counts)), words.counts)


def _sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_bytes: int) -> DataFrame:
    """(text, toxic, copies) of labelled documents; several labels of one document count as the highest."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = bounded_sample(known.withColumn("key", F.col("doc_id").cast("string")), "toxic", "key", max_docs, 1 << 62)
    # At most max_docs ids per class.
    rows = docs.dropna(subset=["text"]).join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")
    sized = bounded_sample(rows.select("text", "toxic"), "toxic", "text", max_docs, max_bytes, seed=2)
    texts = sized.groupBy("text", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    return written(texts.repartition(shuffle_parts(docs.sparkSession)), "toxicity-sample")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of words with the number of texts of either class that have it."""
    for batch in batches:
        for rows in row_groups(batch):
            words = _words(rows)
            before, text = _before(words), _texts(words)
            pair = _pair(before, words.hashes)
            _, once = np.unique(_in_text(pair, text), return_index=True)
            _, first, unit = np.unique(pair[once], return_index=True, return_inverse=True)
            toxic = rows.column("toxic").to_numpy()[text[once]]
            n = [np.bincount(unit[toxic == c], minlength=len(first)).astype(np.int32) for c in (0, 1)]
            columns = [x[once[first]].view(np.int64) for x in (before, words.hashes)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, [*columns, *n])], names=["before", "word", "n0", "n1"])


def _stems_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in row_groups(batch):
            words = _words(rows)
            keys, at = np.unique(words.hashes, return_index=True)
            columns = [pa.array(x.view(np.int64)) for x in (keys, _stems(words)[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "stem"])


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of a count of 0, 1, 2 and more; too few counts have 0.75 for each.

    None takes a count whole, or nothing.
    """
    once, twice, thrice, more = (float((n == k).sum()) for k in (1, 2, 3, 4))
    if not (once and twice and thrice and more):
        return np.array([0, 0.75, 0.75, 0.75])
    y = once / (once + 2 * twice)
    own = [1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * more / thrice]
    return np.array([0, *np.clip(own, 0.1, [0.95, 1.9, 2.85])])


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place among them of each key."""
    distinct = np.sort(keys)
    distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])[: len(keys)]]
    place = np.empty(len(keys), np.int32)
    for at in range(0, len(keys), 1 << 18):
        place[at : at + (1 << 18)] = np.searchsorted(distinct, keys[at : at + (1 << 18)])
    return distinct, place


def _off(off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What is taken off counts; a row for each class, with its own discounts."""
    return np.take_along_axis(off, np.minimum(n, 3).reshape(len(off), -1), axis=1)


def _continued(keys: np.ndarray, n: np.ndarray) -> Counts:
    """A table of continuation counts."""
    off = np.stack([_discounts(x) for x in n])
    return Counts(keys, n, off, n.sum(axis=1, dtype=float), np.array([d[np.minimum(x, 3)].sum() for d, x in zip(off, n)]))


def counts(sample: DataFrame) -> Model:
    """Both classes' models from (text, toxic).

    What comes to the driver is bounded by the sample: a row for each pair of words, and one for each word.
    """
    n0, n1 = (F.sum(c).cast("int").alias(c) for c in ("n0", "n1"))
    texts = sample.select("text", "toxic")
    rows = texts.mapInArrow(_stems_of_words, "word long, stem long").distinct().toArrow()
    known, stem = (rows[c].to_numpy().view(np.uint64) for c in ("word", "stem"))
    stem = stem[np.argsort(known)]
    rows = texts.mapInArrow(_pairs, "before long, word long, n0 int, n1 int").groupBy("before", "word").agg(n0, n1).toArrow()
    before, word = (rows[c].to_numpy().view(np.uint64) for c in ("before", "word"))
    n = [rows[c].to_numpy() for c in ("n0", "n1")]
    del rows
    pa.default_memory_pool().release_unused()
    keys = _pair(before, word)
    # From here on, one array of the pairs' length is made at a time.
    histories, after = _numbered(before)
    del before
    vocabulary, of_word = _numbered(word)
    del word
    n.append(n[0] + n[1])
    off = np.stack([_discounts(x) for x in n])
    added = lambda group, rows, size: np.stack([np.bincount(group, x, size) for x in rows])
    sums = added(after, n[:2], len(histories)).astype(np.int32)
    left = added(after, (d[np.minimum(x, 3)] for d, x in zip(off, n)), len(histories))
    follows = added(of_word, (x > 0 for x in n[:2]), len(vocabulary)).astype(np.int32)
    stems, first, group, kinds = np.unique(stem, return_index=True, return_inverse=True, return_counts=True)
    kinds = kinds + (stems != _short(vocabulary[first]))
    by_stem = added(group, follows, len(stems)).astype(np.int32)
    model = Model(
        Counts(keys, np.zeros((2, 0), np.int32), off), Counts(histories, sums, np.zeros((2, 4))), left.astype(np.float32),
        left.astype(np.float32), _continued(vocabulary, follows), _continued(stems, by_stem), kinds,
    )
    fitting = _adapted(model, _word_chances(model, vocabulary, stem))
    norm = left[2] + added(after, ((n[2] - off[2][np.minimum(n[2], 3)]) * x[of_word] for x in fitting), len(histories))
    del after, of_word
    order = np.argsort(keys)
    pairs = Counts(keys[order], np.stack([x[order] for x in n[:2]]), off)
    return model._replace(pairs=pairs, norm=norm.astype(np.float32))


def _level(
    table: Counts, keys: np.ndarray, base: np.ndarray, text: np.ndarray | None = None, lost: np.ndarray | None = None
) -> np.ndarray:
    """Chances of words or stems by continuation counts, a row for each class; what is taken off goes to ``base``.

    ``lost`` is by how much each key's count is less without its text; it is summed over the text.
    """
    n = table.look(keys)
    total, left = table.total[:, None], table.left[:, None]
    if lost is not None:
        _, one, group = np.unique(_in_text(keys, text), return_index=True, return_inverse=True)
        less = np.stack([np.bincount(group, x, len(one)) for x in lost]).astype(np.int64)
        were = n[:, one]
        change = _off(table.off, were) - _off(table.off, were - less)
        size = int(text.max(initial=-1)) + 1
        sums = lambda values, of: np.stack([np.bincount(of, v, size) for v in values])[:, text]
        n, total, left = n - less[:, group], total - sums(lost, text), left - sums(change, text[one])
    share = (n - _off(table.off, n) + left * base) / np.maximum(total, 1)
    return np.where(total > 0, share, base)


def _word_chances(
    model: Model, word: np.ndarray, stem: np.ndarray, text: np.ndarray | None = None, lost: np.ndarray | None = None
) -> np.ndarray:
    """Chances of words by themselves; a word not seen is one more of its stem, a stem not seen one more of all."""
    place, known = model.stems.at(stem)
    kinds = np.where(known, model.kinds[place], 1) if len(model.kinds) else 1
    every = np.full((2, len(stem)), 1 / (1 + len(model.stems.keys)))
    return _level(model.words, word, _level(model.stems, stem, every, text, lost) / kinds, text, lost)


def _adapted(model: Model, of_word: np.ndarray) -> np.ndarray:
    """A word's chances in the classes over that in both together."""
    weight = model.words.total / max(1, model.words.total.sum())
    return of_word / np.maximum(weight @ of_word, 1e-300)


def chances(
    model: Model, before: np.ndarray, word: np.ndarray, stem: np.ndarray, text: np.ndarray, own: np.ndarray | None = None
) -> np.ndarray:
    """Chance of each word after the one before it, a row for each class.

    With the class of each word's text as ``own``, the counts are those without that text; then no pair may
    come twice in a text. The discounts, the known words and what other pairs add to the norm stay.
    """
    n = model.pairs.look(_pair(before, word))
    place, there = model.before.at(before)
    none = not len(model.before.keys)
    held = lambda table: np.zeros((len(table), len(word))) if none else np.where(there, table[:, place], 0).astype(float)
    sums, left, norm = held(model.before.n), held(model.left), held(model.norm)
    both = lambda x: np.concatenate([x, x.sum(axis=0, keepdims=True)])
    n, sums, lost = both(n), both(sums), None
    if own is not None:
        less = np.stack([(own == c) & (n[c] > 0) for c in (0, 1)]).astype(np.int64)
        lost, less = less * (n[:2] == 1), both(less)
    of_word = _word_chances(model, word, stem, text, lost)
    seen, fitting = n - _off(model.pairs.off, n), _adapted(model, of_word)
    if own is not None:
        _, group = np.unique(_in_text(before, text), return_inverse=True)
        added = lambda values: np.stack([np.bincount(group, v) for v in values])[:, group]
        rest = n - less - _off(model.pairs.off, n - less)
        gone = less - (seen - rest)
        norm = norm - added(gone[2] + seen[2] * _adapted(model, _word_chances(model, word, stem)) - rest[2] * fitting)
        seen, sums, left = rest, sums - added(less), left - added(gone)
    # A word that nothing else follows has exactly no pairs left, but its sums of fractions may be off by a little.
    common = np.where(sums[2] > 0, (seen[2] * fitting + left[2] * of_word) / np.where(sums[2] > 0, norm, 1), of_word)
    return (seen[:2] + (left[:2] + STRENGTH) * common) / (sums[:2] + STRENGTH)


def _log_ratios(words: Words, model: Model, toxic: np.ndarray | None = None) -> np.ndarray:
    """Of each word, the logarithm of its chance in the toxic class over that in the other; see :func:`chances`."""
    before, text = _before(words), _texts(words)
    pair = _pair(before, words.hashes)
    _, at, unit = np.unique(pair if toxic is None else _in_text(pair, text), return_index=True, return_inverse=True)
    own = None if toxic is None else toxic[text[at]]
    clean, bad = chances(model, before[at], words.hashes[at], _stems(words)[at], text[at], own)
    return np.log(bad / clean)[unit]


def _means(words: Words, ratio: np.ndarray, share: float) -> np.ndarray:
    """Mean per word of the logarithm of the mixture's chance over the other class's; 0 without words."""
    gain = np.log1p(share * np.expm1(ratio))
    return np.bincount(_texts(words), gain, len(words.counts)) / np.maximum(words.counts, 1)


def _level_of(curve: tuple[float, float, float], mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.clip(curve[0] + curve[1] * mean + curve[2] * mean * np.sqrt(n), -30, 30)


def _curve(mean: np.ndarray, n: np.ndarray, toxic: np.ndarray, copies: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; a text weighs as much as its copies."""
    x = np.stack([np.ones(len(mean)), mean, mean * np.sqrt(n)], axis=1)
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, w = x / scale, np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (copies * (p - toxic)) + 0.01 * w
        w -= np.linalg.solve((z * (copies * (p * (1 - p) + 1e-6))[:, None]).T @ z + 0.01 * np.eye(3), slope)
    return tuple(w / scale)


def ratios(sample: DataFrame) -> DataFrame:
    """(unit, ratio) of the words and stems that tell the classes apart, to look at; no score depends on it.

    The ratio is that of the continuation counts' chances; it is listed if the counts differ by a significance test.
    """
    model = counts(sample)
    units, found = [], []
    stem_base = np.full((2, len(model.stems.keys)), 1 / (1 + len(model.stems.keys)))
    for table, base in ((model.words, 1 / (1 + len(model.words.keys))), (model.stems, stem_base)):
        total = np.maximum(table.total, 1)
        both, share = table.n.sum(axis=0), total[1] / total.sum()
        spread = both * share * (1 - share)
        off = np.maximum(np.abs(table.n[1] - both * share) - 0.5, 0)
        chance = _level(table, table.keys, base)
        ratio = np.log(chance[1] / chance[0])
        telling = (off * off > ERRORS**2 * (spread + 1)) & (np.abs(ratio) > LEAST_RATIO)
        units.append(table.keys[telling].view(np.int64))
        found.append(ratio[telling])
    columns = pa.table({"unit": np.concatenate(units), "ratio": np.concatenate(found)})
    return sample.sparkSession.createDataFrame(columns, "unit long, ratio double")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS, max_bytes: int = FIT_BYTES) -> Fitted:
    """Fit on (doc_id, text) and (doc_id, toxic).

    At most about ``max_docs`` documents and ``max_bytes`` of text of each class are used, picked by hash,
    whole. What comes to the driver is bounded by that sample: its pairs of words and one row a text.
    """
    sample = _sample(docs, labels, max_docs, max_bytes)
    classes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    broadcast = sample.sparkSession.sparkContext.broadcast
    if len(classes) < 2:
        return Fitted(broadcast(counts(sample.limit(0))), SHARES[0], (30.0 if 1 in classes else -30.0, 0.0, 0.0))
    shared = broadcast(counts(sample))

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, limit=AT_ONCE):
                words = _words(rows)
                ratio = _log_ratios(words, shared.value, rows.column("toxic").to_numpy())
                of_shares = [pa.array(_means(words, ratio, s)) for s in SHARES]
                yield pa.RecordBatch.from_arrays(
                    [*of_shares, pa.array(words.counts), rows.column("toxic"), rows.column("copies")],
                    names=[*names, "n", "toxic", "copies"],
                )

    names = [f"mean{i}" for i in range(len(SHARES))]
    fields = ", ".join(f"{x} double" for x in names)
    rows = sample.mapInArrow(means, f"{fields}, n long, toxic int, copies long").toArrow()
    n, toxic, copies = (rows[c].to_numpy().astype(float) for c in ("n", "toxic", "copies"))
    best = []
    for share, name in zip(SHARES, names):
        mean = rows[name].to_numpy()
        curve = _curve(mean, n, toxic, copies)
        level = _level_of(curve, mean, n)
        best.append((float((copies * np.logaddexp(0, np.where(toxic == 1, -level, level))).sum()), share, curve))
    _, share, curve = min(best)
    return Fitted(shared, share, curve)


def score(docs: DataFrame, model: Fitted, keep_text: bool = False) -> DataFrame:
    """``docs`` with _score and _predicted, without their text unless it is asked for; a null text is empty. Uses the text only."""
    names = [c for c in docs.columns if keep_text or c != "text"]
    shared, share, curve = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, limit=AT_ONCE):
                words = _words(rows)
                mean = _means(words, _log_ratios(words, shared.value), share)
                chance = 1 / (1 + np.exp(-_level_of(curve, mean, words.counts)))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in names], pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))],
                    names=[*names, "_score", "_predicted"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.mapInArrow(run, f"{fields}, _score double, _predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    Labels of documents whose id leaves remainder 0 modulo 5 are held out; a null id is neither held out
    nor learnt from. Labels other than 0 and 1 are ignored. With labels of one class only, every score
    is near that class; without any, near 0.
    """
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").filter(~held_out))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumnsRenamed({"_score": "score", "_predicted": "predicted"})


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that a model fitted on those of them with labels takes for toxic."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score(docs, model, keep_text=True).filter(F.col("_predicted") == 0).select(*docs.columns)
