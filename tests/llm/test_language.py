import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import remainder

from redressa.llm import language
from redressa.llm.common import table
from redressa.llm.words import words_of

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def brute(word: bytes, chance: dict[bytes, float]) -> float:
    """Sum over all segmentations, one by one."""
    return sum(p * brute(word[len(x):], chance) for x, p in chance.items() if word.startswith(x)) if word else 1.0


def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(VOCABULARY)
    rng = np.random.default_rng(3)
    chance = rng.dirichlet(np.ones(pieces.size), 2).T
    words = words_of(pa.array(["there of été", "Thing"]), lower=True)
    got = language.log_likelihood(pieces, chance, words, np.arange(4))
    names = {}
    for row in ("there of été thing".split()):
        data = f" {row}".encode()
        parts = {data[i:j] for i in range(len(data)) for j in range(i + 1, len(data) + 1)}
        for part in parts:
            one = np.frombuffer(part, np.uint8)
            at = np.flatnonzero(pieces.hashes == pieces.hash(one))
            if len(at):
                names[part] = pieces.ids[at[0]]
    for k in range(2):
        probability = {part: chance[i, k] for part, i in names.items()}
        want = [math.log(brute(f" {w}".encode(), probability)) for w in ("there", "of", "été", "thing")]
        assert np.allclose(got[:, k], want)


def test_long_words_are_summed_whole():
    """Words beyond the reach of a double, without spaces, and of several bytes a character, against sums of logarithms."""
    pieces = language.pieces_of(VOCABULARY)
    rng = np.random.default_rng(4)
    chance = rng.dirichlet(np.full(pieces.size, 0.3), 3).T + 1e-12
    texts = ["there" * 90, "東京都は日本の首都である" * 9, "x" * 500, "of", "internationalisation" * 3]
    words = words_of(pa.array([" ".join(texts)]), lower=True)
    got = language.log_likelihood(pieces, chance, words, np.arange(5))
    known = {int(h): i for h, i in zip(pieces.hashes, pieces.ids)}
    for n, text in enumerate(texts):
        data = np.frombuffer(f" {text}".encode(), np.uint8)
        total = np.full((len(data) + 1, 3), -np.inf)
        total[0] = 0
        for j in range(1, len(data) + 1):
            for i in range(max(0, j - pieces.longest), j):
                piece = known.get(int(pieces.hash(data[i:j])))
                if piece is not None:
                    total[j] = np.logaddexp(total[j], total[i] + np.log(chance[piece]))
        assert np.allclose(got[n], total[-1])


def test_expected_counts_weigh_pieces_by_their_share():
    pieces = language.pieces_of(VOCABULARY)
    chance = np.full((pieces.size, 1), 1 / pieces.size)
    words = words_of(pa.array(["of"]))
    used = language.expected_counts(pieces, chance, words, np.array([0]), np.array([0]), np.array([5]))
    lengths = used.sum()
    # Every segmentation covers the three bytes of " of" once.
    assert 5 <= lengths <= 15 and (used >= 0).all()


@pytest.fixture(scope="module")
def got(docs):
    return {(r.doc_id): r for r in language.identify(docs, VOCABULARY).collect()}


def test_rows_and_held_out(got, small_docs):
    assert set(got) == {r[0] for r in small_docs}
    assert all(r.held_out == (i is not None and remainder(i, 3) == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_letters_is_undetermined(got):
    for i in (900_001, 900_002, 900_003, 900_011):
        assert got[i].lang_pred == "und" and got[i].score == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in language.identify(table(spark, folder, "documents"), VOCABULARY).collect() if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows)
    assert len(rows) > 250 and right / len(rows) > 0.97


def test_empty_and_unlabelled(no_docs, docs):
    assert language.identify(no_docs, VOCABULARY).count() == 0
    from pyspark.sql import functions as F

    rows = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), VOCABULARY).collect()
    assert {r.lang_pred for r in rows} == {"und"}
