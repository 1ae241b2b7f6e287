import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from redressa.llm import token_files
from redressa.session import work_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def expected(small_docs):
    """doc_id order with null first; the odd rows hold no equal ids of different texts."""
    whole, rows, at = Tokenizer.from_file(VOCABULARY), [], 0
    for doc_id, text, _ in sorted(small_docs, key=lambda r: (r[0] is not None, r[0])):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        rows.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return rows


def test_round_trip(docs, expected):
    got = token_files.token_output(docs, VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_sequences_are_views(spark, docs, expected):
    folder = work_folder(spark, "test-tokens")
    manifest = token_files.write_tokens(docs, VOCABULARY, folder, length=64).orderBy("shard").collect()
    files, _ = token_files.file_system(folder)
    tokens = sum(r.n_tokens for r in manifest)
    assert tokens == expected[-1][1] + expected[-1][2] and sum(r.n_docs for r in manifest) == len(expected)
    shard = token_files.SequenceFile(files, f"{manifest[0].path}.arrow")
    stream = shard.tokens(0, manifest[0].n_tokens)
    ids, mask = shard.sequence(3)
    assert list(ids) == list(stream[192:256]) and mask.all() and not ids.flags.owndata and ids.dtype == np.uint16
    last, mask = shard.sequence((manifest[0].n_tokens - 1) // 64)
    assert mask.sum() == (manifest[0].n_tokens - 1) % 64 + 1 and not last[~mask].any()


def test_words_encode_as_in_whole_texts(small_docs):
    own, whole = token_files.WordEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    strange = "".join(map(chr, [*range(1, 0x250), 0x1C4, 0x3A3, 0x130, 0x2028, 0x3000, 0x1F600]))
    for text in [strange, " ".join(strange), "a'll B'S 'tis ''re x's9", "<|startoftext|>a<|endoftext|>", *[t for _, t, _ in small_docs[:60]]]:
        ids, counts = own.encode([text], 1)
        assert list(ids[:-1]) == whole.encode(text, add_special_tokens=False).ids and counts[0] == len(ids)


def test_another_vocabulary(spark, small_docs):
    """Settings under which words cannot be encoded on their own: whole texts are."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, whole = token_files.WordEncoder(path), Tokenizer.from_file(path)
    assert not own.by_word and token_files.WordEncoder(VOCABULARY).by_word
    texts = [t for _, t, _ in small_docs[:40]] + ["", None, "  two  spaces\n"]
    ids, counts = own.encode(texts, 7)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    assert list(ids) == [i for x in want for i in x] and list(counts) == [len(x) for x in want]


def test_empty(no_docs):
    assert token_files.token_output(no_docs, VOCABULARY).count() == 0


def test_batches_of_equal_rows(spark, docs):
    folder = work_folder(spark, "test-tokens")
    row = token_files.write_tokens(docs.coalesce(1), VOCABULARY, folder, length=16).first()
    reader = pa.ipc.open_file(token_files.file_system(folder)[0].open_input_file(f"{row.path}.arrow"))
    sizes = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
    assert set(sizes[:-1]) <= {token_files.BATCH_ROWS} and sizes[-1] <= token_files.BATCH_ROWS


def test_words_of_many_texts_are_learned_once(monkeypatch):
    own, asked = token_files.WordEncoder(VOCABULARY), []
    monkeypatch.setattr(own, "ids_of", lambda word: asked.append(word) or [len(word), 9])
    text = " ".join(f"w{i}" for i in range(450_000))
    for given in ([text], ["w1 new new", None]):
        ids, counts = own.encode(given, 1)
    assert len(asked) == len(set(asked)) == 450_001
    assert list(ids) == [2, 9, 3, 9, 3, 9, 1, 1] and list(counts) == [7, 1]
