"""Token ids in Arrow files of equal-length sequences, and their random access.

A shard is an Arrow file (the stream format with a footer) whose batches hold two fixed-size lists per
row: ``ids`` and ``mask``. Every batch but the last has the same number of rows, so sequence ``i`` of a
shard is row ``i % rows`` of batch ``i // rows`` and its ids are a view into the mapped file. The
documents of a shard follow each other without gaps, in ascending order of their id; only the last
sequence of a shard is padded, where the mask is false. Beside it, ``.docs.arrow`` says where each document is.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.llm.words import row_groups
from redressa.session import work_folder

SEQUENCE, BATCH_ROWS, END_ID = 2048, 256, 1
#: Words whose ids a Python worker remembers; beyond it, it starts anew.
REMEMBERED = 1_000_000
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The shared folder may be a path or the address of a store."""
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class _Known(dict):
    """Codes of words; a word that is new is learned when it is looked up."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, word: bytes) -> int:
        return self.learn(word)


class WordEncoder:
    """Ids of texts; under a BPE whose pre-tokens never span white space, words are encoded once.

    The result is that of ``Tokenizer.encode`` on the whole text. Words of plain Latin letters, digits
    and marks go to the tokenizer's model directly; all others through the whole tokenizer. A vocabulary file
    whose normal form and split are not the ones that this relies on is used on whole texts.
    """

    #: The settings of a vocabulary file under which words can be encoded on their own.
    NORMAL_FORM = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
    WORD_SPLIT = [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}), ("ByteLevel", None)]
    #: The vocabulary's own split; white space is in none of its alternatives.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Characters whose lower case and form do not depend on their neighbours; no special token has a place here.
    PLAIN = regex.compile(r"[!-;=-~À-ÖØ-öø-įĲ-ž]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        steps = lambda part, name: [(x["type"], x.get("pattern")) for x in (part or {}).get(name, [])]
        self.by_word = (
            steps(told["normalizer"], "normalizers") == self.NORMAL_FORM and steps(told["pre_tokenizer"], "pretokenizers") == self.WORD_SPLIT
            and not told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] and not told["pre_tokenizer"]["pretokenizers"][1]["use_regex"]
            and not any(regex.search(r"\s", t["content"]) or self.PLAIN.fullmatch(t["content"]) for t in told["added_tokens"])
        )
        self.size = self.whole.get_vocab_size()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        spare = iter(range(256, 512))
        self.symbols = [chr(b) if b in kept else chr(next(spare)) for b in range(256)]
        self.clear()

    def clear(self) -> None:
        self.known = _Known(self._learn)
        self.starts, self.lengths, self.flat = array("q"), array("q"), array("I")

    def ids_of(self, word: str) -> list[int]:
        if not self.PLAIN.fullmatch(word):
            return self.whole.encode(word, add_special_tokens=False).ids
        out = []
        for piece in self.SPLIT.findall(unicodedata.normalize("NFC", word).lower()):
            symbols = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
            out += [token.id for token in self.whole.model.tokenize(symbols)]
        return out

    def _learn(self, word: bytes) -> int:
        ids = self.ids_of(word.decode())
        code = self.known[word] = len(self.lengths)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return code

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end_id``, and how many each has."""
        if not self.by_word:
            each = [x.ids + [end_id] for x in self.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            lengths = np.array([len(x) for x in each], np.int64)
            return np.fromiter(chain.from_iterable(each), np.uint32, lengths.sum()), lengths
        if len(self.known) > REMEMBERED:
            self.clear()
        if b"" not in self.known:  # stands for the end of a text
            self.known[b""] = len(self.lengths)
            self.starts.append(len(self.flat))
            self.lengths.append(1)
            self.flat.append(end_id)
        find, end, codes, words = self.known.__getitem__, self.known[b""], [], []
        for text in texts:
            before = len(codes)
            codes += map(find, (text or "").encode().split())
            codes.append(end)
            words.append(len(codes) - before)
        code = np.array(codes, np.int64)
        lengths, starts = np.array(self.lengths)[code], np.array(self.starts)[code]
        ends = np.cumsum(lengths)
        ids = np.array(self.flat, np.uint32)[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
        per_text = np.add.reduceat(lengths, np.cumsum([0, *words[:-1]]))
        return ids, per_text


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class _Writer:
    """Fills sequences and writes them in batches; renamed into place when whole, so a retry does no harm."""

    def __init__(self, folder: str, shard: int, kind: pa.DataType, length: int) -> None:
        self.fs, base = file_system(folder)
        self.final = f"{base}/shard-{shard:06d}"
        context = TaskContext.get()
        self.temp = f"{self.final}.attempt-{context.taskAttemptId() if context else 0}"
        self.kind, self.length, self.held, self.n = kind, length, [], 0
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(f"{self.temp}.arrow")
        self.writer = pa.ipc.new_file(self.out, schema)
        self.docs_out = self.fs.open_output_stream(f"{self.temp}.docs.arrow")
        self.docs = pa.ipc.new_file(self.docs_out, DOCS)
        self.tokens = self.n_docs = 0

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.writer_schema))

    @property
    def writer_schema(self) -> pa.Schema:
        return pa.schema([("ids", pa.list_(self.kind, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.tokens + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=DOCS))
        self.tokens += len(ids)
        self.n_docs += len(counts)
        ids = np.concatenate([*self.held, ids.astype(self.kind.to_pandas_dtype())])
        full = self.length * BATCH_ROWS
        for lo in range(0, len(ids) // full * full, full):
            self._batch(ids[lo : lo + full], np.ones(full, bool))
        self.held = [ids[len(ids) // full * full :]]

    def close(self) -> str:
        rest = np.concatenate(self.held) if self.held else np.zeros(0)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind.to_pandas_dtype())
            padded[: len(rest)] = rest
            self._batch(padded, np.arange(len(padded)) < len(rest))
        for writer, out, end in ((self.writer, self.out, ".arrow"), (self.docs, self.docs_out, ".docs.arrow")):
            writer.close()
            out.close()
            self.fs.move(f"{self.temp}{end}", f"{self.final}{end}")
        return self.final


class SequenceFile:
    """Sequences of one shard by number, and any run of its tokens, as views of the mapped file where one row holds them."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        local = isinstance(files, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.reader.get_batch(i // self.rows).columns
        at = i % self.rows
        return ids[at].values.to_numpy(), mask[at].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        span, parts = self.rows * self.length, []
        while n > 0:
            batch = self.reader.get_batch(start // span)
            at = start % span
            take = min(n, batch.num_rows * self.length - at)
            parts.append(batch.column(0).values.to_numpy()[at : at + take])
            start, n = start + take, n - take
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str, length: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """Encode (doc_id, text) into shards under ``folder``; the manifest: one row (shard, path, n_docs, n_tokens) each.

    Documents are range-partitioned and sorted by doc_id (null first, repeated ids by a hash of the
    text); a null text is empty, so it has the end id only. Ids take 16 bits where the vocabulary
    allows. A task streams through its shard with one batch of sequences in memory.
    """
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    kind = pa.uint16() if encoder(vocabulary).size <= 1 << 16 and end_id < 1 << 16 else pa.uint32()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for rows in row_groups(batch):
                writer = writer or _Writer(folder, shard, kind, length)
                ids, counts = encoder(vocabulary).encode(rows.column("text").to_pylist(), end_id)
                writer.add(rows.column("doc_id"), ids, counts)
        if writer:
            path = writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": path, "n_docs": writer.n_docs, "n_tokens": writer.tokens}],
                schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document out of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = SequenceFile(files, f"{row['path']}.arrow")
                index = pa.ipc.open_file(files.open_input_file(f"{row['path']}.docs.arrow"))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, counts = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    sums = [
                        zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array(starts + row["before"]), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One row per shard: the tokens before it are a running sum over the manifest.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    # As many tasks as shards, for the reading that follows.
    spread = placed.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write the documents' ids and return what the files hold."""
    folder = folder or work_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder), folder)
