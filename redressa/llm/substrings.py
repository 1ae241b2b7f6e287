"""Repeated passages of words, found from fixed blocks and removed.

Every text is cut into non-overlapping blocks of words, which are indexed; every rolling window of the
block's length is a probe. A block is a hit if another place has its words. A repeated passage of twice
the block less one, or more, holds a whole block wherever it stands, so hits find all of them. Hits are
extended to the passages of the full length around them, and those that occur again, merged, are the
maximal repeats. Texts are dealt into groups by id; between groups go sorted arrays of hashes, dealt by
hash, at most two of a kind from each group, and back come places within the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import shuffle_parts
from redressa.llm.words import BASE_B, Words, rolling, words_of

WINDOW = 35
#: Groups of texts for each shuffle partition.
GROUPS = 4
_HASHES = "bucket int, grp int, probes binary, anchors binary, places binary"
_PLACES = "grp int, places binary"
_PRINTS = "bucket int, grp int, wide binary, narrow binary, places binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,stop:long>>"


def _ordered(docs: pa.Table) -> pa.Table:
    """The texts of a group in an order that any task finds again; equal rows may change places."""
    return docs.sort_by([("doc_id", "ascending"), ("tag", "ascending")]).combine_chunks()


def _words(docs: pa.Table) -> Words:
    column = docs["text"]
    return words_of(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))


def _windows(words: Words, size: int, base: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows, first word of those that lie in one text)."""
    hashes = rolling(words.hashes, size, base) if base else rolling(words.hashes, size)
    return hashes, np.flatnonzero(np.arange(len(hashes)) + size <= words.stop[: len(hashes)])


def _bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ascending with the hash, so that sorted hashes are cut into runs."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _runs(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    edges = np.flatnonzero(np.diff(buckets, prepend=np.uint64(1 << 63)))
    return [(int(buckets[lo]), lo, hi) for lo, hi in zip(edges, [*edges[1:], len(buckets)])]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [tuple(x.split()) for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _probe(block: int, parts: int):
    def run(docs: pa.Table) -> pa.Table:
        """Blocks and probes of a group, by bucket."""
        group, words = docs["grp"][0].as_py(), _words(_ordered(docs))
        hashes, at = _windows(words, block)
        probes = np.sort(hashes[at])
        if len(probes) > 2:
            probes = probes[np.concatenate([[True, True], probes[2:] != probes[:-2]])]
        begin = np.repeat(words.first[:-1], words.counts)
        anchors = at[(at - begin[at]) % block == 0]
        anchors = anchors[np.argsort(hashes[anchors], kind="stable")]
        held = hashes[anchors]
        own = {b: (lo, hi) for b, lo, hi in _runs(_bucket(held, parts))}
        rows = []
        for bucket, lo, hi in _runs(_bucket(probes, parts)):
            a, z = own.get(bucket, (0, 0))
            rows.append((
                bucket, group, probes[lo:hi].astype(np.uint32).tobytes(), held[a:z].astype(np.uint32).tobytes(),
                anchors[a:z].astype(np.uint32).tobytes(),
            ))
        return _table(rows, _HASHES)

    return run


def _hits(bucket: pa.Table) -> pa.Table:
    """Of each group, the blocks whose hash more than one probe has. A chance hit costs work, no more."""
    probes = np.sort(_joined(bucket["probes"], np.uint32))
    repeated = np.unique(probes[1:][probes[1:] == probes[:-1]])
    rows = []
    if len(repeated):
        for group, anchors, places in zip(bucket["grp"].to_pylist(), bucket["anchors"], bucket["places"]):
            held = np.frombuffer(anchors.as_buffer(), np.uint32)
            same = repeated[np.minimum(np.searchsorted(repeated, held), len(repeated) - 1)] == held
            if same.any():
                rows.append((group, np.frombuffer(places.as_buffer(), np.uint32)[same].tobytes()))
    return _table(rows, _PLACES)


def _extend(block: int, window: int, parts: int):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        """Fingerprints of the windows around the hits of a group, once each, by bucket."""
        if not (len(docs) and len(hits)):
            return _table([], _PRINTS)
        group, words = docs["grp"][0].as_py(), _words(_ordered(docs))
        wide, at = _windows(words, window)
        whole = np.zeros(len(wide), bool)
        whole[at] = True
        places = _joined(hits["places"], np.uint32).astype(np.int64)
        starts = (places[:, None] - np.arange(window - block + 1)).ravel()
        starts = starts[(starts >= 0) & (starts < len(wide))]
        starts = np.unique(starts[whole[starts]])
        wide, first = np.unique(wide[starts], return_index=True)
        starts = starts[first]
        narrow = rolling(words.hashes, window, BASE_B)[starts].astype(np.uint32)
        return _table([
            (b, group, wide[lo:hi].tobytes(), narrow[lo:hi].tobytes(), starts[lo:hi].astype(np.uint32).tobytes())
            for b, lo, hi in _runs(_bucket(wide, parts))
        ], _PRINTS)

    return run


def _repeats(bucket: pa.Table) -> pa.Table:
    """Of each group, the windows whose fingerprint another group has too."""
    wide, narrow = _joined(bucket["wide"], np.uint64), _joined(bucket["narrow"], np.uint32)
    order = np.lexsort((narrow, wide))
    same = (wide[order][1:] == wide[order][:-1]) & (narrow[order][1:] == narrow[order][:-1])
    again = np.zeros(len(wide), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    rows, at = [], 0
    for group, places in zip(bucket["grp"].to_pylist(), bucket["places"]):
        held = np.frombuffer(places.as_buffer(), np.uint32)
        mine = again[at : at + len(held)]
        at += len(held)
        if mine.any():
            rows.append((group, held[mine].tobytes()))
    return _table(rows, _PLACES)


def _cut(window: int):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        """Every text of a group without its repeated passages."""
        docs = _ordered(docs)
        words = _words(docs)
        hashes, at = _windows(words, window)
        own, times = np.unique(hashes[at], return_counts=True)
        places = _joined(repeats["places"], np.uint32)
        known = np.union1d(own[times > 1], hashes[places])
        starts = at[np.isin(hashes[at], known)]
        change = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        removed = np.cumsum(change[:-1]) > 0
        texts, spans, gone = [], [], []
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            out = removed[lo:hi]
            gone.append(int(out.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).reshape(-1, 2)
            spans.append([{"start": a, "stop": z} for a, z in edges.tolist()])
            kept = np.flatnonzero(~out) + lo
            texts.append(b" ".join([words.data[a:z].tobytes() for a, z in zip(words.starts[kept], words.ends[kept])]).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({
            "doc_id": docs["doc_id"], "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "kept_text": pa.array(texts, pa.string()), "spans": pa.array(spans, span),
        })

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, groups: int | None = None) -> DataFrame:
    """Texts without the words of any passage of ``window`` words that also starts elsewhere.

    Result: doc_id, n_words, n_removed, kept_text (words joined by one space), spans (removed words, as
    first and last plus one). Words are runs of bytes other than space and 9 to 13. All occurrences go,
    judged on the input. A null text has no words; every row is a text, also those that repeat an id
    or have none. Passages are compared by 96 bits of two rolling hashes.
    """
    block = (window + 1) // 2
    parts = shuffle_parts(docs.sparkSession)
    groups = groups or GROUPS * parts
    tag = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), tag.alias("tag"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(groups)).cast("int"))
    # The texts are shuffled once: all three steps over them read the same exchange.
    by_group = rows.groupBy("grp")
    probed = by_group.applyInArrow(_probe(block, parts), _HASHES)
    hits = probed.groupBy("bucket").applyInArrow(_hits, _PLACES)
    prints = by_group.cogroup(hits.groupBy("grp")).applyInArrow(_extend(block, window, parts), _PRINTS)
    repeats = prints.groupBy("bucket").applyInArrow(_repeats, _PLACES)
    return by_group.cogroup(repeats.groupBy("grp")).applyInArrow(_cut(window), _RESULT)
