"""Near-duplicate texts by b-bit MinHash, confirmed on whole shingle sets.

Bands of full minima give candidate groups. Of every minimum the lowest bits are packed into a short
signature, and the count of differing positions, corrected for chance agreement, estimates the
similarity of a candidate pair; pairs safely below the threshold end there. The rest is decided on the
whole sets. Equal sets are one class from the start. Only groups of a few are expanded into pairs. The members of
a larger one are compared with a leader, the one that shares most groups with others and so is nearest to
all. Texts found linked to the same one need not be compared with each other; the others of a leader's
groups are, in blocks that return links only as far as they join something new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.llm.links import components, local_components
from redressa.llm.words import Words, mix, rolling, row_groups, words_of

#: 32 bands of 4: two texts of similarity 0.8 miss each other in all bands once in twenty million, of 0.85 far less.
BANDS, BAND_ROWS, LOW_BITS = 32, 4, 4
HASHES = BANDS * BAND_ROWS
PLANES = HASHES // 64 * LOW_BITS
#: A pair is dropped on its estimate only so far below the threshold; six standard errors.
MARGIN = 0.2
#: Groups of at most so many are expanded; the side of a block, and the sets a term may be in to be counted pair by pair.
FEW, BLOCK, PAIRED = 8, 512, 6
_RANDOM = np.random.default_rng(20240229)
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_FOLD = _RANDOM.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct shingles; all its words as one if there are fewer than ``size``."""
    whole = rolling(words.hashes, size)
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        if hi - lo >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mix(rolling(words.hashes[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES x sets: the least value of each hash function; no set may be empty."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat((values ^ x) * m, starts) for x, m in zip(_XOR, _MUL)])


def signatures(least: np.ndarray) -> np.ndarray:
    """sets x PLANES: bit k of plane p holds bit p of minimum k, 64 minima a number."""
    planes = []
    for lo in range(0, HASHES, 64):
        for bit in range(LOW_BITS):
            bits = (least[lo : lo + 64] >> np.uint32(bit)) & np.uint32(1)
            planes.append((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64))
    return np.stack(planes, axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """sets x BANDS."""
    grouped = least.reshape(BANDS, BAND_ROWS, -1).astype(np.uint64)
    folded = (grouped * _FOLD[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]
    return mix(folded).T


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, limit=1 << 20):
                sets = shingle_sets(words_of(rows.column("text"), lower=True), size)
                full = [i for i, x in enumerate(sets) if len(x)]
                ids, planes, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    least = minima([sets[i] for i in full])
                    for i, s, k in zip(full, signatures(least).view(np.int64), band_keys(least).view(np.int64)):
                        ids[i], planes[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), s, k
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tag"), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(planes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "tag", "n_shingles", "set_id", "planes", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, limit=1 << 20):
                sets = shingle_sets(words_of(rows.column("text"), lower=True), size)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]),
                     pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["doc_id", "set_id", "shingles"],
                )

    return run


def _confirm(share: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                good.append(of * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: terms of few sets pair by pair, the others as a product of 0-1 matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, term, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(term, kind="stable")
    owner, first = owner[order], np.cumsum(times) - times
    both = np.zeros(n * n)
    for k in range(2, PAIRED + 1):
        start = first[times == k]
        for x in range(k):
            for y in range(k):
                both += np.bincount(owner[start + x] * n + owner[start + y], minlength=n * n) if len(start) else 0
    both = both.reshape(n, n)
    common = np.flatnonzero(times > PAIRED)
    for lo in range(0, len(common), 4096):
        some = common[lo : lo + 4096]
        held = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), times[some])
        within = np.arange(len(column)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
        held[owner[np.repeat(first[some], times[some]) + within], column] = 1
        both += held @ held.T
    return both


def _block_links(share: int, of: int):
    def run(block: pa.Table) -> pa.Table:
        """All pairs of a block on whole sets; the links that join its components."""
        node, label = block["node"].to_numpy(), block["label"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["shingles"].combine_chunks()]
        both, sizes = _shared_counts(sets), np.array([len(x) for x in sets])
        linked = of * both >= share * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(np.triu(linked, 1))
        _, first, known = np.unique(label, return_index=True, return_inverse=True)
        apart = known[a] != known[b]
        a, b = a[apart], b[apart]  # what has one label is joined already
        root = local_components(len(sets), np.concatenate([a, np.arange(len(sets))]), np.concatenate([b, first[known]]))
        new = np.flatnonzero(root != np.arange(len(sets))) if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": node[new], "b": node[root[new]]})

    return run


def _blocks(live: DataFrame) -> DataFrame:
    """(grp, kind, i, j, node, label): the blocks in which a node meets others of its group.

    ``main`` marks the texts that go with the leader. They need not meet each other: blocks hold a part of
    the rest and a part of the main ones (kind 0), or two parts of the rest (kind 1).
    """
    sizes = live.groupBy("grp").agg(
        F.ceil(F.sum((~F.col("main")).cast("int")) / BLOCK).cast("long").alias("rest_parts"),
        F.ceil(F.sum(F.col("main").cast("int")) / BLOCK).cast("long").alias("main_parts"),
    )
    rows = live.join(sizes, "grp").filter("rest_parts > 0")
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("main"), F.col("main_parts")).otherwise(F.col("rest_parts")))
    zero = F.lit(0).cast("long")
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    rest, main = F.sequence(zero, F.col("rest_parts") - 1), F.sequence(zero, F.col("main_parts") - 1)
    of_main = F.transform(rest, lambda i: place(0, i, F.col("own")))
    of_rest = F.concat(
        F.transform(main, lambda j: place(0, F.col("own"), j)),
        F.transform(rest, lambda j: place(1, F.least("own", j), F.greatest("own", j))),
    )
    placed = rows.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("main"), of_main).otherwise(of_rest)))
    return placed.select("grp", "at.*", "node", "label")


def _estimate(a: str, b: str) -> F.Column:
    """Similarity from the agreement of low bits: agreement by chance is 2**-LOW_BITS."""
    apart = F.lit(0)
    for lo in range(0, PLANES, LOW_BITS):
        differ = F.lit(0).cast("long")
        for p in range(lo, lo + LOW_BITS):
            differ = differ.bitwiseOR(F.element_at(a, p + 1).bitwiseXOR(F.element_at(b, p + 1)))
        apart = apart + F.bit_count(differ)
    chance = 2.0**-LOW_BITS
    return (1 - apart / HASHES - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, of: int = 100) -> DataFrame:
    """Components of texts linked when ``of * intersection >= share * union``.

    Result: doc_id, n_shingles, component_id, kept, tag (a hash of the text).

    Words are runs of bytes other than space and 9 to 13, A-Z folded. Null, empty and blank texts have no
    shingles and link with nothing. Every row is a document; rows of one id and text are copies of each
    other. A row without id takes part and is kept only if nothing it is linked with has an id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    kinds = "doc_id long, tag long, n_shingles long, set_id binary, planes array<long>, bands array<long>"
    described = written(rows.mapInArrow(_describe(words), kinds), "shingle-signatures")
    classes = described.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"),
        F.any_value("planes").alias("planes"), F.any_value("bands").alias("bands"),
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = written(banded.join(crowded, "key"), "shingle-groups")
    central = groups.groupBy("node").agg(F.sum("n").alias("central"))
    candidates = written(classes.join(central, "node").select("node", "rep", "set_id", "n", "planes", "central"), "shingle-candidates")
    # Always by a shuffle: the ids grow with the texts, so a small input should not be planned differently.
    wanted = candidates.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = rows.join(wanted, "doc_id", "left_semi")
    found = texts.unionByName(rows.filter("doc_id is null")).mapInArrow(_sets(words), "doc_id long, set_id binary, shingles binary")
    sets = written(
        found.join(candidates.select("node", "set_id"), "set_id").groupBy("node").agg(F.any_value("shingles").alias("shingles")),
        "shingle-sets",
    )

    def links_of(pairs: DataFrame) -> DataFrame:
        side = lambda x: candidates.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("planes").alias(f"p_{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(
            (of * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")) & (_estimate("p_a", "p_b") >= share / of - MARGIN)
        ).select("a", "b")
        whole = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = near.join(whole("a"), "a").join(whole("b"), "b")
        return both.mapInArrow(_confirm(share, of), "a long, b long")

    def central_first(pairs: DataFrame) -> DataFrame:
        """Each pair once, the more central text as ``a``."""
        order = candidates.select("node", F.struct("central", "node").alias("at"))
        both = pairs.filter("a != b").join(order.withColumnsRenamed({"node": "a", "at": "at_a"}), "a").join(
            order.withColumnsRenamed({"node": "b", "at": "at_b"}), "b"
        )
        low, high = F.least("at_a", "at_b"), F.greatest("at_a", "at_b")
        return both.select(high["node"].alias("a"), low["node"].alias("b"))

    def labelled(table: DataFrame, links: DataFrame) -> DataFrame:
        """``table`` with the most central text that its node, or the one it is linked to, is linked to."""
        named = links.join(candidates.select(F.col("node").alias("a"), "central"), "a")
        label = named.groupBy("b").agg(F.max(F.struct("central", "a")).alias("top")).select("b", F.col("top.a").alias("label"))
        label = written(label, "shingle-labels")
        above = label.select(F.col("b").alias("label"), F.col("label").alias("above"))
        jumped = label.join(above, "label", "left").select(F.col("b").alias("node"), F.coalesce("above", "label").alias("label"))
        return table.join(jumped, "node", "left").withColumn("label", F.coalesce("label", "node"))

    few = groups.filter(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("node").alias("m"))  # at most FEW
    every = F.flatten(F.transform("m", lambda x: F.transform("m", lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = few.select(F.explode(every).alias("p")).select("p.*")
    large = groups.filter(F.col("n") > FEW).select("key", "node").join(candidates.select("node", "central"), "node")
    leaders = large.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top")).select("key", F.col("top.node").alias("a"))
    led = written(large.join(leaders, "key").select("key", "a", "node"), "shingle-led")
    found = led.select("a", F.col("node").alias("b")).distinct().unionByName(pairs)
    links = written(links_of(central_first(found).distinct()), "shingle-links")
    after = written(labelled(led, links), "shingle-labelled")
    # Groups whose members all go with one text are done with; those of one leader are one group from here on.
    several = after.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    live = after.join(several.select("key"), "key").groupBy(F.col("a").alias("grp"), "node").agg(F.max("label").alias("label"))
    own = live.filter("node = grp").select("grp", F.col("label").alias("main"))
    live = written(live.join(own, "grp").withColumn("main", F.col("label") == F.col("main")), "shingle-live")
    if not live.isEmpty():
        blocks = _blocks(live).join(sets, "node").groupBy("grp", "kind", "i", "j")
        links = links.unionByName(blocks.applyInArrow(_block_links(share, of), "a long, b long"))
    roots = components(links)

    named = classes.select("node", "rep", "set_id").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    lowest = named.groupBy("comp").agg(F.min("rep").alias("component"))
    known = named.join(lowest, "comp").select("set_id", "component")
    component = F.coalesce("component", "doc_id")
    return described.select("doc_id", "tag", "n_shingles", "set_id").join(known, "set_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "tag",
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, of: int = 100) -> DataFrame:
    """One document of each component of :func:`near_duplicates`, the one with the smallest id; one of equal rows.

    Documents without id stay if nothing they are linked with has an id, one for each text.
    """
    found = near_duplicates(docs, words, share, of).filter("kept")
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id")]
    kept = written(found.groupBy(*key, F.col("tag").alias("_tag")).agg(F.count(F.lit(1)).alias("_rows")), "near-kept")
    rows = docs.select(*docs.columns, *key, F.xxhash64("text").alias("_tag")).join(kept, ["_id", "_no_id", "_tag"])
    if not kept.filter("_rows > 1").isEmpty():
        rows = rows.filter("_rows = 1").unionByName(rows.filter("_rows > 1").dropDuplicates(["_id", "_no_id", "_tag"]))
    return rows.select(*docs.columns)
