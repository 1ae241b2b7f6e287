"""Exact top-k by inner product over a bit-sliced index.

Components are whole numbers. A block of rows keeps, for every component (attribute), its highest bits as
slices: one bitmap per bit, in which row i is bit i. A query's score is a weighted sum of attributes; with
the weights in binary it is a sum of slices, each worth a power of two. Slices of one worth are added by
bitmap arithmetic (three bitmaps become their sum and their carry), so all rows of a block are scored at
once, and the score is itself bit-sliced. From its most significant slice downward the rows that are
surely among the best are told from those still level, which gives the k-th score. The bits that the
index leaves out can add at most a known amount, so the rows within that reach of the k-th score are the
boundary; they, and only they, are scored with all bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.operators.lookup import lookup_join

#: Slices kept of every attribute, rows and numbers of a block of the index, queries of a group.
SLICES, BLOCK_ROWS, BLOCK_NUMBERS, GROUP = 6, 1 << 14, 1 << 20, 1024
#: Larger whole numbers could leave the range of a score.
MOST = 1 << 24
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as bitmaps of 64-bit words; the last word is filled with zeros."""
    width = -(-bits.shape[-1] // 64) * 8
    packed = np.packbits(bits.astype(bool), axis=-1, bitorder="little")
    out = np.zeros((*bits.shape[:-1], width), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


def sliced(values: np.ndarray, slices: int = SLICES) -> tuple[np.ndarray, int]:
    """(attribute, slice, word): the ``slices`` highest bits of each attribute above its least value, and how many bits are left out."""
    above = values - values.min(axis=0)
    shift = max(0, int(above.max(initial=0)).bit_length() - slices)
    high = (above >> shift).T
    return bitmaps(high[:, None, :] >> np.arange(slices)[None, :, None] & 1), shift


def weighted_sum(index: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum of weight x attribute, lowest first, up to a constant that is the same for all rows.

    A negative weight counts the complement of its attribute instead.
    """
    held = index ^ np.where(weights < 0, ALL, np.uint64(0))[:, None, None]
    size = np.abs(weights)
    chosen = [held[(size >> c & 1).astype(bool)] for c in range(int(size.max(initial=0)).bit_length())]
    worth: dict[int, list[np.ndarray]] = {}
    for c, part in enumerate(chosen):
        for b in range(index.shape[1]):
            if len(part):
                worth.setdefault(c + b, []).append(part[:, b])
    out, w = [], 0
    while worth:
        maps = np.concatenate(worth.pop(w)) if w in worth else np.zeros((1, index.shape[2]), np.uint64)
        while len(maps) > 1:
            n = len(maps) // 3
            if n:
                a, b, c = maps[:n], maps[n : 2 * n], maps[2 * n : 3 * n]
                odd = a ^ b
                carry, maps = (a & b) | (odd & c), np.concatenate([odd ^ c, maps[3 * n :]])
            else:
                carry, maps = maps[:1] & maps[1:], maps[:1] ^ maps[1:]
            worth.setdefault(w + 1, []).append(carry)
        out.append(maps[0])
        w += 1
    return out


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The ``k``-th largest value among ``rows`` (a bitmap of at least ``k``), from the highest slice downward."""
    sure, level, value = np.zeros_like(rows), rows, 0
    for s in reversed(slices):
        above = sure | (level & s)
        if int(np.bitwise_count(above).sum()) >= k:
            level, value = level & s, 2 * value + 1
        else:
            sure, level, value = above, level & ~s, 2 * value
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The ``rows`` whose value is ``value`` or more."""
    if value <= 0:
        return rows
    if value.bit_length() > len(slices):
        return np.zeros_like(rows)
    above, level = np.zeros_like(rows), rows
    for i in reversed(range(len(slices))):
        if value >> i & 1:
            level = level & slices[i]
        else:
            above, level = above | (level & slices[i]), level & ~slices[i]
    return above | level


def best_rows(index: np.ndarray, shift: int, values: np.ndarray, weights: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and exact scores of all rows that may be among the ``k`` best of the bitmap ``rows``."""
    if int(np.bitwise_count(rows).sum()) > k:
        total = weighted_sum(index, weights)
        reach = ((1 << shift) - 1) * int(np.abs(weights).sum()) >> shift
        rows = at_least(total, rows, kth_largest(total, rows, k) - reach) if total else rows
    found = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
    return found, values[found] @ weights


def _packed(table: pa.Table) -> dict:
    """Rows of one length side by side: ids with their nulls, row keys, and whole numbers."""
    ids, count = table["vec_id"].combine_chunks(), len(table)
    numbers = table["numbers"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "ids": ids.fill_null(0).to_numpy().astype(np.int64), "unnamed": ids.is_null().to_numpy(zero_copy_only=False),
        "keys": table["row"].to_numpy().astype(np.int64), "values": numbers.reshape(count, -1),
    }


_PACK = "dim long, block long, rows long, ids binary, unnamed binary, keys binary, numbers binary"


def _pack_row(table: pa.Table, packed: dict) -> dict:
    return {
        "dim": [table["dim"][0].as_py()], "block": [table["block"][0].as_py()], "rows": [len(table)],
        "ids": [packed["ids"].tobytes()], "unnamed": [packed["unnamed"].astype(np.uint8).tobytes()],
        "keys": [packed["keys"].tobytes()], "numbers": [packed["values"].astype(np.int32).tobytes()],
    }


_BINARY = {name: pa.binary() for name in ("ids", "unnamed", "keys", "numbers", "slices")}


def _arrow(columns: dict) -> pa.Table:
    return pa.table({name: pa.array(column, _BINARY.get(name, pa.int64())) for name, column in columns.items()})


def _index(slices: int):
    def run(table: pa.Table) -> pa.Table:
        packed = _packed(table)
        held, shift = sliced(packed["values"], slices)
        return _arrow(_pack_row(table, packed) | {"slices": [held.tobytes()], "shift": [shift]})

    return run


def _group(table: pa.Table) -> pa.Table:
    return _arrow(_pack_row(table, _packed(table)))


def _search(k: int, slices: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def unpack(table: pa.Table) -> dict:
        row = {name: table[name][0].as_py() for name in table.schema.names}
        count, dim = row["rows"], row["dim"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        return row | {
            "ids": read("ids", np.int64), "unnamed": read("unnamed", np.uint8).astype(bool), "keys": read("keys", np.int64),
            "values": read("numbers", np.int32).reshape(count, dim).astype(np.int64),
        }

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one block for one group of queries: at most ``k`` rows a query."""
        if not len(left) or not len(right):
            return schema.empty_table()
        block, asked = unpack(left), unpack(right)
        count, dim = block["rows"], block["dim"]
        every = bitmaps(np.ones(count, np.uint8))
        index = np.frombuffer(block["slices"], np.uint64).reshape(dim, slices, len(every))
        sorter = np.argsort(block["keys"])
        at = np.searchsorted(block["keys"], asked["keys"], sorter=sorter)
        own = np.where(at < count, sorter[np.minimum(at, count - 1)], 0)
        own[block["keys"][own] != asked["keys"]] = -1
        # Ties go to the smaller id, those without one last, then to the smaller key.
        ids = np.where(block["unnamed"], np.iinfo(np.int64).max, block["ids"])
        found = []
        for q in range(asked["rows"]):
            rows = every
            if own[q] >= 0:
                rows = every.copy()
                rows[own[q] // 64] &= ~(np.uint64(1) << np.uint64(own[q] % 64))
            near, score = best_rows(index, block["shift"], block["values"], asked["values"][q], rows, k)
            best = np.lexsort((block["keys"][near], ids[near], block["unnamed"][near], -score))[:k]
            found.append((np.full(len(best), q), near[best], score[best]))
        q, rows, score = (np.concatenate(part) for part in zip(*found))
        return pa.table([
            pa.array(asked["keys"][q]), pa.array(asked["ids"][q]), pa.array(block["keys"][rows]),
            pa.array(block["ids"][rows], mask=block["unnamed"][rows]), pa.array(score),
        ], schema=schema)

    return run


def _dealt(rows: DataFrame, size: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``block``, of about ``size`` rows of one length each, and (dim, blocks)."""
    counts = written(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks")), "slice-counts")
    return lookup_join(rows, counts, ["dim"], "inner").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks"), counts


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, numbers, dim): floor(scale * component) of the vectors that take part."""
    value = F.col("embedding").cast("array<double>")
    fit = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST)), F.lit(False))
    numbers = F.transform(value, lambda x: F.floor(x * scale).cast("int"))
    return vectors.filter(fit).select("vec_id", numbers.alias("numbers"), F.size("embedding").cast("long").alias("dim"))


def top_products(vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256, slices: int = SLICES,
                 block_rows: int = BLOCK_ROWS, group: int = GROUP) -> DataFrame:
    """The ``k`` other vectors of the greatest inner product with each vector that ``asked`` (on vec_id) chooses.

    Takes (vec_id, embedding); gives (query_id, rank from 1, vec_id, score) over whole numbers floor(scale * x).
    Vectors that are null, hold null or non-finite components, or one of 2**24 / scale or more, take no part;
    vectors of different length have no product; those of no component have the product 0. Every row is a vector:
    rows of one id are each other's candidates, and each of them asks for itself. Equal scores go to the smaller
    id, rows without id last. A null id asks nothing.
    """
    numbered = whole_numbers(vectors.select("vec_id", "embedding"), scale).withColumn("row", F.monotonically_increasing_id())
    rows = written(numbered, "slice-rows")
    size = F.least(F.lit(block_rows), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("dim", F.lit(1)))))
    dealt, blocks = _dealt(rows, size)
    index = written(dealt.groupBy("dim", "block").applyInArrow(_index(slices), f"{_PACK}, slices binary, shift long"), "bit-slices")
    queries, groups = _dealt(rows.filter(asked), F.lit(group))
    packs = written(
        queries.groupBy("dim", "block").applyInArrow(_group, _PACK).withColumnRenamed("block", "group"), "slice-queries"
    )
    # A cell is one block and one group of queries of the same length; there are as many as blocks times groups.
    numbers_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = lookup_join(index, groups.withColumnRenamed("blocks", "n"), ["dim"], "inner").withColumn("group", numbers_to("n")).drop("n")
    right = lookup_join(packs, blocks.withColumnRenamed("blocks", "n"), ["dim"], "inner").withColumn("block", numbers_to("n")).drop("n")
    cell = ["dim", "block", "group"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _search(k, slices), "query long, query_id long, row long, vec_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
