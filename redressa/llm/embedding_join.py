"""Links between near-equal embeddings: an exact range join of a metric space.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Pivots cut the space into
cells of the vectors nearest to them. A vector can only have partners in another cell if, by the
triangle inequality, its distance to that cell's pivot exceeds the one to its own by at most twice the
radius; and, a tighter bound of the same kind, if the plane between both pivots is within the radius.
It is copied to those cells, and every cell is then joined on its own. Any pivots give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import written
from redressa.llm.links import components, local_components
from redressa.operators.lookup import lookup_join

LEAST_COSINE = 0.98
#: Vectors a cell should have, the bytes of pivots that may be sent to all tasks, and the side of a block of one task.
CELL, PIVOT_BYTES, BLOCK = 2000, 64 << 20, 4096
#: Distances that a task works out at a time.
AT_ONCE = 1 << 21
#: Slack on the bounds only; pairs are decided by the cosine itself.
SLACK = 1e-6


def _units(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # Scaled first, so that neither very large nor very small components leave the range of a double.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _cells(pivots: dict[int, np.ndarray], radius: float):
    rows_at_once = max(1, AT_ONCE // max(map(len, pivots.values()), default=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, rows_at_once) for b in batches for lo in range(0, len(b), rows_at_once)):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                own = pivots.get(int(dim))
                if own is None or len(own) < 2:
                    home, cells = np.zeros(len(rows), np.int64), [[0]] * len(rows)
                else:
                    dots = _units(rows.column("embedding")) @ own.T
                    home = dots.argmax(axis=1)
                    best = dots[np.arange(len(rows)), home][:, None]
                    far = lambda x: np.sqrt(np.maximum(2 - 2 * x, 0))
                    between = far(own[home] @ own.T)
                    near = (far(dots) - far(best) <= 2 * radius + SLACK) & (best - dots <= radius * between + SLACK)
                    near[np.arange(len(rows)), home] = True
                    cells = [np.flatnonzero(x).tolist() for x in near]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(home, pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                    names=[*rows.schema.names, "home", "cells"],
                )

    return run


def _join(least: float):
    def run(block: pa.Table) -> pa.Table:
        """Links of the queries of one block to its targets: a row with the weight linked to each, and links that span them."""
        rep, weight = block["key"].to_numpy(), block["weight"].to_numpy()
        units = _units(block["embedding"].combine_chunks())
        query, target = (np.flatnonzero(block[c].to_numpy(zero_copy_only=False)) for c in ("query", "target"))
        total, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for lo in range(0, len(query), 512):
            part = query[lo : lo + 512]
            linked = units[part] @ units[target].T >= least
            linked &= rep[part][:, None] != rep[target][None, :]
            total[part] += linked @ weight[target]
            a, b = np.nonzero(linked)
            a, b = root[part[a]], root[target[b]]
            apart = a != b
            if apart.any():
                pairs = np.unique(a[apart] * np.int64(len(rep)) + b[apart])
                step = local_components(len(rep), pairs // len(rep), pairs % len(rep))
                root = step[root]
        found = np.flatnonzero(total > 0)
        tied = np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({
            "a": np.concatenate([rep[found], rep[tied]]), "b": np.concatenate([rep[found], rep[root[tied]]]),
            "n": np.concatenate([total[found], np.zeros(len(tied), np.int64)]),
        })

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Links by cosine >= ``least`` between vectors of one label: vec_id, n_links, component_id, kept.

    Every row is a vector. Null, empty or zero vectors, those with null or non-finite components, and
    rows without label or id link with nothing: n_links 0 and their own component. Vectors of different
    length never link. Equal vectors of a label are one class, joined once and counted by its size; a
    class is named by a hash, as two of them may hold rows of the same id, which then share no more than it. Cells larger
    than ``block`` are joined block by block. The number of pivots grows with the largest label, and from
    some millions of vectors on as its root, so that finding the cells takes no more work than joining them.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    number = F.col("embedding").cast("array<double>")
    fit = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(number) > 0)
        & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(number, lambda x: x != 0)
    )
    keyed = rows.withColumns({
        "_h1": F.when(fit, F.xxhash64("label", "embedding")), "_h2": F.when(fit, F.xxhash64("embedding", F.lit(7), "label"))
    })
    classes = written(
        keyed.filter("_h1 is not null").groupBy("_h1", "_h2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"),
            F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"),
        ).withColumn("dim", F.size("embedding").cast("long")).withColumn("key", F.xxhash64("_h1", "_h2")),
        "vector-classes",
    )
    # The largest label decides how many pivots; vectors spread by hash, of a bounded size.
    per_label = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"))
    largest, longest = per_label.agg(F.max("n"), F.max("dim")).first()
    count = min(-(-(largest or 0) // cell), math.isqrt(largest or 0) + 1, max(2, PIVOT_BYTES // (8 * (longest or 1))))
    chosen = classes.orderBy("key").limit(count).select("dim", "embedding").toArrow() if count > 1 else None
    pivots = {}
    if chosen is not None:
        dims = chosen["dim"].to_numpy()
        for dim in np.unique(dims):
            pivots[int(dim)] = _units(chosen["embedding"].combine_chunks().filter(pa.array(dims == dim)))
    radius = float(np.sqrt(2 - 2 * least))
    names = ["key", "weight", "label", "dim", "embedding"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.select(*names).schema)
    placed = written(
        classes.select(*names).mapInArrow(_cells(pivots, radius), f"{kinds}, home long, cells array<long>"), "vector-cells"
    )
    where = ["label", "dim", "cell"]
    members = placed.withColumn("cell", F.explode("cells")).drop("cells")
    sizes = members.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    split = members.join(sizes, where).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    # Block (i, j) joins the j-th part of a cell's members to the i-th part of those at home in it.
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    at_home = F.col("home") == F.col("cell")
    as_query = F.transform(every, lambda i: F.struct(
        i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("query"), (at_home & (i == F.col("own"))).alias("target")
    ))
    as_target = F.transform(F.filter(every, lambda j: at_home & (j != F.col("own"))), lambda j: F.struct(
        F.col("own").alias("i"), j.alias("j"), F.lit(False).alias("query"), F.lit(True).alias("target")
    ))
    blocks = split.withColumn("p", F.explode(F.concat(as_query, as_target))).select(
        *where, "key", "weight", "embedding", "p.*"
    )
    found = written(blocks.groupBy(*where, "i", "j").applyInArrow(_join(least), "a long, b long, n long"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("linked"))
    roots = components(found.select("a", "b"))
    named = (
        classes.select("_h1", "_h2", "key", "rep", "weight")
        .join(counts, F.col("key") == F.col("a"), "left")
        .join(roots, F.col("key") == F.col("node"), "left")
        .withColumn("group", F.coalesce("root", "key"))
    )
    named = written(named.select("_h1", "_h2", "rep", "group", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n")), "vector-groups")
    smallest = named.groupBy("group").agg(F.min("rep").alias("root"))
    known = lookup_join(named, smallest, ["group"], "inner").select("_h1", "_h2", "n", "root")
    component = F.coalesce("root", "vec_id")
    return keyed.select("vec_id", "_h1", "_h2").join(known, ["_h1", "_h2"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
