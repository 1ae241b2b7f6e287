"""A record store in buckets by key: changes are small files beside it, and meet it without a shuffle of the store.

Layout of a store's folder: ``meta`` (key and number of buckets), ``base/through=<n>`` (all records with the changes
up to batch n), ``changes/batch_id=<n>`` (whole records, one per key). Base and changes are dealt to the same
buckets by the hash of the key, which Spark knows from the table's definition, so grouping or joining them by
key moves nothing. What a batch of updates moves is itself only, into the buckets. Compaction
writes a new base from the last one and its changes, bucket by bucket; readers take the newest base that is whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.operators.stores import latest_per_ticket
from redressa.session import materialized, prepare

BUCKETS = 64
VERSION = "batch_id"
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def create_store(records: DataFrame, folder: str, key: str = "ticket_id", buckets: int = BUCKETS) -> None:
    """A new store of ``records``, one per key; a record without a key has no place in it."""
    spark = records.sparkSession
    meta = spark.createDataFrame([(key, buckets)], "key string, buckets int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    _write_base(records.filter(F.col(key).isNotNull()).withColumn(VERSION, F.lit(-1).cast("long")), folder, key, buckets, -1)
    empty = spark.createDataFrame([], records.schema).withColumn(VERSION, F.lit(0).cast("long"))
    _open(spark, f"{folder}/changes", empty, key, buckets, partitioned=True)


def append_changes(updates: DataFrame, folder: str, batch_id: int) -> None:
    """Whole records that replace those of their keys, or are new; a replay of the batch replaces its own file only.

    Several records of one key are one change: see :func:`latest_per_ticket`. The store is not read.
    """
    spark = updates.sparkSession
    key, buckets = _meta(spark, folder)
    one = latest_per_ticket(updates.filter(F.col(key).isNotNull()).withColumnRenamed(key, "ticket_id").withColumn(VERSION, F.lit(batch_id).cast("long")), VERSION)
    one = one.withColumnRenamed("ticket_id", key)
    table = _open(spark, f"{folder}/changes", one, key, buckets, partitioned=True)
    rows = one.repartition(buckets, key).select(*spark.table(table).columns)
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")  # only this batch's partition is replaced
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(OVERWRITE, before)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in its newest version."""
    return _merged(prepare(spark), folder).drop(VERSION)


def records_of(keys: DataFrame, folder: str) -> DataFrame:
    """The newest records of the asked keys (a column named as the store's key, each key once); only ``keys`` are moved."""
    spark = keys.sparkSession
    key, buckets = _meta(spark, folder)
    return _merged(spark, folder, keys=keys.select(key).repartition(buckets, key)).drop(VERSION)


def change_status(updates: DataFrame, folder: str, batch_id: int) -> None:
    """Change records of known keys by (key, other columns): a null keeps what is held, unknown keys change nothing.

    Only the records of the asked keys are read, where they stand.
    """
    spark = updates.sparkSession
    key, _ = _meta(spark, folder)
    given = materialized(updates, "status-updates")
    held = records_of(given.select(key).distinct(), folder)
    fields = [c for c in given.columns if c != key]
    changed = held.join(given.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key)
    append_changes(changed.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in held.columns]), folder, batch_id)


def compact(spark: SparkSession, folder: str) -> None:
    """A new base that holds all changes so far; changes that come meanwhile stay changes."""
    key, buckets = _meta(spark, folder)
    newest = _batches(spark, folder)
    if newest:
        _write_base(_merged(spark, folder, max(newest)), folder, key, buckets, max(newest))


def clean(spark: SparkSession, folder: str) -> None:
    """Remove what the newest base makes superfluous, once no reader of an older one is left."""
    whole = _bases(spark, folder)
    for through in whole[:-1]:
        _delete(spark, f"{folder}/base/through={through}")
    for batch in _batches(spark, folder):
        if whole and batch <= whole[-1]:
            _delete(spark, f"{folder}/changes/{VERSION}={batch}")
    name = _name(f"{folder}/changes")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _merged(spark: SparkSession, folder: str, upto: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    key, buckets = _meta(spark, folder)
    through = _bases(spark, folder)[-1]
    base = spark.table(_open(spark, f"{folder}/base/through={through}", None, key, buckets))
    table = _open(spark, f"{folder}/changes", base, key, buckets, partitioned=True)
    if _batches(spark, folder):  # batches that other sessions have written or removed
        spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
        spark.catalog.refreshTable(table)
    changes = spark.table(table).filter(F.col(VERSION) > through)
    if upto is not None:
        changes = changes.filter(F.col(VERSION) <= upto)
    if keys is not None:
        base, changes = (side.join(keys, key, "left_semi") for side in (base, changes))
    # The newest version per key from two columns; then only its record is taken. The comparison is no join key:
    # equal buckets of the key alone are enough.
    newest = changes.groupBy(key).agg(F.max(VERSION).alias("_newest"))
    change = changes.join(newest.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col(VERSION) >= F.col("_newest")))
    row = F.struct(*base.columns)
    fresh = change.select(F.col(key).alias("_key"), row.alias("_fresh"))
    held = base.select(F.col(key).alias("_held_key"), row.alias("_held"))
    both = held.join(fresh, F.col("_held_key") == F.col("_key"), "full_outer")
    return both.select(F.coalesce("_fresh", "_held").alias("row")).select("row.*")


def _write_base(records: DataFrame, folder: str, key: str, buckets: int, through: int) -> None:
    path = f"{folder}/base/through={through}"
    name = _name(path)
    records.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    partitions = records.repartition(buckets, key)  # where the records stand in these buckets already, nothing moves
    partitions.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def _name(path: str) -> str:
    return "buckets_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def _open(spark: SparkSession, path: str, like: DataFrame | None, key: str, buckets: int, partitioned: bool = False) -> str:
    """The name under which this session knows the table at ``path``; another session finds it by its path too."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        schema = (like if like is not None else spark.read.parquet(path)).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet " + (f"PARTITIONED BY ({VERSION}) " if partitioned else "")
            + f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return name


def _meta(spark: SparkSession, folder: str) -> tuple[str, int]:
    row = spark.read.schema("key string, buckets int").parquet(f"{folder}/meta").first()
    return row["key"], row["buckets"]


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    path, system = _files(spark, folder)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(int(name.removeprefix(prefix)) for name in names if name.startswith(prefix))


def _bases(spark: SparkSession, folder: str) -> list[int]:
    """The bases that are whole, oldest first."""
    _, system = _files(spark, folder)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in _numbered(spark, f"{folder}/base", "through=") if system.exists(mark(f"{folder}/base/through={n}/_SUCCESS"))]


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return _numbered(spark, f"{folder}/changes", f"{VERSION}=")


def _delete(spark: SparkSession, folder: str) -> None:
    path, system = _files(spark, folder)
    system.delete(path, True)
