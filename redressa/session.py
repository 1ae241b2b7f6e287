"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Of the tables written here: texts take a third less room than by Spark's default, at little more time.
COMPRESSION = "zstd"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter brings its own."""
    return prepare(
        SparkSession.builder.master(master)
        .appName("redressa")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """All ticket times are UTC; everything else is left as the submitter set it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where all intermediate tables of this application go; see :func:`clean_up`."""
    return f"{shared_folder(spark).rstrip('/')}/redressa/{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the run's folder; never reused, so nothing is overwritten."""
    folder = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", []):
        scope.append(folder)
    return folder


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that this thread makes inside go at the end, also when it fails.

    For work that writes its results elsewhere, such as a batch of a stream: a stream that runs for long would fill the
    shared folder.
    """
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        made = _scopes.open[-1]
        _scopes.open = _scopes.open[:-1]
        for folder in made:
            _delete(spark, folder)


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the written rows.

    Used where two readers must see the same rows, or would compute them twice: what is written survives
    the loss of an executor, is read by column, and cuts the lineage.
    """
    folder = work_folder(df.sparkSession, name)
    df.write.option("compression", COMPRESSION).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clean_up(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, once no result that reads them is needed."""
    _delete(spark, run_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
