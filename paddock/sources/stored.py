"""Cards written once: partitioned by date, bucketed by race, so that dates prune files and joins of a race need no exchange."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only in local mode (tests) a temporary one if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='paddock-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def dealt(rows: DataFrame, key: str = "race_id") -> DataFrame:
    """`rows` where the buckets of stored tables lie: joins by the key, or by it and more, exchange neither side again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@contextlib.contextmanager
def side_by_side(spark: SparkSession):
    """While a table is written, joins by race and runner take both sides where they lie, dealt out by race, and in the order they were written in.

    By default Spark deals both sides out anew by all keys, and sorts buckets again that are one sorted file each.
    """
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def store(rows: DataFrame, name: str, key: str = "race_id", buckets: int | None = None, by: str | None = "race_date", sort: list[str] | None = None, deal: bool = True) -> DataFrame:
    """Write `rows` as the table `name`, in `buckets` by `key` and, with `by`, in folders by that column; returns the stored table.

    The rows are dealt out by the key first, so that a bucket of a date is one file. There are as many buckets as shuffle
    partitions unless given. The files are in the shared folder. With `deal` off the rows are written where they are: they
    lie in buckets already (`dealt`, or joined to a stored table by the key); others would only make more files.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = (rows.repartition(buckets, key) if deal else rows).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(*(sort or [key])).option("path", f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    with side_by_side(spark):
        (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return spark.table(name)


def fingerprint(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Of the files of some tables: another name, size or time of any of them gives another one."""
    found = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in sorted([files.getFileStatus(path), *files.listStatus(path)], key=lambda s: s.getPath().toString()):
            found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:16]


def once(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build, **how) -> DataFrame:
    """The stored table of `build()`, which is written when the session has none for the present files of the tables it reads."""
    full = f"paddock_{name}_{fingerprint(spark, sf_dir, tables)}"
    return spark.table(full) if spark.catalog.tableExists(full) else store(build(), full, **how)


def on(table: DataFrame, first: str, last: str) -> DataFrame:
    """The rows of some days; only their folders are read."""
    return table.where(F.col("race_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
