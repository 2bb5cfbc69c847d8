"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as in the contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A group is hot if it holds more than this share of the rows; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, and where none is set the warehouse, which they share as well."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.loom_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store; nothing may read it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote; nothing may read these tables any more."""
    for df in tables:
        if path := getattr(df, "loom_path", None):
            remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch, at most: texts are long, and Python's share of an executor is small.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands Python no more than BATCH_ROWS rows at a time from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def n_words(text: Column) -> Column:
    """Words in a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, count: str = "group_size") -> DataFrame:
    """Joins each row to the one row of its group, whatever share of the rows the group holds.

    groups has one row per key with the count of its rows in ``count``.  Groups with more than
    HOT_SHARE of all rows number at most 1 / HOT_SHARE, which bounds the broadcast; rows of other
    groups are joined by a shuffle on the key, where no partition can be hot.  rows and groups
    should be cheap to read, for each is read twice.  Rows whose key has no group are dropped.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = groups.where(F.col(count) > limit)
    cold = groups.where(F.col(count) <= limit)
    hit = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return hit.unionByName(rest)


def released(function):
    """A function over Arrow batches that hands its memory back when a task ends: workers outlive tasks, and idle ones count."""

    def run(*args):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from function(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run
