"""What several operators share: tables, shared scratch space, byte-level words, skew-safe look-ups."""

from __future__ import annotations

import os
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, nothing else; str.lower would also change other alphabets.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where the setting is absent a folder of this machine serves, in local mode only: on a cluster
    other executors could not read it, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        path = f"/tmp/checkpoints/tillage-{os.getpid()}"
        os.makedirs(path, exist_ok=True)
        spark.sparkContext.setCheckpointDir(f"file://{path}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders of stored tables, by the data frame that reads them.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read again: survives lost executors, cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more; other data frames are left alone."""
    for t in tables:
        path = _FOLDERS.pop(t, None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name = f"_{name}"
    return name


def check_absent(df: DataFrame, *names: str) -> None:
    had = {c.lower() for c in df.columns}
    for n in names:
        if n.lower() in had:
            raise ValueError(f"column {n} exists")


def release() -> None:
    """Gives memory that a Python worker has freed back to the system, where the C library can.

    A worker serves one stage after the other and would else keep the most that any of them held.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() splits at exactly these six characters."""
    return text.split() if text else []


def batches(blob: Iterable, columns: list[str]):
    """Arrow batches as Python lists; string columns come as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    for b in blob:
        out = []
        for c in columns:
            col = b.column(b.schema.get_field_index(c))
            if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            out.append(col.to_pylist())
        yield out


def look_up(left: DataFrame, right: DataFrame, key: str, weight: str, row_id: str, share: int = 1000) -> DataFrame:
    """Left join on a key that is unique in right, safe when one key holds much of left.

    right carries `weight`, how many rows of left have the key. At most `share` keys can hold
    1/share of left or more; those are broadcast (that count is the proven bound), and their rows
    take a key of their own for the shuffle join, so no reduce task gets more than 1/share of left
    for one key. A null key finds nothing. `row_id` is any column of left that spreads the rows.
    """
    total = right.agg(F.sum(weight).alias("_total")).first()["_total"] or 0
    values = [c for c in right.columns if c not in (key, weight)]
    hot = right.where(F.col(weight) * share >= F.lit(max(total, share)))
    h = F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values]))
    cold = right.where(F.col(weight) * share < F.lit(max(total, share))).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    kind = left.schema[key].dataType
    spread = F.xxhash64(F.lit("spread"), F.col(row_id))
    marked = left.join(h, F.col(key) == F.col("_hot_key"), "left")
    # the shuffle is on (key, salt); cold rows have salt 0 and hot rows, which find nothing there, any other
    marked = marked.withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(spread, F.lit(65536)) + 1).otherwise(F.lit(0).cast("long")))
    marked = marked.withColumn("_join_key", F.when(F.col("_salt") == 0, F.col(key)).otherwise(F.lit(None).cast(kind)))
    joined = marked.join(
        cold.withColumn("_cold_salt", F.lit(0).cast("long")),
        F.col("_join_key").eqNullSafe(F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    return joined.select(*left.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in values])
