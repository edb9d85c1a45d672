"""Structured Streaming counterparts of the live views: means, de-duplication, sessions, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.session import scratch
from tillage.sources.sinks import LateRows
from tillage.streaming.stateful import with_rocksdb


def timed(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """With a watermark; a timestamp without zone is cast first, which watermarks need."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_means(stream: DataFrame, width: str, value: str = "value", by: list[str] = (), ts: str = "ts") -> DataFrame:
    """Tumbling windows' mean and count; a window is emitted once the watermark has passed it."""
    g = stream.groupBy(F.window(ts, width).alias("w"), *by).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "avg_value", "n")


def first_in_window(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; repeats within the watermark's delay are dropped."""
    return stream.dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    g = stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1000) -> DataFrame:
    """A table's files as a stream, with the schema of the table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")


def drained(df: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns all it has emitted, kept as files in the shared folder. With `at`, a folder
    of an earlier call, the stream goes on from its state there."""
    spark, at = df.sparkSession, at or scratch(df.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    columns = df.schema
    with with_rocksdb(spark):
        query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, i: keep(b, i) if not b.isEmpty() else None).start()
        query.awaitTermination()
    try:
        return spark.read.schema(columns).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], columns)  # nothing was emitted


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(late, kept): a stream's newest ten days, and then rows of three hours before its watermark, as files in turn.

    What is counted is what state would have taken: one late row an hour, since tasks add up an hour's rows first.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("ts").alias("last"))
    at = scratch(spark)
    near = events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 10 DAYS"))  # one row
    near.drop("last").coalesce(1).write.parquet(f"{at}/in/1")
    old = last.select(F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(-1).cast("long"))).alias("event_id"), "last").select(
        "event_id", (F.col("last") - F.expr("INTERVAL 9 DAYS") + F.make_interval(hours=F.col("event_id").cast("int"))).alias("ts")
    )
    columns = [F.col(f.name) if f.name in ("event_id", "ts") else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        stream = timed(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in"))
        means = window_means(stream, "1 hour")
        run = lambda: means.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(
            lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/{i}")
        ).start().awaitTermination()
        run()
        old.select(*columns).coalesce(1).write.parquet(f"{at}/in/2")
        run()
        listener.settle()
    finally:
        spark.streams.removeListener(listener)
    return near.agg(F.lit(listener.dropped).cast("long").alias("late"), F.count("*").alias("kept"))
