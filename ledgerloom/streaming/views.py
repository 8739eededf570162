"""Structured Streaming views of an append-only event store: newest rows, sessions, and suppression of exact repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path


def event_stream(spark: SparkSession, path: str, like: DataFrame, time: str = "ts") -> DataFrame:
    """A file stream with the schema of a batch read; the event time becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(like.schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def newest_stream(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key so far; state is one row a key."""
    rest = [c for c in events.columns if c not in key]
    last = events.dropna(subset=key).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return last.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def distinct_stream(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def session_stream(events: DataFrame, by: list[str], time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of event times; a session ends ``gap`` after its last event, and is emitted once the watermark passes it."""
    w = F.session_window(time, gap)
    out = events.withWatermark(time, delay).groupBy(*by, w.alias("w")).agg(F.count("*").alias("events"), F.max(time).alias("finished"))
    return out.select(*by, F.col("w.start").alias("started"), "finished", "events")


def run_available(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what there is and gives its result table.

    Complete mode replaces the table with each batch, so the last batch's table is read; append mode keeps all.
    """
    spark = stream.sparkSession
    out, done = fresh_path(spark, label), fresh_path(spark, f"{label}-offsets")
    if mode == "complete":

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", done).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", done).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stored_once(stream: DataFrame, store: str, offsets: str, key: list[str], after_batch=None) -> None:
    """Runs a stream into an append-only store that holds the first row of each key, whatever is killed and started again in between.

    Each batch is a folder of its own, named by its number and replaced if the number comes again, and it leaves out the keys of earlier batches. A run
    that ends between a batch's rows and its offsets repeats that batch with the same number, so its rows are written over and
    none come twice. ``after_batch(number)`` is called before the offsets are kept.
    """
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def put(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(schema).parquet(store).where(F.col("batch") < number) if number else None
        new = batch.dropDuplicates(key) if earlier is None else batch.dropDuplicates(key).join(earlier.select(*key), key, "left_anti")
        new.select(*stream.columns).write.mode("overwrite").parquet(f"{store}/batch={number}")
        if after_batch:
            after_batch(number)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, store: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(store).select(*like.columns)
