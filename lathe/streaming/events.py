"""Structured Streaming over event tables: windows, late data, deduplication, sinks that may be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def with_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """ts as an instant, with rows later than `late` given up."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates, late: str = "1 hour") -> DataFrame:
    return _flat(with_time(df, ts, late).groupBy(F.window(ts, size), *keys).agg(*aggregates), keys)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggregates, late: str = "1 hour") -> DataFrame:
    return _flat(with_time(df, ts, late).groupBy(F.window(ts, size, slide), *keys).agg(*aggregates), keys)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates, late: str = "1 hour") -> DataFrame:
    return _flat(with_time(df, ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates), keys)


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("window", *keys)]
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *rest)


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key while the watermark has not passed it."""
    return with_time(df, ts, late).dropDuplicatesWithinWatermark(keys)


def once(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append", partition_by: list[str] | None = None) -> StreamingQuery:
    """All that is there now, exactly once: a file sink with a checkpoint, ended when the input is done."""
    writer = df.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(*partition_by) if partition_by else writer).start(path)
    query.awaitTermination()
    return query


def each_batch(df: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """put(rows, number) at least once for each micro-batch; put must take the same number again."""
    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
