"""Structured Streaming forms of incremental ingest and windowed counts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.graph import shared_folder

WATERMARK = "2 days"


def stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if path.endswith(".parquet"):  # one file, or a folder of files, as the table was written
        parent, name = path.rsplit("/", 1)
        return source.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(parent)
    return source.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def zoned(df: DataFrame, column: str) -> DataFrame:
    """Event time as a timestamp with the session's zone, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedup(df: DataFrame, keys: list[str], ts: str, watermark: str = WATERMARK) -> DataFrame:
    """First arrival of each key; state older than the watermark is dropped."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, ts: str, size: str, *keys: str, watermark: str = WATERMARK) -> DataFrame:
    return df.withWatermark(ts, watermark).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), *keys, "n")


def sliding(df: DataFrame, ts: str, size: str, slide: str, *keys: str, watermark: str = WATERMARK) -> DataFrame:
    return df.withWatermark(ts, watermark).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, *keys: str, watermark: str = WATERMARK) -> DataFrame:
    return df.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("begins"), *keys, "n")


def split_undated(df: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """(dated, undated): rows without a time are kept beside the watermarked flow, not dropped."""
    return df.where(F.col(ts).isNotNull()), df.where(F.col(ts).isNull())


def run_available(df: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run the stream over what is there now and return the table it wrote: Parquet in the folder that all executors share
    (spark.checkpoint.dir unless given).  Of a complete stream every batch writes the whole result and the last one counts."""
    folder = f"{folder or shared_folder(df.sparkSession)}/stream-{uuid4().hex}"
    if mode == "append":
        append_available(df, f"{folder}/rows", f"{folder}/state")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def append_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new to a Parquet table, exactly once by the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
