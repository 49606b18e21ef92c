"""Keyed state over micro-batches, and versioned, idempotent ingest."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuslens.operators.relational import first_per_key

FAILED = "failed__"  # names with a leading underscore do not reach the state processor
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Breaker(StatefulProcessor):
    """A key's failures in a row, whether it is cut, and when its state may go."""

    def __init__(self, order: Sequence[str], ts: str, limit: int, idle: timedelta):
        self.order, self.ts, self.limit, self.idle = list(order), ts, limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streak", "streak long, cut boolean, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        streak, cut, expires = held if held else (0, False, 0)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        latest = batch[self.ts].max()
        streaks, kept = [], []
        for failed in batch[FAILED].fillna(False):
            kept.append(not cut)
            if not cut:
                streak = streak + 1 if failed else 0
                cut = streak >= self.limit
            streaks.append(streak)
        if expires:
            self.handle.deleteTimer(expires)
        expires = max(expires, int((latest + self.idle).timestamp() * 1000))
        self.handle.registerTimer(expires)
        self.state.update((streak, cut, expires))
        yield batch.assign(streak=streaks)[kept].drop(columns=FAILED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def circuit_breaker(df: DataFrame, key: str, order: Sequence[str], failed: Column, limit: int, ts: str, *, watermark: str = "2 days", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """The stream's rows up to the one at which a key has failed limit times in a row, with streak, the failures so far; what comes
    later goes.  A key's rows are taken in order within a micro-batch, and micro-batches in order of arrival.  A key that the
    watermark is idle past is forgotten, and so is its cut.  A failure that is null is none; rows without a time are left out (see
    split_undated)."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = df.where(F.col(ts).isNotNull()).withColumn(FAILED, failed).withWatermark(ts, watermark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", streak long"
    return rows.groupBy(key).transformWithStateInPandas(_Breaker(order, ts, limit, idle), kinds, "Append", "EventTime")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions of a table and the ingest batch that wrote each; a version's rows count from its entry in the ledger on."""
    if not _exists(spark, f"{path}/_ledger"):
        return {}
    return {r["version"]: r["batch"] for r in spark.read.schema("version long, batch string").json(f"{path}/_ledger").collect()}


def read_version(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The table as of a version (the latest unless given), with corpus_version; what no ledger entry names is not read."""
    held = [v for v in sorted(versions(spark, path)) if version is None or v <= version]
    out = spark.createDataFrame([], schema).withColumn("corpus_version", F.lit(0).cast("long"))
    for v in held:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/corpus_version={v}").withColumn("corpus_version", F.lit(v).cast("long")))
    return out


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Append what is there now to a versioned table, a version a micro-batch: the first row in order of every key that no earlier
    version has (rows without a key are left out).  A batch that was committed is not written again, whatever is replayed; one that broke off is
    written anew under the same version; readers of read_version see whole versions only.  One ingest writes a table at a time; a new
    checkpoint is a new ingest, whose batches add only new keys."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        source = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        commit(batch.select(*schema.names), path, f"{source}-{number}", keys, order)

    spark.conf.set("spark.sql.streaming.stopTimeout", "60s")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def commit(batch: DataFrame, path: str, name: str, keys: Sequence[str], order: Sequence[str]) -> int | None:
    """Write a named batch as the next version of the table; its number, or None if a batch of that name was committed before."""
    spark, held = batch.sparkSession, versions(batch.sparkSession, path)
    if name in held.values():
        return None
    version = max(held, default=0) + 1
    known = batch
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    new = first_per_key(known, list(keys), list(order))
    if held:
        new = new.join(read_version(spark, path, batch.schema).select(*keys), list(keys), "left_anti").select(*batch.columns)
    new.write.mode("overwrite").parquet(f"{path}/corpus_version={version}")
    spark.createDataFrame([(version, name)], "version long, batch string").coalesce(1).write.mode("append").json(f"{path}/_ledger")
    return version
