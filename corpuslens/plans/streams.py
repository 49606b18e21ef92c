"""Streaming queries, run over what is available and equal to their batch form."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import functions as F

from corpuslens.operators.graph import shared_folder
from corpuslens.streaming import incremental as I
from corpuslens.streaming import stateful as S

from .registry import query


def events(t):
    return I.zoned(I.stream(t.spark, f"{t.sf_dir}/events.parquet"), "ts")


def _text(df):
    return df.withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@query("select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') begins, event_type, count(*) n from events group by all")
def stream_tumbling(t):  # X2
    return _text(I.run_available(I.tumbling(events(t), "ts", "1 day", "event_type")))


@query("select strftime(time_bucket(interval 12 hour, ts) - to_hours(12 * k), '%Y-%m-%d %H:%M:%S') begins, event_type, count(*) n from events, (select unnest([0, 1]) k) group by all")
def stream_sliding(t):  # X2 X3
    return _text(I.run_available(I.sliding(events(t), "ts", "1 day", "12 hours", "event_type")))


@query("with g as (select *, ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour brk from events), s as (select *, sum(case when brk is null or brk then 1 else 0 end) over (partition by user_id order by ts, event_id) sid from g) select strftime(min(ts), '%Y-%m-%d %H:%M:%S') begins, user_id, count(*) n from s group by user_id, sid")
def stream_session(t):  # X6
    return _text(I.run_available(I.sessions(events(t), "ts", "6 hours", "user_id"), "complete"))


@query("select distinct user_id, event_type from events")
def stream_dedup(t):  # X1 X4
    dated, _ = I.split_undated(events(t), "ts")
    return I.run_available(I.dedup(dated, ["user_id", "event_type"], "ts", "60 days"), "append").select("user_id", "event_type")


@query("""with s as (select *, sum(case when f then 0 else 1 end) over (partition by user_id order by ts, event_id) i from (select *, event_type = 'click' f from events where ts is not null)),
 k as (select *, sum(cast(f as int)) over (partition by user_id, i order by ts, event_id) streak from s),
 b as (select *, coalesce(max(cast(streak >= 2 as int)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) cut from k)
 select user_id, event_id, cast(streak as bigint) streak from b where cut = 0""")
def stream_circuit_breaker(t):  # X7: keyed state
    rows = events(t).select("user_id", "event_id", "event_type", "ts")
    return I.run_available(S.circuit_breaker(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "click", 2, "ts", idle=timedelta(days=3650)), "append").select("user_id", "event_id", "streak")


@query("select event_type, count(distinct user_id) n, 1 versions from events group by 1")
def stream_versions(t):  # X5 X1: a version a batch, first row of every key
    folder = f"{shared_folder(t.spark)}/versions-{uuid4().hex}"
    rows = events(t).select("user_id", "event_type", "event_id")
    S.ingest(rows, f"{folder}/table", f"{folder}/state", ["user_id", "event_type"], ["event_id"])
    got = S.read_version(t.spark, f"{folder}/table", rows.schema)
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("corpus_version").cast("int").alias("versions"))
