"""Seven source dialects mapped to one article record.

Every mapping takes a DataFrame of raw fields; fields it lacks count as missing.  A missing field takes its default, and
columns that only some dialects have are null in the others once :func:`union` puts them together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X


class _Fields:
    """Raw fields of a table by name, null where it has none."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def __call__(self, name: str, default: object = "", kind: str = "string") -> Column:
        value = F.col(name) if name in self.names else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default)) if default is not None else value


def _site(url: Column) -> Column:
    return F.coalesce(X.url_host(url), F.lit(""))


def news_index(df: DataFrame) -> DataFrame:
    f = _Fields(df)
    lang = F.coalesce(f("language", None), f("sourcelang", None), F.lit("unknown"))
    return df.select(f("url").alias("url"), f("title").alias("title"), f("seendate").alias("seendate"), f("sourcecountry", "unknown").alias("sourcecountry"), lang.alias("sourcelang"), f("domain").alias("domain"))


def news_index_windowed(df: DataFrame, window: str, event_id: int) -> DataFrame:
    return news_index(df).withColumns({"window": F.lit(window), "event_id": F.lit(event_id).cast("long"), "source": F.lit("gdelt")})


def full_text_api(df: DataFrame, lang: str, event_id: int, names: dict[str, str], window: str | None = None) -> DataFrame:
    """names: language code → name; a code without one keeps what the record says."""
    f = _Fields(df)
    text = f("text")
    out = df.select(
        f("url").alias("url"), f("title").alias("title"), F.when(f("publish_date") != "", X.compact_timestamp(F.left(f("publish_date"), F.lit(19)))).otherwise("").alias("seendate"), f("source_country", "unknown").alias("sourcecountry"),
        (F.lit(names[lang]) if lang in names else f("language", lang)).alias("sourcelang"), _site(f("url")).alias("domain"), F.lit("worldnews").alias("source"), F.lit(1).cast("long").alias("tier"), F.lit(event_id).cast("long").alias("event_id"),
        F.length(text).cast("long").alias("text_chars"), (text != "").alias("has_full_text"),
    )
    return out.withColumn("window", F.lit(window)) if window else out


def multilingual_api(df: DataFrame, lang_name: str, region: str, country: str, event_id: int) -> DataFrame:
    """The first of a list of countries, two-letter codes in capitals; the content's length, or the description's without one."""
    f = _Fields(df)
    first = F.coalesce(F.get(f("country", None, "array<string>"), F.lit(0)), F.lit(country))
    body = F.coalesce(F.nullif(f("content"), F.lit("")), f("description"))
    return df.select(
        f("link").alias("url"), f("title").alias("title"), F.when(f("pubDate") != "", X.compact_timestamp(f("pubDate"))).otherwise("").alias("seendate"), F.when(F.length(first) == 2, F.upper(first)).otherwise(first).alias("sourcecountry"),
        F.lit(lang_name).alias("sourcelang"), _site(f("link")).alias("domain"), F.lit("newsdata").alias("source"), F.lit(1).cast("long").alias("tier"), F.lit(region).alias("region"), F.lit(event_id).cast("long").alias("event_id"),
        F.length(body).cast("long").alias("text_chars"), (f("content") != "").alias("has_full_text"),
    )


def financial_api(df: DataFrame, window: str, event_id: int = 3) -> DataFrame:
    """entities: array of (symbol, industry); symbols as they come, industries once each in order."""
    f = _Fields(df)
    entities = F.coalesce(f("entities", None, "array<struct<symbol:string,industry:string>>"), F.array().cast("array<struct<symbol:string,industry:string>>"))
    listed = lambda k: F.filter(F.transform(entities, lambda e: e[k]), lambda x: x.isNotNull() & (x != ""))
    text = F.coalesce(F.nullif(f("description"), F.lit("")), f("snippet"))
    stamp = F.try_to_timestamp(F.left(f("published_at"), F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return df.select(
        f("url").alias("url"), f("title").alias("title"), F.coalesce(F.date_format(stamp, "yyyyMMddHHmmss"), F.lit("")).alias("seendate"), f("language", "en").alias("sourcelang"), _site(f("url")).alias("domain"), F.lit("marketaux").alias("source"),
        f("source").alias("source_name"), F.lit(1).cast("long").alias("tier"), F.lit(event_id).cast("long").alias("event_id"), F.lit(window).alias("window"), F.length(text).cast("long").alias("text_chars"),
        listed("symbol").alias("tickers"), F.array_distinct(listed("industry")).alias("industries"), F.size(entities).cast("long").alias("entity_count"),
    )


def tagged_index(df: DataFrame) -> DataFrame:
    """The news index, its language under one name only."""
    return news_index(df.drop("sourcelang")).withColumn("source_api", F.lit("gdelt"))


def league_api(df: DataFrame, lang: str, names: dict[str, str]) -> DataFrame:
    """Publish dates as they come, the host with any www."""
    f = _Fields(df)
    host = F.coalesce(F.regexp_extract(f("url"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return df.select(f("url").alias("url"), f("title").alias("title"), f("publish_date").alias("seendate"), f("source_country", "unknown").alias("sourcecountry"), F.lit(names.get(lang, lang)).alias("sourcelang"), host.alias("domain"), F.lit("api_league").alias("source_api"), f("text").alias("full_text"))


DIALECTS: dict[str, Callable[..., DataFrame]] = {"news_index": news_index, "news_index_windowed": news_index_windowed, "full_text_api": full_text_api, "multilingual_api": multilingual_api, "financial_api": financial_api, "tagged_index": tagged_index, "league_api": league_api}


def union(records: dict[str, DataFrame]) -> DataFrame:
    """Records of several dialects with a column that names theirs."""
    tagged = [df.withColumn("dialect", F.lit(name)) for name, df in records.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
