"""Aggregates with the tie, rounding and guard rules the analyses rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_common(df: DataFrame, group: Sequence[str], value: str, position: str, k: int) -> DataFrame:
    """The k most frequent values of each group; ties go to the value met first.  position should be a number: the least of strings or
    structs cannot be kept in a hash table."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), "_first", value)
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("_first")


def mode_of(df: DataFrame, group: Sequence[str], value: str, position: str) -> DataFrame:
    return most_common(df, group, value, position, 1).drop("rank", "n")


def counts_map(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """A map key → count for each group, keys in order."""
    pairs = df.groupBy(*group, key).agg(F.count("*").alias("n"))
    return pairs.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("counts"))


def distinct_in_order(df: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct non-empty values of each group, in order of first appearance."""
    seen = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group, value).agg(F.min(order).alias("_first"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda x: x[value])
    return seen.groupBy(*group).agg(listed.alias("values"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal bins over [0, 1], the last closed on the right; values outside are dropped; empty bins are kept."""
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    inside = df.where(F.col(value).between(0, 1)).select(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin"))
    return spine.join(inside.groupBy("bin").count(), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def bucket(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    out = F.lit(names[-1])
    for edge, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(value < edge, name).otherwise(out)
    return out


def summary(value: Column | str, places: int = 6) -> list[Column]:
    """Population summary: n, mean, std (ddof 0), least, greatest, median."""
    r = lambda c: F.round(c, places)
    return [F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_pop(value)).alias("std"), r(F.min(value)).alias("least"), r(F.max(value)).alias("greatest"), r(F.median(value)).alias("median")]


def share_at_least(value: Column | str, threshold: float) -> Column:
    return F.avg((F.col(value) >= threshold).cast("double") if isinstance(value, str) else (value >= threshold).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def concentration(df: DataFrame, event: str, cluster: str, large: int = 50) -> DataFrame:
    """By event: items, clusters, the share of the largest one, three and five clusters, clusters of more than large items, and
    singletons with their share of the items.  Only counts of clusters are ranked."""
    sizes = df.groupBy(event, cluster).agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy(event).orderBy(F.col("n").desc(), cluster)))
    top = lambda k: F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)) / F.sum("n")
    single = F.count_if(F.col("n") == 1)
    return ranked.groupBy(event).agg(F.sum("n").alias("items"), F.count("*").alias("clusters"), *(top(k).alias(f"top_{k}") for k in (1, 3, 5)), F.count_if(F.col("n") > large).alias("large"), single.alias("singletons"), (single / F.sum("n")).alias("singleton_share"))


# Words that label no cluster.
LABEL_STOP = tuple(
    """the a an of in to and is are was were that this for on with as by it its from at be has have had not but or which their they he she his
    her who what how about article frames framing coverage news media""".split()
)


def composition(df: DataFrame, cluster: str, position: str, lang: str, text: str, *, examples: int = 10, reach: int = 200, opening: int = 100, words: int = 5, languages: int = 5, noise: int | None = -1) -> DataFrame:
    """cluster, size, share (of all items, noise included), top_languages (array of (language, n), ties to the one met first), keywords
    (the most frequent words of the first examples members' first reach characters, ties to the first met) and representative (the
    first member's first opening characters).  Members are numbered by position; a cluster named noise has no row."""
    from corpuslens.functions.text import keyword_tokens
    from corpuslens.operators.relational import top_per_group

    rows = df.select(F.col(cluster).alias("c"), F.col(position).cast("long").alias("p"), F.coalesce(lang, F.lit("??")).alias("l"), F.coalesce(text, F.lit("")).alias("t"))
    known = rows.where(F.col("c").isNotNull() & (F.lit(True) if noise is None else F.col("c") != noise))
    sizes = known.groupBy("c").agg(F.count("*").alias("size"))
    total = rows.agg(F.count("*").alias("_all"))
    spoken = most_common(known, ["c"], "l", "p", languages).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("rank", "l", "n"))).alias("a"))
    spoken = spoken.select("c", F.transform("a", lambda x: F.struct(x["l"].alias("language"), x["n"].alias("n"))).alias("top_languages"))
    first = top_per_group(known.withColumn("t", F.left("t", F.lit(max(reach, opening)))), ["c"], ["p"], examples, "_k")
    told = first.select("c", "_k", F.posexplode(keyword_tokens(F.left("t", F.lit(reach)), LABEL_STOP)).alias("at", "w")).withColumn("place", F.col("_k") * (1 << 32) + F.col("at"))
    keys = most_common(told, ["c"], "w", "place", words).groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("keywords"))
    shown = first.where("_k = 1").select("c", F.left("t", F.lit(opening)).alias("representative"))
    out = sizes.crossJoin(total).join(spoken, "c").join(shown, "c").join(keys, "c", "left")  # one row
    return out.select(F.col("c").alias(cluster), "size", (F.col("size") / F.col("_all")).alias("share"), "top_languages", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "representative")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group: one row a group and dimension is summed, combined before the shuffle."""
    parts = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))
