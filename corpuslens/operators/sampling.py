"""Seeded samples by hash order: no generator state, the same rows on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int = 42) -> Column:
    """md5 of seed and key: an order that SQL engines share."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def _first_hashes(df: DataFrame, group: str, key: str, wanted: DataFrame, seed: int) -> DataFrame:
    """Rows of df that can be among the first wanted (columns group, _n rows in all, _q of them) of their group in hash order: a cut
    through the hashes that a group's first _q stay under with room to spare leaves few rows to rank."""
    room = F.col("_q") + 8 * F.sqrt(F.col("_q").cast("double")) + 64
    most = F.least(room / F.col("_n") * float(1 << 32), F.lit(float(1 << 32)))
    h = hash_order(key, seed)
    head = F.conv(F.left(h, F.lit(8)), 16, 10).cast("double")
    return df.withColumn("_h", h).join(wanted.withColumn("_most", most), group).where(head < F.col("_most")).drop("_most")


def stratified(df: DataFrame, stratum: str, key: str, target: int, seed: int = 42, slack: float = 1.1) -> DataFrame:
    """max(1, round half even(share * target)) rows a stratum, at most all of it; if many small strata make that more than slack * target
    rows, only target of them stay, the first in an order of their hash that the strata do not share.  Rows are cut by a threshold of
    their hash before they are ranked, and where a cut was too tight the stratum is ranked whole."""
    n = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    quota = n.crossJoin(total).select(stratum, "_n", F.least(F.greatest(F.bround(F.col("_n") / F.col("_all") * target), F.lit(1)), F.col("_n")).cast("long").alias("_q"))
    sample = _ranked(df, stratum, key, quota, seed).drop("_r", "_q", "_h")
    if (quota.agg(F.sum("_q")).first()[0] or 0) <= target * slack:
        return sample
    return sample.orderBy(F.md5(F.concat(F.lit(f"trim:{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(target)


def _ranked(df: DataFrame, group: str, key: str, quota: DataFrame, seed: int) -> DataFrame:
    """df's first _q rows of each group by hash, with _r, _q and _h."""
    w = Window.partitionBy(group).orderBy("_h", key)
    few = _first_hashes(df, group, key, quota, seed).withColumn("_r", F.row_number().over(w)).where("_r <= _q").drop("_n")
    short = quota.join(few.groupBy(group).agg(F.count("*").alias("_got")), group, "left").where("coalesce(_got, 0) < _q").select(group, "_q")
    whole = df.withColumn("_h", hash_order(key, seed)).join(short, group).withColumn("_r", F.row_number().over(w)).where("_r <= _q")
    return few.join(short.select(group), group, "left_anti").unionByName(whole.select(few.columns))


def priority(df: DataFrame, key: str, level: str, language: str, size: int, seed: int = 42, least_foreign: float = 0.3) -> DataFrame:
    """40 % contested, 30 % medium, the rest filled, then the last English picks give way to unpicked others until
    least_foreign of the sample is not English.  Every step is a limit in hash order, so no more than size rows a partition and step
    are moved."""
    h = df.withColumn("_h", hash_order(key, seed))
    first = lambda d, n: d.orderBy("_h", key).limit(n)
    contested = first(h.where(F.col(level) == "contested"), int(size * 0.4)).withColumn("_t", F.lit(0))
    medium = first(h.where(F.col(level) == "medium"), int(size * 0.3)).withColumn("_t", F.lit(1))
    tiers = contested.unionByName(medium)
    rest = first(h.join(F.broadcast(tiers.select(key)), key, "left_anti"), size).withColumn("_t", F.lit(2))
    picked = tiers.unionByName(rest).orderBy("_t", "_h", key).limit(size)
    foreign = F.col(language) != "en"
    need = picked.agg(F.greatest(F.ceil(F.count("*") * least_foreign) - F.count_if(foreign), F.lit(0)).alias("_need"))
    spare = first(h.join(F.broadcast(picked.select(key)), key, "left_anti").where(foreign), size).withColumn("_t", F.lit(2))
    numbered = lambda d, order: d.withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    incoming = numbered(spare, ["_h", key]).crossJoin(need).where("_k <= _need")
    count = incoming.agg(F.count("*").alias("_in"))
    leaving = numbered(picked.where(~foreign), [F.col("_t").desc(), F.col("_h").desc(), key]).crossJoin(count).where("_k <= _in")
    return picked.join(leaving.select(key), key, "left_anti").select(df.columns).unionByName(incoming.select(df.columns))
