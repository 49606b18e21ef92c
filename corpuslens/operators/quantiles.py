"""Exact quantiles of groups of any size, many at once, by narrowing: a percentile that buffers a group's values is for small groups.

Every wanted rank of a group keeps an interval that holds its value.  A pass cuts the interval at approximate quantiles of the
values inside, counts the values between the cuts, and keeps the piece in which the rank falls, until a piece holds one value.  So a
pass keeps about one value in BINS, whatever the distribution, and what a group needs is a sketch and BINS counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable

BINS = 128
MAX_PASSES = 64


def exact_quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """group, share, n, quantile: linearly interpolated between neighbours, as percentile() gives it.  Null values do not count; groups
    without a value have no row; a null group is a group."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = durable(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    asked = sizes.select("g", "n", F.explode(F.lit([float(s) for s in shares]).cast("array<double>")).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    ranks = asked.select("g", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    now = durable(ranks.join(sizes.select("g", "lo", "hi"), ranks["g"].eqNullSafe(sizes["g"])).select(ranks["g"], "rank", "lo", "hi", F.lit(0).cast("long").alias("below")))
    done = now.where("lo = hi")
    now = now.where("lo < hi")
    for _ in range(MAX_PASSES):
        if not now.limit(1).count():
            break
        spans = now.select(F.col("g").alias("h"), "lo", "hi", "below").distinct()
        inside = rows.join(spans, rows["g"].eqNullSafe(spans["h"]) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("h")
        cuts = inside.groupBy("g", "lo", "hi", "below").agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 50 * bins).alias("cuts"))
        cuts = durable(cuts.withColumn("cuts", F.array_distinct("cuts")).withColumnRenamed("g", "h"))
        cut = rows.join(cuts, rows["g"].eqNullSafe(cuts["h"]) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("h")
        # twice the cuts below, and one more on a cut, so that a value that is a cut is a piece of its own
        under = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        piece = 2 * under + F.coalesce(F.get("cuts", under) == F.col("v"), F.lit(False)).cast("int")
        counts = cut.groupBy("g", "lo", "hi", "below", piece.alias("piece")).agg(F.count("*").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        run = Window.partitionBy("g", "lo", "hi", "below").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("end", F.col("below") + F.sum("c").over(run)).withColumn("begin", F.col("end") - F.col("c")).withColumnRenamed("g", "h").drop("below")
        then = now.drop("below").join(counts, now["g"].eqNullSafe(F.col("h")) & (now["lo"] == counts["lo"]) & (now["hi"] == counts["hi"]) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")))
        then = durable(then.select("g", "rank", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("begin").alias("below")))
        done = done.unionByName(then.where("lo = hi"))
        now = then.where("lo < hi")
    else:
        raise RuntimeError("quantiles did not settle")
    found = durable(done.select(F.col("g").alias("h"), "rank", F.col("lo").alias("x")))
    low, high = (found.select(F.col("h").alias(f"h{k}"), F.col("rank").alias(f"r{k}"), F.col("x").alias(f"x{k}")) for k in (0, 1))
    both = asked.join(low, F.col("g").eqNullSafe(F.col("h0")) & (F.floor("at") == F.col("r0"))).join(high, F.col("g").eqNullSafe(F.col("h1")) & (F.ceil("at") == F.col("r1")))
    part = F.col("at") - F.floor("at")
    return both.select(F.col("g").alias(group), "share", "n", F.when(part == 0, F.col("x0")).otherwise((F.ceil("at") - F.col("at")) * F.col("x0") + part * F.col("x1")).alias("quantile"))
