"""Set-based forms of ingest and lookup: first wins, upserts, gap seeding, rounds, chunks, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinal, with_running_sum

DIRECT_WINDOWS = 100  # compared one by one
SLOTS = 1024  # parts of a block of times


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key, the first in order (first writer wins, latest row, preferred row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows of new to append: first of each key that existing does not have."""
    return first_per_key(new, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def upsert_greatest(existing: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return existing.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def upsert_last(existing: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Later tables win over earlier ones."""
    both = existing.select(*keys, *values, F.lit(0).alias("_seq")).unionByName(new.select(*keys, *values, F.lit(1).alias("_seq")))
    best = F.max_by(F.struct(*values), F.col("_seq")).alias("_v")
    return both.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def get_or_create(dimension: DataFrame, names: DataFrame, key: str, identity: str) -> DataFrame:
    """dimension plus a row for each new name, numbered after the largest identity in order of name.  Names are numbered within
    their first characters; only the counts of those meet in one task."""
    new = names.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti").withColumn("_p", F.left(key, F.lit(3)))
    placed = new.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = new.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_b"))
    start = dimension.agg(F.coalesce(F.max(identity), F.lit(0)).alias("_top"))
    numbered = placed.join(before, "_p").crossJoin(start)  # one row
    return dimension.select(identity, key).unionByName(numbered.select((F.col("_n") + F.col("_b") + F.col("_top")).cast("long").alias(identity), key))


def gaps(universe: DataFrame, covered: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Keys of universe that are neither covered nor recorded already."""
    return universe.select(key).distinct().join(covered.select(key), key, "left_anti").join(recorded.select(key), key, "left_anti")


def round_robin(df: DataFrame, group: str, position: str, cap: int, target: int | None = None) -> DataFrame:
    """Up to cap rows a group, dealt in rounds over groups in alphabetical order until target; unknown groups are left out.
    turn numbers the picks."""
    known = df.where(F.col(group).isNotNull() & ~F.lower(F.trim(group)).isin("", "unknown"))
    w = Window.partitionBy(group).orderBy(position)
    picked = known.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    if target is not None:
        picked = picked.orderBy("_rn", group).limit(target)
    return with_ordinal(picked, ["_rn", group, position], "turn").drop("_rn")


def suffix_duplicates(df: DataFrame, name: str, position: str) -> DataFrame:
    """The second and later rows of a name become 'name (2)', 'name (3)', ..."""
    rn = F.row_number().over(Window.partitionBy(name).orderBy(position))
    return df.withColumn("unique_name", F.when(rn > 1, F.concat(F.col(name), F.lit(" ("), rn.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def chunk_of(order: Sequence[str], size: int, *partition: str) -> Column:
    """Fixed-size chunks in order within each partition (see chunks for a whole table)."""
    if not partition:
        raise ValueError("name what parts the table, or use chunks()")
    return F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size).cast("long")


def chunks(df: DataFrame, order: Sequence[Column | str], size: int, name: str = "chunk") -> DataFrame:
    """df with fixed-size chunks 0, 1, 2 ... in order over the whole table, numbered by ranges."""
    return with_ordinal(df, order, "_place").withColumn(name, F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def at_positions(df: DataFrame, order: Sequence[Column | str], positions: DataFrame, name: str = "pos") -> DataFrame:
    """df's rows at positions (column pos, from 0, any number of them) of its order; positions beyond its end have no row."""
    return with_ordinal(df, order, "_place").withColumn(name, F.col("_place") - 1).drop("_place").join(positions.select(F.col("pos").cast("long").alias(name)).distinct(), name)


def circuit_breaker(df: DataFrame, key: str, order: Sequence[str], failed: Column, limit: int) -> DataFrame:
    """Rows up to the one at which a key has failed limit times in a row; streak counts failures so far."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    streaks = df.withColumn("_f", failed.cast("int")).withColumn("_i", island)
    run = Window.partitionBy(key, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    streaks = streaks.withColumn("streak", F.sum("_f").over(run))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.max((F.col("streak") >= limit).cast("int")).over(before), F.lit(0)) == 0
    return streaks.withColumn("_open", open_).where("_open").drop("_f", "_i", "_open")


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run has still to do: rows of work whose key has no result; a null key is never done."""
    return work.join(done.select(*keys).dropDuplicates(), list(keys), "left_anti")


def share_of_total(df: DataFrame, value: str, order: Sequence[Column | str]) -> DataFrame:
    """share and cumulative_share of a small aggregate's value."""
    total = F.sum(value).over(Window.partitionBy())
    run = F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("share", F.col(value) / total).withColumn("cumulative_share", run / total)


def assign_windows(df: DataFrame, ts: str, windows: DataFrame, *, every: bool = False, direct: int = DIRECT_WINDOWS) -> DataFrame:
    """Rows in half-open named windows [begins, ends), any number of them; a row in several gets the first listed (column ord), or with
    every is returned for each; rows in none go, and windows that end before they begin hold nothing.  A few windows become one expression.
    More are met by time alone for the first listed (first_windows).  For every one there is an interval join: a window is dealt to the one
    or two bins of its scale (the least power of two seconds that is no shorter) that it touches, a row to its bin of every scale that
    occurs, and what meets in a bin is compared; to count the rows of windows see window_counts."""
    listed = windows.where("begins < ends").select("begins", "ends", "window", "ord")
    if not every:
        few = listed.limit(direct + 1).collect()
        if len(few) > direct:
            return first_windows(df, ts, listed)
        out = F.lit(None).cast("string")
        for w in sorted(few, key=lambda w: w["ord"], reverse=True):
            out = F.when((F.col(ts) >= F.lit(w["begins"])) & (F.col(ts) < F.lit(w["ends"])), F.lit(w["window"])).otherwise(out)
        return df.withColumn("window", out).where(F.col("window").isNotNull())
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    scale = F.ceil(F.log2(F.greatest(second("ends") - second("begins"), F.lit(1.0)))).cast("int")
    bin_of = lambda seconds, k: F.floor(seconds / F.pow(F.lit(2.0), k)).cast("long")
    scaled = listed.withColumn("_k", scale)
    scales = sorted(r[0] for r in scaled.select("_k").distinct().collect())  # some sixty at most
    dealt = scaled.withColumn("_bin", F.explode(F.sequence(bin_of(second("begins"), F.col("_k")), bin_of(second("ends"), F.col("_k")))))
    rows = df.where(F.col(ts).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), second(ts).alias("_s"), F.col(ts).cast("timestamp").alias("_t"))
    rows = rows.withColumn("_k", F.explode(F.lit(scales).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_s"), F.col("_k")))
    met = rows.join(dealt, ["_k", "_bin"]).where((F.col("_t") >= F.col("begins")) & (F.col("_t") < F.col("ends")))
    return met.select("_row.*", "window")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def first_windows(df: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """df's rows with the name of the first listed window (begins, ends, window, ord) that holds them; rows in none go.

    No row meets a window.  A window is the union of two of length 2^k microseconds, one from its begin and one up to its end; each of those
    is the rest of one block of that length and the start of the next, so it holds a time in a block if that comes after its begin
    or before its end there.  The least of a block so far, from either side, is the answer.  Times that are equal are one row, a block
    has SLOTS slots, and least values run over a block's slots and inside a slot: a window is at most four rows, a time two for each scale."""
    k = F.floor(F.log2((F.col("e") - F.col("b")).cast("double"))).cast("int")
    spans = windows.select(_micros("begins").alias("b"), _micros("ends").alias("e"), F.struct("ord", "window").alias("w")).where("b < e").groupBy("b", "e").agg(F.min("w").alias("w"))
    spans = spans.withColumn("k", k).withColumn("k", F.when(F.pow(F.lit(2.0), "k").cast("long") > F.col("e") - F.col("b"), F.col("k") - 1).otherwise(F.col("k")))  # as the logarithm was rounded
    size = F.pow(F.lit(2.0), "k").cast("long")
    halves = spans.select("k", "w", F.explode(F.array("b", F.col("e") - size)).alias("b"), size.alias("size"))
    block = F.floor(F.col("b") / F.col("size")).cast("long")
    block = block - F.when(block * F.col("size") > F.col("b"), 1).when((block + 1) * F.col("size") <= F.col("b"), -1).otherwise(0)  # as the quotient was rounded
    halves = halves.withColumn("block", block)
    rest = F.struct(F.lit(False).alias("ends"), F.col("block").alias("block"), (F.col("b") - F.col("block") * F.col("size")).alias("at"))
    start = F.struct(F.lit(True).alias("ends"), (F.col("block") + 1).alias("block"), (F.col("b") - F.col("block") * F.col("size")).alias("at"))
    # from the left a begin holds the times at it and after it; from the right an end those before it, so places are turned round
    marks = halves.select("k", "w", "size", F.explode(F.array(rest, start)).alias("m")).where("not m.ends or m.at > 0")
    place = F.when(F.col("m.ends"), F.col("size") - F.col("m.at")).otherwise(F.col("m.at"))
    marks = marks.select("k", "m.ends", "m.block", place.alias("at"), "size", "w").groupBy("k", "ends", "block", "at", "size").agg(F.min("w").alias("w"))
    scales = sorted(r[0] for r in spans.select("k").distinct().collect())  # sixty-three at most
    times = df.where(F.col(ts).isNotNull()).select(_micros(ts).alias("t")).distinct()
    asked = times.select("t", F.explode(F.lit(scales).cast("array<int>")).alias("k")).withColumn("size", size).withColumn("b", F.col("t")).withColumn("block", block)
    into = F.col("t") - F.col("block") * F.col("size")
    asked = asked.select("t", "k", "block", "size", F.explode(F.array(F.struct(F.lit(False).alias("ends"), into.alias("at")), F.struct(F.lit(True).alias("ends"), (F.col("size") - 1 - into).alias("at")))).alias("m"))
    none = F.lit(None)
    both = marks.select("k", "ends", "block", "at", "size", "w", none.cast("long").alias("t")).unionByName(asked.select("k", "m.ends", "block", "m.at", "size", none.cast(marks.schema["w"].dataType).alias("w"), "t"))
    both = both.withColumn("slot", F.floor(F.col("at") / F.greatest(F.col("size") / SLOTS, F.lit(1.0))).cast("int"))
    inside = Window.partitionBy("k", "ends", "block", "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k", "ends", "block").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy("k", "ends", "block", "slot").agg(F.min("w").alias("w")).withColumn("earlier", F.min("w").over(before)).select("k", "ends", "block", "slot", "earlier")
    own = both.withColumn("own", F.min("w").over(inside)).where("t is not null").join(slots, ["k", "ends", "block", "slot"])
    found = own.groupBy("t").agg(F.min(F.least("own", "earlier")).alias("w")).where("w is not null").select("t", "w.window")
    return df.withColumn("_t", _micros(ts)).join(found.withColumnRenamed("t", "_t"), "_t").drop("_t")


def window_counts(df: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """window, n: how many rows of df the half-open windows (begins, ends, window) of a name hold; names that hold none are left out.  No row meets
    a window: begins, ends and times are numbered in one order, and a window holds the times before its end that are not before its begin."""
    spans = windows.where("begins < ends").select("window", F.explode(F.array(F.struct(_micros("begins").alias("at"), F.lit(-1).alias("sign")), F.struct(_micros("ends").alias("at"), F.lit(1).alias("sign")))).alias("m")).select("m.at", "m.sign", "window")
    spans = spans.groupBy("window", "at").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    times = df.where(F.col(ts).isNotNull()).groupBy(_micros(ts).alias("at")).agg(F.count("*").alias("n"))
    both = spans.select("at", "sign", "window", F.lit(0).cast("long").alias("n")).unionByName(times.select("at", F.lit(None).cast("long").alias("sign"), F.lit(None).cast(spans.schema["window"].dataType).alias("window"), "n"))
    placed = with_running_sum(both, ["at", F.col("sign").isNull()], "n", "before")  # borders come before times at the same instant
    counted = placed.where("sign is not null").groupBy("window").agg(F.sum(F.col("sign") * F.col("before")).alias("n"))
    return counted.where("n > 0")


def union_by_position(tables: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Concatenate feeds; the first feed, then the first row, wins a key."""
    tagged = [t.withColumn("_feed", F.lit(i)) for i, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_per_key(out, [key], ["_feed", order]).drop("_feed")


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns))
