"""Agreement of labelings, stability of clusters, agreement of annotators, tests of association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.vectors import set_distance
from corpuslens.operators.graph import durable

MIN_COMMON = 5
CHUNK = 1000  # members of a cluster that meet at once
DIRECT_RUNS = 64  # compared column by column
LIST = 64  # members alike that meet at once
TASK_PAIRS = 1 << 22
MAX_TASKS = 1 << 13


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def contingency(runs: DataFrame) -> DataFrame:
    """run_a < run_b, labels, and the number of items that both place so.  runs: run, item, label (one label an item)."""
    a = runs.select("item", F.col("run").alias("run_a"), F.col("label").alias("label_a"))
    b = runs.select("item", F.col("run").alias("run_b"), F.col("label").alias("label_b"))
    return a.join(b, "item").where("run_a < run_b").groupBy("run_a", "run_b", "label_a", "label_b").agg(F.count("*").alias("n"))


def run_agreement(runs: DataFrame) -> DataFrame:
    """run_a, run_b, common, ari, nmi of every two runs with at least MIN_COMMON common items.  ari is 1 where chance allows
    nothing else; nmi divides by the mean entropy and is 1 if both are 0."""
    c = contingency(runs)
    k = ["run_a", "run_b"]
    rows = c.groupBy(*k, "label_a").agg(F.sum("n").alias("x")).groupBy(*k).agg(F.sum(_pairs(F.col("x"))).alias("sa"), F.sum(F.col("x") * F.ln("x")).alias("ha"))
    cols = c.groupBy(*k, "label_b").agg(F.sum("n").alias("x")).groupBy(*k).agg(F.sum(_pairs(F.col("x"))).alias("sb"), F.sum(F.col("x") * F.ln("x")).alias("hb"))
    cells = c.groupBy(*k).agg(F.sum("n").alias("common"), F.sum(_pairs(F.col("n"))).alias("sab"), F.sum(F.col("n") * F.ln("n")).alias("hab"))
    j = cells.join(rows, k).join(cols, k).where(F.col("common") >= MIN_COMMON)
    n = F.col("common")
    expected = F.col("sa") * F.col("sb") / _pairs(n)
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    ari = F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("sab") - expected) / top)
    # entropies times n: n ln n - sum x ln x
    ea, eb = n * F.ln(n) - F.col("ha"), n * F.ln(n) - F.col("hb")
    shared = n * F.ln(n) - F.col("ha") - F.col("hb") + F.col("hab")
    nmi = F.when(F.abs(ea + eb) < 1e-12, 1.0).otherwise(F.greatest(shared, F.lit(0.0)) / ((ea + eb) / 2))
    return j.select(*k, "common", ari.alias("ari"), nmi.alias("nmi"))


def agreement_wording(ari: Column) -> Column:
    return F.when(ari > 0.6, "strong").when(ari > 0.3, "moderate").otherwise("weak")


def cluster_stability(a: DataFrame, b: DataFrame, stable: float = 0.5) -> DataFrame:
    """For each label of run a (item, label): common members, modal destination in b, its share, and whether it is stable."""
    c = a.select("item", F.col("label")).join(b.select("item", F.col("label").alias("to")), "item").groupBy("label", "to").agg(F.count("*").alias("n"))
    g = c.groupBy("label").agg(F.sum("n").alias("common"), F.max_by("to", F.struct("n", -F.col("to"))).alias("destination"), F.max("n").alias("top"))
    share = F.col("top") / F.col("common")
    return g.select("label", "common", "destination", share.alias("share"), (share >= stable).alias("stable"))


def cooccurrence(reference: DataFrame, runs: DataFrame, chunk: int = CHUNK, direct: int = DIRECT_RUNS, digits: int | None = None) -> DataFrame:
    """Within clusters of reference (item, label): how often two members that a run both samples land together.
    Only pairs of one reference cluster are formed, never all items by all items.  runs: an item once a run at most.  digits: the rate is
    rounded to so many.

    The members of a cluster are dealt into chunks of about chunk rows, and every two chunks meet once.  Members of a chunk that all runs
    treat alike are rows of LIST members at most; two such rows are compared once, and their lists give the pairs, which are not shuffled.
    The work grows with pairs and not with bytes, so the number of tasks does too."""
    r = reference.select("item", F.col("label").alias("cluster"))
    known = runs.where("run is not null").join(r, "item").where("cluster is not null")
    names = [x[0] for x in known.select("run").distinct().orderBy("run").limit(direct + 1).collect()]
    if len(names) <= direct:  # a column a run
        marks = F.struct(*(F.struct(F.max(F.when(F.col("run") == x, True)).alias("in"), F.max(F.when(F.col("run") == x, F.col("label"))).alias("label")).alias(f"r{k}") for k, x in enumerate(names)), F.lit(0).alias("end"))
        count = lambda test: sum((F.when(test(f"r{k}"), 1).otherwise(0) for k in range(len(names))), F.lit(0)).cast("long")
        sampled, same = count(lambda k: F.col(f"mi.{k}.in") & F.col(f"mj.{k}.in")), count(lambda k: F.col(f"mi.{k}.label") == F.col(f"mj.{k}.label"))
    else:
        marks = F.array_sort(F.collect_list(F.struct("run", "label")))
        both = F.array_intersect(F.map_keys("mi"), F.map_keys("mj"))
        sampled, same = F.size(both).cast("long"), F.size(F.filter(both, lambda k: F.col("mi")[k] == F.col("mj")[k])).cast("long")
    each = durable(known.groupBy("cluster", "item").agg(marks.alias("marks")))
    sizes = each.groupBy("cluster").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(_pairs(F.col("n")))).first()[0] or 0
    tasks = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, int(pairs // TASK_PAIRS)))
    dealt = each.join(sizes.select("cluster", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "cluster")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")).repartition("cluster", "own")
    alike = dealt.groupBy("cluster", "chunks", "own", "marks").agg(F.sort_array(F.collect_list("item")).alias("items"))
    lists = F.transform(F.sequence(F.lit(1), F.size("items"), F.lit(LIST)), lambda k: F.slice("items", k, LIST))
    alike = alike.select("cluster", "chunks", "own", "marks" if len(names) <= direct else F.map_from_entries("marks").alias("marks"), F.explode(lists).alias("items")).withColumn("first", F.col("items")[0])
    a = alike.withColumn("d", F.explode(F.sequence("own", F.col("chunks") - 1))).select("cluster", F.col("own").alias("c"), "d", F.col("first").alias("fi"), F.col("marks").alias("mi"), F.col("items").alias("xs"))
    b = alike.withColumn("c", F.explode(F.sequence(F.lit(0), "own"))).select("cluster", "c", F.col("own").alias("d"), F.col("first").alias("fj"), F.col("marks").alias("mj"), F.col("items").alias("ys"))
    key = ["cluster", "c", "d"]
    met = a.repartition(tasks, *key).join(b.repartition(tasks, *key), key).where("c < d or fi <= fj")
    met = met.select("cluster", "xs", "ys", ((F.col("c") == F.col("d")) & (F.col("fi") == F.col("fj"))).alias("self"), sampled.alias("sampled"), same.alias("together")).where("sampled > 0")
    rate = F.col("together") / F.col("sampled")
    met = met.withColumn("rate", rate if digits is None else F.round(rate, digits))
    p = met.withColumn("x", F.explode("xs")).drop("xs").withColumn("y", F.explode("ys")).where("not self or x < y")
    return p.select("cluster", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "sampled", "together", "rate")


def label_vectors(reference: DataFrame, runs: DataFrame) -> DataFrame:
    """cluster, vector (a map run → label), items, n: members of a reference cluster that every run treats alike are one row."""
    r = reference.select("item", F.col("label").alias("cluster"))
    each = runs.join(r, "item").groupBy("cluster", "item").agg(F.sort_array(F.collect_list(F.struct("run", "label"))).alias("vector"))
    return each.groupBy("cluster", "vector").agg(F.count("*").alias("n"))


def hard_core(reference: DataFrame, runs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """cluster, n, mean_rate, core: members whose mean rate of landing with the others (over runs that sample both) reaches the
    threshold.  Members are paired by what the runs make of them, not one by one: pairs of vectors carry the pairs of members."""
    v = label_vectors(reference, runs).withColumn("m", F.map_from_entries("vector")).withColumn("id", F.xxhash64("cluster", "vector"))
    a, b = v.select("cluster", F.col("id").alias("x"), F.col("m").alias("mx"), F.col("n").alias("nx")), v.select("cluster", F.col("id").alias("y"), F.col("m").alias("my"), F.col("n").alias("ny"))
    shared = F.array_intersect(F.map_keys("mx"), F.map_keys("my"))
    p = a.join(b, "cluster").where((F.col("x") != F.col("y")) | (F.col("nx") > 1)).withColumn("s", shared).where(F.size("s") > 0)
    others = F.when(F.col("x") == F.col("y"), F.col("ny") - 1).otherwise(F.col("ny"))
    p = p.withColumn("rate", F.size(F.filter("s", lambda r: F.col("mx")[r] == F.col("my")[r])) / F.size("s")).withColumn("others", others)
    members = p.groupBy("cluster", "x", "nx").agg((F.sum(F.col("rate") * F.col("others")) / F.sum("others")).alias("mean"), F.sum(F.col("rate") * F.col("others")).alias("rates"), F.sum("others").alias("pairs"))
    core = F.sum(F.when(F.round("mean", 9) >= threshold, F.col("nx")).otherwise(0))
    g = members.groupBy("cluster").agg(F.sum("nx").alias("n"), (F.sum(F.col("rates") * F.col("nx")) / F.sum(F.col("pairs") * F.col("nx"))).alias("mean_rate"), core.alias("core"))
    return g.select("cluster", "n", "mean_rate", "core")


def cooccurrence_statistics(runs: DataFrame) -> DataFrame:
    """pairs, mean, std (ddof 0) and median of the rates of landing together (over runs that sample both) of all pairs of items, whatever
    their cluster, whose rate is not 0.  runs: run, item, label, an item once a run at most.

    Items that the runs treat alike are one vector with their number; only vectors that share a label in some run meet, and carry
    the products of their numbers.  Rates are fractions of run counts, so the weights of the few different ones tell everything."""
    each = runs.where("label is not null").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("vector"))
    v = durable(each.groupBy("vector").agg(F.count("*").alias("n")).withColumn("x", F.xxhash64("vector")))
    marks = v.select("x", "n", F.col("vector.run").alias("all"), F.inline("vector"))
    right = marks.select("run", "label", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("all").alias("ally"))
    met = marks.join(right, ["run", "label"]).where("x <= y").groupBy("x", "y").agg(F.count("*").alias("together"), F.first("n").alias("nx"), F.first("ny").alias("ny"), F.first(F.size(F.array_intersect("all", "ally"))).alias("sampled"))
    weight = F.when(F.col("x") == F.col("y"), F.col("nx") * (F.col("nx") - 1) / 2).otherwise(F.col("nx") * F.col("ny")).cast("long")
    rates = met.select((F.col("together") / F.col("sampled")).alias("rate"), weight.alias("w")).groupBy("rate").agg(F.sum("w").alias("w")).where("w > 0")
    run = F.sum("w").over(Window.orderBy("rate"))  # as many rows as there are fractions of run counts
    total = F.sum("w").over(Window.partitionBy())
    placed = rates.select("rate", "w", run.alias("upto"), total.alias("all"))
    mean = F.sum(F.col("rate") * F.col("w")) / F.sum("w")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("rate")))
    median = (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor((F.col("all") + 2) / 2))) / 2
    square = F.sum(F.col("rate") * F.col("rate") * F.col("w")) / F.sum("w")
    return placed.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), median.alias("median"))


def perturbation_stability(baseline: DataFrame, runs: DataFrame, n_runs: int) -> DataFrame:
    """cluster, n, stability: how often two members of a baseline cluster (item, label) share a label in the runs over noisy vectors
    (run, item, label), all pairs over n_runs; 1 for a cluster of one.  Pairs are counted from the sizes of the parts, not formed."""
    b = baseline.select("item", F.col("label").alias("cluster"))
    size = b.groupBy("cluster").agg(F.count("*").alias("n"))
    parts = runs.join(b, "item").groupBy("cluster", "run", "label").agg(F.count("*").alias("k"))
    together = parts.groupBy("cluster").agg(F.sum(_pairs(F.col("k"))).alias("t"))
    rate = F.coalesce("t", F.lit(0.0)) / (_pairs(F.col("n")) * n_runs)
    return size.join(together, "cluster", "left").select("cluster", "n", F.when(F.col("n") < 2, 1.0).otherwise(rate).alias("stability"))


def cluster_jaccard(runs: DataFrame, zeros: bool = False) -> DataFrame:
    """Jaccard of member sets of every two clusters of two runs that share members; with zeros also of those that share none (as many
    rows as two runs have pairs of labels)."""
    c = contingency(runs)
    size = runs.groupBy("run", "label").agg(F.count("*").alias("size"))
    a, b = size.toDF("run_a", "label_a", "size_a"), size.toDF("run_b", "label_b", "size_b")
    if zeros:
        keys = ["run_a", "run_b", "label_a", "label_b"]
        j = a.join(b, F.col("run_a") < F.col("run_b")).join(c, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        j = c.join(a, ["run_a", "label_a"]).join(b, ["run_b", "label_b"])
    return j.select("run_a", "run_b", "label_a", "label_b", (F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))).alias("jaccard"))


def best_pair(runs: DataFrame, order: str = "run") -> DataFrame:
    """run_a, run_b, common of the two runs with most common items; of equal ones the first pair in order."""
    common = contingency(runs).groupBy("run_a", "run_b").agg(F.sum("n").alias("common"))
    return common.orderBy(F.desc("common"), f"{order}_a", f"{order}_b").limit(1)


def krippendorff_nominal(annotations: DataFrame) -> DataFrame:
    """items, observed and expected disagreement and alpha over items with two or more labels (annotations: item, label).
    Coincidences are counted from label counts of an item, so no pairs are formed."""
    per = annotations.where("label is not null").groupBy("item", "label").agg(F.count("*").alias("c"))
    m = per.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m >= 2")
    within = m.agg(F.count("*").alias("items"), F.sum("m").alias("n"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("unlike"))
    totals = per.join(m.select("item"), "item").groupBy("label").agg(F.sum("c").alias("t"))
    pooled = totals.agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("like"))
    j = within.crossJoin(pooled)  # one row each
    n = F.col("n")
    observed, expected = F.col("unlike") / n, (n * (n - 1) - F.col("like")) / (n * (n - 1))
    return j.where("items >= 5").select("items", observed.alias("observed"), expected.alias("expected"), F.when(expected == 0, 1.0).otherwise(1 - observed / expected).alias("alpha"))


def alpha_sets(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Alpha with the set distance: observed over pairs not both empty, expected over all pairs of pooled non-empty sets.

    The distance depends on the sizes of two sets and of what they share, and is 1 unless they share an element.  So only distinct
    sets that share one meet (by element, a set under each of its own), and pairs that share none are what is left of all pairs."""
    observed = pairs.where((F.size(a) > 0) | (F.size(b) > 0)).agg(F.avg(set_distance(a, b)).alias("observed"))
    pooled = pairs.select(F.array_sort(F.array_distinct(a)).alias("s")).unionByName(pairs.select(F.array_sort(F.array_distinct(b)).alias("s"))).where(F.size("s") > 0).groupBy("s").agg(F.count("*").alias("c"))
    x = pooled.select(F.col("s").alias("x"), F.col("c").alias("cx"), F.explode("s").alias("e"))
    y = x.select(F.col("x").alias("y"), F.col("cx").alias("cy"), "e")
    least = F.element_at(F.array_sort(F.array_intersect("x", "y")), 1)  # two sets meet once, under the least element they share
    met = x.join(y, "e").where((F.col("x") < F.col("y")) & (F.col("e") == least))
    apart = met.agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("near"), F.coalesce(F.sum(F.col("cx") * F.col("cy") * set_distance("x", "y")), F.lit(0.0)).alias("d"))
    every = pooled.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0)).alias("same"))
    n = F.col("n")
    total = n * (n - 1) / 2
    expected = (F.col("d") + total - F.col("same") - F.col("near")) / F.nullif(total, F.lit(0.0))
    j = observed.crossJoin(apart).crossJoin(every).select("observed", expected.alias("expected"))  # one row each
    return j.withColumn("alpha", F.when(F.coalesce("expected", F.lit(0.0)) == 0, 1.0).otherwise(1 - F.col("observed") / F.col("expected")))


def alpha_wording(alpha: Column) -> Column:
    return F.when(alpha >= 0.67, "substantial").when(alpha >= 0.33, "moderate").otherwise("slight")


def pooled_t(df: DataFrame, value: str, flag: str) -> DataFrame:
    """n0, n1, means, pooled t and point-biserial r of value by a 0/1 flag; null unless both classes occur."""
    z = lambda k: F.when(F.col(flag) == k, F.col(value))
    g = df.agg(*(f(z(k)).alias(f"{name}{k}") for k in (0, 1) for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))), F.corr(F.col(value).cast("double"), F.col(flag).cast("double")).alias("r"))
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = ((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / (n0 + n1 - 2)
    t = (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / n0 + 1 / n1))
    ok = (n0 > 1) & (n1 > 1)
    return g.select("n0", "n1", "m0", "m1", F.when(ok, t).alias("t"), F.when(ok, F.col("r")).alias("r"))


def association_p(df: DataFrame, value: str, flag: str) -> float | None:
    """Two-sided p of the pooled t test (equally of the point-biserial correlation), by a least-squares fit."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(F.col(value).cast("double").alias("y"), F.col(flag).cast("double").alias("x")).dropna()
    if rows.select("x").distinct().count() < 2:
        return None
    fit = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    return float(fit.summary.pValues[0])
