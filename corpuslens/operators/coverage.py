"""What a corpus covers and what is absent from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X

from .lexicon import match_terms

# Last names that are words, and what tells of an academic angle.
AMBIGUOUS_NAMES = ("church",)
ANGLE_TERMS = ("academic", "professor", "university", "scientist", "research", "mit media lab", "harvard", "yale", "stanford", "columbia", "guru", "wellness", "chopra", "spiritual")


def absence_report(registry: DataFrame, covered: DataFrame) -> DataFrame:
    """registry: region, country (a country may be in several regions).  region, present, absent, ratio for regions with a gap."""
    j = registry.join(covered.select("country", F.lit(1).alias("hit")).distinct(), "country", "left")
    g = j.groupBy("region").agg(F.count("hit").alias("present"), F.count_if(F.col("hit").isNull()).alias("absent"))
    return g.withColumn("ratio", F.col("present") / (F.col("present") + F.col("absent"))).where("absent > 0")


def distribution(df: DataFrame, dimension: str, name: str) -> DataFrame:
    return df.groupBy(F.col(dimension).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")


def suppression(documents: DataFrame, media: DataFrame, least: int = 10, low: float = 0.2) -> DataFrame:
    """name, docs, media, ratio and status: SUPPRESSED if documents name it at least `least` times and media never,
    UNDER-COVERED if media / docs is under low."""
    j = documents.join(media, "name", "left").withColumn("media", F.coalesce("media", F.lit(0)))
    ratio = F.col("media") / F.greatest("docs", F.lit(1))
    status = F.when((F.col("docs") >= least) & (F.col("media") == 0), "SUPPRESSED").when((F.col("docs") >= least) & (ratio < low), "UNDER-COVERED").otherwise("")
    return j.select("name", "docs", "media", ratio.alias("ratio"), status.alias("status"))


def amplified(ratio: Column, threshold: float = 2.0) -> Column:
    return F.when(ratio >= threshold, "AMPLIFIED").otherwise("")


def frame_share(docs: DataFrame, frames: DataFrame, total: int) -> DataFrame:
    """frames: frame, term.  Documents that hold any term of a frame, and their share."""
    held = match_terms(docs.select("doc_id", "text"), F.col("text"), frames.select("term", F.col("frame").alias("name")))
    hits = held.select("doc_id", F.explode(F.array_distinct("found.name")).alias("frame")).distinct()
    return hits.groupBy("frame").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(total))


def next_phase(counts: DataFrame) -> DataFrame:
    """First phase whose share is under its threshold (text 50 %, analysis 90 %, verdicts 90 %).  counts: total, texts, analysed, judged."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    phase = F.when(F.col("total") == 0, "ingest").when(share("texts", "total") < 0.5, "extract").when(share("analysed", "texts") < 0.9, "analyze").when(share("judged", "analysed") < 0.9, "council").otherwise("cluster")
    return counts.withColumn("next_phase", phase)


def entity_terms(entities: DataFrame, ambiguous: Sequence[str] = AMBIGUOUS_NAMES) -> DataFrame:
    """entities: ord, name, aliases.  (term, name): lowered names and aliases, and the last of several words of a name if it has over
    five characters and is not ambiguous; a term of several entities is the last one's, last names above all else."""
    name = F.lower("name")
    words = F.split(F.col("name"), r"\s+")
    last = F.lower(F.element_at(words, -1))
    full = entities.select("ord", "name", F.explode(F.concat(F.array(name), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))).alias("term"), F.lit(0).alias("phase"))
    short = entities.where((F.size(words) >= 2) & (F.length(last) > 5) & ~last.isin(*ambiguous)).select("ord", "name", last.alias("term"), F.lit(1).alias("phase"))
    return full.unionByName(short).groupBy("term").agg(F.max_by("name", F.struct("phase", "ord")).alias("name"))


def tag_entities(docs: DataFrame, terms: DataFrame, text: Column, angles: Sequence[str] = ANGLE_TERMS, **limits: int) -> DataFrame:
    """docs with entities (names of terms, a lexicon of any size, that the lowered text holds, sorted) and angle (does it hold an angle
    term?), where there are any."""
    tagged = match_terms(X.computed_once(docs, _text=text), F.col("_text"), terms, **limits).withColumn("entities", F.array_sort(F.array_distinct("found.name")))
    return X.computed_once(tagged, angle=F.coalesce(X.any_term("_text", angles), F.lit(False))).drop("_text", "found").where((F.size("entities") > 0) | F.col("angle"))


def entity_counts(tagged: DataFrame, key: str) -> DataFrame:
    """name, media: documents that mention each entity."""
    return tagged.select(key, F.explode("entities").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("media"))


def frame_ratio(docs: DataFrame, text: Column, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """left_docs, right_docs, ratio: documents that hold a term of either set; null if the right set is met nowhere."""
    g = docs.agg(F.count_if(X.any_term(text, left)).alias("left_docs"), F.count_if(X.any_term(text, right)).alias("right_docs"))
    return g.withColumn("ratio", F.col("left_docs") / F.nullif("right_docs", F.lit(0)))


def frame_summary(shares: DataFrame, names: DataFrame) -> DataFrame:
    """rank, frame, n, share, median_share: all named frames by how rarely they are met (never: 0), with the median of the shares."""
    from pyspark.sql import Window

    every = names.select("frame").distinct().join(shares, "frame", "left").fillna({"n": 0, "share": 0.0})
    rank = F.row_number().over(Window.orderBy("n", "frame")).cast("long")  # a few named questions
    return every.withColumn("rank", rank).crossJoin(every.agg(F.median("share").alias("median_share"))).select("rank", "frame", "n", "share", "median_share")


def dossier(contexts: DataFrame, lists: Sequence[str], samples: int = 3) -> DataFrame:
    """contexts: entity, level, ord, detail and the columns of lists.  entity, contexts, levels (array of (level, n, samples: the first
    details in order), most frequent first), and for each list its distinct non-empty values in order of appearance."""
    from corpuslens.operators.aggregates import distinct_in_order
    from corpuslens.operators.relational import top_per_group

    n = contexts.groupBy("entity", "level").agg(F.count("*").alias("n"))
    top = top_per_group(contexts.where("detail <> ''"), ["entity", "level"], ["ord"], samples)
    details = top.groupBy("entity", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "detail"))), lambda x: x["detail"]).alias("samples"))
    levels = n.join(details, ["entity", "level"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    order = F.struct((-F.col("n")).alias("k"), "level", "n", "samples")
    out = levels.groupBy("entity").agg(F.sum("n").alias("contexts"), F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["level"].alias("level"), x["n"].alias("n"), x["samples"].alias("samples"))).alias("levels"))
    for name in lists:
        found = distinct_in_order(contexts, ["entity"], name, "ord").withColumnRenamed("values", name)
        out = out.join(found, "entity", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
