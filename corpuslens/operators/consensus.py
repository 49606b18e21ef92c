"""Agreement between several models' readings of an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import cosine

COUNCIL_THRESHOLD = 0.82
SEMANTIC_THRESHOLD = 0.75
SAMPLE_BANDS = (0.82, 0.65)


def reading_pairs(readings: DataFrame) -> DataFrame:
    """Pairs (ord_a < ord_b) of an article's readings with their similarity.  readings: article_id, ord, model, vector,
    confidence; an article has a handful of readings, so pairs stay few."""
    cols = ["ord", "model", "vector", "confidence"]
    a = readings.select("article_id", *(F.col(c).alias(f"{c}_a") for c in cols))
    b = readings.select("article_id", *(F.col(c).alias(f"{c}_b") for c in cols))
    pairs = a.join(b, "article_id").where("ord_a < ord_b")
    return pairs.withColumn("similarity", cosine("vector_a", "vector_b")).drop("vector_a", "vector_b")


def council(articles: DataFrame, readings: DataFrame, threshold: float = COUNCIL_THRESHOLD) -> DataFrame:
    """article_id, n_valid, level, consensus_model, dissenter.

    Three or more valid readings: high if all pairs reach the threshold (most confident model speaks), medium if any does
    (the first pair in order; its more confident member speaks, the first on a tie; the left-over reading dissents).  Two or
    more otherwise: contested.  One: low.  None: failed."""
    n = readings.groupBy("article_id").agg(F.count("*").alias("n_valid"), F.max_by("model", F.struct("confidence", -F.col("ord"))).alias("boldest"), F.sum("ord").alias("ords"), F.map_from_entries(F.collect_list(F.struct("ord", "model"))).alias("models"))
    close = F.col("similarity") >= threshold
    speaker = F.when(F.col("confidence_b") > F.col("confidence_a"), F.col("model_b")).otherwise(F.col("model_a"))
    p = reading_pairs(readings).groupBy("article_id").agg(F.bool_and(close).alias("all_close"), F.bool_or(close).alias("any_close"), F.min_by(F.when(close, F.struct(speaker.alias("speaker"), "ord_a", "ord_b")), F.when(close, F.struct("ord_a", "ord_b"))).alias("first"))
    j = articles.select("article_id").join(n, "article_id", "left").join(p, "article_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    level = F.when(F.col("n_valid") == 0, "failed").when(F.col("n_valid") == 1, "low").when((F.col("n_valid") >= 3) & F.col("all_close"), "high").when((F.col("n_valid") >= 3) & F.col("any_close"), "medium").otherwise("contested")
    j = j.withColumn("level", level)
    dissenter = F.when((F.col("level") == "medium") & (F.col("n_valid") == 3), F.try_element_at("models", F.col("ords") - F.col("first.ord_a") - F.col("first.ord_b")))
    return j.select("article_id", "n_valid", "level", F.when(F.col("level") == "high", F.col("boldest")).when(F.col("level") == "medium", F.col("first.speaker")).when(F.col("level") == "low", F.col("boldest")).alias("consensus_model"), dissenter.alias("dissenter"))


def verdict_rows(verdicts: DataFrame, readings: DataFrame) -> DataFrame:
    """One row for a consensus, one a model for a contested article (flagged for review)."""
    agreed = verdicts.where("level in ('high', 'medium')").select("article_id", F.col("consensus_model").alias("model"), F.lit(False).alias("needs_review"))
    open_ = verdicts.where("level = 'contested'").join(readings.select("article_id", "model"), "article_id").select("article_id", "model", F.lit(True).alias("needs_review"))
    return agreed.unionByName(open_)


def semantic_divergence(pairs: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """article_id, mean, least and level: high if all pairs reach the threshold, medium if half do, else contested."""
    near = F.avg((F.col("similarity") >= threshold).cast("double"))
    level = F.when(near == 1, "high").when(near >= 0.5, "medium").otherwise("contested")
    return pairs.groupBy("article_id").agg(F.avg("similarity").alias("mean"), F.min("similarity").alias("least"), level.alias("level"))


def banded(similarity: Column, bands: tuple[float, float] = SAMPLE_BANDS) -> Column:
    return F.when(similarity >= bands[0], "high").when(similarity >= bands[1], "medium").otherwise("contested")
