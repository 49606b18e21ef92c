"""Language of a text by a model of character runs, learned from labelled texts; no word lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_LANGUAGE = 2000  # labelled rows learned from
HEAD = 1000  # characters looked at, as many as the original passes on
SHORT = 20
ROWS_AT_ONCE = 256  # a batch is looked at in so many rows: memory does not grow with its size
BUCKETS = 1 << 15
RUN = 3


@dataclass
class LanguageModel:
    """names of languages, and for each the log share of every bucket of runs (smoothed)."""

    names: list[str]
    logs: np.ndarray


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of RUN lowered characters, letters kept and all else one space."""
    bare = pa.compute.replace_substring_regex(pa.compute.utf8_lower(pa.compute.fill_null(texts, "")), r"[^\p{L}]+", " ")
    lines = pa.compute.binary_join_element_wise(" ", bare, " ", "").to_pylist()
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in lines], np.int64)
    of = np.repeat(np.arange(len(size)), size)
    if len(points) < RUN:
        return of[:0], of[:0]
    h = np.zeros(len(points) - RUN + 1, np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - RUN + 1 + k]
    h ^= h >> np.uint64(29)
    own = of[: len(h)] == of[RUN - 1 :]
    return of[: len(h)][own], (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)[own] % BUCKETS


def learn(labelled: DataFrame, text: str, lang: str, rows: int = ROWS_A_LANGUAGE, seed: int = 42) -> LanguageModel:
    """From the first rows texts of each language in an order of their hash.  Counts are a language's buckets: at most BUCKETS a language."""
    known = labelled.where(F.col(lang).isNotNull() & (F.length(text) >= SHORT)).select(F.col(lang).alias("lang"), F.left(text, F.lit(HEAD)).alias("text"))
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    n = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = (rows + 8 * rows**0.5 + 64) / F.col("n")  # a cut through the hashes, with room, before rows are ranked
    few = known.join(n, "lang").where(F.pmod("h", F.lit(1 << 32)) < share * float(1 << 32))
    picked = few.withColumn("k", F.expr("row_number() over (partition by lang order by h, text)")).where(F.col("k") <= rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(at, ROWS_AT_ONCE)
                of, bucket = _runs(b.column("text"))
                if not len(of):
                    continue
                names, code = np.unique(np.asarray(b.column("lang").to_pylist(), object), return_inverse=True)
                key, n = np.unique(code[of] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key // BUCKETS], pa.string()), pa.array(key % BUCKETS), pa.array(n)], names=["lang", "bucket", "n"])

    counts = picked.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), BUCKETS), 0.1)
    table[[names.index(x) for x in counts["lang"]], counts["bucket"]] += counts["n"]
    return LanguageModel(names, np.log(table / table.sum(axis=1, keepdims=True)))


def tell_all(texts: pd.Series, names: list[str], logs: np.ndarray, default: str) -> pd.Series:
    """The most probable language of each text, ROWS_AT_ONCE texts at a time."""
    out = np.full(len(texts), default, object)
    for at in range(0, len(texts) if names else 0, ROWS_AT_ONCE):
        some = texts.iloc[at : at + ROWS_AT_ONCE]
        of, bucket = _runs(pa.array(some, pa.string()))
        score = np.stack([np.bincount(of, logs[k][bucket], len(some)) for k in range(len(names))])
        held = np.bincount(of, minlength=len(some)) > 0
        out[at : at + len(some)][held] = np.asarray(names, object)[score.argmax(axis=0)[held]]
    return pd.Series(out)


def detect(df: DataFrame, text: str, model: LanguageModel, output: str = "language", default: str = "en") -> DataFrame:
    """df with the language whose model gives the first HEAD characters the largest probability; default for null texts, texts under
    SHORT characters without the space around them, texts without a letter, and a model without a language.  One narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast((model.names, model.logs.astype(np.float32)))

    @F.pandas_udf("string")
    def tell(texts: pd.Series) -> pd.Series:
        return tell_all(texts, *shared.value, default)

    told = tell(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(HEAD)))
    return df.withColumn(output, F.when(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < SHORT, F.lit(default)).otherwise(told))
