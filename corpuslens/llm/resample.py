"""Operator 13: importance resampling towards a target distribution, by external sort and count.

1. One pass hashes every document's features (runs of 1 to max_words consecutive words) into buckets and writes them as
   packed streams of uint16, one a piece of a few megabytes of text, with the offset of each document.
2. A second pass reads the streams only: each is sorted and run-length encoded, a task adds its runs up, and the tasks'
   counts are summed by bucket.  Both texts and target become one number a bucket, which is all that the driver sees.
3. A third pass gathers each stream's gains and sums them by document with np.add.reduceat.
4. Documents are drawn without replacement by the largest weight plus Gumbel noise of their id.  Weights are bounded by the
   gains, so scores are few different integers: their counts give the score at which the draw ends; only documents at or above it are
   numbered, by ranges.

Defined cases: null text has no words, weight 0 and no chance to be drawn if min_words is above 0; a null id counts as the
text '' in its noise and comes last among ties; repeated rows are documents of their own (rows equal in score, id, weight and
features share out their ranks); texts of any length are whole, one text is never cut; an empty table, or an empty target, gives
counts of zero; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.ordinals import with_ordinal

from .common import durable, pieces, trimmed, words_of

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024

#: all of ASCII but digits and small letters parts words
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = False

_STREAMS = "ids array<long>, n_words array<long>, offsets array<long>, stream binary"


def _crc32(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint32, len(words))


def feature_buckets(texts: pa.Array, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, document by document; offsets of the documents; words of each)."""
    w = words_of(texts, lower=True, breaks=BREAKS)
    ids, words = w.distinct()
    doc = w.doc_of()
    found, of = [(_crc32(words) % buckets).astype(np.uint16)[ids]], [doc]
    runs = words.take(pa.array(ids)) if max_words > 1 else None
    for k in range(1, min(max_words, len(doc))):  # runs of k + 1 words; those that cross documents go
        runs = pc.binary_join_element_wise(runs.slice(0, len(doc) - k), words.take(pa.array(ids[k:])), pa.scalar(b" ", runs.type))
        inside = doc[k:] == doc[:-k]
        coded = runs.dictionary_encode()
        found.append((_crc32(coded.dictionary) % buckets).astype(np.uint16)[coded.indices.to_numpy(zero_copy_only=False)][inside])
        of.append(doc[k:][inside])
    if len(of) > 1:
        stream, doc = np.concatenate(found), np.concatenate(of)
        stream = stream[np.argsort(doc, kind="stable")]
    else:
        stream = found[0]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n_docs))]).astype(np.int64)
    return stream, offsets, w.per_doc


def bucket_streams(docs: DataFrame, max_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """From docs (doc_id long, text string), written in the shared folder: a row a piece of documents, with their packed buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "text"):
                stream, offsets, n_words = feature_buckets(p.column("text"), max_words, buckets)
                row = [p.column("doc_id").to_pylist()], [n_words], [offsets], [stream.astype("<u2").tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.list_(pa.int64())) for x in row[:3]), pa.array(row[3], pa.binary())], names=["ids", "n_words", "offsets", "stream"])

    return durable(docs.mapInArrow(trimmed(pack), _STREAMS))


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all streams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column("stream"):
                runs = np.sort(np.frombuffer(blob.as_py(), "<u2"))
                if len(runs):
                    lead = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
                    total[runs[lead]] += np.diff(np.append(lead, len(runs)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in target / smoothed share in source)) of each bucket."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_source + n) / ((float(s) + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean of the gains of its features) of every document of the streams."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_words, offsets = (batch.column(c)[k].values for c in ("ids", "n_words", "offsets"))
                offsets = offsets.to_numpy()
                n = np.diff(offsets)
                held, total = n > 0, np.zeros(len(n), np.int64)
                if held.any():
                    total[held] = np.add.reduceat(gains[np.frombuffer(batch.column("stream")[k].as_py(), "<u2")], offsets[:-1][held])
                yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(trimmed(gather), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int):
    """floor(1000 times the Gumbel variate of an id); the id's hash is the source of its randomness."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, max_words: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document: doc_id, n_words, n_features, weight, score and rank (1, 2, 3 ... of those drawn, else null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    streams = bucket_streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), max_words, buckets)
    wanted = bucket_streams(target.select(F.lit(None).cast("long").alias("doc_id"), text), max_words, buckets)
    gains = gains_of(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    scored = durable(weigh(streams, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed)))
    may = F.col("n_words") >= min_words
    # scores are integers between the least gain plus the least noise and the largest plus the largest: a bounded number
    counts = sorted(((r.score, r.n) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    n_drawn = percent * sum(n for _, n in counts) // 100
    cut, seen = None, 0
    for score, n in counts:
        if seen >= n_drawn:
            break
        cut, seen = score, seen + n
    inside = may & (F.col("score") >= cut) if cut is not None else F.lit(False)
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").asc()]
    ranked = with_ordinal(scored.where(inside), by, "rank").withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
