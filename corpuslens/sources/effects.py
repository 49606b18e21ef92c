"""Seams for models outside the engine.  Each takes a client (a picklable callable on a batch of strings) and has a
deterministic stand-in.  Write what an effect returns before using it twice: tasks can run again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[Sequence[str]], Sequence[str | None]]


def complete(df: DataFrame, prompt: str, client: Client, attempts: int = 2, output: str = "answer") -> DataFrame:
    """Answers to prompts, a partition's batches at a time.  A batch that fails after the last attempt is halved until the failing
    prompts stand alone; those are answered by None."""
    fields = df.schema

    def ask(prompts: list[str]) -> list[str | None]:
        for _ in range(attempts):
            try:
                return list(client(prompts))
            except Exception:  # noqa: BLE001, S112  a client may raise anything
                continue
        if len(prompts) < 2:
            return [None] * len(prompts)
        mid = len(prompts) // 2
        return ask(prompts[:mid]) + ask(prompts[mid:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{output: ask(b[prompt].tolist())})

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{output} string"]))


def echo_client(prompts: Sequence[str]) -> list[str]:
    """A stand-in: a JSON object with a digest of the prompt."""
    return ['{"primary_frame": "%s"}' % hashlib.md5((p or "").encode()).hexdigest()[:8] for p in prompts]


def embed(df: DataFrame, text: str, dims: int = 64, output: str = "embedding") -> DataFrame:
    """Hashed character trigrams, unit length: a stand-in for a sentence encoder.  A batch is one array of code points."""

    @F.pandas_udf("array<double>")
    def vector(s: pd.Series) -> pd.Series:
        padded = ["  " + t.lower() + " " for t in s]
        points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(t) for t in padded], np.int64)
        row = np.repeat(np.arange(len(s)), size)
        h = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        own = row[:-2] == row[2:]
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        v = np.bincount((row[:-2] * dims + (h % np.uint64(dims)).astype(np.int64))[own], sign[own], len(s) * dims).reshape(len(s), dims)
        return pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return df.withColumn(output, vector(F.coalesce(text, F.lit(""))))


#: what a speech model returns for a recording
TRANSCRIPT = "key string, transcript string, language string, confidence double, minutes double"


def transcribe(audio: DataFrame, url: str, client: Callable[[str], dict | None], cache: DataFrame | None = None) -> DataFrame:
    """Transcripts of recordings, one row a distinct address: key (md5 of the address), transcript, language, confidence, minutes.
    What cache (rows of the same kind) has is taken from there; only the others go to the client, which downloads and recognises one
    recording and returns those fields, or None.  A failed recording has null fields and is asked again next time: cache rows without
    a transcript do not count."""
    keyed = audio.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), F.md5(F.col(url).cast("binary")).alias("key")).distinct()
    known = cache.where("transcript is not null").dropDuplicates(["key"]) if cache is not None else None
    open_ = keyed.join(known.select("key"), "key", "left_anti").select("url", "key") if known is not None else keyed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for address, key in zip(b["url"], b["key"], strict=True):
                try:
                    got = client(address) or {}
                except Exception:  # noqa: BLE001  a client may raise anything; the recording stays open
                    got = {}
                rows.append((key, got.get("transcript"), got.get("language"), got.get("confidence"), got.get("minutes")))
            yield pd.DataFrame(rows, columns=["key", "transcript", "language", "confidence", "minutes"])

    new = open_.mapInPandas(run, TRANSCRIPT)
    return new.unionByName(known.join(keyed.select("key"), "key", "left_semi").select(new.columns)) if known is not None else new


def silent_client(address: str) -> dict:
    """A stand-in: a transcript that names the recording."""
    return {"transcript": f"recording {hashlib.md5(address.encode()).hexdigest()[:8]}", "language": "en", "confidence": 1.0, "minutes": 0.0}


def translation_route(lang: str, direct: Sequence[str] = ("de", "fr", "es", "ru", "ar", "zh")):
    """Which of two engines translates a language; English is left alone."""
    return F.when(F.col(lang) == "en", "none").when(F.col(lang).isin(*direct), "pairwise").otherwise("multilingual")


def token_f1(a: str, b: str):
    """Token overlap F1 of two texts: the stand-in for a learned similarity of texts (a column, no Python)."""
    ta, tb = (F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "") for c in (a, b))
    both = F.size(F.array_intersect(ta, tb))
    p, r = both / F.nullif(F.size(F.array_distinct(ta)), F.lit(0)), both / F.nullif(F.size(F.array_distinct(tb)), F.lit(0))
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def plain(answer: str | None) -> str | None:
    return re.sub(r"(?s)^.*</think>", "", answer).strip() if answer else answer
