"""Operator 4: quality rules by repetition coverage.

For each of several lengths n, rolling 64-bit hashes of every n consecutive words are compared
within a document; every word of an n-gram found twice or more is covered (first occurrence
included), and the rule looks at the share of the document's characters that lie in covered words.
Lines are treated likewise: the share of characters in lines equal to an earlier line.  All of it
is numpy on one batch at a time: hashes are tagged with their document and sorted.

Base rules come first (too few words, too many words inside repeated 8-word windows).  A document
is kept if it passes the base rules and all shares and the symbol share stay under their limits.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are judged
each; other columns are ignored.  The plan is one narrow pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, U64, Words, hash_spans, mix64, pieces, trimmed, words_of

#: bytes of the characters that n_symbols counts
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LINE_BREAK = np.arange(256) == 0x0A


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: n → largest share of word characters that may lie in n-grams found twice or more
    ngram_shares: dict[int, float] = field(default_factory=lambda: {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30})
    max_dup_line_share: float = 0.30
    max_symbol_share: float = 0.08


def repeated_starts(h: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Those of the windows of n words that begin at at whose words their document has again elsewhere."""
    if not len(at):
        return at
    key = h[at]
    for k in range(1, n):
        key = key * U64(0xD6E8FEB86659FD93) + h[at + k]
    key = mix64(key) ^ mix64(doc[at].astype(U64) + U64(1 << 32))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return at[:0]
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return at[twice[place] == key]


def coverage(h: np.ndarray, w: Words, doc: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length n and word: does it lie in an n-word window that its document has twice or more?
    A window found twice begins with a shorter one found twice, so each length looks only where the last one hit."""
    out, at = {}, np.arange(len(h))
    last = w.first[1:][doc]
    for n in sorted(lengths):
        at = repeated_starts(h, doc, at[at + n <= last[at]], n)
        delta = np.zeros(len(h) + 1, np.int32)
        delta[at] += 1
        delta[at + n] -= 1
        out[n] = np.cumsum(delta[:-1]) > 0
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def measures(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    w = words_of(texts)
    doc = w.doc_of()
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    chars = lead[w.end] - lead[w.start] if len(w.start) else np.zeros(0, np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[w.data])])
    h = w.hashes()
    out = {"n_words": w.per_doc, "word_chars": _sums(chars, w.first), "n_symbols": symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]}
    covered = coverage(h, w, doc, [*rules.ngram_shares, rules.window])
    out["n_repeat_words"] = _sums(covered[rules.window], w.first)
    for n in rules.ngram_shares:
        out[f"dup_{n}gram_chars"] = _sums(chars * covered[n], w.first)

    # lines: runs between line breaks, those with a word
    breaks = np.flatnonzero(LINE_BREAK[w.data])
    begin = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    begin = begin[begin < len(w.data)]
    size = np.diff(np.concatenate([begin, [len(w.data)]]))
    size -= LINE_BREAK[w.data[begin + size - 1]] if len(begin) else 0
    worded = np.concatenate([[0], np.cumsum(~IS_SPACE[w.data])])
    begin, size = begin[worded[begin + size] > worded[begin]], size[worded[begin + size] > worded[begin]]
    of = np.searchsorted(w.offsets, begin, "right") - 1
    key = hash_spans(w.data, begin, size) ^ mix64(of.astype(U64) + U64(1 << 33))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    out["n_dup_lines"] = np.bincount(of[later], minlength=w.n_docs)
    out["dup_line_chars"] = np.bincount(of[later], weights=(lead[begin + size] - lead[begin])[later], minlength=w.n_docs).astype(np.int64)
    out["line_chars"] = np.bincount(of, weights=lead[begin + size] - lead[begin], minlength=w.n_docs).astype(np.int64)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    bad = out["base_failed"].copy()
    for n, most in rules.ngram_shares.items():
        bad |= out[f"dup_{n}gram_chars"] > most * out["word_chars"]
    bad |= out["dup_line_chars"] > rules.max_dup_line_share * out["line_chars"]
    bad |= out["n_symbols"] > rules.max_symbol_share * out["word_chars"]
    out["kept"] = ~bad
    return out


def judge(docs: DataFrame, rules: Rules | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, all measures, base_failed and kept of every row."""
    rules = rules or Rules()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_{n}gram_chars" for n in rules.ngram_shares), "dup_line_chars", "line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "text"):
                m = measures(p.column("text"), rules)
                yield pa.RecordBatch.from_arrays([p.column(0), *(pa.array(m[k], pa.int64()) for k in counts), pa.array(m["base_failed"]), pa.array(m["kept"])], names=[key, *counts, "base_failed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), f"`{key}` {kind}, {', '.join(k + ' long' for k in counts)}, base_failed boolean, kept boolean")
