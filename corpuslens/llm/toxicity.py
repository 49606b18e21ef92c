"""Operator 3: toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into an embedding table together with their beginnings of a few lengths (summed),
so inflected and unseen forms share what was learnt.  Filters of several widths run over a text's
words, each is max-pooled over the whole text, and a logistic unit weighs the pooled values.

The classifier is fitted on the driver on a bounded sample of labelled rows, in hash order of the id:
at most MAX_ROWS rows and MAX_WORDS words, no row of more than MAX_ROW_BYTES bytes (all parameters; a
row that does not fit is passed over, those after it are not).  Scoring is one narrow pass over whole
texts; the convolution runs over BLOCK_PLACES words at a time, so memory per word is a few integers.

Thresholds are calibrated by language: the language is told from the text alone (a bag-of-words
model learnt from the sample), each language's best threshold is found on sample rows the filters
were not fitted on, and scores are shifted in log-odds so that it lies at the common cut of 0.7.
Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts are scored like a text without words; texts shorter than a
filter are padded with zero vectors; rows with a null label are not learnt from; a sample without
both classes gives every text the share of label 1 (0 if there is none); repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, hash_spans, pieces, trimmed, words_of

MAX_ROWS = 5_000
MAX_WORDS = 2_500_000
MAX_ROW_BYTES = 2 << 20
BLOCK_PLACES = 1 << 16
BATCH_WORDS = 1 << 18
LANGUAGE_DOCS = 256
FEATURE_WORDS = 1 << 14
CUT = 0.7
PIECE_BYTES = 1 << 20
PREFIXES = (3, 4, 5, 6)
WIDTHS = (1, 2, 3)

#: what parts words here: all ASCII but letters and digits
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    bits: int = 16
    dim: int = 16
    filters: int = 16
    widths: tuple[int, ...] = WIDTHS
    table: np.ndarray | None = None  # embeddings
    kernels: list[np.ndarray] = field(default_factory=list)  # (width, dim, filters)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None  # weights of pooled values, then the constant
    lang_table: np.ndarray | None = None  # log-odds of words by language
    shift: np.ndarray | None = None  # by language, log-odds to add
    constant: float | None = None  # the score if nothing could be learnt


@dataclass
class Bags:
    """Documents as words: ids index features; first[d] .. first[d + 1] are document d's."""

    ids: np.ndarray
    first: np.ndarray
    features: np.ndarray  # (distinct words, 1 + prefixes): rows of the embedding table, -1 where none


def bags_of(texts: pa.Array, bits: int) -> Bags:
    ids, first, distinct = _coded(texts)
    return Bags(ids, first, _features(distinct, bits))


def bags_by_pieces(texts: list[str], bits: int) -> Bags:
    """bags_of, of whose intermediate arrays only a piece of PIECE_BYTES is held at a time."""
    of = lambda part: _coded(pa.array(part, pa.large_string()))
    coded, begin, size = [of([])], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size > PIECE_BYTES:
            coded.append(of(texts[begin : k + 1]))
            begin, size = k + 1, 0
    coded.append(of(texts[begin:]))
    words = pa.concat_arrays([distinct for _, _, distinct in coded]).dictionary_encode()  # in order of appearance, as in one piece
    code, at, ends = words.indices.to_numpy(zero_copy_only=False), 0, [np.zeros(1, np.int64)]
    ids, n = np.zeros(sum(len(x) for x, _, _ in coded), np.int64), 0
    for x, first, distinct in coded:
        ids[n : n + len(x)] = code[at + x]
        ends.append(first[1:] + n)
        at, n = at + len(distinct), n + len(x)
    features = [_features(words.dictionary[a : a + FEATURE_WORDS], bits) for a in range(0, len(words.dictionary), FEATURE_WORDS)]
    return Bags(ids, np.concatenate(ends), np.concatenate([_features(words.dictionary[:0], bits), *features]))


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, first word of each text, the distinct words)."""
    w = words_of(texts, lower=True, breaks=PARTS)
    ids, distinct = w.distinct() if len(w.start) else (np.zeros(0, np.int64), pa.array([], pa.large_binary()))
    return ids, w.first, distinct


def _features(distinct: pa.Array, bits: int) -> np.ndarray:
    _, offsets, data = distinct.buffers()
    offs = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if len(distinct) else np.zeros(0, np.uint8)
    size = np.diff(offs)
    features = np.full((len(size), 1 + len(PREFIXES)), -1, np.int32)
    shift = np.uint64(64 - bits)
    features[:, 0] = hash_spans(raw, offs[:-1], size) >> shift
    for k, n in enumerate(PREFIXES):
        at = np.flatnonzero(size > n)
        features[at, k + 1] = (hash_spans(raw, offs[at], np.full(len(at), n)) ^ np.uint64(0x5A << 56)) >> shift
    return features


def _embed(m: Model, features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), m.dim), np.float32)
    for k in range(features.shape[1]):
        at = features[:, k] >= 0
        out[at] += m.table[features[at, k]]
    return out


def _padded(b: Bags, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(word of every place or -1, first place of every document), each document padded behind."""
    pad = max(widths) - 1
    n = np.diff(b.first)
    first = np.concatenate([[0], np.cumsum(n + pad + (n == 0))])
    places = np.full(first[-1], -1, np.int64)
    places[np.arange(len(b.ids)) + np.repeat(first[:-1] - b.first[:-1], n)] = b.ids
    return places, first


def _convolve(m: Model, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(m.widths) * m.filters), np.float32)
    for i, (w, kernel) in enumerate(zip(m.widths, m.kernels, strict=True)):
        part = out[:, i * m.filters : (i + 1) * m.filters]
        for k in range(w):
            part[: len(x) - k] += x[k:] @ kernel[k]
    return out


def _forward(m: Model, b: Bags) -> tuple[np.ndarray, ...]:
    places, first = _padded(b, m.widths)
    vectors = np.concatenate([_embed(m, b.features), np.zeros((1, m.dim), np.float32)])
    x = vectors[places]
    c = _convolve(m, x)
    # windows that begin in the padding hold no word: they must not win
    body = np.repeat(first[1:] - (max(m.widths) - 1), np.diff(first))
    c[np.arange(len(c)) >= np.maximum(body, np.repeat(first[:-1], np.diff(first)) + 1)] = -np.inf
    pooled = np.maximum.reduceat(c, first[:-1], axis=0)
    return places, first, x, c, pooled


def _pooled(m: Model, b: Bags) -> np.ndarray:
    """The last of _forward's results, block by block: a block's windows may read into the next one."""
    places, first = _padded(b, m.widths)
    reach = max(m.widths) - 1
    body = np.maximum(first[1:] - reach, first[:-1] + 1)  # windows that begin behind hold no word
    out = np.full((len(first) - 1, len(m.widths) * m.filters), -np.inf, np.float32)
    few = len(b.features) <= 2 * BLOCK_PLACES  # then all words' vectors take no more room than a block's
    words = np.concatenate([_embed(m, b.features), np.zeros((1, m.dim), np.float32)]) if few else None
    for lo in range(0, len(places), BLOCK_PLACES):
        hi = min(lo + BLOCK_PLACES, len(places))
        if few:
            x = words[places[lo : hi + reach]]
        else:
            used, inverse = np.unique(places[lo : hi + reach], return_inverse=True)
            vectors = _embed(m, b.features[np.maximum(used, 0)])
            vectors[used < 0] = 0
            x = vectors[inverse]
        c = _convolve(m, x)
        a, z = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
        begin, end = np.maximum(first[a:z], lo) - lo, np.minimum(body[a:z], hi) - lo
        some = end > begin
        edges = np.stack([begin[some], end[some]], axis=1).ravel()
        if len(edges):
            c = np.concatenate([c, np.full((1, c.shape[1]), -np.inf, np.float32)])  # lets an end be the last row
            docs = np.arange(a, z)[some]
            out[docs] = np.maximum(out[docs], np.maximum.reduceat(c, edges, axis=0)[::2])
    return out


def logits(m: Model, b: Bags) -> np.ndarray:
    if len(b.first) < 2:
        return np.zeros(0)
    pooled = _pooled(m, b)
    return (np.maximum(pooled + m.bias, 0) @ m.out[:-1] + m.out[-1]).astype(np.float64)


def language_of(m: Model, b: Bags) -> np.ndarray:
    n = len(b.first) - 1
    if m.lang_table.shape[1] < 2 or not len(b.ids):
        return np.zeros(n, np.int64)
    votes = np.zeros((n, m.lang_table.shape[1]))
    doc = np.repeat(np.arange(n), np.diff(b.first))
    for k in range(votes.shape[1]):
        votes[:, k] = np.bincount(doc, m.lang_table[b.features[:, 0], k][b.ids], n)
    return np.argmax(votes, axis=1)


def scores(m: Model, b: Bags) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(b.first) - 1, m.constant)
    z = logits(m, b) + m.shift[language_of(m, b)]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _take(b: Bags, docs: np.ndarray) -> Bags:
    n = (b.first[1:] - b.first[:-1])[docs]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.first[:-1][docs] - (ends - n), n)
    ids, inverse = np.unique(b.ids[at], return_inverse=True)
    return Bags(inverse, np.concatenate([[0], ends]), b.features[ids])


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], *, epochs: int = 4, steps: int = 120, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Model:
    """A quarter of the rows calibrates thresholds, the others fit the filters (AdaGrad on the log loss, for
    epochs passes and steps batches at least)."""
    m, rng = Model(), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        m.constant = float(labels.mean()) if len(labels) else 0.0
        return m
    width = len(m.widths) * m.filters
    m.table = rng.normal(0, 0.1, (1 << m.bits, m.dim)).astype(np.float32)
    m.kernels = [rng.normal(0, 0.5 / np.sqrt(w * m.dim), (w, m.dim, m.filters)).astype(np.float32) for w in m.widths]
    m.bias = np.zeros(width, np.float32)
    m.out = np.concatenate([rng.normal(0, 0.1, width), [np.log(labels.mean() / (1 - labels.mean()))]]).astype(np.float32)
    bags = bags_by_pieces(texts, m.bits)
    _learn_languages(m, bags, langs)
    order = rng.permutation(len(texts))
    held, learn = order[: len(order) // 4], order[len(order) // 4 :]
    weight = np.where(labels > 0, np.sqrt((1 - labels.mean()) / labels.mean()), 1).astype(np.float32)
    params = [m.table, *m.kernels, m.bias, m.out]
    squares = [np.full_like(p, 1e-6) for p in params]
    n = np.diff(bags.first)
    for _ in range(max(epochs, -(-steps * batch // max(len(learn), 1)))):
        order = rng.permutation(learn)
        order = order[np.argsort(n[order] // 256 + rng.random(len(order)) * 4, kind="stable")]  # batches of like length
        batches = _batches(order, n, batch)
        for at in rng.permutation(len(batches)):
            docs = batches[at]
            grads = _gradients(m, _take(bags, docs), labels[docs], weight[docs])
            for p, s, g in zip(params, squares, grads, strict=True):
                if isinstance(g, tuple):
                    rows, g = g
                    s[rows] += g * g
                    p[rows] -= rate * g / np.sqrt(s[rows])
                else:
                    s += g * g
                    p -= rate * g / np.sqrt(s)
    m.shift = _calibrate(m, _take(bags, held), labels[held])
    return m


def _batches(order: np.ndarray, n: np.ndarray, batch: int) -> list[np.ndarray]:
    """Runs of at most batch rows and BATCH_WORDS words (one row at least)."""
    cuts, rows, words = [], 0, 0
    for k, size in enumerate(n[order].tolist()):
        if rows == batch or rows and words + size > BATCH_WORDS:
            cuts.append(k)
            rows = words = 0
        rows, words = rows + 1, words + size
    return np.split(order, cuts)


def _gradients(m: Model, b: Bags, y: np.ndarray, weight: np.ndarray) -> list:
    places, first, x, c, pooled = _forward(m, b)
    docs, width = pooled.shape
    act = np.maximum(pooled + m.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ m.out[:-1] + m.out[-1], -30, 30)))
    dz = ((p - y) * weight / docs).astype(np.float32)
    d_out = np.concatenate([act.T @ dz, [dz.sum()]])
    d_pool = dz[:, None] * m.out[:-1][None, :] * (act > 0)
    tops = [np.nonzero(c[a:z] == row) for a, z, row in zip(first[:-1], first[1:], pooled, strict=True)]  # no copy of c
    hit = np.concatenate([at + a for (at, _), a in zip(tops, first[:-1], strict=True)])
    channel = np.concatenate([f for _, f in tops])
    doc = np.searchsorted(first, hit, "right") - 1
    _, lead = np.unique(doc * width + channel, return_index=True)
    hit, channel, doc = hit[lead], channel[lead], doc[lead]
    g = d_pool[doc, channel]
    live = g != 0
    hit, channel, g = hit[live], channel[live], g[live]
    d_x = np.zeros_like(x)
    d_kernels = []
    for i, (w, kernel) in enumerate(zip(m.widths, m.kernels, strict=True)):
        mine = channel // m.filters == i
        at, f, gm = hit[mine], channel[mine] % m.filters, g[mine]
        dk = np.zeros_like(kernel)
        for k in range(w):
            inside = at + k < len(x)
            a, ff, gg = at[inside] + k, f[inside], gm[inside]
            np.add.at(d_x, a, gg[:, None] * kernel[k].T[ff])
            by_filter = np.zeros((m.filters, m.dim), np.float32)
            np.add.at(by_filter, ff, gg[:, None] * x[a])
            dk[k] = by_filter.T
        d_kernels.append(dk)
    used = np.flatnonzero((places >= 0) & d_x.any(axis=1))
    feats = b.features[places[used]]
    rows, grads = feats.ravel(), np.repeat(d_x[used], feats.shape[1], axis=0)
    rows, grads = rows[rows >= 0], grads[rows >= 0]
    distinct, inverse = np.unique(rows, return_inverse=True)
    summed = np.zeros((len(distinct), m.dim), np.float32)
    np.add.at(summed, inverse, grads)
    return [(distinct, summed), *d_kernels, d_pool.sum(axis=0), d_out.astype(np.float32)]


def _learn_languages(m: Model, b: Bags, langs: list[str | None]) -> None:
    names = sorted({x for x in langs if x})
    counts = np.full((1 << m.bits, max(len(names), 1)), 0.1)
    code = np.array([names.index(x) if x else -1 for x in langs])
    for a in range(0, len(code), LANGUAGE_DOCS):
        first = b.first[a : a + LANGUAGE_DOCS + 1]
        of, ids = np.repeat(code[a : a + LANGUAGE_DOCS], np.diff(first)), b.ids[first[0] : first[-1]]
        known = of >= 0
        np.add.at(counts, (b.features[ids[known], 0], of[known]), 1)
    share = np.log(counts / counts.sum(axis=0))
    m.lang_table = (share - share.mean(axis=1, keepdims=True)).astype(np.float32)


def _calibrate(m: Model, b: Bags, y: np.ndarray, least: int = 20) -> np.ndarray:
    """By language the log-odds that put its best threshold (most right answers, widest gap) at CUT."""
    z, lang = logits(m, b), language_of(m, b)
    goal = np.log(CUT / (1 - CUT))

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        right = np.concatenate([[0], np.cumsum(y == 0)]) + np.concatenate([np.cumsum((y == 1)[::-1])[::-1], [0]])
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        top = np.flatnonzero(right == right.max())
        gaps = np.concatenate([[0], np.diff(z), [0]])
        return float(edges[top[np.argmax(gaps[top])]])

    if not len(z) or len(set(y.tolist())) < 2:
        return np.zeros(m.lang_table.shape[1])
    common = best(z, y)
    out = np.full(m.lang_table.shape[1], goal - common)
    for k in range(len(out)):
        mine = lang == k
        if (y[mine] == 1).sum() >= least and (y[mine] == 0).sum() >= least:
            out[k] = goal - best(z[mine], y[mine])
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, max_row_bytes: int = MAX_ROW_BYTES, seed: int = 42) -> Model:
    """Fit on rows of labels for which learn holds, in hash order of doc_id, as far as they fit the bounds."""
    chosen = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    chosen = chosen.withColumn("_h", F.xxhash64(F.lit(seed), "_id")).orderBy("_h", "_id").limit(max_rows)  # max_rows rows are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.octet_length("text") <= max_row_bytes).join(F.broadcast(chosen), "_id")
    texts, ys, langs, left = [], [], [], max_words
    for text, y, lang in rows.orderBy("_h", "_id", "text").select("text", "_y", "lang").limit(2 * max_rows).toLocalIterator():
        n = len(words_of(pa.array([text]), breaks=PARTS).start)
        if n <= left:
            left -= n
            texts.append(text)
            ys.append(y)
            langs.append(lang)
    model = fit(texts, np.array(ys, float), langs)
    del texts
    give_back()  # the driver lives on
    return model


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for p in pieces(batch, "_text", PIECE_BYTES):
                s = scores(m, bags_of(p.column("_text"), m.bits))
                yield pa.RecordBatch.from_arrays([*(p.column(k) for k in names), pa.array(s, pa.float64())], names=[*names, "score"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names)
    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(trimmed(run), f"{kinds}, score double")
