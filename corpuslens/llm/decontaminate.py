"""Operator 7: benchmark decontamination with a BM25 inverted index of the test items and block-max WAND.

The items are the indexed collection, the corpus is the queries: every passage asks for all items
above a threshold.  A passage is two neighbouring chunks of a document, a chunk being as long as any
item of a level, so an item lies whole in some passage; a level holds the items of up to MIN_CHUNK,
twice, four times ... as many words.  Impacts are BM25 term weights divided by the item's score for
itself, so one threshold fits items of any length.

Postings: each term lists the blocks of items (neighbours in length) that hold it, with its greatest
impact in the block; each item lists its terms with their impacts.  As all items above a fixed
threshold are wanted, not the best few, the pivot of WAND does not move: the terms of the longest
lists are left of it as long as no item gets more than LEFT of its score from them.  Their lists are
never walked; a block's bound is the sum over a passage's other terms plus what its items can have
from those left.  Blocks whose bound stays under the threshold are skipped, the items of the others
are scored exactly.  Whole batches of passages are bounded and scored at once in numpy.

Survivors are verified: the item's beginning (question) and its end (answer) must both overlap with
the passage in word trigrams; an item under 2 * RUN words must stand in it word for word, and one of
one or two words be the whole text.

The items are read to the driver in parts of MAX_PART_BYTES of text (an index is a small multiple of
its text) and broadcast; document frequencies and lengths are those of the whole benchmark, so the
split changes no score.  The corpus is scanned once a part, without a shuffle.

Words: runs of letters, digits and other non-ASCII characters, A-Z lowered; in scripts without spaces
(CJK, kana, Thai) every character is a word.  Words are told apart by 64-bit hashes.

Defined cases: null and empty texts match nothing, items without a word are matched by nothing; equal
items all match; items of one id (or of none: a null id is an id) are one item with several texts, of which the best
hit counts; repeated rows match each; very long texts are searched whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, pieces, spans, text_bytes, trimmed, words_of

MAX_PART_BYTES = 16 << 20
BLOCK_ITEMS = 8
MIN_CHUNK = 64
BOUND_CELLS = 1 << 22
SCORE_CELLS = 1 << 21
LEFT = 0.2
K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
ANSWER_SHARE = 0.25
RUN = 3
ROUNDING = 1e-5

#: what parts words here: all ASCII but letters and digits
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Stats:
    """Of all items: their number, their words, and in how many each word (sorted hashes) occurs."""

    items: int = 0
    words: int = 0
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, texts: list[str | None]) -> None:
        w, h = tokenize(pa.array(texts, pa.large_string()))
        self.items += int((w.per_doc > 0).sum())
        self.words += len(h)
        terms, df = np.unique(_distinct_pairs(w.doc_of(), h)[1], return_counts=True)
        every, of = np.unique(np.concatenate([self.terms, terms]), return_inverse=True)
        self.terms, self.df = every, np.bincount(of, np.concatenate([self.df, df]), len(every)).astype(np.int64)


@dataclass
class Level:
    chunk: int
    ids: list[int]
    items: list[np.ndarray]  # terms of each item, in order
    item_first: np.ndarray  # item → its distinct terms and their impacts
    item_term: np.ndarray
    item_impact: np.ndarray
    walked: np.ndarray  # term → is its list walked?
    list_first: np.ndarray  # term → its blocks and greatest impacts in them
    list_block: np.ndarray
    list_most: np.ndarray
    left: np.ndarray  # block → the most that an item has from terms that are not walked


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    levels: list[Level]
    whole: dict[tuple[int, ...], list[int]]  # items of one or two words


def _spaced(texts: pa.Array) -> pa.Array:
    """A space around every character of a script that has none."""
    data, offsets = text_bytes(texts)
    if not len(data) or data.max() < 0xE0:
        return texts
    after = np.append(data[1:], 0)
    lead = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & ((after == 0xB8) | (after == 0xB9))
    at = np.flatnonzero(lead)
    if not len(at):
        return texts
    at = np.sort(np.concatenate([at, at + 3]))
    offsets = offsets + np.searchsorted(at, offsets)
    offsets[-1] = len(data) + len(at)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.insert(data, at, 0x20)))


def tokenize(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """(words, their hashes)."""
    w = words_of(_spaced(texts), lower=True, breaks=PARTS)
    return w, w.hashes()


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def build_index(items: list[tuple[int, str | None]], stats: Stats | None = None) -> Index | None:
    """Of a part of the items; stats are those of all items."""
    if stats is None:
        stats = Stats()
        stats.add([t for _, t in items])
    w, h = tokenize(pa.array([t for _, t in items], pa.large_string()))
    size = w.per_doc
    if not len(h):
        return None
    terms = np.unique(h)
    df = stats.df[np.searchsorted(stats.terms, terms)]
    idf = np.log(1 + (stats.items - df + 0.5) / (df + 0.5))
    term = np.searchsorted(terms, h)
    whole: dict[tuple[int, ...], list[int]] = {}
    for k in np.flatnonzero((size > 0) & (size < RUN)):
        whole.setdefault(tuple(term[w.first[k] : w.first[k + 1]].tolist()), []).append(items[k][0])
    levels, chunk, done = [], MIN_CHUNK, RUN - 1
    while done < size.max():
        mine = np.flatnonzero((size > done) & (size <= chunk))
        if len(mine):
            mine = mine[np.lexsort(([items[k][0] or 0 for k in mine], [items[k][0] is None for k in mine], size[mine]))]
            levels.append(_level(chunk, [items[k][0] for k in mine], [term[w.first[k] : w.first[k + 1]] for k in mine], idf, stats.words / stats.items))
        done, chunk = chunk, 2 * chunk
    return Index(terms, levels, whole)


def _level(chunk: int, ids: list[int], items: list[np.ndarray], idf: np.ndarray, mean: float) -> Level:
    counted = [np.unique(x, return_counts=True) for x in items]
    first = np.cumsum([0, *(len(t) for t, _ in counted)])
    item = np.repeat(np.arange(len(items)), np.diff(first))
    terms, tf = (np.concatenate(x) for x in zip(*counted, strict=True))
    size = np.array([len(x) for x in items])[item]
    impact = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    impact /= np.bincount(item, impact)[item]
    # left of the pivot: the longest lists, one by one, as long as every item keeps enough for the others
    order = np.argsort(terms, kind="stable")
    postings = np.searchsorted(terms[order], np.arange(len(idf) + 1))
    walked, taken = np.ones(len(idf), bool), np.zeros(len(items))
    for t in np.argsort(-np.diff(postings), kind="stable"):
        at = order[postings[t] : postings[t + 1]]
        if len(at) < 2 or (taken[item[at]] + impact[at]).max() > LEFT:
            break
        taken[item[at]] += impact[at]
        walked[t] = False
    block = item // BLOCK_ITEMS
    order = np.lexsort((block, terms))
    order = order[walked[terms[order]]]
    lead = np.flatnonzero(np.concatenate([[True], (np.diff(terms[order]) != 0) | (np.diff(block[order]) != 0)])) if len(order) else order
    most = np.maximum.reduceat(impact[order], lead) if len(lead) else np.zeros(0)
    left = np.zeros(-(-len(items) // BLOCK_ITEMS))
    np.maximum.at(left, np.arange(len(items)) // BLOCK_ITEMS, taken)
    return Level(chunk, ids, items, first, terms, impact, walked & (np.diff(postings) > 0), np.searchsorted(terms[order][lead], np.arange(len(idf) + 1)), block[order][lead], most, left)


def search(index: Index, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(row, item_id, score, question overlap, answer overlap): verified hits, the best passage of each row and item."""
    w, h = tokenize(texts)
    if not len(h):
        return []
    distinct, of = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(index.terms, distinct), len(index.terms) - 1)
    term = np.where(index.terms[at] == distinct, at, -1)[of]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for level in index.levels:
        for row, item, found in _hits(level, w, term, len(index.terms)):
            best[row, item] = max(best.get((row, item), found), found)
    if index.whole:
        for row in np.flatnonzero((w.per_doc > 0) & (w.per_doc < RUN)).tolist():
            for item in index.whole.get(tuple(term[w.first[row] : w.first[row + 1]].tolist()), ()):
                best[row, item] = (1.0, 1.0, 1.0)
    return [(*k, *best[k]) for k in sorted(best, key=lambda k: (k[0], k[1] is None, k[1] or 0))]


def _hits(level: Level, w: Words, term: np.ndarray, n_terms: int) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    per = -(-w.per_doc // level.chunk)
    base = np.concatenate([[0], np.cumsum(per)])
    chunk_doc = np.repeat(np.arange(w.n_docs), per)
    follows = np.append(chunk_doc[1:] == chunk_doc[:-1], False)
    begin = w.first[chunk_doc] + (np.arange(base[-1]) - base[chunk_doc]) * level.chunk
    doc_end = w.first[1:][chunk_doc]
    walked = np.append(level.walked, False)[term]
    words, n_blocks = np.flatnonzero(walked), len(level.left)
    chunk = base[np.searchsorted(w.first, words, "right") - 1]
    chunk += (words - w.first[chunk_doc[chunk]]) // level.chunk
    keys = np.unique(chunk * n_terms + term[words])
    c, t = keys // n_terms, keys % n_terms
    step = max(1, BOUND_CELLS // n_blocks)
    for lo in range(0, int(base[-1]), step):
        hi = min(lo + step, int(base[-1]))
        a, z = np.searchsorted(c, [lo, hi + 1])
        if a == z:
            continue
        n = level.list_first[t[a:z] + 1] - level.list_first[t[a:z]]
        at = spans(level.list_first[t[a:z]], n)
        bound = np.bincount(np.repeat(c[a:z] - lo, n) * n_blocks + level.list_block[at], level.list_most[at], (hi + 1 - lo) * n_blocks).reshape(-1, n_blocks)
        bound[:-1][follows[lo:hi]] += bound[1:][follows[lo:hi]]
        passage, block = np.nonzero(bound[:-1] + level.left >= THRESHOLD - ROUNDING)
        passage += lo
        end = np.where(follows[passage], np.minimum(begin[passage] + 2 * level.chunk, doc_end[passage]), np.minimum(begin[passage] + level.chunk, doc_end[passage]))
        some = max(1, SCORE_CELLS // (2 * level.chunk * BLOCK_ITEMS))
        for k in range(0, len(passage), some):
            yield from _scored(level, term, n_terms, passage[k : k + some], block[k : k + some], begin, end[k : k + some], chunk_doc)


def _scored(level: Level, term: np.ndarray, n_terms: int, passage: np.ndarray, block: np.ndarray, begin: np.ndarray, end: np.ndarray, chunk_doc: np.ndarray) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    """Exact scores of the items of blocks for passages, then the check of question and answer."""
    every, first, spot = np.unique(passage, return_index=True, return_inverse=True)
    size = end[first] - begin[every]
    inside = term[spans(begin[every], size)]
    held = np.unique((np.repeat(np.arange(len(every)), size) * n_terms + inside)[inside >= 0])
    item = (block[:, None] * BLOCK_ITEMS + np.arange(BLOCK_ITEMS)).ravel()
    pair = np.repeat(np.arange(len(passage)), BLOCK_ITEMS)[item < len(level.items)]
    item = item[item < len(level.items)]
    n = level.item_first[item + 1] - level.item_first[item]
    at = spans(level.item_first[item], n)
    key = np.repeat(spot[pair], n) * n_terms + level.item_term[at]
    has = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key if len(held) else np.zeros(len(key), bool)
    score = np.bincount(np.repeat(np.arange(len(item)), n), level.item_impact[at] * has, len(item))
    for k in np.flatnonzero(score >= THRESHOLD - ROUNDING):
        p, i = passage[pair[k]], int(item[k])
        question, answer = overlaps(level.items[i].tolist(), term[begin[p] : end[pair[k]]].tolist())
        if question >= OVERLAP and answer >= OVERLAP:
            yield int(chunk_doc[p]), level.ids[i], (float(score[k]), question, answer)


def overlaps(item: list[int], passage: list[int]) -> tuple[float, float]:
    """Shares of the question's and the answer's trigrams that the passage has; the answer is the item's last quarter.  A short
    item has neither: its words must stand in the passage as they are."""
    if len(item) < 2 * RUN:
        found = float(tuple(item) in set(zip(*(passage[k:] for k in range(len(item))), strict=False)))
        return found, found
    cut = len(item) - max(RUN, round(len(item) * ANSWER_SHARE))
    have = set(zip(*(passage[k:] for k in range(RUN)), strict=False))

    def share(part: list[int]) -> float:
        runs = list(zip(*(part[k:] for k in range(RUN)), strict=False))
        return sum(r in have for r in runs) / len(runs)

    return share(item[:cut]), share(item[cut:])


def _parts(benchmark: DataFrame) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MAX_PART_BYTES)
    part = lambda k: [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
    stats, rows = Stats(), []
    for k in range(n):
        rows = part(k)
        stats.add([t for _, t in rows])
    for k in range(n):
        index = build_index(rows if n == 1 else part(k), stats)
        if index:
            yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified hit; one row a document row and item."""
    spark, out = docs.sparkSession, None
    columns = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    for index in _parts(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in pieces(batch, "text"):
                    hits = search(shared.value, p.column("text"))
                    rows = pa.array([h[0] for h in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays([p.column(0).take(rows), pa.array([h[1] for h in hits], pa.int64()), *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), columns)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], columns) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    for index in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in pieces(batch, "text"):
                    clean = np.ones(p.num_rows, bool)
                    clean[[h[0] for h in search(shared.value, p.column("text"))]] = False
                    yield p.filter(pa.array(clean))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
