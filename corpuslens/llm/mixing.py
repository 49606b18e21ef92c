"""Operator 1: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in a hashed order, end to end, cut into blocks of
``block_words``.  A source's target becomes an exact quota of blocks (whole passes, then a part of
a pass whose last block is cut to the word).  A binary tree over the output shards splits the
vector of quotas: at each node the left half's share is one multivariate-hypergeometric draw, so
shards are equally full, every quota is met exactly and the mixture of each shard is as if all
blocks had been shuffled.  A shard then owns a disjoint range of its source's permuted blocks;
permutations are keyed Feistel networks, evaluated per block, so nothing global is shuffled.

Plan: one narrow pass counts words; a map-side combined sum per source gives the plan; positions
in a stream come from a two-level prefix sum over hash buckets of about 4096 rows, so a source
holding a third of the rows is spread over many buckets.  One row a source reaches the driver; the
plan that is broadcast holds at most PLAN_ENTRIES numbers (sources x shards; beyond MIN_SHARDS shards).

Defined cases: null text has size 0 and is never drawn; null source is a source of its own, last
in order; repeated rows are separate documents (their drawn words are equal); an empty table gives an empty result; other
columns are ignored.  Equal hashes are ordered by doc_id and size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_counted, mix64, pieces, spans, trimmed, words_of

BUCKET_ROWS = 4096
BROADCAST_SOURCES = 10_000
PIECE_BYTES = 1 << 20
LIBRARY_RANGE = 10**9  # below it numpy draws
MIN_SHARDS = 64
SHARD_WORDS = 64 << 20
PLAN_ENTRIES = 1 << 23
PIECE = "epoch int, shard int, slot long, first_word long, n_words long"
_PIECE_ARROW = pa.struct([("epoch", pa.int32()), ("shard", pa.int32()), ("slot", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def cyclic_weights(n: int, cycle: Sequence[float] = (5, 2, 1)) -> list[float]:
    return [float(cycle[i % len(cycle)]) for i in range(n)]


def fill_targets(sizes: Sequence[int], weights: Sequence[float], share: float, max_passes: float) -> np.ndarray:
    """Share share * sum(sizes) by weight; no target exceeds max_passes * size, the excess is shared anew."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    caps, target = max_passes * sizes, np.zeros(len(sizes))
    left, free = share * sizes.sum(), weights > 0
    while free.any():
        want = np.where(free, left * weights / weights[free].sum(), 0)
        over = free & (want > caps)
        if not over.any():
            target[free] = want[free]
            break
        target[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return target


def permute(x: np.ndarray, n: int | np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, elementwise: a Feistel network walked until it lands below n."""
    x, n = np.asarray(x, np.uint64), np.broadcast_to(np.asarray(n, np.uint64), np.shape(x))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    key = np.broadcast_to(np.asarray(key, np.uint64), np.shape(x))
    out, todo = x.copy(), np.arange(x.size)
    while todo.size:
        v, h, k = out[todo], half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = v >> h, v & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(k + np.uint64(r))) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _stirling_rest(n: float) -> float:
    """log n! less Stirling's approximation of it."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    return (1 / 12 - (1 / 360 - 1 / 1260 / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near mean."""
    if not x:
        return mean
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * k + 1)
        if more == total:
            return total
        total, k = more, k + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log probability of x hits in n trials, by deviances: exact to rounding for any n."""
    if x in (0, n):
        return n * (math.log1p(-p) if not x else math.log(p))
    q = 1 - p
    spread = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return spread + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of take draws without replacement out of good + bad are good, for numbers of any size: ratio of uniforms
    under the table-mountain hat, the probabilities as quotients of binomial ones."""
    total = good + bad
    low, high = max(0, take - bad), min(good, take)
    if total < LIBRARY_RANGE or low == high:
        return int(rng.hypergeometric(good, bad, take)) if low < high else low
    p = take / total
    log_p = lambda k: _log_binomial(k, good, p) + _log_binomial(take - k, bad, p)
    mean = take * (good / total)
    spread = mean * (bad / total) * ((total - take) / (total - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    top = log_p(min(high, max(low, (take + 1) * (good + 1) // (total + 2))))
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = mean + 0.5 + width * (v - 0.5) / u
        if low <= x < high + 1 and 2 * math.log(u) <= log_p(int(x)) - top:
            return int(x)


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): exact quotas dealt down a binary tree of multivariate-hypergeometric draws."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def draw(q: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
        total = int(q.sum())
        if total < LIBRARY_RANGE:
            return rng.multivariate_hypergeometric(q, take, method="marginals")
        left = np.zeros(len(q), np.int64)
        for s, n in enumerate(q.tolist()):  # source by source: a draw from what is left, conditional on those before
            total -= n
            left[s] = hypergeometric(n, total, take, rng)
            take -= int(left[s])
        return left

    def down(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        left = draw(q, total * (mid - lo) // (hi - lo), np.random.default_rng([seed, lo, hi]))
        down(left, lo, mid)
        down(q - left, mid, hi)

    if len(quotas):
        down(np.asarray(quotas, np.int64), 0, shards)
    return out


def shards_of(words: float, sources: int) -> int:
    """Shards of about SHARD_WORDS words, MIN_SHARDS at least, as long as the plan keeps within PLAN_ENTRIES numbers."""
    return max(MIN_SHARDS, min(int(words // SHARD_WORDS), PLAN_ENTRIES // max(sources, 1)))


def _plan(rows: list, weights: Callable[[int], Sequence[float]], share: float, max_passes: float, block: int, shards: int, seed: int) -> dict:
    """rows: (source, size, documents), in order.  What each source's blocks need to know."""
    sizes = [int(r[1]) for r in rows]
    target = fill_targets(sizes, weights(len(rows)), share, max_passes)
    n_blocks, full, part, draws = [], [], [], []
    for s, (size, t) in enumerate(zip(sizes, target, strict=True)):
        blocks = -(-size // block)
        passes, rest = divmod(int(t + 1e-6), size) if size else (0, 0)
        short = size - (blocks - 1) * block if blocks else 0
        place = int(permute(np.array([blocks - 1]), blocks, _key(seed, s, passes))[0]) if blocks else 0
        length = lambda q: q * block - (block - short if place < q else 0)  # noqa: E731, B023
        q = rest // block
        while q < blocks and length(q + 1) <= rest:
            q += 1
        cut = rest - length(q) if q < blocks else 0
        n_blocks.append(blocks)
        full.append(passes * blocks + q)
        part.append(cut)
        draws.append(passes * blocks + q + (cut > 0))
    ends = np.cumsum(split_quotas(np.array(draws, np.int64), shards, seed), axis=0).T if rows else np.zeros((0, shards), np.int64)
    return {"target": target, "n_blocks": np.array(n_blocks, np.int64), "full": np.array(full, np.int64), "part": np.array(part, np.int64), "draws": np.array(draws, np.int64), "ends": ends, "block": block, "seed": seed}


def _key(seed: int, source: int | np.ndarray, epoch: int | np.ndarray) -> np.ndarray:
    return mix64(np.atleast_1d(np.asarray(source, np.uint64) * np.uint64(64) + np.asarray(epoch, np.uint64)) + np.uint64(seed) * np.uint64(1 << 40))


def _shard_of(ends: np.ndarray, s: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The first shard whose end lies behind slot, by halving."""
    low, high = np.zeros(len(s), np.int64), np.full(len(s), ends.shape[1], np.int64)
    while (low < high).any():
        mid = (low + high) // 2
        go = (low < high) & (ends[s, np.minimum(mid, ends.shape[1] - 1)] <= slot)
        low, high = np.where(go, mid + 1, low), np.where(go, high, mid)
    return low


def _drawn(plan: dict, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which words of documents at [begin, begin + size) of their source's stream are drawn: (document, piece fields)."""
    b = plan["block"]
    n = np.where(size > 0, (begin + size - 1) // b - begin // b + 1, 0)
    doc = np.repeat(np.arange(len(size)), n)
    at = spans(begin // b, n)
    outs = []
    for epoch in range(int((-(-plan["draws"] // np.maximum(plan["n_blocks"], 1))).max(initial=0))):
        s = source[doc]
        draw = epoch * plan["n_blocks"][s] + permute(at, plan["n_blocks"][s], _key(plan["seed"], s, np.full(len(s), epoch)))
        hit = draw < plan["draws"][s]
        d, s, draw, blk = doc[hit], s[hit], draw[hit], at[hit]
        lo = np.maximum(begin[d], blk * b)
        hi = np.minimum(begin[d] + size[d], blk * b + np.where(draw < plan["full"][s], b, plan["part"][s]))
        keep = hi > lo
        d, s, draw, lo, hi = d[keep], s[keep], draw[keep], lo[keep], hi[keep]
        slot = permute(draw, plan["draws"][s], _key(plan["seed"], s, np.full(len(s), 63)))
        shard = _shard_of(plan["ends"], s, slot)
        outs.append((d, np.full(len(d), epoch), shard, slot, lo - begin[d], hi - lo))
    if not outs:
        return np.zeros(0, np.int64), {k: np.zeros(0, np.int64) for k in ("epoch", "shard", "slot", "first_word", "n_words")}
    d, *fields = (np.concatenate(x) for x in zip(*outs, strict=True))
    order = np.lexsort((fields[3], fields[0], d))
    return d[order], {k: f[order] for k, f in zip(("epoch", "shard", "slot", "first_word", "n_words"), fields, strict=True)}


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), p.column(3), pa.array(words_of(p.column(2)).per_doc, pa.int64())], names=["doc_id", "source", "key", "size"])


def mix(docs: DataFrame, *, weights: Callable[[int], Sequence[float]] = cyclic_weights, share: float = 1.5, max_passes: float = 2, block_words: int = 512, shards: int | None = None, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, source, key (a hash of id, source and text), size, source_size, target and pieces, the word
    ranges the mix takes (epoch, shard, slot of its block in the source's permuted order, first_word, n_words).  weights(n) gives the
    weights of n sources in code-point order, null last; shards defaults to what shards_of says."""
    return _mix(docs, weights, share, max_passes, block_words, shards, seed)[0]


def _mix(docs: DataFrame, weights: Callable[[int], Sequence[float]], share: float, max_passes: float, block_words: int, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    sized = texts.withColumn("key", F.xxhash64("doc_id", "source", "text")).mapInArrow(trimmed(_sizes), "doc_id long, source string, key long, size long")
    sized = durable(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    rows = sorted(((r[0], r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    shards = shards or shards_of(share * sum(r[1] or 0 for r in rows), len(rows))
    plan = _plan(rows, weights, share, max_passes, block_words, shards, seed)
    known = spark.createDataFrame([(r[0], i, int(r[1]), float(plan["target"][i]), r[2] // BUCKET_ROWS + 1, r[2]) for i, r in enumerate(rows)], "source string, s int, source_size long, target double, buckets long, _n long")
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source too
    sized, known = sized.withColumn("_s", named), known.withColumn("_s", named).drop("source")
    if len(rows) <= BROADCAST_SOURCES:
        sized = sized.join(F.broadcast(known.drop("_n")), "_s")
    else:
        sized = join_counted(sized, known, "_s", "_n", sum(r[2] for r in rows))
    sized = sized.drop("_s").withColumn("bucket", F.pmod("h", "buckets"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(base, ["s", "bucket"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    shared = spark.sparkContext.broadcast(plan)  # a few words a source and shard

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, begin, size = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "begin", "size"))
            d, f = _drawn(shared.value, s, begin, size)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(s)))])
            taken = pa.StructArray.from_arrays([pa.array(f[x.name]).cast(x.type) for x in _PIECE_ARROW], fields=list(_PIECE_ARROW))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "source", "key", "size", "source_size", "target")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken)], names=["doc_id", "source", "key", "size", "source_size", "target", "pieces"])

    kinds = f"doc_id long, source string, key long, size long, source_size long, target double, pieces array<struct<{PIECE.replace(' int', ':int').replace(' long', ':long')}>>"
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", "s", "begin").mapInArrow(trimmed(draw), kinds), shards


def taken_words(mixed: DataFrame) -> DataFrame:
    """mix()'s rows with taken, the number of words drawn from the document, repeats counted, instead of pieces."""
    return mixed.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"])).drop("pieces")


_PIECES = "shard int, epoch int, slot long, n_words long, doc_id long, lang string, source string, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key, a key's text before its ranges: equal rows share a key, so all its ranges are cut from one text."""
    last = None  # the last row with a text
    for batch in batches:
        for p in pieces(batch, "text", PIECE_BYTES):
            if last is not None:
                p = pa.concat_batches([last, p])
            texts = np.flatnonzero(p.column("text").is_valid().to_numpy(zero_copy_only=False))
            of = np.searchsorted(texts, np.arange(p.num_rows), "right") - 1  # the text above each row: its key has one
            last = p.slice(texts[-1], 1)
            at = np.flatnonzero(p.column("pieces").is_valid().to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            ranges = p.column("pieces").take(pa.array(at))
            n = pc.list_value_length(ranges).to_numpy(zero_copy_only=False).astype(np.int64)
            fields = dict(zip((f.name for f in _PIECE_ARROW), pc.list_flatten(ranges).flatten(), strict=True))
            row = np.repeat(texts[of[at]], n)
            used, spot = np.unique(row, return_inverse=True)
            q = p.take(pa.array(used))
            w = words_of(q.column("text"))
            a = w.first[spot] + fields["first_word"].to_numpy()
            begin, end = w.start[a], w.end[a + fields["n_words"].to_numpy() - 1]
            offsets = np.concatenate([[0], np.cumsum(end - begin)])
            cut = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(w.data[spans(begin, end - begin)]))
            yield pa.RecordBatch.from_arrays([*(fields[k] for k in ("shard", "epoch", "slot", "n_words")), *(q.column(k).take(pa.array(spot)) for k in ("doc_id", "lang", "source")), cut.cast(pa.string())], names=["shard", "epoch", "slot", "n_words", "doc_id", "lang", "source", "text"])


def mix_texts(docs: DataFrame, *, weights: Callable[[int], Sequence[float]] = cyclic_weights, share: float = 1.5, max_passes: float = 2, block_words: int = 512, shards: int | None = None, seed: int = 42) -> DataFrame:
    """The mix itself: one row a drawn piece (shard, position, epoch, doc_id, lang, source, n_words, text), each shard
    in a locally shuffled order, one task a shard.  Ranges meet their text by key in one shuffle; of equal rows, which
    share a key, each partition sends the text once."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "source", "text")).where("text is not null").mapInArrow(trimmed(_once), "doc_id long, lang string, source string, text string, key long")
    mixed, shards = _mix(docs, weights, share, max_passes, block_words, shards, seed)
    drawn = mixed.where(F.size("pieces") > 0).select("key", "pieces")
    both = drawn.unionByName(texts, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", F.col("text").isNull())
    cut = both.mapInArrow(trimmed(_cut), _PIECES).withColumn("position", F.xxhash64(F.lit(seed), "source", "slot"))
    return cut.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "position", "slot", "doc_id").select("shard", "position", "epoch", "doc_id", "lang", "source", "n_words", "text")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with one key the first of every batch."""
    for b in batches:
        first = np.unique(b.column("key").to_numpy(), return_index=True)[1]
        yield b.take(pa.array(np.sort(first))) if len(first) < b.num_rows else b
