"""Operator 12: spelling variants, by a positional q-gram index with a count filter.

Two words are near if one inserted, deleted or replaced code point tells them apart.  One edit spoils at most two of a word's
positional 2-grams and moves the others by one place at most.  So under any common order of the grams, words of one
length meet in one of the first three grams of each, and a word meets one that is longer by one in one of its first two and one of
the other's first three: a word is dealt only to the lists of its rarest grams, keyed by gram, place and length.

A task holds whole lists.  Inside a list it builds the index of all positional grams of its words; a probe merges its shortest
posting lists (as sorted runs), counts the common grams of what they hold, drops pairs under the bound that one edit leaves, and compares
the rest code point by code point.

Lists are as rare as their words' rarest gram.  A list that is still longer than GROUP_ROWS rows or GROUP_CELLS code points is
not merged: its words, and words too short for a common gram, meet under hashes of what is left when one
code point is dropped, of which a word has as many as code points and which at most an alphabet of words share at one place.

Order of grams: by how often they occur in all words, counted in 2^16 buckets, which is all that the driver sees.

Defined cases: null and empty words do not exist; null texts have no words; a null id is hashed as the text ''; repeated rows count again; long
words are whole; an empty table gives an empty table; columns other than those named are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, durable, mix64, spans, trimmed

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
DROP_ONE_IN = 31
RATIO = 10

GROUP_ROWS = 1 << 15
GROUP_CELLS = 1 << 22
BLOCK_CELLS = 1 << 21
MERGE_ROWS = 1 << 21
GRAM_BUCKETS = 1 << 16
SHORT = 4  # words up to here may share no gram after an edit
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word, n: lower-cased runs of letters with at least min_length code points and min_count occurrences.  With drop_one_in, a run whose
    crc32 of '<doc_id>:<run>' it divides loses the code point at crc32 % length first."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("word"))
    if drop_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "word").cast("binary"))).withColumn("k", (F.col("h") % F.length("word")).cast("int"))
        cut = F.expr("concat(substring(word, 1, k), substring(word, k + 2))")
        runs = runs.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all code points, how many of each word)."""
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, gram) of every 2-gram, row by row."""
    n = np.maximum(size - 1, 0)
    at = spans(np.cumsum(size) - size, n)
    row = np.repeat(np.arange(len(size)), n)
    return row, at - (np.cumsum(size) - size)[row], points[at] << 21 | points[at + 1]


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (mix64(gram.view(U64)) % U64(GRAM_BUCKETS)).astype(np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """Occurrences of 2-grams in all words, by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAM_BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(_bucket(_grams(*_code_points(b.column("word")))[2]), minlength=GRAM_BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(GRAM_BUCKETS, np.int64)
    for r in words.select("word").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r.bucket] = r.n
    return out


def _firsts(row: np.ndarray, n: int, *order: np.ndarray) -> np.ndarray:
    """Of rows' entries (row ascending), the n first of each row in order (last key first, as np.lexsort takes them)."""
    by = np.lexsort((*order, row))
    row = row[by]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    nth = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    return by[nth < n]


_LISTED = "size int, key long, role int, word string, n long"


def listed(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """Each word in the lists of its rarest positional grams: as one of the list's length (role 0), and as one shorter (role 1)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, size = _code_points(b.column("word"))
            row, place, gram = _grams(points, size)
            pick = _firsts(row, 3, place, gram, counts[_bucket(gram)])
            row, place, gram = row[pick], place[pick], gram[pick]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            two = nth < 2
            rows = np.concatenate([row, row[two], row[two]])
            places = np.concatenate([place, place[two], place[two] + 1])
            role = np.repeat([0, 1, 1], [len(row), two.sum(), two.sum()])
            long = size[rows] + role
            key = mix64(mix64((long << 32 | places).view(U64)) + np.concatenate([gram, gram[two], gram[two]]).view(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(long, pa.int32()), pa.array(key), pa.array(role, pa.int32()), b.column("word").take(pa.array(rows)), b.column("n").take(pa.array(rows))], names=["size", "key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(trimmed(deal), _LISTED)


def _near(a: np.ndarray, b: np.ndarray, size: np.ndarray, shorter: bool) -> np.ndarray:
    """Which rows of code point tables a and b (of size code points in a; one more in b if shorter) are one edit apart; pairs with
    too few common grams are dropped before the places are compared."""
    inside = np.arange(a.shape[1]) < size[:, None]
    same = (a == b) & inside
    if not shorter:
        enough = (same[:, 1:] & same[:, :-1]).sum(1) >= size - 3
        return enough & (same.sum(1) == size - 1)
    moved = (a[:, :-1] == b[:, 1:]) & inside[:, :-1]
    common = ((same[:, 1:] & same[:, :-1])[:, :-1] | (moved[:, 1:] & moved[:, :-1])).sum(1)
    out = common >= size - 2
    head = np.logical_and.accumulate(same[out], axis=1).sum(1)
    tail = np.logical_and.accumulate((moved | ~inside[:, :-1])[out][:, ::-1], axis=1).sum(1) - (a.shape[1] - 1 - size[out])
    out[out] = head + tail >= size[out]
    return out


def _pairs(size: np.ndarray, key: np.ndarray, role: np.ndarray, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (probe, found) of near words that share a list; rows come by key.  The probe is as long as what it finds (and comes
    first) or shorter by one."""
    points, n = _code_points(words)
    table = np.zeros((len(n), int(n.max()) + 2), np.uint32)
    table[np.repeat(np.arange(len(n)), n), spans(np.zeros(len(n), np.int64), n)] = points
    row, place, gram = _grams(points, n)
    code = mix64(key.view(U64))
    here, next_ = (mix64(mix64(code[row] + (place + k).view(U64)) + gram.view(U64)) for k in (0, 1))
    index = role[row] == 0
    by = np.argsort(here[index], kind="stable")
    posting, held = here[index][by], row[index][by]

    def lists(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.searchsorted(posting, h)
        return lo, np.searchsorted(posting, h, "right") - lo

    for shorter in (False, True):
        mine = role[row] == int(shorter)
        probe = row[mine]
        at = [lists(h[mine]) for h in ((here, next_) if shorter else (here,))]
        long = np.sum([x[1] for x in at], axis=0)
        pick = _firsts(probe, 2 if shorter else 3, long)
        probe, at, long = probe[pick], [(lo[pick], k[pick]) for lo, k in at], long[pick]
        part = (np.cumsum(long) - long) // MERGE_ROWS
        part = np.maximum.accumulate(part[np.searchsorted(probe, probe)]) if len(probe) else part  # a probe's lists stay together
        for p in np.unique(part):
            now = part == p
            merged = np.concatenate([np.repeat(probe[now], k[now]) * len(n) + held[spans(lo[now], k[now])] for lo, k in at])
            merged.sort(kind="stable")
            merged = merged[np.concatenate([[True], merged[1:] != merged[:-1]])] if len(merged) else merged
            a, b = merged // len(n), merged % len(n)
            if not shorter:
                a, b = a[a < b], b[a < b]
            step = max(1, BLOCK_CELLS // table.shape[1])
            for k in range(0, len(a), step):
                i, j = a[k : k + step], b[k : k + step]
                ok = _near(table[i], table[j], n[i], shorter)
                yield i[ok], j[ok]


_PAIRS = "word string, n long, near string, near_n long"


def merged_pairs(rows: DataFrame) -> DataFrame:
    """Near words that share a list, each pair once a list and direction."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
            size, key, role = (t.column(c).to_numpy() for c in ("size", "key", "role"))
            lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cells = np.add.reduceat(size.astype(np.int64) + 2, lead)
            block = (np.cumsum(cells) - cells) // BLOCK_CELLS
            cuts = [*lead[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))], len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                words, n = (t.column(c).slice(lo, hi - lo).combine_chunks() for c in ("word", "n"))
                for i, j in _pairs(size[lo:hi], key[lo:hi], role[lo:hi], words):
                    i, j = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([words.take(i), n.take(i), words.take(j), n.take(j)], names=["word", "n", "near", "near_n"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < GROUP_ROWS:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            last = len(key) - int(np.argmax(np.concatenate([key[::-1] != key[-1], [True]])))
            if last:
                yield from settle(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return rows.mapInArrow(trimmed(merge), _PAIRS)


def dropped_pairs(words: DataFrame) -> DataFrame:
    """Near words among words (word, n), by hashes of what is left when one code point is dropped."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = U64(0xD6E8FEB86659FD93)
        for b in batches:
            for word, n, i in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), b.column("id").to_pylist(), strict=True):
                x = mix64(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(U64))
                power = np.cumprod(np.concatenate([[U64(1)], np.full(len(x), base)]), dtype=U64)
                sums = np.concatenate([[U64(0)], np.cumsum(x * power[:-1], dtype=U64)])
                left = mix64(sums[:-1] * base + (sums[-1] - sums[1:])).view(np.int64)  # all times the base, less the dropped
                whole = mix64(sums[-1:] * base).view(np.int64)
                m = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([whole, left])), pa.array(np.arange(-1, m), pa.int32()), pa.array(np.full(m + 1, m), pa.int32()), pa.array(np.full(m + 1, i))], names=["left", "place", "size", "id"])

    words = words.withColumn("id", F.xxhash64("word"))
    left = words.mapInArrow(trimmed(drop), "left long, place int, size int, id long")
    a, b = (left.select("left", F.col("place").alias(f"p{k}"), F.col("size").alias(f"s{k}"), F.col("id").alias(f"id{k}")) for k in (1, 2))
    replaced = a.where("p1 >= 0").join(b.where("p2 >= 0"), (a["left"] == b["left"]) & (F.col("p1") == F.col("p2")) & (F.col("s1") == F.col("s2")) & (F.col("id1") < F.col("id2")))
    longer = a.where("p1 = -1").join(b.where("p2 >= 0"), (a["left"] == b["left"]) & (F.col("s1") + 1 == F.col("s2")))
    found = replaced.select("id1", "id2").unionByName(longer.select("id1", "id2")).distinct()
    for k, (word, n) in enumerate((("word", "n"), ("near", "near_n")), 1):
        found = found.join(words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(word), F.col("n").alias(n)), f"id{k}")
    found = found.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def near_words(words: DataFrame, *, group_rows: int = GROUP_ROWS, group_cells: int = GROUP_CELLS) -> DataFrame:
    """word, n, near, near_n: every near pair of words (word, n; no word twice), in both directions, possibly several times."""
    rows = listed(words, gram_counts(words))
    sizes = rows.groupBy("key", "size").agg(F.count("*").alias("rows")).where((F.col("rows") > group_rows) | (F.col("rows") * F.col("size") > group_cells))
    hot = durable(sizes.select("key").distinct())
    n_hot = hot.count()
    others = words.where(F.length("word") <= SHORT).select("word", "n")
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        others = others.unionByName(rows.join(side, "key", "left_semi").select("word", "n"))
        rows = rows.join(side, "key", "left_anti")
    out = merged_pairs(rows.repartition("key").sortWithinPartitions("size", "key", "role"))
    if n_hot or others.limit(1).count():
        out = out.unionByName(dropped_pairs(durable(others.distinct())))
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form.  (word, root): where following forms ends.  Each round doubles the way, and an n grows tenfold a step."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        then = durable(now.join(further, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        now = then.drop("moved")
        if not then.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, *, ratio: int = RATIO, group_rows: int = GROUP_ROWS, group_cells: int = GROUP_CELLS) -> DataFrame:
    """words: word, n (no word twice).  word, n, n_near (its near words), form (the near word of largest n, ties to the smallest, if that is at
    least ratio times n), form_n and root (where following forms from the word ends)."""
    words = durable(words.select("word", "n"))
    pairs = near_words(words, group_rows=group_rows, group_cells=group_cells).repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    placed = durable(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    ends = roots(placed.where(F.col("form").isNotNull()))
    return placed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
