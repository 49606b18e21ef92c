"""Operator 8: language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by one space and an end byte.  Every byte is eight binary
decisions; a decision is made in the tree of contexts that the preceding bytes form, down to DEPTH
bytes.  Each node of the tree estimates by Krichevsky-Trofimov (n1 + 1/2) / (n0 + n1 + 1); a node's
weighted probability is half its own estimate's block probability and half the product of its
children's, so predictions mix the estimates of all depths by how well each has coded the corpus.
Contexts that were not seen in training predict as their longest seen suffix.

Counts come from every training text: (DEPTH + 1)-grams of bytes are summed per partition, dealt by
their contexts' last TRUNK_DEPTH bytes and summed in shards.  No context is left out: the tree grows with the corpus.
A shard holds whole branches, the nodes deeper than TRUNK_DEPTH; what a branch's nodes weigh together goes
to the trunk, the nodes up to TRUNK_DEPTH (at most 256 ** 3 grams of them), which is built on the
driver and broadcast.  Grams with at least HOT_SHARE of all occurrences are broadcast with their
probabilities; other grams travel to their shard, as cold words do.  A shard that more than twice the
mean number of them ask (a frequent ending) has copies in tasks of their own, and pieces of the corpus
ask one of them.

Base score (add-0.1 unigram): word counts are summed in shards by word hash.  Words with at least
HOT_SHARE of the tokens (at most 1 / HOT_SHARE of them, a proven bound) are broadcast with their
counts; other words' occurrences travel to their shard, and partial sums travel to their document,
packed as arrays, so no word and no document gathers an unbounded group.  Words are told apart by
64-bit hashes.

Defined cases: null text is empty (the end byte and token only); without training rows N and V are
0, the base score is 0 and every byte costs 8 bits; repeated rows count and are scored each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, hash_spans, mix64, pieces, spans, trimmed, words_of

DEPTH = 5
END = 0x0A
TRUNK_DEPTH = 2
FLUSH = 3 << 20
HOT_SHARE = 1e-6
MIN_SHARDS = 64
SHARD_BYTES = 32 << 20
ASK_GRAMS = 1 << 18
PIECE_BYTES = 2 << 20
END_HASH = hash_spans(np.array([END], np.uint8), np.array([0]), np.array([1]))


# --- text -------------------------------------------------------------------------------------


def plain_text(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first) of the texts: DEPTH end bytes, words joined by a space, an end byte."""
    size = w.end - w.start
    ends = np.cumsum(size + 1)
    at = np.concatenate([[0], ends])[w.first]
    words = np.diff(at)
    room = words + np.where(words > 0, 0, 1) + DEPTH
    first = np.concatenate([[0], np.cumsum(room)])
    data = np.full(first[-1], END, np.uint8)
    doc = w.doc_of()
    place = first[doc] + DEPTH + (ends - size - 1 - at[doc])
    data[spans(place, size)] = w.data[spans(w.start, size)]
    inner = np.ones(len(size), bool)
    inner[w.first[1:][words > 0] - 1] = False
    data[(place + size)[inner]] = 0x20
    return data, first


def grams(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((DEPTH + 1)-gram that ends at each byte of the texts, as a number, newest byte lowest; grams of each text)."""
    n = len(data)
    key = np.zeros(max(n - DEPTH, 0), U64)
    for k in range(DEPTH + 1):
        key = key << U64(8) | data[k : n - DEPTH + k]
    size = np.diff(first) - DEPTH
    return key[spans(first[:-1], size)], size


def word_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, first): the words of each document and its end token."""
    first = w.first + np.arange(len(w.first))
    out = np.repeat(END_HASH, len(w.start) + w.n_docs)
    out[np.arange(len(w.start)) + w.doc_of()] = w.hashes()
    return out, first


def _sum_equal(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat(counts[order], lead) if len(lead) else counts[:0]


# --- counting ---------------------------------------------------------------------------------

_BLOBS = "kind int, shard int, blob binary"


def _rows(kind: int, found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["kind", "shard", "blob"])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each after its type."""
    head = np.array([len(arrays[0]), len(arrays)], np.int64).tobytes() + b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, out = 16 + 4 * k, []
    for i in range(k):
        kind = np.dtype(blob[16 + 4 * i : 20 + 4 * i].decode().strip())
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out


def _deal(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        yield int(shard[part[0]]), _pack(*(x[part] for x in arrays))


def _gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys >> U64(8) & U64((1 << 8 * TRUNK_DEPTH) - 1)) % U64(shards)).astype(np.int64)  # a branch stays together


@dataclass
class Copies:
    """How many tasks hold each shard of grams, and the number of its second one: the first is the shard's own."""

    n: np.ndarray
    second: np.ndarray

    @staticmethod
    def by(load: np.ndarray) -> Copies:
        n = np.maximum(1, np.ceil(load / max(2 * load.mean(), 1))).astype(np.int64) if len(load) else np.zeros(0, np.int64)
        return Copies(n, len(n) + np.cumsum(n - 1) - (n - 1))

    def task(self, shard: np.ndarray, salt: int) -> np.ndarray:
        """The task of each shard that a piece of the corpus asks."""
        pick = salt % self.n[shard]
        return np.where(pick > 0, self.second[shard] + pick - 1, shard)


def corpus_counts(texts: DataFrame, shards: int) -> DataFrame:
    """Summed over the rows of texts (text, train) that train: kind 0 grams by order, kind 1 words, packed by shard."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, place in ((0, _gram_shard), (1, lambda k, n: (k % U64(n)).astype(np.int64))):
                if held[kind]:
                    keys, counts = _sum_equal(*map(np.concatenate, zip(*held[kind], strict=True)))
                    held[kind].clear()
                    yield _rows(kind, _deal(place(keys, shards), keys, counts))

        for batch in batches:
            for p in pieces(batch.filter(batch.column("train")), "text", PIECE_BYTES):
                w = words_of(p.column("text"), lower=True)
                for kind, keys in ((0, grams(*plain_text(w))[0]), (1, word_hashes(w)[0])):
                    keys = np.sort(keys)
                    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    held[kind].append((keys[lead], np.diff(np.append(lead, len(keys)))))
                if sum(len(k) for h in held for k, _ in h) > FLUSH:
                    yield from flush()
        yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = None, [], 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            return _sum_equal(*map(np.concatenate, zip(*held, strict=True)))

        for b in batches:
            for kind, shard, blob in zip(*(b.column(k).to_pylist() for k in ("kind", "shard", "blob")), strict=True):
                if (kind, shard) != now:
                    if held:
                        yield _rows(now[0], [(now[1], _pack(*settle()))])
                    now, held, count = (kind, shard), [], 0
                held.append(tuple(_unpack(blob)))
                count += len(held[-1][0])
                if count > FLUSH:
                    held = [settle()]
                    count = 0
        if held:
            yield _rows(now[0], [(now[1], _pack(*settle()))])

    parts = texts.select("text", "train").mapInArrow(trimmed(partial), _BLOBS)
    return parts.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(trimmed(total), _BLOBS)


# --- the weighted tree ------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(6):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log block probability of n0 zeros and n1 ones under the Krichevsky-Trofimov estimator."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Tree:
    """Nodes by depth: key (context, bits so far), probability of a one, and weight of the node's own estimate."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, counts: np.ndarray, depths: range = range(DEPTH + 1), above: tuple[np.ndarray, np.ndarray] | None = None):
        """keys: grams; level: bytes of context each has; counts: occurrences; depths: those of the nodes to hold; above: nodes of
        the last of these depths and the log weight of their children, if those are held elsewhere."""
        self.keys, self.one, self.own = [], [], []
        tables = []
        for d in reversed(depths):  # a gram counts at its own depth and at every lower one
            mask = U64((1 << 8 * (d + 1)) - 1)
            here = level >= d
            k, n = _sum_equal(keys[here] & mask, counts[here].astype(float))
            tables.append(self._nodes(k, n))
        below = above
        for d, (k, n0, n1) in zip(reversed(depths), tables, strict=True):
            own = log_kt(n0, n1)
            weighted, weight = own.copy(), np.ones(len(k))
            if below is not None and len(below[0]):
                parent, wc = below
                at = np.searchsorted(k, parent)
                inner = np.bincount(at, minlength=len(k)) > 0
                children = np.bincount(at, wc, len(k))
                weighted[inner] = np.logaddexp(own[inner], children[inner]) - np.log(2)
                weight[inner] = 1 / (1 + np.exp(-np.clip(own - children, -60, 60)[inner]))
            below = ((k >> U64(9) & U64((1 << 8 * max(d - 1, 0)) - 1)) << U64(9) | k & U64(511), weighted)
            self.keys.insert(0, k)
            self.one.insert(0, ((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32))
            self.own.insert(0, weight.astype(np.float32))
        self.above = _sum_equal(*below)

    def on(self, trunk: Tree) -> Tree:
        """The tree of a trunk's nodes and these deeper ones."""
        out = copy(self)
        out.keys, out.one, out.own = trunk.keys + self.keys, trunk.one + self.one, trunk.own + self.own
        return out

    @staticmethod
    def _nodes(grams_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ctx, y, out = grams_ >> U64(8), grams_ & U64(255), []
        for j in range(8):
            k = ctx << U64(9) | U64(1 << j) | y >> U64(8 - j)
            one = (y >> U64(7 - j) & U64(1)).astype(bool)
            lead = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            if len(lead):
                out.append((k[lead], np.add.reduceat(np.where(one, 0, n), lead), np.add.reduceat(np.where(one, n, 0), lead)))
        if not out:
            return np.zeros(0, U64), np.zeros(0), np.zeros(0)
        k, n0, n1 = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(k)
        return k[order], n0[order], n1[order]

    def log10(self, g: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of every gram after the others."""
        y, out = g & U64(255), np.zeros(len(g))
        for j in range(8):
            one = (y >> U64(7 - j) & U64(1)).astype(bool)
            prefix = U64(1 << j) | y >> U64(8 - j)
            p = np.full(len(g), 0.5)
            alive = np.arange(len(g))  # a deeper node exists only where the shallower one does
            for d in range(DEPTH + 1):
                key = (g[alive] >> U64(8) & U64((1 << 8 * d) - 1)) << U64(9) | prefix[alive]
                at = np.minimum(np.searchsorted(self.keys[d], key), max(len(self.keys[d]) - 1, 0))
                hit = self.keys[d][at] == key if len(self.keys[d]) else np.zeros(len(key), bool)
                alive, at = alive[hit], at[hit]
                if not len(alive):
                    break
                q = np.where(one[alive], self.one[d][at], 1 - self.one[d][at].astype(float))
                # own[d] weighs this estimate against what is deeper; unrolled from the root: rest is what is left
                if d == 0:
                    rest = np.ones(len(g))
                    mixed = np.zeros(len(g))
                mixed[alive] += rest[alive] * self.own[d][at] * q
                rest[alive] *= 1 - self.own[d][at]
                p[alive] = mixed[alive] + rest[alive] * q  # were this the deepest node, it would predict alone
            out += np.log10(p)
        return out


def branches(keys: np.ndarray, counts: np.ndarray) -> Tree:
    """The nodes deeper than the trunk of a shard's grams."""
    return Tree(keys, np.full(len(keys), DEPTH), counts, range(TRUNK_DEPTH + 1, DEPTH + 1))


def trunk_of(grams_: DataFrame) -> tuple[Tree, int]:
    """(the nodes up to TRUNK_DEPTH, occurrences of all grams), from packed shards of grams (column blob)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                keys, n = _unpack(blob)
                low = _sum_equal(keys & U64((1 << 8 * (TRUNK_DEPTH + 1)) - 1), n)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(*low)], pa.binary()), pa.array([_pack(*branches(keys, n).above)], pa.binary())], names=["low", "above"])

    got = grams_.mapInArrow(trimmed(part), "low binary, above binary").collect()  # a suffix of TRUNK_DEPTH bytes is in one shard only
    none = [np.zeros(0, U64), np.zeros(0, np.int64)], [np.zeros(0, U64), np.zeros(0)]
    low, above = (_sum_equal(*map(np.concatenate, zip(*(_unpack(r[k]) for r in got), strict=True))) if got else none[k] for k in (0, 1))
    return Tree(low[0], np.full(len(low[0]), TRUNK_DEPTH), low[1], range(TRUNK_DEPTH + 1), above), int(low[1].sum())


class Known:
    """A hash table of grams and their log10 probabilities."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.slots, self.value = np.full(size, ~U64(0)), np.zeros(size, np.float32)
        at = (mix64(keys) & U64(size - 1)).astype(np.int64)
        while len(keys):
            won = np.zeros(len(at), bool)
            won[np.unique(at, return_index=True)[1]] = True
            won &= self.slots[at] == ~U64(0)
            self.slots[at[won]], self.value[at[won]] = keys[won], value[won]
            keys, value, at = keys[~won], value[~won], (at[~won] + 1) % size

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability or 0, is it known?) of every gram."""
        size = len(self.slots)
        at, out, todo = (mix64(g) & U64(size - 1)).astype(np.int64), np.zeros(len(g)), np.arange(len(g))
        known = np.zeros(len(g), bool)
        while len(todo):
            got = self.slots[at]
            hit, free = got == g[todo], got == ~U64(0)
            out[todo[hit]] = self.value[at[hit]]
            known[todo[hit]] = True
            more = ~(hit | free)
            todo, at = todo[more], (at[more] + 1) % size
        return out, known


def _asked(item: np.ndarray, doc: np.ndarray, key: np.ndarray, shard_of: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, bytes]]:
    """Occurrences of items in documents, by the items' shards: items, how often each occurs, the document of each occurrence and
    the documents' keys."""
    order = np.argsort(item, kind="stable")
    item, doc = item[order], doc[order]
    lead = np.ones(len(item), bool)
    lead[1:] = item[1:] != item[:-1]
    shard = shard_of(item)
    order = np.argsort(shard, kind="stable")
    found = []
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        mine = lead[part]
        docs_, of = np.unique(doc[part], return_inverse=True)
        found.append((int(shard[part[0]]), b"".join(len(x).to_bytes(8, "little") + x for x in (_pack(item[part[mine]]), _pack(np.diff(np.append(np.flatnonzero(mine), len(part))).astype(np.int32)), _pack(of.astype(np.int32)), _pack(key[docs_])))))
    return found


def _asked_parts(blob: bytes) -> list[np.ndarray]:
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        parts.append(_unpack(blob[at + 8 : at + 8 + size])[0])
        at += 8 + size
    return parts


# --- scoring ----------------------------------------------------------------------------------


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; learn: the rows that train."""
    from .common import durable

    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    n_bytes = int(texts.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = max(MIN_SHARDS, n_bytes // SHARD_BYTES + 1)
    counts = durable(corpus_counts(texts, shards))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                keys, n = _unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["v", "n"])

    words = counts.where("kind = 1")
    v, n = (int(x or 0) for x in words.select("blob").mapInArrow(trimmed(summary), "v long, n long").agg(F.sum("v"), F.sum("n")).first())
    least = max(1, int(np.ceil(HOT_SHARE * n)))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                keys, c = _unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(keys[c >= least], c[c >= least])], pa.binary())], names=["blob"])

    hot = [_unpack(r[0]) for r in words.select("blob").mapInArrow(trimmed(often), "blob binary").collect()]  # at most 1 / HOT_SHARE words
    hot = _sum_equal(*map(np.concatenate, zip(*hot, strict=True))) if hot else (np.zeros(0, U64), np.zeros(0, np.int64))

    grams_ = counts.where("kind = 0").select("blob")
    tree, n_grams = trunk_of(grams_)
    trunk = spark.sparkContext.broadcast(tree)
    common = max(1, int(np.ceil(HOT_SHARE * n_grams)))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob").to_pylist():
                keys, c = _unpack(blob)
                chosen = keys[c >= common]
                if len(chosen):
                    yield pa.RecordBatch.from_arrays([pa.array([_pack(chosen, branches(keys, c).on(trunk.value).log10(chosen).astype(np.float32))], pa.binary())], names=["blob"])

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist(), strict=True):
                c = _unpack(blob)[1]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(c[c < common].sum())], pa.int64())], names=["shard", "n"])

    load = np.zeros(shards, np.int64)
    for shard, asks in counts.where("kind = 0").select("shard", "blob").mapInArrow(trimmed(loads), "shard int, n long").collect():  # a row a shard
        load[shard] += asks
    copies = Copies.by(load)

    known_grams = [_unpack(r[0]) for r in grams_.mapInArrow(trimmed(valued), "blob binary").collect()]  # at most 1 / HOT_SHARE grams
    shared = spark.sparkContext.broadcast((Known(*(map(np.concatenate, zip(*known_grams, strict=True)) if known_grams else (np.zeros(0, U64), np.zeros(0)))), hot, copies))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_table, (hot_keys, hot_counts), held = shared.value
        for batch in batches:
            for p in pieces(batch, "text", PIECE_BYTES):
                w = words_of(p.column("text"), lower=True)
                g, size = grams(*plain_text(w))
                value, is_known = known_table.find(g)
                score = np.add.reduceat(value, np.cumsum(size) - size)
                tokens, first = word_hashes(w)
                at = np.minimum(np.searchsorted(hot_keys, tokens), max(len(hot_keys) - 1, 0))
                is_hot = hot_keys[at] == tokens if len(hot_keys) else np.zeros(len(tokens), bool)
                logs = np.where(is_hot, np.log10(hot_counts[at] + 0.1) if len(hot_keys) else 0, 0.0)
                key = p.column("key").to_numpy()
                doc = np.repeat(np.arange(p.num_rows), np.diff(first))
                known = np.add.reduceat(is_hot.astype(np.int64), first[:-1])
                ids = p.column("doc_id")
                yield _rows(2, _deal(key % shards, key, np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), np.diff(first), known, np.add.reduceat(logs, first[:-1]), score))
                yield _rows(3, _asked(tokens[~is_hot], doc[~is_hot], key, lambda k: (k % U64(shards)).astype(np.int64)))
                yield _rows(4, _asked(g[~is_known], np.repeat(np.arange(p.num_rows), size)[~is_known], key, lambda k: held.task(_gram_shard(k, shards), abs(int(key[0])) >> 8)))  # noqa: B023

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cold words meet their counts and cold grams their branches; documents' sums go on to the documents."""
        now, keys, c = None, np.zeros(0, U64), np.zeros(0, np.int64)
        tree, asked, n_asked = None, [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            distinct, of = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
            value = np.repeat(tree.log10(distinct)[of], np.concatenate([x[1] for x in asked]))
            doc_keys, doc = np.unique(np.concatenate([x[3][x[2]] for x in asked]), return_inverse=True)
            yield _rows(4, _deal(doc_keys % shards, doc_keys, np.bincount(doc, value, len(doc_keys))))

        for b in batches:
            for kind, shard, blob in zip(*(b.column(k).to_pylist() for k in ("kind", "shard", "blob")), strict=True):
                if shard != now:
                    if asked:
                        yield from answer()
                    now, keys, c = shard, keys[:0], c[:0]
                    tree, asked, n_asked = None, [], 0
                if kind == 0:
                    tree = branches(*_unpack(blob)).on(trunk.value)
                elif kind == 1:
                    keys, c = _unpack(blob)
                elif kind == 2:
                    yield _rows(2, [(shard, blob)])
                elif kind == 3:
                    cold, times, of, doc_keys = _asked_parts(blob)
                    place = np.minimum(np.searchsorted(keys, cold), max(len(keys) - 1, 0))
                    got = np.where(keys[place] == cold, c[place], 0) if len(keys) else np.zeros(len(cold), np.int64)
                    got = np.repeat(got, times)
                    sums = np.bincount(of, np.log10(got + 0.1), len(doc_keys))
                    known = np.bincount(of, got > 0, len(doc_keys)).astype(np.int64)
                    yield _rows(3, _deal(doc_keys % shards, doc_keys, known, sums))
                else:
                    if tree is None:
                        tree = branches(np.zeros(0, U64), np.zeros(0, np.int64)).on(trunk.value)
                    asked.append(_asked_parts(blob))
                    n_asked += len(asked[-1][2])
                    if n_asked > ASK_GRAMS:
                        yield from answer()
                        asked, n_asked = [], 0
        if asked:
            yield from answer()

    base = float(np.log10(n + 0.1 * (v + 1)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a shard's documents; equal rows got each other's sums too and share them."""
        now, rows, sums, gram_sums = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            key, ids, valid, tokens, known, logs, score = map(np.concatenate, zip(*rows, strict=True))
            distinct, of, times = np.unique(key, return_inverse=True, return_counts=True)
            if sums:
                k, more_known, more = map(np.concatenate, zip(*sums, strict=True))
                at = np.searchsorted(distinct, k)
                known = known + (np.bincount(at, more_known, len(distinct)) / times)[of].round().astype(np.int64)
                logs = logs + (np.bincount(at, more, len(distinct)) / times)[of]
            if gram_sums:
                k, more = map(np.concatenate, zip(*gram_sums, strict=True))
                score = score + (np.bincount(np.searchsorted(distinct, k), more, len(distinct)) / times)[of]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~valid), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs - tokens * base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for kind, shard, blob in zip(*(b.column(k).to_pylist() for k in ("kind", "shard", "blob")), strict=True):
                if shard != now:
                    yield from close()
                    now, rows, sums, gram_sums = shard, [], [], []
                {2: rows, 3: sums, 4: gram_sums}[kind].append(_unpack(blob))
        yield from close()

    keyed = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    extra = [(s, int(copies.second[s] + k)) for s in np.flatnonzero(copies.n > 1).tolist() for k in range(int(copies.n[s]) - 1)]  # half as many as shards at most
    found = keyed.mapInArrow(trimmed(read), _BLOBS).unionByName(counts)
    if extra:
        found = found.unionByName(counts.where("kind = 0").join(F.broadcast(spark.createDataFrame(extra, "shard int, task int")), "shard").select("kind", F.col("task").alias("shard"), "blob"))
    met = found.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(trimmed(look_up), _BLOBS)
    done = met.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(trimmed(finish), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(n).cast("long"))
