"""Operator 5: SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits by majority over the XXH64 hashes of a text's word shingles (or, for a
similarity, WIDE_WORDS times 64 bits over its distinct shingles).  Equal fingerprints are one node,
so copies never meet in a comparison.

Pairs: fingerprints that differ in at most d bits agree in at least k of d + k blocks of bits, so
nodes are looked up under every choice of k blocks out of d + k; k grows with the number of nodes
so that such a group holds at most MEAN_GROUP random nodes (up to 4 x 10^12 nodes).  Within a group
the method decides: distances of every fingerprint to many reference fingerprints (pivots, drawn
from the data by hash) are tabulated; by the triangle inequality a pair whose distances to any
pivot differ by more than d is discarded, and the survivors are verified.  Only a spanning forest
of a group's links, the nearest ones, is emitted (the links decide by themselves there).

A similarity of word shingles (Jaccard) asks for a wide radius: d is the distance that wide
fingerprints of so similar texts have, and SLACK standard deviations.  No exact choice of blocks is
small there, so nodes are looked up under samples of bits, as many as find a pair at distance d with
probability FOUND (nearer pairs with more), and decided in the same way.  Pairs whose sizes and shingle
parities (MARKS) show that they cannot have the similarity go too, which loses none that has it.  The
links are then verified by the texts' shingle sets.  A link of the forest may fail there and part what it
tied, so a second pass over the same groups emits every other link between nodes that the verified links
leave apart, each once, and verifies those too: no pair that meets is left out, however large its group.
Only nodes with a link in the first pass take part in the second; its links are as many as there are
close pairs that are not similar, beside few that are.

Hot groups (more than GROUP_ROWS nodes) are dealt into chunks by hash and every two chunks meet in
a task of their own, exactly; a task walks its nodes breadth-first, comparing each only with nodes
not reached yet, so a dense group costs a few passes and emits less links than it has nodes.

Defined cases: a text without words has fingerprint 0, linked like any other; null text is empty;
null ids take part but are no component's id (unless it has no other); repeated rows share a
fingerprint; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, mix64, pieces, spans, trimmed, window_hashes, words_of
from .components import connected_components

PIECE_BYTES = 2 << 20
GROUP_ROWS = 4096
SMALL_GROUP = 512
ROWS_AT_ONCE = 64
PIVOTS = 32
MEAN_GROUP = 128
KEY_BITS = 40
FINGERPRINT_DOCS = 256
WIDE_WORDS = 4
SLACK = 1.5
MARKS = ["size", "p0", "p1"]  # distinct shingles, and 128 parities of how many of them have a hash
FOUND = 0.99


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    w = words_of(texts, lower=True)
    size = w.end - w.start
    out = np.zeros(w.n_docs, np.uint64)
    if not len(size):
        return out
    end = np.cumsum(size + 1)
    joined = np.full(end[-1], 0x20, np.uint8)
    joined[spans(end - size - 1, size)] = w.data[spans(w.start, size)]
    text = joined.tobytes()
    per = np.where(w.per_doc > 0, np.maximum(w.per_doc - shingle + 1, 1), 0)
    first = np.repeat(w.first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    last = np.minimum(first + shingle, np.repeat(w.first[1:], per)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip((end - size - 1)[first].tolist(), (end - 1)[last].tolist(), strict=True)), np.uint64, len(first))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(per)
    set_ = np.add.reduceat(bits, (np.cumsum(per) - per)[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * set_ > per[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_sets(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle of the texts, in order; of fewer words the whole sequence is one."""
    w = words_of(texts, lower=True)
    h, n = w.hashes(), w.per_doc
    doc = np.repeat(np.arange(w.n_docs), np.maximum(n - shingle + 1, 0))
    full = window_hashes(h, shingle)[spans(w.first[:-1], np.maximum(n - shingle + 1, 0))] if len(h) else h
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = np.array([window_hashes(h[a : a + k], int(k))[0] for a, k in zip(w.first[short], n[short], strict=True)], np.uint64)
    doc, key = np.concatenate([doc, short]), mix64(np.concatenate([full, whole]) + np.uint64(seed))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])[: len(doc)]
    return doc[new], key[new]


def wide_fingerprints(texts: pa.Array, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """(texts, WIDE_WORDS): the fingerprint of every text over its distinct shingles, hashed from the words' hashes."""
    return _wide(len(texts), *shingle_sets(texts, shingle, seed))


def _wide(n: int, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = np.zeros((n, WIDE_WORDS), np.uint64)
    if not len(doc):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, len(doc)))
    for k in range(WIDE_WORDS):
        for a in range(0, len(first), FINGERPRINT_DOCS):  # a few documents at a time: a byte a bit and shingle
            z = min(a + FINGERPRINT_DOCS, len(first))
            lo, hi = first[a], first[z] if z < len(first) else len(doc)
            bits = np.unpackbits(mix64(key[lo:hi] + np.uint64(k)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, first[a:z] - lo, axis=0, dtype=np.int32)
            out[doc[first[a:z]], k] = np.packbits(2 * ones > size[a:z, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_marks(texts: pa.Array, shingle: int, seed: int = 42) -> list[np.ndarray]:
    """MARKS of every text.  Every shingle that only one of two texts has turns one parity, so parities differ in no more places."""
    return _marks(len(texts), *shingle_sets(texts, shingle, seed))


def _marks(n: int, doc: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    size = np.bincount(doc, minlength=n)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
    place, out = mix64(key ^ np.uint64(0x5A5A)) >> np.uint64(57), [size]
    for half in (0, 1):
        bit = np.where(place >> np.uint64(6) == half, np.uint64(1) << (place & np.uint64(63)), np.uint64(0))
        parity = np.zeros(n, np.uint64)
        if len(first):
            parity[doc[first]] = np.bitwise_xor.reduceat(bit, first)
        out.append(parity)
    return out


def fingerprint_table(docs: DataFrame, *, shingle: int, seed: int = 42, wide: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of keep (longs) and the fingerprint as signed numbers f0, f1, ... with node, one number for all of them; if
    wide also MARKS."""
    n, marks = (WIDE_WORDS, MARKS) if wide else (1, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "text", PIECE_BYTES):
                sets = shingle_sets(p.column("text"), shingle, seed) if wide else ()
                fp = _wide(p.num_rows, *sets) if wide else fingerprints(p.column("text"), shingle, seed)[:, None]
                node = fp[:, 0].copy()
                for k in range(1, n):
                    node = mix64(node) ^ fp[:, k]
                columns = [node, *fp.T, *(_marks(p.num_rows, *sets) if wide else [])]
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), *(p.column(k) for k in keep), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)], names=["doc_id", *keep, "node", *(f"f{k}" for k in range(n)), *marks])

    kinds = ", ".join(["doc_id long", *(f"`{k}` long" for k in keep), "node long", *(f"f{k} long" for k in range(n)), *(f"{k} long" for k in marks)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(trimmed(run), kinds)


def block_masks(n: int, bits: int) -> list[int]:
    """Signed masks of the choices of k blocks among bits + k under which groups of n random nodes are small."""
    for k in range(1, 6):
        m = bits + k
        edges = [64 * i // m for i in range(m + 1)]
        if n >> (64 * k // m) <= MEAN_GROUP or k == 5:
            masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(m), k)]
            return [x - (1 << 64) if x >> 63 else x for x in masks]
    raise AssertionError


def radius(similarity: float) -> int:
    """Bits by which wide fingerprints of two texts with this Jaccard similarity differ, and SLACK standard deviations."""
    share, bits = acos(2 * similarity / (1 + similarity)) / pi, 64 * WIDE_WORDS
    return round(bits * share + SLACK * sqrt(bits * share * (1 - share)))


def bit_samples(n: int, bits: int, seed: int = 42) -> list[np.ndarray]:
    """Places of bits to look n nodes up under: enough bits for small groups, enough samples to meet pairs at distance bits."""
    size = max(1, ceil(log(max(n, 2) / MEAN_GROUP, 2)))
    meet = (1 - bits / (64 * WIDE_WORDS)) ** size
    rng = np.random.default_rng([seed, size])
    return [np.sort(rng.choice(64 * WIDE_WORDS, size, replace=False)) for _ in range(ceil(log(1 - FOUND) / log(1 - meet)) if meet < 1 else 1)]


def may_have(marks: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs i, j of marks (nodes, MARKS) can have the similarity.  Sets of sizes m and n that have it differ in at most
    (m + n) (1 - similarity) / (1 + similarity) members."""
    m, n = marks[i, 0].astype(np.int64), marks[j, 0].astype(np.int64)
    apart = np.abs(m - n)
    parities = np.bitwise_count(marks[i, 1:] ^ marks[j, 1:]).sum(axis=1, dtype=np.int64)
    return np.maximum(apart, parities) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6


def _close(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int, marks: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs i, j those that differ in at most bits bits and, with marks, may have the similarity, and in how many bits: pivot by
    pivot, then verified word by word."""
    for p in range(table.shape[1]):
        near = np.abs(table[i, p] - table[j, p]) <= bits
        i, j = i[near], j[near]
    far = np.zeros(len(i), np.int16)
    for k in range(fp.shape[1]):
        far += np.bitwise_count(fp[i, k] ^ fp[j, k])
        near = far <= bits
        i, j, far = i[near], j[near], far[near]
    if marks is not None:
        near = may_have(marks, i, j, similarity)
        i, j, far = i[near], j[near], far[near]
    return i, j, far


def _distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None, :] ^ pivots[None, :, :]).sum(axis=2, dtype=np.int16)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and their sizes."""
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return begin, np.diff(np.concatenate([begin, [len(group)]]))


def links(group: np.ndarray, fp: np.ndarray, pivots: np.ndarray, bits: int, nearest: int = 0, marks: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """fp: (nodes,) or (nodes, words), pivots alike.  Links (positions) that connect the nodes of each group as its close pairs do (with
    marks, as those that may have the similarity do), and in groups up to SMALL_GROUP those to every node's nearest nodes, as many as
    nearest says; groups are runs of equal numbers."""
    fp, pivots = fp.reshape(len(fp), -1), pivots.reshape(len(pivots), -1)
    table = _distances(fp, pivots)
    begin, size = _runs(group)
    left, right, far = [], [], []
    small = np.repeat(np.where(size <= SMALL_GROUP, size, 0), size)
    place = np.arange(len(group)) - np.repeat(begin, size)
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero(place + d < small)
        if not len(i):
            break
        i, j, x = _close(fp, table, i, i + d, bits, marks, similarity)
        left.append(i)
        right.append(j)
        far.append(x)
    for b, n in zip(begin[size > SMALL_GROUP], size[size > SMALL_GROUP], strict=True):
        rest = np.arange(b, b + n)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                q = queue.pop()
                _, hit, x = _close(fp, table, np.full(len(rest), q), rest, bits, marks, similarity)
                if len(hit):
                    left.append(np.full(len(hit), q))
                    right.append(hit)
                    far.append(x)
                    queue.extend(hit)
                    rest = rest[~np.isin(rest, hit, assume_unique=True)]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    far = np.concatenate(far)
    kept = _forest(len(fp), i, j, far)
    if nearest:
        end, link = np.concatenate([i, j]), np.concatenate([np.arange(len(i))] * 2)
        order = np.lexsort((link, far[link], end))
        nth = np.arange(len(order)) - np.searchsorted(end[order], end[order])
        kept = np.union1d(kept, link[order[nth < nearest]])
    return i[kept], j[kept]


def open_pairs(group: np.ndarray, label: np.ndarray, fp: np.ndarray, pivots: np.ndarray, bits: int, marks: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All close pairs (positions) of each group that may have the similarity and whose labels differ; groups are runs of equal numbers."""
    table = _distances(fp, pivots)
    begin, size = _runs(group)
    small = np.repeat(np.where(size <= SMALL_GROUP, size, 0), size)
    place = np.arange(len(group)) - np.repeat(begin, size)
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero(place + d < small)
        if not len(i):
            break
        i = i[label[i] != label[i + d]]
        yield _close(fp, table, i, i + d, bits, marks, similarity)[:2]
    for b, n in zip(begin[size > SMALL_GROUP], size[size > SMALL_GROUP], strict=True):
        for k in range(b, b + n, ROWS_AT_ONCE):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(k, min(k + ROWS_AT_ONCE, b + n)), np.arange(k, b + n), indexing="ij"))
            apart = (i < j) & (label[i] != label[j])
            yield _close(fp, table, i[apart], j[apart], bits, marks, similarity)[:2]


def _forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Those of the links i, j of n nodes that connect what all of them connect by the nearest links (every part takes its nearest
    link out, part by part, until none is left)."""
    root, found, open_ = np.arange(n), [], np.arange(len(i))
    while True:
        a, b = root[i[open_]], root[j[open_]]
        open_, a, b = open_[a != b], a[a != b], b[a != b]
        if not len(open_):
            return np.concatenate(found) if found else open_
        part, link = np.concatenate([a, b]), np.concatenate([open_, open_])
        order = np.lexsort((link, far[link], part))
        lead = order[np.concatenate([[True], np.diff(part[order]) > 0])]
        part, link = part[lead], link[lead]
        other = np.where(root[i[link]] == part, root[j[link]], root[i[link]])
        up = np.arange(n)
        up[part] = other
        both = (up[other] == part) & (part < other)  # two parts chose one link: the lesser stays
        up[part[both]] = part[both]
        found.append(link[~both])
        while (up != up[up]).any():
            up = up[up]
        root = up[root]


def _groups(nodes: DataFrame, bits: int, count: int) -> tuple[DataFrame, list[str]]:
    """The nodes (node, f0, ... and other longs) under every choice of blocks or sample of bits for count nodes, sorted by group, and the
    columns that tell a group.  Of wide fingerprints the sample's number is held above KEY_BITS of key.  meet tells which two chunks of a hot group meet, and
    which of them is the node's own: (lesser << 32 | greater) << 1 | own is the greater."""
    names, carried = [c for c in nodes.columns if c[0] == "f" and c[1:].isdigit()], nodes.columns
    if len(names) > 1:
        samples = bit_samples(count, bits)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = np.stack([b.column(k).to_numpy() for k in names], axis=1)
                set_ = np.unpackbits(fp.astype("<i8").view(np.uint8), axis=1, bitorder="little")
                for t, places in enumerate(samples):
                    key = set_[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places))) + (np.int64(t) << KEY_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *carried])

        keyed, by = nodes.mapInArrow(trimmed(looked_up), ", ".join(["key long", *(f"{k} long" for k in carried)])), ["key"]
    else:
        masks = block_masks(count, bits)
        keyed = nodes.select(*carried, F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("f0").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))).alias("g")).select("g.t", "g.key", *carried)
        by = ["t", "key"]
    hot = keyed.groupBy(*by).count().where(F.col("count") > GROUP_ROWS).select(*by, F.ceil(F.col("count") / GROUP_ROWS).cast("long").alias("chunks"))
    hot = F.broadcast(hot)  # at most a row for GROUP_ROWS rows, and the rows are shuffled once
    dealt = keyed.join(hot, by, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    meet = F.shiftleft(F.shiftleft(F.least(own, "other"), 32).bitwiseOR(F.greatest(own, "other")), 1).bitwiseOR((own > F.col("other")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(*by, meet.alias("meet"), *carried)
    cell = F.shiftright("meet", 1)
    return dealt.repartition(*by, cell).sortWithinPartitions(*by, cell, F.xxhash64(*by, "node")), by  # other walks in every group


def _by_group(ordered: DataFrame, by: list[str], linked: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """(u, v) that linked makes of batches of whole groups and the groups' numbers."""

    def changes(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(b.num_rows, bool)
        for x in (*(b.column(k).to_numpy() for k in by), b.column("meet").to_numpy() >> 1):
            out[1:] |= x[1:] != x[:-1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if b.num_rows:
                rest = b if rest is None else pa.concat_batches([rest, b])
                at = np.flatnonzero(changes(rest))
                if len(at):
                    whole, rest = rest.slice(0, int(at[-1])), rest.slice(int(at[-1]))
                    yield linked(whole, np.cumsum(changes(whole)))
        if rest is not None:
            yield linked(rest, np.cumsum(changes(rest)))

    return ordered.mapInArrow(trimmed(run), "u long, v long")


def _unsigned(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([b.column(k).to_numpy() for k in names], axis=1).view(np.uint64)


def _pairs(b: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    node = b.column("node")
    return pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], names=["u", "v"])


def _pivots(nodes: DataFrame, names: Sequence[str]) -> np.ndarray:
    few = PIVOTS // WIDE_WORDS if len(names) > 1 else PIVOTS  # pivots discard little at a wide radius
    return np.array([list(r) for r in nodes.select(*names).orderBy(F.xxhash64("node"), "node").limit(few).collect()], np.int64).reshape(-1, len(names)).view(np.uint64)


def near_links(nodes: DataFrame, *, bits: int = 4, similarity: float = 0.0) -> DataFrame:
    """(u, v): links between nodes (node, f0, ...) that leave no close pair unconnected; of wide fingerprints with MARKS, as many pairs as
    FOUND says, and only those that may have the similarity."""
    names = [c for c in nodes.columns if c[0] == "f" and c[1:].isdigit()]
    pivots, marked = _pivots(nodes, names), "size" in nodes.columns
    ordered, by = _groups(nodes, bits, nodes.count())

    def linked(b: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        i, j = links(group, _unsigned(b, names), pivots, bits, 0, _unsigned(b, MARKS) if marked else None, similarity)
        return _pairs(b, i, j)

    return _by_group(ordered, by, linked)


def links_between(nodes: DataFrame, count: int, *, bits: int, similarity: float) -> DataFrame:
    """(u, v): every pair of nodes (node, label, f0, ..., MARKS) of different labels that near_links over count nodes would find close, once."""
    names = [c for c in nodes.columns if c[0] == "f" and c[1:].isdigit()]
    pivots, samples = _pivots(nodes, names), bit_samples(count, bits)
    ordered, by = _groups(nodes, bits, count)

    def linked(b: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        fp, label, meet = _unsigned(b, names), b.column("label").to_numpy(), b.column("meet").to_numpy()
        sample, one, second = b.column("key").to_numpy() >> KEY_BITS, meet >> 33 == (meet >> 1) & 0xFFFFFFFF, meet & 1
        left, right = [], []
        for i, j in open_pairs(group, label, fp, pivots, bits, _unsigned(b, MARKS), similarity):
            met = one[i] | (second[i] != second[j])  # those of one chunk meet where it meets itself
            i, j = i[met], j[met]
            apart = np.unpackbits((fp[i] ^ fp[j]).astype("<u8").view(np.uint8).reshape(len(i), 8 * len(names)), axis=1, bitorder="little")
            first = np.full(len(i), len(samples))
            for t in reversed(range(len(samples))):
                first[~apart[:, samples[t]].any(axis=1)] = t
            left.append(i[first == sample[i]])
            right.append(j[first == sample[i]])
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        return _pairs(b, i, j)

    return _by_group(ordered, by, linked)


def near_duplicates(docs: DataFrame, *, bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach from the document."""
    marked = durable(fingerprint_table(docs, shingle=shingle, seed=seed))
    classes, total = _classes(marked, bits)
    return join_counted(marked.select("doc_id", "node"), classes.select("node", "component_id", "docs"), "node", "docs", total).select("doc_id", F.col("node").alias("fp"), "component_id")


def similar_links(links: DataFrame, marked: DataFrame, texts: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """Those of the links (u, v) whose texts' shingle sets have the similarity.  marked: row, node; texts: row, text.  One text stands
    for a node, and only texts of linked nodes are read into sets."""
    pairs = durable(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    rows = marked.groupBy("node").agg(F.min("row").alias("row")).join(ends, "node", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "text", PIECE_BYTES):
                doc, key = shingle_sets(p.column("text"), shingle, seed)
                offsets = np.searchsorted(doc, np.arange(p.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([p.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))], names=["node", "shingles"])

    sets = durable(texts.join(rows, "row").dropDuplicates(["node"]).select("node", "text").mapInArrow(trimmed(read), "node long, shingles array<long>"))
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(shared >= similarity * (F.size("su") + F.size("sv") - shared) - 1e-9).select("u", "v")


def _classes(marked: DataFrame, bits: int, verify: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> tuple[DataFrame, int]:
    """(node, docs, root, component_id of every distinct fingerprint; rows of marked).  verify, for wide fingerprints (with row), keeps the links
    whose texts have the similarity."""
    names = [c for c in marked.columns if c[0] == "f" and c[1:].isdigit()]
    kept = [F.min(F.struct("row", *MARKS)).alias("m")] if verify else []  # of the row whose text stands for the node
    nodes = marked.groupBy("node", *names).agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"), *kept)
    nodes = durable(nodes.select("node", *names, "least", "docs", *(f"m.{k}" for k in MARKS if verify)))
    total, n_nodes = nodes.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count("*")).first()
    if verify:
        roots = _verified_roots(nodes.select("node", *names, *MARKS), n_nodes, bits, verify, similarity)
    else:
        roots = connected_components(near_links(nodes.select("node", *names), bits=bits))
    placed = durable(nodes.drop(*names, *MARKS).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return durable(join_counted(placed, smallest, "root", "members", n_nodes).select("node", "docs", "root", "component_id")), total


def _verified_roots(nodes: DataFrame, count: int, bits: int, verify: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, root) of the components that verified links make: of a forest's links first, then of all others between what those leave apart."""
    found = durable(near_links(nodes, bits=bits, similarity=similarity).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    roots = durable(connected_components(verify(found)))
    ends = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labelled = ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    linked = durable(nodes.join(labelled, "node"))
    more = links_between(linked, count, bits=bits, similarity=similarity).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    labels = linked.select("node", "label")
    ties = verify(more.join(found, ["u", "v"], "left_anti"))
    for end in ("u", "v"):
        ties = ties.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end)
    tops = connected_components(ties.select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))
    return labels.join(tops.select(F.col("node").alias("label"), F.col("root").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("root"))


def one_of_each(docs: DataFrame, *, similarity: float | None = None, shingle: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """docs with one row of each component: the row with the smallest doc_id (null ids last; of equal ids the first by text hash;
    equal rows are one).  Links are those of texts whose shingle sets have the similarity; without one, of 64-bit fingerprints that
    differ in at most bits bits.  One row key a component survives and meets the texts in one shuffle."""
    key, wide = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), similarity is not None
    texts = docs.select("doc_id", "text", key.alias("row"))
    marked = durable(fingerprint_table(texts, shingle=shingle, seed=seed, wide=wide, keep=["row"]))
    if wide:
        classes, total = _classes(marked, radius(similarity), lambda links: similar_links(links, marked, texts.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), similarity, shingle, seed), similarity)
    else:
        classes, total = _classes(marked, bits)
    rooted = join_counted(marked.select("doc_id", "row", "node"), classes.select("node", "root", "docs"), "node", "docs", total)
    chosen = rooted.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")).select("row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(key.alias("row"), F.struct(*columns).alias("all")).join(chosen, "row", "left_semi")
    return kept.groupBy("row").agg(F.min_by("all", F.xxhash64("all.*")).alias("all")).select("all.*")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
