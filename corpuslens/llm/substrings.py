"""Operator 10: exact substring dedup behind a count-min prefilter.

A window is 20 consecutive words; a word goes if a window over it also starts earlier.

1. Sketch.  Every window is represented by its anchor, the least hash of the 10-word runs inside it:
   equal windows have equal anchors at different places, and neighbouring windows share one, so
   about a sixth as many anchors as windows are counted and an anchor's count is never below a
   window's.  Anchors are dealt into cell shards by hash, as many as the corpus asks for (CELL_BYTES
   of text each), so the sketch's fill does not depend on the corpus.  A piece of a partition is a
   sparse sketch; a cell shard merges its pieces into count-min rows that saturate at two, and
   answers each document shard which of the anchors it asked for have an estimate of two or more.
   Anchors that a piece itself has twice are answered where they are, so a passage that a third of
   the documents share sends one entry a piece.  Nothing is collected or broadcast.
2. Exact pass.  Only windows whose anchor was answered are grouped, in shards by hash, packed as
   arrays.  A document shard sends just its first occurrence of a window (later ones are repeats
   already); a shard keeps the first place of each hash and passes the others on, so no group is
   gathered.  Estimates are never too low, so no repeat is lost; a full sketch only lets more
   windows through.
3. Places of repeats meet their documents and the words go.  Documents are dealt by key once; the
   second and the third step read the same shuffle.

Windows are told apart by 64-bit hashes of their words (chance of any mistake about n^2 / 2^65 for n
windows that pass the sketch).

Defined cases: null text has no words; null ids come last in order; rows with the same id are the
same document at the same place, so equal occurrences in them do not remove each other; documents
under 20 words lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import U64, Words, durable, mix64, pieces, spans, trimmed, window_hashes, within_docs, words_of

CELL_BITS = 24
ROWS = 2
CELL_BYTES = 256 << 20  # text for each cell shard: about 8 million anchors in 2^24 cells a row
PART_BYTES = 48 << 20  # text for each shard of documents, and of windows, at most
FLUSH_ANCHORS = 2 << 20
FLUSH_WINDOWS = 1 << 20
NULL_ID = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _windows(w: Words, window: int, run: int) -> tuple[np.ndarray, ...]:
    """(starts, hashes, anchors) of the windows of all documents; the hash at every place that is an anchor, and the place."""
    h = w.hashes()
    inside = within_docs(w.first, window, len(h))
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, h[:0], h[:0], h[:0], starts
    short, span = mix64(window_hashes(h, run)), window - run + 1
    least = _sliding(short, span, np.minimum)
    # a run is an anchor if it is the least of some window over it; equal runs in one window all count
    edge = np.zeros(span - 1, U64)
    most = _sliding(np.concatenate([edge, np.where(inside, least, U64(0)), edge]), span, np.maximum)
    anchors = np.flatnonzero(most == short)
    return starts, mix64(window_hashes(h, window)[starts]), least[starts], short[anchors], anchors


def _cells(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each scrambled anchor in every row."""
    return [(x >> U64(8 + 28 * r) & U64((1 << bits) - 1)).astype(np.int64) for r in range(ROWS)]


def _blob(of: np.ndarray, x: np.ndarray) -> bytes:
    """Anchors x, each with a number, sorted by number."""
    order = np.argsort(of, kind="stable")
    of = of[order]
    lead = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return b"".join(y.tobytes() for y in (np.array([len(x), len(lead)], np.int64), of[lead].astype(np.int64), np.diff(np.append(lead, len(of))), x[order]))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(blob, np.int64, 2)
    head = np.frombuffer(blob, np.int64, 2 * k, 16).reshape(2, k)
    return np.repeat(head[0], head[1]), np.frombuffer(blob, U64, n, 16 + 16 * k)


_MESSAGE = "kind int, shard int, blob binary"


def asked_anchors(texts: DataFrame, cell_shards: int, window: int, run: int) -> DataFrame:
    """From texts (text, shard): kind 0 to cell shards: anchors with the document shard that asks, or -1 for those that occur twice
    here; kind 1 to document shards: such anchors."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, doc_shard, n = (np.concatenate(y) for y in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc_shard, x))
            x, doc_shard, n = x[order], doc_shard[order], n[order]
            lead = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            twice = np.repeat(np.add.reduceat(n, lead) > 1, np.diff(np.append(lead, len(x)))) if len(x) else np.zeros(0, bool)
            once = np.concatenate([[True], (x[1:] != x[:-1]) | (doc_shard[1:] != doc_shard[:-1])])[: len(x)]
            yield _rows(1, ((d, _blob(np.zeros(len(y), np.int64), y)) for d, (y,) in _deal(doc_shard[once & twice], x[once & twice])))
            first = lead[twice[lead]]
            x = np.concatenate([x[~twice & once], x[first]])
            of = np.concatenate([doc_shard[~twice & once], np.full(len(first), -1)])
            yield _rows(0, ((c, _blob(*y)) for c, y in _deal((x % U64(cell_shards)).astype(np.int64), of, x)))

        for batch in batches:
            for p in pieces(batch, "text"):
                w = words_of(p.column("text"))
                found, at = _windows(w, window, run)[3:]
                doc_shard = p.column("shard").to_numpy()[np.searchsorted(w.first, at, "right") - 1].astype(np.int64)
                held.append((mix64(found), doc_shard, np.ones(len(found), np.int64)))
                count += len(found)
                if count > FLUSH_ANCHORS:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    return texts.select("text", "shard").mapInArrow(trimmed(ask), _MESSAGE)


def answered_anchors(asked: DataFrame, cell_shards: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """Kind 1 to document shards: of the anchors they asked for, those that the merged sketch estimates at two or more."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            seen, twice = np.zeros((ROWS, 1 << cell_bits), bool), np.zeros((ROWS, 1 << cell_bits), bool)
            for blob in blobs:
                of, x = _unblob(blob)
                for r, cells in enumerate(_cells(x, cell_bits)):
                    twice[r, cells[of < 0]] = True
                    cells = np.sort(cells)
                    twice[r, cells[1:][cells[1:] == cells[:-1]]] = True
                    twice[r, cells[seen[r, cells]]] = True
                    seen[r, cells] = True
            for blob in blobs:
                of, x = _unblob(blob)
                often = of >= 0
                for r, cells in enumerate(_cells(x, cell_bits)):
                    often &= twice[r, cells]
                yield _rows(1, ((d, _blob(np.zeros(len(y), np.int64), y)) for d, (y,) in _deal(of[often], x[often])))

        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if shard != now:
                    yield from answer()
                    now, blobs = shard, []
                blobs.append(blob)
        yield from answer()

    return asked.where("kind = 0").select("shard", "blob").repartitionById(cell_shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(trimmed(merge), _MESSAGE)


def _pack_windows(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, h: np.ndarray | None = None) -> bytes:
    """Windows of several documents as bytes, by document and place: ids, keys, counts, steps between places, hashes."""
    order = np.lexsort((at, keys))
    ids, keys, at = ids[order], keys[order], at[order]
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    parts = [np.array([len(at), len(lead)], np.int64), ids[lead], keys[lead], np.diff(np.append(lead, len(at))), np.diff(at, prepend=0).astype(np.int32)]
    return b"".join(x.tobytes() for x in ([*parts, h[order]] if h is not None else parts))


def _unpack_windows(blob: bytes) -> tuple[np.ndarray, ...]:
    """(ids, keys, places, hashes or nothing)."""
    n, d = np.frombuffer(blob, np.int64, 2)
    head = np.frombuffer(blob, np.int64, 3 * d, 16).reshape(3, d)
    at = np.cumsum(np.frombuffer(blob, np.int32, n, 16 + 24 * d), dtype=np.int64)
    rest = 16 + 24 * d + 4 * n
    return np.repeat(head[0], head[2]), np.repeat(head[1], head[2]), at, np.frombuffer(blob, np.int64, n, rest) if len(blob) > rest else None


def _deal(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each shard."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        yield int(shard[part[0]]), [x[part] for x in arrays]


def _rows(kind: int, found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["kind", "shard", "blob"])


def repeated_windows(dealt: DataFrame, answers: DataFrame, shards: int, window: int, run: int) -> DataFrame:
    """dealt: text, id (its order), key (its row) and shard; answers: shard, blob.  (shard, blob): places of windows that also start
    earlier, packed by document, to their document's shard."""

    def candidates(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = [_unblob(b)[1] for b in answers.column("blob").to_pylist()]
        known = np.unique(np.concatenate(known)) if known else np.zeros(0, U64)
        firsts, repeats, count, out = [], [], 0, []

        def flush() -> None:
            if firsts:
                h, ids, keys, at = map(np.concatenate, zip(*firsts, strict=True))
                out.append(_rows(0, ((s, _pack_windows(*x[1:], x[0])) for s, x in _deal((h.view(U64) % U64(shards)).astype(np.int64), h, ids, keys, at))))
            if repeats:
                ids, keys, at = map(np.concatenate, zip(*repeats, strict=True))
                out.append(_rows(1, ((s, _pack_windows(*x)) for s, x in _deal(keys % shards, ids, keys, at))))
            firsts.clear()
            repeats.clear()

        for batch in texts.select(["text", "id", "key"]).to_batches():
            for p in pieces(batch, "text"):
                w = words_of(p.column("text"))
                starts, hashes, anchors = _windows(w, window, run)[:3]
                x = mix64(anchors)
                hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
                starts, h = starts[hit], hashes[hit].view(np.int64)
                doc = np.searchsorted(w.first, starts, "right") - 1
                ids, keys, at = p.column("id").to_numpy()[doc], p.column("key").to_numpy()[doc], starts - w.first[doc]
                first, rest = _first_of_each(h, ids, keys, at)
                firsts.append(first)
                repeats.append(rest[1:])
                count += len(h)
                if count > FLUSH_WINDOWS:
                    flush()
                    count = 0
        flush()
        return pa.Table.from_batches(out or [_rows(0, ())])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        now, known, held, count = None, (none,) * 4, [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal known, held, count
            known, later = _first_of_each(*map(np.concatenate, zip(known, *held, strict=True)))
            held, count = [], 0
            yield _rows(1, ((s, _pack_windows(*x)) for s, x in _deal(later[2] % shards, *later[1:])))

        for b in batches:
            for kind, shard, blob in zip(*(b.column(k).to_pylist() for k in ("kind", "shard", "blob")), strict=True):
                if kind:
                    yield _rows(1, [(shard, blob)])
                    continue
                if shard != now:
                    yield from settle()
                    now, known = shard, (none,) * 4
                ids, keys, at, h = _unpack_windows(blob)
                held.append((h, ids, keys, at))
                count += len(h)
                if count > FLUSH_WINDOWS:
                    yield from settle()
        yield from settle()

    found = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_trimmed_table(candidates), _MESSAGE)
    return found.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard").mapInArrow(trimmed(repeats), _MESSAGE).select("shard", "blob")


def _trimmed_table(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def then_trim(left: pa.Table, right: pa.Table) -> pa.Table:
        return next(iter(trimmed(lambda _: iter([run(left, right)]))(iter(()))))

    return then_trim


def _first_of_each(h: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Windows split into those at their hash's first place (id, at) and the later ones."""
    order = np.lexsort((at, ids, h))
    h, ids, keys, at = h[order], ids[order], keys[order], at[order]
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    of = np.repeat(lead, np.diff(np.append(lead, len(h))))
    first = (ids == ids[of]) & (at == at[of])
    return tuple(x[first] for x in (h, ids, keys, at)), tuple(x[~first] for x in (h, ids, keys, at))


def remove_repeats(docs: DataFrame, *, keep: Sequence[str] = (), window: int = 20, run: int = 10, part_bytes: int = PART_BYTES, cell_bytes: int = CELL_BYTES, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, the columns of keep, n_words, n_removed and kept_text (the words left, joined by one space)."""
    kept = [F.col(f"`{c}`").alias(f"_keep{k}") for k, c in enumerate(keep)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n_bytes) // part_bytes + 1)
    cell_shards = int(n_bytes) // cell_bytes + 1
    texts = texts.withColumn("id", F.coalesce("doc_id", F.lit(int(NULL_ID)))).withColumn("key", F.xxhash64("id", "text")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    dealt = texts.repartition(shards, "shard")
    asked = durable(asked_anchors(texts, cell_shards, window, run))
    answers = asked.where("kind = 1").unionByName(answered_anchors(asked, cell_shards, cell_bits)).select("shard", "blob").repartition(shards, "shard")
    places = repeated_windows(dealt, answers, shards, window, run).repartition(shards, "shard")
    names = ["doc_id", *(f"_keep{k}" for k in range(len(keep)))]

    def cut(texts: pa.Table, places: pa.Table) -> pa.Table:
        got = [_unpack_windows(b) for b in places.column("blob").to_pylist()]
        keys, at = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in (1, 2))
        order = np.argsort(keys, kind="stable")
        keys, at, out = keys[order], at[order], []
        for batch in texts.to_batches():
            for q in pieces(batch, "text"):
                w = words_of(q.column("text"))
                mine = q.column("key").to_numpy()
                lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
                s = at[spans(lo, hi - lo)] + np.repeat(w.first[:-1], hi - lo)
                gone = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(gone, s, 1)
                np.add.at(gone, s + window, -1)
                left, removed = kept_words(w, ~(np.cumsum(gone[:-1]) > 0))
                out.append(pa.RecordBatch.from_arrays([*(q.column(k) for k in names), pa.array(w.per_doc, pa.int64()), pa.array(removed, pa.int64()), left], schema=schema))
        return pa.Table.from_batches(out, schema)

    kinds = [(k, texts.schema[k].dataType) for k in names] + [("n_words", LongType()), ("n_removed", LongType()), ("kept_text", StringType())]
    result = StructType([StructField(k, t) for k, t in kinds])
    schema = to_arrow_schema(result)
    done = dealt.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(_trimmed_table(cut), result)
    return done.select("doc_id", *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)), "n_words", "n_removed", "kept_text")


def kept_words(w: Words, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the kept words of each document joined by one space, words dropped)."""
    held = np.concatenate([[0], np.cumsum(keep)])
    n = held[w.first[1:]] - held[w.first[:-1]]
    start, size = w.start[keep], (w.end - w.start)[keep]
    last = np.cumsum(n)[n > 0] - 1
    room = size + 1
    room[last] -= 1  # no space after a document's last word
    end = np.cumsum(room)
    data = np.full(end[-1] if len(end) else 0, 0x20, np.uint8)
    data[spans(end - room, size)] = w.data[spans(start, size)]
    offsets = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)), w.per_doc - n
