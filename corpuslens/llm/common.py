"""What the operators share: ragged numpy views of Arrow text, durable intermediate tables.

All text work is done on the UTF-8 bytes of one Arrow batch at a time.  A batch is cut into
pieces of a few megabytes (:func:`pieces`), so memory does not grow with a partition; a single
document is never cut, whatever its length.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20
HOT_KEY_SHARE = 1e-4
HOT_KEY_ROWS = 64
U64 = np.uint64

#: space and \t \n \v \f \r: what parts words everywhere in this subpackage
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def durable_path(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share (spark.checkpoint.dir); a temporary one in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpuslens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_MADE: list[list[str]] = []  # for each open scratch() the tables made in it


def durable(df: DataFrame) -> DataFrame:
    """Materialise df once in the cluster's shared checkpoint folder and cut its lineage."""
    durable_path(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _MADE:
        _MADE[-1].append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that durable() makes inside are deleted at the end: what needs them must have been written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            delete(spark, path)


def join_counted(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with side, whose column n tells how many of the total rows have its key.  Keys with more than HOT_KEY_SHARE of the
    rows (so at most 1 / HOT_KEY_SHARE of them) are broadcast and their rows stay where they are; the others are shuffled."""
    most = max(HOT_KEY_ROWS, int(total * HOT_KEY_SHARE))
    hot = F.broadcast(side.where(F.col(n) > most).drop(n))
    cold = side.where(F.col(n) <= most).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def pieces(batch: pa.RecordBatch, text: str, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each piece has about max_bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size, dtype=np.int64) - size) // max_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which its worker gives memory it no longer needs back: workers live on and serve other operators."""

    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return then_trim


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Words of several documents, one after the other.

    data: the documents' bytes; offsets: where documents begin in data; start, end: of each word
    in data; first: first[d] .. first[d + 1] are document d's words; inside: which bytes are words'.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    inside: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.per_doc)

    def as_arrow(self) -> pa.Array:
        """The words as an Arrow binary array."""
        size = self.end - self.start
        offs = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(self.data[self.inside])])

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """(id of each word, the distinct words): exact, ids count from 0 in order of appearance."""
        coded = self.as_arrow().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        ids, words = self.distinct()
        return hash_binary(words)[ids]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i], one span after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


spans = _spans


def words_of(texts: pa.Array, lower: bool = False, breaks: np.ndarray = IS_SPACE) -> Words:
    """Words of every text: runs of bytes that breaks does not mark."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, bool))
    inside = ~breaks[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = inside[edge]
    finish[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(finish) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), inside)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser known as splitmix64)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS = np.ones(1, U64)


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    global _POWERS
    if base != 0xD6E8FEB86659FD93:
        return np.concatenate([[U64(1)], np.cumprod(np.full(max(n - 1, 0), base, U64), dtype=U64)])[:n]
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[U64(1)], np.cumprod(np.full(2 * n, base, U64), dtype=U64)])
    return _POWERS[:n]


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: scrambled bytes times powers of an odd base, summed."""
    if not len(start):
        return np.zeros(0, U64)
    full = size > 0
    out = np.zeros(len(start), U64)
    if full.any():
        s, n = start[full], size[full]
        at = _spans(s, n)
        ends = np.cumsum(n)
        place = np.arange(len(at)) - np.repeat(ends - n, n)
        terms = _BYTE[data[at]] * powers(int(n.max()))[place]
        out[full] = np.add.reduceat(terms, ends - n)
    return mix64(out ^ (size.astype(U64) << U64(48)))


_BYTE = mix64(np.arange(1, 257, dtype=U64)) | U64(1)


def hash_binary(words: pa.Array) -> np.ndarray:
    """hash_spans of the values of a binary array without nulls."""
    large = pa.types.is_large_binary(words.type) or pa.types.is_large_string(words.type)
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return hash_spans(raw, offs[:-1], np.diff(offs))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive values (position-weighted sum, modulo 2^64)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[k : len(h) - n + 1 + k]
    return out


def within_docs(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each of total - n + 1 windows: does it lie in one document?"""
    count = max(total - n + 1, 0)
    if not count:
        return np.zeros(0, bool)
    ok = np.ones(total, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0)]] = False
    # a boundary before word b spoils windows that begin at b-n+1 .. b-1
    return ok[:count]


def cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mark positions inside [s, s + n) for any start s."""
    delta = np.zeros(total + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + n, total), -1)
    return np.cumsum(delta[:-1]) > 0


def column(name_values: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(name_values[f.name], type=f.type) if not isinstance(name_values[f.name], pa.Array) else name_values[f.name].cast(f.type) for f in schema], schema=schema)
