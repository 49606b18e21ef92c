"""Operator 2: token counts by rank-synchronous merging of ragged numpy arrays.

Texts of a batch are cut into pre-tokens at places no vocabulary piece can span, equal pre-tokens
are counted once (Arrow dictionary coding, exact), and the distinct ones are held as one flat array
of symbols.  In each round every sequence applies its lowest-rank pair, all sequences at once; a
sequence leaves when no pair of it is in the vocabulary.  Its tokens are the symbols that survive.

Cuts: two neighbouring characters that are neighbours in no piece can never be merged, nor can
anything across them, so cutting there changes no count.  This covers white space, line ends and
characters outside the vocabulary (which cost one token a UTF-8 byte), and keeps sequences short.

Ties: within a sequence the leftmost pair of the lowest rank goes first.  All its occurrences go at
once only where the merged piece has no extension of a rank as low or lower ("safe" pieces), as
then no other pair could come between; otherwise one occurrence a round.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
other columns are ignored.  The plan is one narrow pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, text_bytes, trimmed

SPACE = "▁"  # what the model writes for a space
PIECE_BYTES = 12 << 20
NEVER = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    char_class: np.ndarray  # code point → class of a known character, else 0
    class_symbol: np.ndarray  # class → symbol
    joins: np.ndarray  # may these two classes be neighbours in a piece?
    keys: np.ndarray  # open-addressed table of pairs of symbols, -1 where free
    merged: np.ndarray  # the symbol such a pair makes
    rank: np.ndarray  # of each symbol, lower is earlier
    safe: np.ndarray


def read_vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    name = {sp.id_to_piece(i): i for i in usable}
    score = np.full(sp.get_piece_size(), -np.inf)
    score[usable] = [sp.get_score(i) for i in usable]
    _, rank = np.unique(-score, return_inverse=True)
    pairs = [(name[w[:k]], name[w[k:]], i) for w, i in name.items() for k in range(1, len(w)) if w[:k] in name and w[k:] in name]
    left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
    safe = np.ones(len(rank), bool)
    for part in (left, right):
        safe[part[rank[made] <= rank[part]]] = False
    chars = sorted({c for w in name for c in w})
    cls = {c: k + 1 for k, c in enumerate(chars)}
    char_class = np.zeros(0x110000, np.int32)
    symbol = np.full(len(chars) + 1, -1, np.int64)
    joins = np.zeros((len(chars) + 1,) * 2, bool)
    for c, k in cls.items():
        char_class[ord(c)] = k
        symbol[k] = name.get(c, -1)
    if (symbol[1:] < 0).any():
        raise ValueError("a character of a piece is no piece itself")
    for w in name:
        for a, b in zip(w, w[1:]):
            joins[cls[a], cls[b]] = True
    char_class[ord(" ")] = cls.get(SPACE, 0)
    size = 1 << (4 * len(left)).bit_length()
    keys, merged = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    todo = left << 32 | right
    value, at = made, _slot(todo, size)
    while len(todo):
        first = np.unique(at, return_index=True)[1]
        won = np.zeros(len(at), bool)
        won[first] = True
        won &= keys[at] == -1
        keys[at[won]], merged[at[won]] = todo[won], value[won]
        todo, value, at = todo[~won], value[~won], (at[~won] + 1) % size
    v = Vocabulary(char_class, symbol, joins, keys, merged, rank.astype(np.int32), safe)
    _check(v, sp, name)
    return v


#: what a model may do to a text before it merges: each must cost what the library says
PROBES = ["a", " a", "a  b", "  a", "a ", "\t a\n\nb ", "ﬁ ²", "Ａ", "é", "e\u0301", "\u00a0x", "\u200bx", "\x00x", "\r\nx", "▁a", "a▁▁b", "<s>", "</s>", "<unk>", "<pad>", "<0x41>", "日本語", "😀", "12345", "don't", "A.B", "..."]


def _check(v: Vocabulary, sp, names: dict[str, int]) -> None:
    """Cuts and the space before a text hold for models that change no character and whose pieces cross no line end and no beginning
    of white space; any other model is refused, not counted wrong."""
    for w in names:
        if len(w) > 1 and "\n" in w or any(b == SPACE != a for a, b in zip(w, w[1:])):
            raise ValueError(f"the piece {w!r} crosses a place where texts are cut")
    got, want = token_counts(v, pa.array(PROBES)).tolist(), [len(x) for x in sp.encode(PROBES)]
    wrong = [p for p, a, b in zip(PROBES, got, want, strict=True) if a != b]
    if wrong:
        raise ValueError(f"this model treats {wrong[0]!r} in a way that is not supported")


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _find(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The symbol that each pair makes, -1 if none."""
    keys = left << 32 | right
    at, out = _slot(keys, len(v.keys)), np.full(len(keys), -1, np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        got = v.keys[at]
        hit = got == keys[todo]
        out[todo[hit]] = v.merged[at[hit]]
        more = ~hit & (got != -1)
        todo, at = todo[more], (at[more] + 1) % len(v.keys)
    return out


def survivors(v: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence first[i] .. first[i + 1] when no more pairs can be merged."""
    count = np.diff(first)
    seq = np.repeat(np.arange(len(count)), count)
    keep = np.repeat(count > 1, count)
    sym, seq = symbols[keep], seq[keep]
    makes = np.full(len(sym), -1, np.int64)  # what symbol i and the next make
    if len(sym):
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        makes[inner] = _find(v, sym[inner], sym[inner + 1])
    while len(sym):
        rank = np.where(makes >= 0, v.rank[makes], NEVER)
        begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        size = np.diff(np.concatenate([begin, [len(sym)]]))
        low = np.minimum.reduceat(rank, begin)
        more = low < NEVER
        if not more.all():
            count[seq[begin[~more]]] = size[~more]
            stay = np.repeat(more, size)
            sym, seq, makes, rank = sym[stay], seq[stay], makes[stay], rank[stay]
            if not len(sym):
                break
            low, size = low[more], size[more]
            begin = np.cumsum(size) - size
        at = np.flatnonzero(rank == np.repeat(low, size))
        # of overlapping occurrences every second one goes; of an unsafe piece only the first
        run = np.concatenate([[True], (np.diff(at) > 1) | (seq[at[1:]] != seq[at[:-1]])])
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        lead = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
        at = at[lead | (v.safe[makes[at]] & (place % 2 == 0))]
        sym[at] = makes[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        to = np.cumsum(stay) - 1
        sym, seq, makes = sym[stay], seq[stay], makes[stay]
        new = to[at]
        touch = np.zeros(len(sym), bool)
        touch[new] = True
        touch[new[new > 0] - 1] = True
        makes[touch] = -1
        touch[-1] = False
        touched = np.flatnonzero(touch)
        touched = touched[seq[touched] == seq[touched + 1]]
        makes[touched] = _find(v, sym[touched], sym[touched + 1])
    return count


def _tokens_of(v: Vocabulary, words: pa.Array) -> np.ndarray:
    """Tokens of each pre-token."""
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    width = np.diff(np.concatenate([np.flatnonzero(lead), [len(raw)]]))
    place = np.concatenate([[0], np.cumsum(lead)])[offs - offs[0]]
    cls = v.char_class[points]
    cut = np.ones(len(cls), bool)
    cut[1:] = ~v.joins[cls[:-1], cls[1:]]
    cut[place[:-1]] = True
    begin = np.flatnonzero(cut)
    n = survivors(v, v.class_symbol[cls], np.concatenate([begin, [len(cls)]]))
    n = np.where(cls[begin] == 0, width[begin], n)
    return np.add.reduceat(n, np.searchsorted(begin, place[:-1]))


def token_counts(v: Vocabulary, texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    out = np.zeros(len(size), np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    data = np.insert(data, offsets[:-1][full], 0x20)  # the model puts a space before every text
    first = offsets[:-1][full] + np.arange(len(full))
    before = np.concatenate([[0x0A], data[:-1]])
    cut = (data == 0x0A) | (before == 0x0A) | ((data == 0x20) & (before != 0x20) & (before != 0x81))
    cut[first] = True
    begin = np.flatnonzero(cut)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate([begin, [len(data)]]).astype(np.int64)), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    n = _tokens_of(v, coded.dictionary)[coded.indices.to_numpy()]
    out[full] = np.add.reduceat(n, np.searchsorted(begin, first))
    return out


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row.  The model file is read on the driver."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(f.read()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "text", PIECE_BYTES):
                size = np.diff(text_bytes(p.column("text"))[1])
                n = token_counts(shared.value, p.column("text"))
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(trimmed(count), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
