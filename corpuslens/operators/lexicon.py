"""Which terms of a lexicon, of any size, a text holds.

A few terms become one expression.  More, up to SCAN_TERMS and SCAN_BYTES, are broadcast as tables of their first bytes (eight at most) by
length; every place of a text is looked up in one narrow pass, and what longer terms have left is compared there.

More than that meet the texts by a join on anchors: the anchor of a term is the one of its 4-grams that
the fewest texts hold, so a text meets only terms whose rarest part it has, and holds them if a look says so.  A term with a 4-gram that no
text holds goes at once; terms under four characters are their own anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from corpuslens.functions import text as X

from .graph import durable

GRAM = 4
DIRECT_TERMS = 200  # searched one by one
HOT_ROWS = 1 << 20  # an anchor in more texts is dealt to several tasks
MAX_HOT = 10_000
SCAN_TERMS = 1 << 16  # broadcast and looked for in one pass
SCAN_BYTES = 4 << 20
HEAD = 8
SLOT_BITS = 20
PLACES = 1 << 18  # of texts, at once
PAIRS = 1 << 20
FOUND = ArrayType(StructType().add("term", "string").add("name", "string"))


def grams(x: Column | str, n: int) -> Column:
    """All runs of n characters, overlapping, each once."""
    return F.array_distinct(F.regexp_extract_all(F.col(x) if isinstance(x, str) else x, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def match_terms(docs: DataFrame, text: Column, lexicon: DataFrame, *, direct: int = DIRECT_TERMS, hot_rows: int = HOT_ROWS, scan: int = SCAN_TERMS) -> DataFrame:
    """docs with found: an array of structs (term, name), sorted, of the rows of lexicon (term, name) whose term the lowered text holds.  Null
    and empty terms are no terms; a null text holds none."""
    lexicon = lexicon.select("term", F.col("name").cast("string").alias("name")).where("term <> ''").distinct()
    few = lexicon.limit(direct + 1).collect()
    docs = X.computed_once(docs, _low=F.lower(text))
    if len(few) <= direct:
        pairs = F.array(*(F.struct(F.lit(r["term"]).alias("term"), F.lit(r["name"]).alias("name")) for r in few)) if few else F.array().cast("array<struct<term:string,name:string>>")
        held = F.coalesce(F.filter(pairs, lambda p: F.contains("_low", p["term"])), F.array().cast("array<struct<term:string,name:string>>"))
        return docs.withColumn("found", F.array_sort(F.array_distinct(held))).drop("_low")
    n, size = lexicon.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("name"), F.lit(0))), F.lit(0))).first()
    if n <= scan and size <= SCAN_BYTES:
        return scanned(docs, [(r["term"], r["name"]) for r in lexicon.collect()])
    found = candidates(docs, lexicon, hot_rows).groupBy("_h").agg(F.array_sort(F.collect_set(F.struct("term", "name"))).alias("_may"))
    joined = docs.withColumn("_h", F.xxhash64("_low")).join(found, "_h", "left")
    held = F.filter(F.coalesce("_may", F.array().cast("array<struct<term:string,name:string>>")), lambda p: F.contains("_low", p["term"]))
    return joined.withColumn("found", F.coalesce(held, F.array().cast("array<struct<term:string,name:string>>"))).drop("_h", "_low", "_may")


def scanned(docs: DataFrame, pairs: list[tuple[str, str | None]]) -> DataFrame:
    """docs without _low and with found, by one look at every place of _low."""
    pairs = sorted(pairs, key=lambda p: (p[0].encode(), p[1] is not None, (p[1] or "").encode()))
    terms = sorted({p[0].encode() for p in pairs})
    first = [k for k, p in enumerate(pairs) if not k or p[0] != pairs[k - 1][0]]
    shared = docs.sparkSession.sparkContext.broadcast((Terms(terms), np.array([*first, len(pairs)]), pairs))  # SCAN_TERMS and SCAN_BYTES at most
    columns = [c for c in docs.columns if c != "_low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, pairs = shared.value
        values = pa.array([{"term": t, "name": n} for t, n in pairs], pa.struct([("term", pa.string()), ("name", pa.string())]))
        for batch in batches:
            text, term = index.held_by(batch.column("_low"))
            rows = first[term + 1] - first[term]
            ends = np.cumsum(rows)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[term] - (ends - rows), rows)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, rows, batch.num_rows))]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), found], names=[*columns, "found"])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in columns]).add("found", FOUND))


class Terms:
    """Distinct terms, as bytes: by the length of their heads the sorted heads as numbers, which slots of hashed heads are in use,
    and the terms of each head."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(terms) + bytes(HEAD), np.uint8)
        self.tables = []
        heads = np.minimum(self.size, HEAD)
        for k in np.unique(heads).tolist():
            mine = np.flatnonzero(heads == k)
            code = _codes(self.data)[self.start[mine]] & _mask(k)
            mine, code = mine[np.argsort(code, kind="stable")], np.sort(code)
            distinct, begin = np.unique(code, return_index=True)
            used = np.zeros(1 << SLOT_BITS, bool)
            used[_slots(distinct)] = True
            self.tables.append((k, distinct, used, np.append(begin, len(code)), mine))

    def held_by(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of every term that a text holds, once, in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        if not len(texts) or not len(self.size) or data is None or not data.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, edge = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]], edge - edge[0]
        codes, found = _codes(np.concatenate([data, np.zeros(HEAD, np.uint8)])), [np.zeros(0, np.int64)]
        for lo in range(0, len(data), PLACES):
            here = codes[lo : min(lo + PLACES, len(data))].copy()
            new = [self._held(table, codes, here, lo, edge) for table in self.tables]
            found.append(np.unique(np.concatenate(new)))
        return np.divmod(np.unique(np.concatenate(found)), len(self.size))

    def _held(self, table: tuple, codes: np.ndarray, here: np.ndarray, lo: int, edge: np.ndarray) -> np.ndarray:
        """text * terms + term of the terms of a table that begin at the places lo, lo + 1, ... with the codes here."""
        k, distinct, used, begin, mine = table
        code = here & _mask(k)
        at = np.flatnonzero(used[_slots(code)])
        head = np.minimum(np.searchsorted(distinct, code[at]), len(distinct) - 1)
        same = distinct[head] == code[at]
        at, head = at[same] + lo, head[same]
        rows, out = begin[head + 1] - begin[head], [np.zeros(0, np.int64)]
        cuts = np.flatnonzero(np.diff(np.cumsum(rows) // PAIRS)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(at)], strict=True):
            n = rows[a:z]
            term = mine[np.arange(n.sum()) + np.repeat(begin[head[a:z]] - (np.cumsum(n) - n), n)]
            place = np.repeat(at[a:z], n)
            text = np.searchsorted(edge, place, "right") - 1
            keep = place + self.size[term] <= edge[text + 1]
            term, place, text, behind, own = term[keep], place[keep], text[keep], HEAD, _codes(self.data)
            while len(term):
                done = self.size[term] <= behind
                out.append(text[done] * len(self.size) + term[done])
                term, place, text = term[~done], place[~done], text[~done]
                differ = (codes[place + behind] ^ own[self.start[term] + behind]) & _mask(np.minimum(self.size[term] - behind, HEAD))
                term, place, text, behind = term[differ == 0], place[differ == 0], text[differ == 0], behind + HEAD
        return np.concatenate(out)


def _codes(data: np.ndarray) -> np.ndarray:
    """The HEAD bytes from every place on as a number, the last HEAD places left out: a view."""
    return np.ndarray(len(data) - HEAD, "<u8", np.ascontiguousarray(data), strides=(1,))


def _mask(size: int | np.ndarray) -> np.ndarray:
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.asarray(size).astype(np.uint64) * np.uint64(8))


def _slots(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def candidates(docs: DataFrame, lexicon: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_h, term, name): hashes of the texts _low that hold a term's anchor."""
    lexicon = lexicon.withColumn("size", F.length("term"))
    short = [r[0] for r in lexicon.where(F.col("size") < GRAM).select("size").distinct().collect()]  # three at most
    texts = docs.where("_low is not null").select(F.xxhash64("_low").alias("_h"), F.explode(F.concat(*(grams("_low", n) for n in (GRAM, *sorted(short))))).alias("gram"))
    counts = texts.groupBy("gram").agg(F.count("*").alias("n"))
    parts = F.when(F.col("size") >= GRAM, grams("term", GRAM)).otherwise(F.array("term"))
    each = X.computed_once(lexicon, grams=parts).select("term", "name", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    rarest = each.join(counts, "gram").groupBy("term", "name").agg(F.min(F.struct("n", "gram")).alias("a"), F.count("*").alias("met"), F.first("all").alias("all"))
    anchors = durable(rarest.where("met = all").select("term", "name", "a.gram", "a.n"))
    hot = anchors.where(F.col("n") > hot_rows).groupBy("gram").agg(F.ceil(F.max("n") / hot_rows).cast("long").alias("salts")).orderBy(F.desc("salts")).limit(MAX_HOT)
    hot = F.broadcast(durable(hot))  # at most MAX_HOT rows
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("_read"), F.col("salts"))).otherwise(0)
    left = texts.withColumn("_read", F.monotonically_increasing_id()).join(hot, "gram", "left").select("_h", "gram", salt.alias("salt"))
    right = anchors.join(hot, "gram", "left").select("gram", "term", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return left.join(right, ["gram", "salt"]).select("_h", "term", "name").distinct()
