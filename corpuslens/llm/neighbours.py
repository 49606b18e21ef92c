"""Operator 11: nearest neighbours by few stable projections, a kd-tree over them and a chi-square stop.

Vectors are lifted by one coordinate so that the largest inner product is the least distance, and projected on AXES random normal
directions.  For a point at distance d, the squared projected distance divided by d^2 is chi-square distributed with AXES degrees of
freedom.  So if d is the distance of a query's k-th best so far, points beyond projected distance d * sqrt(quantile) are nearer than d
with a chance below 1 - confidence each: there the search stops.

1. A kd-tree over the projections of a bounded sample cuts the space into at most MAX_CELLS cells; every vector is dealt to its cell, and one
   pass takes the exact boxes and sizes of the cells.  A cell of more than UNIT_ROWS rows (many equal vectors, or a very large table) is
   several units, by hash of the row.
2. Every query searches the unit that holds its own row: the k-th best there is its first bound.
3. The query goes to every other unit of cells whose box its bound does not exclude, in chunks of QUERY_ROWS queries a unit.  A unit builds the kd-tree
   of its points; each query takes leaves by rising box distance, in doubling steps; points inside the radius are verified by their inner
   product in double precision (a leaf of which much lies inside as one block), the bound rises and the radius shrinks until no leaf is left.
4. What the units found meets by query, as 21 rows a unit at most.

On data without structure (independent random directions) the stop comes late and most pairs are verified, in blocks of units by chunks; on clustered
data few are.  Either way only queries meet all rows.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part; a shorter vector counts as filled up with zeros;
a query is one row and excludes only that row: another row with its id, or its vector, is a candidate; equal rows are one query; null ids are candidates that come
last among ties, never queries; fewer than k candidates are all returned; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, spans, trimmed

K = 20
AXES = 8  # even
CONFIDENCE = 0.95
SAMPLE_ROWS = 1 << 16
CELL_ROWS = 1 << 12
MAX_CELLS = 1 << 12
UNIT_ROWS = 1 << 16
QUERY_ROWS = 1 << 14
LEAF = 128
AT_ONCE = 2048
DENSE = 0.2  # share of a leaf inside the radius above which it is verified as one block
SEED = 7


def chi_square_quantile(p: float, n: int) -> float:
    """Of n (even) degrees of freedom, by halving."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, n // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 20.0 * n + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = np.asarray(vectors.value_lengths().fill_null(0))
    out = np.zeros((len(vectors), dim))
    out[np.repeat(np.arange(len(n)), n), spans(np.zeros(len(n), np.int64), n)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class Space:
    """The lifted, projected space: how rows become points of it and points of cells."""

    def __init__(self, dim: int, largest: float, axes: int, seed: int):
        self.dim, self.largest = dim, largest
        self.directions = np.random.default_rng(seed).standard_normal((dim + 1, axes))
        self.axis, self.at = np.zeros(0, np.int64), np.zeros(0)

    def points(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.directions[:-1] + lift[:, None] * self.directions[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions[:-1]

    def split(self, sample: np.ndarray, depth: int) -> None:
        """Cut at the medians of the widest axes, depth levels deep."""
        self.axis, self.at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        held = {0: sample}
        for node in range(2**depth - 1):
            s = held.pop(node)
            if len(s):
                self.axis[node] = a = int(np.argmax(np.ptp(s, axis=0)))
                self.at[node] = np.median(s[:, a])
            right = s[:, self.axis[node]] >= self.at[node]
            held[2 * node + 1], held[2 * node + 2] = s[~right], s[right]

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range((len(self.at) + 1).bit_length() - 1):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] >= self.at[node])
        return node - len(self.at)


def leaves(p: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, cuts of the leaves in it) of a kd-tree."""
    order, cuts, todo = np.arange(len(p)), [0], [(0, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            cuts.append(b)
            continue
        own = order[a:b]
        x, mid = p[own, np.argmax(np.ptp(p[own], axis=0))], (b - a) // 2
        order[a:b] = own[np.argpartition(x, mid)]
        todo += [(a + mid, b), (a, a + mid)]
    return order, np.array(cuts)


def _box_distances(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p), len(lo)))
    for a in range(p.shape[1]):
        x = p[:, a, None]
        out += np.maximum(np.maximum(lo[:, a] - x, x - hi[:, a]), 0) ** 2
    return out


def _best(q: np.ndarray, at: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Entries that are among the k best of their query; ties to the smaller rank of their point."""
    by = np.lexsort((rank[at], -score, q))
    lead = np.flatnonzero(np.concatenate([[True], np.diff(q[by]) > 0])) if len(by) else by
    nth = np.arange(len(by)) - np.repeat(lead, np.diff(np.append(lead, len(by))))
    return by[nth < k]


def search_unit(space: Space, x: np.ndarray, rank: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, point, score) of each query's k best points among x that reach its bound, as found until the stop; how many pairs were verified."""
    p = space.points(x)
    order, cuts = leaves(p)
    x, p, rank = x[order], p[order], rank[order]
    lo, hi = (np.array([pick(p[a:b], axis=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).reshape(-1, p.shape[1]) for pick in (np.min, np.max))
    found, verified = [], 0
    for first in range(0, len(queries), AT_ONCE):
        q = queries[first : first + AT_ONCE]
        own, least = space.queries(q), bound[first : first + AT_ONCE].copy()
        sq = np.einsum("ij,ij->i", q, q)
        slack = 1e-9 * np.sqrt(sq * space.largest)
        radius = np.where(np.isneginf(least), np.inf, quantile * np.maximum(sq + space.largest - 2 * least, 0) * (1 + 1e-9))
        away = _box_distances(own, lo, hi)
        turn = np.empty(away.shape, np.int64)
        np.put_along_axis(turn, np.argsort(away, axis=1, kind="stable"), np.arange(away.shape[1])[None, :], axis=1)
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
        begin, end = 0, 1
        while begin < len(lo):
            hits = [best]
            todo = (turn >= begin) & (turn < end) & (away <= radius[:, None])
            for leaf in np.flatnonzero(todo.any(axis=0)):
                i, (a, b) = np.flatnonzero(todo[:, leaf]), cuts[leaf : leaf + 2]
                near = ((own[i] ** 2).sum(1)[:, None] + (p[a:b] ** 2).sum(1) - 2 * own[i] @ p[a:b].T) <= radius[i][:, None]
                if near.mean() > DENSE:
                    scores = q[i] @ x[a:b].T
                    verified += scores.size
                    r, c = np.nonzero(scores >= (least - slack)[i][:, None])
                    hits.append((i[r], a + c, scores[r, c]))
                else:
                    r, c = np.nonzero(near)
                    scores = np.einsum("ij,ij->i", q[i[r]], x[a + c])
                    verified += len(scores)
                    ok = scores >= (least - slack)[i[r]]
                    hits.append((i[r][ok], a + c[ok], scores[ok]))
            best = tuple(np.concatenate(y) for y in zip(*hits, strict=True))
            best = tuple(y[_best(*best, rank, k)] for y in best)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
            last = np.searchsorted(best[0], full, "right") - 1
            least[full] = np.maximum(least[full], best[2][last])
            radius = np.where(np.isneginf(least), np.inf, quantile * np.maximum(sq + space.largest - 2 * least, 0) * (1 + 1e-9))
            begin, end = end, 2 * end
        found.append((best[0] + first, *best[1:]))
    at, point, score = (np.concatenate(y) for y in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    score = (queries[at] * x[point]).sum(axis=1) if len(at) else score  # the same for any blocks
    return at, order[point], score, verified


def _ranks(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def usable(vec: str) -> Column:
    """Not null or zero, and every component a number."""
    good = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(good & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = K, axes: int = AXES, confidence: float = CONFIDENCE, seed: int = SEED, cell_rows: int = CELL_ROWS, unit_rows: int = UNIT_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors: vec_id, vec (array of numbers).  query_id, rank (from 1), vec_id, score: for rows of which is_query holds, the k rows of largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec"), (F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()).alias("asks")).where(usable("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    n, dim, largest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(square)).first()
    space, quantile = Space(dim or 1, (largest or 0.0) * (1 + 1e-12), axes, seed), chi_square_quantile(confidence, axes)
    depth = min(MAX_CELLS.bit_length() - 1, max(0, math.ceil(math.log2(max(n, 1) / cell_rows))))
    names = [f"p{a}" for a in range(axes)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, space.points(_matrix(b.column("vec"), space.dim)).T.copy())), names=names)

    if depth:
        sample = rows.select("vec") if n <= SAMPLE_ROWS else rows.select("vec").sample(SAMPLE_ROWS / n, seed)
        points = sample.mapInArrow(trimmed(project), ", ".join(f"{c} double" for c in names)).toArrow()
        space.split(np.column_stack([points.column(c).to_numpy() for c in names]), depth)
    extremes = ", ".join(f"lo{a} double, hi{a} double" for a in range(axes))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = space.points(_matrix(b.column("vec"), space.dim))
            cell = space.cells(p)
            by = np.argsort(cell, kind="stable")
            lead = np.flatnonzero(np.concatenate([[True], np.diff(cell[by]) > 0])) if len(by) else by
            if len(by):
                ends = [f.reduceat(p[by, a], lead) for a in range(axes) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([pa.array(cell[by][lead]), pa.array(np.diff(np.append(lead, len(by)))), *map(pa.array, ends)], names=["cell", "n", *(f"{e}{a}" for a in range(axes) for e in ("lo", "hi"))])

    sums = [F.sum("n").alias("n"), *(f(f"{e}{a}").alias(f"{e}{a}") for a in range(axes) for e, f in (("lo", F.min), ("hi", F.max)))]
    cells = rows.select("vec").mapInArrow(trimmed(measure), f"cell long, n long, {extremes}").groupBy("cell").agg(*sums).orderBy("cell").collect()  # at most MAX_CELLS rows
    cell_ids = np.array([r.cell for r in cells], np.int64)
    lo, hi = (np.array([[r[f"{e}{a}"] for a in range(axes)] for r in cells]).reshape(len(cells), axes) for e in ("lo", "hi"))
    n_units = {r.cell: -(-r.n // unit_rows) for r in cells}
    units = np.ones(2**depth, np.int64)
    units[cell_ids] = [n_units[c] for c in cell_ids.tolist()]
    parts = min(1 << 13, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units[cell_ids].sum())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = space.cells(space.points(_matrix(b.column("vec"), space.dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = rows.withColumn("key", F.xxhash64("vec")).mapInArrow(trimmed(place), f"vec_id long, vec {kind}, asks boolean, key long, cell long")
    unit = F.pmod(F.xxhash64("vec_id", "key", F.monotonically_increasing_id()), F.element_at(F.lit(units.tolist()).cast("array<long>"), (F.col("cell") + 1).cast("int")))
    placed = durable(placed.withColumn("unit", unit))

    def at_home(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t.column("asks").to_numpy()
        mine, x = t.filter(pa.array(asks)), _matrix(t.column("vec"), space.dim)
        ids, q = t.column("vec_id").combine_chunks(), x[asks]
        at, point, score, _ = search_unit(space, x, _ranks(ids), q, np.full(len(q), -np.inf), k + 1, quantile)
        n = np.bincount(at, minlength=len(q))
        least = np.where(n > k, score[np.maximum(np.cumsum(n) - 1, 0)] if len(at) else -np.inf, -np.inf)
        found = _lists(n, ids, x, mine.column("vec_id").to_numpy(), q, at, point, score)
        return pa.table([*(mine.column(c) for c in ("vec_id", "key", "vec", "cell", "unit")), pa.array(least), *found], names=["query_id", "key", "vec", "cell", "unit", "least", *_FOUND])

    units_of = placed.repartition(parts, "cell", "unit").groupBy("cell", "unit")
    homes = units_of.applyInArrow(_trimmed(at_home), f"query_id long, key long, vec {kind}, cell long, unit long, least double, {_LISTS}")
    one = F.max_by(F.struct("vec", "cell", "unit", "least", *_FOUND), F.struct("least", "cell", "unit")).alias("home")
    asked = durable(homes.groupBy("query_id", "key").agg(one).select("query_id", "key", "home.*"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, AT_ONCE):
                part = b.slice(a, AT_ONCE)
                q, least = _matrix(part.column("vec"), space.dim), part.column("least").to_numpy()
                radius = np.where(np.isneginf(least), np.inf, quantile * np.maximum(np.einsum("ij,ij->i", q, q) + space.largest - 2 * least, 0) * (1 + 1e-9))
                i, c = np.nonzero(_box_distances(space.queries(q), lo, hi) <= radius[:, None])
                yield pa.RecordBatch.from_arrays([*(part.column(x).take(pa.array(i)) for x in names_in), pa.array(cell_ids[c])], names=[*names_in, "to"])

    names_in = ["query_id", "key", "vec", "least", "cell", "unit"]
    routed = asked.select(*names_in).mapInArrow(trimmed(route), f"query_id long, key long, vec {kind}, least double, cell long, unit long, to long")
    routed = routed.select("query_id", "key", "vec", "least", F.col("to").alias("cell"), F.when(F.col("cell") == F.col("to"), F.col("unit")).otherwise(-1).alias("home"))
    chunks = np.zeros(2**depth, np.int64)
    for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MAX_CELLS rows
        chunks[r.cell] = -(-r.n // query_rows)

    def of(numbers: np.ndarray) -> Column:
        return F.element_at(F.lit(numbers.tolist()).cast("array<long>"), (F.col("cell") + 1).cast("int"))

    questions = routed.withColumn("chunk", F.pmod(F.xxhash64("query_id", "key"), of(chunks))).withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), of(units) - 1))).where("unit <> home").drop("home")
    candidates = placed.where(of(chunks) > 0).select("vec_id", "key", "vec", "cell", "unit", F.explode(F.sequence(F.lit(0).cast("long"), of(chunks) - 1)).alias("chunk"))
    parts = min(1 << 13, max(parts, int((units * chunks).sum())))
    by = ["cell", "unit", "chunk"]

    def answer(points: pa.Table, queries: pa.Table) -> pa.Table:
        points, queries = points.combine_chunks(), queries.combine_chunks()
        ids = points.column("vec_id").combine_chunks()
        x, q = _matrix(points.column("vec"), space.dim), _matrix(queries.column("vec"), space.dim)
        at, point, score, _ = search_unit(space, x, _ranks(ids), q, queries.column("least").to_numpy(), k + 1, quantile) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
        found = _lists(np.bincount(at, minlength=len(q)), ids, x, queries.column("query_id").to_numpy(), q, at, point, score)
        out = pa.table([*(queries.column(c) for c in ("query_id", "key")), *found], names=["query_id", "key", *_FOUND])
        return out.filter(pa.array(np.isin(np.arange(len(q)), at)))

    found = candidates.repartition(parts, *by).groupBy(*by).cogroup(questions.repartition(parts, *by).groupBy(*by)).applyInArrow(_trimmed(answer), f"query_id long, key long, {_LISTS}")
    found = found.unionByName(asked.select("query_id", "key", *_FOUND))
    hits = found.select("query_id", "key", F.explode(F.arrays_zip("ids", "scores", "own")).alias("h")).select("query_id", "key", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"), F.col("h.own").alias("own"))
    order = "order by score desc, vec_id asc nulls last"
    hits = hits.repartition("query_id", "key").withColumn("nth", F.expr(f"row_number() over (partition by query_id, key, own {order})")).where("not own or nth > 1")
    ranked = hits.withColumn("rank", F.expr(f"row_number() over (partition by query_id, key {order})")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_FOUND = ["ids", "scores", "own"]
_LISTS = "ids array<long>, scores array<double>, own array<boolean>"


def _lists(n: np.ndarray, ids: pa.Array, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, at: np.ndarray, point: np.ndarray, score: np.ndarray) -> list[pa.Array]:
    """Of each query (n of the points found are its): ids, scores, and whether a point has the query's id and vector."""
    mine = ids.take(pa.array(point))
    own = (mine.fill_null(0).to_numpy(zero_copy_only=False) == query_ids[at]) & mine.is_valid().to_numpy(zero_copy_only=False) & (x[point] == q[at]).all(axis=1)
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return [pa.ListArray.from_arrays(ends, y) for y in (mine, pa.array(score), pa.array(own))]


def _trimmed(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    if run.__code__.co_argcount == 1:
        return lambda t: next(iter(trimmed(lambda _: iter([run(t)]))(iter(()))))
    return lambda left, right: next(iter(trimmed(lambda _: iter([run(left, right)]))(iter(()))))
