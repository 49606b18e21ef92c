"""Places in one order over a whole table: numbering, rounds and chunks without a window that holds all rows.

Rows are dealt by ranges of the order, sorted inside each range and written down; the sizes of the ranges (as many
numbers as there are partitions) are summed on the driver, and a row's place is its place in its range after them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

#: the place in its partition is held in the lower bits of monotonically_increasing_id()
PLACE_BITS = 33


def with_ordinal(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """df with its rows numbered 1, 2, 3 ... in order.  Rows that are equal in order get any of their numbers, and those are dealt over
    ranges by where they were read, so that a value that a third of the rows have does not fall to one task.  An empty table stays
    empty.  name must not be a column of df."""
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.expr(f"`{c}`") if isinstance(c, str) else c for c in order]
    by = [*keys, F.col("_read").asc()]
    ranged = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = durable(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_read"))
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = dict(placed.groupBy(part.alias("part")).agg(F.max(place) + 1).collect())
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate([0, *(sizes[p] for p in parts)]), strict=False))
    offsets = F.lit([before.get(p, 0) for p in range(max(parts, default=0) + 1)]).cast("array<long>")
    return placed.withColumn(name, place + 1 + F.element_at(offsets, (part + 1).cast("int"))).drop("_at")


def with_running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """df with the sum of value (whole numbers) over the row and all before it in order; rows that are equal in order are taken as they were
    read.  Ranges are dealt and added up as in with_ordinal."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.expr(f"`{c}`") if isinstance(c, str) else c for c in order]
    by = [*(k.alias(f"_by{i}") for i, k in enumerate(keys)), F.monotonically_increasing_id().alias("_read")]
    names = [*(f"_by{i}" for i in range(len(keys))), "_read"]
    ranged = df.select("*", *by).repartitionByRange(n, *names).sortWithinPartitions(*names)
    columns = [*df.columns, name]
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            sums = total + np.cumsum(b.column(at).to_numpy())
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums)], names=columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    summed = ranged.drop(*names).mapInArrow(run, f"{kinds}, `{name}` long")
    placed = durable(summed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS)
    sums = dict(placed.groupBy(part.alias("part")).agg(F.sum(value)).collect())
    parts = sorted(sums)
    before = dict(zip(parts, accumulate([0, *(sums[p] for p in parts)]), strict=False))
    offsets = F.lit([before.get(p, 0) for p in range(max(parts, default=0) + 1)]).cast("array<long>")
    return placed.withColumn(name, F.col(name) + F.element_at(offsets, (part + 1).cast("int"))).drop("_at")
