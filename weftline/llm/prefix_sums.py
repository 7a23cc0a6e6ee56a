"""Global prefix sums in a stated order, from per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

PART, ROWS, SUM = "__part", "__rows_before", "__sum_before"


def prefix_sums(df: DataFrame, order: list[Column], size: str) -> tuple[DataFrame, int, int]:
    """``df`` with ``__rows_before`` and ``__sum_before`` (of ``size``, a long without nulls), number of rows, sum.

    Rows are range-partitioned by ``order`` and then by where they were read, so a key that holds a third of the
    rows spreads over partitions; rows equal in ``order`` stand in the order of reading. Each partition adds up its
    own rows in a stream; only one total for each partition reaches the driver (24 bytes a partition), and goes back
    as a broadcast of that size. The ranged rows are written to the shared folder once, so that totals and rows
    come from the same partitions even after an executor is lost.
    """
    ranged = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.LongType(), False) for c in (PART, ROWS, SUM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            new = (np.full(len(sizes), part), rows + np.arange(len(sizes)), ends - sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in new)], names=[*b.schema.names, PART, ROWS, SUM])
            if len(sizes):
                rows, total = rows + len(sizes), int(ends[-1])

    local = cut(ranged.mapInArrow(run, schema), "ranged")
    totals = sorted(local.groupBy(PART).agg(F.count("*"), F.sum(size)).collect())
    offsets, rows, total = [], 0, 0
    for part, n, s in totals:
        offsets.append(Row(part, rows, total))
        rows, total = rows + n, total + s
    table = df.sparkSession.createDataFrame(offsets, f"{PART} long, __r long, __s long")
    out = local.join(F.broadcast(table), PART).withColumns({ROWS: F.col(ROWS) + F.col("__r"), SUM: F.col(SUM) + F.col("__s")})
    return out.drop(PART, "__r", "__s"), rows, total
