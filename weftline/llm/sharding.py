"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets into contiguous shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix_sums import ROWS, SUM, prefix_sums
from .shared import plain

N_SHARDS = 24


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows stand in order of ``id_col`` (nulls first), then of where they were read; a row goes to the shard in whose
    equal part of all bytes its first byte falls, so shards are contiguous and differ by one row's size at most.
    Null and empty texts count 8 bytes. Repeated rows are rows of their own. A row larger than a shard's part leaves
    the parts that it covers empty. An empty table gives an empty table. Input columns named as an output column are
    replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    return assign(plain(docs, "size", "shard", "slot").withColumn("size", text_size(F.col(text_col))), n_shards, id_col)


def assign(sized: DataFrame, n_shards: int, id_col: str) -> DataFrame:
    """As ``shard``, of rows that have a ``size`` already."""
    placed, _, total = prefix_sums(sized, [F.col(id_col).asc_nulls_first()], "size")
    # bytes_before * n_shards may pass 2**63 on petabytes, so the division comes first and the remainder is added.
    target = max(total, 1)
    exact = F.col(SUM).cast("decimal(38,0)") * F.lit(n_shards)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(exact / F.lit(target).cast("decimal(20,0)")).cast("int")))
    starts = placed.groupBy("shard").agg(F.min(ROWS).alias("__first"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col(ROWS) - F.col("__first")).select(*sized.columns, "shard", "slot")
