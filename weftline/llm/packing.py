"""Packing of token ids into sequences of several context sizes.

Documents are cut into windows of the largest size; what is left of each goes to the tier of the smallest size that holds it.
The longest of these remainders each open a window of their tier, and the gaps behind them are filled from the shorter ones:
gaps and shorter remainders lie end to end on one line of token positions each, and where the two lines overlap a piece is
cut. What the gaps do not take fills further windows of the largest size, so that only the very last sequence has room left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix_sums import ROWS, SUM, prefix_sums
from .shared import cut, quote, whole_ids
from .token_output import END_ID, PieceEncoder, with_end
from .vec import slices, worker_cache

SIZES = (2048, 1024, 512, 256)
STEP_TOKENS = 1 << 20
#: Token positions of a line that one group of rows spans; pieces are also cut at its ends.
STRETCH = 1 << 16
#: Sequences without a host are numbered from here on. Others are named by their first piece, task << 40 and place.
FRESH = 1 << 62
PIECE = "key long, doc_id long, doc_tokens long, start long, length int, ids binary"


def encoded(docs: DataFrame, tokenizer_path: str, top: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, doc_tokens, start, length, ids): each document's windows of ``top`` ids and its remainder, if any. ``ids``
    are little-endian unsigned 32-bit numbers. Written once, so keys are the same for all that reads them."""
    narrow = docs.select(F.col(quote(id_col)).cast("long"), F.col(quote(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        encoder = cache.get(tokenizer_path) or cache.setdefault(tokenizer_path, PieceEncoder(tokenizer_path))
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi in slices(b.column(1)):
                counts, ids = with_end(*encoder.encode(b.column(1)[lo:hi]), end_id)
                n = -(-counts // top)
                doc = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * top
                length = np.minimum(counts[doc] - start, top)
                ends = np.append(0, np.cumsum(length)) * 4
                packed = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                columns = [pa.array(key + np.arange(len(doc))), b.column(0)[lo:hi].take(pa.array(doc)), pa.array(counts[doc]), pa.array(start), pa.array(length.astype(np.int32)), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "doc_tokens", "start", "length", "ids"])
                key += len(doc)

    return cut(narrow.mapInArrow(run, PIECE), "pieces", "zstd")


def tier(length: Column, sizes: tuple[int, ...]) -> Column:
    """The smallest size that holds so many ids."""
    out = F.lit(sizes[0])
    for size in sizes[1:]:
        out = F.when(length <= size, size).otherwise(out)
    return out


def shortest_host(counts: dict[int, int], sizes: tuple[int, ...]) -> int:
    """The least length from which on remainders open windows of their own: as many as the shorter ones can fill up.
    ``counts``: remainders by length, which is below sizes[0]."""
    length = np.arange(sizes[0])
    n = np.array([counts.get(x, 0) for x in range(sizes[0])], object)  # products may pass 2**63
    size = np.min([np.where(length <= s, s, sizes[0]) for s in sizes], axis=0)
    gaps, ids = np.cumsum((n * (size - length))[::-1])[::-1], np.cumsum(n * length) - n * length
    return int(np.flatnonzero(np.append(gaps <= ids, True))[0])


def stretches(line: DataFrame, first: Column, length: Column, what: str, *carried: str) -> DataFrame:
    """(stretch, at, what): an interval of a line begins anew in each stretch that it touches. ``what`` carries columns, and
    where the interval began."""
    part = line.select(*carried, first.alias("from"), length.alias("n")).where("n > 0")
    part = part.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from") / STRETCH), F.floor((F.col("from") + F.col("n") - 1) / STRETCH))))
    return part.select("stretch", F.greatest("from", F.col("stretch") * STRETCH).alias("at"), F.struct(*carried, "from").alias(what))


def overlaps(gaps: DataFrame, fillers: DataFrame, total: int) -> DataFrame:
    """(key, begin, length, sequence_id, offset): which part of which filler lies in which gap, of two lines of intervals (gap,
    filler) that each cover 0 to ``total`` without holes. Within a stretch each piece runs from one beginning to the next."""
    both = gaps.unionByName(fillers, allowMissingColumns=True)
    so_far = Window.partitionBy("stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    past = F.coalesce(F.lead("at").over(Window.partitionBy("stretch").orderBy("at")), F.least((F.col("stretch") + 1) * STRETCH, F.lit(total)))
    pieces = both.select("at", past.alias("past"), *(F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("gap", "filler"))).where("past > at")
    return pieces.select("filler.key", (F.col("at") - F.col("filler.from")).alias("begin"), (F.col("past") - F.col("at")).cast("int").alias("length"), "gap.sequence_id", (F.col("gap.used") + F.col("at") - F.col("gap.from")).alias("offset"))


def steps(sequences: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(sequence_id, size, step) of sequences(sequence_id, size): groups of about ``step_tokens`` of context, in which the sequences
    of each size are dealt evenly, so steps are alike in tokens and in the cost of long contexts: any two differ by one
    sequence of each size at most. Which of one size go together is drawn by a hash."""
    placed, _, total = prefix_sums(sequences.select("sequence_id", "size"), [F.desc("size"), F.xxhash64("sequence_id"), F.col("sequence_id")], "size")
    n_steps = max(1, -(-total // step_tokens))
    by_size = placed.groupBy("size").agg(F.min(ROWS).alias("first"), F.count("*").alias("n"))  # a row for each of SIZES
    step = F.floor((F.col(ROWS) - F.col("first")) * F.lit(n_steps) / F.col("n"))
    return placed.join(F.broadcast(by_size), "size").select("sequence_id", "size", step.cast("long").alias("step"))


def pack(docs: DataFrame, tokenizer_path: str, sizes: tuple[int, ...] = SIZES, step_tokens: int = STEP_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) and sequences (sequence_id, size, step).

    A document is its text's ids and ``end_id``. Each id lies in one piece, and a sequence's pieces cover 0 to its size; only the
    last sequence can have room left. Most documents stay whole: remainders that open a window are never cut, and of the
    fillers about one a gap is. ``ids`` are little-endian unsigned 32-bit numbers. Names of sequences and what shares one depend
    on how ``docs`` is partitioned; pieces of one call always belong together, since they come from one written table.

    Null and empty texts have the end id alone. Rows that share an id, null among them, are documents of their own. An empty
    table gives none of both. Ids are whole numbers (TypeError otherwise). Other columns of ``docs`` are not read, whatever
    their names. ``sizes`` descend (ValueError otherwise).

    To the driver come the counts of remainders by length, below sizes[0] rows, and totals of partitions.
    """
    whole_ids(docs, id_col)
    if not sizes or list(sizes) != sorted(set(sizes), reverse=True) or sizes[-1] < 1:
        raise ValueError("sizes must be positive and descend")
    top = sizes[0]
    pieces = encoded(docs, tokenizer_path, top, end_id, id_col, text_col)
    counts = dict(pieces.where(F.col("length") < top).groupBy("length").count().collect())
    least = shortest_host(counts, sizes)
    hosting, size = F.col("length") >= least, tier(F.col("length"), sizes)

    hosts = pieces.where(hosting).select(F.col("key").alias("sequence_id"), size.alias("size"), F.col("length").alias("used"), (size - F.col("length")).alias("room"))
    gaps, _, n_gap = prefix_sums(hosts.where("room > 0"), [F.desc("room"), F.col("sequence_id")], "room")
    fillers, _, n_fill = prefix_sums(pieces.where(~hosting).select("key", "length"), [F.desc("length"), F.col("key")], "length")
    fresh = docs.sparkSession.range(-(-(n_fill - n_gap) // top)).select((F.col("id") + F.lit(FRESH)).alias("sequence_id"), F.lit(top).alias("size"), F.lit(0).alias("used"), F.lit(top).alias("room"), (F.col("id") * top + n_gap).alias(SUM))
    line = gaps.select(*fresh.columns).unionByName(fresh)
    laid = overlaps(stretches(line, F.col(SUM), F.col("room"), "gap", "sequence_id", "used"), stretches(fillers, F.col(SUM), F.col("length"), "filler", "key"), n_fill)

    own = pieces.where(hosting).select("doc_id", "start", "length", "ids", "doc_tokens", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    taken = laid.join(pieces.where(~hosting).select("key", "doc_id", "doc_tokens", F.col("start").alias("first"), F.col("ids").alias("all")), "key")
    part = F.substring("all", (F.col("begin") * 4 + 1).cast("int"), F.col("length") * 4)
    taken = taken.select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "length", part.alias("ids"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"))
    sequences = hosts.select("sequence_id", "size").unionByName(fresh.select("sequence_id", "size"))
    return own.unionByName(taken), steps(sequences, step_tokens)
