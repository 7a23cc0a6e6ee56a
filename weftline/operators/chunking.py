"""Documents and word-window chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunk size must be positive and overlap from 0 to below it")


def documents(df: DataFrame, text_col: str = "text", source_col: str | None = "source", ord_col: str | None = None, id_col: str | None = None, metadata_col: str | None = None) -> DataFrame:
    """Rows as documents (doc_id, text, source, doc_ord, metadata): text normalised, empty text dropped, ids from the content
    unless ``id_col`` has one; ``metadata`` is JSON text and travels along.

    ``doc_ord`` orders documents; without a column for it, order of reading. An id that comes twice keeps its first row.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("inline")) if source_col else F.lit("inline")
    order = F.col(ord_col).cast("long") if ord_col else F.monotonically_increasing_id()
    given = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    metadata = F.coalesce(F.col(metadata_col).cast("string"), F.lit("{}")) if metadata_col else F.lit("{}")
    rows = df.select(X.normalize(F.col(text_col)).alias("text"), source.alias("source"), order.alias("doc_ord"), given.alias("given"), metadata.alias("metadata")).where(F.length("text") > 0)
    rows = rows.select(F.coalesce("given", X.document_id(F.col("source"), F.col("text"))).alias("doc_id"), "text", "source", "doc_ord", "metadata")
    return first_by(rows, ["doc_id"], "doc_ord")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, that with the least ``order``; combined on the map side, so a key with many rows is no burden."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    least = F.min_by(F.struct(*rest), F.col(order)).alias("r") if rest else F.lit(None).alias("r")
    found = df.groupBy(*keys).agg(F.min(order).alias(order), least)
    return found.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def windows(words: Column, size: int, overlap: int) -> Column:
    """Arrays of words of each window; the last one reaches the end, and no words give no window."""
    step = size - overlap
    return X.let(words, lambda w: _windows(w, size, step))


def _windows(words: Column, size: int, step: int) -> Column:
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i * step + 1, size))


def chunks(docs: DataFrame, size: int = 180, overlap: int = 40) -> DataFrame:
    """(chunk_id, doc_id, source, doc_ord, idx, text, metadata) of documents. A narrow map, without a shuffle."""
    check_window(size, overlap)
    metadata = F.col("metadata") if "metadata" in docs.columns else F.lit("{}")
    found = docs.select("doc_id", "source", "doc_ord", metadata.alias("metadata"), F.posexplode(windows(F.split(F.col("text"), " "), size, overlap)).alias("idx", "w"))
    found = found.select("doc_id", "source", "doc_ord", "idx", "metadata", F.array_join("w", " ").alias("text")).where(F.length("text") > 0)
    return found.select(X.chunk_id(F.col("doc_id"), F.col("idx"), F.col("text")).alias("chunk_id"), "doc_id", "source", "doc_ord", "idx", "text", "metadata")


def not_yet(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``known`` lacks."""
    return new.join(known.select(key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with rows of ``new`` in place of those with equal keys; of equal keys in ``new`` the last counts."""
    rest = [c for c in table.columns if c != key]
    latest = new.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
    return table.join(latest, key, "left_anti").unionByName(latest.select(*table.columns))
