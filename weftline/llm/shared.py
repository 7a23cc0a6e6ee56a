"""Small plan helpers that the operators share; intermediate tables are those of the rest of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut, shared_dir  # noqa: F401


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def plain(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns named as the operator's own outputs; an operator's output replaces such a column."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(quote(c)) for c in df.columns if c.lower() not in own])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """TypeError where the id is no whole number: it is compared, summed or written as 64 bits."""
    kind = docs.select(F.col(id_col)).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def some_rows(df: DataFrame, rows: int, of: int, seed: int = 17) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df``, twice as many at most. Rows are dealt by a seeded random number each,
    never by what they hold, so equal texts, nulls and missing ids weigh no more than others."""
    return df.where(F.rand(seed) < min(1.0, rows / of) if of else F.lit(True)).limit(2 * rows)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches to and from Python hold 8 MB at most, however many rows that is. Results do not change."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
