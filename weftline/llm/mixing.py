"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix_sums import SUM, prefix_sums
from .shared import cut, plain

SEED, MAX_EPOCHS, WEIGHTS = 17, 3, (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def water_fill(sizes: list[int], weights: list[int], total: int, max_epochs: int = MAX_EPOCHS) -> list[Fraction]:
    """Targets that share ``total`` by weight, none above max_epochs * size: clamp what is above, reshare the excess
    among the rest by weight, again until none is above. Exact rationals."""
    caps = [Fraction(max_epochs * s) for s in sizes]
    clamped: set[int] = set()
    while True:
        rest = total - sum(caps[i] for i in clamped)
        free = sum(w for i, w in enumerate(weights) if i not in clamped)
        level = Fraction(rest) / free if free else Fraction(0)
        over = {i for i, w in enumerate(weights) if i not in clamped and w * level > caps[i]}
        if not over:
            return [caps[i] if i in clamped else w * level for i, w in enumerate(weights)]
        clamped |= over


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to max_epochs): how often the mix takes each row.

    Sources, ordered by code point with null as the last, weigh ``weights`` in turn, and share 100 % of all words.
    A source's rows are taken floor(target / size) times whole; the fraction left goes to the rows that come first in
    the order of a seeded md5 of the id, up to the row where the sum of words comes nearest to the target. That
    place is found by prefix sums over narrow rows, range-partitioned by source and hash, so a source with a third
    of all rows spreads over partitions. One row of totals for each source comes to the driver and goes back as a
    broadcast: sources are few by nature (a name each), and it is checked below 1,000,000.

    Rows that share source and id are taken alike, apart from the row at the cut. Null texts have no words and are
    taken as their source's whole repetitions say. An empty table, or one without a word, takes nothing.
    ``size_col``: a column that has the words of each text already, which then is not read. Input columns named as an
    output column are replaced.
    """
    sized = docs.withColumn("size", F.col(size_col).cast("long") if size_col else n_words(F.col(text_col)))
    sized = plain(sized, "source_size", "target", "copies")
    source, key = F.col(source_col), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    narrow = cut(sized.select(source.cast("string").alias("source"), key.alias("key"), "size"), "mix")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    if (found := totals.count()) > 1_000_000:
        raise ValueError(f"{found} sources; the mix is stated over 1,000,000 names at most")
    rows = sorted(totals.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes, total = [r["s"] for r in rows], sum(r["s"] for r in rows)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], total, max_epochs)
    plan, before = [], 0
    for r, s, t in zip(rows, sizes, targets):
        whole = int(t // s) if s else 0
        plan.append((r["source"], s, float(t), whole, before, float(t - whole * s)))
        before += s
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, offset long, extra double")
    placed, _, _ = prefix_sums(narrow, [F.col("source").asc_nulls_last(), F.col("key")], "size")
    # The last row whose middle lies before the wanted sum is the last one taken.
    taken = placed.join(F.broadcast(table), placed["source"].eqNullSafe(table["source"])).where(F.col(SUM) - F.col("offset") + F.col("size") / 2 < F.col("extra"))
    last = {r[0]: r[1] for r in taken.groupBy(placed["source"]).agg(F.max("key")).collect()}  # a row a source
    cuts = spark.createDataFrame([(*p[:4], last.get(p[0])) for p in plan], "__source string, source_size long, target double, __whole int, __cut string")
    out = sized.join(F.broadcast(cuts), source.cast("string").eqNullSafe(F.col("__source")), "left")
    return out.withColumn("copies", F.col("__whole") + F.coalesce((key <= F.col("__cut")).cast("int"), F.lit(0))).drop("__source", "__whole", "__cut")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``copies`` says, with all that is stated there of nulls,
    ties, repeats and empty tables. A column named ``size``, ``source_size``, ``target`` or ``copies`` gets that figure."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return copies(docs, **options).where("copies > 0").select(*docs.columns, times.alias("__copy")).select(*docs.columns)
