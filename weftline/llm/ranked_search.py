"""Ranked lexical search of all documents for each item, by sort-based accumulation.

Documents become postings of the items' terms, range-partitioned by id. A task joins a run of documents with the items of each
term into one long array of (item, document, impact), sorts it by packed keys of item and document with a radix sort, adds
up impacts between the keys' bounds, and keeps the best of each item; the tasks' best meet in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, quote, whole_ids
from .vec import LOWER, NOT_ALNUM, slices, spans, words

TOP_K = 50
#: Bytes of the items' distinct terms up to which they travel to all tasks; beyond, terms are joined as tables.
MOST_BYTES = 16 << 20
#: (item, document, impact) entries sorted at a time, unless one document alone has more.
ENTRIES = 1 << 21
#: Groups into which each item's candidates are dealt before they meet.
DEALT = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# How lengths and weights enter the score.
SCALE, LENGTH_SHARE, TF_SCALE, LENGTH_SCALE = 1000, 50, 1_000_000_000, 20
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each once: rows that share an id are one item."""
    low = F.translate(F.col(quote(text_col)), UPPER_AZ, LOWER_AZ)
    return items.select(F.col(quote(item_col)).alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


class Vocabulary:
    """Terms by number, found among words by hash and then by their letters."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        h = words(pa.array(terms, pa.string()), NOT_ALNUM, LOWER).hashes()
        self.hashes = np.sort(h)

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms with repeats in each text, known or not; text, number and count of each known term of a text, in order of text."""
        w = words(texts, NOT_ALNUM, LOWER)
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        near = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, np.int64)
        size = w.end[near] - w.start[near]
        offs = np.append(0, np.cumsum(size)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(near), pa.py_buffer(offs), pa.py_buffer(w.low[spans(w.start[near], size)])).dictionary_encode()
        number = np.array([self.number.get(t, -1) for t in found.dictionary.to_pylist()], np.int64)
        term = number[found.indices.to_numpy(zero_copy_only=False)] if len(near) else np.zeros(0, np.int64)
        doc, term = w.doc[near][term >= 0], term[term >= 0]
        pair, n = np.unique(doc * max(1, len(self.number)) + term, return_counts=True)
        return w.n, pair // max(1, len(self.number)), pair % max(1, len(self.number)), n


def known_postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of docs(doc_id, text) with a term: n terms with repeats; numbers and counts of those among
    ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                n, doc, term, tf = known.counted(b.column(1)[lo:hi])
                offs = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=hi - lo))), pa.int32())
                lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys below 2**63, by 16 bits at a time from the lowest; numpy sorts these by counting."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    rest = int(keys.max(initial=0)) >> 16
    shift = 16
    while rest:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        rest, shift = rest >> 16, shift + 16
    return order


class Best:
    """The best ``k`` of each item, by score and then by the smaller id, nulls last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size, self.room = 0, max(1 << 16, 4 * n_items * k)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[item])
        self.kept.append((item[good], score[good], doc[good], null[good]))
        self.size += int(good.sum())
        if self.size > self.room:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """What is kept, after the rest is dropped. An item that has its ``k`` takes nothing below its last from then on."""
        item, score, doc, null = (np.concatenate(x) for x in zip(*self.kept)) if self.kept else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[order], item[order], "left")
        place = np.arange(len(order)) - first
        full = order[place == self.k - 1]
        self.least[item[full]] = score[full]
        order = order[place < self.k]
        self.kept = [(item[order], score[order], doc[order], null[order])]
        self.size = len(order)
        return self.kept[0]


def accumulated(row: np.ndarray, term: np.ndarray, impact: np.ndarray, first: np.ndarray, n_of: np.ndarray, items: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, row and score of all pairs that share a term. ``first`` and ``n_of``: where a term's items begin in ``items``, and
    their number."""
    n = n_of[term]
    packed = items[spans(first[term], n)] * n_rows + np.repeat(row, n)
    if not len(packed):
        return packed, packed, packed
    order = radix_order(packed)
    packed = packed[order]
    at = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    return packed[at] // n_rows, packed[at] % n_rows, np.add.reduceat(np.repeat(impact, n)[order], at)


def in_blocks(postings: DataFrame, pairs: list[tuple[int, int]], weights: np.ndarray, n_items: int, n_docs: int, length: int, top_k: int) -> DataFrame:
    """(item, doc_id, score): the best of each task. ``pairs``: item and term, by number."""
    by_term = np.array(sorted((t, i) for i, t in pairs), np.int64).reshape(-1, 2)
    n_of = np.bincount(by_term[:, 0], minlength=len(weights))
    shared = postings.sparkSession.sparkContext.broadcast((weights, np.cumsum(n_of) - n_of, n_of, by_term[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, first, n_of, items = shared.value
        best = Best(n_items, top_k)
        for b in batches:
            doc, null = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            m = LENGTH_SHARE + (LENGTH_SHARE * b.column(1).to_numpy() * n_docs) // length
            size = b.column(2).value_lengths().to_numpy().astype(np.int64)
            term, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            impact = weights[term] * ((TF_SCALE * tf) // (SCALE * tf + LENGTH_SCALE * m[row]))
            ends = np.cumsum(size)
            entries = np.append(0, np.cumsum(n_of[term]))[ends] if len(ends) else ends
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(entries, (entries[lo - 1] if lo else 0) + ENTRIES, "right")))
                s = slice(int(ends[lo] - size[lo]), int(ends[hi - 1]))
                item, at, score = accumulated(row[s] - lo, term[s], impact[s], first, n_of, items, hi - lo)
                best.add(item, score, doc[lo + at], null[lo + at])
                lo = hi
        item, score, doc, null = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc.astype(np.int64), mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def all_postings(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, term, tf) of docs(doc_id, text), all terms as text; written once, so a row's number stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi in slices(b.column(1)):
                w = words(b.column(1)[lo:hi], NOT_ALNUM, LOWER)
                data, offs = w.compact()
                coded = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(data)).dictionary_encode()
                size = max(1, len(coded.dictionary))
                pair, tf = np.unique(w.doc * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                doc = pair // size
                columns = [pa.array(key + doc), b.column(0)[lo:hi].take(pa.array(doc)), pa.array(w.n[doc].astype(np.int64)), coded.dictionary.take(pa.array(pair % size)).cast(pa.string()), pa.array(tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "term", "tf"])
                key += hi - lo

    return cut(docs.mapInArrow(run, "row long, doc_id long, n long, term string, tf long"), "postings", "zstd")


def in_tables(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of all pairs with a common term, for any number of items: a join on terms, whose hot keys Spark
    splits, and sums with a partial one on the map side."""
    postings = all_postings(docs)
    n_docs, length = postings.select("row", "n").distinct().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    w = F.floor(SCALE * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = wanted.groupBy("term").agg(F.count("*").alias("df")).select("term", w.alias("w"))
    divided = lambda a, b: F.expr(f"({a}) div ({b})")
    m = LENGTH_SHARE + divided(f"{LENGTH_SHARE}L * n * {n_docs}L", f"{length}L")
    met = wanted.withColumn("m", m).join(terms.join(weights, "term"), "term")
    impact = F.col("w") * divided(f"{TF_SCALE}L * tf", f"{SCALE}L * tf + {LENGTH_SCALE}L * m")
    return met.groupBy("item_id", "row", "doc_id").agg(F.sum(impact).alias("score")).where("score > 0").select("item_id", "doc_id", "score")


def best_of(found: DataFrame, item: str, top_k: int) -> DataFrame:
    """``found`` with ``rank``, cut to the first ``top_k`` of each item: first within the groups that its documents are dealt into."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    dealt = found.withColumn("__dealt", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)))
    some = dealt.withColumn("__place", F.row_number().over(Window.partitionBy(item, "__dealt").orderBy(*order))).where(F.col("__place") <= top_k)
    return some.drop("__dealt", "__place").withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(*order))).where(F.col("rank") <= top_k)


def search(docs: DataFrame, items: DataFrame, top_k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top_k`` documents of each item with the highest scores above 0, ties by the smaller
    id, nulls last.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased. A term in df of
    the N documents with a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), and its count tf in a document of n of all L
    terms adds to the score 10**9 tf div (1000 tf + 20 m) times that, where m = 50 + 50 n N div L; each term of an item counts once.

    Items whose distinct terms hold ``most_bytes`` at most go to all tasks; more of them are joined as tables, with the same
    rows. Null texts have no terms and are no documents; repeated rows are documents of their own. Items that share an id,
    null among them, are one; those without terms or hits return nothing, as do empty tables. Ids of documents are whole
    numbers (TypeError otherwise), those of items of any type. Other columns are not read, whatever their names.
    """
    whole_ids(docs, id_col)
    if top_k < 1:
        raise ValueError("top_k must be 1 at least")
    narrow = docs.select(F.col(quote(id_col)).cast("long").alias("doc_id"), F.col(quote(text_col)).alias("text"))
    terms = cut(item_terms(items, item_col, item_text_col), "item-terms")
    held = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    if held > most_bytes:
        return best_of(in_tables(narrow, terms), "item_id", top_k).select("item_id", "rank", "doc_id", "score")

    rows = terms.collect()  # of most_bytes at most
    names, known = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x)), sorted({r["term"] for r in rows})
    postings = cut(known_postings(narrow, known), "postings", "zstd")
    n_docs, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each of ``known`` at most
    weights = np.array([weight(n_docs, df[t]) if t in df else 0 for t in range(len(known))], np.int64)
    of_item, of_term = ({x: i for i, x in enumerate(xs)} for xs in (names, known))
    pairs = [(of_item[r["item_id"]], of_term[r["term"]]) for r in rows]
    ranged = postings.repartitionByRange(F.col("doc_id"), F.col("n"), F.xxhash64("terms", "tfs"))
    found = best_of(in_blocks(ranged, pairs, weights, len(names), n_docs, max(1, length), top_k), "item", top_k)
    table = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], f"item long, item_id {terms.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(table), "item").select("item_id", "rank", "doc_id", "score")
