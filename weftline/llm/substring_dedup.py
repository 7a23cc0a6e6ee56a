"""Substring dedup: every run of several consecutive sentences, or pieces of long ones, is hashed and joined globally, and those
covered by any non-first repeated run are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, plain, whole_ids
from .vec import LOWER, SPACE, Words, flat, mix, powers, slices, spans, words

#: Pieces in a run. One with fewer words than LEAST_WORDS takes in further pieces until it has as many.
RUN, LEAST_WORDS = 3, 12
#: A stop within so many words after another ends no sentence, so lists and shouted words make no one-word sentences.
CLOSE = 3
#: Sentences are cut into pieces after word pairs of the smallest hash among any SPLIT in a row, so text without stops, and a
#: passage glued to other text at its ends, has bounds too. Whether there is a bound depends on SPLIT words before and after
#: alone: in a passage of n words the bounds but for the outer SPLIT - 1 on either side are the same wherever it stands, and
#: those are SPLIT words apart at most. Whole pieces thus cover n - 30 words, 21 of 51, and a run needs no more than 19.
#: A cut that would leave NEAR words at most on either side of it in its sentence is not made.
SPLIT, NEAR = 8, 4
STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
CLOSERS = np.isin(np.arange(256), np.frombuffer(b"\"')]", np.uint8))
#: From here on stand rows with a null id, in the order of a hash of their texts; other ids are below.
NO_ID = 1 << 62


def sentences(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; of each piece of a sentence the number of its first word, the number past its last, its hash, its sentence."""
    w = words(texts, SPACE, LOWER)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return w, none, none, none.astype(np.uint64), none
    raw, _ = flat(texts)
    lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    last = w.low[w.end - 1]
    stop = STOPS[last] | (CLOSERS[last] & STOPS[w.low[np.maximum(w.end - 2, w.start)]])
    stop[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    edge = np.append(w.doc[1:] != w.doc[:-1], True)
    crowded = np.zeros(n, bool)
    for k in range(1, CLOSE + 1):
        crowded[k:] |= stop[:-k] & (w.doc[k:] == w.doc[:-k])
    stop = (stop & ~crowded) | edge
    number = np.cumsum(stop) - stop
    h = w.hashes()
    pair = np.append(mix(h[:-1] * np.uint64(3) + h[1:]), np.uint64(1))
    stop |= smallest(pair, w.doc) & ~short(stop, w.doc)
    past = np.flatnonzero(stop) + 1
    first = np.append(0, past[:-1])
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return w, first, past, mix((sums[past] - sums[first]) * down[first] + (past - first).astype(np.uint64)), number[first]


def short(stop: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the sentence of a word begins and ends within NEAR words of the bound after it."""
    n = np.arange(len(stop))
    begin = np.maximum.accumulate(np.where(np.append(True, stop[:-1] | (doc[1:] != doc[:-1])), n, 0))
    end = np.append(n[stop], len(stop))[np.searchsorted(n[stop], n)]
    return (n + 1 - begin <= NEAR) & (end - n <= NEAR)


def smallest(pair: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a pair of words is the smallest, the last of equal ones, among some SPLIT pairs in a row of its text."""
    out = np.zeros(len(pair), bool)
    if len(pair) > SPLIT:
        rows = np.lib.stride_tricks.sliding_window_view(pair[:-1], SPLIT)
        at = np.arange(len(rows)) + SPLIT - 1 - np.argmin(rows[:, ::-1], axis=1)
        out[at[doc[:-SPLIT] == doc[SPLIT:]]] = True
    return out


def runs(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each run: its hash, its text's number, its first piece's number within the text, its number of pieces, and whether
    the text has had the same run before. A text of fewer pieces than a run has is one run if it has LEAST_WORDS."""
    w, first, past, h, _ = sentences(texts)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    doc = w.doc[first]
    count = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(count)  # past the last sentence of each text
    begin = end - count
    at = np.arange(len(first))
    to = np.maximum(at + RUN, np.searchsorted(past, first + LEAST_WORDS) + 1)
    whole = (at == begin[doc]) & (to > end[doc]) & (past[end[doc] - 1] - first >= LEAST_WORDS)
    to = np.where(whole, end[doc], to)
    at = at[to <= end[doc]]
    to, doc = to[at], doc[at]
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    key = mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))
    order = np.lexsort((at, key, doc))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return key, doc, at - begin[doc], to - at, again


def placed_id(id_col: str, text_col: str):
    """The id, or after all ids a place by the text, so equal passages of different texts without ids are told apart."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, __runs): for each text with something to remove, its non-first runs, as first piece * 65536 + pieces.

    First is the smallest id, and within a text the first place; null ids come last, by a hash of the text. Only keys go through the shuffles.
    Counting combines on the map side, so a passage in a third of all texts sends one row a task; the join back is a
    plain equi-join of two written tables, whose hot keys Spark splits.
    """
    whole_ids(docs, id_col)
    ids = docs.select(placed_id(id_col, text_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2)
            for lo, hi in slices(text):
                key, doc, at, size, again = runs(text[lo:hi])
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)[lo:hi].take(rows), b.column(1)[lo:hi].take(rows), pa.array((at << 16) + np.minimum(size, 0xFFFF)), pa.array(again)], names=["key", "id", "text_hash", "run", "again"])

    found = cut(ids.mapInArrow(run, "key long, id long, text_hash long, run long, again boolean"), "runs", "zstd")
    shared = cut(found.groupBy("key").agg(F.min("id").alias("__first"), F.max("id").alias("__last")).where("__first < __last").drop("__last"), "runs-shared")
    later = found.join(shared, "key").where("id > __first").select("id", "text_hash", "run")
    both = later.unionByName(found.where("again").select("id", "text_hash", "run"))
    return cut(both.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("run")).alias("__runs")), "runs-removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``clean_text``, ``n_sentences_removed`` and ``n_words_removed``.

    Sentences end with . ! or ? before white space, and at line ends, and are cut into pieces (see SPLIT); what is removed are
    whole pieces, and ``n_sentences_removed`` counts the sentences that lose any. White space and the case of A-Z do not tell
    runs apart; 64-bit hashes do. A removed piece goes with the white space after it. A run keeps its first
    occurrence, in the row with the smallest id; rows that share the smallest id, as repeated rows do, all keep it. Null ids
    come after all others, in the order of a hash of their texts. Ids are whole numbers below 2**62 (TypeError for other
    types). Null and empty texts stay as they are. An empty table gives an empty table. Input columns named as an output column
    are replaced.
    """
    docs = plain(docs, "clean_text", "n_sentences_removed", "n_words_removed")
    gone = removed(docs, id_col, text_col)
    left = docs.withColumns({"__id": placed_id(id_col, text_col), "__hash": F.xxhash64(text_col)})
    keys = gone.withColumnsRenamed({"id": "__gone_id", "text_hash": "__gone_hash"})
    joined = left.join(keys, (F.col("__id") == F.col("__gone_id")) & (F.col("__hash") == F.col("__gone_hash")), "left")
    joined = joined.select(*docs.columns, "__runs")
    schema = T.StructType([*docs.schema.fields, T.StructField("clean_text", T.StringType()), T.StructField("n_sentences_removed", T.LongType(), False), T.StructField("n_words_removed", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            clean, n, m = text.to_pylist(), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
            for i, gone in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if gone:
                    clean[i], n[i], m[i] = without(text[i : i + 1], np.array(gone, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(clean, pa.string()), pa.array(n), pa.array(m)], names=schema.names)

    return joined.mapInArrow(run, schema)


def without(text: pa.Array, gone: np.ndarray) -> tuple[str, int, int]:
    """One text without the pieces of the runs ``gone``; sentences that lose any, and words removed."""
    w, first, past, _, sentence = sentences(text)
    drop = np.zeros(len(first), bool)
    drop[spans(gone >> 16, gone & 0xFFFF)] = True
    raw, _ = flat(text)
    begin = w.start[first]
    end = np.append(begin[1:], len(raw))
    keep = np.ones(len(raw), bool)
    keep[spans(begin[drop], (end - begin)[drop])] = False
    return raw[keep].tobytes().decode(), len(np.unique(sentence[drop])), int((past - first)[drop].sum())
