"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, plain
from .vec import LOWER, NOT_ALNUM, Words, mix, slices, windows, words

WINDOW = 10
#: Benchmark text in one broadcast, in bytes. A larger benchmark is worked off in several sets, one after the other.
SET_BYTES = 16 << 20
#: A word of a set is 24 bytes in its arrays and takes two bytes of text at least, so a set is this many times its text
#: at most, beside a table of 1 MB for each window length.
MOST_PER_BYTE = 13
RUNS, ITEMS = "__runs", "__items"


class WindowSet:
    """Normalised windows of benchmark items, by window length: hashes in order, each with its window's first word; and the
    words of all items as flat arrays."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        w = words(pa.array([t for _, t in items], pa.string()), NOT_ALNUM, LOWER)
        self.names = [name for name, _ in items]
        self.low, self.start, self.end, self.doc = w.low, w.start.astype(np.int32), w.end.astype(np.int32), w.doc.astype(np.int32)
        hashes = w.hashes()
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(int(n), window) for n in w.n if n}):
            rows, at = windows(hashes, w.doc, size)
            other, _ = windows(mix(hashes), w.doc, size)
            keep = (w.n[w.doc[at]] == size) | (size == window)
            rows, at, other = rows[keep], at[keep], other[keep]
            order = np.lexsort((other, w.doc[at], rows))
            rows, at, other = rows[order], at[order], other[order]
            new = np.ones(len(rows), bool)  # a window that an item repeats stands once for it
            new[1:] = (rows[1:] != rows[:-1]) | (other[1:] != other[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
            mask = np.zeros(1 << 20, bool)
            mask[(rows >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = rows[new], at[new].astype(np.int32), mask

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.low, self.start, self.end, self.doc)) + sum(x.nbytes for arrays in self.by_size.values() for x in arrays)

    def same(self, at: int, w: Words, i: int, size: int) -> bool:
        """Whether the window at the set's word ``at`` has the words of ``w`` from ``i`` on."""
        return all(self.low[self.start[at + k] : self.end[at + k]].tobytes() == w.word(i + k) for k in range(size))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans (first, past) as runs in order, overlapping and touching ones as one."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def scan(texts: pa.Array, sets: WindowSet) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Number of words of each text; and of texts with verified hits their spans (first word, word past the last) and items."""
    w = words(texts, NOT_ALNUM, LOWER)
    hashes, first = w.hashes(), np.cumsum(w.n) - w.n
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for size, (keys, at_word, mask) in sets.by_size.items():
        rows, at = windows(hashes, w.doc, size)
        maybe = np.flatnonzero(mask[(rows >> np.uint64(44)).astype(np.int64)])
        lo, hi = (np.searchsorted(keys, rows[maybe], side) for side in ("left", "right"))
        for i, a, z in zip(at[maybe].tolist(), lo.tolist(), hi.tolist()):
            own = [sets.names[sets.doc[at_word[j]]] for j in range(a, z) if sets.same(int(at_word[j]), w, i, size)]
            if own:
                d = int(w.doc[i])
                spans.setdefault(d, []).append((i - int(first[d]), i - int(first[d]) + size))
                items.setdefault(d, set()).update(own)
    return w.n, spans, items


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", set_bytes: int = SET_BYTES, then=None) -> DataFrame:
    """``docs`` with ``n_words``, ``__runs`` (hit words, as arrays of first and past) and ``__items`` (ids of the items hit).

    The benchmark's size is summed before anything is broadcast. Up to ``set_bytes`` of text make one set, whose own size
    is checked again once it is built; a larger benchmark is dealt by item into several sets, each of which is a stage of
    its own with a written table in between, so tasks hold one set at a time. All hits are kept, so results do not depend
    on the number of sets. ``then``: from the result's schema, a schema and a function over its batches, which runs in the
    same Python pass as the last set.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_sets = 1 + int(size) // set_bytes
    out = plain(docs, "n_words", RUNS, ITEMS)
    pair = T.ArrayType(T.ArrayType(T.LongType()))
    fields = [*out.schema.fields, T.StructField("n_words", T.LongType(), False), T.StructField(RUNS, pair, False), T.StructField(ITEMS, T.ArrayType(T.StringType()), False)]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for k in range(n_sets):
        part = items if n_sets == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_sets)) == k)
        built = WindowSet([(r["i"], r["t"]) for r in part.collect()], window)
        text = len(built.low)
        if built.nbytes() > MOST_PER_BYTE * text + (window << 20) + 1024:
            raise ValueError(f"a window set of {built.nbytes()} bytes for {text} bytes of text")
        shared = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = b.column(b.schema.get_field_index(text_col))
                for lo, hi in slices(text):
                    n, spans, named = scan(text[lo:hi], shared.value)
                    rows = b.slice(lo, hi - lo)
                    if RUNS in rows.schema.names:
                        for d, old in enumerate(rows.column(rows.schema.get_field_index(RUNS)).to_pylist()):
                            if old:
                                spans.setdefault(d, []).extend(map(tuple, old))
                                named.setdefault(d, set()).update(rows.column(rows.schema.get_field_index(ITEMS))[d].as_py())
                        rows = rows.select([c for c in rows.schema.names if c not in ("n_words", RUNS, ITEMS)])
                    runs = pa.array([merged(spans.get(d, [])) for d in range(hi - lo)], pa.list_(pa.list_(pa.int64())))
                    who = pa.array([sorted(named.get(d, ())) for d in range(hi - lo)], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64()), runs, who], names=[*rows.schema.names, "n_words", RUNS, ITEMS])

        if k == n_sets - 1 and then is not None:
            schema, last = then(T.StructType(fields))
            out = out.mapInArrow(lambda batches, run=run: last(run(batches)), schema)
        else:
            out = out.mapInArrow(run, T.StructType(fields))
            out = out if k == n_sets - 1 else cut(out, "window-hits")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "spans", text_col: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids of items with windows in the text), ``contaminated`` and ``clean_text``.

    Words are ASCII letters (lower-cased), digits and non-ASCII characters; a window is ``window`` consecutive item
    words, or the whole item if it has fewer words but one. A word inside any occurrence of a window is hit.
    ``remove``: ``spans`` takes the hit words, with what stands between words of one span, out of ``clean_text``;
    ``documents`` makes ``clean_text`` null for a contaminated document. Every window whose hash is in the set is
    compared word by word, so hash collisions change nothing. Null texts have no words and stay null. Items with
    equal text are all named; a null item id counts as the empty string. Repeated rows are treated alike. An empty
    benchmark hits nothing. Input columns named as an output column are replaced.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    docs = plain(docs, "n_hit", "items", "contaminated", "clean_text")
    names = [*plain(docs, "n_words", RUNS, ITEMS).columns, "n_words", "n_hit", "items", "contaminated", "clean_text"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, clean = [], []
            for runs, text in zip(b.column(b.schema.get_field_index(RUNS)).to_pylist(), b.column(b.schema.get_field_index(text_col))):
                n_hit.append(sum(e - s for s, e in runs))
                clean.append(text.as_py() if not runs else None if remove == "documents" else without(text.as_py(), runs))
            keep = [b.column(b.schema.get_field_index(c)) for c in names[:-4]]
            items = b.column(b.schema.get_field_index(ITEMS))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_hit, pa.int64()), items, pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(clean, pa.string())], names=names)

    def then(found: T.StructType):
        new = [T.StructField("n_hit", T.LongType(), False), T.StructField("items", T.ArrayType(T.StringType()), False), T.StructField("contaminated", T.BooleanType(), False), T.StructField("clean_text", T.StringType())]
        return T.StructType([*(found[c] for c in names[:-4]), *new]), finish

    return with_hits(docs, benchmark, window, text_col, set_bytes, then)


def without(text: str, runs: list[list[int]]) -> str:
    """``text`` without the words of each run and what stands between them."""
    w = words(pa.array([text]), NOT_ALNUM, LOWER)
    raw, out, at = text.encode(), [], 0
    for s, e in runs:
        out.append(raw[at : w.start[s]])
        at = w.end[e - 1]
    return b"".join([*out, raw[at:]]).decode()
