"""LM scoring: a probabilistic suffix tree over the bytes of the token stream, and unigram counts of its words.

The stream of a text is its words, lower-cased (A-Z), with one space between, and an end symbol. A state of the tree
is a context of up to ``DEPTH`` preceding symbols, kept where a divergence test tells its next-symbol distribution
from that of the context one symbol shorter; and the suffixes of such, which are its path to the root. A text is scored
from the longest suffix of its history that is a state, whose distribution is smoothed with that of its path.
Every context that passes is kept, however many there are. Counts stay a table, dealt into buckets by the last three
symbols of a context, so a bucket holds all of a path but its last two steps, which the alphabet bounds. The distinct
contexts of each chunk meet the counts there, and log probabilities go back to the chunks.

    texts -> chunks -> words by hash: counts back to the chunks
                    -> counts of (context, symbol) -> states of one and two symbols -> bucket: states, log probabilities
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc32_of_id, cut, whole_ids
from .vec import SPACE, LOWER, slices, spans, words

DEPTH, END, GAP = 5, 0x0A, 0x20
#: A context is kept if n * divergence exceeds this times (its distinct next symbols) * ln(all symbols).
PENALTY = 0.5
#: States of fewer symbols go to every task: their number is bounded by the alphabet, not by the corpus.
NEAR = 3
#: Weight of the shorter context's distribution in a state's own, in symbols.
PRIOR = 4.0
CHUNK = 4 << 20
#: Symbols of training text that one group of a bucket answers for; a bucket with more is dealt to several by chunk.
GROUP_SYMBOLS = 64 << 20


# ---- chunks: the corpus as local word numbers and a dictionary -------------------------------------------------


def chunked(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised chunks of ``CHUNK`` bytes about: word numbers into the chunk's own dictionary. Written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out.alias("held"), F.spark_partition_id().alias("part"))
    schema = "chunk long, doc_ids array<long>, held binary, n binary, ids binary, dict binary, sizes binary, trained binary, n_dict long, n_trained long, n_train_docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        for b in batches:
            text = b.column(1)
            for lo, hi in slices(text, CHUNK):
                w = words(text[lo:hi], SPACE, LOWER)
                data, offs = w.compact()
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(data)]).dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                held = b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                trained = np.bincount(ids[~held[w.doc]], minlength=len(coded.dictionary))
                own = words(coded.dictionary.cast(pa.large_string()), SPACE, LOWER)
                order = np.argsort(own.hashes(), kind="stable")  # by hash, as the counts come back
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                sizes = (own.end - own.start)[order]
                sorted_bytes = own.low[spans(own.start[order], sizes)]
                out = [(b.column(3)[lo].as_py() << 32) + chunk, b.column(0)[lo:hi].to_pylist(), held.tobytes(), w.n.astype("<i4").tobytes(), packed(rank[ids], len(order)), sorted_bytes.tobytes(), sizes.astype("<i4").tobytes(), trained[order].astype("<i8").tobytes(), len(order), int(trained.sum() + (~held).sum()), int((~held).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, *[pa.int64()] * 3))], names=[x.split()[0] for x in schema.split(", ")])
                chunk += 1

    return cut(rows.mapInArrow(run, schema), "lm-chunks", "zstd")


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, all first bytes first: what hardly changes then costs hardly anything once it
    is compressed, on its way to a file or through a shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int, kind: type) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(kind)


def packed(ids: np.ndarray, n_dict: int) -> bytes:
    """Word numbers as ranks by frequency, whose upper bytes are mostly zero, behind the word number of each rank."""
    of_rank = np.argsort(-np.bincount(ids, minlength=n_dict), kind="stable").astype("<i4")
    rank = np.empty(n_dict, np.int32)
    rank[of_rank] = np.arange(n_dict, dtype=np.int32)
    return of_rank.tobytes() + planes(rank[ids], 4)


def unpacked(data: bytes, sizes: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4", len(sizes) // 4)[from_planes(data[len(sizes) :], 4, np.int32)]


def one_by_one(batch: pa.RecordBatch) -> Iterator[list]:
    """Rows as Python values, one in memory at a time: a chunk is some MB."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def word_hashes(dictionary: bytes, sizes: bytes) -> np.ndarray:
    size = np.frombuffer(sizes, "<i4").astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(dictionary))
    return words(text, SPACE, LOWER).hashes()


def counts_back(chunks: DataFrame) -> tuple[DataFrame, int, int]:
    """For each chunk and bucket of hashes, the corpus-wide training counts of the chunk's words, in order of hash; and
    N and V. Words meet by hash in buckets of about 500,000 entries; their counts then go back to the chunks."""
    entries, n_trained = chunks.agg(F.sum("n_dict"), F.sum("n_trained")).first()
    bits = max(6, int(np.ceil(np.log2(max(1, entries or 0) / 500_000 + 1))))
    shift = np.uint64(64 - bits)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, d, s, t in one_by_one(b):
                h, n = word_hashes(d, s), np.frombuffer(t, "<i8")
                at = np.searchsorted(h >> shift, np.arange((1 << bits) + 1).astype(np.uint64))
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([chunk] * len(some), pa.int64()), pa.array([h[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()), pa.array([n[at[i] : at[i + 1]].astype("<i4" if n.max(initial=0) < 1 << 31 else "<i8").tobytes() for i in some], pa.binary())], names=["bucket", "chunk", "h", "n"])

    def meet(table: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
        ns = [np.frombuffer(x, "<i4" if len(x) == 4 * len(h) else "<i8") for x, h in zip(table.column("n").to_pylist(), hs)]
        keys, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate(ns))
        back = np.split(total[inverse], np.cumsum([len(h) for h in hs])[:-1])
        seen = [int((total > 0).sum())] + [0] * (len(hs) - 1)
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array([x.astype("<i8").tobytes() for x in back], pa.binary()), pa.array(seen, pa.int64())], names=["chunk", "bucket", "counts", "seen"])

    sent = chunks.select("chunk", "dict", "sizes", "trained").mapInArrow(split, "bucket long, chunk long, h binary, n binary")
    back = cut(sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket long, counts binary, seen long"), "lm-counts", "zstd")
    distinct = back.agg(F.sum("seen")).first()[0] or 0
    return back.drop("seen"), int(n_trained or 0), int(distinct)


# ---- the suffix tree -------------------------------------------------------------------------------------------


def stream(n: np.ndarray, ids: np.ndarray, dictionary: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts of a chunk, each after DEPTH end symbols; and the place just past each text."""
    size = np.frombuffer(sizes, "<i4").astype(np.int64)
    at = np.cumsum(size) - size
    low = np.frombuffer(dictionary, np.uint8)
    n = n.astype(np.int64)
    each = size[ids] + 1  # the word and the space, or the end, after it
    past_word = np.cumsum(each)
    last = np.cumsum(n)
    body = np.where(n > 0, past_word[np.maximum(last, 1) - 1] if len(ids) else 0, 0)
    body = np.maximum.accumulate(body)
    empty = np.cumsum(n == 0)  # an empty text is its end symbol alone
    past = body + empty + DEPTH * np.arange(1, len(n) + 1)
    out = np.full(int(past[-1]) if len(n) else 0, END, np.uint8)
    doc = np.repeat(np.arange(len(n)), n)
    start = past_word - each + DEPTH * (doc + 1) + empty[doc]
    out[spans(start, size[ids])] = low[spans(at[ids], size[ids])]
    gaps = start + size[ids]
    inner = np.ones(len(ids), bool)
    inner[last[n > 0] - 1] = False
    out[gaps[inner]] = GAP
    return out, past


def gram_keys(s: np.ndarray, past: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """(DEPTH preceding symbols, symbol) as one number, of each symbol of the texts, or of those to use."""
    n = max(0, len(s) - DEPTH)
    key = np.zeros(n, np.uint64)
    for j in range(DEPTH + 1):
        key <<= np.uint64(8)
        key |= s[j : j + n]
    inside = np.ones(len(s), bool)
    begin = np.concatenate([[0], past[:-1]])
    inside[(begin[:, None] + np.arange(DEPTH)).reshape(-1)] = False
    if use is not None:
        inside &= np.repeat(use, past - begin)
    return key[inside[DEPTH:]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order of first sight, and the number of each among them."""
    found = pa.array(keys.view(np.int64)).dictionary_encode()
    return found.dictionary.to_numpy().view(np.uint64), found.indices.to_numpy()


def train_grams(chunks: DataFrame, bits: int) -> DataFrame:
    """(key, n, bucket): counts of all (context of DEPTH symbols, next symbol) of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for held, n, ids, d, sizes in one_by_one(b):
                s, past = stream(np.frombuffer(n, "<i4"), unpacked(ids, sizes), d, sizes)
                new, at = distinct(gram_keys(s, past, ~np.frombuffer(held, bool)))
                keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, np.bincount(at, minlength=len(new))]))
                if len(keys) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "n"])
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "n"])

    found = chunks.select("held", "n", "ids", "dict", "sizes").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    last = F.shiftright("key", 8).bitwiseAND(F.lit(low(NEAR)))
    return cut(found.withColumn("bucket", F.shiftright((last * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)), "lm-grams")


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Of (context, symbol) keys, by a hash of the last NEAR symbols of the context."""
    last = (keys >> np.uint64(8)) & np.uint64(low(NEAR))
    return ((last * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def by_bucket_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket and then by the last symbols of their contexts, and their buckets in that order."""
    bucket = bucket_of(keys, bits)
    order = np.lexsort((keys, (keys >> np.uint64(8)) & np.uint64(low(NEAR)), bucket))
    return order, bucket[order]


def low(symbols: int) -> int:
    return (1 << (8 * symbols)) - 1


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and their sums."""
    out, inverse = np.unique(keys, return_inverse=True)
    return out, np.bincount(inverse, counts, len(out)).astype(np.int64)


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


class Level:
    """Counts of contexts of ``d`` symbols: (context, symbol) keys in order and how often each was seen; the contexts in
    order, where each one's keys begin, their total."""

    def __init__(self, d: int, keys: np.ndarray, n: np.ndarray):
        self.d = d
        self.keys, self.n = summed(keys & np.uint64(low(d + 1)), n)
        ctx = self.keys >> np.uint64(8)
        self.first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
        self.contexts = ctx[self.first]
        self.total = np.add.reduceat(self.n, self.first) if len(ctx) else np.zeros(0, np.int64)
        self.seen = np.diff(np.append(self.first, len(ctx)))

    def passing(self, above: Level, all_symbols: int) -> np.ndarray:
        """Which contexts the divergence test tells from those one symbol shorter, in ``above``."""
        if not len(self.keys):
            return np.zeros(0, bool)
        of = np.repeat(np.arange(len(self.contexts)), self.seen)
        own = self.keys & np.uint64(low(self.d))
        at, _ = place(above.keys, own)
        over, _ = place(above.contexts, own >> np.uint64(8))
        each = self.n * np.log(self.n / self.total[of] * (above.total[over] / above.n[at]))
        return np.round(np.add.reduceat(each, self.first), 6) > PENALTY * self.seen * np.log(all_symbols)


#: Of each depth: (context, symbol) keys of the states in order and their log10 probabilities; the states in order, and what
#: is added to the log10 probability by the context one symbol shorter for a symbol not seen.
States = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def with_level(states: States, level: Level, kept: np.ndarray, all_symbols: int) -> None:
    """Add the ``kept`` contexts of a level to the states, smoothed with the level above."""
    mine = np.repeat(kept, level.seen)
    keys, n, t = level.keys[mine], level.n[mine], np.repeat(level.total, level.seen)[mine]
    if level.d:
        above, logp, _, _ = states[level.d - 1]
        at, _ = place(above, keys & np.uint64(low(level.d)))
        states[level.d] = keys, np.log10((n + PRIOR * 10.0 ** logp[at]) / (t + PRIOR)), level.contexts[kept], np.log10(PRIOR / (level.total[kept] + PRIOR))
    else:  # the root gives each byte value an extra count of one
        states[0] = keys, np.log10((n + 1) / (all_symbols + 256.0)), level.contexts[kept], np.zeros(int(kept.sum()))


def far_kept(keys: np.ndarray, n: np.ndarray, near: Level, all_symbols: int) -> list[tuple[Level, np.ndarray]]:
    """Levels from NEAR symbols on of the counts of a bucket, each with which of its contexts are states. near: the level
    above the first."""
    levels = [near, *(Level(d, keys, n) for d in range(NEAR, DEPTH + 1))]
    kept = [x.passing(above, all_symbols) for above, x in zip(levels, levels[1:])]
    for i in range(len(kept) - 1, 0, -1):  # suffixes of states are states
        at, _ = place(levels[i].contexts, np.unique(levels[i + 1].contexts[kept[i]] & np.uint64(low(levels[i].d))))
        kept[i - 1][at] = True
    return list(zip(levels[1:], kept))


def near_states(grams: DataFrame) -> tuple[States, Level, int]:
    """States of fewer than NEAR symbols, the level of NEAR - 1, and all symbols. Each (context, symbol) of these is a row
    on the driver: their number is bounded by the alphabet, 256 to the power of NEAR, not by the corpus."""
    rows = grams.groupBy(F.col("key").bitwiseAND(F.lit(low(NEAR))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = rows.column("key").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    levels = [Level(d, keys, n) for d in range(NEAR)]
    all_symbols = int(n.sum())
    kept = [np.ones(len(levels[0].contexts), bool), *(x.passing(above, all_symbols) for above, x in zip(levels, levels[1:]))]

    def needed(table: pa.Table) -> pa.Table:
        level, far = far_kept(table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy(), last.value, max(all_symbols, 1))[0]
        return pa.table({"ctx": pa.array(np.unique(level.contexts[far] & np.uint64(low(NEAR - 1))).astype(np.int64))})

    last = grams.sparkSession.sparkContext.broadcast(levels[-1])
    wanted = grams.select("bucket", "key", "n").groupBy("bucket").applyInArrow(needed, "ctx long").distinct().toArrow().column("ctx").to_numpy().astype(np.uint64)
    for d in range(NEAR - 1, 0, -1):
        at, _ = place(levels[d].contexts, np.unique(wanted))
        kept[d][at] = True
        wanted = levels[d].contexts[kept[d]] & np.uint64(low(d - 1))
    states: States = {}
    for level, k in zip(levels, kept):
        with_level(states, level, k, all_symbols)
    return states, levels[-1], all_symbols


def log_probabilities(keys: np.ndarray, states: States, all_symbols: int) -> np.ndarray:
    """log10 probability of the symbol of each (DEPTH symbols, symbol), from its longest suffix that is a state."""
    out, left = np.zeros(len(keys)), np.arange(len(keys))
    for d in range(DEPTH, -1, -1):
        if d in states:
            seen, logp, contexts, rest = states[d]
            own = keys[left] & np.uint64(low(d + 1))
            at, hit = place(seen, own)
            out[left[hit]] += logp[at[hit]]
            left, own = left[~hit], own[~hit]
            at, state = place(contexts, own >> np.uint64(8))
            if d:
                out[left[state]] += rest[at[state]]
    out[left] -= np.log10(all_symbols + 256.0)
    return out


def bucket_bits(chunks: DataFrame) -> int:
    """Bits of a bucket's number. A chunk has one distinct key in 20 symbols or so; buckets hold about 500,000 keys."""
    size = chunks.agg(F.sum(F.octet_length("ids"))).first()[0] or 0  # four bytes a word, of about five symbols
    return min(20, max(6, int(np.ceil(np.log2(size / 16 / 500_000 + 1)))))


def scores_back(chunks: DataFrame, grams: DataFrame, bits: int) -> DataFrame:
    """For each chunk and bucket, log10 probabilities of the chunk's distinct keys, in the order of ``by_bucket_of``.

    A group is a bucket, or where its contexts make up much of the text, its part for some of the chunks, with the
    bucket's counts for each; so groups do not grow with the corpus. Log probabilities travel in single precision. Counts of a bucket are bounded by the alphabet.
    """
    states, last, all_symbols = near_states(grams)
    sc = chunks.sparkSession.sparkContext
    shared = sc.broadcast((states, last))
    heavy = grams.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP_SYMBOLS).collect()  # at most 2**bits
    parts = {r["bucket"]: 1 + r["n"] // GROUP_SYMBOLS for r in heavy}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, n, ids, d, sizes in one_by_one(b):
                key, _ = distinct(gram_keys(*stream(np.frombuffer(n, "<i4"), unpacked(ids, sizes), d, sizes)))
                order, bucket = by_bucket_of(key, bits)
                key, at = key[order], np.searchsorted(bucket, np.arange((1 << bits) + 1).astype(np.uint64))
                some = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([chunk % parts.get(i, 1) for i in some], pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array([planes(key[at[i] : at[i + 1]], DEPTH + 1) for i in some], pa.binary())], names=["bucket", "part", "chunk", "keys"])

    def meet(asked: pa.Table, counts: pa.Table) -> pa.Table:
        near, above = shared.value
        own = dict(near)
        for level, kept in far_kept(counts.column("key").to_numpy().astype(np.uint64), counts.column("n").to_numpy(), above, max(all_symbols, 1)):
            with_level(own, level, kept, all_symbols)
        found = [planes(log_probabilities(from_planes(x.as_py(), DEPTH + 1, np.uint64), own, all_symbols).astype(np.float32).view(np.uint32), 4) for x in asked.column("keys")]
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(found, pa.binary())], names=["chunk", "bucket", "logp"])

    sent = chunks.select("chunk", "n", "ids", "dict", "sizes").mapInArrow(split, "bucket long, part long, chunk long, keys binary")
    table = grams.sparkSession.createDataFrame(list(parts.items()), "bucket long, parts long")
    n_parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = grams.join(table, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part"), "key", "n")
    return cut(sent.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInArrow(meet, "chunk long, bucket long, logp binary"), "lm-logp", "zstd")


def text_scores(s: np.ndarray, past: np.ndarray, by_bucket: np.ndarray, bits: int) -> np.ndarray:
    """log10 probability of each text of a chunk, from what ``scores_back`` gives for it."""
    if not len(past):
        return np.zeros(0)
    keys, at = distinct(gram_keys(s, past))
    logp = np.empty(len(keys))
    logp[by_bucket_of(keys, bits)[0]] = by_bucket
    sums = np.concatenate([[0.0], np.cumsum(logp[at])])
    ends = past - DEPTH * np.arange(1, len(past) + 1)
    return np.diff(sums[np.concatenate([[0], ends])])


# ---- scores ----------------------------------------------------------------------------------------------------


def score(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score (add-one unigrams, log10) and score (the suffix tree's log10 probability of the text).

    ``held_out``: a boolean column; such rows are not learnt from. Default: crc32 of the id as text, modulo 7, is 2.
    Ids are whole numbers (TypeError otherwise) or null. Null texts count as empty: one token, the end. Repeated rows count
    and are scored each for itself, alike. Without any training row every distribution is uniform and base_score is
    log10(1/1) for each token. An empty table gives no rows. Other columns of ``docs`` are left out, so none clashes. Word
    counts are exact but for collisions of 64-bit hashes.
    """
    whole_ids(docs, id_col)
    held_out = held_out if held_out is not None else F.pmod(crc32_of_id(F.col(id_col)), F.lit(7)) == 2
    chunks = chunked(docs, held_out, id_col, text_col)
    back, n_train, distinct = counts_back(chunks)
    ends = int(chunks.agg(F.sum("n_train_docs")).first()[0] or 0)
    bits = bucket_bits(chunks)
    logps = scores_back(chunks, train_grams(chunks, bits), bits)
    floor = np.log10(n_train + distinct + (1 if ends else 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, held, n, ids, d, sizes, parts in one_by_one(b):
                held, n, ids = np.frombuffer(held, bool), np.frombuffer(n, "<i4").astype(np.int64), unpacked(ids, sizes)
                parts = sorted(parts or [], key=lambda x: x["bucket"])
                c = np.frombuffer(b"".join(x["counts"] for x in parts if x["counts"] is not None), "<i8")
                logp = np.concatenate([np.zeros(0, np.float32), *(from_planes(x["logp"], 4, np.float32) for x in parts if x["logp"] is not None)])
                doc = np.repeat(np.arange(len(n)), n)
                base = np.bincount(doc, (np.log10(c + 1.0) - floor)[ids], len(n)) + np.log10(ends + 1.0) - floor
                known = np.bincount(doc, (c > 0)[ids], len(n)).astype(np.int64) + (1 if ends else 0)
                total = text_scores(*stream(n, ids, d, sizes), logp, bits)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(held), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = back.unionByName(logps, allowMissingColumns=True)
    lists = both.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "logp")).alias("parts"))
    joined = chunks.join(lists, "chunk", "left").select("doc_ids", "held", "n", "ids", "dict", "sizes", "parts")
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

