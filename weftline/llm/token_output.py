"""Token-ID output: patched frame-of-reference blocks in binary files.

A file holds the ids of a run of documents, in ascending order of their doc_id:

    magic "WPFR"
    a block: uint32 minimum, uint8 width, uint16 exceptions, then ``width`` bit planes of (value - minimum), each of
    values / 8 bytes, then the exceptions' uint16 positions and uint32 values (value - minimum)
    documents: int64 doc_id, uint8 (1: the doc_id is null) and uint64 number of ids, each as an array
    index: uint64 place of each block in the file, and of the end of the last
    tail: uint32 version, values a block, documents, blocks; uint64 ids; magic

All numbers are little-endian. The width is the number of bits that ``PERCENTILE`` of a block's offsets from its minimum
need; larger offsets keep their low bits in the planes and stand whole in the exception list. The last block is filled up
with its minimum. A writer holds one block's rest and the arrays of documents and index; a reader some blocks at a time.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, new_path, whole_ids
from .vec import LOWER, SAME, SPACE, Words, flat, slices, spans, worker_cache, words

BLOCK, PERCENTILE, MAGIC, VERSION, END_ID = 256, 90, b"WPFR", 2, 1
TAIL, TAIL_BYTES = "<4IQ4s", struct.calcsize("<4IQ4s")
#: Ids after which a file is full; the document that reaches it is its last.
FILE_IDS = 32 << 20
#: Ids decoded at a time, unless one document alone has more.
READ_IDS = 1 << 20
# What a tokenizer does before its merges if a text's ids are those of its pieces: white space only parts
# words, letters are lower-cased, and no match goes across a letter and the punctuation after it.
PIECEWISE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECEWISE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces whose ids one Python worker keeps; it starts anew beyond that.
KEPT_PIECES = 400_000
#: Pieces encoded in one call, with a control character's token between them.
JOINED, BETWEEN = 200, "\x01"
CLOSING = np.isin(np.arange(256), np.frombuffer(b".,!?;:%&$*#", np.uint8))
LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks end to end, and the start of each."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.uint64)
    x = np.empty(n * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = x[(n - 1) * BLOCK : len(ids)].min()
    x = x.reshape(n, BLOCK)
    low = x.min(1)
    x = x - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.ceil(np.log2(np.partition(x, rank, 1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
    big = (x.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    n_big = big.sum(1)
    size = 7 + width * (BLOCK // 8) + 6 * n_big
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(n, np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2")]))
    head["low"], head["width"], head["n"] = low, width, n_big
    out[start[:, None] + np.arange(7)] = head.view(np.uint8).reshape(n, 7)
    for k in range(int(width.max(initial=0))):
        rows = np.flatnonzero(width > k)
        plane = np.packbits((x[rows] >> np.uint32(k)).astype(np.uint8) & 1, axis=1)
        out[(start[rows] + 7 + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = plane
    row, col = np.nonzero(big)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_big) - n_big, n_big)
        at = start[row] + 7 + width[row] * (BLOCK // 8)
        out[(at + 2 * nth)[:, None] + np.arange(2)] = col.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[(at + 2 * n_big[row] + 4 * nth)[:, None] + np.arange(4)] = np.ascontiguousarray(x[row, col].astype("<u4")).view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start.astype(np.uint64)


def decode_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All values of the blocks that begin at ``start``, fillers of the last included."""
    n, at = len(start), start.astype(np.int64)
    head = np.ascontiguousarray(data[at[:, None] + np.arange(7)]).view(np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2")])).reshape(n)
    width, n_big = head["width"].astype(np.int64), head["n"].astype(np.int64)
    x = np.zeros((n, BLOCK), np.uint32)
    for k in range(int(width.max(initial=0))):
        rows = np.flatnonzero(width > k)
        plane = data[(at[rows] + 7 + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
        x[rows] |= np.unpackbits(plane, axis=1).astype(np.uint32) << np.uint32(k)
    row = np.repeat(np.arange(n), n_big)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_big) - n_big, n_big)
        tail = at[row] + 7 + width[row] * (BLOCK // 8)
        col = np.ascontiguousarray(data[(tail + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        x[row, col] = np.ascontiguousarray(data[(tail + 2 * n_big[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (x + head["low"][:, None]).reshape(-1)


class FileWriter:
    """Writes one file as its documents come."""

    def __init__(self, out):
        self.out, self.at, self.rest, self.n_ids = out, len(MAGIC), np.zeros(0, np.uint32), 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.blocks: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), nulls.astype(np.uint8), counts.astype("<u8")))
        self.n_ids += len(ids)
        x = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(x) // BLOCK * BLOCK
        self.put(x[:whole])
        self.rest = x[whole:]

    def put(self, ids: np.ndarray) -> None:
        data, start = encode_blocks(ids)
        self.out.write(data)
        self.blocks.append(start + np.uint64(self.at))
        self.at += len(data)

    def close(self) -> int:
        """The number of documents."""
        self.put(self.rest)
        columns = [np.concatenate(c) for c in zip(*self.docs)] if self.docs else [np.zeros(0, np.uint8)] * 3
        blocks = np.append(np.concatenate(self.blocks), np.uint64(self.at))
        for x in (*columns, blocks.astype("<u8")):
            self.out.write(x.tobytes())
        self.out.write(struct.pack(TAIL, VERSION, BLOCK, len(columns[0]), len(blocks) - 1, self.n_ids, MAGIC))
        return len(columns[0])


def read_file(f, size: int) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
    """doc_ids, ids before them in the file, numbers of ids, and ids, of some documents of an open file at a time."""

    def part(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail = part(size - TAIL_BYTES, TAIL_BYTES) if size >= TAIL_BYTES else b""
    if tail[-4:] != MAGIC:
        raise ValueError("not a token file")
    version, block, n, blocks, _, _ = struct.unpack(TAIL, tail)
    if version != VERSION or block != BLOCK:
        raise ValueError(f"version {version}, blocks of {block} values")
    lengths = 17 * n + 8 * (blocks + 1)
    head = part(size - TAIL_BYTES - lengths, lengths)
    doc_ids, nulls = np.frombuffer(head, "<i8", n), np.frombuffer(head, np.uint8, n, 8 * n)
    counts = np.frombuffer(head, "<u8", n, 9 * n).astype(np.int64)
    place = np.frombuffer(head, "<u8", blocks + 1, 17 * n).astype(np.int64)
    names = pa.array(doc_ids, mask=nulls.astype(bool))
    ends = np.cumsum(counts)
    lo = 0
    while lo < n:
        start = int(ends[lo] - counts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, start + READ_IDS, "right")))
        first, past = start // BLOCK, -(-int(ends[hi - 1]) // BLOCK)
        ids = np.zeros(0, np.uint32)
        if past > first:
            data = np.frombuffer(part(int(place[first]), int(place[past] - place[first])), np.uint8)
            ids = decode_blocks(data, place[first:past] - place[first])
        yield names[lo:hi], start, counts[lo:hi], ids[start - first * BLOCK : int(ends[hi - 1]) - first * BLOCK]
        lo = hi


def pieces_of(texts: pa.Array) -> Words:
    """Words between ASCII white space, with closing punctuation after an ASCII letter as a piece of its own, and
    A-Z lower-cased where that surely changes no id: no special token's brackets and no combining mark is near."""
    raw, _ = flat(texts)
    marks = bool(((raw == 0xCC) | (raw == 0xCD)).any())
    brackets = bool(((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)).any())
    w = words(texts, SPACE, SAME if marks or brackets else LOWER)
    if not len(w.start):
        return w
    tail = np.zeros(len(w.start), np.int64)
    for _ in range(4):
        at = w.end - 1 - tail
        tail += CLOSING[w.low[at]] & (at > w.start)
    tail[~LETTER[w.low[w.end - 1 - tail]]] = 0
    parts = 1 + (tail > 0)
    place = np.cumsum(parts) - parts
    start, end = np.repeat(w.start, parts), np.repeat(w.end, parts)
    two = tail > 0
    end[place[two]] -= tail[two]
    start[place[two] + 1] = end[place[two]]
    return Words(w.low, start, end, np.repeat(w.doc, parts), np.bincount(np.repeat(w.doc, parts), minlength=len(texts)))


class PieceEncoder:
    """Encodes texts piece by piece where the tokenizer drops white space and matches nothing across it, nor across a letter
    and the punctuation after it (PIECEWISE_*): then a text's ids are those of its pieces, and each distinct piece is
    encoded once for a worker. With any other tokenizer texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piecewise = is_piecewise(json.loads(self.tokenizer.to_str()))
        found = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = found[0] if len(found) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.start, self.ids, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0

    def add(self, pieces: list[str], size: np.ndarray, new: np.ndarray) -> None:
        while self.filled + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(new)] = new
        self.start = np.concatenate([self.start, self.filled + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.filled += len(new)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))

    def learn(self, pieces: list[str]) -> None:
        alone = [p for p in pieces if self.between is None or BETWEEN in p]
        if alone:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            self.add(alone, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((i for ids in found for i in ids), np.uint32))
        some = [p for p in pieces if not (self.between is None or BETWEEN in p)]
        if some:
            joined = [f" {BETWEEN} ".join([*some[k : k + JOINED], ""]) for k in range(0, len(some), JOINED)]
            x = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(x == self.between)
            self.add(some, np.diff(ends, prepend=-1) - 1, x[x != self.between])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids."""
        if not self.piecewise:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return counts, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
        w = pieces_of(texts)
        data, offs = w.compact()
        both = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(data)).dictionary_encode()
        pieces = both.dictionary.to_pylist()
        if len(self.number) > KEPT_PIECES:
            self.clear()
        self.learn([p for p in pieces if p not in self.number])
        piece = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        each = piece[both.indices.to_numpy(zero_copy_only=False)] if len(pieces) else np.zeros(0, np.int64)
        size = self.size[each]
        counts = np.bincount(w.doc, size, len(texts)).astype(np.int64)
        return counts, self.ids[spans(self.start[each], size)]


def is_piecewise(tokenizer: dict) -> bool:
    """Whether a tokenizer's definition is of the kind that PIECEWISE_* states."""
    steps = (tokenizer.get("normalizer") or {}).get("normalizers") or []
    first = ((tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    splits = first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECEWISE_SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    return splits and [x.get("type") for x in steps] == PIECEWISE_NORMALIZERS and steps[1].get("pattern") == {"Regex": r"\s+"}


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(counts)
    return counts + 1, np.insert(ids, at, np.uint32(end_id))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append ``end_id``, write files under ``folder`` in ascending ``id_col`` (nulls first).

    Returns the manifest, materialised: part and file (in order), name, n_docs, n_ids; documents and block starts are in
    the files. A task begins a new file at ``file_ids`` ids, so files and what a task holds do not grow with its
    partition. It writes under names of its own and the manifest lists only what finished tasks wrote, so a repeated or
    killed task leaves at most unlisted files.

    Ids are whole numbers (TypeError otherwise). Null and empty texts have the end id alone; rows that share an id, null
    among them, stand side by side in the order of reading; an empty table writes no file. Other columns of ``docs`` are
    not read, whatever their names.
    """
    whole_ids(docs, id_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        encoder = cache.get(tokenizer_path) or cache.setdefault(tokenizer_path, PieceEncoder(tokenizer_path))
        part = TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        writer, name, number = None, "", 0

        def closed() -> pa.RecordBatch:
            n_docs = writer.close()
            writer.out.close()
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([name]), pa.array([n_docs]), pa.array([writer.n_ids])], names=["part", "file", "name", "n_docs", "n_ids"])

        for b in batches:
            doc_ids, nulls = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in slices(b.column(1)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.wpfr"
                    writer = FileWriter(fs.open_output_stream(f"{root}/{name}"))
                writer.add(doc_ids[lo:hi], nulls[lo:hi], *with_end(*encoder.encode(b.column(1)[lo:hi]), end_id))
                if writer.n_ids >= file_ids:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    return cut(ranged.mapInArrow(run, "part long, file long, name string, n_docs long, n_ids long"), "tokens-manifest")


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    Only a row of totals for each file reaches the driver. An empty manifest gives no rows.
    """
    before, starts = 0, []
    for name, n in ((r["name"], r["n_ids"]) for r in sorted(manifest.select("part", "file", "name", "n_ids").collect())):
        starts.append((name, before))
        before += n
    spark: SparkSession = manifest.sparkSession
    files = spark.createDataFrame(starts, "name string, before long").repartition(max(1, len(starts)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    for doc_ids, start, counts, ids in read_file(f, f.size()):
                        ends = np.cumsum(counts)
                        at = ids.astype("<u4")
                        crcs = [zlib.crc32(at[s:e]) for s, e in zip((ends - counts).tolist(), ends.tolist())]
                        out = {"doc_id": doc_ids, "start": pa.array(before + start + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64())}
                        if with_ids:
                            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(out)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back; results as ``write_tokens`` and
    ``read_tokens`` state them."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder, **options), folder, with_ids)
