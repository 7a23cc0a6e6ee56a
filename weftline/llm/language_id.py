"""Language ID: bit-sliced Bloom filters that return, for an n-gram, the bitmask of all languages that contain it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, plain
from .vec import flat, mix, slices

#: N-grams are of so many bytes of UTF-8. ASCII letters are lower-cased; runs of other ASCII characters count as spaces.
GRAM = 4
#: Labelled rows from which each language is learnt, about; of more than that, so many are drawn at random.
SAMPLE_ROWS = 3000
#: Labels that a model may have: a name each reaches the driver, and a cell has a bit for each. There are some 7,900 languages.
MOST_LANGS = 8192
#: Cells that a model may have, all slices together, of eight bytes at most each: 128 MB, as 1,000 labels of 40,000 n-grams need.
MOST_CELLS = 1 << 24
#: N-grams whose masks are taken apart at a time, and sums (a text, a label) that are held at a time.
AT_ONCE, SUMS = 1 << 17, 1 << 22
#: A language contains an n-gram that occurs twice at least there and as often, relatively, as this part of its sum over languages.
SHARE, LEAST = 0.3, 2
#: Cells for each n-gram of the language that has most. With every doubling of the labels above four an n-gram takes a cell
#: more, up to MOST_HASHES: a label's rate of false hits falls (1.4 % at two cells, 0.06 % at eight, at the fullest) as labels that
#: can give one increase, so a small model serves many labels.
CELLS_PER_GRAM, HASHES, MOST_HASHES, SEED = 16, 2, 8, 17
FOLD = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
#: Odd, one for each hash function and one for what they share.
FACTORS = mix(np.arange(1, MOST_HASHES + 2, dtype=np.uint64)) | np.uint64(1)
HAS_LETTER = r"\pL"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams within the texts but those that begin with two spaces, and the number of each one's text."""
    raw, offs = flat(texts)
    if len(raw) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    y = FOLD[raw].astype(np.uint32)
    n = len(y) - GRAM + 1
    g = np.zeros(n, np.uint32)
    for j in range(GRAM):
        g = (g << np.uint32(8)) | y[j : j + n]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offs))
    keep = (doc[:n] == doc[GRAM - 1 :]) & ((g >> np.uint32(8 * (GRAM - 2))) != 0x2020)
    return g[keep], doc[:n][keep]


def cells(g: np.ndarray, size: int, hashes: int = HASHES) -> list[np.ndarray]:
    """Where each n-gram's masks stand: one place for each hash function. size: a power of two."""
    h = g * FACTORS[-1]
    h ^= h >> np.uint64(32)
    shift = np.uint64(65 - size.bit_length())
    return [(h * f >> shift).view(np.int64) for f in FACTORS[:hashes]]


@dataclass
class Model:
    """langs: by falling number of training rows. masks: of each cell, in slices of as many languages as the type has bits:
    bit l of slice w tells whether language w * bits + l set the cell."""

    langs: list[str]
    masks: np.ndarray
    hashes: int = HASHES

    def bit(self, words: np.ndarray, lang: int) -> np.ndarray:
        """Of masks, or of what n-grams have in common with them, by slices: whether the language's bit is set."""
        kind = words.dtype.type
        return (words[lang // np.iinfo(kind).bits] >> kind(lang % np.iinfo(kind).bits)) & kind(1)

    def popcounts(self, words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): how many of a text's words have each language's bit set. ``doc``: each word's text, in rising order.
        Words without any bit are passed over, and the others are taken apart some at a time."""
        bits = words.dtype.itemsize * 8
        out = np.zeros((n, len(words) * bits), np.int64)
        for w, row in enumerate(words):
            some = np.flatnonzero(row)
            for lo in range(0, len(some), AT_ONCE):
                at = some[lo : lo + AT_ONCE]
                word, bit = np.divmod(np.flatnonzero(np.unpackbits(row[at].view(np.uint8), bitorder="little").view(bool)), bits)
                first, last = doc[at[0]], doc[at[-1]] + 1
                sums = np.bincount((doc[at[word]] - first).astype(np.int64) * bits + bit, minlength=(last - first) * bits)
                out[first:last, w * bits : (w + 1) * bits] += sums.reshape(-1, bits)
        return out[:, : len(self.langs)]

    @cached_property
    def rates(self) -> np.ndarray:
        return (self.popcounts(self.masks, np.zeros(self.masks.shape[1], np.int64), 1)[0] / self.masks.shape[1]) ** self.hashes

    def false_positive(self) -> np.ndarray:
        """Per language: the part of n-grams outside it whose cells are all set."""
        return self.rates

    def found(self, g: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, by slices."""
        out = np.full((len(self.masks), len(g)), np.iinfo(self.masks.dtype).max, self.masks.dtype)
        for at in cells(g, self.masks.shape[1], self.hashes):
            out &= self.masks[:, at]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Label and score of each text, so many texts at a time that their sums by language keep within SUMS."""
        langs, scores = [], []
        step = max(1, SUMS // len(self.langs))
        for lo in range(0, len(texts), step):
            lang, score = self._predict(texts[lo : lo + step])
            langs += lang
            scores += score
        return langs, scores

    def _predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        g, doc = grams(texts)
        n = np.bincount(doc, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.langs)), np.int64)
        step = max(1, AT_ONCE // len(self.masks))
        for lo in range(0, len(g), step):
            own = doc[lo : lo + step]
            hits[own[0] : own[-1] + 1] += self.popcounts(self.found(g[lo : lo + step]), own - own[0], int(own[-1] - own[0]) + 1)
        rate = self.rates
        true = np.maximum(0, (hits - n[:, None] * rate) / np.maximum(1e-9, 1 - rate))
        best = true.argmax(1)
        total = true.sum(1)
        score = np.where(total > 0, true[np.arange(len(best)), best] / np.maximum(total, 1e-300), 0.0)
        letters = pc.match_substring_regex(texts.fill_null(""), HAS_LETTER).to_numpy(zero_copy_only=False).astype(bool)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0).tolist()


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a text and a label.

    ``sample_rows`` bounds what each language is learnt from, in the mean over seeded draws of rows; n-gram counts of that
    sample meet in a shuffle, cells are filled there, and only their masks reach the driver. Rows with a null text or label
    teach nothing; repeated rows count each; of languages with equally many rows the smaller name comes first. Without a
    labelled row the one language is ``und``. ValueError above MOST_LANGS labels, and above MOST_CELLS cells before any is collected. Other columns are not read.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = sorted(((r[0], r[1]) for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()), key=lambda x: (-x[1], x[0]))
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels")
    langs = [x for x, _ in counts]
    if not langs:
        return Model(["und"], np.zeros((1, 16), np.uint8))
    spark = labelled.sparkSession
    part = spark.createDataFrame([(lang, i, min(1.0, sample_rows / n)) for i, (lang, n) in enumerate(counts)], "lang string, bit long, part double")
    part = F.broadcast(part)  # MOST_LANGS rows at most
    sample = rows.withColumn("draw", F.rand(SEED)).join(part, "lang").where("draw < part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, bit = b.column(0), b.column(1).to_numpy().astype(np.uint64)
            for lo, hi in slices(text):
                g, doc = grams(text[lo:hi])
                key, n = np.unique(bit[lo:hi][doc] << np.uint64(32) | g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array((key >> np.uint64(32)).astype(np.int64)), pa.array(n, pa.int64())], names=["g", "bit", "n"])

    found = cut(sample.select("text", "bit").mapInArrow(count, "g long, bit long, n long").groupBy("g", "bit").agg(F.sum("n").alias("n")), "lang-grams")
    totals = found.groupBy("bit").agg(F.sum("n").cast("double").alias("total"))
    share = found.join(F.broadcast(totals), "bit").withColumn("p", F.col("n") / F.col("total"))  # a row a label
    sums = share.groupBy("g").agg(F.sum("p").alias("all"))
    kept = cut(share.join(sums, "g").where((F.col("n") >= LEAST) & (F.col("p") >= SHARE * F.col("all"))).select("g", "bit"), "lang-kept")
    most = kept.groupBy("bit").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    size = 1 << max(16, int(np.ceil(np.log2(max(1, most) * CELLS_PER_GRAM))))
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.iinfo(t).bits >= len(langs)), np.uint64)
    width = np.iinfo(kind).bits
    n_slices, hashes = -(-len(langs) // width), min(MOST_HASHES, max(HASHES, (len(langs) - 1).bit_length()))
    if n_slices * size > MOST_CELLS:
        raise ValueError(f"{len(langs)} labels of up to {most} n-grams need more than {MOST_CELLS} cells")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column(1).to_numpy()
            word = np.left_shift(np.uint64(1), (bit % width).astype(np.uint64)).view(np.int64)
            for at in cells(b.column(0).to_numpy().astype(np.uint32), size, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(bit // width * size + at), pa.array(word)], names=["cell", "word"])

    filled = kept.mapInArrow(placed, "cell long, word long").groupBy("cell").agg(F.bit_or("word").alias("word")).toArrow()
    masks = np.zeros(n_slices * size, kind)
    masks[filled.column("cell").to_numpy()] = filled.column("word").to_numpy().view(np.uint64).astype(kind)
    return Model(langs, masks.reshape(n_slices, size), hashes)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the language's part of all corrected hits, 0 to 1).

    Whole texts are read. ``und`` with score 0: a null text, or one without a letter. A text without any hit, as a very
    short one, goes to the language with most training rows, with score 0; ties go the same way. Repeated rows are
    treated alike. An empty table gives an empty table. Input columns named as an output column are replaced.
    """
    docs = plain(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    # MOST_CELLS cells at most.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            for lo, hi in slices(text):
                lang, score = shared.value.predict(text[lo:hi])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
