"""Secret scans: pattern spans, and a battery of randomness tests under false-discovery control. DataFrame functions only.

Each run of 20 or more characters of encodings outside the pattern spans is a candidate. Its encoding (decimal, hex,
base32, base64) is inferred from its characters, and as a sequence of digits of that encoding it goes through three tests:
the chi-squared statistic of its digit counts, the runs above and below the middle, and the lag-1 serial correlation.
Each statistic is measured twice: against uniform random digits, where none may lie beyond ``GATE``; and against text of
that encoding, whose moments follow from the letter frequencies below. The three scores against text, weighted by how far
random digits lie from text and less where those scatter more, add up to one, and its p-value is the chance that text
looks as random as the run does.
The p-values of all candidates of the table, each divided by its run's share of length, go through one step-up control at
``FALSE_DISCOVERIES``: long runs, which carry more evidence, are let through more easily than short ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain

# The patterns of the three base kinds, and the characters of encodings.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:passw|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
HEX_ALPHABET = "0123456789abcdef"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
KINDS = ("assign", "access", "hex", "random")

# Per cent of each letter from A to Z in English text, and of each digit in numbers as people write them.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
NUMERALS = (20, 18, 12, 9, 8, 8, 7, 6, 6, 6)
#: How often each digit stands in text of an encoding of so many: numbers, words of A to F, upper case, lower case.
TEXT_DIGITS = {
    10: NUMERALS,
    16: (0,) * 10 + LETTERS[:6],
    32: LETTERS + (0,) * 6,
    64: (0,) * 26 + LETTERS + (0,) * 12,
}

#: The part of text that is any other digit of the encoding.
OTHER = 0.05
#: Bound of each test's |z| under uniformity; the part of false discoveries; the least digits of a run that is tested.
GATE, FALSE_DISCOVERIES, LEAST_DIGITS, LEAST_SECRET = 3.3, 0.05, 16, 6
#: Steps to a doubling at which weighted p-values are told apart by the control.
STEPS = 8
SPAN = "struct<start:int,k:int,past:int>"


@dataclass(frozen=True)
class Kind:
    number: int
    pattern: str
    hint: str
    least_group: int | None = None


BASE = (Kind(0, ASSIGN, ASSIGN_HINT, 2), Kind(1, ACCESS, "AKIA"), Kind(2, HEX, HEX))


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans_of(text: Column, kind: Kind) -> Column:
    """Leftmost non-overlapping matches, in code points. Places add up from the pieces between matches."""
    pieces = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.least_group or 0)).alias("group"),
    )
    real = F.filter(pieces, lambda p: p["match"].isNotNull())
    lengths = F.transform(real, lambda p: F.struct(F.length(p["before"]).alias("b"), F.length(p["match"]).alias("m"), F.length(p["group"]).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), empty().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["b"]
        keep = p["g"] >= (LEAST_SECRET if kind.least_group else 0)
        new = F.struct(start.cast("int").alias("start"), F.lit(kind.number).alias("k"), (start + p["m"]).cast("int").alias("past"))
        return F.struct((start + p["m"]).alias("at"), F.when(keep, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(kind.hint), F.aggregate(lengths, zero, step, lambda acc: acc["out"])).otherwise(empty())


@dataclass(frozen=True)
class TextModel:
    """Moments of the three statistics for text of an encoding of ``k`` digits, taken as independent draws."""

    k: int
    same: float  # the chance that two digits are equal
    three: float  # that three are
    cross: float  # that neighbours lie on either side of the middle
    mean: float  # of the product of neighbours, from the middle
    spread: float  # that product's variance, and twice its covariance with the next one
    weights: tuple[float, float, float]


def text_model(k: int) -> TextModel:
    """Weights, of unit length: how many standard deviations of text lie between text and random digits in a run of 32, over
    the square of how many of them random digits scatter if that is more than one."""
    p = [(1 - OTHER) * x / sum(TEXT_DIGITS[k]) + OTHER / k for x in TEXT_DIGITS[k]]
    same, three = sum(x**2 for x in p), sum(x**3 for x in p)
    upper = sum(x for d, x in enumerate(p) if d >= k / 2)
    cross = 2 * upper * (1 - upper)
    first = sum(x * (d - (k - 1) / 2) for d, x in enumerate(p))
    second = sum(x * (d - (k - 1) / 2) ** 2 for d, x in enumerate(p))
    spread = second**2 - first**4 + 2 * (second - first**2) * first**2
    n = 32
    pairs = n * (n - 1) / 2
    shifts = (
        (pairs * (same - 1 / k), pairs * same * (1 - same) + n * (n - 1) * (n - 2) * (three - same**2), pairs / k * (1 - 1 / k)),
        ((n - 1) * (0.5 - cross), (n - 1) * cross * (1 - cross), (n - 1) / 4),
        ((n - 1) * first**2, (n - 1) * spread, (n - 1) * ((k * k - 1) / 12) ** 2),
    )
    apart = [max(0.0, shift) / math.sqrt(text) / max(1.0, random / text) for shift, text, random in shifts]
    return TextModel(k, same, three, cross, first**2, spread, tuple(x / math.hypot(*apart) for x in apart))


MODELS = {k: text_model(k) for k in TEXT_DIGITS}


def normal_below(z: Column) -> Column:
    """Normal distribution function, from above: by a bound of the tail within 2 %, at the tail's end too."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * 2 / (x + F.sqrt(x * x + 8 / math.pi))
    return F.when(z < 0, tail).otherwise(1 - tail)


def candidates(text: Column, base: Column) -> Column:
    """Runs outside base spans: (start, past, run without padding)."""
    runs = F.transform(spans_of(text, Kind(3, RUN, RUN)), lambda s: F.struct(s["start"].alias("start"), s["past"].alias("past"), F.rtrim(F.substring(text, s["start"] + 1, s["past"] - s["start"]), F.lit("=")).alias("run")))
    return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["past"]) & (b["past"] > r["start"])) & (F.length(r["run"]) >= LEAST_DIGITS))


def digits(found: Column) -> Column:
    """Each candidate with its encoding's size ``k``, its digits ``x`` and its length ``n``."""

    def one(r: Column) -> Column:
        run = r["run"]
        k = F.when(run.rlike("^[0-9]+$"), 10).when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(run.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
        same = F.when(k == 16, F.lower(run)).otherwise(F.translate(run, "-_=", "+/A"))
        alphabet = F.when(k <= 16, HEX_ALPHABET).when(k == 32, BASE32_ALPHABET).otherwise(BASE64_ALPHABET)
        x = F.transform(F.filter(F.split(same, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
        return F.struct(r["start"].alias("start"), r["past"].alias("past"), k.alias("k"), x.alias("x"), F.length(run).cast("double").alias("n"))

    return F.transform(found, one)


def sums(found: Column) -> Column:
    """What the tests need of the digits: squared counts, changes of half, digits in the upper half, products of neighbours."""

    def one(r: Column) -> Column:
        x, half, middle = r["x"], r["k"] / 2, (r["k"] - 1) / 2
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(x, lambda y: y == d)), 2))
        pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] >= half) != (p["b"] >= half))).cast("double")
        products = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle))
        return F.struct(*[r[c].alias(c) for c in ("start", "past", "n")], r["k"].cast("double").alias("k"), squares.alias("squares"), turns.alias("turns"), F.size(F.filter(x, lambda y: y >= half)).cast("double").alias("up"), products.alias("products"))

    return F.transform(found, one)


def by_encoding(k: Column, value) -> Column:
    first, *rest = MODELS
    out = F.when(k == first, F.lit(value(MODELS[first])))
    for other in rest:
        out = out.when(k == other, F.lit(value(MODELS[other])))
    return out


def battery(found: Column) -> Column:
    """Each candidate with ``ok``, whether the three tests of uniformity let it through, and ``step``: its p-value of being
    text divided by its length, as steps of which ``STEPS`` make a doubling."""

    def one(r: Column) -> Column:
        n, k, m = r["n"], r["k"], lambda value: by_encoding(r["k"], value)
        chi = (k / n * r["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        both = 2 * r["up"] * (n - r["up"])
        runs = (r["turns"] - both / n) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        serial = r["products"] / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1)
        ok = (chi <= GATE) & (F.abs(runs) <= GATE) & (F.abs(serial) <= GATE)
        pairs = n * (n - 1) / 2
        text_chi = ((r["squares"] - n) / 2 - pairs * m(lambda t: t.same)) / F.sqrt(pairs * m(lambda t: t.same * (1 - t.same)) + 2 * pairs * (n - 2) * m(lambda t: t.three - t.same**2))
        text_runs = ((n - 1) * m(lambda t: t.cross) - r["turns"]) / F.sqrt((n - 1) * m(lambda t: t.cross * (1 - t.cross)))
        text_serial = (r["products"] - (n - 1) * m(lambda t: t.mean)) / F.sqrt((n - 1) * m(lambda t: t.spread))
        z = sum((m(lambda t, i=i: t.weights[i]) * x for i, x in enumerate((text_chi, text_runs, text_serial))), F.lit(0.0))
        step = F.ceil(STEPS * F.log2(F.greatest(normal_below(z), F.lit(1e-300)) / n)).cast("int")
        return F.struct(r["start"].alias("start"), r["past"].alias("past"), n.alias("n"), ok.alias("ok"), step.alias("step"))

    return F.transform(found, one)


def tested(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``base_spans`` and ``__tested``, the battery's results of all candidates."""
    docs = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("__text")
    docs = docs.withColumn("__long", text.rlike(RUN))  # no access key, hex run or candidate without one
    rest = F.when(F.col("__long"), F.concat(*(spans_of(text, k) for k in BASE[1:]))).otherwise(empty())
    docs = docs.withColumn("base_spans", F.array_sort(F.concat(spans_of(text, BASE[0]), rest)))
    docs = docs.withColumn("__found", F.when(F.col("__long"), candidates(text, F.col("base_spans"))))
    return docs.withColumn("__tested", F.when(F.size("__found") > 0, battery(sums(digits(F.col("__found")))))).drop("__text", "__long", "__found")


def last_step(docs: DataFrame, text_col: str) -> int | None:
    """The largest step that the control lets through: the family is all candidates of the table, and of those up to the
    step, the part that text would give is ``FALSE_DISCOVERIES`` at most. A row a step, some thousands, reaches the driver."""
    one = tested(docs.select(text_col), text_col).select(F.explode("__tested").alias("t"))
    rows = one.groupBy(F.when(F.col("t.ok"), F.col("t.step")).alias("step")).agg(F.count("*").alias("c"), F.sum("t.n").alias("n")).collect()
    return control({r["step"]: r["c"] for r in rows}, sum(r["n"] for r in rows))


def control(steps: dict[int | None, int], characters: float) -> int | None:
    """Step-up of Benjamini and Hochberg over weighted p-values. steps: candidates at each step, at None those that are not
    random; characters: of all candidates. A candidate's weight is its length over the mean one, so its p-value over
    that weight is 2 ** (step / STEPS) * mean, and the number of candidates times the mean is ``characters``."""
    best, so_far = None, 0
    for step in sorted(x for x in steps if x is not None):
        so_far += steps[step]
        if FALSE_DISCOVERIES * so_far >= characters * 2.0 ** (step / STEPS):
            best = step
    return best


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, k, past), ordered by start, then kind (its number in
    KINDS), in code points of the whole text.

    Spans of the kind ``random`` depend on the whole table, which is the family of the false-discovery control; base spans
    on their text alone. Texts are read twice, first for the control. Null and empty texts have no spans; repeated rows
    are treated alike, and each counts in the family; an empty table gives an empty table. Kinds may overlap one another,
    but for random ones, which stand outside base spans; spans of one kind do not. Runs with less than LEAST_DIGITS
    characters before their padding are not tested. Input columns named as an output column are replaced.
    """
    docs = plain(docs, "base_spans", "spans")
    last = last_step(docs, text_col)
    new = F.filter("__tested", lambda r: r["ok"] & (r["step"] <= F.lit(last)))
    new = F.transform(new, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("k"), r["past"].alias("past")))
    some = F.coalesce(new, empty()) if last is not None else empty()
    return tested(docs, text_col).withColumn("spans", F.array_sort(F.concat("base_spans", some))).drop("__tested")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["past"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``scan`` and ``redacted``: the text with every span replaced by ``mark``, overlapping spans by one. A null text stays
    null, one without spans as it is. Input columns named as an output column are replaced."""
    found = scan(docs, text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))))
        return F.struct(F.greatest(acc["at"], s["past"]).alias("at"), new.alias("out"))

    done = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return plain(found, "redacted").withColumn("redacted", F.when(F.size("spans") > 0, done).otherwise(text))
