"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a sample, and rules run in
order of rejection per cost. DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain, some_rows

WINDOW, SAMPLE_ROWS = 5, 2000
WHITE = "\t\n\x0b\x0c\r "
SYMBOLS, UPPER, EXCLAMATION = "[#*$%&|<>]", "[A-Z]", "!"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def none(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(none(text), "[ \\t-\\r]+"), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    """Characters that match; dear only where there are many."""
    return F.regexp_count(none(text), F.lit(pattern)).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(none(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def n_dup_lines(found: Column) -> Column:
    return (F.size(found) - F.size(F.array_distinct(found))).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each run of WINDOW words, of the words' own hashes."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), _window_hashes)


def _window_hashes(each: Column) -> Column:
    count = F.size(each) - F.lit(WINDOW)
    runs = F.transform(F.arrays_zip(*[F.slice(each, k + 1, F.greatest(count + 1, F.lit(0))).alias(f"h{k}") for k in range(WINDOW)]), lambda x: F.xxhash64(*[x[f"h{k}"] for k in range(WINDOW)]))
    return F.when(count >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(hashes: Column) -> Column:
    """Words within windows found twice or more, from the windows' hashes.

    Only a text with an equal pair sorts (hash, place); places with an equal neighbour, in order, each cover WINDOW
    words or as many as there are up to the next such place.
    """
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_placed(h), _covered))).cast("long")


def _placed(hashes: Column) -> Column:
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(placed: Column) -> Column:
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), placed)
    after = F.concat(F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    near = F.arrays_zip(placed.alias("x"), before.alias("b"), after.alias("a"))
    twice = F.filter(near, lambda t: t["x"]["h"].isNotNull() & (t["x"]["h"].eqNullSafe(t["b"]["h"]) | t["x"]["h"].eqNullSafe(t["a"]["h"])))
    places = F.array_sort(F.transform(twice, lambda t: t["x"]["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")), lambda acc: acc["sum"])


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, of each text as a whole. A null text
    counts as empty and has none of anything; repeated rows are treated alike; an empty table gives an empty table; input
    columns named as an output column are replaced."""
    text, words = F.col(text_col), F.col("__words")
    docs = plain(docs, *FIGURES).withColumns({"__words": word_list(text), "__lines": lines(text)})
    docs = docs.withColumn("__hashes", window_hashes(words))
    out = {"n_words": F.size(words).cast("long"), "word_chars": word_chars(words), "n_symbols": count_of(text, SYMBOLS), "n_dup_lines": n_dup_lines(F.col("__lines")), "n_repeat_words": n_repeat_words(F.col("__hashes"))}
    return docs.withColumns(out).drop("__words", "__lines", "__hashes")


@dataclass(frozen=True)
class Facts:
    """What rules judge by: columns of the text and its words, computed where a rule asks, or figures that are there."""

    text: Column
    words: Column
    known: dict[str, Column]

    def __getitem__(self, name: str) -> Column:
        own = {
            "n_words": lambda: F.size(self.words),
            "word_chars": lambda: word_chars(self.words),
            "n_symbols": lambda: count_of(self.text, SYMBOLS),
            "n_upper": lambda: count_of(self.text, UPPER),
            "n_exclamations": lambda: count_of(self.text, EXCLAMATION),
            "n_repeat_words": lambda: n_repeat_words(window_hashes(self.words)),
        }
        return self.known[name] if name in self.known else own[name]()


@dataclass(frozen=True)
class Rule:
    """``rejects``: from the facts of a text, a boolean column without nulls."""

    name: str
    rejects: Callable[[Facts], Column]


def base_fails(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


#: Base rules first, in the order in which they stand if nothing is known about them.
RULES = (
    Rule("few_words", lambda f: f["n_words"] < 10),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 6 * f["word_chars"]),
    Rule("shouting", lambda f: 100 * f["n_upper"] > 40 * f["word_chars"]),
    Rule("exclamations", lambda f: 100 * f["n_exclamations"] > 6 * f["word_chars"]),
    Rule("repeated_lines", lambda f: let(lines(f.text), lambda x: 100 * n_dup_lines(x) > 40 * F.size(x))),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 30 * f["n_words"])),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, text_col: str = "text", known: bool = False) -> list[tuple[Rule, float, float]]:
    """Each rule's seconds a row and rejected part on about ``sample_rows`` rows, twice as many at most, drawn at random
    from all of the table. It only sets the order; every rule judges every row that earlier rules left. ``known``: rules
    are to run where FIGURES stand ready, and their cost is measured so."""
    text = F.col(text_col)
    sample = some_rows(docs.select(text_col), sample_rows, docs.count())
    sample = (figures(sample, text_col) if known else sample.withColumn("__words", word_list(text))).persist()
    try:
        rows = max(1, sample.count())
        facts = known_facts(text_col) if known else Facts(text, F.col("__words"), {})
        empty = min(_seconds(sample, F.lit(False))[0] for _ in range(2))
        out = []
        for rule in rules:
            took, rejected = min(_seconds(sample, rule.rejects(facts)) for _ in range(2))
            out.append((rule, max(took - empty, 1e-4) / rows, rejected / rows))
        return out
    finally:
        sample.unpersist()


def known_facts(text_col: str = "text") -> Facts:
    """Facts of rows that have FIGURES already; only what is not among them is computed from the text."""
    return Facts(F.col(text_col), F.array().cast("array<string>"), {c: F.col(c) for c in FIGURES})


def _seconds(sample: DataFrame, condition: Column) -> tuple[float, int]:
    began = time.perf_counter()
    found = sample.select(F.count_if(condition)).first()[0]
    return time.perf_counter() - began, found


def ordered(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By falling rejection per cost."""
    return [rule for rule, _, _ in sorted(measured, key=lambda x: -x[2] / x[1])]


def passes(rules: list[Rule], facts: Facts) -> Column:
    """True where no rule rejects. The first that does ends the row's evaluation, so dear rules see few rows."""
    if not rules:
        return F.lit(True)
    chain = F.when(rules[0].rejects(facts), False)
    for rule in rules[1:]:
        chain = chain.when(rule.rejects(facts), False)
    return chain.otherwise(True)


def with_verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept``: false where any of ``rules`` rejects the text.

    Verdicts do not depend on the order that the sample suggests. Null and empty texts have no words and are judged as
    such (``few_words`` rejects them). Repeated rows are judged alike; an empty table gives an empty table. Each text is
    judged as a whole. An input column named ``kept`` is replaced.
    """
    docs = plain(docs, "kept")
    order = ordered(measure(docs, rules, sample_rows, text_col))
    worded = docs.withColumn("__words", word_list(F.col(text_col)))
    return worded.withColumn("kept", passes(order, Facts(F.col(text_col), F.col("__words"), {}))).drop("__words")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES[2:], sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """``docs`` with FIGURES, ``base_failed`` (the two base rules) and ``kept``: false where a base rule or any of ``rules``
    rejects the text.

    The figures are part of the result for every row, so the cascade has only the rest to save: base rules come first, as
    they cost nothing any more, and ``rules`` follow in the order of rejection per cost, both measured with the figures at
    hand. Nulls, empties, repeats and empty tables as in ``with_verdict``; input columns named as an output column are
    replaced.
    """
    docs = plain(docs, *FIGURES, "base_failed", "kept")
    order = ordered(measure(docs, rules, sample_rows, text_col, known=True))
    out = figures(docs, text_col).withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(passes(order, known_facts(text_col))))
