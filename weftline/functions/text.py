"""Text functions on columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

MIN_LENGTH = 3


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a function over elements an expression would be computed for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, f"{lexicon.SPACE}+", " "))


def hash_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: the prefix and twelve hex digits of the sha1 of the parts, joined by colons."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 12))


def document_id(source: Column, text: Column) -> Column:
    return hash_id("doc", source, text)


def chunk_id(doc_id: Column, idx: Column, text: Column) -> Column:
    return hash_id("chunk", doc_id, idx.cast("string"), text)


def is_cjk(token: Column) -> Column:
    return token.rlike(f"[{lexicon.CJK}]")


def tokenize(text: Column) -> Column:
    """Lower-case words of any script, in order; an elided article is split off once; CJK characters stand alone."""
    any_script = F.transform(F.regexp_extract_all(text, F.lit(lexicon.token_pattern(lexicon.LETTER)), F.lit(0)), F.lower)
    ascii_only = F.regexp_extract_all(F.lower(text), F.lit(lexicon.ASCII_TOKEN), F.lit(0))
    found = F.when(F.length(text) == F.octet_length(text), ascii_only).otherwise(any_script)
    elision = lexicon.elision_pattern(lexicon.LETTER)
    split = lambda ts: F.flatten(F.transform(ts, lambda t: F.when(t.rlike(elision), F.array(F.regexp_extract(t, elision, 1), F.regexp_extract(t, elision, 2))).otherwise(F.array(t))))
    articles = F.when(text.rlike(f"[{lexicon.APOSTROPHES}]"), split(found)).otherwise(found)
    return F.coalesce(articles, F.array().cast("array<string>"))


def is_content(token: Column, min_length: int = MIN_LENGTH) -> Column:
    return ~token.isin(*lexicon.STOPWORDS) & ((F.length(token) >= min_length) | is_cjk(token))


def content_tokens(text: Column, min_length: int = MIN_LENGTH) -> Column:
    return F.filter(tokenize(text), lambda t: is_content(t, min_length))


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space, after full-width stops, and at blank lines; each normalised, none empty."""
    ends = rf"(?<=[.!?]){lexicon.SPACE}+|(?<=[。！？]){lexicon.SPACE}*|\n{{2,}}"
    return F.filter(F.transform(F.split(text, ends), normalize), lambda s: s != "")


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by spaces, shorter ones first."""

    def of(t: Column, k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.concat_ws(" ", *(F.get(t, i + j) for j in range(k))))
        return F.when(F.size(t) >= k, runs).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.concat(*(of(t, k) for k in range(low, high + 1))))


def runs_of(sorted_rows: Column, key) -> Column:
    """(from, size) of each run of rows with equal ``key(row)``."""
    new = lambda i: (i == 0) | (key(F.get(sorted_rows, i)) != key(F.get(sorted_rows, i - 1)))
    starts = F.filter(F.when(F.size(sorted_rows) > 0, F.sequence(F.lit(0), F.size(sorted_rows) - 1)).otherwise(F.array().cast("array<int>")), new)
    return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(i.alias("from"), (F.coalesce(F.get(at, k + 1), F.size(sorted_rows)) - i).alias("size"))))


def counted(values: Column) -> Column:
    """(value, n) of each different value of an array, without a shuffle."""
    return let(F.sort_array(values), lambda s: F.transform(runs_of(s, lambda x: x), lambda r: F.struct(F.get(s, r["from"]).alias("value"), r["size"].alias("n"))))


def relation_type(tokens: Column) -> Column:
    """Type of the first relation verb among the tokens, or ``co_occurs``."""
    verbs = F.create_map(*(F.lit(x) for pair in lexicon.VERBS.items() for x in pair))
    known = F.filter(tokens, lambda t: t.isin(*lexicon.VERBS))
    return let(F.get(known, F.lit(0)), lambda verb: F.coalesce(F.try_element_at(verbs, verb), F.lit(lexicon.UNTYPED)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector's norm counts as one, so its cosines are zero."""
    safe = lambda v: F.when(norm(v) > 0, norm(v)).otherwise(F.lit(1.0))
    return dot(a, b) / (safe(a) * safe(b))
