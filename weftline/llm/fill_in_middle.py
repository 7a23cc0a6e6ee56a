"""Fill-in-the-middle texts by relational units: the units of a text are rows, a window adds up their lengths, cut requests
join them by ordinal, and what comes out is two offsets a document, by which its text is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, plain, quote, whole_ids

#: A unit: a word with the white space before it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80
PLAIN_FORM, PSM_FORM, SPM_FORM = "plain", "psm", "spm"
OUTPUTS = ("n_units", "form", "prefix_chars", "middle_chars", "fim_text")
KEY = ["__key_a", "__key_b"]


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the id: the first 8-digit groups of the sha256 of ``seed:id``. A null id counts as the
    empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, third: Column, fourth: Column, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> Column:
    marked = F.contains(text, F.lit(markers[0])) | F.contains(text, F.lit(markers[1])) | F.contains(text, F.lit(markers[2]))
    stays = (text == "") | marked | (third % 100 >= rate)
    return F.when(stays, PLAIN_FORM).when(fourth % 100 < spm, SPM_FORM).otherwise(PSM_FORM)


def offsets(asked: DataFrame) -> DataFrame:
    """(*KEY, n_units, prefix_chars, middle_chars) of asked(*KEY, sizes, h1, h2), where sizes are the lengths of a text's units.

    Rows with equal keys have equal texts and count once. A text's sizes move as one row and become rows where they arrive,
    so the window over them needs no second shuffle. Its unit 0 has no length and stands for the beginning of the text:
    unit k ends where a cut after k units lies. Both cuts of a text join its units by ordinal.
    """
    once = asked.groupBy(*KEY).agg(F.first("sizes").alias("sizes"))
    unit = once.select(*KEY, F.posexplode(F.concat(F.array(F.lit(0)), F.col("sizes"))).alias("unit", "size"))
    ends = unit.select(*KEY, "unit", F.sum("size").over(Window.partitionBy(*KEY).orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    n = F.size("sizes").cast("long")
    cuts = F.sort_array(F.array(F.col("h1") % (n + 1), F.col("h2") % (n + 1)))
    requests = asked.select(*KEY, n.alias("n"), cuts.alias("c")).groupBy(*KEY).agg(F.first("n").alias("n_units"), F.first(F.col("c")[0]).alias("first"), F.first(F.col("c")[1]).alias("second"))
    # Both sides lie by key already; an ordinal among the keys of the join would deal all units out anew. Merged, since how
    # many units there are cannot be told from the size of their table.
    met = ends.hint("merge").join(requests, KEY).where(F.col("unit").isin(F.col("first"), F.col("second")))
    found = met.groupBy(*KEY).agg(F.first("n_units").alias("n_units"), F.min("end").alias("prefix_chars"), F.max("end").alias("to"))
    return found.select(*KEY, "n_units", "prefix_chars", (F.col("to") - F.col("prefix_chars")).alias("middle_chars"))


def arranged(text: Column, form: Column, prefix_chars: Column, middle_chars: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text in its form; lengths are code points."""
    p, s, m = (F.lit(x) for x in markers)
    prefix, middle = F.substring(text, F.lit(1), prefix_chars.cast("int")), F.substring(text, (prefix_chars + 1).cast("int"), middle_chars.cast("int"))
    suffix = F.substring(text, (prefix_chars + middle_chars + 1).cast("int"), F.length(text))
    return F.when(form == PLAIN_FORM, text).when(form == PSM_FORM, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))


def restored(fim_text: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from what ``transform`` made of it and its form alone. A text with markers of its own is plain, and a
    marker's first character is none of its others, so each marker is found where it was put."""
    parts = F.split(fim_text, "|".join(r"\Q" + x + r"\E" for x in markers), 4)
    whole = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == PLAIN_FORM, fim_text).when(form == PSM_FORM, whole(1, 3, 2)).otherwise(whole(2, 3, 1))


def check_markers(markers: tuple[str, str, str]) -> None:
    if len(set(markers)) != 3 or any(not x or x[0] in x[1:] or y.startswith(x) and x != y or y[0] != x[0] for x in markers for y in markers):
        raise ValueError("markers are three different texts, none the beginning of another, all with one first character that comes nowhere else in them")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` (code points, null if plain) and ``fim_text``.

    Of 100 texts about ``rate`` are rearranged, about ``spm`` of 100 of these as suffix, prefix, middle and the others as
    prefix, suffix, middle; the draws come from the id and ``seed`` alone. Cuts lie between units, so a part can be empty. A text that
    is empty or holds a marker is plain. Plain texts never move; of the others, lengths of units are shuffled and, once,
    the texts themselves to meet their offsets.

    A null text counts as empty and a null id as the empty string. Repeated rows are treated alike. An empty table gives an
    empty table. Ids are whole numbers (TypeError otherwise). Input columns named as an output column are replaced.
    """
    whole_ids(docs, id_col)
    check_markers(markers)
    docs = plain(docs, *OUTPUTS, *KEY)
    text, id_ = F.coalesce(F.col(quote(text_col)), F.lit("")), F.col(quote(id_col))
    h1, h2, h3, h4 = draws(id_, seed)
    form = form_of(text, h3, h4, rate, spm, markers)
    none = F.lit(None).cast("long")
    stays = docs.where(form == PLAIN_FORM).withColumns({"n_units": F.regexp_count(text, F.lit(UNIT)).cast("long"), "form": F.lit(PLAIN_FORM), "prefix_chars": none, "middle_chars": none, "fim_text": text})

    keys = {KEY[0]: F.xxhash64(id_, text), KEY[1]: F.xxhash64(F.lit(seed), text, id_)}
    sizes = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.length)
    moved = docs.where(form != PLAIN_FORM)
    asked = cut(moved.select(*(c.alias(k) for k, c in keys.items()), sizes.alias("sizes"), h1.alias("h1"), h2.alias("h2")), "units", "zstd")
    joined = moved.withColumns(keys).join(offsets(asked), KEY)
    made = arranged(text, form, F.col("prefix_chars"), F.col("middle_chars"), markers)
    return stays.unionByName(joined.withColumns({"form": form, "fim_text": made}).select(*map(quote, stays.columns)))
