import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_in_middle as fim

UNIT = re.compile(fim.UNIT)


def by_hand(doc_id, text, seed=42, rate=50, spm=80, markers=fim.MARKERS):
    """n_units, form, prefix_chars, middle_chars, fim_text of one row, without Spark."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = markers
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(prefix), len(middle), s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle


def rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", *(str(r[c]) for c in fim.OUTPUTS)) for r in df.collect())


def wanted(data, **options):
    return sorted((i is None, i or 0, t or "", *map(str, by_hand(i, t, **options))) for i, t in data)


@pytest.mark.parametrize("options", [{}, {"rate": 100, "spm": 0}, {"rate": 100, "spm": 100, "seed": 7}, {"rate": 0}])
def test_equals_plain_python(spark, edge_rows, options):
    texts = ["a<b <P", "x <S>", "<M>", "<", "<S <P <M end <", "  lead", "trail \n ", "  wide x 𝔘𝔫𝔦 kó", *(" ".join("w" * (j % 7 + 1) for j in range(k)) for k in range(40))]
    data = [(i, t) for i, t, *_ in edge_rows] + [(100 + i, t) for i, t in enumerate(texts)]
    out = fim.transform(spark.createDataFrame(data, "doc_id long, text string"), **options).cache()
    assert rows(out) == wanted(data, **options)
    again = out.select(F.coalesce("text", F.lit("")).alias("t"), fim.restored(F.col("fim_text"), F.col("form")).alias("r"))
    assert again.where("t <> r").count() == 0
    out.unpersist()


def test_other_markers_and_columns_of_the_same_names(spark):
    data = [(i, f"one two three {i} four [S> five") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"form": F.lit(1), "__key_a": F.lit("x"), "n_units": F.lit(None), "more. of it": F.lit(2)})
    markers = ("[PRE]", "[SUF]", "[MID]")
    out = fim.transform(docs, markers=markers)
    assert out.columns == ["doc_id", "text", "more. of it", *fim.OUTPUTS]
    assert rows(out) == wanted(data, markers=markers)
    assert out.select(fim.restored(F.col("fim_text"), F.col("form"), markers).alias("r"), "text").where("r <> text").count() == 0


def test_bad_markers_and_ids(spark, no_docs):
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "<PS>x", "M"), ("<<", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(no_docs, markers=markers)
    with pytest.raises(TypeError):
        fim.transform(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty_table(no_docs):
    out = fim.transform(no_docs)
    assert out.columns == [*no_docs.columns, *fim.OUTPUTS]
    assert out.count() == 0


def test_many_rows_that_are_the_same(spark):
    data = [(None, "all the same words here")] * 3000 + [(7, "all the same words here")] * 50 + [(i, "all the same words here") for i in range(100, 200)]
    assert rows(fim.transform(spark.createDataFrame(data, "doc_id long, text string").repartition(8))) == wanted(data)


def test_units_are_not_shuffled_one_by_one(spark, sf_dir):
    """One exchange of rows that hold a text's lengths; none above the rows of units."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = fim.offsets(docs.select(F.col("doc_id").alias("__key_a"), F.col("doc_id").alias("__key_b"), F.array(F.lit(1)).alias("sizes"), F.lit(1).alias("h1"), F.lit(2).alias("h2")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in plan
