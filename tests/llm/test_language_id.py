import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_id, queries


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = queries.op2_language_id(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, f"the lamp {i}", "en", "s") for i in range(40)] + [(100 + i, f"die lampe {i}", "de", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs.where("doc_id < 100"))
    assert model.langs == ["en"]
    out = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert out[100]["lang_pred"] == "en" and out[0]["score"] == 1.0


def test_edges(spark, edge_docs, no_docs):
    model = language_id.fit(edge_docs)
    out = language_id.identify(edge_docs.withColumns({"Score": F.lit("mine"), "g": F.lit(1)}), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "g", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == edge_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in model.langs for r in got if r["doc_id"] in (4, 5, 6, 7, 8))
    assert language_id.identify(no_docs, model).count() == 0
    empty = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, empty).collect()} == {"und"}


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    masks = np.zeros(1 << 12, np.uint8)
    known = rng.integers(0, 1 << 32, 300, np.uint64).astype(np.uint32)
    for at in language_id.cells(known, len(masks)):
        masks[at] |= 1
    masks[rng.random(len(masks)) < 0.5] |= 2  # a crowded slice
    model = language_id.Model(["a", "b"], masks[None])
    assert abs(model.false_positive()[1] - 0.25) < 0.05
    texts = pa.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 4000))])
    g, _ = language_id.grams(texts)
    assert abs(model.bit(model.found(g), 1).mean() - model.false_positive()[1]) < 0.05


def brute(rows, texts):
    """Languages of texts by n-gram sets instead of filters, all rows learnt from: what the filters come near to."""
    fold = lambda t: bytes(language_id.FOLD[b] for b in t.encode())
    grams = lambda t: [x[i : i + 4] for x in [fold(t)] for i in range(len(x) - 3) if x[i : i + 2] != b"  "]
    count = {}
    for t, lang in rows:
        count.setdefault(lang, Counter()).update(grams(t))
    total = {x: sum(n.values()) for x, n in count.items()}
    known = {x: {g for g, n in c.items() if n >= language_id.LEAST and n / total[x] >= language_id.SHARE * sum(count[y][g] / total[y] for y in count)} for x, c in count.items()}
    order = sorted(count, key=lambda x: (-sum(y == x for _, y in rows), x))
    out = []
    for t in texts:
        hits = {x: sum(g in known[x] for g in grams(t)) for x in order}
        best = max(order, key=lambda x: (hits[x], -order.index(x)))
        out.append((best, hits[best] / max(1, sum(hits.values()))))
    return out


def test_filters_come_near_to_sets_with_many_languages(spark):
    """70 languages, which take two slices of masks."""
    rng = random.Random(2)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(30)] for k in range(70)}
    rows = [(" ".join(rng.choices(w, k=40)), lang) for lang, w in words.items() for _ in range(4 + int(lang[1:]) % 3)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == 70 and model.masks.shape[0] == 2
    asked = [" ".join(rng.choices(w, k=15)) for w in words.values()]
    got = model.predict(pa.array(asked))
    want = brute(rows, asked)
    assert got[0] == [w[0] for w in want] == sorted(words)
    assert all(abs(a - b[1]) < 0.02 for a, b in zip(got[1], want))


def test_a_thousand_labels(spark, monkeypatch):
    """A model's size goes with the n-grams of one language and the number of labels, not with their product."""
    rng = random.Random(4)
    words = {f"l{k:04}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(1000)}
    rows = [(" ".join(rng.choices(w, k=60)), lang) for lang, w in words.items() for _ in range(2)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == 1000 and model.masks.shape == (16, 1 << 16)
    asked = [" ".join(rng.choices(w, k=20)) for w in words.values()]
    monkeypatch.setattr(language_id, "SUMS", 10_000)  # ten texts at a time
    monkeypatch.setattr(language_id, "AT_ONCE", 64)
    got = model.predict(pa.array([*asked, None, ""]))
    assert got[0] == [*words, "und", "und"] and got[1][-2:] == [0, 0] and min(got[1][:-2]) > 0.5
    monkeypatch.setattr(language_id, "MOST_CELLS", 1 << 19)
    with pytest.raises(ValueError, match="cells"):
        language_id.fit(docs)


def test_the_sample_is_bounded(spark, monkeypatch):
    """Null ids, or one text in all rows, weigh no more than others."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("word "), F.col("id"))).otherwise("alas").alias("text"), F.lit("en").alias("lang"))
    model = language_id.fit(docs, sample_rows=200)
    assert model.langs == ["en"] and model.masks.shape[1] == 1 << 16  # 10,000 words would need more cells
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(docs.select("text", F.col("text").alias("lang")))


def test_grams_stay_within_texts():
    g, doc = language_id.grams(pa.array(["abcd", "ef", None, "Wxyz!"]))
    assert [int(x).to_bytes(4, "big") for x in g] == [b"abcd", b"wxyz", b"xyz "] and doc.tolist() == [0, 3, 3]
