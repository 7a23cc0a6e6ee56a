import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ranked_search as rs

TERM = re.compile(rs.TERM)
AZ = str.maketrans(rs.UPPER_AZ, rs.LOWER_AZ)


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def by_hand(docs, items, k=50):
    """All (item_id, rank, doc_id, score), without Spark."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in bags:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t]), doc))
        best = sorted(((s, d) for s, d in scored if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(str(item), r + 1, str(d), s) for r, (s, d) in enumerate(best)]
    return sorted(out)


def rows(df):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


@pytest.mark.parametrize("most_bytes", [rs.MOST_BYTES, 0])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_edges_by_both_ways(spark, edge_rows, most_bytes, k):
    docs = [(i, t) for i, t, *_ in edge_rows] + [(100 + i, f"alpha beta {'gamma ' * (i % 5)}Ω{i % 3} x-ray's") for i in range(300)] + [(7000, "beta")] * 5
    items = [(1, "Alpha, GAMMA gamma"), (2, None), (3, "nowhere"), (None, "ω0 Ω1 rho"), (4, ""), (1, "x s"), (5, "beta BETA ß 日本"), (5, "beta BETA ß 日本")]
    found = rs.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string"), k, most_bytes=most_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == by_hand(docs, items, k)


def test_blocks_of_any_size(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 7)
    row = np.array([0, 0, 1, 2, 2, 2])
    whole = rs.accumulated(row, np.array([0, 1, 1, 0, 1, 2]), np.arange(1, 7), np.array([0, 2, 3]), np.array([2, 1, 0]), np.array([4, 9, 4]), 3)
    assert [x.tolist() for x in whole] == [[4, 4, 4, 9, 9], [0, 1, 2, 0, 2], [3, 3, 9, 1, 4]]
    assert rows(rs.search(docs, items, 7)) == want
    assert rows(rs.search(docs, items, 7, most_bytes=0)) == want


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 50, 10_000)
    assert (rs.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(rs.radix_order(np.zeros(0, np.int64))) == 0


def test_best_keeps_ties_by_id_whatever_the_order():
    rng = np.random.default_rng(2)
    for k in (1, 4):
        best, data = rs.Best(3, k), []
        best.room = 20
        for _ in range(60):
            item, score, doc, null = rng.integers(0, 3, 15), rng.integers(0, 6, 15), rng.integers(0, 1000, 15), rng.integers(0, 9, 15) == 0
            best.add(item, score, doc, null)
            data += list(zip(item.tolist(), (-score).tolist(), null.tolist(), doc.tolist()))
        want = sorted(x for i in range(3) for x in sorted(y for y in data if y[0] == i and y[1] < 0)[:k])
        item, score, doc, null = best.rows()
        assert sorted(zip(item.tolist(), (-score).tolist(), null.tolist(), doc.tolist())) == want


def test_terms_whose_hashes_are_equal_are_told_apart():
    known = rs.Vocabulary(["one", "two"])
    known.hashes = np.sort(np.append(known.hashes, rs.words(rs.pa.array(["three"]), rs.NOT_ALNUM, rs.LOWER).hashes()))
    n, doc, term, tf = known.counted(rs.pa.array(["Three two TWO", None, "one three"]))
    assert (n.tolist(), doc.tolist(), term.tolist(), tf.tolist()) == ([3, 0, 2], [0, 2], [1, 0], [2, 1])


def test_empty_tables_names_and_ids(spark, no_docs, sf_dir):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, score int")
    items = spark.createDataFrame([("q", "B", 1)], "item_id string, text string, rank int")
    for most in (rs.MOST_BYTES, 0):
        assert rs.search(no_docs, items, most_bytes=most).count() == 0
        assert rs.search(docs, items.limit(0), most_bytes=most).count() == 0
        assert rows(rs.search(docs, items, most_bytes=most)) == by_hand([(1, "a b")], [("q", "B")])
    with pytest.raises(TypeError):
        rs.search(docs.select(F.col("doc_id").cast("string"), "text"), items)
    with pytest.raises(ValueError):
        rs.search(docs, items, 0)


def test_a_third_of_all_rows_alike(spark):
    docs = [(i, "the same words in each") for i in range(2000)] + [(5000 + i, f"others {i} words") for i in range(1000)]
    items = [(i, f"same words {i}") for i in range(20)]
    assert rows(rs.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id int, text string"))) == by_hand(docs, items)
