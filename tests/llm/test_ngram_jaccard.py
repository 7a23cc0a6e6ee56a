import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import ngram_jaccard, queries

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    """rows: (id, text). Links by an inverted index over all pairs, then classes."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    seen = {}
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in seen.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            seen[x].append(i)
        for j, both in near.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.components(docs, shingle=4, percent=85).collect()]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


@pytest.mark.parametrize("small_leaders", [False, True])
def test_query_against_brute_force(spark, sf_dir, small_leaders, monkeypatch):
    if small_leaders:  # then neighbours are hardly linked, and the pairs across classes have to find the links
        monkeypatch.setattr(ngram_jaccard, "LEADERS", 2)
        monkeypatch.setattr(ngram_jaccard, "ROUNDS", 2)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = {tuple(r) for r in queries.op1_ngram_jaccard(spark, sf_dir).collect()}
    assert got == set(brute(rows))
    assert len({c for _, _, c in got}) < len(rows)


def test_near_copies_of_one_text(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(100000)}"
        if rng.random() < 0.2:
            del w[rng.randrange(len(w))]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(rng.randrange(1, 40))) + " " + " ".join(base[: rng.randrange(150)])) for i in range(200)]
    check(spark, rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    check(spark, [(r[0], r[1]) for r in edge_rows])
    check(spark, [(3, "A b"), (2, "a B"), (5, "a b c"), (1, "x"), (9, None), (8, ""), (7, "a b c d"), (6, "A  B\nC d"), (None, "n m"), (None, "N M"), (4, "a b")])
    clash = edge_docs.withColumns({"N_shingles": F.lit("mine"), "h1": F.lit(1), "key": F.lit(2), "node": F.lit(3), "label": F.lit(4)})
    out = ngram_jaccard.components(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "h1", "key", "node", "label", "n_shingles", "component_id"]
    assert out.count() == len(edge_rows) and ngram_jaccard.components(no_docs).collect() == []


def test_prefix_bound():
    import numpy as np

    n = np.arange(1, 500)
    assert all(100 * k >= 85 * int(m) > 100 * (k - 1) for k, m in zip(ngram_jaccard.needed(n, 85).tolist(), n))
    assert ngram_jaccard.shingle_sets(pa.array(["a b", "", "a b c d e", "A b c d"]), 4)[0].tolist() == [1, 0, 2, 1]


@pytest.mark.parametrize("contracted", [2, 500_000])
def test_classes(spark, contracted, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CONTRACTED", contracted)
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 1), *[(100 + i, 101 + i) for i in range(60)], *[(1000, 1001 + i) for i in range(500)]]
    rng = random.Random(4)
    web = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(260)]
    pairs += web
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r["node"]: r["label"] for r in ngram_jaccard.classes(edges).collect()}
    least = {x: x for p in pairs for x in p}
    for _ in least:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    alone = {x for x in least if not any(x in p and p[0] != p[1] for p in pairs)}
    assert {k: v for k, v in got.items()} == {k: v for k, v in least.items() if k not in alone}
    assert ngram_jaccard.classes(edges.limit(0)).count() == 0


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        ngram_jaccard.components(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_one_of_each_class_stays(spark, edge_docs):
    kept = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in ngram_jaccard.keep_one(edge_docs, shingle=4, percent=85).collect()))
    brief = [(d, t[:5]) for some, d, t in kept]
    assert len(kept) == 8 and brief.count((0, "")) == 1
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (3, "A b c d e f"), (4, None), (None, "x y"), (None, "x y"), (5, "")]
    kept = [r["text"] for r in ngram_jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, kept)) == ["", "None", "a b c d e f", "x y"]
