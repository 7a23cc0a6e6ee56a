import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, queries, sharding

TEXT_LIMIT = 24


def test_sharding_query_against_brute_force(spark, sf_dir):
    rows = sorted(pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    sizes = [len((r["text"] or "").encode()) + 8 for r in rows]
    total, before, slots, want = sum(sizes), 0, Counter(), {}
    for r, s in zip(rows, sizes):
        shard = min(23, before * 24 // total)
        want[r["doc_id"]] = (s, zlib.crc32((r["text"] or "").encode()), "bytes", shard, slots[shard], None)
        slots[shard] += 1
        before += s
    got = {r[0]: tuple(r[1:]) for r in queries.op4_sharding(spark, sf_dir).collect()}
    assert got == want
    each = Counter()
    for r in want.values():
        each[r[3]] += r[0]
    assert len(each) == 24 and max(each.values()) - min(each.values()) <= 2 * max(sizes)


def test_sharding_edges(spark, edge_docs, no_docs):
    assert sharding.shard(no_docs, 3).collect() == []
    clash = edge_docs.withColumns({"Shard": F.lit("mine"), "slot": F.lit(9), "part": F.lit(1), "before": F.lit(2)})
    out = sharding.shard(clash, 3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "part", "before", "size", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    with pytest.raises(ValueError):
        sharding.shard(no_docs, 0)


def test_shards_are_contiguous(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 50).cast("int")).alias("text"))
    shards = [r["shard"] for r in sharding.shard(docs, 7).orderBy("doc_id").collect()]
    assert shards == sorted(shards) and set(shards) == set(range(7))


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 300) == [Fraction(1500, 8), 75, Fraction(300, 8)]
    assert mixing.water_fill([1, 100], [5, 2], 101) == [3, 98]
    assert mixing.water_fill([0, 0], [5, 2], 0) == [0, 0]
    assert mixing.water_fill([], [], 0) == []
    targets = mixing.water_fill([1, 5, 7, 1000], [5, 2, 1, 5], 1013)
    assert sum(targets) == 1013 and all(t <= 3 * s for t, s in zip(targets, [1, 5, 7, 1000]))


def test_mixing_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()}
    size = {i: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]) for i, r in rows.items()}
    of = Counter()
    for i, r in rows.items():
        of[r["source"]] += size[i]
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(names, mixing.water_fill([of[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], sum(of.values()))))
    got, taken, largest = queries.op5_mixing(spark, sf_dir).collect(), Counter(), Counter()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        source = rows[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[source] and r["target"] == float(targets[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in names)
    assert sorted(got) == sorted(queries.op5_mixing(spark, sf_dir).collect())


def test_mixing_edges(spark, edge_docs, no_docs):
    assert mixing.mix(no_docs).collect() == []
    clash = edge_docs.withColumns({"Size": F.lit("mine"), "key": F.lit(9), "whole": F.lit(9), "target": F.lit(0)})
    rows = mixing.copies(clash).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["copies"] <= 3 for r in rows)
    assert rows[0]["whole"] == 9
    out = mixing.mix(edge_docs)
    assert out.columns == edge_docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.copies(edge_docs).collect())
    no_words = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert mixing.copies(no_words).agg(F.sum("copies")).first()[0] == 0
