import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import packing, queries
from weftline.llm.shared import small_batches

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def held(spark, docs, tokenizer, sizes=packing.SIZES, **options):
    """Packs, and asserts all that has to hold whatever was packed; pieces, sizes and steps by sequence."""
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    small_batches(spark)
    pieces, sequences = packing.pack(docs, PATH, sizes, **options)
    got, named = [r.asDict() for r in pieces.collect()], {r["sequence_id"]: r for r in sequences.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        r["ids"] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(r["ids"]) == r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    wanted = defaultdict(list)
    for i, text in data:
        wanted[i].append(ids_of(tokenizer, text))
    assert set(by_doc) == set(wanted)
    for i, texts in wanted.items():
        # Rows that share an id cannot be told apart, but each of their ids is there once, at its place.
        places = sorted((k, x, len(ids)) for ids in texts for k, x in enumerate(ids))
        assert places == sorted((r["start"] + k, x, r["doc_tokens"]) for r in by_doc[i] for k, x in enumerate(r["ids"]))
    assert set(named) == set(by_sequence)
    room = 0
    for s, own in by_sequence.items():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]]
        assert ends[-1] <= named[s]["size"] and named[s]["size"] in sizes
        room += named[s]["size"] - ends[-1]
    assert room < sizes[0]
    return by_sequence, named


def test_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    by_sequence, named = held(spark, docs, tokenizer, step_tokens=8192)
    steps = defaultdict(lambda: defaultdict(int))
    for r in named.values():
        steps[r["step"]][r["size"]] += 1
    assert set(steps) == set(range(len(steps))) and len(steps) > 5
    for size in packing.SIZES:
        n = [steps[s][size] for s in steps]
        assert max(n) - min(n) <= 1
    assert {r["size"] for r in named.values()} <= set(packing.SIZES) and len({r["size"] for r in named.values()}) > 1
    # Gaps are filled from shorter tiers: what opens a window is never shorter than what fills it.
    hosts = [own for s, own in by_sequence.items() if s < packing.FRESH]
    shortest = min(own[0]["doc_tokens"] - own[0]["start"] for own in hosts if own[0]["length"] < packing.SIZES[0])
    assert all(r["doc_tokens"] % packing.SIZES[0] < shortest for own in hosts for r in own[1:])
    whole = sum(r["length"] == r["doc_tokens"] for own in by_sequence.values() for r in own)
    assert whole > 0.5 * docs.count()


def test_all_sizes_where_few_fillers_are_needed(spark, tokenizer):
    lengths = [2040, 1020, 500, 250] * 30 + [20] * 40
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    by_sequence, named = held(spark, docs, tokenizer)
    sizes = [r["size"] for r in named.values()]
    assert [sizes.count(s) for s in packing.SIZES[1:]] == [30, 30, 30] and sizes.count(2048) >= 30


def test_query(spark, sf_dir, tokenizer):
    docs = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op12_packing"](spark, sf_dir).collect()
    for r in got:
        ids = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(docs[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sum(r["length"] for r in got) == sum(map(len, docs.values()))


@pytest.mark.parametrize("sizes", [packing.SIZES, (64, 16, 4), (8,), (3, 2, 1), (1,)])
def test_edges_and_sizes(spark, edge_rows, tokenizer, sizes):
    rows = [(i, t if t is None else t[:3000]) for i, t, *_ in edge_rows] + [(50 + i, "word " * (i % 23)) for i in range(200)]
    held(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer, sizes)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 2047, 2048, 5000])
def test_one_document(spark, tokenizer, n):
    by_sequence, _ = held(spark, spark.createDataFrame([(1, "a " * n)], "doc_id long, text string"), tokenizer)
    assert len(by_sequence) == -(-(n + 1) // 2048)


def test_very_long_text_and_equal_lengths(spark, edge_docs, tokenizer):
    held(spark, edge_docs.select("doc_id", "text"), tokenizer)
    held(spark, spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("five words of a text").alias("text")), tokenizer, (64, 32))


def test_empty_table_and_bad_input(spark, no_docs):
    pieces, sequences = packing.pack(no_docs, PATH)
    assert pieces.count() == sequences.count() == 0
    with pytest.raises(TypeError):
        packing.pack(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)
    with pytest.raises(ValueError):
        packing.pack(no_docs, PATH, (256, 512))


def test_shortest_host():
    assert packing.shortest_host({}, (8, 4)) == 0
    assert packing.shortest_host({7: 3, 1: 2}, (8, 4)) == 8  # three gaps of 1, two ids to fill them
    assert packing.shortest_host({7: 2, 1: 2}, (8, 4)) == 2
    assert packing.shortest_host({3: 1, 1: 1}, (8, 4)) == 2
