import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import queries, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


WHOLE, PIECES = Tokenizer.from_file(PATH), token_output.PieceEncoder(PATH)


@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=1500))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    data, start = token_output.encode_blocks(ids)
    assert token_output.decode_blocks(np.frombuffer(data, np.uint8), start)[: len(ids)].tolist() == values


def test_outliers_are_exceptions():
    ids = np.tile(np.arange(16, dtype=np.uint32), 64)
    ids[[3, 700]] = 40_000
    data, start = token_output.encode_blocks(ids)
    assert len(data) < 4 * (7 + 4 * 32) + 2 * 6 + 1 and len(start) == 4
    assert (token_output.decode_blocks(np.frombuffer(data, np.uint8), start) == ids).all()


def test_file_rejects_other_bytes():
    with pytest.raises(ValueError):
        list(token_output.read_file(io.BytesIO(b"nonsense" * 10), 80))


@pytest.mark.parametrize("file_ids", [1, 700, 1 << 20])
def test_files_are_rolled(spark, edge_docs, edge_rows, file_ids, monkeypatch):
    monkeypatch.setattr(token_output, "READ_IDS", 500)
    folder = token_output.new_path(spark, "rolled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    manifest = token_output.write_tokens(edge_docs.where("doc_id is not null").coalesce(1), PATH, folder, file_ids=file_ids)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(tuple(r) for r in token_output.read_tokens(manifest, folder, False).collect())
    assert got == sorted(expected(sorted((r[0], r[1] or "") for r in edge_rows if r[0] is not None)))
    assert (manifest.count() > 1) == (file_ids < 1000) and manifest.agg({"n_docs": "sum"}).first()[0] == len(got)


def test_a_tokenizer_of_another_kind_encodes_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Mixed CASE  words,\nand lines", "", None, "ÄÖ e\u0301 <|endoftext|>"]
    out = token_output.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    whole = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["ids"] for r in out} == {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert PIECES.piecewise and not token_output.PieceEncoder(path).piecewise
    with pytest.raises(TypeError, match="doc_id"):
        token_output.round_trip(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)


@given(st.lists(st.lists(st.sampled_from([*"ab'sT tre\n\tHÉe1!.,%<|endoftx> ß漢—", "\x01", "\u0301", "\u0331", "<|endoftext|>", "AB.,", "'ll"]), max_size=12).map("".join), max_size=8))
@settings(deadline=None, max_examples=300)
def test_pieces_equal_whole_texts(texts):
    whole = [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]
    counts, ids = PIECES.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == whole if texts else not len(ids)


def expected(rows):
    out, before = [], 0
    for i, text in rows:
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_query_against_whole_encoding(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    assert sorted(tuple(r) for r in queries.op10_token_output(spark, sf_dir).collect()) == expected(rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = token_output.round_trip(edge_docs, PATH).collect()
    want = expected(sorted(((r[0], r[1]) for r in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, n, c) for i, _, n, c in want)
    assert sorted(r["start"] for r in got)[0] == 0 and sum(r["n_tokens"] for r in got) == sum(w[2] for w in want)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 1 for r in got)
    assert token_output.round_trip(no_docs, PATH).collect() == []
