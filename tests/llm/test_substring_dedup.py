import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, substring_dedup


def sentence_lists(texts):
    """Each text's pieces as (words, number of the sentence), by the rules of bounds in plain Python; only the hashes of word
    pairs are the operator's."""
    out = []
    for text in texts:
        raw = text.encode()
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
        low = [m[0].translate(bytes(substring_dedup.LOWER)) for m in found]
        if not found:
            out.append([])
            continue
        stop = [bool(re.search(rb"[.!?][\"')\]]?$", w)) or (i + 1 < len(found) and b"\n" in raw[found[i].end() : found[i + 1].start()]) for i, w in enumerate(low)]
        ends = [i for i, s in enumerate(stop) if s and not any(stop[max(0, i - substring_dedup.CLOSE) : i])]
        if not ends or ends[-1] != len(low) - 1:
            ends.append(len(low) - 1)
        h = [int(x) for x in substring_dedup.words(pa.array([text])).hashes()]
        pair = [int(substring_dedup.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        smallest = set()
        for i in range(len(pair) - substring_dedup.SPLIT + 1):
            smallest.add(max((k for k in range(i, i + substring_dedup.SPLIT) if pair[k] == min(pair[i : i + substring_dedup.SPLIT]))))
        own, start = [], 0
        for number, e in enumerate(ends):
            near = lambda k, a=start, b=e: k + 1 - a <= substring_dedup.NEAR and b - k <= substring_dedup.NEAR
            for c in (*(k for k in range(start, e) if k in smallest and not near(k)), e):
                own.append((tuple(low[start : c + 1]), number))
                start = c + 1
        out.append(own)
    return out


def brute(rows):
    found, own, numbers = defaultdict(list), {}, {}
    for (i, t), pieces in zip(rows, sentence_lists([t or "" for _, t in rows])):
        sents = own[i] = [p for p, _ in pieces]
        numbers[i] = [n for _, n in pieces]
        for j in range(len(sents)):
            k = next((k for k in range(substring_dedup.RUN, len(sents) - j + 1) if sum(map(len, sents[j : j + k])) >= substring_dedup.LEAST_WORDS), 0)
            if not k and j == 0 and sum(map(len, sents)) >= substring_dedup.LEAST_WORDS:
                k = len(sents)
            if k:
                found[tuple(sents[j : j + k])].append((i, j))
    gone = defaultdict(set)
    for run, places in found.items():
        for i, j in sorted(places)[1:]:
            gone[i] |= set(range(j, j + len(run)))
    return {i: (len({numbers[i][j] for j in gone[i]}), sum(len(s[j]) for j in gone[i]), b" ".join(b" ".join(x) for j, x in enumerate(s) if j not in gone[i])) for i, s in own.items()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = brute(rows)
    got = queries.op8_substring_dedup(spark, sf_dir).collect()
    low = lambda t: b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes(substring_dedup.LOWER))))
    assert {r["doc_id"]: (r["n_sentences_removed"], r["n_words_removed"], low(r["text"])) for r in got} == want
    assert sum(n > 0 for n, _, _ in want.values()) > 0.02 * len(rows)


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    bare = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for p in range(60):
        passage = (prose if p % 2 else bare)(70)
        passages.append(passage.split())
        rows += [(3 * p + k, f"{prose(40)} {passage} {prose(40)}") for k in range(3)]
    out = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for p in range(60):
        assert out[3 * p]["n_words_removed"] == 0
        for k in (1, 2):
            assert 20 <= out[3 * p + k]["n_words_removed"] <= 70
            assert len(set(out[3 * p + k]["clean_text"].split()) & set(passages[p])) < 55


def test_every_passage_of_51_words_without_stops_is_found(spark):
    rows, n = [], 600
    for seed in range(n):
        rng = random.Random(seed)
        bare = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
        passage = bare(51)
        rows += [(2 * seed + k, f"{bare(30)} {passage} {bare(30)}") for k in range(2)]
    out = {r["doc_id"]: r["n_words_removed"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2 * i] == 0 for i in range(n))
    assert all(substring_dedup.LEAST_WORDS <= out[2 * i + 1] <= 51 for i in range(n))


@pytest.mark.parametrize("low,high", [(12, 16), (14, 16), (8, 16), (12, 20), (3, 9), (1, 4), (51, 51), (30, 30)])
@pytest.mark.parametrize("words", [51, 60, 80])
def test_passages_are_found_whatever_stands_at_their_ends(low, high, words):
    """Passages with sentences of some lengths, alone in one text or glued at both ends; each pair shares a run."""
    for seed in range(400):
        rng = random.Random(seed)
        bare = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
        parts, left = [], words
        while left:
            n = min(left, rng.randint(low, high))
            parts.append(bare(n) + rng.choice([".", "!", "?", '."']))
            left -= n
        passage = " ".join(parts)
        alone, glued = passage, f"{bare(25)} {passage[:-1]} {bare(25)}"
        stopped = f"{bare(9)}. {passage} {bare(9)}."
        lined = f"{bare(9)}\n{passage}\n{bare(9)}"
        keys = [set(substring_dedup.runs(pa.array([t]))[0].tolist()) for t in (alone, glued, stopped, lined)]
        assert all(a & b for i, a in enumerate(keys) for b in keys[i + 1 :]), seed


def test_glued_passages_lose_most_of_their_words(spark):
    rows, n = [], 300
    for seed in range(n):
        rng = random.Random(seed)
        bare = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
        passage = " ".join(f"{bare(rng.randint(12, 16))}." for _ in range(4)).split()[:51]
        rows += [(2 * seed, " ".join(passage)), (2 * seed + 1, f"{bare(30)} {' '.join(passage)} {bare(30)}")]
    out = {r["doc_id"]: r["n_words_removed"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = [out[2 * i + 1] for i in range(n)]
    assert all(out[2 * i] == 0 for i in range(n)) and min(removed) >= substring_dedup.LEAST_WORDS and max(removed) <= 51
    assert sum(removed) / n > 40


def test_edges(spark, edge_docs, no_docs):
    out = substring_dedup.dedup(edge_docs.withColumns({"Clean_text": F.lit(1), "id": F.lit(2), "text_hash": F.lit(3), "key": F.lit(4), "at": F.lit(5)})).collect()
    assert len(out) == edge_docs.count()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert [r["n_sentences_removed"] > 0 for r in by[5]] == [False, False] and by[5][0]["clean_text"] == by[5][0]["text"]
    assert by[6][0]["clean_text"] == "" and by[1][0]["clean_text"] is None and by[2][0]["clean_text"] == ""
    assert sorted(r["clean_text"] or "" for r in by[None]) == ["", ""]  # null ids come last
    same = "One two three four five. Six seven eight nine. Ten eleven twelve thirteen. "
    alone = substring_dedup.dedup(spark.createDataFrame([(None, f"{same}first"), (None, f"{same}second"), (None, f"{same}second")], "doc_id long, text string")).collect()
    kept = {r["clean_text"] for r in alone if r["n_sentences_removed"] == 0}
    assert len(kept) == 1 and {r["clean_text"] for r in alone if r["n_sentences_removed"]} in ({"first"}, {"second"})
    with pytest.raises(TypeError, match="doc_id"):
        substring_dedup.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert substring_dedup.dedup(no_docs).collect() == []
    twice = "One two three four five. Six seven eight nine. Ten eleven twelve thirteen. "
    only = substring_dedup.dedup(spark.createDataFrame([(1, twice + twice + "end")], "doc_id long, text string")).collect()[0]
    assert only["clean_text"] == twice + "end" and only["n_sentences_removed"] == 3
