import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import lm_scoring, queries

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute(rows):
    """rows: (id, text). Held out, tokens, known, N and the unigram score of each."""
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(t for i, x in rows if not held[i] for t in (*tokens(x), None))
    n, v = sum(count.values()), len(count)
    out = []
    for i, x in rows:
        own = (*tokens(x), None)
        out.append((i, held[i], len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    got = [tuple(r) for r in queries.op9_lm_scoring(spark, sf_dir).collect()]
    compare(got, brute(rows))
    assert all(r[6] < 0 for r in got)
    # On held-out texts, contexts are worth more than a fifth of what symbols alone cost.
    held = [(i, x) for i, x in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    seen = Counter(c for i, x in rows if (i, x) not in set(held) for c in b" ".join(t.encode() for t in tokens(x)) + b"\n")
    root = sum(math.log10((seen[c] + 1) / (sum(seen.values()) + 256)) for _, x in held for c in b" ".join(t.encode() for t in tokens(x)) + b"\n")
    assert sum(r[6] for r in got if r[1]) > 0.8 * root


def test_edges(spark, edge_docs, edge_rows, no_docs):
    clash = edge_docs.withColumns({"n": F.lit(1), "chunk": F.lit(2), "score": F.lit("mine")})
    got = [tuple(r) for r in lm_scoring.score(clash).collect()]
    compare(got, brute([(r[0], r[1]) for r in edge_rows]))
    assert lm_scoring.score(no_docs).collect() == []
    nothing = lm_scoring.score(edge_docs, F.lit(True)).collect()
    assert len(nothing) == len(edge_rows) and all(r["n_known"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_stream_of_a_chunk():
    words, texts = [b"a", b"bc"], [[0, 1], [], [1]]
    ids = np.array([w for t in texts for w in t], np.int32)
    s, past = lm_scoring.stream(np.array([2, 0, 1], np.int32), ids, b"".join(words), np.array([1, 2], "<i4").tobytes())
    pad = b"\n" * lm_scoring.DEPTH
    assert s.tobytes() == pad + b"a bc\n" + pad + b"\n" + pad + b"bc\n" and past.tolist() == [10, 16, 24]
    keys = lm_scoring.gram_keys(s, past, np.array([False, False, True]))
    assert [int(k).to_bytes(6, "big") for k in keys] == [b"\n\n\n\n\nb", b"\n\n\n\nbc", b"\n\n\nbc\n"]


def plain_tree(texts):
    """States with their next-symbol counts, straight from the definition; texts: bytes without the end symbol."""
    pad, depth = b"\n" * lm_scoring.DEPTH, lm_scoring.DEPTH
    nexts = {}
    for x in texts:
        x = pad + x + b"\n"
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                nexts.setdefault(x[i - d : i], Counter())[x[i]] += 1
    total = {c: sum(n.values()) for c, n in nexts.items()}
    least = lm_scoring.PENALTY * math.log(total[b""])
    gain = lambda c: sum(n * math.log(n / total[c] / (nexts[c[1:]][b] / total[c[1:]])) for b, n in nexts[c].items())
    passing = [c for c in nexts if c and gain(c) > least * len(nexts[c])]
    return {c: nexts[c] for c in {p[i:] for p in passing for i in range(len(p))} | {b""}}, len(passing)


def plain_probability(states, context, symbol):
    if context == b"":
        return (states[b""][symbol] + 1) / (sum(states[b""].values()) + 256)
    n, prior = states[context], lm_scoring.PRIOR
    return (n[symbol] + prior * plain_probability(states, context[1:], symbol)) / (sum(n.values()) + prior)


def plain_score(states, text):
    x, out = b"\n" * lm_scoring.DEPTH + text + b"\n", 0.0
    for i in range(lm_scoring.DEPTH, len(x)):
        longest = next(x[i - d : i] for d in range(lm_scoring.DEPTH, -1, -1) if x[i - d : i] in states)
        out += math.log10(plain_probability(states, longest, x[i]))
    return out


@pytest.mark.parametrize("group", [64 << 20, 3000])
def test_scores_are_those_of_the_whole_tree(spark, group, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP_SYMBOLS", group)  # with the small one, buckets are dealt to several groups
    monkeypatch.setattr(lm_scoring, "CHUNK", 20_000)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4000)]
    said = vocabulary * 12
    rng.shuffle(said)
    texts = [" ".join(said[i : i + 400]) for i in range(0, len(said), 400)]
    states, n = plain_tree([x.encode() for x in texts])
    assert n > 8000 and len({len(c) for c in states}) > 3
    texts += ["never SEEN Ünïcode here", "", "zzzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, F.col("doc_id") >= len(texts) - 3).collect()}
    for i in [*range(0, len(texts), 10), *range(len(texts) - 3, len(texts))]:
        assert got[i] == pytest.approx(plain_score(states, " ".join(tokens(texts[i])).encode()), rel=1e-7)


def test_probabilities_of_a_context_add_up_to_one():
    states, _ = plain_tree([b"abracadabra alakazam"] * 40)
    for c in states:
        assert sum(plain_probability(states, c, b) for b in range(256)) == pytest.approx(1)


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        lm_scoring.score(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
