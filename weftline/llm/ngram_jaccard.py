"""N-gram Jaccard join by grouped prefixes.

A text's set is that of its distinct shingles. All sets are put in one global order, rare shingles first, and two sets
that reach the threshold share a shingle within their prefixes. Texts with identical prefix and size are one group;
pairs of groups go through the size and position filters, and only then are expanded to their members, whose sets are
compared. Links are wanted for their classes, so members that are known to be in one class already are not compared
again: that keeps a group of many near copies from costing its square, and loses no class.

    texts -> chunks (exact copies collapse) -> document frequencies -> prefixes -> groups
          -> members within each group, then neighbours under one prefix shingle, verified in a stream -> classes
          -> pairs of groups across classes: with hubs by one member each, then all: filtered, expanded, verified -> classes
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, plain, whole_ids
from .vec import LOWER, SPACE, mix, slices, windows, words

#: Words of a shingle, and the least per cent of the union that two linked sets share.
SHINGLE, PERCENT = 5, 80
CHUNK = 4 << 20
#: A shingle's place is known to so many bits within its bucket; buckets hold about BUCKET entries.
PLACE_BITS, BUCKET = 26, 2_000_000
#: Unlinked sets of one key that a new one is compared with while it is linked to its neighbours; keys for that.
LEADERS, ROUNDS = 64, 3
#: Links that a task contracts at a time before it hands on what is left of them.
CONTRACTED = 500_000


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text, and their hashes, sorted within each text. A text with fewer than
    ``shingle`` words has one, of all of them; one without words has none."""
    counts, sets = np.zeros(len(texts), np.int64), []
    for lo, hi in slices(texts):
        w = words(texts[lo:hi], SPACE, LOWER)
        h = w.hashes()
        found = []
        for k in range(1, shingle + 1):
            key, at = windows(h, w.doc, k)
            keep = (k == shingle) | (w.n[w.doc[at]] == k)
            found.append((key[keep], w.doc[at][keep]))
        key, doc = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        counts[lo:hi] = np.bincount(doc[new], minlength=hi - lo)
        sets.append(key[new])
    return counts, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of a set of n with any other that it links to."""
    return (percent * n + 99) // 100


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


# ---- prefixes --------------------------------------------------------------------------------------------------


def distinct_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once for a partition: copies of one text, be they a third of all rows, leave a row a partition."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        keep = []
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


class Chunk:
    """The distinct texts of a chunk, their sets, and the order in which the chunk's shingles go to the buckets."""

    def __init__(self, table: pa.Table, bits: int, shingle: int):
        h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        self.rows = order[new]
        self.h1, self.h2 = h1[self.rows], h2[self.rows]
        texts = table.column("text").take(pa.array(self.rows)).combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        self.n, self.tokens = shingle_sets(texts, shingle)
        self.place = self.tokens >> np.uint64(64 - bits - PLACE_BITS)
        self.bits = bits

    def bounds(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(places >> np.uint64(PLACE_BITS), np.arange((1 << self.bits) + 1).astype(np.uint64))

    def keys(self) -> list[bytes]:
        """128 bits of each set, whatever text it comes from."""
        ends = np.concatenate([[0], np.cumsum(self.n)])
        out = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.tokens ^ np.uint64(salt)))])
            out.append(mix(sums[ends[1:]] - sums[ends[:-1]] + self.n.astype(np.uint64)))
        both = np.stack(out, 1)
        return [x.tobytes() for x in both]


def frequencies(chunks: DataFrame, bits: int, shingle: int) -> DataFrame:
    """(chunk, bucket, at, df): which of a chunk's distinct places, in order, occur in two texts or more, and in how many,
    as 8 * log2. Places of a chunk go to the buckets as differences, about two bytes each, with the number of texts where
    that is not one; so a shingle that a third of all texts have is one entry a chunk."""

    def send(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, bits, shingle)
        places, n = np.unique(chunk.place, return_counts=True)
        at = chunk.bounds(places)
        some = np.flatnonzero(np.diff(at))
        low = (places & np.uint64((1 << PLACE_BITS) - 1)).astype(np.uint32)
        data, many, times = [], [], []
        for i in some:
            own = slice(at[i], at[i + 1])
            steps = np.diff(low[own], prepend=np.uint32(0))
            data.append(steps.astype("<u2").tobytes() + b"2" if steps.max() < 1 << 16 else steps.astype("<u4").tobytes() + b"4")
            several = np.flatnonzero(n[own] > 1)
            many.append(several.astype("<u4").tobytes())
            times.append(n[own][several].astype("<u4").tobytes())
        name = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(some, pa.int64()), "chunk": pa.array([name] * len(some), pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in (("data", data), ("many", many), ("times", times))}})

    def count(table: pa.Table) -> pa.Table:
        places = [np.cumsum(np.frombuffer(x[:-1], "<u2" if x[-1:] == b"2" else "<u4"), dtype=np.uint32) for x in table.column("data").to_pylist()]
        n = []
        for p, where, times in zip(places, table.column("many").to_pylist(), table.column("times").to_pylist()):
            n.append(np.ones(len(p), np.int64))
            n[-1][np.frombuffer(where, "<u4")] = np.frombuffer(times, "<u4")
        _, inverse = np.unique(np.concatenate(places), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(n))
        each = np.minimum(255, np.floor(8 * np.log2(df))).astype(np.uint8)[inverse]
        at, out, start = [], [], 0
        for p in places:
            x = each[start : start + len(p)]
            hit = np.flatnonzero(x)
            at.append(hit.astype("<u4").tobytes())
            out.append(x[hit].tobytes())
            start += len(p)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "at": pa.array(at, pa.binary()), "df": pa.array(out, pa.binary())})

    sent = chunks.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, data binary, many binary, times binary")
    return sent.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, at binary, df binary")


def prefixes(chunks: DataFrame, bits: int, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each distinct text: h1, h2, n, key (its set's), and if its prefix has shingles that occur elsewhere: those
    (``tokens``, rare first), their places in its whole order (``pos``), its prefix' hash (``sig``) and its set."""

    def prefix(texts: pa.Table, back: pa.Table) -> pa.Table:
        names = ["h1", "h2", "n", "key", "tokens", "pos", "sig", "set"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        chunk = Chunk(texts, bits, shingle)
        places, which = np.unique(chunk.place, return_inverse=True)
        at = chunk.bounds(places)
        each = np.zeros(len(places), np.uint8)
        for bucket, where, d in zip(*(back.column(c).to_pylist() for c in ("bucket", "at", "df"))):
            each[at[bucket] + np.frombuffer(where, "<u4").astype(np.int64)] = np.frombuffer(d, np.uint8)
        df = each[which]
        ends = np.cumsum(chunk.n)
        length = chunk.n - needed(chunk.n, percent) + 1
        alone = np.concatenate([[0], np.cumsum(df == 0)])
        n_alone = alone[ends] - alone[ends - chunk.n]
        tokens, pos, sig, sets = ([None] * len(ends) for _ in range(4))
        for i in np.flatnonzero((chunk.n > 0) & (n_alone < length)):
            own = slice(ends[i] - chunk.n[i], ends[i])
            t, d = chunk.tokens[own], df[own]
            ranked = np.lexsort((t, d))[: length[i]]
            shared = np.flatnonzero(d[ranked])
            tokens[i], pos[i] = t[ranked[shared]].view(np.int64), shared.astype(np.int32)
            sig[i] = int(mix(np.cumsum(mix(t[ranked] + np.uint64(7))))[-1].astype(np.int64))
            sets[i] = t.tobytes()
        columns = [chunk.h1, chunk.h2, chunk.n, chunk.keys(), tokens, pos, sig, sets]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    back = frequencies(chunks, bits, shingle)
    both = chunks.groupBy("chunk").cogroup(back.groupBy("chunk"))
    return both.applyInArrow(prefix, "h1 long, h2 long, n long, key binary, tokens array<long>, pos array<int>, sig long, set binary")


# ---- links -----------------------------------------------------------------------------------------------------


def link_neighbours(batches: Iterator[pa.RecordBatch], percent: int = PERCENT, most: int = LEADERS) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, set), equal keys side by side: each set is compared with up to ``most`` earlier ones of its key
    that stand for different classes so far. Every link given is a verified one."""
    key, leaders, root = None, [], {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        a, z = [], []
        for k, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if k != key:
                key, leaders, root = k, [], {}
            own = np.frombuffer(raw.as_buffer(), np.uint64)
            alone = True
            for other, theirs in leaders:
                if find(other) != find(node) and linked(own, theirs, percent):
                    root[find(node)] = find(other)
                    a.append(node)
                    z.append(other)
                    alone = False
            if alone or len(leaders) < most // 4:
                leaders = [*leaders[1 - most :], (node, own.copy())]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as stars (u, v): each node but the least of what it reaches here, with that least one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        if len(root) > CONTRACTED:
            yield stars()
    yield stars()


def classes(links: DataFrame) -> DataFrame:
    """(node, label) of links(a, b): the smallest node that links reach.

    Tasks first contract the links that they hold to stars. Then, step by step, each node takes the least of its
    neighbours' and their neighbours' labels, and its other neighbours are linked to that least one, until all are stars.
    A step is one written table; only a count of what is left to do reaches the driver. A node's neighbours are a set
    combined on the map side, one a task after the contraction.
    """
    edges = links.select("a", "b").mapInArrow(contracted, "u long, v long")
    while True:
        near = edges.groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("p", F.array_min("vs"))
        above = near.select(F.col("u").alias("w"), F.col("p").alias("pp"))
        step = cut(near.join(above, F.col("p") == F.col("w"), "left").drop("w"), "stars")
        if not step.where((F.size("vs") > 1) | F.col("pp").isNotNull()).limit(1).count():
            return step.select(F.col("u").alias("node"), F.col("p").alias("label")).unionByName(step.select(F.col("p").alias("node"), F.col("p").alias("label")).distinct())
        others = step.select(F.explode(F.array_remove("vs", F.col("p"))).alias("u"), F.col("p").alias("v"))
        edges = step.select("u", F.coalesce("pp", "p").alias("v")).unionByName(others)


def grouped(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of the shingles that occur in several classes, as (token, sig, n, label, pos, g), and their members as (g,
    node). A group is an identical prefix and size, within a class: all its members stand under the same shingles, at
    the same places."""
    entries = sets.join(labels, "node", "left").select("node", "n", "sig", F.coalesce("label", "node").alias("label"), F.explode(F.arrays_zip("tokens", "pos")).alias("x"))
    entries = entries.select("node", "n", "sig", "label", F.col("x.tokens").alias("token"), F.col("x.pos").alias("pos"))
    several = cut(entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"), "tokens")
    entries = cut(entries.join(several, "token"), "entries")
    groups = cut(entries.groupBy("token", "sig", "n", "label").agg(F.min("pos").alias("pos"), F.min("node").alias("g")), "groups")
    members = entries.join(groups.select("token", "sig", "n", "label", "g"), ["token", "sig", "n", "label"]).select("g", "node").distinct()
    return groups, cut(members, "members")


def near(percent: int):
    """Groups x and y of one shingle and different classes that the size and position filters let through: what stands
    from the shingle on in both orders bounds the overlap."""
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & sizes & ((100 + percent) * reach >= percent * (F.col("x.n") + F.col("y.n")))


def hub_pairs(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The first members of each group and of the group of another class that has its shingle foremost: the one with fewest
    rare shingles, as the text that copies were made of. A pair an entry at most; the links found merge most classes before
    all pairs are taken."""
    foremost = F.min_by(F.struct("n", "label", "pos", "g"), F.struct("pos", "g"))
    hubs = cut(groups.groupBy("token").agg(foremost.alias("h")).select("token", "h.*"), "hubs")
    return groups.alias("x").join(hubs.alias("y"), near(percent)).select(F.col("x.g").alias("a"), F.col("y.g").alias("b")).distinct()


def cross_pairs(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of groups of different classes. One side of each lies outside the class with most groups of the shingle."""
    counts = groups.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = cut(counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main")), "main-class")
    marked = cut(groups.join(main, "token"), "groups-marked")
    x, y = marked.where("label <> main").alias("x"), marked.alias("y")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.g") < F.col("y.g"))
    return x.join(y, near(percent) & once).select(F.col("x.g").alias("x"), F.col("y.g").alias("y"))


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of groups as pairs of their members: (a, b)."""
    pairs = cut(pairs.distinct(), "group-pairs")
    left = pairs.join(members.select(F.col("g").alias("x"), F.col("node").alias("a")), "x")
    return left.join(members.select(F.col("g").alias("y"), F.col("node").alias("b")), "y").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    each = sets.select("node", "set")
    both = pairs.join(each.withColumnsRenamed({"node": "a", "set": "set_a"}), "a").join(each.withColumnsRenamed({"node": "b", "set": "set_b"}), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def link_keys(sets: DataFrame) -> list[DataFrame]:
    """(key, node, set) to be compared as neighbours: members of groups of several; then all by the commonest shared
    shingle of the prefix, as copies of one text share it; then by the rarest."""
    several = sets.groupBy("sig", "n").count().where("count > 1").drop("count")
    inner = sets.join(several, ["sig", "n"], "left_semi").select(F.xxhash64("sig", "n").alias("key"), "node", "set")
    return [inner, *(sets.select(F.element_at("tokens", at).alias("key"), "node", "set") for at in (-1, 1))]


def link_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label) of every node that links to another."""
    found = None
    for r, rows in enumerate(link_keys(sets)[:ROUNDS]):
        rows = rows.withColumn("mixed", F.xxhash64("node", F.lit(r))).repartitionByRange("key", "mixed").sortWithinPartitions("key", "mixed").select("key", "node", "set")
        links = cut(rows.mapInArrow(partial(link_neighbours, percent=percent, most=LEADERS), "a long, b long"), "links")
        found = links if found is None else found.unionByName(links)
    labels = cut(classes(found), "classes")
    for pairs in (lambda groups, members: hub_pairs(groups, percent), lambda groups, members: expanded(cross_pairs(groups, percent), members)):
        groups, members = grouped(sets, labels)
        more = cut(verified(pairs(groups, members), sets, percent), "links")
        if more.limit(1).count():
            known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = cut(classes(known.unionByName(more.select("a", "b"))), "classes")
    return labels


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``n_shingles`` (set size) and ``component_id`` (the smallest id that links reach, its own included).

    Ids are whole numbers (TypeError otherwise). Texts are compared whole, A-Z lower-cased. Links are exact but for 64-bit hashes of shingles and 128-bit hashes of
    sets. Documents with equal sets are linked. Null and empty texts, and those of white space, have no set, no link and
    their own id. A null id counts for no class: a class of null ids alone has a null component. Repeated rows get equal
    results. An empty table gives an empty table. Input columns named as an output column are replaced.
    """
    docs = plain(docs, "n_shingles", "component_id")
    whole_ids(docs, id_col)
    _, table = solve(docs, F.col(id_col).cast("long"), F.col(text_col), shingle, percent)
    return placed(docs, table, F.col(id_col).cast("long"), F.col(text_col))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class of ``components``: one with the smallest id, and of rows that share it any one.
    Rows without a set stay. A null id counts as the hash of its text. Ids are whole numbers (TypeError otherwise)."""
    whole_ids(docs, id_col)
    own = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    marked = plain(docs, "__own").withColumn("__own", own)
    narrow, table = solve(marked, F.col("__own"), F.col(text_col), shingle, percent)
    out = placed(marked, table, F.col("__own"), F.col(text_col))
    first = (F.col("n_shingles") == 0) | (F.col("__own") == F.col("component_id"))
    out = out.where(first)
    shared = cut(narrow.groupBy("id").count().where("count > 1").select(F.col("id").alias("__own")), "shared-ids")
    if shared.limit(1).count():
        once = out.where("n_shingles > 0").join(shared, "__own", "left_semi").dropDuplicates(["__own"])
        rest = out.where("n_shingles > 0").join(shared, "__own", "left_anti")
        out = out.where("n_shingles = 0").unionByName(once).unionByName(rest)
    return out.select(*docs.columns)


def solve(docs: DataFrame, own_id, text, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, h1, h2, bytes) of each row with a text, and (__r1, __r2, __n, __c) of each distinct text: its hashes, its
    set's size and its class' smallest id. Both written."""
    some = docs.where(text.isNotNull())
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    narrow = cut(some.select(own_id.alias("id"), *hashes, F.octet_length(text).alias("bytes")), "ids")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    n_chunks = 1 + int(total) // CHUNK
    bits = max(6, int(np.ceil(np.log2(1 + total / 5 / BUCKET))))  # about one shingle for five bytes
    texts = some.select(*hashes, text.alias("text"))
    chunks = texts.mapInArrow(distinct_here, texts.schema).withColumn("chunk", F.pmod("h1", F.lit(n_chunks)))
    found = cut(prefixes(chunks, bits, shingle, percent), "prefixes")
    candidates = found.where("tokens is not null").select("key", "n", "tokens", "pos", "sig", "set").dropDuplicates(["key"])
    sets = cut(candidates.withColumn("node", F.monotonically_increasing_id()), "sets")
    labels = link_classes(sets.select("node", "n", "tokens", "pos", "sig", "set"), percent)
    named = found.select("h1", "h2", "n", "key").join(sets.select("key", "node"), "key", "left").join(labels, "node", "left")
    group = F.when(F.col("label").isNotNull(), F.col("label").cast("string")).otherwise(F.hex("key"))
    named = cut(named.select("h1", "h2", "n", group.alias("g")), "named")
    firsts = cut(narrow.groupBy("h1", "h2").agg(F.min("id").alias("id")), "firsts")
    by_text = cut(named.join(firsts, ["h1", "h2"]), "by-text")
    least = cut(by_text.groupBy("g").agg(F.min("id").alias("component_id")), "least")
    table = by_text.join(least, "g").select(F.col("h1").alias("__r1"), F.col("h2").alias("__r2"), F.col("n").alias("__n"), F.col("component_id").alias("__c"))
    return narrow, cut(table, "components")


def placed(docs: DataFrame, table: DataFrame, own_id, text) -> DataFrame:
    # Rows without a text are dealt by their id, not all to one place.
    keyed = docs.withColumns({"__h1": F.when(text.isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(own_id)), "__h2": F.xxhash64(F.lit(1), text)})
    out = keyed.join(table, (F.col("__h1") == F.col("__r1")) & (F.col("__h2") == F.col("__r2")) & text.isNotNull(), "left")
    n = F.coalesce("__n", F.lit(0)).cast("long")
    return out.select(*docs.columns, n.alias("n_shingles"), F.when(n > 0, F.col("__c")).otherwise(own_id).cast("long").alias("component_id"))
