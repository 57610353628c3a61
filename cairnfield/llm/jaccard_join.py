"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct k-word shingles (64-bit hashes). Sets are ordered by a global order, rare shingles first. Two
sets of Jaccard similarity t or more share at least l shingles among their first s - ceil(t s) + l (s: set size). For each document l
is chosen by estimated cost: a longer prefix meets more postings, but asks for l shared shingles before a pair is
verified; documents whose short prefix is full of frequent shingles take a larger l. A pair is a candidate if it shares
min(l, l') shingles of both prefixes; candidates are verified on whole sets.

Shingles meet within size classes alone, as sets of very unequal size cannot be similar; a shared shingle counts once for a pair,
and only at places of the order that leave room for enough others on both sides. Each set also has a parity sketch (which
of 64 * PARITIES classes hold an odd number of its shingles): two sketches differ in no more bits than the sets differ in shingles, so
that most unrelated sets part inside the join, and no similar ones.

Equal sets are one class from the start; only classes are joined, and a group of near copies is connected through
pivots before all that remains unconnected is compared.

The order's counts are lossy counts over all documents: a chunk's count of a shingle is dropped when it is below
LEAST_LOCAL. The order never changes results, only the work. Sets are known by 64-bit digests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components, shared

#: Shingles counted together, the least count that is passed on, and how many frequent shingles the order can hold (8 MB).
CHUNK_SHINGLES, LEAST_LOCAL, FREQUENT = 4_000_000, 3, 500_000
#: The cost of verifying a candidate, in postings.
VERIFY_COST = 20.0
#: Longs of a set's parity sketch, and bytes of the larger one that a candidate has to pass before texts move.
PARITIES, WIDE = 8, 512
#: Rounds in which each key's items are compared with one of them, before all that are still apart are.
STARS = 6
#: Documents up to which a list of wanted ids is broadcast (some 50 MB); beyond it documents are shuffled.
BROADCAST_IDS = 1_000_000


def digest(hashes: np.ndarray) -> int:
    """A 64-bit digest of a set of hashes, as a signed integer."""
    x = shared.mix(np.array([shared.mix(hashes).sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(hashes) + np.uint64(len(hashes)))], dtype=np.uint64))
    return int(x.astype(np.int64)[0])


def parities(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of size * 8 classes of hashes, those of which a set has an odd number, as bits in size bytes."""
    classes = size * 8
    return np.packbits(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % classes, minlength=classes).astype(np.uint8) & 1)


def _summary(k: int):
    sketch = [f"p{n}" for n in range(PARITIES)]

    def run(batches):
        held, seen, n, kind = [], set(), 0, None

        def counted():
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            at = count >= LEAST_LOCAL
            m = int(at.sum())
            return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, kind), pa.array(count[at].astype(np.int64)), pa.array(tokens[at].astype(np.int64)), *[pa.nulls(m, pa.int64())] * PARITIES, pa.nulls(m, pa.binary())], names=["kind", "id", "n", "hash", *sketch, "wide"])

        for batch in batches:
            ids = batch.column(0)
            kind = ids.type
            data, off = shared.utf8(batch.column(1))
            for i, j in shared.blocks(off):
                size, which, odd, wide = [], [], [], []
                for s in shared.sets_of(data[off[i]: off[j]], off[i: j + 1], k):
                    d = digest(s)
                    size.append(len(s))
                    which.append(d)
                    odd.append(parities(s, 8 * PARITIES).view(np.int64).tolist())
                    wide.append(parities(s, WIDE).tobytes())
                    if d not in seen and len(s):
                        seen.add(d)
                        held.append(s)
                        n += len(s)
                yield pa.RecordBatch.from_arrays([pa.array([0] * (j - i), pa.int32()), ids.slice(i, j - i), pa.array(size, pa.int64()), pa.array(which, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*odd, strict=True)), pa.array(wide, pa.binary())], names=["kind", "id", "n", "hash", *sketch, "wide"])
                if n >= CHUNK_SHINGLES:
                    yield counted()
                    held, seen, n = [], set(), 0
        if held:
            yield counted()

    return run


def _frequent(counts: DataFrame, scratch: shared.Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (ascending hashes) and their counts, FREQUENT of them at most."""
    total = counts.groupBy("hash").agg(F.sum("n").alias("n"))
    total = scratch.keep(total)
    held = dict(total.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect())  # some 40 rows
    least, n = 64, 0
    for level in sorted(held, reverse=True):
        n += held[level]
        if n > FREQUENT:
            break
        least = level
    rows = total.filter(F.col("n") >= float(2.0**least)).toArrow()
    token, count = rows.column("hash").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def prefix(hashes: np.ndarray, frequent: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(prefix shingles, l) of a set of ascending hashes."""
    s = len(hashes)
    need = -(-percent * s // 100)
    df = np.zeros(s)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        df = np.where(frequent[at] == hashes, count[at], 0)
    order = np.argsort(df, kind="stable")
    most = need  # the longest prefix is the whole set
    work = np.cumsum(df[order[: s - need + most]])
    i = np.arange(1, most + 1)
    cost = work[s - need:] * (1 + VERIFY_COST / i) + (s - need + i)
    best = int(np.argmin(cost)) + 1
    return hashes[order[: s - need + best]], best


def similar_classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = (), key_col: str | None = None) -> DataFrame:
    """Per document row: id, keep_cols, n_shingles (set size), component_id (smallest id reachable by links, itself included).

    Documents link when their sets' Jaccard similarity is at least percent / 100. Null texts and texts without words have
    empty sets and link with nothing; texts of fewer than k words are one shingle. Repeated rows link with each
    other; null ids never become a component's id unless all its ids are null. Other columns of docs are dropped.
    key_col: name of a last column with the component's own key, which components of equal (or null) ids do not share; null for empty sets.
    """
    with shared.Scratch(docs.sparkSession) as scratch:
        return shared.stored(_classes(docs, k, percent, id_col, text_col, keep_cols, key_col, scratch))


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, keep_cols: tuple[str, ...], key_col: str | None, scratch: shared.Scratch) -> DataFrame:
    extra = [f"__k{n}" for n in range(len(keep_cols))]
    sketch = [f"p{n}" for n in range(PARITIES)]
    docs = docs.select(F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(x) for x, c in zip(extra, keep_cols, strict=True))).alias("__row"), F.col(text_col).alias("__text"), F.col(id_col).alias("__id"))
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", docs.schema["__row"].dataType), *(T.StructField(x, T.LongType()) for x in ("n", "hash", *sketch)), T.StructField("wide", T.BinaryType())])
    facts = scratch.keep(docs.select("__row", "__text").mapInArrow(_summary(k), schema))
    rows = facts.filter("kind = 0").select(F.col("id.id").alias("__id"), *(F.col(f"id.{x}").alias(x) for x in extra), F.col("n").alias("n_shingles"), "hash", *sketch, "wide")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(facts.filter("kind = 1"), scratch))
    classes = scratch.keep(rows.filter("n_shingles > 0").groupBy("hash").agg(F.min("__id").alias("first"), F.min("n_shingles").alias("size"), *(F.min(x).alias(x) for x in sketch), F.first("wide").alias("wide")))

    def prefixes(batches):
        token, count = frequent.value
        seen: set[int] = set()
        for batch in batches:
            data, off = shared.utf8(batch.column(0))
            for i, j in shared.blocks(off):
                keys, nodes, sizes, matches, places = [], [], [], [], []
                for s in shared.sets_of(data[off[i]: off[j]], off[i: j + 1], k):
                    d = digest(s)
                    if not len(s) or d in seen:
                        continue
                    seen.add(d)
                    p, m = prefix(s, token, count, percent)
                    keys.append(p)
                    nodes.append(np.full(len(p), d))
                    sizes.append(np.full(len(p), len(s)))
                    matches.append(np.full(len(p), m))
                    places.append(np.arange(len(p)))
                if len(seen) > 1_000_000:
                    seen.clear()
                if keys:
                    cols = [np.concatenate(x) for x in (keys, nodes, sizes, matches, places)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1]), *(pa.array(x.astype(np.int32)) for x in cols[2:])], names=["key", "node", "size", "matches", "place"])

    postings = docs.select("__text").mapInArrow(prefixes, "key long, node long, size int, matches int, place int")
    def several(postings: DataFrame) -> DataFrame:
        """Those whose key has several nodes."""
        keys = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("__k"))
        out = scratch.keep(postings.join(keys, F.col("key") == F.col("__k"), "left_semi"))
        scratch.drop(postings)
        return out

    # Equal sets of different tasks give equal rows; keys of one class alone are dropped.
    postings = several(scratch.keep(postings.groupBy("key", "node").agg(F.min("size").alias("size"), F.min("matches").alias("matches"), F.min("place").alias("place"))))
    # Sets of linked documents differ in size by at most the similarity: they share a size class, or neighbouring ones.
    level = F.floor(F.log(F.col("size").cast("double")) / -math.log(percent / 100) + 1e-6) if percent < 100 else F.col("size")
    both = F.array(*(F.struct(F.xxhash64("key", level + up).alias("key"), F.lit(bool(up)).alias("up")) for up in (0, 1)))
    leveled = postings.select(F.explode(both).alias("of"), "node", "size", "matches", "place").select("of.key", "of.up", "node", "size", "matches", "place")
    leveled = several(leveled)
    scratch.drop(postings)
    # nodes with their sketches: classes are few, their postings many
    wide = classes.select(F.col("hash").alias("__h"), *sketch)
    postings = leveled.join(wide, F.col("node") == F.col("__h")).drop("__h")

    def similar(batches):
        """The pairs whose texts' whole sets are similar; a text of another class (an id may repeat) is no witness."""
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (a_data, a_off), (b_data, b_off) = shared.utf8(batch.column(2)), shared.utf8(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in shared.blocks(a_off):
                a_sets = shared.sets_of(a_data[a_off[i]: a_off[j]], a_off[i: j + 1], k)
                b_sets = shared.sets_of(b_data[b_off[i]: b_off[j]], b_off[i: j + 1], k)
                for r, (x, y) in enumerate(zip(a_sets, b_sets, strict=True), i):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = 100 * both >= percent * (len(x) + len(y) - both) and digest(x) == a[r] and digest(y) == b[r]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def close(batches):
        """The pairs whose large sketches leave it open that they are similar."""
        for batch in batches:
            bits = [data[off[0]: off[-1]].reshape(-1, WIDE) for data, off in map(shared.utf8, batch.columns[2:4])]
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64) * (100 + percent) <= sizes * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of one document of each class; texts are a third of the size of their sets."""
        wanted = scratch.keep(nodes.join(classes, F.col("node") == F.col("hash")).select("first", "node"))
        few = wanted.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(wanted) if few else wanted, F.col("__id").eqNullSafe(F.col("first"))).select("node", F.col("__text").alias("text")).dropDuplicates(["node", "text"])

    def near():
        # sets of a similarity differ in at most this share of their shingles
        apart = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in sketch), F.lit(0))
        sizes = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
        # sets of one class meet in it alone, not in the one above again
        once = ~(F.col("a_up") & F.col("b_up"))
        # what can be shared before this shingle, and from it on
        most = F.least("a_place", "b_place") + F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
        room = most * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent
        return once & sizes & room & (apart * (100 + percent) <= (F.col("a_size") + F.col("b_size")) * (100 - percent))

    def matches():
        return F.least("a_matches", "b_matches")

    def enough(n, least):
        return n >= least

    def verify(pairs: DataFrame, scratch: shared.Scratch) -> DataFrame:
        # large sketches move for candidates, and texts for those that pass
        of = [classes_.select(F.col("hash").alias(x), F.col("wide").alias(f"{x}_wide"), F.col("size").alias(f"{x}_size")) for x in "ab"]
        pairs = pairs.join(of[1], "b").join(of[0], "a").select("a", "b", "a_wide", "b_wide", "a_size", "b_size").mapInArrow(close, "a long, b long")
        pairs = scratch.keep(pairs)
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(similar, "a long, b long").distinct()

    classes_ = classes
    linked = components.clusters(postings, near, verify, scratch, matches, enough, STARS)
    classes = classes.select("hash", "first")
    classes = classes.join(linked, F.col("hash") == F.col("node"), "left").withColumn("component", F.coalesce("component", "hash")).drop("node")
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "component").select(F.col("hash").alias("__h"), "component_id", "component")
    return rows.join(classes, (F.col("hash") == F.col("__h")) & (F.col("n_shingles") > 0), "left").select(
        F.col("__id").alias(id_col), *(F.col(x).alias(c) for x, c in zip(extra, keep_cols, strict=True)), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("__id")).otherwise(F.col("component_id")).alias("component_id"), *([F.col("component").alias(key_col)] if key_col else [])
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document, 3-word shingles, similarity 0.9."""
    return similar_classes(shared.table(spark, sf_dir, "documents"))
