import hashlib
import random
import re
import zlib

import pyspark.sql.functions as F

from cairnfield.llm import shared, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    paths = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(paths.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [out[k] for k in kids.get(p, [])]
        out[p] = {
            "conv_id": min(nodes[p]),
            "depth": len(p),
            "parent_conv_id": min(nodes[p[:-1]]) if p else None,
            "n_convs": len(nodes[p]),
            "n_children": len(below),
            "n_leaves": sum(x["n_leaves"] for x in below) or 1,
            "saved_tokens": (len(nodes[p]) - 1) * words + sum(x["saved_tokens"] for x in below),
            "ends_sha256": hashlib.sha256(",".join(str(c) for c in sorted(c for c in nodes[p] if rebuilt[c] == p)).encode()).hexdigest(),
        }
    return sorted((tuple(x[k] for k in COLUMNS) for x in out.values()), key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(spark, df):
    with shared.Scratch(spark) as scratch:
        turns = trie.numbered(trie.turn_rows(df), scratch)
        out = trie.prefix_trie(trie.with_openings(turns), scratch)
        assert tuple(out.columns) == COLUMNS
        return sorted((tuple(r) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in range(-45, 90):
        if c % 20 == 0 and c in (20, 60):
            continue  # blocks without an opening
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "d  e\tf"])))
    rows += [(1000, None, "user", None), (1000, 3, None, "x y"), (1001, 0, "user", "q"), (1001, 0, "user", "q"), (1001, 0, "user", "p"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    assert nodes(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_conversation_over_many_partitions_and_one_group_of_copies(spark):
    rows = [(7, t, "user", f"w{t % 3} x") for t in range(400)] + [(7, 400, "user", "same")] * 50
    rows += [(c, t, "user", "hello there") for c in range(100, 400) for t in range(3)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(7)
        assert nodes(spark, df) == brute(rows)
        with shared.Scratch(spark) as scratch:
            long = trie.turn_rows(df.filter("conv_id = 7")).withColumn("row", F.lit(0))
            got = trie.running(long, ("turn", "digest"), scratch, sums=("words",)).groupBy().agg(F.max("seen"), F.max("run_words"), F.countDistinct("seen")).first()
            assert tuple(got) == (450, 850, 450)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = spark.range(100).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("c")).unionByName(spark.range(3).select(F.lit(2).cast("long").alias("k"), F.col("id").alias("c")))
    got = {r.k: r.ends_sha256 for r in trie.list_digests(rows, ("k",), "c").collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest(), 2: hashlib.sha256(b"0,1,2").hexdigest()}


def test_empty_and_clashing_columns(spark):
    assert nodes(spark, spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (20, 0, "user", "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", c int, depth int, k1 int, words int")
    assert nodes(spark, df) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "a", "b")]
    with shared.Scratch(spark) as scratch:
        turns = trie.numbered(trie.turn_rows(spark.createDataFrame(rows, SCHEMA)), scratch)
        got = sorted((r.depth, r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in trie.prefix_trie(trie.as_they_are(turns), scratch).collect())
    assert got == [(0, 1, 3, 1, 3), (1, 1, 3, 1, 3), (2, 1, 2, 1, 1)]
