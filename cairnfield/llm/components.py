"""Connected components of a link table, and clusters of items that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component: smallest node reachable) for the nodes of links (a, b), kept in scratch. Nulls are not links.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the longest chain.
    Each round is written. A hub's rows are summed by partial aggregation and joined, so that a skewed hub can be split.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        """(u, v) with m: the smallest of u and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        return pairs.join(least, F.col("u") == F.col("k")).drop("k")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges)
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = smallest(large)  # here every v < u
        new = scratch.keep(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges)
        edges, after = new, mark(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    out = scratch.keep(found)
    scratch.drop(edges)
    return out


def clusters(postings: DataFrame, near, verify, scratch: Scratch, score=None, enough=None, stars: int = 2) -> DataFrame:
    """Components of the items linked by verify(), among pairs that near() admits: (node, component) of linked items, kept in scratch.

    postings: (key, node, ...), a row for each key of an item; near() says whether two postings' items (columns by prefixes a_
    and b_) can be linked - it becomes part of the join's condition; enough(n, score), if given, whether n shared keys and the
    least score() of two postings make a candidate; verify(pairs, scratch) returns the pairs (a, b) that are links.
    No link between different components is lost: the first rounds verify, per key, one pivot against the others, which
    joins most groups at linear cost; the last round takes every candidate pair whose items are not connected yet.
    """
    others = [c for c in postings.columns if c not in ("key", "node")]
    joined, done, kept = None, None, None
    for turn in range(stars + 1):
        if joined is None:
            rows = postings.withColumn("component", F.col("node"))
        else:
            rows = postings.join(joined.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").withColumn("component", F.coalesce("component", "node")).drop("__n")
        keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
        keys = keys.filter("lo < hi").select(F.col("key").alias("__key"), "pivot")
        rows = scratch.keep(rows.join(keys, F.col("key") == F.col("__key")).drop("__key"))
        scratch.drop(kept)
        kept, postings = rows, rows.drop("component", "pivot")  # keys whose items are all connected stay so
        a = rows.filter("node = pivot") if turn < stars else rows
        a, b = (side.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "component", *others))) for side, x in ((a, "a"), (rows, "b")))
        met = a.join(b, "key").filter((F.col("a_component") != F.col("b_component")) & near())
        if turn == stars:
            met = met.filter("a_node < b_node")
        met = met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), (score() if score else F.lit(0)).alias("score"))
        pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        pairs = (pairs.filter(enough(F.col("n"), F.col("score"))) if enough else pairs).select("a", "b")
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        new = scratch.keep(verify(pairs, scratch))
        done = pairs if done is None else done.unionByName(pairs)
        # the components so far stand for the links so far
        links = new if joined is None else new.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        joined = components(links, scratch)
    scratch.drop(kept)
    return joined
