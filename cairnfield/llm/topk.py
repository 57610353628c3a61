"""Exact top-k search by inner product: tiles of queries times tiles of candidates.

Candidates are dealt into shards, queries into tiles of bounded size; each task multiplies one query tile with one
candidate shard block by block (exact integer arithmetic), keeps the k best per query, and the lists of the shards
are merged level by level (`fan_in` lists into one), so no task sees all the lists of a large run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows of a query tile and of a candidate shard (64 dimensions: 4 MB and 16 MB as doubles).
TILE_QUERIES, TILE_ROWS, FAN_IN = 8192, 32768, 32


def quantise(col: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds null, NaN or an infinity."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(col.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(col, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def best_of_tile(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, k: int, step: int = 256, wide: int = 4096):
    """(query index, candidate id, score) of the k best candidates for each query, ties to smaller ids. ids ascend."""
    out = []
    top = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
    exact = top * top * queries.shape[1] < 2.0**53
    if not exact:  # Python's integers do not overflow
        queries, vectors = (np.vectorize(int, otypes=[object])(x) for x in (queries, vectors))
    for a in range(0, len(queries), step):
        q, held = queries[a: a + step], None
        for b in range(0, len(vectors), wide):
            score = q @ vectors[b: b + wide].T
            own = query_ids[a: a + step, None] == ids[None, b: b + wide]
            if exact:
                score[own] = -np.inf
                cutoff = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else score.min(axis=1)
                r, c = np.nonzero((score >= cutoff[:, None]) & ~own)
                s = score[r, c].astype(np.int64)
            else:
                r, c = np.nonzero(~own)
                s = score[r, c]
            found = (r, c + b, s)
            held = found if held is None else tuple(np.concatenate(x) for x in zip(held, found, strict=True))
            r, c, s = held
            order = np.lexsort((c, -s, r)) if exact else np.array(sorted(range(len(r)), key=lambda i: (r[i], -s[i], c[i])), dtype=np.int64)
            r, c, s = r[order], c[order], s[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            held = tuple(x[rank < k] for x in (r, c, s))
        out.append((held[0] + a, ids[held[1]], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, tile_queries: int = TILE_QUERIES, tile_rows: int = TILE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The k candidates of highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Both inputs have `vec_id` and `v` (array of whole doubles, as quantise() makes them). Rows with a null id or
    vector take no part; a query's candidates are all rows but those of its own id; vectors of another length
    than the query's are no candidates. Repeated candidate rows count as often as they occur; of several query rows
    of one id the one with the smallest vector asks. Ties go to smaller ids. Scores are exact; one outside the range of a
    long raises an error. No queries or no candidates: no rows.
    """
    vectors = vectors.select("vec_id", "v").filter("vec_id is not null and v is not null")
    queries = queries.select("vec_id", "v").filter("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    n_shards = max(1, -(-vectors.count() // tile_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, 64))
    n_tiles = max(1, -(-queries.count() // tile_queries))

    def cells(df: DataFrame, own: int, other: int, own_name: str, other_name: str, names: tuple[str, str]) -> DataFrame:
        return df.select(
            F.col("vec_id").alias(names[0]),
            F.col("v").alias(names[1]),
            F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int").alias(own_name),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name),
        )

    # Each candidate goes to every query tile, each query to every shard: blocks of a stated query set.
    left = cells(queries, n_tiles, n_shards, "tile", "shard", ("q_id", "q_v")).groupBy("tile", "shard")
    right = cells(vectors, n_shards, n_tiles, "shard", "tile", ("c_id", "c_v")).groupBy("tile", "shard")

    def tile(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": [], "shard": [], "vec_id": [], "score": []}).astype("int64")]
        if q.empty or c.empty:
            return parts[0]
        c = c.sort_values("c_id", kind="stable")
        q_len, c_len = q["q_v"].map(len), c["c_v"].map(len)
        for n in set(q_len) & set(c_len):
            qs, cs = q[q_len == n], c[c_len == n]
            qi = qs["q_id"].to_numpy()
            at, ids, score = best_of_tile(np.array(qs["q_v"].tolist(), dtype=float).reshape(len(qs), n), cs["c_id"].to_numpy(), np.array(cs["c_v"].tolist(), dtype=float).reshape(len(cs), n), qi, k)
            parts.append(pd.DataFrame({"query_id": qi[at], "shard": key[1], "vec_id": ids, "score": score.astype("int64")}))
        return pd.concat(parts)

    found = left.cogroup(right).applyInPandas(tile, "query_id long, shard int, vec_id long, score long")
    lists = n_shards
    while True:
        lists = -(-lists // fan_in)
        by = ["query_id"] + ["shard"] * (lists > 1)
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("shard", (F.col("shard") / fan_in).cast("int")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if lists == 1:
            return found.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: rows whose vec_id is divisible by 50 ask all the other rows; five answers each."""
    rows = shared.table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("v"))
    return exact_topk(rows, rows.filter("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
