"""Retrieval for tables of queries: dense and lexical top-k, fusion, hydration."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import text as tx
from cairnfield.functions.text import terms

from . import bm25
from .stages import Stages

K1, B = 1.2, 0.75
RRF_K, PREFETCH, FRESH_DAYS = 60, 100, 7
#: Queries that a task multiplies at once, rows of a part of the chunks, and the bytes of vectors up to which queries are broadcast.
QUERY_BLOCK, PART_ROWS, BROADCAST_BYTES = 2000, 50_000, 64 << 20
#: Distinct terms of all queries, and pairs of a query and a term, up to which they travel to the chunks.
BROADCAST_TERMS, BROADCAST_ASKED = 1_000_000, 4_000_000


def top_per_query(scored: DataFrame, k: int, digits: int | None = 5, id_col: str = "chunk_id") -> DataFrame:
    """rank 1..k of each query by rounded score, then id: last-bit noise cannot change who is in."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    order = Window.partitionBy("query_id").orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit(vectors) -> np.ndarray:
    """Rows of equal length as a matrix of length-one rows (zero stays zero)."""
    m = np.stack(vectors).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def best_of_tile(query_ids, asked: np.ndarray, ids, rows: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, chunk_id, score): of each query the k best rows by rounded score, then id; scores that are no number are left out."""
    score = asked @ rows.T
    near = np.nan_to_num(np.round(score, 5), nan=-np.inf)
    # everything that rounds to the k-th best score or better stays until ties are settled by id
    cutoff = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(asked), -np.inf)
    r, c = np.nonzero((near >= cutoff[:, None]) & (near > -np.inf))
    order = np.lexsort((ids[c], -near[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    r, c = r[first], c[first]
    return pd.DataFrame({"query_id": np.asarray(query_ids)[r], "chunk_id": ids[c], "score": score[r, c]})


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, vec_col: str = "vec", dense_col: str = "dense", id_col: str = "id", blocks: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks of highest cosine in the query's vertical. Exact.

    While the vectors of the queries are few bytes (counted) they travel to the chunks as one matrix a vertical, and each chunk batch is
    multiplied with QUERY_BLOCK of them at a time; only its best k per query are shuffled. More queries are dealt out in blocks, which
    meet parts of the chunks of a bounded number of rows. Rows without a vector or a vertical take no part.
    DenseIndex (dense.py) gives the same rows and reads only clusters that can hold one of them.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", "industry", F.col(vec_col).cast("array<double>").alias("vec")).filter("vec is not null and industry is not null")
    rows = chunks.select(F.col(id_col).alias("chunk_id"), "industry", F.col(dense_col).cast("array<double>").alias("dense")).filter("dense is not null and industry is not null")
    kind = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)[id_col]
    schema = f"query_id {kind[0]}, chunk_id {kind[1]}, score double"
    n, width = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()

    def multiply(asked: dict, pdf: pd.DataFrame):
        for industry, part in pdf.groupby("industry"):
            if industry in asked:
                ids, m = asked[industry]
                mine, names = unit(part["dense"].to_numpy()), part["chunk_id"].to_numpy()
                for at in range(0, len(ids), QUERY_BLOCK):
                    yield best_of_tile(ids[at : at + QUERY_BLOCK], m[at : at + QUERY_BLOCK], names, mine, k)

    if n * width * 8 <= BROADCAST_BYTES:
        shipped = spark.sparkContext.broadcast(by_industry(q.toPandas()))  # bounded by the line above

        def run(batches):
            for pdf in batches:
                yield from multiply(shipped.value, pdf)

        scored = rows.mapInPandas(run, schema)
    else:
        n_blocks, n_parts = blocks or -(-n // QUERY_BLOCK), max(1, -(-rows.count() // PART_ROWS))
        each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        mine = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn("part", each(n_parts))
        dealt = rows.withColumn("block", each(n_blocks)).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(n_parts)).cast("int"))

        def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = list(multiply(by_industry(a), b))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

        scored = mine.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(tile, schema)
    return top_per_query(scored, k)


def by_industry(q: pd.DataFrame) -> dict:
    """{industry: (query ids, matrix)} of query rows."""
    return {industry: (part["query_id"].to_numpy(), unit(part["vec"].to_numpy())) for industry, part in q.groupby("industry")}


def term_counts(words: Column) -> Column:
    """array of (term, tf), one for each distinct term."""
    return tx.let(words, lambda all_: F.transform(F.array_distinct(all_), lambda w: F.struct(w.alias("term"), F.size(F.filter(all_, lambda x: x == w)).alias("tf"))))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """BM25's share of a term's count: rises with the count, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("industry").alias("q_industry"), F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, scope: str = "industry", id_col: str = "id", stages: Stages | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of the query's vertical by BM25 over text, any term matching.

    Statistics (number of chunks, mean length, document frequency) are those of the vertical, or with scope "corpus" of all. Texts are
    cut into terms once: one scan keeps of each chunk its length and the counts of the terms that are asked for, as a narrow table that
    statistics and scores read. Up to BROADCAST_TERMS terms and BROADCAST_ASKED pairs of a query and a term (counted) travel to the
    chunks, and a task gives its k best of each query (bm25.py); more are joined. An id stands for one chunk of a vertical.
    """
    stages = stages or Stages(chunks.sparkSession)
    asked = stages.keep(asked_terms(queries))
    docs = chunks.select(F.col(id_col).alias("chunk_id"), "industry", terms(F.col("text")).alias("t"))
    vocabulary = asked.select("term").distinct()
    if asked.count() > BROADCAST_ASKED or vocabulary.count() > BROADCAST_TERMS:
        return _joined_topk(asked, docs, vocabulary, k, scope, stages)
    words = vocabulary.toArrow().column("term").combine_chunks()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    counted = stages.keep(bm25.counted(docs, words))
    by = ["industry"] if scope == "industry" else []
    pairs = asked.toArrow()  # bounded, as counted above
    query, term, names = bm25.wanted(pairs, words)
    verticals = pairs.column("q_industry").to_pandas().to_numpy(dtype=object)
    whole, df = bm25.statistics(counted, by)
    if by:  # of each vertical only what is asked there
        known = pa.table({"industry": pairs.column("q_industry"), "term": pa.array(term, pa.int32())}).group_by(["industry", "term"]).aggregate([])
        known = chunks.sparkSession.createDataFrame(known.cast(pa.schema({"industry": pa.string(), "term": pa.int32()})))
        whole = whole.join(known.select("industry").distinct(), "industry", "left_semi")
        df = stages.keep(df).join(known, [*by, "term"], "left_semi")  # summed first: a stored table, as Spark would join first
    whole, df = whole.toArrow().to_pandas(), df.toArrow().to_pandas()
    ready = {}
    for vertical in set(verticals):
        mine = verticals == vertical if vertical is not None else np.array([v is None for v in verticals])
        n = whole[whole["industry"] == vertical] if by else whole
        of = (df[df["industry"] == vertical] if by else df).set_index("term")["df"].sort_index()
        if len(n) and len(of):
            n, avgdl = int(n["n"].iloc[0]), float(n["avgdl"].iloc[0])
            ready[vertical] = bm25.Asked(query[mine], term[mine], np.log(1 + (n - of + 0.5) / (of + 0.5)), of, n, avgdl)
    kind = dict(queries.dtypes)["query_id"]
    return top_per_query(bm25.scored(counted, ready, names, kind, k, K1, B), k)


def _joined_topk(asked: DataFrame, docs: DataFrame, vocabulary: DataFrame, k: int, scope: str, stages: Stages) -> DataFrame:
    """bm25_topk() where the asked terms are too many to travel: a row for each term of a chunk meets the queries that ask it."""
    rows = docs.select("chunk_id", "industry", F.size("t").alias("dl"), F.explode_outer(term_counts(F.col("t"))).alias("of"))
    known = vocabulary.withColumnRenamed("term", "__t")
    met = rows.join(known, F.col("of.term") == F.col("__t"), "left").withColumn("of", F.when(F.col("__t").isNotNull(), F.col("of")))
    counted = stages.keep(met.groupBy("chunk_id", "industry", "dl").agg(F.collect_list("of").alias("tfs")))  # a chunk's terms
    by = ["industry"] if scope == "industry" else []
    whole = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = counted.select("chunk_id", "industry", "dl", F.explode("tfs").alias("of")).select("chunk_id", "industry", "dl", "of.term", "of.tf")
    df = tf.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    stats = df.join(whole, by) if by else df.crossJoin(F.broadcast(whole))  # one row
    hits = tf.join(stats, [*by, "term"]).join(asked, "term").filter(F.col("q_industry").eqNullSafe(F.col("industry")))
    weight = idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    scored = hits.withColumn("w", weight).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))
    return top_per_query(scored, k)


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, top_k: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, rank, in_dense, in_lex): reciprocal ranks of both legs summed; a missing leg adds nothing."""
    legs = (df.select("query_id", "chunk_id", F.col("rank").alias(name)) for df, name in ((dense, "d"), (lexical, "l")))
    both = next(legs).join(next(legs), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.select("query_id", "chunk_id", (part("d") + part("l")).alias("score"), F.col("d").isNotNull().alias("in_dense"), F.col("l").isNotNull().alias("in_lex"))
    return top_per_query(scored, top_k, digits=9)


def hydrate(hits: DataFrame, chunks: DataFrame, as_of: datetime, id_col: str = "id") -> DataFrame:
    """Chunk columns and fresh (crawled within 7 days) for the few rows that survived the cut."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), "url", "title", "org", "source_type", "text", "crawled_at", "published_at")
    fresh = F.col("crawled_at").cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(FRESH_DAYS))
    return hits.join(rows, "chunk_id").withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def hybrid_search(queries: DataFrame, chunks: DataFrame, top_k: int, as_of: datetime, prefetch: int = PREFETCH) -> DataFrame:
    """Both legs, fused, with chunk columns. queries: query_id, query, industry, vec."""
    fused = rrf_fuse(dense_topk(queries, chunks, prefetch), bm25_topk(queries, chunks, prefetch), top_k=top_k)
    return hydrate(fused, chunks, as_of)


def pipeline_trace(fused: DataFrame, reranked: DataFrame | None = None) -> DataFrame:
    """Per query: rows of the returned list that each leg knew, all rows, and rows left after re-ranking."""
    trace = fused.groupBy("query_id").agg(F.count_if("in_dense").alias("dense"), F.count_if("in_lex").alias("bm25"), F.count(F.lit(1)).alias("fused"))
    left = (reranked if reranked is not None else fused).groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked"))
    return trace.join(left, "query_id", "left").withColumn("reranked", F.coalesce("reranked", F.lit(0)))
