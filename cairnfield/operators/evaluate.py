"""Evaluation of runs by source domain, and the gate for a release."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.urls import source_domain

from .rank import recency_prior
from .retrieve import dense_topk

MIN_GAIN, TOLERANCE = 0.005, 1e-9


def domain_ranking(run: DataFrame, k: int) -> DataFrame:
    """(run, query_id, domain, rank): each domain at its best place, ranked anew, the first k."""
    best = run.withColumn("domain", source_domain(F.col("url"))).groupBy("run", "query_id", "domain").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("run", "query_id").orderBy("best", "domain")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("best")


def score_queries(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(run, query_id, ndcg, mrr, recall, first_rank) for every query of qrels (id, relevant) in every run; misses score 0."""
    wanted = qrels.select(F.col("id").alias("query_id"), F.array_distinct(F.transform("relevant", source_domain)).alias("domains"))
    ranked = domain_ranking(run, k)
    runs = run.select("run").distinct()
    pairs = wanted.select("query_id", F.explode("domains").alias("domain"))
    hits = ranked.join(pairs, ["query_id", "domain"]).groupBy("run", "query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("found"))
    n = F.size("domains")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i.cast("double") + 1))
    every = wanted.crossJoin(F.broadcast(runs)).join(hits, ["run", "query_id"], "left")  # runs: a name each
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "run", "query_id", F.when(n > 0, zero(F.col("dcg") / ideal)).otherwise(0.0).alias("ndcg"), zero(1 / F.col("first_rank")).alias("mrr"),
        F.when(n > 0, zero(F.col("found") / n)).otherwise(0.0).alias("recall"), "first_rank",
    )


def report(scores: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Mean figures of each run (and vertical, if `by` names it)."""
    return scores.groupBy(*by).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("ndcg", "mrr", "recall")), F.count(F.lit(1)).alias("queries"))


def breakdown(scores: DataFrame) -> DataFrame:
    return scores.orderBy("run", "query_id")


def model_run(queries: DataFrame, chunks: DataFrame, model: str, k: int = 10) -> DataFrame:
    """A run by exact dense ranking with one model's vectors, max(3k, 30) deep."""
    hits = dense_topk(queries, chunks, max(3 * k, 30))
    return hits.join(chunks.select(F.col("id").alias("chunk_id"), "url"), "chunk_id").select(F.lit(model).alias("run"), "query_id", "rank", "url", "score")


def ship_verdict(reports: DataFrame, base: str, candidate: str) -> DataFrame:
    """(base, candidate, gain, ship): nDCG rises by 0.005 or more, MRR and recall do not fall."""
    a = reports.filter(F.col("run") == base).select(*(F.col(c).alias(f"b_{c}") for c in ("ndcg", "mrr", "recall")))
    b = reports.filter(F.col("run") == candidate).select("ndcg", "mrr", "recall")
    ship = (F.col("ndcg") >= F.col("b_ndcg") + MIN_GAIN) & (F.col("mrr") >= F.col("b_mrr") - TOLERANCE) & (F.col("recall") >= F.col("b_recall") - TOLERANCE)
    return b.crossJoin(F.broadcast(a)).select(F.lit(base).alias("base"), F.lit(candidate).alias("candidate"), (F.col("ndcg") - F.col("b_ndcg")).alias("gain"), ship.alias("ship"))  # one row each


def boost_sweep(hits: DataFrame, qrels: DataFrame, boosts: list[float], as_of: datetime, k: int = 10) -> DataFrame:
    """The report of each max_boost over one shared retrieval. hits: query_id, rank, url, score, source_type, published_at."""
    values = F.explode(F.array(*map(F.lit, boosts)))
    many = hits.withColumn("boost", values)
    run = recency_prior(many, as_of, F.col("boost"), by=("boost", "query_id")).withColumn("run", F.col("boost").cast("string"))
    return report(score_queries(run, qrels, k))
