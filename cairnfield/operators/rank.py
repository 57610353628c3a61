"""The tail of a search: pair scoring, recency, result rows, and the two tiers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.encoders import OverlapScorer
from cairnfield.functions.highlight import best_place, highlight

from .retrieve import dense_topk, hybrid_search, hydrate, top_per_query

# Fixed values of the recency prior.
RECENT_TYPES, HALF_LIFE_DAYS, MAX_BOOST = ("news",), 180.0, 0.05
RERANK_DEPTH = 50


def rerank_pairs(hits: DataFrame, scorer=None, top_k: int = 10, query_col: str = "query") -> DataFrame:
    """hits re-scored jointly with their query (logistic of the scorer's logit), the top_k of each query."""
    shipped = hits.sparkSession.sparkContext.broadcast(scorer or OverlapScorer())

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shipped.value
        for query, text in batches:
            yield pd.Series(1 / (1 + np.exp(-np.asarray(model.score(list(query), list(text)), dtype=float))))

    return top_per_query(hits.drop("rank").withColumn("score", score(F.col(query_col), F.col("text"))), top_k)


def recency_multiplier(source_type: Column, published_at: Column, as_of: datetime, max_boost: Column | float = MAX_BOOST, half_life: float = HALF_LIFE_DAYS) -> Column:
    """1 + boost, halved every half life, for dated rows of the recent types; 1 for others. The future counts as today."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(published_at.cast("timestamp"))) / 86_400e6
    boost = (F.lit(max_boost) if not isinstance(max_boost, Column) else max_boost) * F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / half_life)
    return F.when(source_type.isin(*RECENT_TYPES) & published_at.isNotNull(), 1 + boost).otherwise(F.lit(1.0))


def recency_prior(hits: DataFrame, as_of: datetime, max_boost: Column | float = MAX_BOOST, half_life: float = HALF_LIFE_DAYS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """hits with boosted scores and new ranks; equal scores keep their order."""
    boosted = hits.withColumn("score", F.col("score") * recency_multiplier(F.col("source_type"), F.col("published_at"), as_of, max_boost, half_life))
    return boosted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "rank")))


def format_results(hits: DataFrame) -> DataFrame:
    """Result rows: rank, url, title (else the URL), org, source_type, score, highlight, fresh, published_at as text."""
    title = F.trim(F.coalesce("title", F.lit("")))
    hits = hits.withColumn("__best", best_place(F.col("query"), F.col("text")))
    return hits.select(
        "query_id", "rank", "url", F.when(title != "", F.col("title")).otherwise(F.col("url")).alias("title"), "org", "source_type",
        F.round("score", 4).alias("score"), highlight(F.col("query"), F.col("text"), best=F.col("__best")).alias("highlight"), "fresh",
        F.date_format("published_at", "yyyy-MM-dd").alias("published_at"),
    )


def _asked(hits: DataFrame, queries: DataFrame) -> DataFrame:
    return hits.join(queries.select("query_id", "query"), "query_id")


def search_fast(queries: DataFrame, chunks: DataFrame, top_k: int, as_of: datetime) -> DataFrame:
    """Dense, recency, result rows."""
    hits = hydrate(dense_topk(queries, chunks, top_k), chunks, as_of)
    return format_results(_asked(recency_prior(hits, as_of), queries))


def search_quality(queries: DataFrame, chunks: DataFrame, top_k: int, as_of: datetime, scorer=None, depth: int = RERANK_DEPTH) -> DataFrame:
    """Hybrid, pair scoring, recency, result rows."""
    hits = _asked(hybrid_search(queries, chunks, depth, as_of), queries)
    return format_results(recency_prior(rerank_pairs(hits, scorer, top_k), as_of))
