"""Training data of retrieval models: prompts per chunk, and pairs from the replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import parse_synth_queries

PASSAGE_CHARS = 4000
PROMPT = 'Passage:\n"""\n%s\n"""\n\nWrite %d different search queries that this passage answers. Reply only with a JSON array of strings.'


def synth_prompts(chunks: DataFrame, n: int = 3) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), "url", F.format_string(PROMPT, F.substring("text", 1, PASSAGE_CHARS), F.lit(n)).alias("prompt"))


def build_pairs(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, chunk_id, url, positive): one row for each query that a reply (chunk_id, content) gives."""
    asked = replies.select("chunk_id", F.explode(parse_synth_queries(F.col("content"))).alias("query"))
    return asked.join(chunks.select(F.col("id").alias("chunk_id"), "url", F.col("text").alias("positive")), "chunk_id").select("query", "chunk_id", "url", "positive")
