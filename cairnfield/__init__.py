"""Set-at-a-time Spark jobs for curated document search: indexing, retrieval, evaluation."""
