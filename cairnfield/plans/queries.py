"""The registered queries over the corpus operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from cairnfield.functions import dates, text, urls
from cairnfield.functions.encoders import QUERY_INSTRUCTION
from cairnfield.functions.highlight import highlight
from cairnfield.operators import answers, dense, embed, evaluate, index, lexical, pages, rank, registry, retrieve, train
from cairnfield.operators.chunking import spread
from cairnfield.operators.stages import Stages, shared_dir
from cairnfield.sources import snapshots
from cairnfield.streaming import ingest

from . import bindings as b

QUERIES: dict = {}
ORACLES: dict = {}
AS_OF_SQL = "TIMESTAMP '2001-08-02'"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------ text and chunks


@query(f"SELECT doc_id, sha256({b.norm_sql('text')}) AS clean_hash, length({b.norm_sql('text')})::INT AS n_chars FROM documents")
def clean_text(spark, d):
    clean = text.normalize_text(F.coalesce("text", F.lit("")))
    return spread(b.table(spark, d, "documents")).withColumn("c", clean).select("doc_id", text.content_hash(F.col("c")).alias("clean_hash"), F.length("c").alias("n_chars"))


@query(f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')} SELECT id, url, ordinal, begin_char, end_char, token_count, content_hash FROM c")
def chunk_windows(spark, d):
    return b.chunks(spark, d).select("id", "url", "ordinal", "begin_char", "end_char", "token_count", "content_hash")


# ------------------------------------------------------------------------------ retrieval


@query(
    f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')}, corpus AS (SELECT * REPLACE ('all' AS industry) FROM c), q AS (SELECT item_id AS query_id, text AS query, 'all' AS industry FROM benchmark), "
    f"{b.bm25_sql('r', 'q', 'corpus', 10, None)} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 4) AS score FROM r"
)
def bm25_topk(spark, d):
    """Which passages match each benchmark text."""
    asked = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("all").alias("industry"))
    found = retrieve.bm25_topk(asked, b.chunks(spark, d).withColumn("industry", F.lit("all")), 10, scope="corpus")
    return found.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(
    "WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS h FROM embeddings), n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS l FROM v), "
    "u AS (SELECT vec_id, unnest(h) AS x, generate_subscripts(h, 1) AS dim, l FROM n) SELECT vec_id, dim::INT AS dim, round(x / l, 6) AS x FROM u"
)
def matryoshka_32(spark, d):
    v = b.table(spark, d, "embeddings").select("vec_id", F.posexplode(text.truncate_normalize(F.col("embedding"), 32)).alias("dim", "x"))
    return v.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("x"))


@query(f"WITH {b.VECTORS}, {b.dense_sql('r', 10)} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 4) AS score FROM r")
def dense_topk(spark, d):
    return retrieve.dense_topk(b.vector_queries(spark, d), b.vectors(spark, d), 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(ORACLES["dense_topk"])
def dense_index(spark, d):
    """The same question to a stored index by clusters, of which only those are read that can hold a result."""
    store = dense.DenseIndex(spark, f"{shared_dir(spark)}/dense-{uuid.uuid4().hex}").build(b.vectors(spark, d))
    return store.topk(b.vector_queries(spark, d), 10)[0].select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(ORACLES["bm25_topk"])
def lexical_index(spark, d):
    """The same question to an index that was filled by one crawl and brought up to date by the next."""
    store = lexical.LexicalIndex(spark, f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}", parts=8)
    old, new = (side.withColumn("industry", F.lit("all")) for side in _sides(spark, d))
    store.update(0, old, index.diff_chunks(old.limit(0), old))
    store.update(1, new, index.diff_chunks(old, new))
    asked = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("all").alias("industry"))
    return store.topk(asked, 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def _fused(spark, d):
    asked, corpus = b.vector_queries(spark, d), b.vectors(spark, d)
    return retrieve.rrf_fuse(retrieve.dense_topk(asked, corpus, 100), retrieve.bm25_topk(asked, corpus, 100), top_k=50)


_FUSED = f"""{b.VECTORS}, {b.dense_sql("dn", 100)}, {b.bm25_sql("lx", "asked", "vectors", 100, "industry")},
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, coalesce(1.0 / (60 + dn.rank), 0)::DOUBLE + coalesce(1.0 / (60 + lx.rank), 0)::DOUBLE AS score, dn.rank IS NOT NULL AS in_dense, lx.rank IS NOT NULL AS in_lex
  FROM dn FULL OUTER JOIN lx USING (query_id, chunk_id))) WHERE rank <= 50)"""


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score, in_dense, in_lex FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "in_dense", "in_lex")


@query(f"WITH {_FUSED} SELECT query_id, count(*) FILTER (in_dense) AS dense, count(*) FILTER (in_lex) AS bm25, count(*) AS fused, least(count(*), 10) AS reranked FROM fused GROUP BY 1")
def hybrid_trace(spark, d):
    fused = retrieve.hybrid_search(b.vector_queries(spark, d), b.dated_vectors(spark, d), 50, b.AS_OF)
    hits = fused.join(b.vector_queries(spark, d).select("query_id", "query"), "query_id")
    return retrieve.pipeline_trace(fused, rank.rerank_pairs(hits, top_k=10))


_BOOST = f"CASE WHEN source_type = 'news' AND published_at IS NOT NULL THEN 1 + {{boost}} * pow(0.5, greatest(epoch({AS_OF_SQL} - published_at) / 86400.0, 0) / 180.0) ELSE 1.0 END"


@query(
    f"WITH {b.VECTORS}, {b.dense_sql('r', 50)}, s AS (SELECT query_id, chunk_id, rank, score * {_BOOST.format(boost='0.05')} AS score FROM r JOIN vectors ON chunk_id = id) "
    "SELECT query_id, chunk_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank)::INT AS rank FROM s"
)
def recency_prior(spark, d):
    hits = retrieve.hydrate(retrieve.dense_topk(b.vector_queries(spark, d), b.vectors(spark, d), 50), b.dated_vectors(spark, d), b.AS_OF)
    return rank.recency_prior(hits, b.AS_OF).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


#: Result rows of hits r (query_id, chunk_id, rank, score): boosted, ranked, as format_results gives them.
_RESULTS = f"""shown AS (SELECT query_id, chunk_id, query, text FROM r JOIN (SELECT id, text FROM vectors) ON chunk_id = id JOIN (SELECT query_id, query FROM asked) USING (query_id)), {b.highlight_sql('hl', 'shown')},
boosted AS (SELECT query_id, chunk_id, rank AS was, score * {_BOOST.format(boost='0.05')} AS score, url, source_type, published_at FROM r JOIN vectors ON chunk_id = id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, was)::INT AS rank, url, 'Vector ' || chunk_id AS title, NULL::VARCHAR AS org, source_type, round(score, 4) AS score,
       coalesce(published_at >= {AS_OF_SQL} - INTERVAL 7 DAY, false) AS fresh, strftime(published_at, '%Y-%m-%d') AS published_at, highlight FROM boosted JOIN hl USING (query_id, chunk_id)"""


@query(f"WITH {b.VECTORS}, {b.dense_sql('r', 10)}, {_RESULTS}")
def search_fast(spark, d):
    return rank.search_fast(b.vector_queries(spark, d), b.dated_vectors(spark, d), 10, b.AS_OF)


_SHARE = f"len(list_intersect(list_distinct({b.terms_sql('query')}), list_distinct({b.terms_sql('text')}))) / len(list_distinct({b.terms_sql('query')}))"


@query(
    f"WITH {_FUSED}, pairs AS (SELECT query_id, chunk_id, 1 / (1 + exp(-(CASE WHEN len({b.terms_sql('query')}) = 0 THEN -4 ELSE 8 * {_SHARE} - 4 END))) AS score FROM fused JOIN (SELECT id, text FROM vectors) ON chunk_id = id JOIN (SELECT query_id, query FROM asked) USING (query_id)), "
    f"r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, chunk_id) AS rank FROM pairs) WHERE rank <= 10), {_RESULTS}"
)
def search_quality(spark, d):
    return rank.search_quality(b.vector_queries(spark, d), b.dated_vectors(spark, d), 10, b.AS_OF)


@query(f"WITH {b.VECTORS}, {b.dense_sql('r', 10)}, shown AS (SELECT query_id, chunk_id, query, text FROM r JOIN (SELECT id, text FROM vectors) ON chunk_id = id JOIN (SELECT query_id, query FROM asked) USING (query_id)), {b.highlight_sql('hl', 'shown')} SELECT query_id, chunk_id, query, text, highlight FROM shown JOIN hl USING (query_id, chunk_id)")
def highlights(spark, d):
    """The highlight of each result of the fast search, with the texts it comes from."""
    hits = retrieve.hydrate(retrieve.dense_topk(b.vector_queries(spark, d), b.vectors(spark, d), 10), b.dated_vectors(spark, d), b.AS_OF)
    asked = hits.join(b.vector_queries(spark, d).select("query_id", "query"), "query_id")
    return asked.select("query_id", "chunk_id", "query", "text", highlight(F.col("query"), F.col("text")).alias("highlight"))


#: In the middle of the dates, so that some rows are fresh.
_FRESH = datetime(1996, 7, 1)


@query(
    f"WITH {_FUSED} SELECT query_id, chunk_id, fused.rank::INT AS rank, round(score, 6) AS score, in_dense, in_lex, url, 'Vector ' || chunk_id AS title, source_type, sha256(text) AS text_hash, "
    "strftime(published_at, '%Y-%m-%d') AS published_at, strftime(published_at, '%Y-%m-%d') AS crawled_at, coalesce(published_at >= TIMESTAMP '1996-06-24', false) AS fresh FROM fused JOIN vectors ON chunk_id = id"
)
def hybrid_search(spark, d):
    out = retrieve.hybrid_search(b.vector_queries(spark, d), b.dated_vectors(spark, d), 50, _FRESH)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "in_dense", "in_lex", "url", "title", "source_type", text.content_hash(F.col("text")).alias("text_hash"), day("published_at"), day("crawled_at"), "fresh")


def _embedded_sql(key: str, col: str, source: str) -> str:
    """Digest of the default encoder's vectors of the texts col of source."""
    return (
        f"WITH t AS (SELECT {key}, {b.terms_sql(col)} AS t FROM {source}), h AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest(t) AS w FROM t)), "
        f"v AS (SELECT {key}, (h % 256)::INT AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL), n AS (SELECT {key}, sqrt(sum(x * x)) AS l, max(x) FILTER (i = 0) AS x0, sum(i * sign(x))::BIGINT AS signs, count(*) FILTER (x <> 0) AS filled FROM v GROUP BY 1) "
        f"SELECT {key}, 256 AS dim, CASE WHEN l > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm2, coalesce(filled, 0)::BIGINT AS filled, coalesce(signs, 0)::BIGINT AS signs, round(CASE WHEN l > 0 THEN coalesce(x0, 0) / l ELSE 0 END, 4) AS first FROM t LEFT JOIN n USING ({key})"
    )


def _digest(rows, key: str, vec: str):
    v = F.col(vec)
    norm2 = F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2")
    filled = F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("filled")
    signs = F.aggregate(F.transform(v, lambda x, i: i * F.signum(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("signs")
    return rows.select(key, F.size(v).alias("dim"), norm2, filled, signs, F.round(F.element_at(v, 1).cast("double"), 4).alias("first"))


@query(_embedded_sql("doc_id", "text", "documents"))
def embed_documents(spark, d):
    """Vectors of all documents by the default encoder: squared length, filled components, weighted signs, first component."""
    return _digest(embed.embed_docs(b.table(spark, d, "documents").select("doc_id", "text")), "doc_id", "dense")


@query(_embedded_sql("item_id", f"'Instruct: {QUERY_INSTRUCTION} Query: ' || text", "benchmark"))
def embed_queries(spark, d):
    """Vectors of all benchmark texts as queries, which carry the instruction."""
    return _digest(embed.embed_queries(b.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))), "item_id", "vec")


# ------------------------------------------------------------------------------ evaluation


def _runs(spark, d):
    """Two models: the whole vectors, and their first 32 components."""
    asked, corpus = b.vector_queries(spark, d), b.vectors(spark, d)
    short = lambda df, c: df.withColumn(c, text.truncate_normalize(F.col(c), 32))
    return evaluate.model_run(asked, corpus, "full").unionByName(evaluate.model_run(short(asked, "vec"), short(corpus, "dense"), "short"))


def _scores_sql(run: str, k: int = 10) -> str:
    """run: run, query_id, url, rank; relevant is the label's domain."""
    return f"""dom AS (SELECT run, query_id, regexp_extract(url, '//([^/]+)', 1) AS domain, min(rank) AS best FROM {run} GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY best, domain) AS rank FROM dom) WHERE rank <= {k}),
scores AS (SELECT r.run, q.query_id, coalesce(sum(1 / log2(rank + 1)), 0) AS ndcg, coalesce(1.0 / min(rank), 0)::DOUBLE AS mrr, count(rank)::DOUBLE AS recall, min(rank)::INT AS first_rank
  FROM asked q CROSS JOIN (SELECT DISTINCT run FROM {run}) r LEFT JOIN ranked k ON k.run = r.run AND k.query_id = q.query_id AND domain = 'label' || label || '.example.org' GROUP BY r.run, q.query_id)"""


_RUNS = f"{b.VECTORS}, {b.dense_sql('f', 30)}, {b.dense_sql('s', 30, 32)}, runs AS (SELECT 'full' AS run, query_id, url, rank FROM f JOIN vectors ON chunk_id = id UNION ALL SELECT 'short', query_id, url, rank FROM s JOIN vectors ON chunk_id = id), {_scores_sql('runs')}"
_REPORT = "report AS (SELECT run, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(recall) AS recall, count(*) AS queries FROM scores GROUP BY run)"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 5) for c in cols})


@query(f"WITH {_RUNS} SELECT run, query_id, round(ndcg, 5) AS ndcg, round(mrr, 5) AS mrr, round(recall, 5) AS recall, first_rank FROM scores")
def eval_per_query(spark, d):
    return _rounded(evaluate.score_queries(_runs(spark, d), b.vector_qrels(spark, d)), "ndcg", "mrr", "recall")


@query(f"WITH {_RUNS}, {_REPORT} SELECT run, round(ndcg, 5) AS ndcg, round(mrr, 5) AS mrr, round(recall, 5) AS recall, queries FROM report")
def eval_report(spark, d):
    return _rounded(evaluate.report(evaluate.score_queries(_runs(spark, d), b.vector_qrels(spark, d))), "ndcg", "mrr", "recall")


@query(
    f"WITH {_RUNS}, {_REPORT} SELECT 'short' AS base, 'full' AS candidate, round(c.ndcg - a.ndcg, 5) AS gain, c.ndcg >= a.ndcg + 0.005 AND c.mrr >= a.mrr - 1e-9 AND c.recall >= a.recall - 1e-9 AS ship "
    "FROM report a, report c WHERE a.run = 'short' AND c.run = 'full'"
)
def ship_verdict(spark, d):
    reports = evaluate.report(evaluate.score_queries(_runs(spark, d), b.vector_qrels(spark, d)))
    return _rounded(evaluate.ship_verdict(reports, "short", "full"), "gain")


_BOOSTS = (0.05, 0.1, 0.15)


@query(
    f"WITH {b.VECTORS}, {b.dense_sql('f', 50)}, boosted AS (SELECT boost::VARCHAR AS run, query_id, url, rank AS was, score * {_BOOST.format(boost='boost')} AS score FROM f JOIN vectors ON chunk_id = id, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) v(boost)), "
    f"runs AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY round(score, 12) DESC, was) AS rank FROM boosted), {_scores_sql('runs')}, {_REPORT} "
    "SELECT run, round(ndcg, 5) AS ndcg, round(mrr, 5) AS mrr, round(recall, 5) AS recall, queries FROM report"
)
def boost_sweep(spark, d):
    hits = retrieve.hydrate(retrieve.dense_topk(b.vector_queries(spark, d), b.vectors(spark, d), 50), b.dated_vectors(spark, d), b.AS_OF)
    return _rounded(evaluate.boost_sweep(hits, b.vector_qrels(spark, d), list(_BOOSTS), b.AS_OF), "ndcg", "mrr", "recall")


# ------------------------------------------------------------------------------ index maintenance

_INDEX = f"{b.DOCS}, {b.OLD_DOCS}, {b.chunks_sql('new_c', 'docs')}, {b.chunks_sql('old_c', 'old_docs')}"
_DIFF = f"""{_INDEX}, diff AS (
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.url, o.url) AS url, coalesce(n.industry, o.industry) AS industry,
         CASE WHEN n.id IS NULL THEN 'vanished' WHEN o.id IS NULL THEN 'new' WHEN n.content_hash = o.content_hash THEN 'unchanged' ELSE 'changed' END AS state
  FROM new_c n FULL OUTER JOIN (SELECT * FROM old_c WHERE (url, industry) IN (SELECT (url, industry) FROM new_c)) o ON n.id = o.id AND n.industry = o.industry)"""


def _sides(spark, d):
    """The index before the crawl and the chunks of the crawl, as written tables."""
    stages = Stages(spark)
    return stages.keep(b.index_of(b.old_docs(spark, d))), stages.keep(b.index_of(b.docs(spark, d)))


@query(f"WITH {_DIFF} SELECT id, url, state FROM diff")
def chunk_diff(spark, d):
    return index.diff_chunks(*_sides(spark, d)).select("id", "url", "state")


def _upserted(spark, d):
    old, new = _sides(spark, d)
    diff = index.diff_chunks(old, new)
    written = new.join(diff.filter(F.col("state").isin("new", "changed")).select("id", "industry"), ["id", "industry"], "left_semi")
    return index.prune_vanished(index.upsert_chunks(old, written, b.AS_OF), diff)


_UPSERTED = f"""{_DIFF}, upserted AS (
  SELECT n.id, n.url, n.industry, n.source_url, n.content_hash, n.published_at, {AS_OF_SQL} AS crawled_at FROM new_c n JOIN diff USING (id, industry) WHERE state IN ('new', 'changed')
  UNION ALL SELECT id, url, industry, source_url, content_hash, published_at, TIMESTAMP '2001-07-01' FROM old_c WHERE id NOT IN (SELECT id FROM diff WHERE state <> 'unchanged'))"""


@query(f"WITH {_UPSERTED} SELECT id, url, content_hash, strftime(published_at, '%Y-%m-%d') AS published_at, strftime(crawled_at, '%Y-%m-%d') AS crawled_at FROM upserted")
def index_upsert(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _upserted(spark, d).select("id", "url", "content_hash", day("published_at"), day("crawled_at"))


@query(
    f"WITH {_UPSERTED}, stamps AS (SELECT url, max(published_at) AS date FROM docs WHERE published_at IS NOT NULL GROUP BY 1) "
    "SELECT id, strftime(coalesce(date, published_at), '%Y-%m-%d') AS published_at FROM upserted LEFT JOIN stamps USING (url)"
)
def stamp_dates(spark, d):
    return index.stamp_published_at(_upserted(spark, d), b.docs(spark, d).select("url", "published_at")).select("id", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"))


@query(
    f"WITH {_INDEX}, runs AS (SELECT DISTINCT source_url, industry FROM docs WHERE o_orderstatus <> 'O'), ok AS (SELECT DISTINCT source_url, industry, url FROM docs WHERE o_orderstatus <> 'O') "
    "SELECT id FROM old_c WHERE (source_url, industry) NOT IN (SELECT (source_url, industry) FROM runs) OR (source_url, industry, url) IN (SELECT (source_url, industry, url) FROM ok)"
)
def page_prune(spark, d):
    """Pages of orders that are still open count as not fetched in this run."""
    fetched = b.docs(spark, d).filter("o_orderstatus <> 'O'")
    return index.prune_pages(_sides(spark, d)[0], fetched, fetched).select("id")


@query(f"WITH {_DIFF} SELECT url, industry, count(*) FILTER (state IN ('new', 'changed')) AS changed, count(*) FILTER (state = 'unchanged') AS skipped, count(*) FILTER (state = 'vanished') AS removed, count(*) FILTER (state <> 'vanished') AS chunks FROM diff GROUP BY ALL")
def page_results(spark, d):
    return index.page_results(index.diff_chunks(*_sides(spark, d)))


@query(
    f"WITH {_DIFF}, p AS (SELECT url, industry, count(*) FILTER (state IN ('new', 'changed')) AS changed, count(*) FILTER (state = 'unchanged') AS skipped, count(*) FILTER (state = 'vanished') AS removed, count(*) FILTER (state <> 'vanished') AS chunks FROM diff GROUP BY ALL), "
    "r AS (SELECT * FROM p JOIN (SELECT url, source_url, any_value(o_orderstatus) AS s FROM docs GROUP BY ALL) USING (url)) "
    "SELECT source_url, count(*) FILTER (s IS DISTINCT FROM 'O') AS indexed_pages, count(*) FILTER (s = 'P') AS not_modified, sum(chunks)::BIGINT AS chunks, sum(changed)::BIGINT AS changed, sum(skipped)::BIGINT AS skipped, sum(removed)::BIGINT AS removed, "
    "count(*) FILTER (s = 'O') AS n_errors, sha256(coalesce(array_to_string(list_sort(list(url || ': open') FILTER (s = 'O')), ','), '')) AS errors_hash, count(*) FILTER (s IS DISTINCT FROM 'O') > 0 OR count(*) FILTER (s = 'P') > 0 AS ok FROM r GROUP BY ROLLUP (source_url)"
)
def run_rollup(spark, d):
    """Pages of open orders have failed, those of status P were not modified."""
    state = F.coalesce("o_orderstatus", F.lit(""))
    of = b.docs(spark, d).select("url", "source_url", state.alias("s")).distinct()
    rows = index.page_results(index.diff_chunks(*_sides(spark, d))).join(of, "url")
    rows = rows.withColumns({"ok": F.col("s") != "O", "not_modified": F.col("s") == "P", "error": F.when(F.col("s") == "O", F.lit("open"))})
    out = index.run_rollup(Stages(spark).keep(rows))
    return out.select("source_url", "indexed_pages", "not_modified", "chunks", "changed", "skipped", "removed", "n_errors", F.col("errors_sha256").alias("errors_hash"), "ok")


@query(
    f"WITH {_INDEX}, seeds AS (SELECT DISTINCT source_url, industry FROM docs) "
    "SELECT 'removed' AS kind, s.source_url AS name, s.industry, count(id) AS n FROM seeds s LEFT JOIN old_c o ON o.source_url = s.source_url AND o.industry = s.industry WHERE s.industry = 'de' GROUP BY ALL "
    "UNION ALL SELECT 'chunk', id, industry, 1 FROM old_c WHERE industry IS DISTINCT FROM 'de' UNION ALL SELECT 'source', source_url, industry, 1 FROM seeds WHERE industry IS DISTINCT FROM 'de'"
)
def delete_source(spark, d):
    """All German seeds go: chunks removed for each, and the chunks and sources that are left."""
    sources = b.docs(spark, d).select(F.col("source_url").alias("url"), "industry").distinct()
    left, known, removed = index.delete_source(_sides(spark, d)[0], sources, sources.filter("industry = 'de'"))
    one = lambda df, kind, c, n: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "industry", n.cast("long").alias("n"))
    return one(removed, "removed", "source_url", F.col("removed")).union(one(left, "chunk", "id", F.lit(1))).union(one(known, "source", "url", F.lit(1)))


@query(f"WITH {_INDEX} SELECT id FROM old_c WHERE url NOT IN (SELECT url FROM docs WHERE source_type = 'news')")
def delete_url(spark, d):
    return index.delete_url(_sides(spark, d)[0], b.docs(spark, d).filter("source_type = 'news'")).select("id")


_CRAWLED = (
    f"WITH {_UPSERTED}, ok AS (SELECT DISTINCT source_url, industry, url FROM docs WHERE text IS NOT NULL AND {b.norm_sql('text')} <> ''), fetched AS (SELECT DISTINCT source_url, industry FROM docs WHERE text IS NOT NULL), "
    f"stamps AS (SELECT url, max(published_at) AS date FROM docs WHERE published_at IS NOT NULL AND text IS NOT NULL AND {b.norm_sql('text')} <> '' GROUP BY 1) "
    "SELECT id, url, content_hash, strftime(coalesce(date, published_at), '%Y-%m-%d') AS published_at, strftime(crawled_at, '%Y-%m-%d') AS crawled_at FROM upserted u LEFT JOIN stamps USING (url) "
    "WHERE NOT EXISTS (FROM fetched f WHERE f.source_url = u.source_url AND f.industry = u.industry) OR EXISTS (FROM ok o WHERE o.source_url = u.source_url AND o.industry = u.industry AND o.url = u.url)"
)
#: Counts of a page's chunks, and what it failed of.
_PAGE_RESULTS = (
    f"WITH {_DIFF}, p AS (SELECT url, industry, count(*) FILTER (state IN ('new', 'changed')) AS changed, count(*) FILTER (state = 'unchanged') AS skipped, count(*) FILTER (state = 'vanished') AS removed, count(*) FILTER (state <> 'vanished') AS chunks FROM diff GROUP BY ALL) "
    "SELECT url, coalesce(changed, 0) AS changed, coalesce(skipped, 0) AS skipped, coalesce(removed, 0) AS removed, coalesce(chunks, 0) AS chunks, coalesce(chunks, 0) > 0 AS ok, "
    "CASE WHEN text IS NULL THEN 'crawl failed' WHEN coalesce(chunks, 0) = 0 THEN 'empty after cleaning' END AS error FROM docs LEFT JOIN p USING (url, industry)"
)


def _crawl(docs):
    """docs as what a crawl fetched; documents without text are failures."""
    return docs.withColumns({"ok": F.col("text").isNotNull(), "error": F.lit(None).cast("string")})


def _chunk_days(index):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return index.select("id", "url", "content_hash", day("published_at"), day("crawled_at"))


def _incremental(spark, d):
    stages = Stages(spark)
    old = stages.keep(embed.embed_docs(b.index_of(b.old_docs(spark, d))))
    return index.incremental_index(old, _crawl(b.docs(spark, d)), b.AS_OF, size=b.SIZE, overlap=b.OVERLAP, stages=stages)


@query(_CRAWLED)
def incremental_index(spark, d):
    """The composed job over all documents as a crawl."""
    return _chunk_days(_incremental(spark, d)[0])


@query(_PAGE_RESULTS)
def incremental_results(spark, d):
    """What the composed job says of each page."""
    return _incremental(spark, d)[1].select("url", "changed", "skipped", "removed", "chunks", "ok", "error")


@query(_CRAWLED)
def bucketed_index(spark, d):
    """Two crawls over the index on disk, which rewrite only the buckets that change; what a reader then sees."""
    store = snapshots.BucketedIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", buckets=8)
    for version, (docs, as_of) in enumerate(((b.old_docs(spark, d), datetime(2001, 7, 1)), (b.docs(spark, d), b.AS_OF))):
        with Stages(spark) as stages:
            index.update_index(store, version, stages.keep(_crawl(docs).drop("o_orderstatus", "doc_id")), as_of, size=b.SIZE, overlap=b.OVERLAP, stages=stages)
    return _chunk_days(store.read())


_LAST_VERSIONS = b.DOCS.replace("docs AS (", "given AS (") + ", docs AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 2 THEN text ELSE 'Earlier version . ' || text END AS text) FROM given)"


@query(f"WITH {_LAST_VERSIONS}, {b.chunks_sql('c', 'docs')} SELECT id, url, content_hash FROM c")
def ingest_stream(spark, d):
    """All documents as a stream of page versions in three batches; the index that it leaves.

    Every page first has an earlier version. Then two of three get their text. Then one of those goes back to the earlier version, the other
    one has a version from in between come late, and the third's fetch fails.
    """
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    crawl = Stages(spark).keep(_crawl(b.docs(spark, d)).withColumn("part", F.col("doc_id") % 3).drop("o_orderstatus", "doc_id"))

    def version(part, day, text, ok=None):
        rows = crawl.filter(part).withColumn("text", text).withColumns({"fetched_at": F.lit(datetime(2001, 8, day)).cast("timestamp"), "version_id": F.xxhash64("text")})
        return rows.withColumn("ok", F.lit(ok) if ok is not None else F.col("ok")).drop("part")

    earlier, now = F.concat(F.lit("Earlier version . "), "text"), F.col("text")
    batches = (
        version("true", 1, earlier),
        version("part > 0", 4, now),
        version("part = 1", 5, earlier).unionByName(version("part = 2", 2, F.concat(F.lit("Out of date . "), "text"))).unionByName(version("part = 0", 5, now, ok=False)),
    )
    for batch in batches:
        batch.write.mode("append").parquet(f"{path}/feed")
        feed = spark.readStream.schema(batch.schema).parquet(f"{path}/feed")
        ingest.ingest_stream(feed, f"{path}/index", f"{path}/checkpoint", buckets=8, size=b.SIZE, overlap=b.OVERLAP).awaitTermination()
    return ingest.latest_snapshot(spark, f"{path}/index").select("id", "url", "content_hash")


# ------------------------------------------------------------------------------ sources


@query(f"WITH {b.SOURCES} SELECT url, source_type, cadence FROM sources WHERE last_crawl IS NULL OR last_crawl < TIMESTAMP '1998-12-01' - CASE cadence WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 24 HOUR WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END")
def sources_due(spark, d):
    return registry.sources_due(b.sources(spark, d), datetime(1998, 12, 1)).select("url", "source_type", "cadence")


@query(f"WITH {b.SOURCES} SELECT url, source_type FROM sources WHERE industry = 'BUILDING'")
def list_sources(spark, d):
    return registry.list_sources(b.sources(spark, d), "BUILDING").select("url", "source_type")


def _outcomes(spark, d):
    """The latest event of each user as the outcome of the crawl of the source of that number."""
    e = b.table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m"))
    named = b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("url"))
    kind = F.col("m.event_type")
    return e.join(named, "user_id").select("url", (kind != "error").alias("ok"), (kind == "click").alias("not_modified"), F.floor("m.value").cast("int").alias("pages"), F.floor(F.col("m.value") * 2).cast("int").alias("chunks"), F.when(kind == "error", F.lit("crawl failed")).alias("error"), F.lit("e1").alias("etag"), F.lit(None).cast("string").alias("last_modified"))


@query(
    f"WITH {b.SOURCES}, e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) "
    f"SELECT url, CASE WHEN kind IS NULL THEN 'idle' WHEN kind = 'error' THEN 'error' ELSE 'done' END AS status, CASE WHEN kind IS NOT NULL AND kind NOT IN ('error', 'click') THEN floor(value)::INT ELSE pages END AS pages, "
    f"CASE WHEN kind IS NOT NULL AND kind NOT IN ('error', 'click') THEN floor(value * 2)::INT ELSE 0 END AS chunks, CASE WHEN kind = 'error' THEN 'crawl failed' END AS error, strftime(CASE WHEN kind IS NOT NULL AND kind <> 'error' THEN {AS_OF_SQL} ELSE last_crawl END, '%Y-%m-%d') AS last_crawl, "
    "CASE WHEN kind IS NOT NULL AND kind NOT IN ('error', 'click') THEN 'e1' END AS etag FROM sources LEFT JOIN e ON user_id = c_custkey"
)
def source_status_fold(spark, d):
    out = registry.apply_run_status(b.sources(spark, d), _outcomes(spark, d), b.AS_OF)
    return out.select("url", "status", "pages", "chunks", "error", F.date_format("last_crawl", "yyyy-MM-dd").alias("last_crawl"), "etag")


@query(f"WITH {b.SOURCES} SELECT c_name AS url, CASE WHEN c_acctbal > 0 THEN 'updated' ELSE s.industry END AS industry, CASE WHEN c_acctbal > 0 THEN 'daily' ELSE cadence END AS cadence, pages FROM customer JOIN sources s ON url = c_name UNION ALL SELECT s_name, 'updated', 'daily', 0 FROM supplier")
def upsert_sources(spark, d):
    """Seeds: customers in credit, and all suppliers, which are new."""
    seed = lambda df, name: df.select(F.col(name).alias("url"), F.lit("ngo").alias("source_type"), F.lit(None).cast("string").alias("org"), F.lit("updated").alias("industry"), F.lit("daily").alias("cadence"))
    seeds = seed(b.table(spark, d, "customer").filter("c_acctbal > 0"), "c_name").unionByName(seed(b.table(spark, d, "supplier"), "s_name"))
    return registry.upsert_sources(b.sources(spark, d).drop("c_custkey"), seeds).select("url", "industry", "cadence", "pages")


@query(f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')}, s AS (SELECT industry, count(DISTINCT source_url) AS sources, count(*) AS pages FROM docs GROUP BY 1), n AS (SELECT industry, count(*) AS chunks FROM c GROUP BY 1) SELECT industry, coalesce(sum(chunks), 0)::BIGINT AS chunks, coalesce(sum(sources), 0)::BIGINT AS sources, coalesce(sum(pages), 0)::BIGINT AS pages FROM n FULL OUTER JOIN s USING (industry) GROUP BY ROLLUP (industry)")
def corpus_stats(spark, d):
    known = b.docs(spark, d).groupBy("industry", "source_url").agg(F.count(F.lit(1)).alias("pages"))
    return registry.corpus_stats(b.chunks(spark, d), known)


@query("SELECT DISTINCT c_mktsegment AS industry FROM customer")
def loaded_industries(spark, d):
    return registry.loaded_industries(b.sources(spark, d))


def _prefs(spark, d):
    return b.table(spark, d, "events").select("user_id", F.col("event_type").alias("active_industry"), F.col("ts").alias("updated_at"))


@query("SELECT c_custkey AS user_id, coalesce(a, 'esg') AS active_industry FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_type)) AS a FROM events GROUP BY 1) ON user_id = c_custkey")
def active_industry(spark, d):
    return registry.active_industry(_prefs(spark, d), b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")))


@query(
    "WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS a FROM events GROUP BY 1), cat AS (SELECT DISTINCT event_type AS id FROM events UNION SELECT DISTINCT c_mktsegment FROM customer) "
    "SELECT c_custkey AS user_id, id, id IN (SELECT event_type FROM events WHERE value > 50) AS loaded, id = coalesce(a, 'esg') AS active FROM customer LEFT JOIN a ON user_id = c_custkey CROSS JOIN cat"
)
def catalog_state(spark, d):
    """The catalog as each customer sees it."""
    e, c = b.table(spark, d, "events"), b.table(spark, d, "customer")
    catalog = e.select(F.col("event_type").alias("id")).union(c.select("c_mktsegment")).distinct()
    return registry.catalog_states(catalog, e.filter("value > 50").select(F.col("event_type").alias("industry")), _prefs(spark, d), c.select(F.col("c_custkey").alias("user_id")))


# ------------------------------------------------------------------------------ pages and links

_CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '[?&]+$', ''), '([^/])/(\?|$)', '\1\2')"


@query(f"SELECT page_id, {_CANON} AS canonical FROM pages")
def canonical_urls(spark, d):
    return b.table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '//([^/?#:]+)', 1), '^www\\.', '') AS domain FROM pages")
def source_domains(spark, d):
    return b.table(spark, d, "pages").select("page_id", urls.source_domain(F.col("url")).alias("domain"))


@query(f"SELECT min(page_id) AS page_id, {_CANON} AS canonical FROM pages GROUP BY 2")
def page_dedupe(spark, d):
    return pages.dedupe_pages(b.table(spark, d, "pages"), "page_id").select("page_id", "canonical")


@query("SELECT page_id FROM pages WHERE NOT (lower(url) LIKE '%spam%' OR lower(url) LIKE 'http://%/de/%' OR lower(url) LIKE '%.html')")
def filter_excluded(spark, d):
    return pages.filter_excluded(b.table(spark, d, "pages"), ["*spam*", "http://*/DE/*", "*.html"]).select("page_id")


_BARE = "|".join(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "title", "nav", "header", "footer", "aside", "form"))
_BARE = rf"regexp_replace(regexp_replace(html, '(?is){_BARE}|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _sign, _name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("chr(39)", "&#x27;"), ("chr(39)", "&#39;"), ("&", "&amp;")):
    _TITLE = f"replace({_TITLE}, '{_name}', {_sign if _sign.startswith('chr') else repr(_sign)})"


@query(rf"SELECT page_id, coalesce(nullif(trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')), ''), url) AS title, trim({_BARE}) <> '' AS ok, CASE WHEN trim({_BARE}) = '' THEN 'empty markdown' END AS error FROM pages")
def page_titles(spark, d):
    """What the main-text job says of each page beside its text."""
    return pages.extract_main_text(b.table(spark, d, "pages")).select("page_id", "title", "ok", "error")


@query()
def main_text(spark, d):
    out = pages.extract_main_text(b.table(spark, d, "pages"))
    return out.select("page_id", "title", text.content_hash(F.col("text")).alias("text_hash"), F.length("text").alias("n_chars"), "ok", "error")


@query(
    r"""WITH l AS (SELECT url, unnest(h) AS raw, generate_subscripts(h, 1) - 1 AS seq FROM (SELECT url, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS h FROM pages))
SELECT url AS page_url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || raw AS href, seq::INT AS seq FROM l WHERE NOT regexp_matches(raw, '(?i)^\s*(#|mailto:|javascript:|tel:)')"""
)
def link_edges(spark, d):
    """The links of all pages, which are relative to their sites."""
    return pages.extract_links(b.table(spark, d, "pages"))


def _site_links(spark, d):
    """Customers link to those of a tenth of the numbers of their orders, on one host for each nation."""
    c = b.table(spark, d, "customer").select("c_custkey", F.format_string("https://n%d.example.org/c/%d", "c_nationkey", "c_custkey").alias("page"))
    o = b.table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 10).alias("to"))
    links = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("page").alias("src"), "to").join(c.select(F.col("c_custkey").alias("to"), F.col("page").alias("dst")), "to").select("src", "dst")
    seeds = c.groupBy(F.regexp_extract("page", "//([^/]+)", 1).alias("h")).agg(F.min("page").alias("url")).select("url")
    return seeds, links


@query(
    """WITH c AS (SELECT c_custkey, 'n' || c_nationkey AS h, 'https://n' || c_nationkey || '.example.org/c/' || c_custkey AS page FROM customer),
l AS (SELECT DISTINCT a.page AS src, z.page AS dst FROM orders JOIN c a ON o_custkey = a.c_custkey JOIN c z ON o_orderkey // 10 = z.c_custkey AND a.h = z.h),
s AS (SELECT min(page) AS seed FROM c GROUP BY h), d0 AS (SELECT seed, seed AS url, 0 AS depth FROM s), d1 AS (SELECT DISTINCT seed, dst AS url, 1 AS depth FROM d0 JOIN l ON url = src WHERE (seed, dst) NOT IN (SELECT (seed, url) FROM d0)),
d2 AS (SELECT DISTINCT seed, dst AS url, 2 AS depth FROM d1 JOIN l ON url = src WHERE (seed, dst) NOT IN (SELECT (seed, url) FROM d0 UNION ALL SELECT (seed, url) FROM d1)), r AS (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2)
SELECT seed, url, depth::INT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, url) AS n FROM r) WHERE n <= 10"""
)
def crawl_frontier(spark, d):
    return pages.crawl_frontier(*_site_links(spark, d), max_depth=2, max_pages=10)


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 6 < 4 AND year(o_orderdate) BETWEEN 1990 AND 2002 THEN o_orderdate END, '%Y-%m-%d') AS day FROM orders")
def parse_dates(spark, d):
    """Compact dates, dates, times with an offset, dates before other text, prose, years too early."""
    forms = ("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd'T12:30:00+01:00'", "yyyy-MM-dd 'at noon'", "MMMM d, yyyy", "'1970'-MM-dd")
    raw = F.coalesce(*(F.when(F.col("o_orderkey") % 6 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)))
    return b.table(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_iso_date(raw, b.AS_OF), "yyyy-MM-dd").alias("day"))


# ------------------------------------------------------------------------------ answers and training


def _turns(spark, d):
    """Turns of conversations as result rows of their conversation."""
    t = b.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text", "role")
    return t.withColumn("url", F.format_string("https://%s%d.example.org/t/%d", "role", F.col("query_id") % 3, "rank")).withColumn("title", F.concat(F.lit("Turn "), F.col("rank").cast("string")))


_ESCAPE = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("SELECT conv_id AS query_id, count(*) AS n_passages, sha256(coalesce(string_agg('[' || (turn + 1) || '] ' || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY turn, text) FILTER (trim(text, ' ' || chr(10) || chr(9)) <> ''), '')) AS sources_hash FROM conversations WHERE turn < 6 GROUP BY 1")
def prompt_sources(spark, d):
    marked = F.concat(F.lit("<mark>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</mark>"))
    return answers.build_prompts(_turns(spark, d).withColumn("highlight", marked)).select("query_id", "n_passages", F.sha2("sources", 256).alias("sources_hash"))


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || ' [2][' || turn || '][99]') END::INT AS answer_chars, "
    "CASE WHEN turn % 4 = 3 THEN '' WHEN turn BETWEEN 1 AND 8 AND turn <> 2 THEN array_to_string(list_sort([2, turn]), ',') ELSE '2' END AS citations FROM conversations"
)
def parse_answers(spark, d):
    reply = F.when(F.col("turn") % 4 == 3, F.lit(" None. ")).otherwise(F.concat(F.col("text"), F.format_string(" [2][%d][99]", "turn")))
    clean = text.strip(F.col("text"))
    t = b.table(spark, d, "conversations").withColumn("text", clean).select("conv_id", "turn", reply.alias("content"), F.lit(8).alias("n_passages"))
    return answers.parse_answers(t).select("conv_id", "turn", F.length("answer").alias("answer_chars"), F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query(
    "WITH r AS (SELECT DISTINCT conv_id, turn, text AS t FROM conversations), v AS (SELECT conv_id, turn, sha256(coalesce(t, '')) AS reply, nullif(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '') AS v FROM r) "
    "SELECT conv_id, turn, reply, 0 AS ordinal, 'Net Zero?' AS name, sha256(v) AS value_hash, CASE WHEN v IS NULL THEN '' ELSE '1,3' END AS citations FROM v UNION ALL SELECT conv_id, turn, reply, 1, 'net-zero', sha256('second'), '2' FROM v UNION ALL SELECT conv_id, turn, reply, 2, '!!', NULL, '' FROM v"
)
def parse_structured(spark, d):
    """Each whole turn as a value in a reply of three fields, of which two have the same slug and one has none."""
    t = b.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("v")).distinct().withColumn("reply", F.sha2(F.coalesce("v", F.lit("")), 256))
    first = t.withColumn("request_id", F.concat_ws(":", "conv_id", "turn", "reply"))
    entry = lambda v, s: F.struct(v.alias("value"), F.array(*map(F.lit, s)).alias("sources"))
    content = F.to_json(F.struct(entry(F.col("v"), (3, 1, 3, 9)).alias("net_zero"), entry(F.lit("second"), (2,)).alias("net_zero_2"), entry(F.lit(" "), (1,)).alias("field_2")))
    replies = first.select("request_id", content.alias("content"), F.lit(4).alias("n_passages"))
    fields = first.select("request_id", F.posexplode(F.array(F.lit("Net Zero?"), F.lit("net-zero"), F.lit("!!"))).alias("ordinal", "name"))
    out, key = answers.parse_structured(replies, fields), F.split("request_id", ":")
    return out.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), key[2].alias("reply"), "ordinal", "name", F.sha2("value", 256).alias("value_hash"), F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query("SELECT conv_id, (turn)::INT AS ordinal, left(role || ' ' || turn, 60) AS name, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::INT AS value_chars FROM conversations WHERE turn < 8 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def parse_auto_fields(spark, d):
    """Each conversation as a reply whose fields are its turns."""
    rows = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    content = F.to_json(F.struct(F.transform("ts", lambda t: F.struct(F.concat_ws(" ", t["role"], t["turn"].cast("string")).alias("name"), t["text"].alias("value"), F.array(F.lit(1)).alias("sources"))).alias("fields")))
    out = answers.parse_auto_fields(rows.select(F.col("conv_id").alias("request_id"), content.alias("content"), F.lit(8).alias("n_passages")))
    return out.filter("value is not null").select(F.col("request_id").alias("conv_id"), "ordinal", "name", F.length("value").alias("value_chars"))


@query(
    """WITH t AS (SELECT conv_id, (turn + 1)::INT AS rank, 'https://' || role || (conv_id % 3) || '.example.org/t/' || (turn + 1) AS url, role || (conv_id % 3) || '.example.org' AS host FROM conversations),
k AS (SELECT DISTINCT conv_id FROM t), c AS (SELECT conv_id, unnest([3, 1, 3, 2, 50]) AS rank, unnest([0, 1, 2, 3, 4]) AS p FROM k), f AS (SELECT conv_id, rank, min(p) AS pos FROM c GROUP BY ALL)
SELECT conv_id, host, min(pos)::INT AS pos, arg_min(rank, pos)::INT AS rank, count(*) - 1 AS extra FROM f JOIN (SELECT DISTINCT * FROM t) USING (conv_id, rank) GROUP BY conv_id, host"""
)
def citations_by_host(spark, d):
    t = _turns(spark, d).select("query_id", "rank", "url", "title").distinct()
    cited = t.select("query_id").distinct().select(F.col("query_id").alias("answer_id"), "query_id", F.array(*map(F.lit, (3, 1, 3, 2, 50))).alias("citations"))
    return answers.citations_by_host(cited, t).select(F.col("answer_id").alias("conv_id"), "host", "pos", "rank", "extra")


@query(f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')} SELECT id AS chunk_id, url, length(text)::INT AS passage_chars, unnest([title || ' ' || ordinal, 'What is in ' || title || '?']) AS query FROM c")
def training_pairs(spark, d):
    """Two queries for each chunk, from replies with prose around the array."""
    c = b.chunks(spark, d)
    array = F.to_json(F.array(F.concat_ws(" ", "title", F.col("ordinal").cast("string")), F.lit("  "), F.concat(F.lit("What is in "), F.col("title"), F.lit("?"))))
    replies = c.select(F.col("id").alias("chunk_id"), F.concat(F.lit("Sure:\n```json\n"), array, F.lit("\n```")).alias("content"))
    return train.build_pairs(replies, c).select("chunk_id", "url", F.length("positive").alias("passage_chars"), "query")


_QUOTES = "chr(10) || '\"\"\"' || chr(10)"


@query(
    f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')} SELECT id AS chunk_id, url, sha256('Passage:' || {_QUOTES} || substr(text, 1, 4000) || {_QUOTES} || chr(10) || "
    "'Write 3 different search queries that this passage answers. Reply only with a JSON array of strings.') AS prompt_hash FROM c"
)
def synth_prompts(spark, d):
    return train.synth_prompts(b.chunks(spark, d)).select("chunk_id", "url", text.content_hash(F.col("prompt")).alias("prompt_hash"))
