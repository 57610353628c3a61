"""The virtual tables that the queries use, built from the given ones: in Spark, and as SQL for the oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.highlight import SLACK_CHARS, STOP_WORDS, WINDOW_CHARS
from cairnfield.functions.text import CONSENT_PHRASES
from cairnfield.operators.chunking import chunk_windows, spread

AS_OF = datetime(2001, 8, 2)
SIZE, OVERLAP = 128, 16
TYPES = ("framework", "regulator", "ratings", "report", "ngo", "news")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of sites; the date is that of the order with the same number."""
    d = spread(table(spark, sf_dir, "documents"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("published_at"), "o_orderstatus")
    return d.join(o, "doc_id", "left").select(
        "doc_id",
        F.format_string("https://%s.example.org/doc/%d", "source", "doc_id").alias("url"),
        F.format_string("https://%s.example.org/", "source").alias("source_url"),
        F.format_string("Document %d", "doc_id").alias("title"),
        F.lit(None).cast("string").alias("org"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 6 + 1).cast("int")).alias("source_type"),
        F.col("lang").alias("industry"),
        "text",
        "published_at",
        "o_orderstatus",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_windows(docs(spark, sf_dir), SIZE, OVERLAP)


def index_of(pages: DataFrame) -> DataFrame:
    """An index snapshot of pages (columns of docs), crawled on 2001-07-01."""
    c = chunk_windows(pages, SIZE, OVERLAP)
    return c.select("id", "url", "source_url", "title", "org", "source_type", "text", "content_hash", "token_count", "industry", F.lit(datetime(2001, 7, 1)).cast("timestamp_ntz").alias("crawled_at"), "published_at")


def old_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state before the crawl: documents of order status P are not yet there, those of status F had other first words."""
    d = docs(spark, sf_dir).filter("o_orderstatus is null or o_orderstatus <> 'P'")
    return d.withColumn("text", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Earlier version . "), F.col("text"))).otherwise(F.col("text"))).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks with the text of the document of the same number; verticals are label parities."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    return e.join(d, "vec_id", "left").select(
        F.col("vec_id").alias("id"),
        F.format_string("https://label%d.example.org/v/%d", "label", "vec_id").alias("url"),
        F.format_string("Vector %d", "vec_id").alias("title"),
        F.lit(None).cast("string").alias("org"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("vec_id") % 6 + 1).cast("int")).alias("source_type"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col("label") % 2).cast("string").alias("industry"),
        F.col("embedding").alias("dense"),
        F.col("label"),
    )


def dated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"))
    return vectors(spark, sf_dir).join(o, "id", "left").withColumn("crawled_at", F.col("published_at"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose number is divisible by 100 asks; its text is the query."""
    return vectors(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("text").alias("query"), "industry", F.col("dense").alias("vec"), "label")


def vector_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_queries(spark, sf_dir).select(F.col("query_id").alias("id"), "query", F.array(F.format_string("https://label%d.example.org/", "label")).alias("relevant"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources; the last crawl is their last order, none for every tenth."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_crawl"), F.count(F.lit(1)).cast("int").alias("pages"))
    cadence = F.element_at(F.array(*map(F.lit, ("hourly", "daily", "weekly", "monthly"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return c.join(last, "c_custkey", "left").select(
        "c_custkey",
        F.col("c_name").alias("url"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("source_type"),
        F.lit(None).cast("string").alias("org"),
        F.col("c_mktsegment").alias("industry"),
        cadence.alias("cadence"),
        F.lit("idle").alias("status"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.lit(0).alias("chunks"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("last_crawl")).alias("last_crawl"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


# ------------------------------------------------------------------------------------------------ SQL


def norm_sql(col: str) -> str:
    x = rf"regexp_replace(coalesce({col}, ''), '\r\n?', chr(10), 'g')"
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", "''"), (r"\[([^\]]+)\]\([^)]*\)", r"'\1'"), (r"https?://\S+", "''"), (r"(?m)^[\s>*\-#=_|`]+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    bad = " OR ".join(f"contains(lower(l), '{p}')" for p in ("cookie", *CONSENT_PHRASES))
    x = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT ({bad})), chr(10))"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def terms_sql(col: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({col}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


TYPES_SQL = "['" + "','".join(TYPES) + "']"

DOCS = f"""docs AS (
  SELECT doc_id, 'https://' || source || '.example.org/doc/' || doc_id AS url, 'https://' || source || '.example.org/' AS source_url,
         'Document ' || doc_id AS title, {TYPES_SQL}[doc_id % 6 + 1] AS source_type, lang AS industry, text, o_orderdate AS published_at, o_orderstatus
  FROM documents LEFT JOIN orders ON doc_id = o_orderkey)"""

OLD_DOCS = "old_docs AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 'Earlier version . ' || text ELSE text END AS text, NULL::TIMESTAMP AS published_at) FROM docs WHERE o_orderstatus IS NULL OR o_orderstatus <> 'P')"


def chunks_sql(name: str, source: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    step = size - overlap
    return rf"""{name} AS (
  SELECT sha256(url || '#' || ordinal) AS id, * EXCLUDE (tk, w), regexp_replace(array_to_string(w, ''), '\s+$', '') AS text, len(w)::INT AS token_count, sha256(regexp_replace(array_to_string(w, ''), '\s+$', '')) AS content_hash,
         length(array_to_string(tk[1 : ordinal * {step}], ''))::INT AS begin_char, (length(array_to_string(tk[1 : ordinal * {step}], '')) + length(regexp_replace(array_to_string(w, ''), '\s+$', '')))::INT AS end_char
  FROM (SELECT *, tk[ordinal * {step} + 1 : ordinal * {step} + {size}] AS w
        FROM (SELECT *, unnest(range(0, greatest(ceil((len(tk) - {size}) / {step}), 0)::BIGINT + 1))::INT AS ordinal
              FROM (SELECT * EXCLUDE (text), regexp_extract_all({norm_sql("text")}, '\S+\s*') AS tk FROM {source}) WHERE len(tk) > 0)))"""


VECTORS = f"""vectors AS (
  SELECT e.vec_id AS id, 'https://label' || label || '.example.org/v/' || e.vec_id AS url, {TYPES_SQL}[e.vec_id % 6 + 1] AS source_type,
         coalesce(text, '') AS text, (label % 2)::VARCHAR AS industry, embedding::DOUBLE[] AS dense, label, o_orderdate AS published_at
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN orders o ON e.vec_id = o.o_orderkey
), asked AS (SELECT id AS query_id, text AS query, industry, dense AS vec, label FROM vectors WHERE id % 100 = 0)"""


def dense_sql(name: str, k: int, dim: int = 64) -> str:
    return f"""{name} AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, chunk_id) AS rank FROM (
      SELECT query_id, v.id AS chunk_id, list_cosine_similarity(vec[1:{dim}], dense[1:{dim}]) AS score FROM asked JOIN vectors v USING (industry))) WHERE rank <= {k})"""


def bm25_sql(name: str, queries: str, corpus: str, k: int, scope: str | None) -> str:
    """queries: query_id, query, industry; corpus: id, industry, text. Statistics by industry, or over all."""
    by = "industry, " if scope else ""
    on = "USING (industry)" if scope else "ON true"
    return f"""{name}_d AS (SELECT id AS chunk_id, industry, {terms_sql("text")} AS t FROM {corpus}),
{name}_q AS (SELECT query_id, industry, unnest(list_distinct({terms_sql("query")})) AS term FROM {queries}),
{name}_n AS (SELECT {by}count(*) AS n, avg(len(t)) AS avgdl FROM {name}_d {"GROUP BY industry" if scope else ""}),
{name}_tf AS (SELECT chunk_id, industry, dl, term, count(*) AS tf FROM (SELECT chunk_id, industry, len(t) AS dl, unnest(t) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_df AS (SELECT {by}term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_tf JOIN {name}_df USING ({by}term) JOIN {name}_n {on} JOIN {name}_q USING (industry, term) GROUP BY query_id, chunk_id)) WHERE rank <= {k})"""


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def highlight_sql(name: str, hits: str) -> str:
    """hits: query_id, chunk_id, query, text; adds highlight. Letters outside ASCII stand between underscores while terms are marked, as word boundaries are ASCII's here."""
    strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".format
    most = WINDOW_CHARS + SLACK_CHARS
    return rf"""{name}_w AS (SELECT query_id, chunk_id, text, list_filter(regexp_extract_all(lower(query), '[A-Za-z0-9][A-Za-z0-9\-'']+'), lambda w: len(w) > 2 AND w NOT IN ({_STOPS})) AS w FROM {hits}),
{name}_p AS (SELECT query_id, chunk_id, text, list_filter(w, lambda x, i: list_position(w, x) = i) AS terms,
  list_filter(list_transform(string_split(regexp_replace({strip("text")}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda p: {strip("p")}), lambda p: p <> '') AS parts FROM {name}_w),
{name}_h AS (SELECT *, list_transform(parts, lambda p: coalesce(list_sum(list_transform(terms, lambda t: ((len(lower(p)) - len(replace(lower(p), t, ''))) / len(t))::INT)), 0)) AS hits FROM {name}_p),
{name}_b AS (SELECT *, list_position(hits, list_max(hits))::BIGINT AS best FROM {name}_h),
{name}_g AS (SELECT *, list_reduce(list_prepend({{'lo': best, 'hi': best, 'n': len(parts[best]), 't': 0::BIGINT}}, list_transform(range(1, len(parts) + 1), lambda i: {{'lo': 0::BIGINT, 'hi': 0::BIGINT, 'n': 0::BIGINT, 't': i}})),
  lambda a, x: CASE WHEN a.n >= {WINDOW_CHARS} OR (a.lo = 1 AND a.hi = len(parts)) THEN a
    WHEN a.hi < len(parts) AND (x.t % 2 = 1 OR a.lo = 1) THEN {{'lo': a.lo, 'hi': a.hi + 1, 'n': a.n + 1 + len(parts[a.hi + 1]), 't': x.t}}
    ELSE {{'lo': a.lo - 1, 'hi': a.hi, 'n': a.n + 1 + len(parts[a.lo - 1]), 't': x.t}} END) AS g FROM {name}_b WHERE len(parts) > 0),
{name}_c AS (SELECT query_id, chunk_id, terms, array_to_string(parts[g.lo : g.hi], ' ') AS f FROM {name}_g),
{name}_e AS (SELECT query_id, chunk_id, terms, CASE WHEN len(f) <= {most} THEN f ELSE regexp_replace(substr(f, 1, {most}), ' [^ ]*$', '') || '…' END AS f FROM {name}_c
  UNION ALL SELECT query_id, chunk_id, terms, substr(text, 1, {WINDOW_CHARS}) FROM {name}_b WHERE len(parts) = 0),
{name}_s AS (SELECT query_id, chunk_id, terms, regexp_replace(replace(replace(replace(replace(replace(f, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), '([^\x00-\x7F…])', '_\1_', 'g') AS f FROM {name}_e),
{name} AS (SELECT query_id, chunk_id, regexp_replace(CASE WHEN len(terms) = 0 THEN f ELSE regexp_replace(f, '(?i)\b(' || array_to_string(terms, '|') || ')\b', '<mark>\1</mark>', 'g') END, '_([^\x00-\x7F…])_', '\1', 'g') AS highlight FROM {name}_s)"""


SOURCES = f"""sources AS (
  SELECT c_custkey, c_name AS url, {TYPES_SQL}[c_custkey % 6 + 1] AS source_type, c_mktsegment AS industry, ['hourly', 'daily', 'weekly', 'monthly'][c_nationkey % 4 + 1] AS cadence,
         coalesce(pages, 0)::INT AS pages, CASE WHEN c_custkey % 10 <> 0 THEN last END AS last_crawl
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS pages FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
