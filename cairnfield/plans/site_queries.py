"""Registered queries over seeds, page preparation, links and the readers and writers, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnfield.operators import pages, train
from cairnfield.operators.stages import shared_dir
from cairnfield.sources import readers

from . import bindings as b
from .queries import query


def _folder(spark) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# ------------------------------------------------------------------------------ seeds and files


@query(
    """SELECT c_name AS url, c_mktsegment AS industry, CASE WHEN c_custkey % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS cadence,
coalesce(CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 2 THEN c_custkey % 3 END, 1)::INT AS depth, 25 AS max_pages, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey ELSE 4 END::INT AS max_pdfs,
CASE WHEN c_custkey % 4 <> 0 THEN 22 ELSE 21 END AS n_exclude, CASE WHEN c_custkey % 4 <> 0 THEN '*/x' || c_custkey || '*' ELSE '*/newsletter*' END AS last_exclude, CASE WHEN c_custkey % 4 = 1 THEN 'h' || c_nationkey || '.example.net' ELSE '' END AS hosts FROM customer"""
)
def crawl_seeds(spark, d):
    """Customers as seed files, one for each market segment, read back against a catalog, with their crawl settings resolved."""
    c, n, k = b.table(spark, d, "customer"), F.col("c_nationkey"), F.col("c_custkey")
    crawl = F.struct(
        F.when(k % 3 != 2, (k % 3).cast("int")).alias("max_depth"),
        F.array(F.format_string("*/x%d*", k)).alias("exclude"),
        n.cast("int").alias("max_pdfs"),
        F.when(k % 4 == 1, F.array(F.format_string("h%d.example.net", n))).alias("pdf_hosts"),
    )
    seeds = c.select(F.col("c_name").alias("url"), F.lit("ngo").alias("source_type"), F.when(k % 2 == 0, F.lit("weekly")).alias("cadence"), F.when(k % 4 != 0, crawl).alias("crawl"), F.col("c_mktsegment").alias("segment"))
    path = _folder(spark)
    seeds.write.partitionBy("segment").json(f"{path}/seeds")
    c.select(F.col("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("label")).distinct().write.json(f"{path}/catalog")
    catalog = readers.read_catalog(spark, f"{path}/catalog")
    out = None
    for r in catalog.select("id").collect():  # a file for each vertical
        part = readers.read_seeds(spark, f"{path}/seeds/segment={r.id}", r.id, catalog)
        out = part if out is None else out.unionByName(part)
    out = readers.resolve_crawl_config(out)
    return out.select("url", "industry", "cadence", "depth", "max_pages", "max_pdfs", F.size("exclude").alias("n_exclude"), F.element_at("exclude", -1).alias("last_exclude"), F.array_join("pdf_hosts", ",").alias("hosts"))


@query(f"WITH {b.VECTORS} SELECT query_id::VARCHAR AS id, sha256(query) AS query_hash, 'https://label' || label || '.example.org/' AS relevant FROM asked")
def qrels_file(spark, d):
    path = _folder(spark)
    b.vector_qrels(spark, d).withColumn("id", F.col("id").cast("string")).write.json(path)
    return readers.read_qrels(spark, path).select("id", F.sha2("query", 256).alias("query_hash"), F.array_join("relevant", ",").alias("relevant"))


@query(f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')} SELECT title || ' ' || ordinal AS anchor, sha256(text) AS positive_hash FROM c")
def pairs_file(spark, d):
    """A training pair for each chunk, written and read back."""
    c, path = b.chunks(spark, d), _folder(spark)
    replies = c.select(F.col("id").alias("chunk_id"), F.to_json(F.array(F.concat_ws(" ", "title", F.col("ordinal").cast("string")))).alias("content"))
    readers.write_pairs(train.build_pairs(replies, c), path)
    return readers.read_pairs(spark, path).select("anchor", F.sha2("positive", 256).alias("positive_hash"))


@query(f"WITH {b.DOCS}, {b.chunks_sql('c', 'docs')} SELECT id, url, industry, content_hash, strftime(published_at, '%Y-%m-%d') AS published_at FROM c")
def index_file(spark, d):
    """The index of all documents, written by vertical and read back."""
    path = _folder(spark)
    readers.write_index(b.index_of(b.docs(spark, d)), path)
    return readers.read_index(spark, path).select("id", "url", "industry", "content_hash", _day("published_at"))


@query("SELECT page_id, url, sha256(html) AS html_hash FROM pages")
def pages_file(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.sha2("html", 256).alias("html_hash"))


# ------------------------------------------------------------------------------ pages and links

# `PDF text`: words broken after hyphens, lines of a sentence each, paragraphs after commas, and two kinds of newline.
_WRAPPED = "replace(replace(replace(replace(text, ' a', '-' || chr(10) || 'a'), '. ', '.' || chr(10)), ', ', ',  ' || chr(10) || chr(10) || chr(10) || ' '), '; ', ';' || chr(13) || chr(10))"


def _reflow_sql(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '-\n([\pL\pM\p{{Nd}}\p{{Nl}}\p{{Pc}}])', '-\1', 'g')"
    x = rf"regexp_replace({x}, '[ \t]*\n[ \t]*', chr(10), 'g')"
    for _ in range(2):  # matches that share a sign
        x = rf"regexp_replace({x}, '([^\n])\n([^\n])', '\1 \2', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH {b.DOCS}, p AS (SELECT *, {_reflow_sql(_WRAPPED)} AS body FROM docs)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Annual Report ' || doc_id WHEN 1 THEN 'plan of+' || doc_id ELSE 'Given ' || doc_id END AS title, sha256(body) AS text_hash, body <> '' AS ok,
CASE WHEN body = '' THEN 'no extractable text' END AS error, strftime(CASE WHEN doc_id % 4 < 2 THEN published_at ELSE published_at + INTERVAL 1 DAY END, '%Y-%m-%d') AS published_at FROM p"""
)
def pdf_pages(spark, d):
    """Documents as extracted PDF text."""
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.format_string("Annual-Report_%d.PDF", i)).when(i % 3 == 1, F.format_string("plan%%20of+%d.pdf", i)).otherwise(F.format_string("x%d.pdf", i))
    pdfs = b.docs(spark, d).select(
        F.concat(F.format_string("https://www.example.org/%d/", i), name).alias("url"),
        F.when(i % 3 == 2, F.format_string("  Given %d ", i)).alias("title"),
        F.expr(_WRAPPED).alias("text"),
        F.when(i % 4 == 1, F.lit("1970-01-01").cast("timestamp_ntz")).when(i % 4 > 1, F.col("published_at") + F.expr("INTERVAL 1 DAY")).alias("creation_date"),
        F.col("published_at").alias("modification_date"),
    )
    out = pages.prepare_pdf_pages(pdfs, b.AS_OF)
    return out.select(F.regexp_extract("url", r"org/(\d+)/", 1).cast("long").alias("doc_id"), "title", F.sha2("text", 256).alias("text_hash"), "ok", "error", _day("published_at"))


@query(
    """WITH l AS (SELECT 'https://www.n' || c_nationkey || '.example.org/' AS seed, o_orderkey AS seq, 10 + c_nationkey AS cap,
  CASE o_orderkey % 5 WHEN 0 THEN 'https://n' || c_nationkey || '.example.org/r/' || (o_orderkey % 40) || '.pdf' WHEN 1 THEN 'https://files.example.net/' || o_orderkey || '.PDF' END AS url FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT seed, url, min(seq) AS seq, min(cap) AS cap FROM l WHERE url IS NOT NULL GROUP BY ALL)
SELECT seed, url FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY seq, url) AS r FROM f) WHERE r <= cap"""
)
def harvest_pdf_links(spark, d):
    """Orders as links of their nation's seed: own files that repeat, an allowed host, a strange host, drafts, and no PDF."""
    k, n = F.col("o_orderkey"), F.col("c_nationkey")
    own = "https://n%d.example.org/"
    kinds = (F.format_string(f"{own}r/%d.pdf#p%d", n, k % 40, k), F.format_string("https://files.example.net/%d.PDF?utm_source=x", k), F.format_string("https://other.example.com/%d.pdf", k), F.format_string(f"{own}Draft/%d.pdf", n, k))
    href = F.coalesce(*(F.when(k % 5 == i, h) for i, h in enumerate(kinds)), F.format_string(f"{own}p/%d.html", n, k))
    seed = F.format_string("https://www.n%d.example.org/", n)
    links = b.table(spark, d, "orders").join(b.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(seed.alias("seed_url"), href.alias("href"), k.alias("seq"))
    seeds = b.table(spark, d, "customer").select(seed.alias("url"), F.array(F.lit("*draft*")).alias("exclude"), F.array(F.lit("Files.example.net")).alias("pdf_hosts"), (n + 10).alias("max_pdfs")).distinct()
    return pages.harvest_pdf_links(seeds, links)


@query(
    """WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1),
s AS (SELECT c_name AS url, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS depth, CASE WHEN c_custkey % 3 <> 0 THEN 'v' || c_custkey END AS etag, CASE WHEN c_custkey % 5 = 0 THEN 'Mon' END AS modified, kind, event_id FROM customer LEFT JOIN e ON user_id = c_custkey),
n AS (SELECT *, coalesce(depth = 0 AND (etag IS NOT NULL OR modified IS NOT NULL) AND kind = 'click', false) AS not_modified FROM s)
SELECT url, depth, not_modified, CASE WHEN NOT not_modified AND kind <> 'error' THEN 'e' || event_id ELSE etag END AS etag, CASE WHEN NOT not_modified AND kind <> 'error' THEN NULL ELSE modified END AS last_modified FROM n"""
)
def conditional_split(spark, d):
    """Customers as sources with and without validators; their latest events as probes: clicks say not modified, errors fail."""
    c, k = b.table(spark, d, "customer"), F.col("c_custkey")
    sources = c.select(F.col("c_name").alias("url"), F.when(k % 7 == 0, 1).otherwise(0).alias("depth"), F.when(k % 3 != 0, F.format_string("v%d", k)).alias("etag"), F.when(k % 5 == 0, F.lit("Mon")).alias("last_modified"))
    e = b.table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).join(c, F.col("user_id") == k)
    kind = F.col("m.event_type")
    failed = kind == "error"
    log = e.select(F.col("c_name").alias("url"), F.when(kind == "click", 304).when(~failed, 200).alias("status"), F.format_string("e%d", F.col("m.event_id")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.when(failed, F.lit("timeout")).alias("error"))
    return pages.conditional_split(log, sources).select("url", "depth", "not_modified", "etag", "last_modified")


@query(
    """SELECT page_id, strftime(CASE page_id % 6 WHEN 0 THEN o_orderdate + INTERVAL 10 DAY WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE o_orderdate END, '%Y-%m-%d') AS published_at
FROM pages LEFT JOIN orders ON page_id = o_orderkey"""
)
def published_dates(spark, d):
    """Pages with the date of an order in their head: two tags of which one is trusted more, a compact date, linked data, prose before a date, a date too early, none."""
    day, i = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("page_id")
    later = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 10 DAY"), "yyyy-MM-dd")
    tags = (
        F.format_string('<meta name="date" content="%s"><META content="%s" property="article:published_time">', day, later),
        F.format_string("<meta name='pubdate' content='%s'>", F.date_format("o_orderdate", "yyyyMMdd")),
        F.format_string('<script type="application/ld+json">{"datePublished": "%sT12:00:00Z"}</script>', day),
        F.format_string('<meta name="date" content="soon"><meta itemprop="datePublished" content="%s">', day),
        F.lit('<meta property="og:published_time" content="1970-01-01">'),
    )
    tag = F.coalesce(*(F.when(i % 6 == n, t) for n, t in enumerate(tags)), F.lit(""))
    dated = b.table(spark, d, "pages").join(b.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), i == F.col("o_orderkey"), "left")
    dated = dated.withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), tag)))
    return pages.extract_published_at(dated, b.AS_OF).select("page_id", _day("published_at"))
