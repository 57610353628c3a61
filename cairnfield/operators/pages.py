"""Page preparation: from fetched pages and links to clean page rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import dates, text, urls
from cairnfield.functions.html import main_text

from .stages import Stages

#: Pages of a level up to which they are sent to the link table, and the parts in which the links of one page are cut at first.
BROADCAST_PAGES, SALTS = 200_000, 64


def dedupe_pages(pages: DataFrame, order_col: str = "page_seq", url_col: str = "url") -> DataFrame:
    """One row for each canonical URL: the first crawled, failed or not. Its key is found before wide columns move."""
    keyed = pages.withColumn("canonical", urls.canonical_url(F.col(url_col)))
    first = keyed.groupBy("canonical").agg(F.min(order_col).alias("__first"))
    rows = keyed.join(first.withColumnRenamed("canonical", "__c"), F.col("canonical").eqNullSafe(F.col("__c")) & (F.col(order_col) == F.col("__first")), "left_semi")
    return rows.dropDuplicates(["canonical", order_col])


def filter_excluded(pages: DataFrame, patterns, url_col: str = "url") -> DataFrame:
    """Without URLs that match one of the globs (a list, or the name of an array column)."""
    return pages.filter(~F.coalesce(urls.matches_glob(F.col(url_col), F.col(patterns) if isinstance(patterns, str) else patterns), F.lit(False)))


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with title (else the URL), text, ok and error; a page without text is a failure, never an exception."""
    keep = [c for c in pages.columns if c not in ("title", "text", "ok", "error", html_col)]
    schema = pages.select(*keep).withColumns({"title": F.lit(""), "text": F.lit(""), "ok": F.lit(True), "error": F.lit("")}).schema

    def run(batches):
        for batch in batches:
            got = [main_text(h) for h in batch[html_col]]
            out = batch[keep].copy()
            out["title"] = [t or u for (t, _), u in zip(got, batch[url_col], strict=True)]
            out["text"] = [x for _, x in got]
            out["ok"] = [bool(x) for _, x in got]
            out["error"] = [None if x else "empty markdown" for _, x in got]
            yield out

    from pyspark.sql.types import StructType

    return pages.select(*keep, html_col).mapInPandas(run, StructType([f if f.name in keep else type(f)(f.name, f.dataType, True) for f in schema.fields]))


def extract_published_at(pages: DataFrame, as_of: datetime, html_col: str = "html", meta_col: str | None = None) -> DataFrame:
    return pages.withColumn("published_at", dates.published_at(F.col(meta_col) if meta_col else None, F.col(html_col), as_of))


def _pdf_date(col: Column, as_of: datetime) -> Column:
    return F.when(F.year(col).between(dates.FIRST_YEAR, as_of.year + 1), col)


def prepare_pdf_pages(pdfs: DataFrame, as_of: datetime) -> DataFrame:
    """Page rows from extracted PDF text: reflowed, with title (else the file's name) and date (created, else modified)."""
    name = F.element_at(F.split(urls.url_path(F.col("url")), "/"), -1)
    name = F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), "[-_]", " "))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    for pattern, by in ((r"(?U)-\n(?=\w)", "-"), (r"[ \t]*\n[ \t]*", "\n"), (r"(?<!\n)\n(?!\n)", " "), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        body = F.regexp_replace(body, pattern, by)
    body = text.strip(body)
    title = F.trim(F.coalesce("title", F.lit("")))
    return pdfs.select(
        "url",
        F.when(title != "", title).when(name != "", name).otherwise(F.col("url")).alias("title"),
        body.alias("text"),
        (body != "").alias("ok"),
        F.when(body == "", F.lit("no extractable text")).alias("error"),
        F.coalesce(_pdf_date(F.col("creation_date"), as_of), _pdf_date(F.col("modification_date"), as_of)).alias("published_at"),
    )


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_url, href, seq): the links of each page in order, as seen from the page; page anchors and mail links stay out."""
    found = pages.select(F.col(url_col).alias("page_url"), F.posexplode(F.regexp_extract_all(html_col, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), 1)).alias("seq", "raw"))
    found = found.filter(~F.col("raw").rlike(r"(?i)^\s*(#|mailto:|javascript:|tel:)"))
    return found.select("page_url", urls.resolve_url(F.col("page_url"), F.col("raw")).alias("href"), "seq")


def first_links(links: DataFrame, sources: DataFrame, cap: int, exclude=(), count: int | None = None) -> DataFrame:
    """(src, dst): of each page in sources (url, distinct) its first `cap` links by URL that stay on its domain and match no exclude.

    The link table is only filtered where it lies while the pages are few (count: a bound that the caller knows, else they are counted).
    A page with very many links is cut in SALTS parts first.
    """
    few = (sources.limit(BROADCAST_PAGES + 1).count() if count is None else count) <= BROADCAST_PAGES
    wanted = sources.select(F.col("url").alias("src"))
    found = links.join(F.broadcast(wanted) if few else wanted, "src", "left_semi")
    found = filter_excluded(found, exclude, "dst").filter(urls.source_domain(F.col("src")) == urls.source_domain(F.col("dst"))).select("src", "dst")
    salted = found.withColumn("__s", F.pmod(F.xxhash64("dst"), F.lit(SALTS))).repartition("src", "__s").distinct()
    for keys in (("src", "__s"), ("src",)):
        salted = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("dst"))).filter(F.col("__r") <= cap).drop("__r")
    return salted.select("src", "dst")


def crawl_frontier(seeds: DataFrame, links: DataFrame, max_depth: int = 1, max_pages: int = 25, exclude=()) -> DataFrame:
    """(seed, url, depth): breadth-first over a link table (src, dst) from each seed, on its own domain, at most max_pages each.

    A depth or max_pages column of seeds overrides the arguments where it is not null; of a repeated seed the largest limits hold; a null
    seed has no pages. Order within a seed is (depth, url): reproducible, where a live crawl's is not. Each level takes what is left of a
    seed's budget, and a seed without budget goes no further. Of a page only the first max_pages links by URL can matter, as those before
    them are new or were reached, and both count against the budget: so a level makes at most max_pages squared rows a seed,
    however many links a page has. Each level is a stored table; levels are few.
    """
    stages = Stages(seeds.sparkSession)
    limit_of = lambda c, default: F.max(F.coalesce(F.col(c), F.lit(default)) if c in seeds.columns else F.lit(default)).alias(f"max_{c}" if c == "depth" else c)
    limits = stages.keep(seeds.filter("url is not null").groupBy(F.col("url").alias("seed")).agg(limit_of("depth", max_depth), limit_of("max_pages", max_pages)).filter("max_pages >= 1"))
    deepest, cap = limits.agg(F.max("max_depth"), F.max("max_pages")).first()
    ends = limits.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"))
    reached, count = ends, limits.count()
    for level in range(1, (deepest or 0) + 1):
        used = reached.groupBy("seed").agg(F.count(F.lit(1)).alias("__used"))
        open_ = limits.filter(F.col("max_depth") >= level).join(used, "seed").select("seed", (F.col("max_pages") - F.col("__used")).alias("__left")).filter("__left > 0")
        going = ends.select("seed", "url").join(open_, "seed")
        step = first_links(links, going.select("url").distinct(), cap, exclude, count)
        new = going.join(step, F.col("url") == F.col("src")).select("seed", F.col("dst").alias("url"), "__left").distinct()
        new = new.join(reached.select("seed", "url"), ["seed", "url"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("url"))
        ends = stages.keep(new.withColumn("__r", rank).filter("__r <= __left").select("seed", "url", F.lit(level).alias("depth")))
        count = ends.count()
        if not count:
            break
        reached = reached.unionByName(ends)
    return reached


def harvest_pdf_links(seeds: DataFrame, links: DataFrame, max_pdfs: int = 4) -> DataFrame:
    """(seed, url): PDF links of a seed's pages on its own domain or an allowed host, first seen first, capped per seed.

    seeds: url and, if there, exclude, pdf_hosts (arrays), max_pdfs; links: seed_url, href, seq (order within the seed).
    """
    empty = F.array().cast("array<string>")
    of = lambda c, default: F.coalesce(F.col(c), default) if c in seeds.columns else default
    plan = seeds.select(F.col("url").alias("seed"), of("exclude", empty).alias("exclude"), F.transform(of("pdf_hosts", empty), F.lower).alias("hosts"), of("max_pdfs", F.lit(max_pdfs)).alias("cap"))
    found = links.join(plan, F.col("seed_url") == F.col("seed")).filter(F.lower(urls.url_path(F.col("href"))).endswith(".pdf"))
    found = found.filter((urls.source_domain(F.col("href")) == urls.source_domain(F.col("seed"))) | F.array_contains("hosts", urls.host(F.col("href"))))
    found = found.filter(~urls.matches_glob(F.col("href"), F.col("exclude"))).withColumn("url", urls.canonical_url(F.col("href")))
    first = found.groupBy("seed", "url").agg(F.min("seq").alias("seq"), F.first("cap").alias("cap"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("seq", "url"))).filter("r <= cap").select("seed", "url")


def conditional_split(fetch_log: DataFrame, sources: DataFrame) -> DataFrame:
    """What the probe of each depth-0 seed says: not_modified, or a full crawl with the validators to keep.

    fetch_log: url, status, etag, last_modified, error; sources: url, depth, etag, last_modified. A probe that failed and
    a seed that was not probed are crawled; a 304 keeps the old validators.
    """
    log = fetch_log.select(F.col("url").alias("__u"), "status", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), F.col("error").alias("probe_error"))
    depth = F.col("depth") if "depth" in sources.columns else F.lit(0)
    known = F.col("etag").isNotNull() | F.col("last_modified").isNotNull()
    same = (depth == 0) & known & F.col("probe_error").isNull() & (F.col("status") == 304)
    same = F.coalesce(same, F.lit(False))
    heard = ~same & F.col("status").isNotNull() & F.col("probe_error").isNull()
    return sources.join(log, F.col("url") == F.col("__u"), "left").select(
        *[c for c in sources.columns if c not in ("etag", "last_modified")],
        same.alias("not_modified"),
        F.when(heard, F.col("new_etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(heard, F.col("new_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
    )


