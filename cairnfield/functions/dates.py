"""Publish dates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where pages state their date, the most trusted first.
DATE_META_KEYS = (
    "article:published_time",
    "og:published_time",
    "citation_publication_date",
    "citation_date",
    "dcterms.date",
    "dcterms.created",
    "dc.date.issued",
    "dc.date",
    "datepublished",
    "publishdate",
    "publish-date",
    "pubdate",
    "date",
)
CRAWLER_KEYS = ("article:published_time", "og:published_time", "published_time", "date")
HEAD_CHARS = 200_000
FIRST_YEAR = 1990


def parse_iso_date(col: Column, as_of: datetime) -> Column:
    """UTC timestamp of an ISO date or time, else of its date-only prefix; null outside 1990 .. next year, and for prose.

    The year is that of the text as written, before its offset is applied.
    """
    s = F.trim(col)
    shape = s.rlike(r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?\s?(Z|[+\-]\d{2}:?\d{2})?)?$")
    dashed = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    full = F.when(shape, F.try_to_timestamp(dashed))
    prefix = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(s, 1, 10)))
    year = F.substring(s, 1, 4).try_cast("int")
    return F.when(year.between(FIRST_YEAR, as_of.year + 1), F.coalesce(full, prefix))


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*'([^']*)'", 1)
    return F.when(quoted != "", quoted).when(single != "", single)


def published_at(meta: Column | None, html: Column, as_of: datetime) -> Column:
    """The date that the crawler's metadata (map of strings) states, else the page's meta tags by priority, else JSON-LD."""
    candidates = [parse_iso_date(meta[k], as_of) for k in CRAWLER_KEYS] if meta is not None else []
    head = F.substring(F.coalesce(html, F.lit("")), 1, HEAD_CHARS)
    tags = F.transform(
        F.regexp_extract_all(head, F.lit(r"(?i)(<meta\b[^>]*>)"), 1),
        lambda t: F.struct(
            F.lower(F.trim(F.coalesce(_attribute(t, "property"), _attribute(t, "name"), _attribute(t, "itemprop")))).alias("key"),
            _attribute(t, "content").alias("content"),
        ),
    )
    tags = F.filter(tags, lambda t: t["key"].isNotNull() & t["content"].isNotNull())

    def stated(key: str) -> Column:
        return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["content"]

    # of each key the first tag speaks; of the keys, the first in order whose date parses
    dated = [parse_iso_date(stated(k), as_of) for k in DATE_META_KEYS]
    linked = parse_iso_date(F.regexp_extract(head, r'(?i)"datePublished"\s*:\s*"([^"]+)"', 1), as_of)
    return F.coalesce(*candidates, *dated, linked)
