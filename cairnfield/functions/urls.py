"""URL columns."""

from __future__ import annotations

import fnmatch
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters that never change what a page shows, and those of paging with their first-page values.
TRACKING_PREFIXES = ("utm_", "_gcl")
TRACKING_KEYS = ("gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid", "yclid", "_ga", "_gl", "_gac")
PAGE_KEYS = ("page", "paged", "pg")
FIRST_PAGE = ("", "0", "1")
DEFAULT_PORTS = {"http": 80, "https": 443}


def _keeps(pair: tuple[str, str]) -> bool:
    name, value = pair[0].lower(), pair[1].strip()
    if name.startswith(TRACKING_PREFIXES) or name in TRACKING_KEYS:
        return False
    return not (name in PAGE_KEYS and value in FIRST_PAGE)


def canonical(url: str | None) -> str | None:
    """One spelling for URLs that show the same page; what is no http(s) URL stays as it is."""
    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
    except ValueError:
        return url
    if parts.scheme not in DEFAULT_PORTS:
        return url
    authority = parts.hostname or ""
    if port and port != DEFAULT_PORTS[parts.scheme]:
        authority += f":{port}"
    path = parts.path if parts.path in ("", "/") else parts.path.rstrip("/")
    kept = sorted(filter(_keeps, parse_qsl(parts.query, keep_blank_values=True)))
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)
    if authority and path and not path.startswith("/"):
        path = "/" + path
    return f"{parts.scheme}://{authority}{path}" + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(canonical, na_action="ignore")


def _joined(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href or "")
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href as seen from the page base."""
    return pd.Series([_joined(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user or port; null if there is none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def source_domain(url: Column) -> Column:
    """Host without a leading www.; text that is no URL: itself, trimmed, in lower case."""
    return F.regexp_replace(F.coalesce(host(url), F.lower(F.trim(url))), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def glob_regex(patterns) -> str:
    """One anchored regular expression for all globs, lower case."""
    return "|".join(fnmatch.translate(p.lower()).replace(r"\Z", r"\z").replace(r"\z", "$") for p in patterns)


def matches_glob(url: Column, patterns) -> Column:
    """Whether the whole lower-cased URL matches one of the globs; the list may be Python's or an array column."""
    if isinstance(patterns, Column):
        # globs of each row: every special sign is quoted, then * and ? get their meaning
        quoted = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(p), r"([.\\+^$(){}\[\]|])", r"\\$1"), r"\*", ".*"), r"\?", ".")
        return F.coalesce(F.exists(patterns, lambda p: F.regexp_like(F.lower(url), F.concat(F.lit("(?s)^"), quoted(p), F.lit("$")))), F.lit(False))
    patterns = list(patterns or ())
    return F.lower(url).rlike(glob_regex(patterns)) if patterns else F.lit(False)
