"""The source registry and figures about the corpus."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours after which a source of a cadence is due; any other cadence counts as monthly.
CADENCE_HOURS = {"hourly": 1, "daily": 24, "weekly": 7 * 24}
OTHER_HOURS = 30 * 24
DEFAULT_INDUSTRY = "esg"


def upsert_sources(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds registered: their metadata is refreshed, status and counts of known sources stay."""
    meta = ["source_type", "org", "industry", "cadence"]
    new = seeds.select("url", *(F.col(c).alias(f"n_{c}") for c in meta), F.lit(True).alias("__seen"))
    start = {"status": F.lit("idle"), "pages": F.lit(0), "chunks": F.lit(0)}
    cols = [F.when(F.col("__seen"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in meta else F.coalesce(c, start[c]).alias(c) if c in start else F.col(c) for c in sources.columns if c != "url"]
    return sources.join(new, "url", "full_outer").select("url", *cols).select(*sources.columns)


def apply_run_status(sources: DataFrame, outcomes: DataFrame, as_of: datetime) -> DataFrame:
    """Outcomes (url, ok, not_modified, pages, chunks, error, etag, last_modified) folded in, one for each source at most.

    Done: counts, time and validators are set. Not modified: done, time set, counts stay. Failed: status and error are set, time and
    counts stay, so that the source stays due.
    """
    o = outcomes.select("url", *(F.col(c).alias(f"o_{c}") for c in ("ok", "not_modified", "pages", "chunks", "error", "etag", "last_modified")), F.lit(True).alias("__ran"))
    ran, same = F.coalesce("__ran", F.lit(False)), F.coalesce("o_not_modified", F.lit(False))
    done = ran & (same | F.coalesce("o_ok", F.lit(False)))
    fresh = done & ~same
    new = {
        "status": F.when(done, "done").when(ran, "error").otherwise(F.col("status")),
        "pages": F.when(fresh, F.col("o_pages")).otherwise(F.col("pages")),
        "chunks": F.when(fresh, F.col("o_chunks")).otherwise(F.col("chunks")),
        "last_crawl": F.when(done, F.lit(as_of).cast(sources.schema["last_crawl"].dataType)).otherwise(F.col("last_crawl")),
        "error": F.when(done, F.lit(None)).when(ran, F.col("o_error")).otherwise(F.col("error")),
        "etag": F.when(fresh, F.coalesce("o_etag", "etag")).otherwise(F.col("etag")),
        "last_modified": F.when(fresh, F.coalesce("o_last_modified", "last_modified")).otherwise(F.col("last_modified")),
    }
    joined = sources.join(o, "url", "left")
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in sources.columns))


def _of(df: DataFrame, industry: str | None) -> DataFrame:
    return df if industry is None else df.filter(F.col("industry") == industry)


def window_hours(cadence: Column) -> Column:
    hours = F.lit(OTHER_HOURS)
    for name, n in CADENCE_HOURS.items():
        hours = F.when(cadence == name, F.lit(n)).otherwise(hours)
    return hours


def sources_due(sources: DataFrame, as_of: datetime, industry: str | None = None) -> DataFrame:
    """Sources never crawled, or whose last crawl is older than their cadence; by type and URL."""
    oldest = F.lit(as_of).cast("timestamp") - F.make_interval(hours=window_hours(F.col("cadence")))
    due = F.col("last_crawl").isNull() | (F.col("last_crawl").cast("timestamp") < oldest)
    return _of(sources, industry).filter(due).orderBy("source_type", "url")


def list_sources(sources: DataFrame, industry: str | None = None) -> DataFrame:
    return _of(sources, industry).orderBy("source_type", "url")


def corpus_stats(index: DataFrame, sources: DataFrame, industry: str | None = None) -> DataFrame:
    """chunks, sources and pages per vertical, and in all (industry null)."""
    chunks = _of(index, industry).groupBy("industry").agg(F.count(F.lit(1)).alias("chunks"))
    known = _of(sources, industry).groupBy("industry").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "sources", "pages")]
    return chunks.join(known, "industry", "full_outer").rollup("industry").agg(*total)


def loaded_industries(sources: DataFrame) -> DataFrame:
    return sources.select("industry").distinct()


def active_industry(pref_log: DataFrame, users: DataFrame, default: str = DEFAULT_INDUSTRY) -> DataFrame:
    """Each user's latest choice. Equal times: the choice that sorts last."""
    latest = pref_log.groupBy("user_id").agg(F.max(F.struct("updated_at", "active_industry")).alias("m"))
    return users.select("user_id").distinct().join(latest, "user_id", "left").select("user_id", F.coalesce("m.active_industry", F.lit(default)).alias("active_industry"))


def catalog_states(catalog: DataFrame, sources: DataFrame, prefs: DataFrame, users: DataFrame) -> DataFrame:
    """For each user (user_id): the catalog with flags loaded (it has seeds) and active (the user's choice). The catalog is small: it travels as one row."""
    loaded = loaded_industries(sources).select(F.col("industry").alias("__l"))
    state = catalog.join(loaded, F.col("id") == F.col("__l"), "left").select(F.struct(*catalog.columns, F.col("__l").isNotNull().alias("loaded")).alias("entry"))
    chosen = active_industry(prefs, users)
    each = chosen.crossJoin(F.broadcast(state.agg(F.collect_list("entry").alias("entries")))).select("user_id", "active_industry", F.explode("entries").alias("entry"))  # one row
    return each.select("user_id", *(F.col(f"entry.{c}").alias(c) for c in (*catalog.columns, "loaded")), (F.col("entry.id") == F.col("active_industry")).alias("active"))


def catalog_state(catalog: DataFrame, sources: DataFrame, prefs: DataFrame, user_id) -> DataFrame:
    """catalog_states() of one user, without the id."""
    user = prefs.sparkSession.createDataFrame([(user_id,)], prefs.select("user_id").schema)
    return catalog_states(catalog, sources, prefs, user).drop("user_id")
