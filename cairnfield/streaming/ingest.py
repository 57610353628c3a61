"""The recrawl loop as a stream: page versions arrive as files, each micro-batch makes the next version of the index.

The newest version of each page is keyed state: its time of fetching and its version_id. A version passes if it was fetched later than
what the state knows, whatever batches the versions are split into and in whatever order they come; one whose content is
already the newest only moves the time on. State goes when the watermark has passed it: from then on every version that is
not too late is newer anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnfield.operators.index import update_index
from cairnfield.operators.stages import Stages
from cairnfield.sources.snapshots import BUCKETS, BucketedIndex

LATE = "7 days"


def latest_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The index as the newest batch (before `before`) left it; empty if there is none."""
    return BucketedIndex(spark, path).read(before=before)


def _order(at: int, version: str | None) -> tuple:
    """Later first fetched, then the greater version_id: an order that no split into batches changes."""
    return at, version is not None, version or ""


def newest_version(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The page's newest version of this batch, if it is newer than all before it; of failed fetches the newest, if nothing else passes.

    A failed fetch leaves the state as it is, so that a fetch from before it still counts.
    """
    if state.hasTimedOut:
        state.remove()
        return
    best, failed = None, None
    for pdf in batches:
        # plain lists: a page has few versions, and a Series costs more than all of them
        at = pdf["fetched_at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        for i, (when, version, ok) in enumerate(zip(at, pdf["version_id"].tolist(), pdf["ok"].tolist(), strict=True)):
            row = (_order(when, None if version is None or version != version else str(version)), pdf, i)
            if ok is not None and ok == True:  # noqa: E712 - nor NaN, nor NA
                best = row if best is None or row[0] > best[0] else best
            else:
                failed = row if failed is None or row[0] > failed[0] else failed
    known = state.getOption
    seen = _order(*known) if known else None
    if best and (seen is None or best[0] > seen):
        at, has, version = best[0]
        state.update((at, version if has else None))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + 1)
        if seen is None or seen[1:] != best[0][1:]:
            yield best[1].iloc[best[2] : best[2] + 1]
        return
    if known:
        state.setTimeoutTimestamp(max(known[0] // 1000, state.getCurrentWatermarkMs()) + 1)
    if failed and (seen is None or failed[0] > seen):
        yield failed[1].iloc[failed[2] : failed[2] + 1]


def newest_versions(pages: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of page versions (url, industry, fetched_at, version_id, ok and others) without those that are not the newest of their page.

    Versions older than the watermark (`late` behind the latest fetch) or without fetched_at are dropped.
    """
    dated = pages.filter("fetched_at is not null").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", late)
    return dated.groupBy("url", "industry").applyInPandasWithState(newest_version, dated.schema, "at bigint, version string", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_stream(pages: DataFrame, path: str, checkpoint: str, encoder=None, late: str = LATE, buckets: int = BUCKETS, **options) -> StreamingQuery:
    """Starts the stream (availableNow): pages need version_id and fetched_at besides the columns of incremental_index.

    Each batch is a version of the bucketed index at path, with its results per page in path/results/batch=n. Versions are single
    pages, not whole seeds: a fetched page without text loses its chunks, a failed fetch and pages that do not occur change nothing.
    A batch that is run again reads the same state and the same predecessor, so that a restart changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with Stages(spark, f"{path}/stages/batch={batch_id}") as stages:
            rows = stages.keep(batch)
            as_of = rows.agg(F.max("fetched_at")).first()[0]
            if as_of is None:
                return
            store = BucketedIndex(spark, path, buckets)
            results = update_index(store, batch_id, rows.drop("fetched_at", "version_id"), as_of, encoder, whole_seeds=False, stages=stages, **options)
            results.write.mode("overwrite").parquet(f"{path}/results/batch={batch_id}")

    return newest_versions(pages, late).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
