"""The index on disk, the stream over it, and windows as slices."""

import hashlib
import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import text as tx
from cairnfield.operators import chunking, index
from cairnfield.operators.stages import Stages
from cairnfield.sources import readers, snapshots
from cairnfield.streaming import ingest

PAGE = "source_url string, industry string, url string, title string, org string, source_type string, text string, ok boolean, error string, published_at timestamp"
DAY0 = datetime(2024, 6, 1)


def page(url, text, ok=True, seed="s1", industry="esg", date=None):
    return (seed, industry, url, "T", None, "news", text, ok, None if ok else "boom", date)


def crawl(spark, store, version, rows, **kw):
    with Stages(spark) as stages:
        return index.update_index(store, version, spark.createDataFrame(rows, PAGE), DAY0 + timedelta(days=version), size=4, overlap=1, stages=stages, **kw).collect()


def content(df):
    return sorted((r.url, r.industry, r.text) for r in df.collect())


def folders(tmp_path, run):
    return len(list((tmp_path / f"data/run={run}").glob("part=*")))


def test_a_small_crawl_rewrites_few_buckets(spark, tmp_path):
    store = snapshots.BucketedIndex(spark, str(tmp_path), buckets=16)
    rows = [page(f"u{i}", f"text number {i}", seed=f"s{i % 50}") for i in range(400)]
    crawl(spark, store, 0, rows)
    assert folders(tmp_path, 0) == 16
    before = content(store.read())
    # four pages change: no more buckets than pages are written, others keep the files of the first run
    changed = [page(f"u{i}", f"other {i}", seed=f"s{i % 50}") for i in (3, 77, 150, 301)]
    results = crawl(spark, store, 1, changed, whole_seeds=False)
    assert folders(tmp_path, 1) <= 4 and sum(r.changed for r in results) == 4
    assert content(store.read()) == sorted([b for b in before if b[0] not in ("u3", "u77", "u150", "u301")] + [(c[2], "esg", c[6]) for c in changed])
    assert content(store.read(before=1)) == before
    # the same again changes nothing, and writes nothing
    crawl(spark, store, 2, changed, whole_seeds=False)
    assert folders(tmp_path, 2) == 0 and content(store.read()) == content(store.read(before=2))
    # a version that is repeated is the same
    crawl(spark, store, 1, changed, whole_seeds=False)
    assert content(store.read(before=2)) == content(store.read())


def test_same_as_the_index_in_one_piece(spark, tmp_path):
    """Whole seeds over two runs: pages that shrink, fail, vanish, are dated, lie in two verticals; buckets give what the whole gives."""
    store = snapshots.BucketedIndex(spark, str(tmp_path), buckets=4)
    runs = [
        [page("a", "1 2 3 4 5 6 7 8 9"), page("b", "x y"), page("c", "k", seed="s2"), page("d", "m n", seed="s3", industry="eco"), page("a", "1 2", seed="s4", industry="eco")],
        [page("a", "Z 2 3 4", date=DAY0), page("b", None, ok=False), page("e", " \n"), page("c", "k", seed="s2", date=DAY0), page("d", None, ok=False, seed="s3", industry="eco")],
        [page("a", "Z 2 3 4", date=DAY0)],
    ]
    whole = spark.createDataFrame([], readers.CHUNKS)
    for version, rows in enumerate(runs):
        crawl(spark, store, version, rows)
        out, _ = index.incremental_index(whole, spark.createDataFrame(rows, PAGE), DAY0 + timedelta(days=version), size=4, overlap=1)
        whole = Stages(spark).keep(out)
        columns = [c for c in whole.columns if c != "dense"]
        assert sorted(map(str, store.read().select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    assert content(store.read("eco")) == [("d", "eco", "m n")]
    assert store.read("none").count() == 0


def test_readers_see_whole_versions_and_vacuum_keeps_what_is_named(spark, tmp_path):
    store = snapshots.BucketedIndex(spark, str(tmp_path), buckets=4)
    assert store.manifest() is None and store.read().count() == 0
    for v in range(4):
        crawl(spark, store, v, [page("a", f"version {v}"), page("b", "always")])
    (tmp_path / "data/run=9").mkdir()  # a run that was cut off
    assert content(store.read()) == [("a", "esg", "version 3"), ("b", "esg", "always")]
    assert store.vacuum(keep=1) and store.versions() == [3]
    assert content(store.read()) == [("a", "esg", "version 3"), ("b", "esg", "always")]
    assert snapshots.BucketedIndex(spark, str(tmp_path), buckets=99).buckets == 4
    with pytest.raises(ValueError, match="outside"):
        store.rewrite(5, set(), store.read())


def test_null_and_odd_verticals(spark, tmp_path):
    store = snapshots.BucketedIndex(spark, str(tmp_path), buckets=2)
    crawl(spark, store, 0, [page("a", "x", industry="a/b=c d"), page("b", "y", industry="ü")])
    assert content(store.read("a/b=c d")) == [("a", "a/b=c d", "x")] and store.read().count() == 2


# ------------------------------------------------------------------------------ the stream


def stream(spark, tmp_path, batches, **kw):
    schema = PAGE + ", fetched_at timestamp, version_id bigint"
    for n, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/feed/f{n:03d}")
        feed = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/feed")
        ingest.ingest_stream(feed, f"{tmp_path}/index", f"{tmp_path}/cp", buckets=4, size=4, overlap=1, **kw).awaitTermination()
    return content(ingest.latest_snapshot(spark, f"{tmp_path}/index"))


def seen(url, text, day, ok=True):
    return (*page(url, text, ok), DAY0 + timedelta(days=day), hash(text))


def test_reverts_and_late_versions(spark, tmp_path):
    batches = [[seen("p", "one", 0), seen("q", "q1", 1)], [seen("p", "two", 1)], [seen("p", "one", 2), seen("q", "older", 0.5)], [seen("p", "zero", 1.5), seen("q", None, 3, ok=False)]]
    assert stream(spark, tmp_path, batches) == [("p", "esg", "one"), ("q", "esg", "q1")]
    results = spark.read.parquet(f"{tmp_path}/index/results")
    assert {(r.url, r.error) for r in results.filter("error is not null").collect()} == {("q", "boom")}


@pytest.mark.parametrize("split", [[4], [1, 3], [2, 2]])
def test_any_order_and_split_gives_the_newest(spark, tmp_path, split):
    versions = [seen("p", "one", 0), seen("p", "two", 1), seen("p", "one", 2), seen("r", "r1", 1)]
    for n, order in enumerate(list(itertools.permutations(versions))[:: 11]):
        at = list(itertools.accumulate(split, initial=0))
        where = tmp_path / str(n)
        where.mkdir()
        assert stream(spark, where, [list(order[a:b]) for a, b in zip(at, at[1:])]) == [("p", "esg", "one"), ("r", "esg", "r1")]


def test_restart_changes_nothing_and_late_pages_stay_out(spark, tmp_path):
    first = stream(spark, tmp_path, [[seen("p", "one", 0), seen("p", "one", 0), seen("e", " ", 1)], [seen("p", "two", 30)], []])
    assert first == [("p", "esg", "two")]
    manifests = sorted((tmp_path / "index/manifest").glob("*.json"))
    # p's state has gone with the watermark; an older version is too late
    assert stream(spark, tmp_path / "x", []) == [] and stream_more(spark, tmp_path, [seen("p", "late", 3)]) == first
    assert sorted((tmp_path / "index/manifest").glob("*.json")) == manifests


def stream_more(spark, tmp_path, rows):
    schema = PAGE + ", fetched_at timestamp, version_id bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/feed/late")
    feed = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/feed")
    ingest.ingest_stream(feed, f"{tmp_path}/index", f"{tmp_path}/cp", buckets=4, size=4, overlap=1).awaitTermination()
    return content(ingest.latest_snapshot(spark, f"{tmp_path}/index"))


def test_a_page_that_turns_empty_loses_its_chunks(spark, tmp_path):
    assert stream(spark, tmp_path, [[seen("p", "one", 0), seen("q", "two", 0)], [seen("p", " \n ", 1)]]) == [("q", "esg", "two")]


# ------------------------------------------------------------------------------ roll-up and windows


def test_rollup_names_few_errors_and_counts_all(spark):
    rows = [("s1", f"u{i:04d}", False, False, 0, 0, 0, 0, "boom") for i in range(300)] + [("s2", "a", True, False, 1, 0, 0, 1, None), (None, "z", False, False, 0, 0, 0, 0, "odd")]
    df = spark.createDataFrame(rows, "source_url string, url string, ok boolean, not_modified boolean, changed int, skipped int, removed int, chunks int, error string")
    got = {(r.source_url, r.is_run): r for r in index.run_rollup(df, first=3).collect()}
    assert got["s1", 0].n_errors == 300 and got["s1", 0].first_errors == ["u0000: boom", "u0001: boom", "u0002: boom"] and not got["s1", 0].ok
    assert got["s2", 0].first_errors == [] and got["s2", 0].ok and got[None, 0].first_errors == ["z: odd"]
    assert got[None, 1].n_errors == 301 and got[None, 1].first_errors == ["u0000: boom", "u0001: boom", "u0002: boom"]
    assert index.run_errors(df).count() == 301


def test_rollup_digests_all_errors(spark, monkeypatch):
    monkeypatch.setattr(index, "PIECE", 100)
    names = [("s1", f"u{i % 250:04d}") for i in range(300)] + [(None, "z"), ("s2", None)]
    rows = [(s, u, False, False, 0, 0, 0, 0, "boom") for s, u in names] + [("s3", "a", True, False, 1, 0, 0, 1, None)]
    df = spark.createDataFrame(rows, "source_url string, url string, ok boolean, not_modified boolean, changed int, skipped int, removed int, chunks int, error string")
    got = {(r.source_url, r.is_run): r.errors_sha256 for r in index.run_rollup(df).collect()}
    line = lambda u: f"{u}: boom" if u else "boom"
    sha = lambda lines: hashlib.sha256(",".join(sorted(lines)).encode()).hexdigest()
    want = {(s, 0): sha(line(u) for t, u in names if t == s) for s in ("s1", "s2", None)}
    assert got == want | {("s3", 0): sha([]), (None, 1): sha(line(u) for _, u in names)}


def test_windows_are_slices_of_the_normalised_text(spark):
    text = "Title\n\nFirst line here.\nSecond  line\there; third piece\n\n\n\nend  "
    docs = spark.createDataFrame([("u", text, 1), ("v", None, 2), ("w", " \n ", 3), ("x", "one", 4)], "url string, text string, ordinal int")
    norm = {r.url: r.n for r in docs.select("url", tx.normalize_text(F.coalesce("text", F.lit(""))).alias("n")).collect()}
    rows = chunking.chunk_windows(docs, 4, 1).orderBy("url", "ordinal").collect()
    assert [(r.url, r.text) for r in rows if r.url == "u"] == [("u", "Title\n\nFirst line here."), ("u", "here.\nSecond line here;"), ("u", "here; third piece\n\nend")]
    assert all(norm[r.url][r.begin_char : r.end_char] == r.text for r in rows) and [r.url for r in rows] == ["u", "u", "u", "x"]


def test_a_subword_tokenizer_plugs_in(spark):
    docs = spark.createDataFrame([("u", "abcdefgh ij\nklm")], "url string, text string")
    rows = chunking.chunk_windows(docs, 3, 1, tokenize=lambda t: F.regexp_extract_all(t, F.lit("(?s).{1,2}"), F.lit(0))).orderBy("ordinal").collect()
    assert [(r.text, r.begin_char, r.end_char, r.token_count) for r in rows] == [("abcdef", 0, 6, 3), ("efgh i", 4, 10, 3), ("ij\nkl", 9, 14, 3), ("klm", 12, 15, 2)]
    assert all("abcdefgh ij\nklm"[r.begin_char : r.end_char] == r.text for r in rows)


def test_vectors_are_made_above_all_joins(spark):
    """What a crawl writes is joined before it is embedded, so that no vector of it is shuffled."""
    from cairnfield.sources.readers import CHUNKS

    old = spark.createDataFrame([], CHUNKS)
    pages = spark.createDataFrame([], "source_url string, industry string, url string, title string, org string, source_type string, text string, ok boolean, error string, published_at timestamp")
    chunks = old.drop("dense", "crawled_at")
    out = index.apply_crawl(old, pages, chunks, index.diff_chunks(old, chunks), datetime(2024, 1, 1))
    above: list[str] = []
    for line in out._jdf.queryExecution().analyzed().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if len(x) - len(x.lstrip(" :+-")) < depth] + [line]
        if "encode(" in line:
            assert not any("Join" in x for x in above[:-1])


def test_state_takes_one_row_of_many_versions(monkeypatch):
    """The newest version is found in plain lists; of the frame only the row that passes is cut out."""
    import pandas as pd

    class State:
        hasTimedOut, getOption, kept = False, None, None

        def update(self, value):
            self.kept = value

        def setTimeoutTimestamp(self, _):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    rows = pd.DataFrame({"fetched_at": pd.to_datetime(["2024-01-01", "2024-01-03", "2024-01-03", "2024-01-09", "2024-01-02"]), "version_id": ["a", None, "b", "c", "d"], "ok": pd.Series([True, True, True, None, False], dtype=object)})
    cut = []
    whole = pd.DataFrame.iloc.fget if isinstance(pd.DataFrame.iloc, property) else pd.core.indexing.IndexingMixin.iloc.fget
    monkeypatch.setattr(pd.DataFrame, "iloc", property(lambda self: cut.append(1) or whole(self)), raising=False)
    state = State()
    (found,) = ingest.newest_version(("u", "x"), iter([rows]), state)
    assert found["version_id"].tolist() == ["b"] and state.kept[1] == "b" and len(cut) == 1
    (failed,) = ingest.newest_version(("u", "x"), iter([rows[3:]]), State())
    assert failed["version_id"].tolist() == ["c"]
