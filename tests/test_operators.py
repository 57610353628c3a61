from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import answers, chunking, evaluate, index, pages, rank, registry, retrieve, train
from cairnfield.sources import readers

AS_OF = datetime(2024, 6, 1)


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [1]), (448, [448]), (511, [511]), (512, [512]), (513, [512, 65]), (960, [512, 512]), (961, [512, 512, 65])])
def test_windows(spark, n, want):
    docs = spark.createDataFrame([("u", " ".join(f"w{i}" for i in range(n)))], "url string, text string")
    got = chunking.chunk_windows(docs).orderBy("ordinal").collect()
    assert [r.token_count for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))
    if len(got) > 1:
        assert got[0].text.split()[-64:] == got[1].text.split()[:64]


def test_dedupe_and_exclude(spark):
    p = spark.createDataFrame([(2, "http://a.org/x/"), (1, "http://a.org/x?utm_id=1"), (3, "http://a.org/login")], "page_seq int, url string")
    assert [r.page_seq for r in pages.dedupe_pages(p).orderBy("page_seq").collect()] == [1, 3]
    assert pages.filter_excluded(p, readers.EXCLUDE).count() == 2


def test_main_text_rows(spark):
    p = spark.createDataFrame([("http://a.org", "<p>hello</p>"), ("http://b.org", ""), ("http://c.org", None)], "url string, html string")
    got = {r.url: (r.title, r.text, r.ok, r.error) for r in pages.extract_main_text(p).collect()}
    assert got["http://a.org"] == ("http://a.org", "hello", True, None)
    assert got["http://b.org"] == ("http://b.org", "", False, "empty markdown") and not got["http://c.org"][2]


def test_pdf_pages(spark):
    t = datetime(2023, 1, 2)
    rows = [
        ("http://a.org/d/climate-plan_2023.pdf", None, "soft\nwrap climate-\nrelated\n\nnext  para\n", t, None),
        ("http://a.org/x.pdf", " Title ", "body", datetime(1970, 1, 1), t),
        ("http://a.org/y.pdf", None, " \n", None, None),
    ]
    p = spark.createDataFrame(rows, "url string, title string, text string, creation_date timestamp, modification_date timestamp")
    a, b, c = pages.prepare_pdf_pages(p, AS_OF).collect()
    assert (a.title, a.text, a.ok, a.published_at) == ("climate plan 2023", "soft wrap climate-related\n\nnext para", True, t)
    assert (b.title, b.published_at) == ("Title", t) and (c.ok, c.title, c.published_at) == (False, "y", None)


def test_links_frontier_and_pdfs(spark):
    p = spark.createDataFrame([("http://a.org/x/", '<a href="y">1</a><a class=z HREF=\'/z.pdf\'>2</a><a href="#top">3</a><a href="mailto:q">4</a>')], "url string, html string")
    assert [r.href for r in pages.extract_links(p).orderBy("seq").collect()] == ["http://a.org/x/y", "http://a.org/z.pdf"]
    links = [("http://a.org/", "http://a.org/1"), ("http://a.org/", "http://www.a.org/2"), ("http://a.org/", "http://b.org/"), ("http://a.org/1", "http://a.org/3"), ("http://a.org/3", "http://a.org/4"), ("http://a.org/", "http://a.org/login")]
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    table = spark.createDataFrame(links, "src string, dst string")
    got = pages.crawl_frontier(seeds, table, 2, 25, ["*/login*"])
    assert {(r.url, r.depth) for r in got.collect()} == {("http://a.org/", 0), ("http://a.org/1", 1), ("http://www.a.org/2", 1), ("http://a.org/3", 2)}
    assert pages.crawl_frontier(seeds, table, 2, 2).count() == 2 and pages.crawl_frontier(seeds, table, 0).count() == 1
    pdfs = [("http://a.org/", "http://a.org/1.pdf", 0), ("http://a.org/", "http://a.org/1.PDF?utm_x=1", 1), ("http://a.org/", "http://cdn.net/2.pdf", 2), ("http://a.org/", "http://evil.net/3.pdf", 3), ("http://a.org/", "http://a.org/skip/4.pdf", 4)]
    plan = spark.createDataFrame([("http://a.org/", ["*/skip/*"], ["CDN.net"], 9)], "url string, exclude array<string>, pdf_hosts array<string>, max_pdfs int")
    got = [r.url for r in pages.harvest_pdf_links(plan, spark.createDataFrame(pdfs, "seed_url string, href string, seq int")).collect()]
    assert sorted(got) == ["http://a.org/1.PDF", "http://a.org/1.pdf", "http://cdn.net/2.pdf"]


def test_frontier_budgets_and_hubs(spark):
    """Against breadth-first search by hand; a hub of very many links makes no more rows than the budget."""
    hub = [("http://h.org/", f"http://h.org/{i:06d}") for i in range(100_000)]
    rng = np.random.default_rng(5)
    web = [(f"http://w.org/{a}", f"http://w.org/{z}") for a, z in rng.integers(0, 60, size=(240, 2))]
    links = spark.createDataFrame([*hub, *web, ("http://h.org/000001", "http://h.org/a"), ("http://h.org/", None)], "src string, dst string").repartition(8)
    plan = [("http://h.org/", 2, 30), ("http://w.org/1", 3, 9), ("http://w.org/2", 3, 500), ("http://w.org/3", 1, 1), ("http://w.org/4", 0, 5), ("http://w.org/5", 2, 0), (None, 1, 5), ("http://w.org/6", None, None)]
    seeds = spark.createDataFrame(plan, "url string, depth int, max_pages int")
    assert pages.first_links(links, spark.createDataFrame([("http://h.org/",)], "url string"), 30).count() == 30
    after = {}
    for a, z in (*hub, *web, ("http://h.org/000001", "http://h.org/a")):
        after.setdefault(a, set()).add(z)
    want = set()
    for seed, depth, most in plan:
        depth, most = (2, 4) if depth is None else (depth, most)
        known, level = ([seed], [seed]) if seed and most else ([], [])
        want |= {(seed, u, 0) for u in known}
        for at in range(1, depth + 1):
            level = sorted({z for u in level for z in after.get(u, ())} - set(known))[: most - len(known)]
            known += level
            want |= {(seed, u, at) for u in level}
    got = [tuple(r) for r in pages.crawl_frontier(seeds, links, 2, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pages.crawl_frontier(seeds.limit(0), links).count() == 0


def test_conditional_split(spark):
    log = spark.createDataFrame([("a", 304, None, None, None), ("b", 200, "e2", "m2", None), ("c", None, None, None, "timeout"), ("d", 304, None, None, None)], "url string, status int, etag string, last_modified string, error string")
    src = spark.createDataFrame([("a", 0, "e1", None), ("b", 0, "e1", "m1"), ("c", 0, "e1", None), ("d", 1, "e1", None), ("x", 0, None, None)], "url string, depth int, etag string, last_modified string")
    got = {r.url: (r.not_modified, r.etag) for r in pages.conditional_split(log, src).collect()}
    assert got["a"] == (True, "e1") and got["b"] == (False, "e2") and got["c"] == (False, "e1") and not got["d"][0] and got["x"] == (False, None)


PAGE = "source_url string, industry string, url string, title string, org string, source_type string, text string, ok boolean, error string, published_at timestamp"


def page(url, text, ok=True, seed="s1", industry="esg", date=None):
    return (seed, industry, url, "T", None, "news", text, ok, None if ok else "boom", date)


def crawl(spark, old, rows, as_of=AS_OF):
    out, results = index.incremental_index(old, spark.createDataFrame(rows, PAGE), as_of, size=4, overlap=1)
    path = index_path(spark)
    out.write.parquet(path)
    return spark.read.parquet(path), results


def index_path(spark):
    import tempfile

    return tempfile.mkdtemp(prefix="spark-") + "/index"


def test_incremental_index(spark):
    empty = spark.createDataFrame([], readers.CHUNKS)
    first, results = crawl(spark, empty, [page("p1", "a b c d e f g"), page("p2", "x y"), page("p3", "k", seed="s2", industry="eco")])
    assert first.count() == 4 and {(r.url, r.changed, r.skipped) for r in results.collect()} == {("p1", 2, 0), ("p2", 1, 0), ("p3", 1, 0)}
    again, results = crawl(spark, first, [page("p1", "a b c d e f g"), page("p2", "x y"), page("p3", "k", seed="s2", industry="eco")], datetime(2025, 1, 1))
    assert sum(r.changed for r in results.collect()) == 0 and again.filter("crawled_at > '2024-12-31'").count() == 0
    d = datetime(2024, 1, 1)
    # p1 shrinks and changes, p2 fails and goes; s2 as a whole failed and stays
    third, results = crawl(spark, again, [page("p1", "a b c Z", date=d), page("p2", None, ok=False), page("p3", None, ok=False, seed="s2", industry="eco")], datetime(2025, 2, 2))
    assert {(r.url, r.text) for r in third.collect()} == {("p1", "a b c Z"), ("p3", "k")}
    assert {(r.url, r.error) for r in results.collect()} == {("p1", None), ("p2", "boom"), ("p3", "boom")}
    # a seed all of whose fetched pages are empty loses everything
    assert crawl(spark, third, [page("p1", " \n")])[0].filter("source_url = 's1'").count() == 0


def test_stamping_and_scopes(spark):
    empty = spark.createDataFrame([], readers.CHUNKS)
    first, _ = crawl(spark, empty, [page("p", "a b"), page("q", "c", seed="s2", industry="eco")])
    stamped = index.stamp_published_at(first, spark.createDataFrame([("p", AS_OF), ("q", None)], "url string, published_at timestamp"))
    assert {(r.url, r.published_at) for r in stamped.collect()} == {("p", AS_OF), ("q", None)}
    seeds = spark.createDataFrame([("s1", "esg"), ("s9", "esg")], "url string, industry string")
    left, _, removed = index.delete_source(first, seeds, seeds)
    assert [r.url for r in left.collect()] == ["q"] and {(r.source_url, r.removed) for r in removed.collect()} == {("s1", 1), ("s9", 0)}
    assert index.delete_url(first, spark.createDataFrame([("p",)], "url string")).count() == 1


def test_dense_topk_is_exact_and_scoped(spark):
    rng = np.random.default_rng(0)
    vecs = [[float(x) for x in rng.normal(size=8)] for _ in range(60)]
    chunks = spark.createDataFrame([(i, "ab"[i % 2], v) for i, v in enumerate(vecs)], "id long, industry string, dense array<float>")
    asked = spark.createDataFrame([(q, "ab"[q % 2], vecs[q]) for q in range(6)], "query_id long, industry string, vec array<float>")
    a = np.array(vecs, dtype=np.float32).astype(float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    for blocks, limit in ((None, retrieve.BROADCAST_BYTES), (3, 0)):
        retrieve.BROADCAST_BYTES, kept = limit, retrieve.BROADCAST_BYTES
        got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieve.dense_topk(asked, chunks, 5, blocks=blocks).collect()}
        retrieve.BROADCAST_BYTES = kept
        for q in range(6):
            want = sorted((i for i in range(60) if i % 2 == q % 2), key=lambda i: (-round(float(a[q] @ a[i]), 5), i))[:5]
            assert [got[q, r] for r in range(1, 6)] == want


def test_bm25_and_fusion(spark):
    chunks = spark.createDataFrame([("c1", "x", "carbon price rules"), ("c2", "x", "carbon carbon"), ("c3", "x", "other words"), ("c4", "y", "carbon")], "id string, industry string, text string")
    asked = spark.createDataFrame([("q", "Carbon RULES?", "x")], "query_id string, query string, industry string")
    lex = retrieve.bm25_topk(asked, chunks, 10)
    assert [r.chunk_id for r in lex.orderBy("rank").collect()] == ["c1", "c2"]
    dense = spark.createDataFrame([("q", "c3", 0.9, 1), ("q", "c1", 0.5, 2)], "query_id string, chunk_id string, score double, rank int")
    fused = {r.chunk_id: r for r in retrieve.rrf_fuse(dense, lex, top_k=3).collect()}
    assert fused["c1"].score == pytest.approx(1 / 62 + 1 / 61) and fused["c1"]["rank"] == 1 and not fused["c2"].in_dense
    trace = retrieve.pipeline_trace(retrieve.rrf_fuse(dense, lex, top_k=3)).first()
    assert (trace.dense, trace.bm25, trace.fused) == (2, 2, 3)


def test_recency(spark):
    old, half = datetime(2000, 1, 1), datetime(2023, 12, 4)
    rows = [("q", "a", 1, 0.90, "report", AS_OF), ("q", "b", 2, 0.89, "news", datetime(2030, 1, 1)), ("q", "c", 3, 0.5, "news", half), ("q", "d", 4, 0.4, "news", None), ("q", "e", 5, 0.3, "news", old)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double, source_type string, published_at timestamp")
    got = {r.chunk_id: r for r in rank.recency_prior(hits, AS_OF).collect()}
    assert got["b"]["rank"] == 1 and got["b"].score == pytest.approx(0.89 * 1.05) and got["a"].score == 0.9
    assert got["c"].score == pytest.approx(0.5 * 1.025, rel=1e-3) and got["d"].score == 0.4 and got["e"].score == pytest.approx(0.3, rel=1e-6)


def test_answers(spark):
    replies = [("None.", 3), ("none", 3), ("NONE of the passages", 3), ("", 3), ("Yes [2][9][1] [2]", 3), (None, 1)]
    got = [(r.answer, r.citations) for r in answers.parse_answers(spark.createDataFrame(replies, "content string, n_passages int")).collect()]
    assert got == [(None, []), (None, []), ("NONE of the passages", []), (None, []), ("Yes [2][9][1] [2]", [1, 2]), (None, [])]
    results = spark.createDataFrame([("q", 1, "<mark>a</mark> &amp;lt; b"), ("q", 2, " "), ("q", 3, "c")], "query_id string, rank int, highlight string")
    assert answers.build_prompts(results).first().sources == "[1] a &lt; b\n\n[3] c"


def test_structured(spark):
    fields = spark.createDataFrame([("r", 0, "Net Zero?"), ("r", 1, "net-zero"), ("r", 2, "???"), ("r", 3, "Other")], "request_id string, ordinal int, name string")
    assert [r.key for r in answers.field_keys(fields).orderBy("ordinal").collect()] == ["net_zero", "net_zero_2", "field_2", "other"]
    content = '{"net_zero": {"value": " 2050 ", "sources": [3, 1, 3, 9]}, "net_zero_2": {"value": null, "sources": [1]}, "field_2": {"value": " "}}'
    got = answers.parse_structured(spark.createDataFrame([("r", content, 3)], "request_id string, content string, n_passages int"), fields).orderBy("ordinal").collect()
    assert [(r.value, r.citations) for r in got] == [("2050", [1, 3]), (None, []), (None, []), (None, [])]
    auto = '{"fields": [{"name": " a ", "value": "v", "sources": [2]}, {"name": "", "value": "w"}, {"name": "b"}]}'
    got = answers.parse_auto_fields(spark.createDataFrame([("r", auto, 1)], "request_id string, content string, n_passages int")).collect()
    assert [(r.name, r.value, r.citations) for r in got] == [("a", "v", []), ("b", None, [])]


def test_training_pairs_and_citations(spark):
    chunks = spark.createDataFrame([("c", "u", "text")], "id string, url string, text string")
    replies = spark.createDataFrame([("c", 'Here: ["q1", " ", "q2"] done'), ("c", "no array"), ("c", "[broken")], "chunk_id string, content string")
    assert sorted(r["query"] for r in train.build_pairs(replies, chunks).collect()) == ["q1", "q2"]
    assert "text" in train.synth_prompts(chunks).first().prompt
    results = spark.createDataFrame([("q", 1, "http://www.a.org/1", "x"), ("q", 2, "http://b.org", "y"), ("q", 3, "http://a.org/3", "z")], "query_id string, rank int, url string, title string")
    cited = spark.createDataFrame([("w", "q", [3, 1, 3, 7, 2])], "answer_id string, query_id string, citations array<int>")
    got = {r.host: (r["rank"], r.extra) for r in answers.citations_by_host(cited, results).collect()}
    assert got == {"a.org": (3, 1), "b.org": (2, 0)}


def test_metrics(spark):
    run = [("r", "q1", 1, "http://x.org/a"), ("r", "q1", 2, "http://x.org/b"), ("r", "q1", 3, "http://www.good.org/1"), ("r", "q2", 1, "http://bad.org")]
    qrels = [("q1", "", ["https://good.org/", "https://other.org"]), ("q2", "", ["http://good.org"]), ("q3", "", ["http://good.org"])]
    scores = evaluate.score_queries(spark.createDataFrame(run, "run string, query_id string, rank int, url string"), spark.createDataFrame(qrels, "id string, query string, relevant array<string>"))
    got = {r.query_id: r for r in scores.collect()}
    assert got["q1"].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3))) and got["q1"].mrr == 0.5 and got["q1"].recall == 0.5 and got["q1"].first_rank == 2
    assert (got["q2"].ndcg, got["q3"].mrr, got["q3"].first_rank) == (0, 0, None)
    reports = spark.createDataFrame([("a", 0.5, 0.5, 0.5), ("b", 0.506, 0.5, 0.5), ("c", 0.6, 0.4, 0.5)], "run string, ndcg double, mrr double, recall double")
    assert [evaluate.ship_verdict(reports, "a", c).first().ship for c in "bca"] == [True, False, False]


def test_registry(spark):
    cols = "url string, source_type string, org string, industry string, cadence string, status string, pages int, chunks int, last_crawl timestamp, error string, etag string, last_modified string"
    src = spark.createDataFrame([("a", "news", None, "esg", "daily", "done", 3, 9, datetime(2024, 5, 30), None, None, None), ("b", "ngo", None, "esg", "odd", "idle", 0, 0, datetime(2024, 5, 30), None, "e", None), ("c", "ngo", None, "eco", "weekly", "idle", 0, 0, None, None, None, None)], cols)
    assert [r.url for r in registry.sources_due(src, AS_OF).collect()] == ["a", "c"]
    out = spark.createDataFrame([("a", False, False, 0, 0, "x", None, None), ("b", True, True, 0, 0, None, None, None), ("c", True, False, 2, 5, None, "e9", None)], "url string, ok boolean, not_modified boolean, pages int, chunks int, error string, etag string, last_modified string")
    got = {r.url: r for r in registry.apply_run_status(src, out, AS_OF).collect()}
    assert (got["a"].status, got["a"].last_crawl, got["a"].error) == ("error", datetime(2024, 5, 30), "x")
    assert (got["b"].status, got["b"].pages, got["b"].last_crawl, got["b"].etag) == ("done", 0, AS_OF, "e")
    assert (got["c"].status, got["c"].pages, got["c"].chunks, got["c"].etag) == ("done", 2, 5, "e9")
    seeds = spark.createDataFrame([("a", "report", "O", "esg", "weekly"), ("z", "ngo", None, "esg", "monthly")], "url string, source_type string, org string, industry string, cadence string")
    got = {r.url: r for r in registry.upsert_sources(src, seeds).collect()}
    assert (got["a"].source_type, got["a"].pages, got["a"].status) == ("report", 3, "done") and (got["z"].status, got["z"].pages) == ("idle", 0) and len(got) == 4


def test_seeds_catalog_and_files(spark, tmp_path):
    (tmp_path / "seeds.jsonl").write_text('{"url": "http://a.org", "source_type": "ngo", "crawl": {"max_depth": 0, "exclude": ["*/x/*"]}}\n{"url": "http://b.org", "source_type": "news", "cadence": "daily"}\n')
    (tmp_path / "catalog.jsonl").write_text('{"id": "esg", "label": "ESG"}\n')
    catalog = readers.read_catalog(spark, f"{tmp_path}/catalog.jsonl")
    seeds = readers.read_seeds(spark, f"{tmp_path}/seeds.jsonl", "esg", catalog)
    with pytest.raises(ValueError, match="unknown"):
        readers.read_seeds(spark, f"{tmp_path}/seeds.jsonl", "nope", catalog)
    got = {r.url: r for r in readers.resolve_crawl_config(seeds).collect()}
    a, b = got["http://a.org"], got["http://b.org"]
    assert (a.depth, a.max_pages, a.max_pdfs, a.cadence) == (0, 25, 4, "monthly") and a.exclude[-1] == "*/x/*"
    assert (b.depth, b.cadence, b.pdf_hosts) == (1, "daily", [])
    chunks = spark.createDataFrame([("i1", "u1", "t", "esg"), ("i2", "u0", "t", "eco")], "id string, url string, text string, industry string")
    readers.write_index(chunks, f"{tmp_path}/index")
    assert readers.read_index(spark, f"{tmp_path}/index", "eco").count() == 1
    assert [r.id for r in readers.read_index(spark, f"{tmp_path}/index", limit=1).collect()] == ["i2"]
    pairs = spark.createDataFrame([("q", "c", "u", "p")], readers.PAIRS)
    readers.write_pairs(pairs, f"{tmp_path}/pairs")
    assert [tuple(r) for r in readers.read_pairs(spark, f"{tmp_path}/pairs").collect()] == [("q", "p")]
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "x", "relevant": ["u"]}\n\n')
    assert readers.read_qrels(spark, f"{tmp_path}/q.jsonl").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from cairnfield.streaming import ingest

    rows = [page("p1", "a b c"), page("p2", "x"), page("p1", "a b c"), page("p3", "k l", seed="s2")]
    feed = spark.createDataFrame(rows, PAGE).withColumns({"fetched_at": F.lit(AS_OF).cast("timestamp"), "version_id": F.xxhash64("text")})
    feed.repartition(1).write.parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/feed")
    ingest.ingest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", size=4, overlap=1).awaitTermination()
    got = {(r.id, r.content_hash) for r in ingest.latest_snapshot(spark, f"{tmp_path}/out").collect()}
    batch, _ = crawl(spark, spark.createDataFrame([], readers.CHUNKS), [page("p1", "a b c"), page("p2", "x"), page("p3", "k l", seed="s2")])
    assert got == {(r.id, r.content_hash) for r in batch.collect()} and len(got) == 3


def test_structured_values_are_strings_and_sources_integers(spark):
    content = '{"a": {"value": 5, "sources": [1]}, "b": {"value": " ok ", "sources": [1, "x", 2, 9, 1.5, null]}, "c": "no entry", "d": {"value": "y", "sources": 3}}'
    replies = spark.createDataFrame([(1, content, 3), (2, "[1]", 3)], "request_id int, content string, n_passages int")
    fields = spark.createDataFrame([(r, i, n) for r in (1, 2) for i, n in enumerate("abcd")], "request_id int, ordinal int, name string")
    got = {(r.request_id, r.name): (r.value, r.citations) for r in answers.parse_structured(replies, fields).collect()}
    assert got[1, "a"] == (None, []) and got[1, "b"] == ("ok", [1, 2]) and got[1, "c"] == (None, []) and got[1, "d"] == ("y", [])
    assert all(got[2, n] == (None, []) for n in "abcd")


def test_auto_fields_take_strings_and_integers_only(spark):
    content = '{"fields": [{"name": "A", "value": true}, {"name": 7, "value": "x"}, {"name": "B", "value": "v", "sources": ["1", 2]}]}'
    rows = answers.parse_auto_fields(spark.createDataFrame([(1, content, 8)], "request_id int, content string, n_passages int")).collect()
    assert [(r.name, r.value, r.citations) for r in rows] == [("A", None, []), ("B", "v", [2])]
