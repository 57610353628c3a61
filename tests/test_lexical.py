import random

import numpy as np
import pandas as pd
import pytest

from cairnfield.operators import bm25, index, lexical, retrieve

CHUNKS = "id string, industry string, text string"
WORDS = [f"w{i}" for i in range(60)]


def same(a, b):
    rows = [sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in x.collect()) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def hashed(df):
    from pyspark.sql import functions as F

    return df.withColumns({"content_hash": F.md5("text"), "url": F.concat(F.lit("u"), "id")})


def text(rng):
    return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(60)], k=rng.randint(3, 40)))


def test_same_rows_as_a_whole_scan_after_inserts_changes_and_deletions(spark, tmp_path):
    rng = random.Random(2)
    store = lexical.LexicalIndex(spark, str(tmp_path), parts=3, blocks=8)
    asked = spark.createDataFrame([(q, text(rng), "ab"[q % 2]) for q in range(12)] + [(90, None, "a"), (91, "absent", "a"), (92, "w1", "none")], "query_id long, query string, industry string")
    now = {(f"c{i}", "ab"[i % 2]): text(rng) for i in range(300)}
    before = {}
    for version in range(3):
        rows = spark.createDataFrame([(*k, t) for k, t in now.items()], CHUNKS)
        old = spark.createDataFrame([(*k, t) for k, t in before.items()], CHUNKS)
        diff = index.diff_chunks(hashed(old), hashed(rows), hashed(rows.unionByName(old)))
        store.update(version, rows, diff)
        same(store.topk(asked, 7), retrieve.bm25_topk(asked, rows, 7))
        before = dict(now)
        for k in rng.sample(sorted(now), 60):
            now[k] = text(rng)
        for k in rng.sample(sorted(now), 30):
            del now[k]
        now |= {(f"n{version}-{i}", "a"): text(rng) for i in range(20)}
        # c7 in two verticals is two chunks
        now[("c7", "a")], now[("c7", "b")] = text(rng), text(rng)
    # a version that is repeated changes nothing
    store.update(2, rows, diff)
    same(lexical.LexicalIndex(spark, str(tmp_path)).topk(asked, 7), retrieve.bm25_topk(asked, rows, 7))


def test_blocks_that_cannot_reach_the_kth_score_stay_closed(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", "a", "common " * (8 if i % 97 == 0 else 1) + "filler " * 20) for i in range(2000)], CHUNKS)
    store = lexical.LexicalIndex(spark, str(tmp_path), parts=2, blocks=256)
    store.update(0, rows, index.diff_chunks(hashed(rows.limit(0)), hashed(rows)))
    asked = spark.createDataFrame([(1, "common", "a")], "query_id long, query string, industry string")
    found, blocks = store.search(asked, 3)
    same(found, retrieve.bm25_topk(asked, rows, 3))
    r = blocks.first()
    assert r.blocks > 200 and r.scored < 30


def test_empty(spark, tmp_path):
    asked = spark.createDataFrame([(1, "common", "a")], "query_id long, query string, industry string")
    store = lexical.LexicalIndex(spark, str(tmp_path), parts=2)
    assert store.topk(asked, 3).collect() == []
    none = spark.createDataFrame([], CHUNKS)
    store.update(0, none, index.diff_chunks(hashed(none), hashed(none)))
    assert store.topk(asked, 3).collect() == []


def test_many_terms_are_joined(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(f"c{i}", "a", text(rng)) for i in range(50)] + [("e", "a", "")], CHUNKS)
    asked = spark.createDataFrame([(q, text(rng), "a") for q in range(5)], "query_id long, query string, industry string")
    few = retrieve.bm25_topk(asked, rows, 4)
    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", 3)
    same(few, retrieve.bm25_topk(asked, rows, 4))


@pytest.mark.parametrize("scope", ["industry", "corpus"])
def test_chunks_stay_where_they_lie(spark, monkeypatch, scope):
    """No row for a term of a chunk, or for a pair of chunk and query, is shuffled, and the rows are those of the join."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(f"c{i:03}", "ab"[i % 2] if i % 9 else None, text(rng)) for i in range(200)] + [(f"d{i}", "a", "w1 w1 w59") for i in range(9)] + [("e", "a", None)], CHUNKS)
    asked = spark.createDataFrame([(q, text(rng), "ab"[q % 2] if q % 5 else None) for q in range(14)] + [(98, "w1 w59 w59", "a"), (None, "w59", "b"), (99, "", "a")], "query_id long, query string, industry string")
    order = lambda df: sorted((r.query_id or -1, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    with monkeypatch.context() as m:
        m.setattr(retrieve, "BROADCAST_ASKED", 0)
        want = order(retrieve.bm25_topk(asked, rows, 6, scope=scope))
    found = retrieve.bm25_topk(asked, rows, 6, scope=scope)
    assert order(found) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_that_are_multiplied_count_as_those_that_are_looked_up(monkeypatch):
    rng = np.random.default_rng(6)
    query, term = rng.integers(0, 9, 60), rng.integers(0, 20, 60)
    df = pd.Series(rng.integers(1, 40, 18), index=range(18))  # two terms occur nowhere
    lists = [np.sort(rng.choice(20, rng.integers(0, 9), replace=False)) for _ in range(40)]
    off, terms = np.cumsum([0, *map(len, lists)]), np.concatenate(lists)
    tfs, dl = rng.integers(1, 5, len(terms)).astype(float), np.array([len(x) + 3 for x in lists])
    want = np.zeros((40, 9))
    for c in range(40):
        for t, tf in zip(lists[c], tfs[off[c] : off[c + 1]], strict=True):
            for q in query[term == t]:
                want[c, q] += t < 18 and np.log(1 + 60 / df[t]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[c] / 8.0))
    for share, cells in ((-1, 7), (2, 7), (0.01, 1 << 21), (2, 1 << 21)):
        monkeypatch.setattr(bm25, "DENSE_SHARE", share)
        monkeypatch.setattr(bm25, "CELLS", cells)
        asked = bm25.Asked(query, term, np.log(1 + 60 / df), df, 40, 8.0)
        got = np.zeros((40, 9))
        for first, out in asked.scores(terms, tfs, off, dl, 1.2, 0.75):
            got[first : first + len(out), asked.queries] = out
        assert np.allclose(got, want) and (len(asked.dense) > 0) == (share < 1)


def test_an_id_is_stored_once_a_chunk(spark, tmp_path):
    """Postings name chunks by their places; none is copied for a query, and no run stores terms a second time."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = spark.createDataFrame([(f"c{i}", "a", text(rng)) for i in range(200)], CHUNKS)
    store = lexical.LexicalIndex(spark, str(tmp_path), parts=2, blocks=4)
    store.update(0, rows, index.diff_chunks(hashed(rows.limit(0)), hashed(rows)))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    assert sorted(r.id for r in stored.select(F.explode("ids").alias("id")).collect()) == sorted(f"c{i}" for i in range(200))
    assert not (tmp_path / "forward").exists()
