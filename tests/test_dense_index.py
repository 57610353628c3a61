"""The clustered dense index against the full product."""

import numpy as np
import pytest

from cairnfield.operators import retrieve
from cairnfield.operators.dense import DenseIndex, upper_bound

SCHEMA = "id long, industry string, dense array<float>"
ASKED = "query_id long, industry string, vec array<float>"


def hits(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in df.collect()}


def clustered(seed, n, groups, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [[float(x) for x in centres[i % groups] + spread * rng.normal(size=dim)] for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_rows_of_the_full_product_and_few_clusters_read(spark, tmp_path, spread):
    vecs = clustered(1, 1600, 40, 16, spread)
    vecs[7] = [0.0] * 16
    vecs[100:103] = [vecs[99]] * 3  # ties
    rows = [(i, "ab"[i % 4 == 0], v) for i, v in enumerate(vecs)]
    chunks = spark.createDataFrame([*rows, (9000, None, vecs[1]), (9001, "a", None)], SCHEMA)
    asked = spark.createDataFrame([(q, "ab"[q % 4 == 0], vecs[q]) for q in (*range(0, 60, 3), 7, 99, 100)] + [(5000, "none", vecs[0]), (5001, None, vecs[0]), (5002, "a", None)], ASKED)
    store = DenseIndex(spark, str(tmp_path / "i")).build(chunks)
    assert store.clusters().agg({"rows": "sum"}).first()[0] == 1600
    want = hits(retrieve.dense_topk(asked, chunks, 10))
    got, read = store.topk(asked, 10)
    assert hits(got) == want and len(want) == 23 * 10
    if spread < 1:  # one tight group is a small share of the clusters
        total = {r.industry: r.n for r in store.clusters().groupBy("industry").agg({"cluster": "count"}).withColumnRenamed("count(cluster)", "n").collect()}
        share = [r.clusters / min(total.values()) for r in read.collect() if r.query_id != 7]
        assert np.mean(share) < 0.4, share


def test_slices_small_verticals_and_empty(spark, tmp_path, monkeypatch):
    vecs = clustered(2, 90, 6, 8, 0.3)
    chunks = spark.createDataFrame([(i, "small" if i < 3 else "big", v) for i, v in enumerate(vecs)], SCHEMA)
    asked = spark.createDataFrame([(q, "small" if q < 2 else "big", vecs[q]) for q in range(12)], ASKED)
    want = hits(retrieve.dense_topk(asked, chunks, 5))
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", 2000)
    assert hits(DenseIndex(spark, str(tmp_path / "i")).build(chunks).topk(asked, 5)[0]) == want and len(want) == 2 * 3 + 10 * 5
    none = DenseIndex(spark, str(tmp_path / "e")).build(chunks.limit(0))
    assert none.topk(asked, 5)[0].count() == 0
    assert DenseIndex(spark, str(tmp_path / "i")).topk(asked.limit(0), 5)[0].count() == 0


def test_bound_holds():
    rng = np.random.default_rng(3)
    centre, asked, rows = (retrieve.unit(list(rng.normal(size=(n, 6)))) for n in (1, 50, 200))
    radius = np.array([np.arccos(np.clip(rows @ centre.T, -1, 1)).max()])
    assert (asked @ rows.T <= upper_bound(asked, centre, radius) + 1e-9).all()
