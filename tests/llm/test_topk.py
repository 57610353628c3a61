import numpy as np
from pyspark.sql import functions as F

from cairnfield.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, k):
    vecs = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vecs.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = []
    for q in vecs:
        if q % every:
            continue
        a = min(vecs[q])
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, many in vecs.items() if i != q for b in many if len(b) == len(a)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every, k=5, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    out = topk.exact_topk(df, df.filter(F.col("vec_id") % every == 0), k, **kw).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)


def test_matches_brute_force_with_ties_and_many_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    assert run(spark, rows, 10, tile_queries=7, tile_rows=20, fan_in=2) == brute(rows, 10, 5)


def test_bad_vectors_nulls_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (10, [0.1]), (6, [-1.0, 0.3])]
    assert run(spark, rows, 5) == brute(rows, 5, 5)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3.0e5, 1.0]), (1, [3.0e5, 1.0]), (2, [3.0e5, 1.00390625]), (3, [1.0, 1.0])]
    assert run(spark, rows, 2, k=2) == brute(rows, 2, 2)


def test_empty(spark):
    assert run(spark, [], 5) == []
