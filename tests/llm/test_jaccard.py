import random

import numpy as np

from tests.llm import brute

from cairnfield.llm import components, jaccard_join, shared

SCHEMA = "doc_id long, text string, component_id string"


def check(spark, rows, k=3, percent=90):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_classes(df, k, percent).collect()), key=str)
    want = sorted(((i is None, i, n, c) for (i, _), (n, c) in zip(rows, brute.jaccard_components(rows, k, percent), strict=True)), key=str)
    assert got == want


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
        yield " ".join(copy)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    texts = [*near_copies(rng, 30, 120, 5), *near_copies(rng, 20, 40, 2), *(" ".join(f"z{rng.randint(0, 9)}" for _ in range(12)) for _ in range(20))]
    check(spark, list(enumerate(texts)))


def test_lower_similarity_and_longer_shingles(spark):
    rng = random.Random(12)
    check(spark, list(enumerate([*near_copies(rng, 25, 80, 4), *near_copies(rng, 10, 30, 1)])), 5, 80)


def test_nulls_blank_short_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Two words"), (5, "two  WORDS"), (6, "two"), (7, "É é x y"), (7, "É é x y"), (8, "é é x y"), (9, "a b c d"), (None, "two words"), (None, None)]
    check(spark, rows)


def test_empty(spark):
    assert jaccard_join.similar_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    with shared.Scratch(spark) as scratch:
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 150))


def test_parity_sketches_never_part_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 10, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 4], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        for size in (32, jaccard_join.WIDE):
            apart = int(np.bitwise_count(jaccard_join.parities(a, size) ^ jaccard_join.parities(b, size)).sum())
            assert apart <= len(np.setxor1d(a, b))


def test_a_pair_meets_once_for_each_shingle_that_both_prefixes_share(spark, monkeypatch):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    met, clusters = [], components.clusters

    def watched(postings, near, *rest):
        sides = [postings.select("key", *(postings[c].alias(f"{x}_{c}") for c in postings.columns if c != "key")) for x in "ab"]
        met.append(sides[0].join(sides[1], "key").filter("a_node < b_node").filter(near()).count())
        return clusters(postings, near, *rest)

    monkeypatch.setattr(components, "clusters", watched)
    check(spark, list(enumerate(texts)))
    none = np.zeros(0, np.uint64)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    prefixes = [jaccard_join.prefix(next(shared.sets_of(d, np.array([0, len(d)]), 3)), none, none, 90)[0] for d in data]
    assert met == [len(np.intersect1d(*prefixes))] and met[0] > 0
