import random

from tests.llm import brute

from cairnfield.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, n_hit int", "item_id long, text string, words int"


def check(spark, docs, items):
    a = spark.createDataFrame([(i, t, 0) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.find_contamination(a, b).collect())
    want = []
    for i, t in docs:
        n, hit, found = brute.contamination(t, items)
        want.append((i if i is not None else -1, n, hit, tuple(found), hit > 0 and 20 * hit >= n))
    assert got == sorted(want)


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "Ij", "ké"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(12)]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        if i % 2:
            w = (items[i % 12][1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts.insert(0, ", ".join(w[a : a + rng.randint(10, 20)]).upper())
        docs.append((i, "\n".join(parts)))
    check(spark, docs, items)


def test_nulls_repeats_short_items_and_runs(spark):
    items = [(1, "one two three"), (None, "zero zero"), (2, None), (3, "... !"), (4, "same " * 20), (4, "same " * 20), (5, " ".join(f"w{i}" for i in range(13)))]
    docs = [(1, "One, two; THREE four"), (1, "One, two; THREE four"), (None, "zero zero"), (2, None), (3, ""), (4, "same " * 60), (5, " ".join(f"w{i}" for i in range(12))), (6, "x " * 500 + " ".join(f"W{i}" for i in range(13)))]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [])


def test_large_benchmarks_take_the_shuffled_way(spark):
    docs = spark.createDataFrame([(1, "a b c d", 0), (2, "x y", 0)], DOCS)
    items = spark.createDataFrame([(9, "b c", 0)], ITEMS)
    out = decontaminate.find_contamination(docs, items, broadcast_rows=0).collect()
    assert {(r.doc_id, r.n_hit) for r in out} == {(1, 2), (2, 0)}
