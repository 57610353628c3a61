import random

import numpy as np
import pytest
from tests.llm import brute

from cairnfield.llm import suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, spans int"


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 50)), 0)
        order = suffix_array.suffix_array(s, large=int(rng.choice([0, 512])))
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert order.tolist() == want
        at, length = suffix_array.common_prefixes(s, order, np.array([0]), np.array([len(s)]))
        place = {p: i for i, p in enumerate(want)}
        for i, n in zip(at.tolist(), length.tolist(), strict=True):
            j = want[place[i] - 1] if place[i] else None
            m = 0
            while j is not None and i + m < len(s) and j + m < len(s) and s[i + m] == s[j + m]:
                m += 1
            assert n == m


def check(spark, texts, length, **kw):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept), r.n_bytes) for r in suffix_dedup.remove_repeats(df, length, **kw).collect()}
    for i, (runs, kept) in enumerate(brute.repeats(texts, length)):
        assert got[i] == (runs, kept, len((texts[i] or "").encode()))


def texts():
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, line = some(60), some(25)
    out = [some(100) + passage + some(50), passage[5:] + some(80), some(30) + passage[:40] + some(9), some(150)]
    out += [line + some(40) for _ in range(6)] + [some(20) + line + some(20) for _ in range(4)]
    out += ["aaaa" * 20, "ab" * 30, "", None, "short", some(19)]
    return out + [out[0], out[0]]


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_bytes": 200}])
def test_against_brute_force(spark, options):
    check(spark, texts(), 20, **options)


def test_each_window_is_in_the_context_of_its_anchor_alone():
    rng = np.random.default_rng(3)
    for symbols in (250, 2):
        data = rng.integers(0, symbols, 900).astype(np.uint8)
        _, _, at, back, rest = suffix_dedup.anchors(data, 100)
        windows = [a - b + w for a, b, r in zip(at.tolist(), back.tolist(), rest.tolist(), strict=True) for w in range(b + r - 100 + 1)]
        assert sorted(windows) == list(range(801))
        assert (back >= 0).all() and (rest >= 50).all()


def test_repeated_rows_repeat_each_other(spark):
    df = spark.createDataFrame([(1, "x" + "abcdefghij" * 3, 0)] * 2 + [(None, None, 0)], SCHEMA)
    out = suffix_dedup.remove_repeats(df, 30).collect()
    assert sorted(len(r.kept) for r in out) == [0, 0, 0]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), 20).count() == 0
