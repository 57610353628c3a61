import random

import public_tokenizers
import pytest
import tiktoken

from cairnfield.llm import bpe

RANKS = bpe.read_ranks(None, public_tokenizers.path(bpe.VOCABULARY))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(RANKS, public_tokenizers.PATTERN)


def same(coder, texts):
    got = coder.encode_all(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text or "")
        assert bytes(coder.decode(ids)) == (text or "").encode()


def test_every_kind_of_character(coder):
    same(coder, ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 64)])


def test_spaces_contractions_and_odd_texts(coder):
    same(coder, [None, "", " ", "  \n\n x", "it's we'll I'd 12³½", "\x1c \x85y　z ", "<|endoftext|>", "é \U0001f600 तमिल"])


def test_random_texts(coder):
    rng = random.Random(3)
    same(coder, ["".join(rng.choice("ab \n\té中1²") for _ in range(80)) for _ in range(300)])


def test_long_pretokens_use_the_single_queue(coder):
    rng = random.Random(4)
    same(coder, ["a" * 3000, "ab" * 1500, "".join(rng.choice("abcde") for _ in range(4000)), " " * 700])


def test_batch_and_single_queue_agree(coder):
    rng = random.Random(5)
    raws = [bytes(rng.choice(b"theran ") for _ in range(rng.randint(2, 40))) for _ in range(200)]
    assert coder.merge_batch(raws) == [__import__("numpy").array(coder.merge_long(r), dtype="int32").tobytes() for r in raws]


def test_cache_bound_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    same(bpe.BytePairCoder(RANKS, public_tokenizers.PATTERN), ["one two three four five six", "six five four", "one"])


def test_frame_keeps_rows_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    out = bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in out) == [(0, b""), (1, b"Hello world"), (1, b"Hello world"), (3, b"")]
    assert bpe.encode_decode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = bpe.query(spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = LIBRARY.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
