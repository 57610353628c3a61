"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits; for each bit, a linear classifier over hashed byte n-grams tells on which side
a text falls. Decoding sums the logistic losses of all bits for each codeword and takes the nearest; if the second
nearest is almost as near, the text is flagged as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams, shared

GRAMS, BITS = (1, 2, 3), 12
#: Rows that are learned from: at most so many for each language, and in all (chosen by a hash of their id).
ROWS_EACH, ROWS = 500, 4000
AMBIGUOUS = 0.8
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages. Up to 6: all distinct splits; more: the best of 64 seeded random codes."""
    if n <= 6:
        splits = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1)]
        return np.array([s for s in splits if -1 in s], dtype=float).reshape(-1, n).T
    size = max(15, int(np.ceil(10 * np.log2(n))))

    def least(code):
        d = (size - code @ code.T) / 2
        return d[~np.eye(n, dtype=bool)].min()

    codes = [np.where(np.random.default_rng(s).random((n, size)) < 0.5, -1.0, 1.0) for s in range(64)]
    codes = [c for c in codes if (np.abs(c.sum(axis=0)) < n).all()]
    return max(codes, key=least)


def profiles(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of n-gram features for each text: roots of the shares of its n-grams (each row has length 1)."""
    n = len(off) - 1
    total = np.zeros(n << BITS)
    for k in GRAMS:
        ids, text = ngrams.text_grams(data, off, k, BITS)
        total += np.bincount((text << BITS) + ids, minlength=n << BITS)
    total = total.reshape(n, 1 << BITS)
    return np.sqrt(total / np.maximum(total.sum(axis=1, keepdims=True), 1)).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.code, self.weights, self.bias = langs, code, weights, bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, ambiguous) of each row of features."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        score = p[np.arange(len(p)), best]
        return best, score, score < AMBIGUOUS


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_each: int = ROWS_EACH, rows: int = ROWS, l2: float = 1e-5) -> Model:
    """A model from the rows of docs that have a language and a text with a letter."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().orderBy(lang_col).collect()}  # a row for each language
    langs = sorted(counts)
    if len(langs) < 2:
        return Model(langs, np.ones((len(langs), 0)), np.zeros((1 << BITS, 0)), np.zeros(0))
    each = max(2, min(rows_each, rows // len(langs)))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("lang"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, 2.0 * each / n))) for k, n in counts.items()))
    near = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), u.alias("u")).filter(F.col("u") < F.element_at(share, F.col("lang")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))).filter(F.col("r") <= each)

    def run(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column(1))
            for i, j in shared.blocks(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([p.tobytes() for p in profiles(data, off[i: j + 1])], pa.binary())], names=["lang", "p"])

    got = near.select("lang", "text").mapInArrow(run, "lang string, p binary").toArrow()  # at most ROWS rows of 16 KB
    x = np.frombuffer(b"".join(got.column("p").to_pylist()), np.float32).reshape(-1, 1 << BITS)
    which = np.array([langs.index(v) for v in got.column("lang").to_pylist()])
    order = np.lexsort((x @ np.arange(1 << BITS, dtype=np.float64), which))
    x, which = x[order], which[order]
    code = codewords(len(langs))
    weight = 1 / np.bincount(which, minlength=len(langs))[which]
    w, b = ngrams.fit_logistic(x, (code[which] + 1) / 2, l2, weight=weight)
    return Model(langs, code, w.astype(np.float32), b.astype(np.float32))


_LETTER = regex.compile(r"\p{L}")


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (0 to 1) and ambiguous for each whole text.

    Null texts and texts without a letter: `und`, score 0, ambiguous. A model that learned one language predicts it
    with score 1; one that learned none predicts `und`. No shuffle; the model's size is fixed.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep)
    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema

    def run(batches):
        m = shipped.value
        for batch in batches:
            texts = batch.column(len(keep))
            data, off = shared.utf8(texts)
            ascii_letter = np.zeros(256, dtype=bool)
            ascii_letter[[*range(65, 91), *range(97, 123)]] = True
            for i, j in shared.blocks(off, shared.BLOCK_BYTES // 4):
                for i, j in ((a, min(j, a + 256)) for a in range(i, j, 256)):  # noqa: B020, PLW2901
                    o = off[i: j + 1]
                    letters = np.concatenate([[0], np.cumsum(ascii_letter[data[o[0]: o[-1]]])])
                    has = np.diff(letters[o - o[0]]) > 0
                    for k in np.flatnonzero(~has):
                        t = texts[i + int(k)].as_py()
                        has[k] = bool(t) and _LETTER.search(t) is not None
                    has &= len(m.langs) > 0
                    best, score, unsure = m.decode(profiles(data, o)) if len(m.langs) else (np.zeros(j - i, int), np.zeros(j - i), np.ones(j - i, bool))
                    lang = [m.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(lang, pa.string()), pa.array(np.where(has, score, 0).astype(float)), pa.array(unsure | ~has)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: learn from the rows that are not held out, predict for every document."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    return identify(docs, learn(docs.filter(~F.col("held_out"))), keep=("doc_id", "held_out"))
