"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text has an n-gram at four levels: once, twice, four times, and densely (once in DENSE bytes or more often). Learning: for
every hashed n-gram and level, the numbers of toxic and of other sample texts that have it give a smoothed log-count ratio;
those whose two shares differ clearly (a G-test) are kept, presence times ratio is the feature, and a logistic
regression weighs them. Scoring: the weights of all that a whole text has are summed.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams, shared

GRAMS, BITS = (4, 6, 8), 18
LEVELS, DENSE = 4, 400
SIZE = LEVELS << BITS
#: At most about this many labelled rows of either class are learned from (chosen by a hash of their id), and n-grams kept.
SAMPLE_ROWS, FEATURES = 2000, 4096
#: Least value of the G statistic of an n-gram: chance alone hardly gives it to one of a million n-grams.
LEAST_G = 36.0
THRESHOLD = 0.7


def _levels(ids: np.ndarray, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (level and n-gram id, text index) pairs, in order of text, from the n-grams of texts of these lengths."""
    pairs, count = np.unique((text.astype(np.int64) << BITS) | ids, return_counts=True)
    ids, text = pairs & ((1 << BITS) - 1), pairs >> BITS
    has = [np.ones(len(ids), bool), count >= 2, count >= 4, count * DENSE >= length[text]]
    ids, text = np.concatenate([ids[h] + (k << BITS) for k, h in enumerate(has)]), np.concatenate([text[h] for h in has])
    order = np.argsort(text, kind="stable")
    return ids[order], text[order]


def _present(data, off) -> tuple[np.ndarray, np.ndarray]:
    ids, text = (np.concatenate(x) for x in zip(*(ngrams.text_grams(data, off, n, BITS) for n in GRAMS), strict=True))
    return _levels(ids, text, np.diff(off))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with `label`, about `rows` of either class. Chosen by a hash of the id, so the same for any partitioning.

    Ids whose labels contradict each other and null labels are left out; a label row that is repeated counts once, repeated docs
    are rows of their own. A column of docs named label is replaced. No labels or no docs: no rows.
    """
    docs = docs.drop("label")
    one = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("__max"))
    one = one.filter("label = __max").select(id_col, F.col("label").cast("int").alias("label"), (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)).alias("__u"))
    n = {r[0]: r[1] for r in one.groupBy("label").count().collect()}
    chosen = one.filter(F.col("__u") < F.when(F.col("label") == 1, F.lit(rows / max(1, n.get(1, 0)))).otherwise(F.lit(rows / max(1, n.get(0, 0)))))
    # about 2 * rows ids: bounded by the parameter
    return docs.join(F.broadcast(chosen.drop("__u")), id_col)


class Model:
    """Weight of each level and n-gram id (dense float32 table), intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.used = (weights.reshape(LEVELS, -1) != 0).any(axis=0)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each text that off separates."""
        found = []
        for n in GRAMS:
            ids, text = ngrams.text_grams(data, off, n, BITS)
            at = np.flatnonzero(self.used[ids])
            found.append((ids[at], text[at]))
        ids, text = _levels(*(np.concatenate(x) for x in zip(*found, strict=True)), np.diff(off))
        return ngrams.sigmoid(self.bias + np.bincount(text, weights=self.weights[ids], minlength=len(off) - 1))


def learn(labelled: DataFrame, text_col: str = "text", features: int = FEATURES, least_g: float = LEAST_G, l2: float = 2e-4, l2_rows: float = 0.3) -> Model:
    """A model from the rows of sample(). Without rows of both classes, every text scores the share of toxic rows (or 0)."""

    def run(batches):
        for batch in batches:
            label, texts = batch.column(0), batch.column(1)
            data, off = shared.utf8(texts)
            for i, j in shared.blocks(off):
                ids, text = _present(data, off[i: j + 1])
                ends = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([label.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], names=["label", "ids"])

    got = labelled.select("label", text_col).mapInArrow(run, "label int, ids array<int>").toArrow()  # bounded by SAMPLE_ROWS
    y = got.column("label").to_numpy().astype(float)
    lists = got.column("ids").to_pylist() if not len(y) else [np.asarray(x.values) for x in got.column("ids").combine_chunks()]
    weights = np.zeros(SIZE, np.float32)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        rate = (n1 + 0.5) / (len(y) + 1) if len(y) else 1e-3
        return Model(weights, float(np.log(rate / (1 - rate))))
    # equal texts count once, in an order that does not depend on the partitioning; only digests are copied
    first = {(t, blake2b(x, digest_size=16).digest()): i for i, (t, x) in enumerate(zip(y, lists, strict=True))}
    order = [first[k] for k in sorted(first)]
    y, lists = y[order], [lists[i] for i in order]
    n1, n0 = y.sum(), (1 - y).sum()
    df1, df0 = np.zeros(SIZE), np.zeros(SIZE)
    for ids, t in zip(lists, y, strict=True):
        (df1 if t else df0)[ids] += 1
    ratio = np.log((df1 + 1) / (n1 + 2)) - np.log((df0 + 1) / (n0 + 2))

    def part(o, e):
        return np.where(o > 0, o * np.log(np.where(o > 0, o, 1) / np.where(e > 0, e, 1)), 0)

    df, n = df1 + df0, n1 + n0
    e1, e0 = df * n1 / n, df * n0 / n
    g = 2 * (part(df1, e1) + part(df0, e0) + part(n1 - df1, n1 - e1) + part(n0 - df0, n0 - e0))
    kept = np.flatnonzero(g >= least_g)
    kept = np.sort(kept[np.lexsort((kept, -g[kept]))][:features])
    column = np.full(SIZE, -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(y), len(kept)), np.float32)
    for i, ids in enumerate(lists):
        c = column[ids]
        x[i, c[c >= 0]] = 1
    x *= ratio[kept]
    w, b = ngrams.fit_logistic(x, y[:, None], max(l2, l2_rows / len(y)))
    weights[kept] = w[:, 0] * ratio[kept]
    return Model(weights, float(b[0]))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (double, 0 to 1, higher: likelier toxic) of each whole text; null scores as the empty text.

    No shuffle. The model is a table of fixed size (4 MB), broadcast. A column named like score_col is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != score_col]
    schema = docs.select(*keep).withColumn(score_col, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column(len(keep)))
            scores = [shipped.value.score(data, off[i: j + 1]) for i, j in shared.blocks(off)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keep, score_col])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: learn from labelled rows that are not held out, score every document."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = shared.table(spark, sf_dir, "labels").filter(~fold)
    model = learn(sample(docs, labels, "doc_id", "toxic"))
    scored = score_texts(docs.withColumn("held_out", F.coalesce(fold, F.lit(False))).select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
