"""Document quality by hierarchical empirical Bayes.

Level 0 is a document classifier: a logistic regression over a dozen shape features of the whole text. Its evidence is
combined with that of the document's site: per host and per path (a section of a host) the expected number of good
documents - labels where there are any, the classifier's probability otherwise - is summed by grouped aggregation. A host's
posterior rate is shrunk toward the global rate, a path's toward its host's, by a prior strength that the method of moments
estimates from the spread between groups: sparse sites keep their parent's rate, large ones speak for themselves.
The document's log odds are then moved by the difference between its path's posterior and the global rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams, shared

#: The classifier is fitted to at most about so many labelled rows, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: Documents are kept from this probability on; how much of the site's log odds counts.
KEEP_FROM, SITE_WEIGHT = 0.5, 0.5

FEATURES = ("log_bytes", "symbols", "pipes", "digits", "upper", "spaces", "letters", "new_words", "longest_repeat", "same_next", "word_bytes", "lines", "repeated_lines", "symbol_ends", "none")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: shares of byte classes, repetition of words and lines, lengths."""
    n = len(off) - 1
    o = off - off[0]
    data = data[off[0]: off[-1]]
    size = np.diff(o).astype(float)
    many = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[o[1:]] - total[o[:-1]]) / many

    byte = np.arange(256)
    alnum = ((byte >= 48) & (byte < 58)) | ((byte >= 65) & (byte < 91)) | ((byte >= 97) & (byte < 123)) | (byte > 127)
    space = shared._SPACE
    symbol = ~alnum & ~space & ~np.isin(byte, [*b".,;:!?'\"()-"])
    is_symbol = symbol[data]
    words, begin = shared.word_hashes(data, o)
    lines, line_begin = shared.word_hashes(data, o, byte == 10)
    count = np.diff(begin)
    some = np.maximum(count, 1)
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = words[1:] == words[:-1]
        same[begin[:-1][begin[:-1] < len(words)]] = False
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[:-1] = is_symbol[:-1] & space[data[1:]]
        ends[o[1:][size > 0] - 1] = is_symbol[o[1:][size > 0] - 1]
    out = np.zeros((n, len(FEATURES)))
    for i in range(n):
        w = words[begin[i]: begin[i + 1]]
        out[i, 7] = len(np.unique(w)) / some[i]
        breaks = np.flatnonzero(~same[begin[i]: begin[i + 1]])
        out[i, 8] = np.diff(np.append(breaks, len(w))).max(initial=0) / some[i]
        li = lines[line_begin[i]: line_begin[i + 1]]
        out[i, 12] = 1 - len(np.unique(li)) / max(1, len(li))
    total_same = np.concatenate([[0], np.cumsum(same)])
    out[:, 0] = np.log1p(size)
    out[:, 1], out[:, 2], out[:, 3] = share(is_symbol), share(data == 124), share((data >= 48) & (data < 58))
    out[:, 4], out[:, 5], out[:, 6] = share((data >= 65) & (data < 91)), share(space[data]), share(alnum[data])
    out[:, 9] = (total_same[begin[1:]] - total_same[begin[:-1]]) / some
    out[:, 10] = np.minimum(size / some, 50)
    out[:, 11] = np.log1p(np.diff(line_begin))
    total_ends = np.concatenate([[0], np.cumsum(ends)])
    out[:, 13] = (total_ends[o[1:]] - total_ends[o[:-1]]) / some
    out[:, 14] = count == 0
    return out


class Model:
    def __init__(self, mean, scale, weights, bias, pairs=True):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        """Features, their roots and squares: shares of junk act strongly from small values on."""
        return np.hstack([x, np.sqrt(np.maximum(x, 0)), x * x])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return ngrams.sigmoid(((self.expand(x) - self.mean) / self.scale) @ self.weights + self.bias)


def _measured(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    schema = df.select(*keep).withColumn("__x", F.array(F.lit(0.0))).schema

    def run(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column(len(keep)))
            for i, j in shared.blocks(off):
                x = features(data, off[i: j + 1])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), values], names=[*keep, "__x"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _unit_hash(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One 0/1 label for each id; ids with null, other or contradicting labels are left out."""
    one = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.min(label_col).cast("int").alias("__label"), F.max(label_col).cast("int").alias("__max"))
    return one.filter("__label = __max").drop("__max")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """The document classifier. Without labels of both kinds, every text gets the labelled share (or 1)."""
    one = one_label(labels, id_col, label_col)
    n = one.count()
    chosen = one.filter(_unit_hash(F.col("__lid")) < rows / max(1, n))  # about `rows` ids at most: small enough to broadcast
    got = _measured(docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__lid")), ["__label"], text_col).toArrow()
    y = got.column("__label").to_numpy().astype(float)
    x = np.array(got.column("__x").to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    wide = Model.expand(x)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(wide.shape[1]), np.ones(wide.shape[1]), np.zeros(wide.shape[1]), 3.0 if not len(y) or y[0] else -3.0)
    order = np.lexsort((*x.T, y))
    wide, y = wide[order], y[order]
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-9
    w, b = ngrams.fit_logistic((wide - mean) / scale, y[:, None], 1e-4, steps=600)
    return Model(mean, scale, w[:, 0].astype(float), float(b[0]))


def classify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", prob_col: str = "p_doc") -> DataFrame:
    """The kept columns and the classifier's probability (double) that the whole text is good; null counts as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).withColumn(prob_col, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column(len(keep)))
            p = [shipped.value.probability(features(data, off[i: j + 1])) for i, j in shared.blocks(off)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(np.concatenate(p) if p else np.zeros(0))], names=[*keep, prob_col])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _strength(groups: DataFrame, rate: str, parent: str) -> Column:
    """Prior strength m (in documents) of groups with n documents: moments of the spread of their rates around the parent's.

    m = mean of p (1 - p) / between-group variance - 1, kept within 2 .. 1e6 (no spread beyond chance: very strong).
    """
    within = F.col(parent) * (1 - F.col(parent))
    usable = F.col("n") >= 2
    spread = F.sum(F.when(usable, F.col("n") * (F.col(rate) - F.col(parent)) ** 2))
    chance = F.sum(F.when(usable, within))
    weight = F.sum(F.when(usable, F.col("n")))
    between = F.greatest((spread - chance) / weight, F.lit(1e-12))
    mean_within = F.sum(F.when(usable, F.col("n") * within)) / weight
    return F.coalesce(F.least(F.greatest(mean_within / between - 1, F.lit(2.0)), F.lit(1e6)), F.lit(1e6))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate, global_rate from rows (host, path, good: expected 0..1), null-safe keys.

    Hot hosts are summed by partial aggregation first by path, then by host, so that no task holds a host's rows.
    """
    paths = shared.stored(evidence.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    whole = hosts.agg((F.sum("good") / F.sum("n")).alias("global_rate"))
    hosts = hosts.crossJoin(F.broadcast(whole)).withColumn("rate", F.col("good") / F.col("n"))  # one row
    m = hosts.agg(_strength(hosts, "rate", "global_rate").alias("m_host"))
    hosts = hosts.crossJoin(F.broadcast(m)).select("host", "global_rate", ((F.col("good") + F.col("m_host") * F.col("global_rate")) / (F.col("n") + F.col("m_host"))).alias("host_rate"))
    paths = paths.withColumn("rate", F.col("good") / F.col("n")).withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("h")
    m = paths.agg(_strength(paths, "rate", "host_rate").alias("m_path"))
    return paths.crossJoin(F.broadcast(m)).select("host", "path", "global_rate", "host_rate", ((F.col("good") + F.col("m_path") * F.col("host_rate")) / (F.col("n") + F.col("m_path"))).alias("path_rate"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_from: float = KEEP_FROM, site_weight: float = SITE_WEIGHT, keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, keep_cols, p_doc, host_rate, path_rate, score (0 to 1), keep. A row for each row of docs.

    Null and empty texts are judged by their (empty) features; null hosts and paths are sites of their own; documents with
    a null id have no label. Repeated rows count as often as they occur. Empty docs: no rows. Empty labels: see learn().
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("__id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("__t"), *(F.col(c).alias(f"__k{n}") for n, c in enumerate(keep_cols)))
    extra = [f"__k{n}" for n in range(len(keep_cols))]
    judged = shared.stored(classify(rows, model, ["__id", "host", "path", *extra], "__t"))
    labelled = judged.join(one_label(labels, id_col, label_col), F.col("__id") == F.col("__lid"), "left")
    sites = site_posteriors(labelled.select("host", "path", F.coalesce(F.col("__label").cast("double"), F.col("p_doc")).alias("good")))
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    joined = judged.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    score = 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + site_weight * (_logit(F.col("path_rate")) - _logit(F.col("global_rate"))))))
    return joined.select(F.col("__id").alias(id_col), *(F.col(x).alias(c) for x, c in zip(extra, keep_cols, strict=True)), "p_doc", "host_rate", "path_rate", score.alias("score")).withColumn("keep", F.col("score") >= keep_from)


def document_sites() -> tuple[Column, Column]:
    """Host and path of a row of `documents`, which has no URL: its source, and the source's section of one language."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.coalesce(F.col("lang"), F.lit("-")))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document, judged with all labels."""
    return judge(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), *document_sites())
