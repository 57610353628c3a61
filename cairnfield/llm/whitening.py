"""Embedding whitening from exact principal components.

Vectors become whole numbers, so that sums and the scatter matrix are exact, whatever the partitioning: one pass gives the sums, a
second one the products of what is left after the mean's whole part is taken off. Of the integer matrix n**2 * covariance the
characteristic polynomial is computed modulo primes, a share of the primes in each task, and joined by remainders
(exact_eigen); its largest roots are isolated, and each root's vectors come from inverse iteration in a task of their own. The rows
are then projected as they stream by. The driver holds what the dimension bounds: sums, the matrix, the polynomial, the vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact_eigen, shared

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Fixed-point bits of sums of doubles, so that they do not depend on the order of addition.
FIXED = 40
_DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """n rows with sums; vectors (components x dimension), their eigenvalues (of the covariance) and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: tuple[float, ...]


def whole_vectors(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """rows with x, array<bigint>: floor(scale * c) + offset of each entry. Rows whose vector is null or holds null, NaN or an infinity go.

    So do empty vectors, and those that are not of the most frequent length (of equally frequent ones: the longest). An entry
    beyond 2**53 after scaling raises an error.
    """

    def entry(c: Column) -> Column:
        v = F.floor(c.cast("double") * scale)
        return F.when(F.abs(v) < 2**53, v + offset).otherwise(F.raise_error(F.lit("an entry is too large to be whitened")).cast("long"))

    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)))
    sizes = clean.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return clean.filter(F.size(v) == size).withColumn("x", F.transform(v, entry))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _totals(rows: DataFrame, part, by: tuple[str, ...]) -> dict:
    """Sums of the whole numbers that part(batches) yields as {key: value}, by key. Exact; one row a key and partition is shuffled."""

    def add(batches):
        out: dict = {}
        for found in part(batches):
            for k, v in found.items():
                out[k] = out.get(k, 0) + v
        keys = list(out)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(len(by))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(out[k]) for k in keys], _DECIMAL)], names=[*by, "v"])

    shape = ",".join(f"{b} int" for b in by) + ",v decimal(38,0)"
    found = rows.mapInArrow(add, shape).groupBy(*by).agg(F.sum("v").alias("v")).collect()
    return {tuple(r[b] for b in by): int(r.v) for r in found}


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    def part(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                most = max(1, int(np.abs(x).max()))
                step = max(1, 2**62 // most)
                for i in range(0, len(x), step):
                    yield {(j,): int(v) for j, v in enumerate(x[i : i + step].sum(axis=0))}
                yield {(-1,): len(x)}

    found = _totals(rows.select("x"), part, ("i",))
    n = found.pop((-1,), 0)
    return n, [found[(j,)] for j in range(len(found))]


def _scatter(rows: DataFrame, means: list[int]) -> list[list[int]]:
    """Sums of the products of (x - means), exact."""
    at, d = np.array(means, dtype=np.int64), len(means)
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def part(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = _matrix(b.column(0)) - at
            most = max(1, int(np.abs(y).max()))
            step = 2**53 // most**2
            if step:  # doubles are exact below 2**53
                for i in range(0, len(y), step):
                    z = y[i : i + step].astype(float)
                    m = z.T @ z
                    yield {k: int(m[k]) for k in upper}
            else:
                z = y.astype(object)
                m = z.T @ z
                yield {k: int(m[k]) for k in upper}

    found = _totals(rows.select("x"), part, ("i", "j"))
    return [[found[(min(i, j), max(i, j))] for j in range(d)] for i in range(d)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of all rows (x, as whole_vectors() gives it) in falling order of eigenvalue; fewer if the covariance has a lower rank.

    None if there is no row, or if all rows are equal.
    """
    spark = rows.sparkSession
    n, sums = _sums(rows)
    if not n:
        return None
    d, means = len(sums), [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, means)]
    products = _scatter(rows, means)
    matrix = [[n * products[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]  # n**2 times the covariance
    shared_factor = math.gcd(*(x for row in matrix for x in row)) or 1
    matrix = [[x // shared_factor for x in row] for row in matrix]
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return None

    primes = exact_eigen.enough_primes(trace, d)
    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    at_once = max(1, (1 << 20) // (d * d))

    def residues(batches):
        for b in batches:
            for i in range(0, len(b), at_once):
                ids = b["id"].iloc[i : i + at_once]
                found = exact_eigen.polynomials_mod(matrix, [primes[k] for k in ids])
                yield pd.DataFrame({"id": ids.to_numpy(), "poly": list(found)})

    got = {r.id: r.poly for r in spark.range(0, len(primes), 1, tasks).mapInPandas(residues, "id long, poly array<bigint>").collect()}
    poly = exact_eigen.remainders_joined(primes, [got[k] for k in range(len(primes))])
    roots = exact_eigen.largest_roots(poly, components, trace)

    def directions(batches):
        for b in batches:
            for k in b["id"]:
                root, count = roots[k]
                for i, v in enumerate(exact_eigen.null_space(matrix, root, count)):
                    yield pd.DataFrame({"id": [k], "i": [i], "v": [v]})

    found = {(r.id, r.i): r.v for r in spark.range(0, len(roots), 1, max(1, min(len(roots), spark.sparkContext.defaultParallelism))).mapInPandas(directions, "id long, i int, v array<double>").collect()}
    each = [(roots[k][0], found[(k, i)]) for k, i in sorted(found)][:components]
    values = [float(root * shared_factor / Fraction(n) ** 2) for root, _ in each]
    return Whitening(n, tuple(sums), np.array([v for _, v in each]), np.array(values), tuple(float(root / trace) for root, _ in each))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums, exact: as whole numbers of 64 bits, or Python's where those would not do."""
    means = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = [s - model.n * int(m) for s, m in zip(model.sums, means)]
    y = x - means
    if (int(np.abs(y).max(initial=0)) + 1) * model.n < 2**62:
        return y * model.n - np.array(rest, dtype=np.int64)
    return y.astype(object) * model.n - np.array(rest, dtype=object)


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    c = _centred(x, model)
    most = int(np.abs(c).max(initial=0))
    wide = c if c.dtype == object or most**2 * c.shape[1] < 2**63 else c.astype(object)
    z = (c.astype(float) / model.n) @ (model.vectors / np.sqrt(model.eigenvalues)[:, None]).T
    return (wide * wide).sum(axis=1), z


def transform(rows: DataFrame, model: Whitening, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """keep columns with deviation (sum of (n * x - sums)**2, exact; one beyond a long raises an error) and whitened (a value for each component).

    Rows are those of whole_vectors(), of the model's dimension.
    """
    names = list(keep)

    def project(batches):
        for b in batches:
            if b.num_rows:
                deviation, z = _project(_matrix(b.column("x")), model)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(deviation.tolist(), pa.int64()), lists], names=[*names, "deviation", "whitened"])

    picked = rows.select(*names, "x")
    fields = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "x")
    return picked.mapInArrow(project, f"{fields},deviation bigint,whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.eigenvalues)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def part(batches):
        for b in batches:
            if b.num_rows:
                _, z = _project(_matrix(b.column(0)), model)
                m, s = z.T @ z, z.sum(axis=0)
                yield {p: round(m[p] * 2**FIXED) for p in pairs} | {(i, -1): round(s[i] * 2**FIXED) for i in range(k)}

    found = _totals(rows.select("x"), part, ("i", "j"))
    unit = model.n << FIXED
    mean = [found[(i, -1)] / unit for i in range(k)]
    return max(abs(found[(i, j)] / unit - mean[i] * mean[j] - (i == j)) for i, j in pairs)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Which vectors take part: see whole_vectors(). Null and repeated ids stay as they are; other columns are left out. Components whose
    eigenvalue is 0 are not there, so no rows come of an empty table, one vector or equal ones.
    """
    exact = whole_vectors(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v")
    model = fit(exact, components)
    shape = f"{id_col} {dict(rows.dtypes)[id_col]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], shape)
    error = identity_error(exact, model)
    return (
        transform(exact, model, keep=("id",))
        .select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("component", "whitened"))
        .select(
            id_col,
            (F.col("component") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.array(*map(F.lit, model.explained))[F.col("component")].alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all embeddings, 32 components."""
    return whitened(shared.table(spark, sf_dir, "embeddings"))
