"""A stored dense index for exact top-k that reads only clusters which can hold a result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieve
from .retrieve import best_of_tile, by_industry, top_per_query, unit

#: Rows that the centroids of a vertical are fitted on, about; the most clusters of a vertical; k-means rounds.
SAMPLE, MOST_CLUSTERS, ROUNDS = 20_000, 1024, 8
#: Nearest clusters that every query visits first. What they give bounds the rest.
FIRST = 4
#: Scores are compared at five digits, so a cluster counts as hopeless only if its bound is lower by more than this.
SLACK = 3e-5


def fit_centroids(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly spaced rows. Only speed depends on them, never a result."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = centroids[empty]
        centroids = unit(sums)
    return centroids


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit rows of a and unit rows of b."""
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def upper_bound(asked: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No row within the radius (an angle) of a centroid has a higher cosine with the query, by the triangle inequality of angles."""
    return np.cos(np.maximum(angle(asked, centroids) - radius, 0.0))


class DenseIndex:
    """Chunks laid out by coarse clusters of their vertical: path/rows/cluster=N, and path/clusters, written last, with centroid, radius and size.

    Centroids are fitted on a sample of about SAMPLE rows a vertical, chosen by a hash of the id; every row is stored in the cluster of
    its nearest centroid. Clusters are about the square root of the rows, MOST_CLUSTERS at most a vertical, so that their table is
    small whatever the rows are. Rows without a vector or a vertical are left out. Verticals are those of the catalog: few.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, chunks: DataFrame, dense_col: str = "dense", id_col: str = "id") -> DenseIndex:
        """Replaces what is there. A build that is repeated after a loss writes the same rows."""
        rows = chunks.select(F.col(id_col).alias("chunk_id"), "industry", F.col(dense_col).alias("dense")).filter("dense is not null and industry is not null")
        sizes = {r.industry: r["count"] for r in rows.groupBy("industry").count().collect()}
        share = F.lit(0.0)
        for industry, n in sizes.items():
            share = F.when(F.col("industry") == industry, min(1.0, SAMPLE / n)).otherwise(share)
        place = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.filter(place < share).toPandas()  # about SAMPLE rows a vertical
        table, at = {}, 0
        for industry, part in sample.sort_values("chunk_id").groupby("industry"):
            count = int(min(MOST_CLUSTERS, max(1, round(sizes[industry] ** 0.5)), len(part)))
            table[industry] = (at, fit_centroids(unit(part["dense"].to_numpy()), count))
            at += count
        shipped = self.spark.sparkContext.broadcast(table)

        def assign(batches):
            for pdf in batches:
                for industry, part in pdf.groupby("industry"):
                    start, centroids = shipped.value[industry]
                    cosine = unit(part["dense"].to_numpy()) @ centroids.T
                    best = np.argmax(cosine, axis=1)
                    yield part.assign(cluster=start + best, angle=np.arccos(np.clip(cosine[np.arange(len(best)), best], -1.0, 1.0)))

        fields = f"chunk_id {dict(rows.dtypes)['chunk_id']}, industry string, dense {dict(rows.dtypes)['dense']}, cluster int, angle double"
        laid = rows.mapInPandas(assign, fields).hint("rebalance", "cluster")  # small clusters share tasks, large ones are split
        laid.write.mode("overwrite").partitionBy("cluster").parquet(f"{self.path}/rows")
        known = self._rows(fields).groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows"), F.min("chunk_id").alias("least_id"))
        listed = [(start + i, industry, [float(x) for x in c]) for industry, (start, m) in table.items() for i, c in enumerate(m)]
        centres = self.spark.createDataFrame(listed, "cluster int, industry string, centroid array<double>")
        centres.join(known, "cluster").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clusters")
        return self

    def _rows(self, schema: str | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/rows")

    def clusters(self) -> DataFrame:
        """(cluster, industry, centroid, radius, rows, least_id)."""
        return self.spark.read.parquet(f"{self.path}/clusters")

    def topk(self, queries: DataFrame, k: int, vec_col: str = "vec", first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """(query_id, chunk_id, score, rank) as of dense_topk, and (query_id, clusters, rows): how much of the index each query was compared with.

        Every query visits its nearest clusters, at least `first` and until they hold k rows. Its k-th score there is a floor: of the other
        clusters it visits those whose bound reaches the floor. Both passes read only the folders of clusters that some query visits.
        Queries go in slices of about BROADCAST_BYTES (vectors, bounds and first hits), so what the driver and a task hold does not grow with them.
        """
        q = queries.select("query_id", "industry", F.col(vec_col).cast("array<double>").alias("vec")).filter("vec is not null and industry is not null")
        n, width = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        table = self.clusters()
        found = table.toPandas().sort_values("cluster")  # MOST_CLUSTERS a vertical
        kinds = dict(queries.dtypes)["query_id"], dict(table.dtypes)["least_id"]
        if found.empty:
            return self.spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int"), self.spark.createDataFrame([], f"query_id {kinds[0]}, clusters long, rows long")
        each = width * 8 + k * 32 + int(found.groupby("industry").size().max()) * 8
        slices = max(1, -(-n * each // max(1, retrieve.BROADCAST_BYTES)))
        layout = {industry: (c["cluster"].to_numpy(), unit(c["centroid"].to_numpy()), c["radius"].to_numpy(), c["rows"].to_numpy()) for industry, c in found.groupby("industry")}
        hits, visits = [], []
        for i in range(slices):
            asked = by_industry(q.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).toPandas())
            asked = {industry: a for industry, a in asked.items() if industry in layout}
            near = {industry: nearest(m, layout[industry], k, first) for industry, (_, m) in asked.items()}
            best = top_per_query(self._compare(queries, layout, asked, near, k), k).drop("rank").toPandas()  # k rows a query of the slice
            floor = best.groupby("query_id")["score"].agg(["min", "size"])
            rest = {}
            for industry, (ids, m) in asked.items():
                known = floor.reindex(ids)
                least = np.where(known["size"].to_numpy() >= k, known["min"].to_numpy(), -np.inf)
                rest[industry] = (upper_bound(m, *layout[industry][1:3]) >= least[:, None] - SLACK) & ~near[industry]
                seen = near[industry] | rest[industry]
                visits.append(pd.DataFrame({"query_id": ids, "clusters": seen.sum(axis=1), "rows": seen @ layout[industry][3]}))
            more = self._compare(queries, layout, asked, rest, k)
            hits.append(more.unionByName(self.spark.createDataFrame(best, more.schema)))
        read = self.spark.createDataFrame(pd.concat(visits) if visits else pd.DataFrame({"query_id": [], "clusters": [], "rows": []}), f"query_id {kinds[0]}, clusters long, rows long")
        all_hits = hits[0]
        for h in hits[1:]:
            all_hits = all_hits.unionByName(h)
        return top_per_query(all_hits, k), read

    def _compare(self, queries: DataFrame, layout: dict, asked: dict, visited: dict, k: int) -> DataFrame:
        """The k best rows of each query and batch among the clusters marked for it. visited: {industry: matrix of query x cluster}."""
        number = {industry: c[0] for industry, c in layout.items()}
        wanted = [int(x) for industry, m in visited.items() for x in number[industry][m.any(axis=0)]]
        rows = self._rows().filter(F.col("cluster").isin(wanted)).select("chunk_id", "industry", "cluster", F.col("dense").cast("array<double>").alias("dense"))
        start = {industry: c[0] for industry, c in number.items()}
        position = {industry: np.searchsorted(c, np.arange(c[0], c[-1] + 1)) for industry, c in number.items()}
        shipped = self.spark.sparkContext.broadcast((asked, {i: np.packbits(m, axis=1) for i, m in visited.items()}, {i: m.shape[1] for i, m in visited.items()}))

        def run(batches):
            asked, packed, count = shipped.value
            for pdf in batches:
                for (industry, cluster), part in pdf.groupby(["industry", "cluster"]):
                    if industry not in asked:
                        continue
                    column = position[industry][cluster - start[industry]]
                    going = np.flatnonzero(np.unpackbits(packed[industry][:, column // 8 : column // 8 + 1], axis=1)[:, column % 8])
                    ids, m = asked[industry]
                    mine, names = unit(part["dense"].to_numpy()), part["chunk_id"].to_numpy()
                    for at in range(0, len(going), retrieve.QUERY_BLOCK):
                        some = going[at : at + retrieve.QUERY_BLOCK]
                        yield best_of_tile(ids[some], m[some], names, mine, k)

        schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(rows.dtypes)['chunk_id']}, score double"
        return rows.mapInPandas(run, schema)


def nearest(asked: np.ndarray, layout: tuple, k: int, first: int) -> np.ndarray:
    """query x cluster: the clusters of the nearest centroids, at least `first` of them and as many as hold k rows."""
    _, centroids, _, rows = layout
    order = np.argsort(angle(asked, centroids), axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1)
    take = (np.arange(order.shape[1]) < first) | (held - rows[order] < k)
    marks = np.zeros(order.shape, bool)
    np.put_along_axis(marks, order, take, axis=1)
    return marks
