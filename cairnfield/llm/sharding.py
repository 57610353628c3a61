"""Proportional stratified interleaving: shards whose source mixture is that of the whole table.

Rows of each source are put in a seeded random order; the row of rank r (from 1) among n rows of its
source gets the fractional rank (r - 1 + u) / n, with u in [0, 1) fixed for each source, so that many
one-row sources spread out, too. All rows sorted by fractional rank and cut into runs of equal length give
shards in which each source has its share, give or take a row or two.

Both ranks come from counts of buckets plus a row number inside a bucket, never from a sort of a whole
source or table in one task: a source that holds a third of all rows is dealt over `buckets` groups, as many as the rows ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SEED = "interleave-1"
#: Least buckets of a source, and rows of a source that one bucket is meant for.
BUCKETS, BUCKET_ROWS = 1024, 1_000_000


def _uniform(col: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of an MD5 sum."""
    return F.conv(F.substring(col, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def assign_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    shards: int = 8,
    seed: str = SEED,
    buckets: int | None = None,
    tie_cols: tuple[str, ...] = (),
) -> DataFrame:
    """df with `shard` (0 .. shards-1) and `slot` (gapless from 0 in each shard); shard sizes differ by one at most.

    A null source is a source of its own; null ids count as the empty string. tie_cols are part of the seeded order, so rows of
    equal or null ids spread, too; rows equal in those columns as well are interchangeable and stay together. An empty
    table gives no rows. Columns of df named shard or slot are replaced; other columns pass through. buckets (by default from the counted
    rows) deals a source's rows out over the tasks that sort them.
    """
    buckets = buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    work = ["__key", "__src", "__bucket", "__seen", "__n", "__rank", "__frac", "__cell", "__before", "__pos", "__total"]
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = (
        df.select(*kept)
        .withColumn("__src", src)
        .withColumn("__key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie_cols))))
        .withColumn("__bucket", (_uniform(F.col("__key")) * buckets).cast("int"))
    )
    by_source = Window.partitionBy("__src")
    counts = (
        rows.groupBy("__src", "__bucket")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__seen", F.sum("__c").over(by_source.orderBy("__bucket")) - F.col("__c"))
        .withColumn("__n", F.sum("__c").over(by_source))
        .drop("__c")
    )
    inside = Window.partitionBy("__src", "__bucket").orderBy("__key", id_col, *tie_cols)
    ranked = (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(counts, ["__src", "__bucket"])
        .withColumn("__rank", F.col("__rank") + F.col("__seen"))
        .withColumn("__frac", (F.col("__rank") - 1 + _uniform(F.md5(F.concat(F.lit(seed), F.col("__src"))))) / F.col("__n"))
        .withColumn("__cell", (F.col("__frac") * buckets * 4).cast("int"))
    )
    # At most 4 * buckets rows, whatever the table's size: small enough for one task and for a broadcast.
    cells = (
        ranked.groupBy("__cell")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__before", F.sum("__c").over(Window.orderBy("__cell")) - F.col("__c"))
        .withColumn("__total", F.sum("__c").over(Window.partitionBy(F.lit(0))))
        .drop("__c")
    )
    order = Window.partitionBy("__cell").orderBy("__frac", "__src", "__rank")
    base, extra = F.floor(F.col("__total") / shards), F.col("__total") % shards
    big = extra * (base + 1)  # the first `extra` shards have one row more
    pos = F.col("__pos")
    return (
        ranked.withColumn("__pos", F.row_number().over(order))
        .join(F.broadcast(cells), "__cell")
        .withColumn("__pos", pos + F.col("__before") - 1)
        .withColumn("shard", F.when(pos < big, F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - big) / F.greatest(base, F.lit(1)))).cast("int"))
        .withColumn("slot", F.when(pos < big, pos % (base + 1)).otherwise((pos - big) % F.greatest(base, F.lit(1))).cast("long"))
        .drop(*work)
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the whole rows as Parquet under path/shard=k, in slot order inside each file."""
    shards = assign_shards(df, **options)
    shards.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: law `rows`. Sizes and checksums are taken in the scan; texts themselves are not shuffled."""
    docs = shared.table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).cast("long").alias("text_crc32"),
    )
    return assign_shards(docs, tie_cols=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
