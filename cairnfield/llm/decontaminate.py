"""Benchmark decontamination by winnowing, with DataFrame functions alone.

A text is a sequence of words; of each run of GRAM + SPAN - 1 = 13 words the smallest hash of its GRAM-word grams is a
fingerprint. Two texts that share 13 words in a row share that fingerprint, so joining the fingerprints of documents and
benchmark items misses no shared window. Hits are then extended: every 13-word run whose fingerprint was hit
is compared word by word with the items' windows, and the words of all equal runs are marked.
An item of fewer words is one window; its fingerprint is the hash of all its words (a span of one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW, GRAM = 13, 6
SPAN = WINDOW - GRAM + 1

#: Fingerprints or windows of the benchmark up to which a side is broadcast (some 100 MB); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lowering: A-Z belong to words


def word_array(text: Column) -> Column:
    """The words of a text, A-Z lowered; none for null."""
    return F.array_remove(F.split(shared.lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _runs(array: Column, length: int, of) -> Column:
    """of(run) for each run of `length` neighbours; empty if there are fewer."""
    n = F.size(array) - length + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: of(F.slice(array, i, F.lit(length))))).otherwise(F.array().cast("array<bigint>"))


def _with_prints(df: DataFrame, short: list[int]) -> DataFrame:
    """df (with `words`) and `p13`, and `p<n>` for each shorter window length: the fingerprint of each window."""
    df = df.withColumn("__hash", F.transform("words", lambda w: F.xxhash64(w))).withColumn("__gram", _runs(F.col("__hash"), GRAM, F.xxhash64))
    df = df.withColumn(f"p{WINDOW}", _runs(F.col("__gram"), SPAN, F.array_min))
    for n in short:
        df = df.withColumn(f"p{n}", _runs(F.col("__hash"), n, lambda x, n=n: F.xxhash64(F.lit(n), x)))
    return df.drop("__hash", "__gram")


def _windows(df: DataFrame, lengths: list[int], keep: list[str], among: str | None = None) -> DataFrame:
    """A row for each window of the given lengths: kept columns, length, start, fingerprint and words."""

    def of(n: int) -> Column:
        prints = F.col(f"p{n}")
        starts = F.sequence(F.lit(1), F.size(prints))
        starts = F.when(F.size(prints) > 0, starts).otherwise(F.array().cast("array<int>"))
        if among:
            starts = F.filter(starts, lambda i: F.array_contains(F.col(among), F.get(prints, i - 1)))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("length"), i.alias("start"), F.get(prints, i - 1).alias("print"), F.array_join(F.slice("words", i, F.lit(n)), " ").alias("window")))

    return df.select(*keep, F.explode(F.concat(*(of(n) for n in lengths))).alias("w")).select(*keep, "w.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS, keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: id, keep_cols, n_words, n_hit (words inside a benchmark window), spans, items, contaminated.

    `spans` are the merged hit runs (start from 0, length), `items` the ids, as strings in order, of items with a window in
    the document. contaminated: at least one hit word and at least a twentieth of all words. Null texts have no
    words; items with a null id or no words take no part; rows of the same id and text get the same answer; an empty table on
    either side finds nothing. Other columns of docs are dropped.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), word_array(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    # at most 12 values, whatever the benchmark's size
    short = sorted(r[0] for r in items.filter(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())
    lengths = [WINDOW, *short]
    whole = F.when(F.size("words") < WINDOW, F.size("words")).otherwise(F.lit(WINDOW))
    known = _windows(_with_prints(items, short).withColumn("__n", whole), lengths, ["item", "__n"]).filter("length = __n").select("print", "window", "length", "item").distinct()
    known = shared.stored(known)
    small = known.count() <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)

    extra = [f"__k{n}" for n in range(len(keep_cols))]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *(F.col(c).alias(x) for x, c in zip(extra, keep_cols, strict=True))).withColumn("__uid", F.xxhash64("__id", "__text"))
    prints = _with_prints(rows.filter(F.length("__text") > 0).select("__uid", word_array(F.col("__text")).alias("words")), short)
    hits = (
        prints.select("__uid", F.explode(F.array_distinct(F.concat(*(F.col(f"p{n}") for n in lengths)))).alias("print"))
        .join(side(known.select("print").distinct()), "print", "left_semi")
        .groupBy("__uid")
        .agg(F.collect_set("print").alias("__hits"))
    )
    hits = shared.stored(hits)
    if hits.count() <= broadcast_rows // 4:
        hits = F.broadcast(hits)
    # Texts are read again for documents with hits alone, and their windows compared whole.
    suspects = rows.join(hits, "__uid").dropDuplicates(["__uid"]).select("__uid", "__hits", word_array(F.col("__text")).alias("words"))
    equal = _windows(_with_prints(suspects, short), lengths, ["__uid"], among="__hits").join(side(known.select("window", "length", "item")), ["window", "length"])
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("length")).alias("end")))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    found = equal.groupBy("__uid").agg(merged.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array()
    return (
        rows.select("__id", "__uid", *extra, F.coalesce(F.regexp_count("__text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_words"))
        .join(found, "__uid", "left")
        .select(
            F.col("__id").alias(id_col),
            *(F.col(x).alias(c) for x, c in zip(extra, keep_cols, strict=True)),
            "n_words",
            F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (x["end"] - x["start"]).alias("length"))), none.cast("array<struct<start:int,length:int>>")).alias("spans"),
            F.coalesce("items", none.cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document against every benchmark item."""
    found = find_contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS window_text
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS window_text
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT DISTINCT rid, dw.n, s, item FROM dw JOIN iw ON dw.n = iw.n AND dw.window_text = iw.window_text
), covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid
), items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
