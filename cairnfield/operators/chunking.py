"""Overlapping token windows of documents, with stable ids, offsets and content hashes.

A tokenizer cuts a text into pieces that give the text again when joined: each token with the space that follows it. A window is a
run of pieces, so its text is the slice of the normalised text from its first token to its last, line breaks included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import text as tx

SIZE, OVERLAP = 512, 64


def spread(rows: DataFrame) -> DataFrame:
    """rows of a table of few files, dealt out over the session's cores; a table with as many files as cores stays as it is.

    A file of one row group is one task, whatever its size, and all work on its texts would be that task's.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def word_pieces(text: Column) -> Column:
    """Words with the white space behind them; what stands before the first word belongs to it."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(?:^\s+)?\S+\s*"), F.lit(0))


def windows(pieces: Column, size: int, step: int) -> Column:
    """Slices of `size` pieces, `step` apart; the first window that reaches the end is the last."""
    n = F.size(pieces)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pieces, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def _begins(sliced: Column, step: int) -> Column:
    """Where each window begins: the lengths of the first `step` pieces of all windows before it."""
    lengths = F.transform(sliced, lambda w: F.aggregate(F.slice(w, 1, step), F.lit(0), lambda n, p: n + F.length(p)))
    return F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def chunk_windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text_col: str = "text", url_col: str = "url", tokenize=None) -> DataFrame:
    """docs exploded into windows: id, ordinal, begin_char, end_char, text, token_count, content_hash and the other columns of docs.

    tokenize maps a column of texts to array<string>, pieces that give the text when joined; the default counts words. Texts are
    normalised before; text is their slice [begin_char, end_char), without outer white space. Windows of white space alone
    are skipped, ordinals stay gapless. Null and empty texts have no windows.
    """
    made = ("id", "ordinal", "begin_char", "end_char", "token_count", "content_hash")
    keep = [c for c in docs.columns if c not in (text_col, *made)]

    def piece(w: Column, begin: Column) -> Column:
        whole = F.array_join(w, "")
        lead = F.length(whole) - F.length(F.ltrim(whole, F.lit(tx.SPACE)))
        text = tx.strip(whole)
        return F.struct((begin + lead).alias("begin_char"), (begin + lead + F.length(text)).alias("end_char"), text.alias("text"), F.size(w).alias("token_count"))

    def pieces(sliced: Column) -> Column:
        return F.filter(F.zip_with(sliced, F.slice(_begins(sliced, size - overlap), 1, F.size(sliced)), piece), lambda p: p["text"] != "")

    tokens = (tokenize or word_pieces)(tx.normalize_text(F.coalesce(F.col(text_col), F.lit(""))))
    cut = tx.let(tokens, lambda t: tx.let(windows(t, size, size - overlap), pieces))
    rows = docs.select(*keep, F.posexplode(cut).alias("ordinal", "piece"))
    return rows.select(
        tx.chunk_id(F.col(url_col), F.col("ordinal")).alias("id"),
        *keep,
        "ordinal",
        F.col("piece.begin_char").alias("begin_char"),
        F.col("piece.end_char").alias("end_char"),
        F.col("piece.text").alias("text"),
        F.col("piece.token_count").alias("token_count"),
        tx.content_hash(F.col("piece.text")).alias("content_hash"),
    )
