"""The answer layer: model inputs and replies are tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.text import strip
from cairnfield.functions.urls import source_domain

ANSWER_ROWS, STRUCTURED_ROWS, PASSAGE_CHARS = 6, 8, 1500
AUTO_FIELDS, NAME_CHARS, KEY_CHARS = 8, 60, 40


def plain_passage(highlighted: Column) -> Column:
    """A highlight without marks and escapes."""
    col = F.regexp_replace(highlighted, "</?mark>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(sign))
    return col


def build_prompts(results: DataFrame, n: int = ANSWER_ROWS) -> DataFrame:
    """(query_id, n_passages, sources): the first n rows as numbered passages; blank ones are left out, numbers stay."""
    rows = results.filter(F.col("rank") <= n).select("query_id", "rank", plain_passage(F.coalesce("highlight", F.lit(""))).alias("p"))
    grouped = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_passages"), F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("ps"))  # n rows a query
    full = F.filter("ps", lambda x: strip(x["p"]) != "")
    text = F.array_join(F.transform(full, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), F.substring(x["p"], 1, PASSAGE_CHARS))), "\n\n")
    return grouped.select("query_id", "n_passages", text.alias("sources"))


def _bounded(numbers: Column, n: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= n))))


def parse_answers(replies: DataFrame) -> DataFrame:
    """replies with answer (null for an empty reply or the word NONE, alone or before a sign) and citations ([n] within bounds)."""
    text = strip(F.coalesce("content", F.lit("")))
    refused = (text == "") | text.rlike(r"(?iU)^none($|[^\w\s])")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))
    return replies.withColumn("answer", F.when(~refused, text)).withColumn("citations", F.when(refused, F.array().cast("array<int>")).otherwise(_bounded(numbers, F.col("n_passages"))))


def field_keys(fields: DataFrame) -> DataFrame:
    """fields (request_id, ordinal, name) with a unique key each: a slug of the name, numbered on collision."""

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        taken: set[str] = set()
        keys = []
        for slug, i in zip(pdf["slug"], range(len(pdf)), strict=True):
            base = slug or f"field_{i}"
            key, n = base, 1
            while key in taken:
                n += 1
                key = f"{base}_{n}"
            taken.add(key)
            keys.append(key)
        return pdf.assign(key=keys)[["request_id", "ordinal", "name", "key"]]

    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, KEY_CHARS)
    kinds = dict(fields.dtypes)
    rows = fields.select("request_id", "ordinal", "name", slug.alias("slug"))
    return rows.groupBy("request_id").applyInPandas(number, f"request_id {kinds['request_id']}, ordinal int, name string, key string")


def _string(entry: Column, path: str) -> Column:
    """The stripped string at a path of a variant; null for blanks and for values of any other type."""
    found = strip(F.try_variant_get(entry, path, "string"))
    return F.when((F.schema_of_variant(F.try_variant_get(entry, path, "variant")) == "STRING") & (found != ""), found)


def _sources(entry: Column) -> Column:
    """The integers of the list `sources`; other elements are left out."""
    listed = F.filter(F.try_variant_get(entry, "$.sources", "array<variant>"), lambda x: F.schema_of_variant(x) == "BIGINT")
    return F.transform(listed, lambda x: F.try_variant_get(x, "$", "int"))


def parse_structured(replies: DataFrame, fields: DataFrame) -> DataFrame:
    """(request_id, ordinal, name, value, citations) for each requested field; unsupported ones are null, sources within bounds.

    A reply is a JSON object of {value, sources} by key. A reply or entry of another shape supports nothing: values are strings, and only integers count among sources.
    """
    parsed = replies.select("request_id", "n_passages", F.from_json("content", "map<string,variant>").alias("m"))
    joined = field_keys(fields).join(parsed, "request_id", "left").withColumn("e", F.try_element_at("m", F.col("key")))
    value = _string(F.col("e"), "$.value")
    sources = F.coalesce(_bounded(_sources(F.col("e")), F.col("n_passages")), F.array().cast("array<int>"))
    return joined.select("request_id", "ordinal", "name", value.alias("value"), F.when(value.isNotNull(), sources).otherwise(F.array().cast("array<int>")).alias("citations"))


def parse_auto_fields(replies: DataFrame) -> DataFrame:
    """(request_id, ordinal, name, value, citations) of the first eight fields that a reply names itself; nameless ones are dropped."""
    parsed = replies.select("request_id", "n_passages", F.from_json("content", "struct<fields:array<variant>>").alias("j"))
    rows = parsed.select("request_id", "n_passages", F.posexplode(F.slice("j.fields", 1, AUTO_FIELDS)).alias("ordinal", "e")).withColumn("name", _string(F.col("e"), "$.name")).filter("name is not null")
    value = _string(F.col("e"), "$.value")
    sources = F.coalesce(_bounded(_sources(F.col("e")), F.col("n_passages")), F.array().cast("array<int>"))
    return rows.select("request_id", "ordinal", F.substring("name", 1, NAME_CHARS).alias("name"), value.alias("value"), F.when(value.isNotNull(), sources).otherwise(F.array().cast("array<int>")).alias("citations"))


def parse_synth_queries(content: Column) -> Column:
    """The JSON string array between the first [ and the last ], blanks dropped; empty if there is none."""
    inner = F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)(\[.*\])", 1)
    found = F.from_json(inner, "array<string>")
    return F.coalesce(F.filter(F.transform(found, strip), lambda q: q.isNotNull() & (q != "")), F.array().cast("array<string>"))


def cited_sources(citations: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, pos, rank, url, title): distinct cited rows in the order of first citation; ranks without a row are dropped.

    citations: answer_id, query_id, citations; results: query_id, rank, url, title.
    """
    first = citations.select("answer_id", "query_id", F.posexplode("citations").alias("p", "rank")).groupBy("answer_id", "query_id", "rank").agg(F.min("p").alias("pos"))
    return first.join(results.select("query_id", "rank", "url", "title"), ["query_id", "rank"]).select("answer_id", "pos", "rank", "url", "title")


def citations_by_host(citations: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, host, pos, rank, url, title, extra): cited rows grouped by host, with the first and how many more."""
    rows = cited_sources(citations, results).withColumn("host", source_domain(F.col("url")))
    first = F.min(F.struct("pos", "rank", "url", "title"))
    return rows.groupBy("answer_id", "host").agg(first.alias("f"), (F.count(F.lit(1)) - 1).alias("extra")).select("answer_id", "host", "f.*", "extra")
