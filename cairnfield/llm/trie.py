"""Conversation prefix trie by collapse of whole sequences.

Identical conversations become one weighted sequence with the list of its conversations; a sequence that is a proper
prefix of another is dropped by an anti-join, what stays are the leaves; the prefixes of the distinct sequences, with their
weights, are summed into nodes. A prefix is known by its length and the exclusive or of two 64-bit hashes over its (depth, turn)
pairs, so that every prefix of every sequence comes from one running pass, and prefixes are never held as lists.

What has to run along a conversation (turn numbers, prefix keys) is a scan over range partitions: rows are dealt out by
(conversation, turn), each partition runs by itself, and the totals at the partitions' ends, one row each, are added to what follows.
A conversation that holds a third of all rows lies in many partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from . import shared

KEY = ("depth", "k1", "k2")
#: Turns of a shared opening that a conversation may take over, and how many ids share one.
OPENING, BLOCK = 4, 20
#: Ids in one piece of a list that is digested.
PIECE = 50_000


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(c, turn, digest, words) of conv_id, turn, role and text: narrow rows that stand for the turns.

    Null roles and texts count as empty; a row without conv_id belongs to no conversation. words: runs of other than white space.
    """
    role, text = _text("role"), _text("text")
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def running(rows: DataFrame, order: tuple, scratch: shared.Scratch, xors: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with seen (from 1) and the running run_x of each column x along every c, in the order of its rows; kept in scratch."""
    values = [*xors, *sums]
    names = ["seen", *(f"run_{v}" for v in values)]
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields), StructField("part", IntegerType()), StructField("end", BooleanType()), *(StructField(n, LongType()) for n in names)])

    def scan(batches):
        part, last, carry = TaskContext.get().partitionId(), None, []
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            c = b.column("c").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
            first = np.repeat(starts, np.diff(np.append(starts, n)))
            out = [np.arange(1, n + 1) - first]
            for i, v in enumerate(values):
                x = b.column(v).to_numpy()
                acc = np.concatenate([[0], np.bitwise_xor.accumulate(x) if i < len(xors) else np.cumsum(x)])
                out.append(acc[1:] ^ acc[first] if i < len(xors) else acc[1:] - acc[first])
            if last == c[0]:
                same = first == 0
                for i, x in enumerate(out):
                    x[same] = x[same] ^ carry[i] if 0 < i <= len(xors) else x[same] + carry[i]
            last, carry = c[-1], [x[-1] for x in out]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool)), *map(pa.array, out)], names=[*b.schema.names, "part", "end", *names])
        if last is not None:  # what the next partitions have to add, if the conversation goes on there
            columns = [pa.array([last] if f.name == "c" else [None], f.type) for f in b.schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32()), pa.array([True]), *(pa.array([x], pa.int64()) for x in carry)], names=[*b.schema.names, "part", "end", *names])

    dealt = rows.repartitionByRange("c", *order).sortWithinPartitions("c", *order)
    found = scratch.keep(dealt.mapInArrow(scan, schema))
    # one row of each partition
    along = Window.partitionBy("__c").orderBy("__from")
    ends = found.filter("end").select(F.col("c").alias("__c"), F.col("part").alias("__from"), *(F.col(n).alias(f"__{n}") for n in names))
    ends = ends.withColumn("__to", F.lead("__from").over(along))
    for v in names:
        add = (F.bit_xor if v.removeprefix("run_") in xors else F.sum)(f"__{v}").over(along)
        ends = ends.withColumn(f"__total_{v}", add)
    carried = F.broadcast(ends.drop(*(f"__{n}" for n in names)))
    met = (F.col("c") == F.col("__c")) & (F.col("part") > F.col("__from")) & (F.col("part") <= F.coalesce("__to", F.lit(2**31 - 1)))
    joined = found.filter("not end").join(carried, met, "left")

    def whole(n: str) -> Column:
        before = F.coalesce(f"__total_{n}", F.lit(0))
        return (F.col(n).bitwiseXOR(before) if n.removeprefix("run_") in xors else F.col(n) + before).alias(n)

    return joined.select(*rows.columns, *map(whole, names))


def numbered(turns: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(c, pos, digest, words): turns numbered from 1, by turn (null first); rows of one turn by digest."""
    rows = turns.withColumn("row", F.monotonically_increasing_id())  # equal rows can be dealt out, too
    return running(rows, (F.asc_nulls_first("turn"), "digest", "row"), scratch).select("c", F.col("seen").alias("pos"), "digest", "words")


def with_openings(turns: DataFrame, opening: int = OPENING, block: int = BLOCK) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % block in place of its own first h; h = crc32(c) % opening.

    All turns of that conversation if it has fewer, none if there is none. A conversation without turns keeps its mark (depth 0).
    turns: as numbered() gives them; returns sequence rows for prefix_trie().
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % opening
    base = F.col("c") - F.col("c") % block
    own = turns.withColumn("h", h)
    heads = turns.filter((F.col("c") % block == 0) & (F.col("pos") < opening)).select(F.col("c").alias("base"), "pos", "digest", "words")
    have = heads.groupBy("base").agg(F.max("pos").alias("have"))
    asked = own.filter("pos = 1").select("c", "h", base.alias("base"))
    taken = asked.join(heads, "base").filter("pos <= h").select("c", F.col("pos").alias("depth"), "digest", "words")
    # a missing opening moves the own turns up
    short = asked.join(have, "base", "left").select(F.col("c").alias("__c"), (F.col("h") - F.coalesce("have", F.lit(0))).alias("up")).filter("up > 0")
    kept = own.filter("pos > h").join(short, F.col("c") == F.col("__c"), "left")
    kept = kept.select("c", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("depth"), "digest", "words")
    return _marks(turns).unionByName(taken).unionByName(kept)


def as_they_are(turns: DataFrame) -> DataFrame:
    """Sequence rows for prefix_trie() of conversations that nothing is done to."""
    return _marks(turns).unionByName(turns.withColumnRenamed("pos", "depth"))


def _marks(turns: DataFrame) -> DataFrame:
    return turns.filter("pos = 1").select("c", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))


def list_digests(rows: DataFrame, key: tuple[str, ...], id_col: str) -> DataFrame:
    """SHA-256 of each key's ids, ascending, in decimal, joined by commas.

    A key's ids are sorted over many partitions and joined there, PIECE at a time; one task then hashes its pieces as they
    stream by (the digest's own order allows no other way), so no task holds a list.
    """
    fields = [f for f in rows.schema.fields if f.name in key]

    def pieces(batches):
        at, first, held = None, None, []

        def piece():
            return pa.RecordBatch.from_pylist([dict(zip(key, at, strict=True)) | {"first": first, "ids": ",".join(held)}], schema=out)

        out = pa.schema([*((k, pa.int64()) for k in key), ("first", pa.int64()), ("ids", pa.string())])
        done = []
        for b in batches:
            for *k, i in zip(*(b.column(n).to_pylist() for n in (*key, id_col)), strict=True):
                if k != at or len(held) >= PIECE:
                    if held:
                        done.append(piece())
                    at, first, held = k, i, []
                held.append(str(i))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if held:
            yield piece()

    def digest(batches):
        at, sha = None, None
        out = pa.schema([*((k, pa.int64()) for k in key), ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for *k, ids in zip(*(b.column(n).to_pylist() for n in (*key, "ids")), strict=True):
                if k != at:
                    if sha:
                        done.append(dict(zip(key, at, strict=True)) | {"ends_sha256": sha.hexdigest()})
                    at, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema=out)
        if sha:
            yield pa.RecordBatch.from_pylist([dict(zip(key, at, strict=True)) | {"ends_sha256": sha.hexdigest()}], schema=out)

    shape = StructType(fields).simpleString()[7:-1]
    parts = rows.select(*key, id_col).repartitionByRange(*key, id_col).sortWithinPartitions(*key, id_col).mapInArrow(pieces, f"{shape},first:bigint,ids:string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{shape},ends_sha256:string")


def prefix_trie(rows: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """The nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: (c, depth, digest, words), depths 1 to the length without gaps, and a mark of depth 0 for each conversation (so
    one without turns is a member of the root). saved_tokens: words that need not be read again, summed over the node's subtree. No rows: no nodes.
    """
    hashed = rows.select(
        "c",
        "depth",
        "words",
        F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", "digest")).alias("k1"),
        F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit("second"), "digest", "depth")).alias("k2"),
    )
    hashed = scratch.keep(hashed)
    each = hashed.groupBy("c").agg(F.max("depth").alias("depth"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("words").alias("total"))
    each = scratch.keep(each)
    sequences = each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("seq"), F.min("total").alias("total"))
    sequences = scratch.keep(sequences)
    ends = list_digests(each, KEY, "c")

    # the prefixes of the distinct sequences; before: words above this turn
    first = sequences.select("seq", "weight", "total", F.col("depth").alias("length"))
    turns = hashed.join(first, F.col("c") == F.col("seq")).drop("seq")
    p = running(turns, ("depth",), scratch, xors=("k1", "k2"), sums=("words",)).select(
        F.col("c").alias("seq"),
        "depth",
        F.col("run_k1").alias("k1"),
        F.col("run_k2").alias("k2"),
        F.col("run_k1").bitwiseXOR(F.col("k1")).alias("up1"),
        F.col("run_k2").bitwiseXOR(F.col("k2")).alias("up2"),
        "words",
        (F.col("total") - F.col("run_words") + F.col("words")).alias("below"),
        "weight",
        "length",
    )
    prefixes = scratch.keep(p)
    nodes = prefixes.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"),
        F.min("seq").alias("conv_id"),
        F.sum(F.col("weight") * F.col("below")).alias("read"),
        F.max("length").alias("longest"),
        F.min("words").alias("words"),
        F.min("up1").alias("up1"),
        F.min("up2").alias("up2"),
    )
    nodes = scratch.keep(nodes)

    # a sequence that is no proper prefix of another is a leaf; each node's words are counted once, by the sequence it is named after
    inner = nodes.filter("longest > depth").select(*KEY)
    leaves = sequences.join(inner, list(KEY), "left_anti").select(F.col("seq").alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("from"), F.sum("words").alias("owned"))
    each_seq = sequences.select("seq").join(leaves, F.col("seq") == F.col("leaf"), "left").join(owned, F.col("seq") == F.col("owner"), "left")
    each_seq = each_seq.select(F.col("seq").alias("__seq"), F.col("leaf").isNotNull().cast("long").alias("leaf"), "from", F.coalesce("owned", F.lit(0)).alias("owned"))
    once = F.when(F.col("from") <= F.col("depth"), F.col("below")).otherwise(F.col("owned"))
    zero = F.lit(0).cast("long")
    facts = prefixes.join(each_seq, F.col("seq") == F.col("__seq")).select(*KEY, "leaf", once.alias("once"), zero.alias("child"), F.lit(None).cast("string").alias("sha"))
    facts = facts.unionByName(nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"), zero.alias("leaf"), zero.alias("once"), F.lit(1).cast("long").alias("child"), F.lit(None).cast("string").alias("sha")))
    facts = facts.unionByName(ends.select(*KEY, zero.alias("leaf"), zero.alias("once"), zero.alias("child"), F.col("ends_sha256").alias("sha")))
    sums = facts.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("once").alias("once"), F.sum("child").alias("n_children"), F.max("sha").alias("sha"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(sums, list(KEY)).join(parents, ["depth", "up1", "up2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("read") - F.col("once")).alias("saved_tokens"), F.coalesce("sha", F.lit(empty)).alias("ends_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the trie of all conversations, each with the opening of its block of 20."""
    with shared.Scratch(spark) as scratch:
        turns = numbered(turn_rows(shared.table(spark, sf_dir, "conversations")), scratch)
        return shared.stored(prefix_trie(with_openings(turns), scratch))


#: CRC32 of a decimal number, bit by bit.
_CRC = """(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), list_transform(range(8), lambda i: i::UBIGINT)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 20 AS base, (xor({_CRC.format("c::VARCHAR")}, 4294967295) % 4)::BIGINT AS h FROM (SELECT DISTINCT c FROM t)
), own AS (SELECT t.* FROM t JOIN ids USING (c) WHERE pos > h
), opening AS (SELECT ids.c, t.pos, t.digest, t.words FROM ids JOIN t ON t.c = ids.base WHERE t.pos <= ids.h
), rebuilt AS (
  SELECT ids.c, list_concat(coalesce((SELECT list(digest ORDER BY pos) FROM opening o WHERE o.c = ids.c), []), coalesce((SELECT list(digest ORDER BY pos) FROM own w WHERE w.c = ids.c), [])) AS path,
    list_concat(coalesce((SELECT list(words ORDER BY pos) FROM opening o WHERE o.c = ids.c), []), coalesce((SELECT list(words ORDER BY pos) FROM own w WHERE w.c = ids.c), [])) AS words
  FROM ids
), pre AS (
  SELECT c, d, list_slice(path, 1, d) AS node, list_slice(path, 1, d - 1) AS up, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, len(path) = d AS here
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)
), n AS (
  SELECT d, node, any_value(up) AS up, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (here), '')) AS ends_sha256
  FROM pre GROUP BY d, node
), kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, node)
), sub AS (
  SELECT a AS d, list_slice(node, 1, a) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_n) GROUP BY ALL
)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves,
  sub.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM full_n x JOIN sub USING (d, node) LEFT JOIN n p ON p.d = x.d - 1 AND p.node = x.up AND x.d > 0
"""
