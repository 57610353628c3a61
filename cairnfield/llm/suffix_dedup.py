"""Removal of long repeated byte strings, by suffix arrays over shards of the places that can repeat.

Each byte covered by a string of LENGTH bytes that also starts anywhere else goes, wherever it stands.

1. Anchors. Among the hashes of all LENGTH/2-byte grams in a window of LENGTH bytes the smallest is the window's anchor. Equal
   windows have equal anchors at equal places, so a repeated string shows as an anchor hash that occurs twice. Its
   context - from the first to the last of the LENGTH-byte windows with this anchor - holds no other windows, so that each
   window is in one context alone (in several only where a gram repeats inside it).
2. Contexts that occur twice as a whole (by two independent 64-bit hashes) are repeated from end to end; this
   collapses copies of documents and passages, however many there are, before any bytes move.
3. What is left are anchors with different contexts: edges of passages, near copies. One copy of each such context goes
   to the shard of its anchor; the shard's suffix array is induced, permuted common prefixes are computed,
   and runs of suffixes that share LENGTH bytes from different places of the corpus are repeats.
   An anchor with more than HOT contexts would overload its shard: its windows are found by halving ranges of starts,
   each range being kept while what all its windows share occurs twice, and done when what they cover together does.
4. Repeats are merged per document and cut from its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .suffix_array import common_prefixes, suffix_array

LENGTH = 400
#: Bytes of contexts in a shard, contexts of one anchor beyond which it does not go to a shard, and
#: contexts up to which their list is broadcast (6 MB).
SHARD_BYTES, HOT, BROADCAST_ROWS = 2_000_000, 10_000, 100_000

_BASES = (int(shared._BASE), 0xD1342543DE82EF95)


def _tables(n: int, kept: dict = {}) -> list[tuple[np.ndarray, np.ndarray]]:  # noqa: B006
    """Powers and inverse powers of both bases, up to n."""
    if kept.get("n", 0) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        kept["n"] = m
        kept["t"] = [tuple(np.cumprod(np.append(np.uint64(1), np.full(m - 1, b, np.uint64)), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))) for base in _BASES]
    return kept["t"]


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    power, _ = _tables(len(data) + 1)[which]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])


def _hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hashes of data[begin:end]; equal strings have equal hashes."""
    _, inverse = _tables(len(sums))[which]
    return shared.mix((sums[end] - sums[begin]) * inverse[begin])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, position, bytes of the context before and after it) of the anchors of one text."""
    n, gram = len(data), length // 2
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    sums = _sums(data, 0)
    at = np.arange(n - gram + 1)
    h = _hash(sums, at, at + gram, 0)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    # windows in a row with one smallest hash are a run; an anchor's windows are those of its run that hold it
    edge = np.append(True, low[1:] != low[:-1])
    runs = np.flatnonzero(edge)
    first, last = np.maximum(at - (length - gram), 0), np.minimum(at, len(low) - 1)
    of = np.searchsorted(runs, first, side="right") - 1
    while len(off := np.flatnonzero(low[runs[of]] != h[at])):
        of[off] += 1
    begin, end = np.maximum(first, runs[of]), np.minimum(last, np.append(runs[1:], len(low))[of] - 1) + length
    context = _hash(sums, begin, end, 0) ^ shared.mix(_hash(_sums(data, 1), begin, end, 1) + ((at - begin) << 32 | (end - at)).astype(np.uint64))
    return h[at], context, at, at - begin, end - at


def _places(length: int):
    def run(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column(1))
            uid = batch.column(0).to_numpy()
            for i, j in shared.blocks(off):
                found = [anchors(data[off[r]: off[r + 1]], length) for r in range(i, j)]
                h, c, at, back, rest = (np.concatenate(x) for x in zip(*found, strict=True))
                u = np.repeat(uid[i:j], [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(u), *(pa.array(x.astype(np.int32)) for x in (at, back, rest))], names=["h", "c", "uid", "at", "back", "rest"])

    return run


def _cut_out(batches):
    """Contexts of the wanted places: (h, uid, begin, whole, text bytes)."""
    for batch in batches:
        data, off = shared.utf8(batch.column(1))
        wanted = batch.column(2).to_pylist()
        uids = batch.column(0).to_pylist()
        h, u, at, begin, flag, piece = [], [], [], [], [], []
        for r, places in enumerate(wanted):
            text = data[off[r]: off[r + 1]]
            for p in places:
                h.append(p["h"])
                u.append(uids[r])
                at.append(p["at"])
                begin.append(p["begin"])
                flag.append(p["whole"])
                piece.append(text[p["begin"]: p["end"]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(u, pa.int64()), pa.array(at, pa.int32()), pa.array(begin, pa.int32()), pa.array(flag, pa.bool_()), pa.array(piece, pa.binary())], names=["h", "uid", "at", "begin", "whole", "piece"])


def _runs(at: np.ndarray, repeated: np.ndarray, text: np.ndarray, first: np.ndarray, length: int):
    """(text index, begin, end), relative to each text, of merged runs of repeated starts. at ascends."""
    at, text = at[repeated], text[repeated]
    if not len(at):
        return text, at, at
    new = np.append(True, (at[1:] > at[:-1] + 1) | (text[1:] != text[:-1]))
    last = np.append(new[1:], True)
    return text[new], (at - first[text])[new], (at - first[text])[last] + length


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        uid, begin = table.column("uid").to_numpy(), table.column("begin").to_numpy().astype(np.int64)
        data, off = shared.utf8(table.column("piece").combine_chunks())
        size = np.diff(off)
        # texts one after another, a 1 after each, and the unique smallest symbol at the end
        first = off[:-1] - off[0] + np.arange(len(size))
        s = np.ones(int(size.sum()) + len(size) + 1, np.int16)
        inside = np.ones(len(s), bool)
        inside[first + size] = inside[-1] = False
        s[inside] = data[off[0]: off[-1]].astype(np.int16) + 2
        s[-1] = 0
        order = suffix_array(s)
        counts = np.maximum(size - length + 1, 0)
        places, shares = common_prefixes(s, order, first, counts, length)
        text = np.repeat(np.arange(len(size)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = first[text] + offset
        by_place = np.zeros(len(s), np.int32)
        by_place[places] = shares
        # suffixes that can start a window, in suffix order; a class is a run in which each shares `length` symbols with the last
        can = np.zeros(len(s), bool)
        can[starts] = True
        owner = np.zeros(len(s), np.int32)
        owner[starts] = text
        o = order[can[order]]
        cls = np.cumsum(by_place[o] < length)
        where = shared.mix(uid[owner[o]].astype(np.uint64)) + (begin[owner[o]] + o - first[owner[o]]).astype(np.uint64)
        edge = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(o) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(where, edge) != np.maximum.reduceat(where, edge) if len(o) else np.zeros(0, bool)
        repeated = np.zeros(len(s), bool)
        repeated[o] = np.repeat(several, np.diff(np.append(edge, len(o))))
        which, a, b = _runs(starts, repeated[starts], text, first, length)
        new = ~np.asarray(table.column("whole"))[which]  # whole contexts are known already
        which, a, b = which[new], a[new], b[new]
        return pa.table({"uid": pa.array(uid[which]), "begin": pa.array((begin[which] + a).astype(np.int32)), "end": pa.array((begin[which] + b).astype(np.int32))})

    return run


def _halves(length: int):
    """Both halves of each range [lo, hi] of window starts (from the anchor): hashes of what its windows share and what they cover."""

    def run(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column("piece"))
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "uid", "at", "begin", "whole", "lo", "hi")}
            out = {c: [] for c in ("h", "uid", "at", "whole", "lo", "hi", "core", "all")}
            for r in range(batch.num_rows):
                text = data[off[r]: off[r + 1]]
                shift = int(col["at"][r] - col["begin"][r])  # the anchor's place in the piece
                sums = [_sums(text, k) for k in (0, 1)]

                def of(a, b, text=text, sums=sums):
                    x, y = (int(_hash(sums[k], np.array([a]), np.array([b]), k)[0]) for k in (0, 1))
                    return x ^ (y * 3 + b - a) & 0xFFFFFFFFFFFFFFFF

                lo, hi = int(col["lo"][r]), int(col["hi"][r])
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)) if lo < hi else ((lo, hi),):
                    if shift + b < 0 or shift + a + length > len(text):
                        continue  # no window of this range lies in the text
                    fits = shift + a >= 0 and shift + b + length <= len(text)
                    if a == b and not fits:
                        continue
                    for c in ("h", "uid", "at", "whole"):
                        out[c].append(col[c][r])
                    out["lo"].append(a)
                    out["hi"].append(b)
                    out["core"].append(of(shift + b, shift + a + length) - (1 << 63))
                    out["all"].append(of(shift + a, shift + b + length) - (1 << 63) if fits else None)
            kinds = {"h": pa.int64(), "uid": pa.int64(), "at": pa.int32(), "whole": pa.bool_(), "lo": pa.int32(), "hi": pa.int32(), "core": pa.int64(), "all": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) for c in out], names=list(out))

    return run


def _halving(pieces: DataFrame, length: int) -> DataFrame:
    """(uid, begin, end) of the repeats among the contexts of hot anchors. Levels: the logarithm of the windows of a context.

    Of the ranges that are known to repeat as a whole, one of each kind stays as a partner for others.
    """
    ranges = pieces.select("h", "uid", "at", F.lit(length // 2 - length).alias("lo"), F.lit(0).alias("hi"))
    found = None
    for _ in range((length - length // 2).bit_length() + 1):
        halves = pieces.join(ranges, ["h", "uid", "at"]).select("h", "uid", "at", "begin", "whole", "lo", "hi", "piece").mapInArrow(_halves(length), "h long, uid long, at int, whole boolean, lo int, hi int, core long, all long")
        halves = shared.stored(halves)
        cores = halves.groupBy("h", "lo", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        covers = halves.filter("all is not null").groupBy("h", "lo", "all").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("u"), F.min_by("at", "uid").alias("t")).filter("n > 1").drop("n")
        covers = covers.withColumnRenamed("all", "a")
        state = halves.join(cores, ["h", "lo", "core"], "left_semi").alias("x").join(covers.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.all") == F.col("y.a")), "left")
        state = shared.stored(state.select("x.*", F.col("a").isNotNull().alias("done"), ((F.col("x.uid") == F.col("u")) & (F.col("x.at") == F.col("t"))).alias("first")))
        new = state.filter("done and not whole").select("uid", (F.col("at") + F.col("lo")).alias("begin"), (F.col("at") + F.col("hi") + length).alias("end"))
        found = new if found is None else found.unionByName(new)
        ranges = state.filter("lo < hi and (not done or first)").select("h", "uid", "at", "lo", "hi")
    return found


def repeated_spans(rows: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(uid, begin, end): byte spans (they may overlap) that together cover all repeats. rows: uid, text (distinct uid, or equal rows)."""
    begin, end = F.col("at") - F.col("back"), F.col("at") + F.col("rest")
    occ = shared.stored(rows.mapInArrow(_places(length), "h long, c long, uid long, at int, back int, rest int"))
    by_anchor = occ.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("contested")).filter("n > 1").select(F.col("h").alias("__h"), "contested")
    occ = shared.stored(occ.join(by_anchor, F.col("h") == F.col("__h")).drop("__h"))
    contexts = occ.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.max("contested").alias("contested"), F.min("uid").alias("uid"), F.min_by("at", "uid").alias("at"), F.max("back").alias("back"), F.max("rest").alias("rest"))
    contexts = shared.stored(contexts)
    twice = contexts.filter("n > 1").select(F.col("h").alias("__h"), F.col("c").alias("__c"))
    whole = occ.join(twice, (F.col("h") == F.col("__h")) & (F.col("c") == F.col("__c"))).select("uid", begin.alias("begin"), end.alias("end"))

    open_ = contexts.filter("contested")
    many = open_.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max((F.col("n") == 1).cast("int")).alias("any"))
    many = many.filter("any = 1").select(F.col("h").alias("__h"), "m")  # contexts that occur twice need nothing more
    open_ = open_.join(many, F.col("h") == F.col("__h")).select("uid", F.struct("h", "at", begin.alias("begin"), end.alias("end"), (F.col("n") > 1).alias("whole")).alias("place"), "m", "h")
    open_ = shared.stored(open_)
    places = open_.groupBy("uid").agg(F.collect_list("place").alias("places")).withColumnRenamed("uid", "__u")
    total, size = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("place.end") - F.col("place.begin")), F.lit(0))).first()
    if total <= BROADCAST_ROWS:
        places = F.broadcast(places)
    texts = rows.dropDuplicates(["uid"]) if total > BROADCAST_ROWS else rows
    pieces = texts.join(places, F.col("uid") == F.col("__u")).select("uid", "text", "places").mapInArrow(_cut_out, "h long, uid long, at int, begin int, whole boolean, piece binary")
    large = open_.filter(F.col("m") > hot).select(F.col("h").alias("__h")).distinct()
    pieces = shared.stored(pieces.join(large.withColumn("hot", F.lit(True)), F.col("h") == F.col("__h"), "left").drop("__h").dropDuplicates(["h", "uid", "at"]))
    shards = max(1, -(-size // shard_bytes))
    in_shards = pieces.filter("hot is null").drop("at").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    sorted_ = in_shards.groupBy("shard").applyInArrow(_shard(length), "uid long, begin int, end int")
    out = whole.unionByName(sorted_)
    return out if large.isEmpty() else out.unionByName(_halving(pieces.filter("hot"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Per document row: id, n_bytes, spans (begin, end of maximal removed runs of bytes), kept (binary: what remains, in order).

    Bytes are those of the text in UTF-8 (null: none); matches never cross documents; equal rows repeat each other. Texts
    shorter than `length` keep all. Kept bytes may split characters, hence binary. Other columns are dropped.
    """
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    docs = docs.select(F.col(id_col).alias("__id"), uid.alias("uid"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("text"))
    spans = repeated_spans(docs.select("uid", "text").filter(F.length("text") >= length), length, shard_bytes, hot)
    spans = spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")).withColumnRenamed("uid", "__u")
    schema = docs.select("__id").withColumnRenamed("__id", id_col).withColumn("n_bytes", F.lit(0).cast("long")).withColumn("spans", F.array(F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end")))).withColumn("kept", F.lit(b"")).schema

    def cut(batches):
        for batch in batches:
            data, off = shared.utf8(batch.column(1))
            lists = batch.column(2)
            out, kept = [], []
            for r in range(batch.num_rows):
                text = data[off[r]: off[r + 1]]
                got = lists[r].values if lists[r].is_valid else None
                if got is None or not len(got):
                    out.append([])
                    kept.append(text.tobytes())
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, got.field("begin").to_numpy(), 1)
                np.add.at(step, got.field("end").to_numpy(), -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append([{"begin": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return docs.join(spans, F.col("uid") == F.col("__u"), "left").select("__id", "text", "spans").mapInArrow(cut, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document, strings of 400 bytes."""
    done = remove_repeats(shared.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
