"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that has a merge rank is queued in the bucket of that
rank; a two-level bitmap (one word of bits per 256 ranks, and a summary of the words that have bits) finds the
lowest rank in use by two find-first-set steps. Entries are positions of the pair's left node; one whose pair has changed
since is stale and skipped. Each merge costs constant time whatever the pre-token's length, where scanning for the
lowest pair would take time in proportion to it. Merges of one rank go from left to right, as the reference order asks.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Pre-tokens whose ids a worker remembers: a bound on its memory, not on the work.
CACHE_ENTRIES = 800_000
#: Pre-tokens of more bytes are merged one by one, shorter ones together in batches.
LONG_BYTES = 256
#: Text that a worker holds as pre-tokens at once; a longer text is a block of its own.
BLOCK = 4 * shared.BLOCK_BYTES

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """Positions by merge rank. pop() gives the leftmost position of the lowest rank."""

    __slots__ = ("buckets", "words", "summary")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.summary = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        w = rank >> 8
        bits = self.words.get(w, 0)
        if not bits:
            self.summary |= 1 << w
        self.words[w] = bits | 1 << (rank & 255)

    def pop(self) -> tuple[int, int]:
        w = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[w]
        low = (bits & -bits).bit_length() - 1
        rank = w << 8 | low
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            bits &= bits - 1
            self.words[w] = bits
            if not bits:
                self.summary &= self.summary - 1
        return rank, at


def _classes(pattern: str, members) -> str:
    """pattern with \\p{..}, \\s and \\S spelled by members(name), in or out of a bracket."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        m = regex.compile(r"\\p\{(\w+)\}|\\[sS]").match(pattern, i)
        if m:
            out.append(members(m[1] or m[0][1], inside))
            i = m.end()
            continue
        if pattern[i] == "\\":
            out.append(pattern[i: i + 2])
            i += 2
            continue
        inside = {"[": True, "]": False}.get(pattern[i], inside)
        out.append(pattern[i])
        i += 1
    return "".join(out)


def splitter(pattern: str):
    """text -> its matches of the pattern. White space is Unicode's property White_Space, which \\s of re is not.

    Texts below U+0250 are split by re with the classes spelled out, which is twice as fast; others by regex.
    """
    few = [chr(c) for c in range(0x250)]

    def ranges(name: str, inside: bool) -> str:
        test = regex.compile({"s": r"\p{White_Space}", "S": r"\P{White_Space}"}.get(name, rf"\p{{{name}}}"))
        if name == "S" and not inside:  # all but white space, beyond U+0250 too
            return ranges("s", False).replace("[", "[^", 1)
        codes = [ord(c) for c in few if test.match(c)]
        runs = [(a, b) for a, b in zip([c for c in codes if c - 1 not in codes], [c for c in codes if c + 1 not in codes], strict=True)]
        body = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
        return body if inside else f"[{body}]"

    full = regex.compile(_classes(pattern, lambda n, inside: {"s": r"\p{White_Space}", "S": r"\P{White_Space}"}.get(n, rf"\p{{{n}}}")), flags=regex.V0)
    try:
        fast, other = re.compile(_classes(pattern, ranges)).findall, re.compile("[^\u0000-\u024f]").search
    except re.error:  # the pattern uses what re does not know
        return full.findall
    return lambda text: full.findall(text) if other(text) else fast(text)


class BytePairCoder:
    """Encodes and decodes with a table of ranks (bytes -> id, ids in merge order) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = splitter(pattern)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.single < 0).any():
            raise ValueError("every single byte needs an id")
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for b, i in ranks.items():
            pieces[i] = b
        self.length = np.array([len(b) for b in pieces], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        pairs = [(ranks[b[:k]] << 32 | ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        pairs.sort()
        self.keys, self.values = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64) - 1,) * 2
        self.pairs = dict(pairs)
        self.cache: dict[str, bytes] = {}

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that adjacent ids merge into, -1 where none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge_long(self, raw: bytes) -> list[int]:
        """Ids of one long pre-token: the queue, one merge at a time."""
        n = len(raw)
        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pair = RankQueue(), self.pairs.get
        for i in range(n - 1):
            rank = pair(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                queue.push(rank, i)
        while queue.summary:
            rank, i = queue.pop()
            j = after[i]
            if ids[i] < 0 or j >= n or pair(ids[i] << 32 | ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = rank, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                new = pair(rank << 32 | ids[j])
                if new is not None:
                    queue.push(new, i)
            h = before[i]
            if h >= 0:
                new = pair(ids[h] << 32 | rank)
                if new is not None:
                    queue.push(new, h)
        return [x for x in ids if x >= 0]

    def merge_batch(self, raws: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of many pre-tokens: one queue whose buckets hold the positions of all of them.

        A pop takes the lowest rank and, of its bucket, the leftmost live position of each pre-token; what is left of the
        bucket goes back, so that each pre-token sees its merges in its own order.
        """
        size = np.array([len(r) for r in raws], dtype=np.int64)
        ends = np.cumsum(size)
        n = int(ends[-1])
        ids = self.single[np.frombuffer(b"".join(raws), np.uint8)]
        owner = np.repeat(np.arange(len(raws)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - size] = -1
        now = np.full(n, -1)  # rank of the pair that starts here; queue entries that differ are stale
        left = np.flatnonzero(after >= 0)
        now[left] = self.merged(ids[left], ids[left + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        words: dict[int, int] = {}
        summary = 0

        def push(at: np.ndarray) -> None:
            nonlocal summary
            ranks = now[at]
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                runs = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) < 8 else [at[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True)], strict=True)
            else:
                runs = ((int(ranks[0]), at),)
            for rank, part in runs:
                bucket = buckets.get(rank)
                if bucket is not None:
                    bucket.append(part)
                    continue
                buckets[rank] = [part]
                w = rank >> 8
                bits = words.get(w, 0)
                if not bits:
                    summary |= 1 << w
                words[w] = bits | 1 << (rank & 255)

        push(left)
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = w << 8 | (bits & -bits).bit_length() - 1
            bits &= bits - 1
            words[w] = bits
            if not bits:
                summary &= summary - 1
            parts = buckets.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[now[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                whose = owner[at]
                first = np.concatenate([[True], whose[1:] != whose[:-1]])
                if not first.all():
                    push(at[~first])
                    at = at[first]
            gone = after[at]
            right, prior = after[gone], before[at]
            ids[at], ids[gone], now[gone] = rank, -1, -1
            after[at] = right
            has = right >= 0
            now[at] = -1
            a, r = at[has], right[has]
            before[r] = a
            now[a] = self.merged(np.full(len(a), rank), ids[r])
            p = prior[prior >= 0]
            now[p] = self.merged(ids[p], np.full(len(p), rank))
            push(np.concatenate([a, p]))
        live = ids >= 0
        flat = ids[live].astype(np.int32).tobytes()
        stop = (np.cumsum(live)[ends - 1] * 4).tolist()
        return [flat[i:j] for i, j in zip([0, *stop], stop, strict=False)]

    def remember(self, tokens: set[str]) -> dict[str, bytes]:
        """Makes sure that the ids of these pre-tokens are known; returns those that are too long to keep."""
        cache = self.cache
        missing = [t for t in tokens if t not in cache]
        if len(cache) + len(missing) > CACHE_ENTRIES:
            cache.clear()
            missing = list(tokens)
        once: dict[str, bytes] = {}
        many, raws = [], []
        for t in missing:
            raw = t.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                cache[t] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_BYTES:
                once[t] = np.array(self.merge_long(raw), dtype=np.int32).tobytes()
            else:
                many.append(t)
                raws.append(raw)
        if raws:
            cache.update(zip(many, self.merge_batch(raws), strict=True))
        return once

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text: each match of the pattern by itself; null is empty."""
        tokens = [self.find(t) if t else [] for t in texts]
        known = self.cache
        once = self.remember(set().union(*tokens))
        if once:
            known = self.cache | once
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in tokens]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes (uint8) that ids stand for."""
        size = self.length[ids]
        ends = np.cumsum(size)
        shift = self.begin[ids] - (ends - size)
        return self.bytes[np.repeat(shift, size) + np.arange(ends[-1] if len(ends) else 0)]


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 id"; its size is that of the vocabulary, not of the corpus."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_coder: list = []


def _coder_of(shipped) -> BytePairCoder:
    """One coder for each worker process and vocabulary, so that its memory of pre-tokens lasts over tasks."""
    if not _coder or _coder[0] != shipped.value[2]:
        _coder[:] = [shipped.value[2], BytePairCoder(*shipped.value[:2])]
    return _coder[1]


def encode_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `ids` (array of int) and `decoded` (binary: the bytes that the ids stand for).

    A null text counts as empty: no ids, no bytes. Texts of any length are encoded whole; rows repeat as they come.
    No shuffle: texts stream through the workers in Arrow batches. The vocabulary is broadcast: its size is
    fixed by the file, not by the corpus.
    """
    shipped = df.sparkSession.sparkContext.broadcast((ranks, pattern, f"{len(ranks)}:{hash(pattern)}:{hash(frozenset(ranks.items()))}"))
    schema = df.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())
    names = [*keep]

    def run(batches):
        coder = _coder_of(shipped)
        for batch in batches:
            texts = batch.column(len(names))
            _, off = shared.utf8(texts)
            for i, j in shared.blocks(off, BLOCK):
                ids = coder.encode_all(texts.slice(i, j - i).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.concatenate(ids)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                decoded = coder.decode(flat)
                stops = np.concatenate([[0], np.cumsum(coder.length[flat])])[ends].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(stops), pa.py_buffer(decoded)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(names))), lists, decoded], names=[*names, "ids", "decoded"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """Token count and checksums of ids and decoded bytes instead of the ids and bytes."""
    return coded.select(
        *(c for c in coded.columns if c not in ("ids", "decoded")),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document, encoded and decoded again."""
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents")
    return digests(encode_decode(docs, read_ranks(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN))
