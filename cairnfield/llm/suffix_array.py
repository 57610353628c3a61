"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays. Runs inside tasks, on one shard."""

from __future__ import annotations

import numpy as np

from . import shared

#: Symbols that are compared at once, by their hashes; the last step compares one.
STRIDES = (128, 32, 8, 1)


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type (smaller than the next one); the last symbol is the unique smallest."""
    step = np.sign(np.diff(s.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return np.append(np.append(step, 1)[nearest] > 0, True)


def _deal(at: np.ndarray, s: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append each position to the list of its symbol, in order."""
    if not len(at):
        return
    symbol = s[at]
    order = np.argsort(symbol, kind="stable")  # a radix sort for 16-bit symbols
    at, symbol = at[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    begin = [0, *cuts.tolist()]
    for a, b in zip(begin, [*begin[1:], len(at)], strict=True):
        to[symbol[a]].append(at[a:b])


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, given the leftmost S-type ones in (substring or true) order. Works bucket by bucket."""
    none = np.zeros(0, np.int32)
    lows: list[list[np.ndarray]] = [[] for _ in range(size)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(lms, s, seeds)
    done_l = []
    for c in range(size):
        whole, new = [], lows[c]
        lows[c] = []
        while new:  # L-type suffixes of this bucket may put others into the same bucket
            batch = np.concatenate(new)
            whole.append(batch)
            p = batch[batch > 0] - 1
            p = p[~small[p]]
            _deal(p, s, lows)
            new, lows[c] = lows[c], []
        done_l.append(np.concatenate(whole) if whole else none)
        for batch in seeds[c]:
            p = batch[batch > 0] - 1
            _deal(p[~small[p]], s, lows)
    highs: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        whole, new = [], highs[c]
        highs[c] = []
        while new:
            batch = np.concatenate(new)
            whole.append(batch)
            p = batch[batch > 0] - 1
            _deal(p[small[p]], s, highs)
            new, highs[c] = highs[c], []
        batch = done_l[c][::-1]
        p = batch[batch > 0] - 1
        _deal(p[small[p]], s, highs)
        if c == 0:
            whole.append(np.array([len(s) - 1], np.int32))
        out.extend([*whole, batch])
    return np.concatenate(out)[::-1]


def _ranked(names: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet, by doubling ranks. Only suffixes that still share a rank are sorted again.

    order: their places by ascending names; equal names are one group, in any order.
    The rank of a group is the place of its first suffix in the order, so those of single suffixes stay as they are.
    """
    n = len(names)
    rank, key = np.zeros(n + 1, np.int64), names[order]
    open_, k = np.arange(n), 0
    while len(open_):
        if k:
            at = order[open_]
            key = rank[at] * (n + 2) + np.where(at + k < n, rank[np.minimum(at + k, n)] + 1, 0)
            sort = np.argsort(key)
            key = key[sort]
            order[open_] = at[sort]
        new = np.append(True, key[1:] != key[:-1])
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        k = max(1, k * 2)
    return order


def _prefix_sums(s: np.ndarray) -> np.ndarray:
    """Sums of symbols times powers, before each place; made in one array, as shards should take little memory."""
    out = np.empty(len(s) + 1, np.uint64)
    out[0] = 0
    out[1:] = s
    out[1:] += np.uint64(1)
    out[1:] *= shared.powers(len(s))
    return np.cumsum(out, out=out)


def suffix_array(s: np.ndarray, large: int = 512) -> np.ndarray:
    """Suffix array (int32) of integer symbols of which the last is the unique smallest, 0.

    Leftmost-smaller substrings are sorted by a first induction and named; equal names are resolved on the string of
    names - by the same steps, or by doubling once its alphabet is larger than `large`; a second induction orders all.
    """
    n, size = len(s), int(s.max()) + 1
    s = s.astype(np.int16 if size < 1 << 15 else np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) <= 1:
        return _induce(s, small, lms, size)
    order = _induce(s, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # substrings run to the next leftmost-smaller position; equality by length and a 64-bit hash
    power = shared.powers(n)
    total = _prefix_sums(s)
    after = np.append(lms[1:], n - 1)
    stop = np.zeros(n, np.int64)
    stop[lms] = np.minimum(after + 1, n)
    length = stop[order] - order
    print_ = (total[stop[order]] - total[order]) * power[n - 1 - order]
    differs = (length[1:] != length[:-1]) | (print_[1:] != print_[:-1])
    names = np.cumsum(np.append(0, differs))
    if names[-1] + 1 < len(lms):
        by_place = np.zeros(n, np.int64)
        by_place[order] = names
        reduced = by_place[lms]
        by_place[lms] = np.arange(len(lms))
        order = lms[suffix_array(reduced, large) if names[-1] < large else _ranked(reduced, by_place[order])]
    return _induce(s, small, order.astype(np.int32), size)


def common_prefixes(s: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes of chosen suffixes: for each text (starting at starts, with its first counts suffixes) the length
    that suffix shares with its predecessor in the array, `most` at most. Returns (positions, lengths).

    In text order, a suffix shares at least one symbol less than the one before it, so each text is walked once; all texts
    of the shard are walked side by side, by STRIDE symbols (whose 64-bit hashes are compared) and then by one.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    most = n if most is None else most
    total = _prefix_sums(s)
    power = shared.powers(n)

    def of(at: np.ndarray, step: int) -> np.ndarray:
        return (total[at + step] - total[at]) * power[n - 1 - at]

    shared_now = np.zeros(len(starts), np.int64)
    places, lengths = [], []
    for r in range(int(counts.max(initial=0))):
        on = np.flatnonzero(counts > r)
        i = starts[on] + r
        j = before[i].astype(np.int64)
        length = np.maximum(shared_now[on] - 1, 0)
        length[j < 0] = 0
        reach = np.minimum(n - np.maximum(i, j), most)
        reach[j < 0] = 0
        more = np.flatnonzero(length < reach)
        more = more[s[i[more] + length[more]] == s[j[more] + length[more]]]  # most suffixes end here: one symbol settles them
        for step in STRIDES:
            grow = more[length[more] + step <= reach[more]]
            while len(grow):
                now = length[grow]
                grow = grow[of(i[grow] + now, step) == of(j[grow] + now, step)]
                length[grow] += step
                grow = grow[length[grow] + step <= reach[grow]]
        shared_now[on] = length
        places.append(i)
        lengths.append(length)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(lengths)
