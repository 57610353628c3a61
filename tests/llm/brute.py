"""Plain single-process versions of what the operators promise, for small inputs."""

import collections
import itertools
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def groups(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def jaccard_components(rows, k, percent):
    """rows: (id, text); per row (n_shingles, component id)."""
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = groups(len(rows), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(least.get(root[i], doc), doc)
    return [(len(sets[i]), rows[i][0] if not sets[i] else least.get(root[i])) for i in range(len(rows))]


def repeats(texts, length):
    """Per text: the removed runs and the kept bytes."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = []
        for key, part in itertools.groupby(enumerate(gone), key=lambda x: x[1]):
            part = list(part)
            if key:
                runs.append((part[0][0], part[-1][0] + 1))
        out.append((runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    """(words, hit words, items hit) of a text against (item id, text) pairs."""
    words = WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        n = min(13, len(w))
        if item is None or not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)
