"""Eigenvalues and eigenvectors of an integer symmetric matrix without negative eigenvalues, from its exact characteristic polynomial.

The polynomial is computed modulo many primes (Hessenberg form, then the recurrence over its leading minors) and put together by
Chinese remaindering; how many primes are needed follows from the trace. All roots are real, so the sign changes of the
polynomial shifted by a count the roots above a exactly (Budan and Fourier); bisection by such counts isolates the roots,
bisection by signs narrows each one. Vectors come from inverse iteration in fixed-point arithmetic of PRECISION bits.

Everything here is bounded by the dimension, whatever the number of rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

#: Roots are narrowed to this share of themselves; closer ones count as one root of several directions.
ROOT_BITS = 90
PRECISION = 256


def primes_below(limit: int = 1 << 31):
    """Primes in falling order (a deterministic test for numbers of 32 bits)."""
    for n in range(limit - 1, 2, -2):
        if all(n % p for p in (3, 5, 7, 11, 13)):
            d, r = n - 1, 0
            while d % 2 == 0:
                d, r = d // 2, r + 1
            for a in (2, 3, 5, 7):
                x = pow(a, d, n)
                if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
                    break
            else:
                yield n


def enough_primes(trace: int, d: int) -> list[int]:
    """Primes whose product exceeds twice every coefficient: the k-th is at most C(d, k) * (trace / d) ** k."""
    most = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    out, product = [], 1
    for p in primes_below():
        if product > 2 * most:
            return out
        out.append(p)
        product *= p
    raise AssertionError("unreachable")


def polynomials_mod(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(xI - matrix) modulo each prime: an array of len(primes) rows."""
    whole = np.array(matrix, dtype=object)
    h = np.stack([(whole % p).astype(np.int64) for p in primes])
    p1, d = np.array(primes, dtype=np.int64), len(matrix)
    p2, p3 = p1[:, None], p1[:, None, None]
    at = np.arange(len(primes))
    for k in range(d - 2):
        pick = k + 1 + (h[:, k + 1 :, k] != 0).argmax(axis=1)
        rows = h[at, pick].copy()
        h[at, pick], h[:, k + 1] = h[:, k + 1].copy(), rows
        cols = h[at, :, pick].copy()
        h[at, :, pick], h[:, :, k + 1] = h[:, :, k + 1].copy(), cols
        inverse = np.array([pow(int(x), -1, p) if x else 0 for x, p in zip(h[:, k + 1, k], primes)], dtype=np.int64)
        m = h[:, k + 2 :, k] * inverse[:, None] % p2
        h[:, k + 2 :] = (h[:, k + 2 :] - m[:, :, None] * h[:, k + 1, None, :] % p3) % p3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * m[:, None, :] % p3).sum(axis=2)) % p2
    poly = np.zeros((len(primes), d + 1, d + 1), dtype=np.int64)
    poly[:, 0, 0] = 1
    below = np.zeros((len(primes), 0), dtype=np.int64)  # products of the subdiagonal, from each earlier column to this one
    for k in range(d):
        if k:
            below = np.concatenate([below, np.ones((len(primes), 1), np.int64)], axis=1) * h[:, k, k - 1][:, None] % p2
        new = np.roll(poly[:, k], 1, axis=1) - h[:, k, k][:, None] * poly[:, k] % p2
        if k:
            factor = h[:, :k, k] * below % p2
            new -= (factor[:, :, None] * poly[:, :k] % p3).sum(axis=1) % p2
        poly[:, k + 1] = new % p2
    return poly[:, d]


def remainders_joined(primes: list[int], residues: list[list[int]]) -> list[int]:
    """The integers, of either sign, that have these residues, by Chinese remaindering."""
    product, out = 1, [0] * len(residues[0])
    for p, row in zip(primes, residues, strict=True):
        inverse = pow(product, -1, p)
        out = [x + product * ((r - x) * inverse % p) for x, r in zip(out, row, strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def roots_above(poly: list[int], m: int, s: int) -> int:
    """How many roots (all are real), as often as they occur, exceed m / 2**s."""
    d = len(poly) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], m: int, s: int) -> int:
    """The sign of the polynomial at m / 2**s."""
    d, acc = len(poly) - 1, 0
    for k in range(d, -1, -1):
        acc = acc * m + (poly[k] << (s * (d - k)))
    return (acc > 0) - (acc < 0)


def largest_roots(poly: list[int], most: int, limit: int) -> list[tuple[Fraction, int]]:
    """(root, how often) of the positive roots in falling order, until `most` are found; limit: no root exceeds it."""
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    out: list[tuple[Fraction, int]] = []

    def narrowed(lo: int, hi: int, s: int) -> Fraction:
        """The one root in (lo, hi] / 2**s: signs differ at its ends unless it is hi itself."""
        right = _sign(poly, hi, s)
        while right and (hi - lo) << ROOT_BITS > hi:
            if hi - lo < 2:
                lo, hi, s = lo << 8, hi << 8, s + 8
            mid = (lo + hi) >> 1
            here = _sign(poly, mid, s)
            if not here:
                return Fraction(mid, 1 << s)
            lo, hi = (lo, mid) if here == right else (mid, hi)
        return Fraction(hi if not right else lo + hi, (1 << s) << (1 if right else 0))

    work = [(0, limit + 1, 0, len(poly) - 1, 0)]  # (lo, hi, s, roots above lo, roots above hi)
    while work:
        lo, hi, s, above_lo, above_hi = work.pop()
        n = above_lo - above_hi
        if not n or above_hi >= most:
            continue
        if n == 1:
            out.append((narrowed(lo, hi, s), 1))
        elif (hi - lo) << ROOT_BITS <= hi:
            out.append((Fraction(lo + hi, 2 << s), n))
        else:
            if hi - lo < 2:
                lo, hi, s = lo << 8, hi << 8, s + 8
            mid = (lo + hi) >> 1
            above = roots_above(poly, mid, s)
            work += [(lo, mid, s, above_lo, above), (mid, hi, s, above, above_hi)]
    return out


def null_space(matrix: list[list[int]], root: Fraction, count: int, rounds: int = 2) -> list[list[float]]:
    """`count` orthonormal vectors v with matrix v = root v, by inverse iteration; the largest entry of each is positive."""
    d, f = len(matrix), PRECISION
    size = max(1, max(abs(x) for row in matrix for x in row))
    a = np.array([[((x << f) if i != j else (x << f) - (root.numerator << f) // root.denominator) // size for j, x in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    order = list(range(d))
    for k in range(d):  # LU with partial pivoting; multipliers stay below the diagonal
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        for i in range(k + 1, d):
            if a[i, k]:
                m = (int(a[i, k]) << f) // int(a[k, k])
                a[i, k + 1 :] -= (a[k, k + 1 :] * m) >> f
                a[i, k] = m

    def solved(b: list[int]) -> list[int]:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum(int(a[i, j]) * x[j] for j in range(i)) >> f
        for i in range(d - 1, -1, -1):
            x[i] = ((x[i] - (sum(int(a[i, j]) * x[j] for j in range(i + 1, d)) >> f)) << f) // int(a[i, i])
        return x

    def unit(x: list[int]) -> list[int]:
        norm = math.isqrt(sum(v * v for v in x)) or 1
        return [(v << f) // norm for v in x]

    # start vectors: fixed, spread numbers of 16 bits
    found = [unit([((i * 40503 + c * 30011 + 12345) * 2654435761 >> 8) % 65536 - 32768 for i in range(d)]) for c in range(count)]
    for _ in range(rounds):
        done: list[list[int]] = []
        for x in (unit(solved(v)) for v in found):
            for _again in range(2):
                for y in done:
                    dot = sum(p * q for p, q in zip(x, y)) >> f
                    x = [p - ((dot * q) >> f) for p, q in zip(x, y)]
                x = unit(x)
            done.append(x)
        found = done
    out = []
    for x in found:
        sign = 1 if max(x, key=abs) > 0 else -1
        out.append([float(Fraction(sign * v, 1 << f)) for v in x])
    return out
