"""Exact characteristic polynomials of integer matrices, their real roots and
null vectors.

``modular`` gives the polynomial modulo one prime by reduction to Hessenberg
form; ``remaindered`` joins the images of many primes.  A symmetric matrix has
real roots only, so the number of roots above a point is the number of sign
changes after shifting the polynomial there: ``top_roots`` isolates the
largest ones by exact counts, and ``narrowed`` halves an isolating interval by
exact signs.  ``null_vectors`` solves for the null space of ``M - root`` in
fixed-point arithmetic that the distance to the next root calls for.

Polynomials are lists of integer coefficients, constant term first.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2**31."""
    out, n = [], (1 << 31) - 1
    while len(out) < count:
        # These bases decide primality below 3.2e9.
        if all(pow(b, n - 1, n) == 1 and _strong(n, b) for b in (2, 3, 5, 7)):
            out.append(n)
        n -= 2
    return out


def _strong(n: int, base: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    x = pow(base, d, n)
    if x in (1, n - 1):
        return True
    for _ in range(r - 1):
        x = x * x % n
        if x == n - 1:
            return True
    return False


def hessenberg(h: np.ndarray, q: int) -> np.ndarray:
    """A matrix similar to ``h`` modulo ``q`` with zeros below its subdiagonal."""
    h = h.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + below[0]
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, q) % q
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m][None, :]) % q
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u[None, :] % q).sum(1)) % q
    return h


def modular(matrix: np.ndarray, q: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo the prime ``q`` < 2**31."""
    h = hessenberg(np.array(matrix % q, dtype=np.int64), q)
    d = len(h)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        new = (new - h[k - 1, k - 1] * polys[k - 1]) % q
        weights, product = np.zeros(k - 1, np.int64), 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % q
            weights[i - 1] = product * int(h[i - 1, k - 1]) % q
        if k > 1:
            new = (new - (weights[:, None] * polys[:k - 1] % q).sum(0)) % q
        polys[k] = new
    return polys[d]


def gcd_modular(a: list[int], b: list[int], q: int) -> list[int]:
    """Monic greatest common divisor of two polynomials modulo ``q``."""
    def trimmed(p):
        p = [c % q for c in p]
        while p and p[-1] == 0:
            p.pop()
        return np.array(p, np.int64)

    a, b = trimmed(a), trimmed(b)
    while len(b):
        b = b * pow(int(b[-1]), -1, q) % q
        while len(a) >= len(b):
            top, at = int(a[-1]), len(a) - len(b)
            a[at:] = (a[at:] - top * b) % q
            a = np.trim_zeros(a, "b")
            if not len(a):
                break
        a, b = b, a
    return (a * pow(int(a[-1]), -1, q) % q).tolist() if len(a) else []


def remaindered(images: list[list[int]], moduli: list[int]) -> list[int]:
    """The integer coefficients, of absolute value below half the product of
    the moduli, with these images."""
    product = math.prod(moduli)
    basis = [product // q * pow(product // q, -1, q) for q in moduli]
    out = []
    for column in zip(*images):
        c = sum(r * b for r, b in zip(column, basis)) % product
        out.append(c - product if 2 * c > product else c)
    return out


def derivative(p: list[int]) -> list[int]:
    return [k * c for k, c in enumerate(p)][1:]


def divided(a: list[int], b: list[int]) -> list[int]:
    """Quotient of ``a`` by its monic divisor ``b``."""
    a, out = list(a), [0] * (len(a) - len(b) + 1)
    for k in range(len(out) - 1, -1, -1):
        out[k] = c = a[k + len(b) - 1]
        if c:
            for i, x in enumerate(b):
                a[k + i] -= c * x
    return out


def layers(p: list[int], moduli: list[int]) -> list[list[int]]:
    """Polynomials without repeated roots: the n-th has the roots of ``p`` that
    occur at least n times.  A common divisor with the derivative is monic and
    has coefficients no larger than those that the moduli are enough for."""
    out = []
    while len(p) > 1:
        d = derivative(p)
        images = []
        for q in moduli:
            images.append(gcd_modular(p, d, q))
            if len(images[-1]) == 1:  # none modulo one prime: none at all
                break
        least = min(map(len, images))
        if least == 1:
            shared = [1]
        else:
            kept = [(g, q) for g, q in zip(images, moduli) if len(g) == least]
            shared = remaindered([g for g, _ in kept], [q for _, q in kept])
        out.append(divided(p, shared))
        p = shared
    return out


def sign_at(p: list[int], x: Fraction) -> int:
    """Sign of ``p`` at a dyadic point."""
    num, shift = x.numerator, x.denominator.bit_length() - 1
    acc, d = 0, len(p) - 1
    for k in range(d, -1, -1):
        acc = acc * num + (p[k] << (shift * (d - k)))
    return (acc > 0) - (acc < 0)


def roots_above(p: list[int], x: Fraction) -> int:
    """How many roots of ``p`` (all real, none repeated) lie above a dyadic point."""
    num, shift, d = x.numerator, x.denominator.bit_length() - 1, len(p) - 1
    c = [p[k] << (shift * (d - k)) for k in range(d + 1)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def top_roots(p: list[int], top: int, bound: int) -> list[tuple[Fraction, Fraction]]:
    """Intervals (lo, hi], falling, each with one of the ``top`` largest roots
    of ``p``, whose roots lie in [0, bound]."""
    if len(p) < 2:
        return []
    hi = Fraction(1 << bound.bit_length())
    stack = [(Fraction(-1), hi, len(p) - 1, 0)]
    out = []
    while stack and len(out) < top:
        lo, hi, above_lo, above_hi = stack.pop()
        if above_lo - above_hi == 1:
            out.append((lo, hi))
        elif above_lo > above_hi:
            mid = (lo + hi) / 2
            n = roots_above(p, mid)
            stack += [(lo, mid, above_lo, n), (mid, hi, n, above_hi)]
    return out


def narrowed(p: list[int], lo: Fraction, hi: Fraction, width: Fraction) -> tuple[Fraction, Fraction]:
    """The isolating interval (lo, hi] of a root, no wider than ``width``."""
    at_hi = sign_at(p, hi)
    if at_hi == 0:
        return hi, hi
    while hi - lo > width:
        mid = (lo + hi) / 2
        s = sign_at(p, mid)
        if s == 0:
            return mid, mid
        if s == at_hi:
            hi = mid
        else:
            lo = mid
    return lo, hi


def null_vectors(matrix: np.ndarray, root: Fraction, gap: Fraction, count: int) -> list[list[float]]:
    """Orthonormal vectors of the ``count``-dimensional null space of
    ``matrix - root``, by inverse iteration; other roots are at least ``gap`` away.

    Numbers are integers in units of 2**-bits, so many bits that what rounding
    does to a vector stays far below a double's last place.
    """
    d = len(matrix)
    size = max(1, int(abs(matrix).max()))
    bits = 96 + 4 * d.bit_length() + max(0, size.bit_length() - int(math.floor(math.log2(gap))) if gap >= 1 else
                                         size.bit_length() + gap.denominator.bit_length())
    fixed = round(root * (1 << bits))
    a = matrix.astype(object) * (1 << bits)
    for i in range(d):
        a[i, i] -= fixed
    steps = []  # (row swapped, factors) of each column
    for k in range(d):
        i = k + max(range(d - k), key=lambda j: abs(a[k + j, k]))
        if i != k:
            a[[k, i]] = a[[i, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        f = (a[k + 1:, k] << bits) // a[k, k]
        a[k + 1:, k:] -= (f[:, None] * a[k, k:][None, :]) >> bits
        steps.append((i, f))
    mix = np.random.default_rng(0)
    found: list[np.ndarray] = []
    for _ in range(count):
        v = np.array([int(x) for x in mix.integers(-(1 << 30), 1 << 30, d)], dtype=object) << bits
        for _ in range(3):
            for k, (i, f) in enumerate(steps):
                if i != k:
                    v[k], v[i] = v[i], v[k]
                v[k + 1:] -= (f * v[k]) >> bits
            for k in range(d - 1, -1, -1):
                rest = v[k] - ((a[k, k + 1:] * v[k + 1:]).sum() >> bits if k + 1 < d else 0)
                v[k] = (rest << bits) // a[k, k]
            for _ in range(2):
                for w in found:
                    v -= (w * (int((w * v).sum()) >> bits)) >> bits
                norm = math.isqrt(int((v * v).sum()))
                v = np.array([(int(x) << bits) // norm for x in v], dtype=object)
        found.append(v)
    out = []
    for v in found:
        largest = max(range(d), key=lambda i: (abs(v[i]), -i))
        unit = -(1 << bits) if v[largest] < 0 else 1 << bits
        out.append([int(x) / unit for x in v])
    return out
