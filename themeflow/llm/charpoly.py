"""Exact characteristic polynomial of an integer matrix, its largest roots and
their null vectors. Nothing here is rounded before the last step.

The matrix is symmetric and positive semidefinite (a scatter matrix), so all
roots are real and none is negative. Then the number of roots above a point
is exactly the number of sign changes of the polynomial shifted to that point.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np

#: Moduli lie below this, so that products of residues fit 64 bits.
PRIME_LIMIT = 1 << 31
#: Roots are told apart, and found, to this many bits below the trace.
ROOT_BITS = 128
_DIGITS = 100  # of the decimals in inverse iteration
_WITNESSES = (2, 3, 5, 7)  # decide primality below 3.2e9


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in _WITNESSES:
        x = pow(a, odd, n)
        if x not in (0, 1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def moduli(matrix: list[list[int]]) -> list[int]:
    """Primes whose product is more than twice any coefficient. By Maclaurin's
    inequality the k-th is at most C(d, k) (trace / d) ** k."""
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // d)
    need = 2 * max(math.comb(d, k) * mean ** k for k in range(d + 1)) + 1
    primes, product, n = [], 1, PRIME_LIMIT - 1
    while product <= need:
        if _is_prime(n):
            primes.append(n)
            product *= n
        n -= 2
    return primes


def _hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo ``p`` without entries below the first subdiagonal."""
    a = a.copy()
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[pivot, k + 1]] = a[[k + 1, pivot]]
            a[:, [pivot, k + 1]] = a[:, [k + 1, pivot]]
        factors = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - factors[:, None] * a[k + 1] % p) % p
        # the inverse step on columns: column k + 1 gains factor times each later column
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * factors % p).sum(axis=1)) % p
    return a


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients modulo ``p`` of det(x I - matrix), the constant first."""
    d = len(matrix)
    h = _hessenberg(np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d), p)
    polys = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k x k block
    polys[0, 0] = 1
    chain = np.zeros(0, np.int64)  # products of the subdiagonal, from row i to row k - 1
    for k in range(d):
        new = np.roll(polys[k], 1)
        new = (new - int(h[k, k]) * polys[k]) % p
        if k:
            chain = np.append(chain, 1) * int(h[k, k - 1]) % p
            terms = (h[:k, k] * chain % p)[:, None] * polys[:k] % p
            new = (new - terms.sum(axis=0)) % p
        polys[k + 1] = new
    return polys[d].tolist()


def combine(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Signed coefficients from those modulo several primes."""
    whole = math.prod(p for p, _ in residues)
    out = [0] * len(residues[0][1])
    for p, values in residues:
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        out = [o + v * unit for o, v in zip(out, values)]
    return [c - whole if (c := o % whole) > whole // 2 else c for o in out]


def _above(poly: list[int], at: int) -> int:
    """How many roots are larger than ``at``, counted as often as they occur."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def positive_roots(poly: list[int]) -> int:
    return _above(poly, 0)


def root_bracket(poly: list[int], trace: int, nth: int) -> tuple[int, int, int, int]:
    """(low, shift, first, last): the ``nth`` largest root, from 1, is in
    (low, low + 1] / 2 ** shift, and so are exactly the roots ``first`` to
    ``last``. It must be positive."""
    d = len(poly) - 1
    shift = max(0, ROOT_BITS - trace.bit_length())
    poly = [c << shift * (d - k) for k, c in enumerate(poly)]
    low, high = 0, trace << shift
    n_low, n_high = _above(poly, low), _above(poly, high)
    while high - low > 1:
        mid = (low + high) // 2
        if n_low - n_high == 1:  # the only root here: the sign tells the side
            value = 0
            for c in reversed(poly):
                value = value * mid + c
            right = value != 0 and (value > 0) != (n_high % 2 == 0)
        else:
            n_mid = _above(poly, mid)
            right = n_mid >= nth
            n_low, n_high = (n_mid, n_high) if right else (n_low, n_mid)
        low, high = (mid, high) if right else (low, mid)
    return low, shift, n_high + 1, n_low


def _factored(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU factors of decimals in place, rows exchanged for the largest pivot."""
    d, order = len(a), list(range(len(a)))
    tiny = max(abs(v) for v in a.ravel()).scaleb(-_DIGITS) or Decimal(1)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not a[k, k]:
            a[k, k] = tiny
        a[k + 1:, k] /= a[k, k]
        a[k + 1:, k + 1:] -= a[k + 1:, k, None] * a[k, k + 1:]
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order]
    for i in range(len(x)):
        x[i] -= lu[i, :i] @ x[:i] if i else 0
    for i in reversed(range(len(x))):
        x[i] = (x[i] - (lu[i, i + 1:] @ x[i + 1:] if i + 1 < len(x) else 0)) / lu[i, i]
    return x


def null_vectors(matrix: list[list[int]], low: int, shift: int, many: int) -> list[list[float]]:
    """Unit vectors that span what belongs to the ``many`` roots in (low,
    low + 1] / 2 ** shift: inverse iteration at the middle of that interval,
    with decimals, until the vectors stand still. The largest entry of each is
    positive."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = _DIGITS
        a = np.array([[Decimal((v << shift + 1) - (2 * low + 1 if i == j else 0)) for j, v in enumerate(row)]
                      for i, row in enumerate(matrix)], object).reshape(d, d)
        lu, order = _factored(a)
        draw = np.random.default_rng(11)
        found: list[np.ndarray] = []
        for _ in range(many):
            x = np.array([Decimal(int(v)) for v in draw.integers(1, 1000, d)], object)
            for _ in range(20):
                old = x
                x = _solved(lu, order, old)
                for other in found:
                    x = x - other * (other @ x)
                x = x / (x @ x).sqrt()
                if abs(abs(x @ old) - 1) < Decimal("1e-40"):
                    break
            found.append(x if max(x, key=abs) > 0 else -x)
        return [[float(v) for v in x] for x in found]
