"""Eigenvectors of a symmetric matrix by QDWH spectral divide and conquer.

The polar factor U of A - s*1 maps eigenvectors to plus or minus themselves, so (U + 1) / 2 projects on
the invariant subspace of eigenvalues above s. The matrix is reduced to that subspace and to its
complement, and each part is split on until it has one dimension or one eigenvalue. U comes from
dynamically weighted Halley steps, by QR where the weights are large and by Cholesky where they are not.

All of it works on one matrix of the vectors' width; nothing here grows with the rows.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (eigenvalue 0 where the matrix is singular)."""
    n = len(a)
    one = np.eye(n)
    x = a / np.linalg.norm(a)
    # A lower bound of the least singular value; too small a one costs a step or two.
    low = max(np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / np.sqrt(n), _EPS) * 0.5
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        a_ = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        if c_ > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c_) * x, one]))[0]
            new = b_ / c_ * x + (a_ - b_ / c_) / np.sqrt(c_) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(one + c_ * (x.T @ x))
            half = np.linalg.solve(w, x.T)
            new = b_ / c_ * x + (a_ - b_ / c_) * np.linalg.solve(w.T, half).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(low * (a_ + b_ * square) / (1 + c_ * square), 1.0)
        if moved < 10 * _EPS ** (1 / 3) and 1 - low < 1e-8 or moved < 10 * _EPS * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the subspace of larger eigenvalues, and their number.

    None if all eigenvalues agree to the precision of ``scale``.
    """
    n = len(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= 4 * n * _EPS * scale:
        return None
    # The median of the diagonal halves the work; the mean always parts unequal eigenvalues. Others
    # serve if a shift comes too near to an eigenvalue.
    step = spread / np.sqrt(n)
    random = np.random.default_rng(7)
    best = None
    for shift in (np.median(np.diag(a)), middle, *(middle + step * t for t in (0.17, -0.17, 0.41, -0.41, 0.05, -0.05, 0.83, -0.83))):
        u = polar(a - shift * np.eye(n))
        p = (u + np.eye(n)) / 2
        rank = int(round(np.trace(p)))
        if not 0 < rank < n:
            continue
        basis = np.linalg.qr(p @ random.standard_normal((n, rank)))[0]
        for _ in range(2):
            basis = np.linalg.qr(p @ basis)[0]
        # A full basis, by QR of the part and of what its projection leaves.
        q = np.linalg.qr(np.hstack([basis, random.standard_normal((n, n - rank))]))[0]
        off = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
        if best is None or off < best[0]:
            best = off, q, rank
        if off <= 20 * n * _EPS * scale:
            break
    return None if best is None else best[1:]


def largest(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns.

    Parts that hold none of the k largest are not split on. Among equal eigenvalues any basis serves.
    """
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    values, vectors = [], []

    def part(basis: np.ndarray, m: np.ndarray) -> None:
        if len(values) >= k or not len(m):
            return
        split = _split(m, scale) if len(m) > 1 else None
        if split is None:
            for column in basis.T:
                values.append(float(column @ a @ column))
                vectors.append(column)
            return
        q, rank = split
        m = q.T @ m @ q
        m = (m + m.T) / 2
        part(basis @ q[:, :rank], m[:rank, :rank])
        part(basis @ q[:, rank:], m[rank:, rank:])

    if len(a):
        part(np.eye(len(a)), a)
    order = np.argsort(np.negative(values), kind="stable")[:k]
    found = np.array(vectors).reshape(-1, len(a))[order].T
    return np.array(values)[order], found / np.linalg.norm(found, axis=0)
