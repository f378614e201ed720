"""Eigenvectors of a symmetric matrix by QDWH spectral divide and conquer
(Nakatsukasa and Higham, 2013): the polar factor U of A - sI, found by dynamically
weighted Halley steps, gives the projector (U + I) / 2 on the invariant
subspace of the eigenvalues above s; both parts are split again until single
directions are left."""

from __future__ import annotations

import numpy as np

EPS = np.finfo("float64").eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    size = np.linalg.norm(a)
    x, eye = a / size, np.eye(n)
    try:
        low = 1.0 / (np.linalg.norm(np.linalg.inv(x)) or np.inf)
    except np.linalg.LinAlgError:
        low = EPS
    low = float(np.clip(low, EPS, 1.0))
    for _ in range(30):
        sq = low * low
        d = np.cbrt(4.0 * (1.0 - sq) / sq ** 2) if sq < 1 else 0.0
        r = np.sqrt(1.0 + d)
        wa = r + np.sqrt(max(0.0, 8.0 - 4.0 * d + 8.0 * (2.0 - sq) / (sq * r))) / 2.0
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        if wc > 100:
            # far from orthogonal: the step by QR, which needs no inverse
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:n] @ q[n:].T)
        else:
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2.0
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * sq) / (1.0 + wc * sq))
        if 1.0 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """(orthogonal basis, k): its first k columns span the eigenvalues above the shift."""
    n = len(a)
    p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2.0
    k = int(round(float(np.trace(p))))
    if not 0 < k < n:
        return None
    y = p @ rng.standard_normal((n, k))
    q, _ = np.linalg.qr(p @ np.linalg.qr(y)[0], mode="complete")
    return q, k


def top_components(a: np.ndarray, count: int, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the ``count`` largest eigenvalues.

    Subspaces below the wanted eigenvalues are not split further. A block that
    is a multiple of the identity within rounding is one repeated eigenvalue; any basis of
    it serves."""
    a = (a + a.T) / 2.0
    n = len(a)
    rng = np.random.default_rng(seed)
    scale = np.linalg.norm(a)
    found: list[np.ndarray] = []
    stack = [np.eye(n)]
    while stack and len(found) < count:
        basis = stack.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2.0
        k = len(block)
        mean = float(np.trace(block)) / k
        if k == 1 or np.linalg.norm(block - mean * np.eye(k)) <= 4 * EPS * scale:
            found += list(basis.T)
            continue
        stack += _parts(block, basis, mean, scale, rng)
    vecs = np.array(found[:count]).T.reshape(n, -1)
    # directions come out from above to below; equal within rounding may be out of order
    vals = np.einsum("ij,ij->j", vecs, a @ vecs)
    order = np.argsort(-vals, kind="stable")
    return vals[order], vecs[:, order]


def _parts(block: np.ndarray, basis: np.ndarray, mean: float, scale: float,
           rng: np.random.Generator) -> list[np.ndarray]:
    """The subspaces of a block below and above a shift, the latter last. A shift too
    near an eigenvalue leaves coupling between the parts; then the next shift is
    tried and the split with the least coupling taken."""
    spread = float(np.linalg.norm(block - mean * np.eye(len(block)))) / np.sqrt(len(block))
    best = None
    for step in (0.0, 0.11, -0.13, 0.37, -0.41, 0.73, -0.79, 1e-3, -1e-3):
        got = _split(block, mean + step * spread, rng)
        if got is None:
            continue
        q, k = got
        left = float(np.linalg.norm(q[:, :k].T @ block @ q[:, k:]))
        if best is None or left < best[0]:
            best = left, q, k
        if left <= 20 * EPS * scale:
            break
    if best is None:
        # eigenvalues equal up to rounding: no shift parts them
        return [basis[:, j:j + 1] for j in range(basis.shape[1] - 1, -1, -1)]
    _, q, k = best
    return [basis @ q[:, k:], basis @ q[:, :k]]
