"""Six-node plane-stress triangle on straight edges, batched in numpy; two dofs a node."""

from __future__ import annotations

import numpy as np

#: Nodes 3, 4, 5 are the middles of the edges 1-2, 2-0, 0-1.
RULE = [((1 / 3, 1 / 3), -27 / 48), ((0.2, 0.2), 25 / 48), ((0.6, 0.2), 25 / 48), ((0.2, 0.6), 25 / 48)]


def shape_gradients(r: float, s: float) -> np.ndarray:
    """(6, 2) derivatives by r and s, with barycentric 1-r-s, r, s at nodes 0, 1, 2."""
    t = 1 - r - s
    return np.array([[1 - 4 * t, 1 - 4 * t], [4 * r - 1, 0], [0, 4 * s - 1], [4 * s, 4 * r], [-4 * s, 4 * (t - s)], [4 * (t - r), -4 * r]])


def plane_stress(e: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """(E, 3, 3) stress of (exx, eyy, gxy)."""
    mu = e / (2 * (1 + nu))
    lam = 2 * mu * nu / (1 - nu)
    d = np.zeros((len(e), 3, 3))
    d[:, 0, 0] = d[:, 1, 1] = 2 * mu + lam
    d[:, 0, 1] = d[:, 1, 0] = lam
    d[:, 2, 2] = mu
    return d


def stiffness(x: np.ndarray, e, nu, t) -> np.ndarray:
    """(E, 12, 12) from corner coordinates (E, 3, 2); dof = 2 * node + component."""
    n = len(x)
    e, nu, t = (np.broadcast_to(np.asarray(v, float), (n,)) for v in (e, nu, t))
    jac = np.stack((x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]), -1)  # columns: by r, by s
    det, inv = np.linalg.det(jac), np.linalg.inv(jac)
    d, k = plane_stress(e, nu), np.zeros((n, 12, 12))
    for (r, s), w in RULE:
        g = np.einsum("na,eab->enb", shape_gradients(r, s), inv)
        b = np.zeros((n, 3, 12))
        b[:, 0, 0::2] = b[:, 2, 1::2] = g[..., 0]
        b[:, 1, 1::2] = b[:, 2, 0::2] = g[..., 1]
        k += np.einsum("e,eai,eab,ebj->eij", w * 0.5 * det * t, b, d, b)
    return k
