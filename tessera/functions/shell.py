"""Four-node mixed-interpolation (MITC) shell element, batched in numpy.

Six dofs a node (u, v, w and three rotations), nodes in tensor order (-1,-1), (1,-1),
(-1,1), (1,1). The element is linear, so strains are a matrix B times the dofs and
stiffness is the sum of w det B^T D B over the 2x2 Gauss points. B comes from
putting all 24 unit vectors through the strain formulas at once.
"""

from __future__ import annotations

import numpy as np

GAUSS = 0.577350269189626
DOFS = 24
#: (xi, eta) of the Gauss points, first index fastest.
POINTS = [(a * GAUSS, b * GAUSS) for b in (-1, 1) for a in (-1, 1)]
NODES = [(-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0), (1.0, 1.0)]
SHEAR = 5.0 / 6.0
DRILL = 10.0

_U = np.zeros((4, 3, DOFS))
_R = np.zeros((4, 3, DOFS))
for _n in range(4):
    for _d in range(3):
        _U[_n, _d, 6 * _n + _d] = 1
        _R[_n, _d, 6 * _n + 3 + _d] = 1


def shape(xi: float, eta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and both derivatives of the bilinear functions."""
    a, b = np.array([1 - xi, 1 + xi]) / 2, np.array([1 - eta, 1 + eta]) / 2
    da = db = np.array([-0.5, 0.5])
    return np.outer(b, a).ravel(), np.outer(b, da).ravel(), np.outer(db, a).ravel()


def _at(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum over nodes: f (4,), x (E, 4, ...) -> (E, ...)."""
    return np.tensordot(x, f, axes=([1], [0])) if x.ndim == 3 else np.einsum("n,en...->e...", f, x)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def normals(x: np.ndarray) -> np.ndarray:
    """(E, 4, 3) unit normals at the nodes of (E, 4, 3) coordinates."""
    out = []
    for xi, eta in NODES:
        _, nx, ny = shape(xi, eta)
        out.append(_unit(np.cross(_at(nx, x), _at(ny, x))))
    return np.stack(out, 1)


def frame(x_xi: np.ndarray, n: np.ndarray, ref_axis: np.ndarray | None) -> np.ndarray:
    """(E, 3, 3) with columns t1, t2, n; t1 is the reference axis (or x_xi) in the tangent plane."""
    n = _unit(n)
    axis = x_xi if ref_axis is None else np.broadcast_to(ref_axis, n.shape)
    t1 = _unit(axis - np.sum(axis * n, -1, keepdims=True) * n)
    return np.stack((t1, np.cross(n, t1), n), -1)


def _fields(f, u):
    return np.einsum("n,endk->edk", f, u)


def _dot(a, b):
    """a (E, 3) with b (E, 3, 24)."""
    return np.einsum("ed,edk->ek", a, b)


def strain_matrix(x: np.ndarray, xi: float, eta: float, ref_axis: np.ndarray | None = None, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(B (E, 9, 24), det (E,)) at a point: e11 e22 2e12 k11 k22 k12 2e23 2e13 drill."""
    e = len(x)
    fn = normals(x)
    u = np.broadcast_to(_U, (e, *_U.shape))
    d = np.cross(np.broadcast_to(_R, (e, *_R.shape)), fn[..., None], axis=2)  # director: rotation x normal
    n, n_xi, n_eta = shape(xi, eta)
    x_xi, x_eta, n0 = _at(n_xi, x), _at(n_eta, x), _at(n, fn)
    xd = np.stack((x_xi, x_eta, n0), -1)
    xdz = np.stack((_at(n_xi, fn), _at(n_eta, fn), np.zeros_like(n0)), -1)
    xd_inv, det = np.linalg.inv(xd), np.linalg.det(xd)
    t = frame(x_xi, n0, ref_axis)
    to_t = xd_inv @ t
    u0 = np.stack((_fields(n_xi, u), _fields(n_eta, u), _fields(n, d)), 2)  # (E, 3, 3 derivatives, 24)
    u1 = np.stack((_fields(n_xi, d), _fields(n_eta, d), np.zeros((e, 3, DOFS))), 2)
    turn = lambda m, right: np.einsum("eia,eijk,ejb->eabk", t, m, right)
    u0x = turn(u0, to_t)
    u1x = turn(u1, to_t) - turn(u0, xd_inv @ xdz @ to_t)
    g = _tying(x, fn, u, d, xi, eta, mixed)
    local = np.einsum("eia,eijk,ejb->eabk", to_t, g, to_t)
    b = np.stack(
        (
            local[:, 0, 0], local[:, 1, 1], 2 * local[:, 0, 1], u1x[:, 0, 0], u1x[:, 1, 1], u1x[:, 0, 1] + u1x[:, 1, 0],
            2 * local[:, 1, 2], 2 * local[:, 0, 2], _drill(x, fn, u, d, n, ref_axis),
        ),
        1,
    )
    return b, det


def _tying(x, fn, u, d, xi, eta, mixed):
    """(E, 3, 3, 24) covariant strains, from the tying points or at the point itself."""

    def at(which: str, p: float, q: float):
        n, a, b = shape(p, q)
        xa, xb, un, dn = _at(a, x), _at(b, x), _at(n, fn), _fields(n, d)
        ua, ub = _fields(a, u), _fields(b, u)
        if which == "11":
            return _dot(xa, ua)
        if which == "22":
            return _dot(xb, ub)
        if which == "12":
            return 0.5 * (_dot(xb, ua) + _dot(xa, ub))
        if which == "23":
            return 0.5 * (_dot(xb, dn) + _dot(un, ub))
        return 0.5 * (_dot(xa, dn) + _dot(un, ua))

    g = np.zeros((len(x), 3, 3, DOFS))
    for which in ("11", "22", "12", "23", "13"):
        i, j = int(which[0]) - 1, int(which[1]) - 1
        if not mixed:
            v = at(which, xi, eta)
        elif which == "12":
            v = at(which, 0.0, 0.0)
        elif which in ("11", "13"):
            v = 0.5 * (1 - eta) * at(which, 0.0, -1.0) + 0.5 * (1 + eta) * at(which, 0.0, 1.0)
        else:
            v = 0.5 * (1 - xi) * at(which, -1.0, 0.0) + 0.5 * (1 + xi) * at(which, 1.0, 0.0)
        g[:, i, j] = g[:, j, i] = v
    return g


def _drill(x, fn, u, d, n, ref_axis):
    """Rotation about the normal against the in-plane spin of the mid-surface, at nodes, then interpolated."""
    out, eye = 0.0, np.broadcast_to(_R, (len(x), *_R.shape))
    for i, (p, q) in enumerate(NODES):
        _, a, b = shape(p, q)
        xa, xb = _at(a, x), _at(b, x)
        t = frame(xa, fn[:, i], ref_axis)
        to_t = np.linalg.inv(np.stack((xa, xb, fn[:, i]), -1)) @ t
        grad = np.einsum("eia,eijk,ejb->eabk", t, np.stack((_fields(a, u), _fields(b, u), d[:, i]), 2), to_t)
        spin = np.einsum("ed,edk->ek", t[..., 2], eye[:, i])  # rotation about the normal
        out = out + n[i] * (0.5 * (grad[:, 1, 0] - grad[:, 0, 1]) - spin)
    return out


def rigidity(e: np.ndarray, nu: np.ndarray, t: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(E, 9, 9): stress resultants of the strains, for an isotropic plate of thickness t; offset as a share of t."""
    e, nu, t, offset = map(np.asarray, (e, nu, t, offset))
    c = np.zeros((len(e), 3, 3))
    c[:, 0, 0] = c[:, 1, 1] = e / (1 - nu**2)
    c[:, 0, 1] = c[:, 1, 0] = nu * e / (1 - nu**2)
    g = e / (2 * (1 + nu))
    c[:, 2, 2] = g
    d = np.zeros((len(e), 9, 9))
    d[:, :3, :3] = t[:, None, None] * c
    d[:, :3, 3:6] = d[:, 3:6, :3] = -(t**2 * offset)[:, None, None] * c
    d[:, 3:6, 3:6] = (t**3 / 12 + t**3 * offset**2)[:, None, None] * c
    d[:, 6, 6] = d[:, 7, 7] = SHEAR * t * g
    d[:, 8, 8] = DRILL * SHEAR * t * g
    return d


def stiffness(x: np.ndarray, e, nu, t, offset=None, ref_axis: np.ndarray | None = None, mixed: bool = True) -> np.ndarray:
    """(E, 24, 24) stiffness matrices; residuals are K q, energies q K q / 2."""
    n = len(x)
    full = lambda v: np.broadcast_to(np.asarray(v, float), (n,))
    d = rigidity(full(e), full(nu), full(t), full(0.0 if offset is None else offset))
    k = np.zeros((n, DOFS, DOFS))
    for xi, eta in POINTS:
        b, det = strain_matrix(x, xi, eta, ref_axis, mixed)
        k += np.einsum("e,eai,eab,ebj->eij", det, b, d, b, optimize=True)
    return k


def nonlinear_membrane(u0x: np.ndarray, u1x: np.ndarray, e0ty: np.ndarray, drill: np.ndarray) -> np.ndarray:
    """The nine strains with quadratic bending terms; tying strains stay linear. Arrays (..., 3, 3)."""
    k = lambda i, j: np.sum(u0x[..., :, i] * u1x[..., :, j], -1)
    return np.stack(
        (
            e0ty[..., 0, 0], e0ty[..., 1, 1], 2 * e0ty[..., 0, 1],
            u1x[..., 0, 0] + k(0, 0), u1x[..., 1, 1] + k(1, 1), u1x[..., 0, 1] + u1x[..., 1, 0] + k(0, 1) + k(1, 0),
            2 * e0ty[..., 1, 2], 2 * e0ty[..., 0, 2], drill,
        ),
        -1,
    )
