"""Temporal bases as small numpy matrices (time x component), and a registry for more kinds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..errors import NoMethod, ValidationError
from ..options import option

_KINDS: dict[str, Callable[..., np.ndarray]] = {}


def temporal_basis(kind: str):
    """Decorator: a function (n_time, n_basis, **parameters) -> matrix becomes a basis of that kind."""

    def add(f):
        _KINDS[kind] = f
        return f

    return add


def basis_matrix(kind: str, n_time: int, n_basis: int, **parameters) -> np.ndarray:
    if kind not in _KINDS:
        raise NoMethod(f"no temporal basis {kind!r}; there are {', '.join(sorted(_KINDS))}", "basis_matrix")
    return _KINDS[kind](n_time, n_basis, **parameters)


def kinds() -> list[str]:
    return sorted(_KINDS)


@temporal_basis("dct")
def dct(n_time: int, n_basis: int, **_) -> np.ndarray:
    k = np.arange(n_basis)
    b = np.cos(np.pi * (np.arange(n_time)[:, None] + 0.5) * k / n_time) * math.sqrt(2 / n_time)
    return b * np.where(k == 0, math.sqrt(0.5), 1.0)


@temporal_basis("polynomial")
def polynomial(n_time: int, n_basis: int, **_) -> np.ndarray:
    """Orthonormal polynomials of rising degree; each has a positive leading coefficient."""
    if n_basis <= 0:
        return np.zeros((n_time, 0))
    x = np.arange(n_time) - (n_time - 1) / 2
    x = x / max(1.0, np.abs(x).max())
    q, r = np.linalg.qr(np.vander(x, n_basis, increasing=True))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


@temporal_basis("bspline")
def bspline(n_time: int, n_basis: int, order: int = 3, knot_spacing_method: str = "equidistant", **_) -> np.ndarray:
    """B-splines of a degree with intercept over 1..n_time; inner knots at even quantiles."""
    inner = n_basis - order - 1
    if inner < 0:
        raise ValidationError(f"{n_basis} B-splines are too few for degree {order}", "bspline")
    x = np.arange(1, n_time + 1, dtype=float)
    share = np.linspace(0, 1, inner + 2)[1:-1]
    knots = np.concatenate([[1.0] * (order + 1), np.quantile(x, share) if knot_spacing_method == "quantile" else 1 + share * (n_time - 1), [float(n_time)] * (order + 1)])
    b = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    b[x == knots[-1], np.flatnonzero(knots[:-1] < knots[-1])[-1]] = 1
    for d in range(1, order + 1):
        n = len(knots) - d - 1
        width = knots[d:] - knots[:-d]
        safe = np.where(width > 0, width, 1)
        up = (x[:, None] - knots[:-d]) / safe * (width > 0)
        down = (knots[d:] - x[:, None]) / safe * (width > 0)
        b = up[:, :n] * b[:, :n] + down[:, 1 : n + 1] * b[:, 1 : n + 1]
    return b


def bspline_knots(n_time: int, n_basis: int, order: int = 3) -> np.ndarray:
    return 1 + np.linspace(0, 1, n_basis - order + 1)[1:-1] * (n_time - 1)


@temporal_basis("dpss")
def dpss(n_time: int, n_basis: int, time_bandwidth_product: float = 3.0, **_) -> np.ndarray:
    """Slepian sequences: leading eigenvectors of the sinc kernel, of unit norm, first entry not negative."""
    nw = float(time_bandwidth_product)
    if not 0 < nw < n_time / 2:
        raise ValidationError(f"time-bandwidth product {nw} must be between 0 and n_time / 2", "dpss")
    if n_basis > 2 * nw:
        raise ValidationError(f"{n_basis} sequences are more than twice the product {nw}", "dpss")
    m = np.arange(n_time)
    kernel = 2 * nw / n_time * np.sinc(2 * nw / n_time * (m[:, None] - m))
    v = np.linalg.eigh(kernel)[1][:, ::-1][:, :n_basis]
    return v * np.where(v[0] < 0, -1.0, 1.0)


def daubechies(moments: int) -> np.ndarray:
    """Scaling filter with that many vanishing moments, of least phase, by spectral factorisation."""
    if moments == 1:
        return np.array([1.0, 1.0]) / math.sqrt(2)
    # roots of sum C(n-1+k, k) y^k, each mapped to the z inside the unit circle with y = (2 - z - 1/z) / 4
    p = [math.comb(moments - 1 + k, k) for k in range(moments)]
    inside = []
    for y in np.roots(p[::-1]):
        z = np.roots([1, 4 * y - 2, 1])
        inside.append(z[np.argmin(np.abs(z))])
    h = np.real(np.poly([-1.0] * moments + inside))
    return h * math.sqrt(2) / h.sum()


#: Scaling filters that no short rule gives (least asymmetric with 8 taps, coiflet with 6).
LA8 = (-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427)
C6 = (-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539)

_ALIASES = {"haar": "d2", "db1": "d2", "sym8": "la8", "coif6": "c6"}


def scaling_filter(name: str) -> np.ndarray:
    """Orthonormal scaling filter: haar, dN (N taps, even), dbN (as dN; db1 is haar), la8/sym8, c6/coif6."""
    name = name.lower()
    name = _ALIASES.get(name, name)
    if name == "la8":
        return np.array(LA8)
    if name == "c6":
        return np.array(C6)
    taps = name.removeprefix("db").removeprefix("d")
    if not taps.isdigit() or int(taps) % 2 or int(taps) < 2:
        raise ValidationError(f"unknown wavelet {name!r}", "scaling_filter")
    return daubechies(int(taps) // 2)


def wavelet_filter(scaling: np.ndarray) -> np.ndarray:
    """Quadrature mirror of a scaling filter."""
    return scaling[::-1] * (-1.0) ** np.arange(len(scaling))


@temporal_basis("wavelet")
def wavelet(n_time: int, n_basis: int | None = None, wavelet: str = "db4", **_) -> np.ndarray:
    """Columns are the rows of the periodic full-depth wavelet transform: details from fine to coarse, then
    the approximation. The matrix is orthogonal; n_basis doesn't shorten it."""
    if n_time < 1 or n_time & (n_time - 1):
        raise ValidationError(f"a wavelet basis needs a power of two, not {n_time}", "wavelet")
    g = scaling_filter(wavelet)
    h = wavelet_filter(g)
    low, rows = np.eye(n_time), []
    while len(low) > 1:
        n = len(low)
        at = (2 * np.arange(n // 2)[:, None] + 1 - np.arange(len(g))) % n
        rows.append(np.einsum("j,ijk->ik", h, low[at]))
        low = np.einsum("j,ijk->ik", g, low[at])
    return np.concatenate([*rows, low]).T


def modwt_max_level(n_time: int, taps: int) -> int:
    return math.floor(math.log2((n_time - 1) / (taps - 1) + 1))


def modwt_levels(n_time: int, name: str, levels: int | None = None) -> int:
    return levels or max(1, min(6, modwt_max_level(n_time, len(scaling_filter(name)))))


def modwt(x: np.ndarray, name: str, levels: int, boundary: str = "periodic") -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Details and approximations of every level; x has time in its first axis."""
    if boundary == "reflection":
        x = np.concatenate([x, x[::-1]])
    g = scaling_filter(name) / math.sqrt(2)
    h = wavelet_filter(scaling_filter(name)) / math.sqrt(2)
    n, v, details, approx = len(x), np.asarray(x, float), [], []
    for j in range(levels):
        at = (np.arange(n)[:, None] - 2**j * np.arange(len(g))) % n
        details.append(np.einsum("j,ij...->i...", h, v[at]))
        v = np.einsum("j,ij...->i...", g, v[at])
        approx.append(v)
    return details, approx


def imodwt(details: list[np.ndarray], last: np.ndarray, name: str) -> np.ndarray:
    g = scaling_filter(name) / math.sqrt(2)
    h = wavelet_filter(scaling_filter(name)) / math.sqrt(2)
    n, v = len(last), last
    for j in range(len(details) - 1, -1, -1):
        at = (np.arange(n)[:, None] + 2**j * np.arange(len(g))) % n
        v = np.einsum("j,ij...->i...", h, details[j][at]) + np.einsum("j,ij...->i...", g, v[at])
    return v


def default_components(kind: str, n_time: int, denoise: bool = False) -> int:
    """How many components a basis of this length has unless told otherwise."""
    return max(1, {
        "dct": min(50, n_time // 4) if denoise else min(20, n_time // 5),
        "polynomial": min(5, n_time // 10),
        "bspline": min(30, n_time // 5),
        "dpss": 7,
        "wavelet": min(50, n_time // 4),
    }.get(kind, n_time))


def suggest_dpss(tr: float, n_time: int, study_type: str = "resting", max_freq: float | None = None, conservative: bool = False) -> dict:
    """Slepian parameters for a repetition time: time_bandwidth_product, n_basis, preserved_freq, notes."""
    if tr <= 0 or n_time <= 0:
        raise ValidationError("tr and n_time must be positive", "suggest_dpss")
    #: Fixed values by kind of study: product at a long and at a short repetition time, and the border.
    table = {"resting": (2.0, 2.5, 2.0), "task": (3.0, 3.5, 2.0), "event": (4.0, 4.5, 1.5)}
    if study_type in table:
        slow, fast, border = table[study_type]
        nw = slow if tr >= border else fast
    elif study_type == "custom":
        if max_freq is None:
            raise ValidationError("a custom study needs max_freq", "suggest_dpss")
        nw = min(max(max_freq * n_time * tr / 2, 1.5), 6.0)
    else:
        raise ValidationError(f"unknown study type {study_type!r}", "suggest_dpss")
    nw = max(1.5, min(nw * (0.8 if conservative else 1.0), n_time / 4))
    most = math.floor(2 * nw)
    n_basis = int(max(1, min(round(0.8 * most), most, n_time / 2)))
    kept = 2 * nw / (n_time * tr)
    notes = [f"keeps 0 to {kept:.3f} Hz of a {study_type} study with a repetition time of {tr:.1f} s"]
    notes += ["narrow: may smooth too much"] * (nw < 2) + ["broad: removes less noise"] * (nw > 4)
    return {"time_bandwidth_product": round(nw, 2), "n_basis": n_basis, "preserved_freq": round(kept, 4), "notes": "; ".join(notes)}


def default_order(kind: str) -> int:
    return int(option("temporal.bspline_order" if kind == "bspline" else "temporal.polynomial_order"))
