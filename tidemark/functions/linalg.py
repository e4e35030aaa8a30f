"""Numeric kernels from published formulas, on NumPy and the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Shrunk covariance of centred rows, divided by n."""
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s**2).sum() - p * mu**2) / p
    squares = x**2
    b2 = min(d2, ((squares.T @ squares).sum() / n - (s**2).sum()) / (n * p))
    share = b2 / d2 if b2 > 0 and d2 > 0 else 0.0
    return (1 - share) * s + share * mu * np.eye(p)


def partial_betas(f: np.ndarray, y: np.ndarray, method: str = "ledoit_wolf") -> np.ndarray:
    """Betas of y on the columns of f by the moments of standardised values, back in raw units."""
    n = len(y)
    scale = f.std(axis=0, ddof=1)
    scale = np.where(scale > 0, scale, 1.0)
    z = (f - f.mean(axis=0)) / scale
    cross = z.T @ (y - y.mean()) / (n - 1)
    inner = ledoit_wolf(z) if method == "ledoit_wolf" else z.T @ z / (n - 1)
    return np.linalg.lstsq(inner, cross, rcond=None)[0] / scale


def strip(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual of y on all columns of f jointly, and what each column in turn explains of the last row, beyond those before it."""
    yc, fc = y - y.mean(), f - f.mean(axis=0)
    residual = yc - fc @ np.linalg.lstsq(fc, yc, rcond=None)[0]
    basis: list[np.ndarray] = []
    shares = np.zeros(fc.shape[1])
    for j in range(fc.shape[1]):
        v = fc[:, j] - sum((b * (b @ fc[:, j]) for b in basis), np.zeros(len(yc)))
        size = np.linalg.norm(v)
        if size > 1e-10 * max(1.0, np.linalg.norm(fc[:, j])):
            v = v / size
            basis.append(v)
            shares[j] = (v @ yc) * v[-1]
    return residual, shares


def _centred(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, windows less the means of their masked rows; the other rows are zero)."""
    n = mask.sum(axis=1)
    kept = np.where(mask[:, :, None], x, 0.0)
    return n, np.where(mask[:, :, None], kept - kept.sum(axis=1, keepdims=True) / n[:, None, None], 0.0)


def partial_betas_of_windows(x: np.ndarray, mask: np.ndarray, method: str = "ledoit_wolf") -> np.ndarray:
    """``partial_betas`` of many windows at once: x is (windows, rows, 1 + factors) with y first, mask says which rows count."""
    n, c = _centred(x, mask)
    y, f = c[:, :, 0], c[:, :, 1:]
    p = f.shape[2]
    scale = np.sqrt((f**2).sum(axis=1) / (n - 1)[:, None])
    scale = np.where(scale > 0, scale, 1.0)
    z = f / scale[:, None, :]
    cross = np.einsum("wnp,wn->wp", z, y) / (n - 1)[:, None]
    products = z.transpose(0, 2, 1) @ z
    if method == "ledoit_wolf":
        s = products / n[:, None, None]
        mu, size = np.trace(s, axis1=1, axis2=2) / p, (s**2).sum(axis=(1, 2))
        d2 = (size - p * mu**2) / p
        # the sum of all products of two squares of a row is the square of their sum
        b2 = np.minimum(d2, ((((z**2).sum(axis=2)) ** 2).sum(axis=1) / n - size) / (n * p))
        share = np.where((b2 > 0) & (d2 > 0), b2 / np.where(d2 > 0, d2, 1.0), 0.0)
        inner = (1 - share)[:, None, None] * s + (share * mu)[:, None, None] * np.eye(p)
    else:
        inner = products / (n - 1)[:, None, None]
    # the least solution by eigenvalues, those that are nothing left out
    values, vectors = np.linalg.eigh(inner)
    real = np.abs(values) > np.finfo(float).eps * p * np.abs(values).max(axis=1, keepdims=True)
    turned = np.einsum("wij,wi->wj", vectors, cross)
    return np.einsum("wij,wj->wi", vectors, np.where(real, turned / np.where(real, values, 1.0), 0.0)) / scale


def strip_of_windows(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``strip`` of many windows at once: the last rows' residuals and shares."""
    n, c = _centred(x, mask)
    y, f = c[:, :, 0], c[:, :, 1:]
    q, r = np.linalg.qr(f)
    sizes = np.abs(np.diagonal(r, axis1=1, axis2=2))
    clear = (sizes > 1e-8 * np.maximum(1.0, np.sqrt((f**2).sum(axis=1)))).all(axis=1) & (n > f.shape[2] + 1)
    shares = np.einsum("wnp,wn->wp", q, y) * q[:, -1, :]
    residual = y[:, -1] - shares.sum(axis=1)
    for w in np.flatnonzero(~clear):  # columns that nearly depend on those before: one by one
        alone, shares[w] = strip(x[w][mask[w], 0], x[w][mask[w], 1:])
        residual[w] = alone[-1]
    return residual, shares


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised, by its continued fraction, for arrays of one shape (or what is read as such) at once."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    turned = inside & (x > (a + 1) / (a + b + 2))  # it converges fast below that, and is one less the other tail above
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    z = np.where(inside, np.where(turned, 1 - x, x), 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.maximum(1 - (a + b) * z / (a + 1), tiny)
    out = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(d == 0, tiny, d)
            c = 1 + top / c
            c = np.where(c == 0, tiny, c)
            out *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    tail = np.where(turned, 1 - front * out, front * out)
    return np.where(inside, tail, np.where(x >= 1, 1.0, np.where(np.isnan(x), np.nan, 0.0)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers; degrees of freedom repeat, so each different one is computed once."""
    each, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) if v > 0 else math.nan for v in each.tolist()])[at].reshape(np.shape(x))


def t_two_sided(t, df):
    """Two-sided tail of Student's t, of numbers or arrays; NaN where there are no degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = (df > 0) & ~np.isnan(t)
    out = np.where(ok, incomplete_beta(np.where(ok, df, 1.0) / 2, 0.5, np.where(ok, df / np.where(ok, df + t * t, 1.0), 0.5)), np.nan)
    return float(out) if out.ndim == 0 else out


NORMAL = NormalDist()
