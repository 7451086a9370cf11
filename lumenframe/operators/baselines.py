"""Baselines that need an iteration for each spectrum: batch kernels in numpy, applied to Arrow batches.

A batch of spectra of equal length is solved at once: the penalised least-squares systems are
pentadiagonal, so one banded elimination runs over the whole batch channel by channel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK = 2048  # spectra solved at once, few enough for a core's cache


def solve_penta(w: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """Solve (W + lam D'D) z = W y for each row, D the second difference; no pivoting is needed."""
    return _solve_channels(np.ascontiguousarray(w.T), np.ascontiguousarray(y.T), lam).T


def _solve_channels(w: np.ndarray, y: np.ndarray, lam: float, room: np.ndarray | None = None) -> np.ndarray:
    """``solve_penta`` with a row for each channel, so that every step of the elimination runs over neighbouring numbers.

    The system is divided by ``lam``: its outer diagonals are 1 then. ``room``, three arrays of at least the size of ``y``, is
    used again in each call; the answer lies in it.
    """
    n, b = y.shape
    if n < 3:
        return y.copy()
    d = np.zeros((3, n))  # diagonal and two upper diagonals of D'D
    for r in range(n - 2):
        for i, ci in enumerate((1.0, -2.0, 1.0)):
            for j in range(i, 3):
                d[j - i, r + i] += ci * (1.0, -2.0, 1.0)[j]
    diag, up, _ = d.tolist()
    near, inv, z = (np.empty((3, y.size)) if room is None else room[:, : y.size]).reshape(3, n, b)
    p, e, t, mul, sub = np.empty(b), np.zeros(b), np.empty(b), np.multiply, np.subtract
    for k in range(n):
        x = z[k]
        mul(w[k], 1.0 / lam, t)
        mul(t, y[k], x)
        np.add(t, diag[k], p)
        if k > 1:
            sub(p, inv[k - 2], p)
            sub(x, z[k - 2], x)
        if k > 0:
            sub(p, mul(e, near[k - 1], t), p)
            sub(x, mul(e, z[k - 1], t), x)
            mul(e, inv[k - 1], e)
        sub(up[k], e, e)
        np.divide(1.0, p, inv[k])
        mul(e, inv[k], near[k])
        mul(x, inv[k], x)
    for k in range(n - 2, -1, -1):
        x = z[k]
        sub(x, mul(near[k], z[k + 1], t), x)
        if k + 2 < n:
            sub(x, mul(inv[k], z[k + 2], t), x)
    return z


def arpls(y: np.ndarray, lam: float = 1e5, tol: float = 1e-3, rounds: int = 20) -> np.ndarray:
    """Asymmetrically reweighted smoothing: weights follow a logistic of the residual over the spread of the negative ones."""
    if y.shape[1] < 5:
        return np.repeat(y.min(axis=1, keepdims=True), y.shape[1], axis=1)
    out = np.zeros_like(y)
    for at in range(0, len(y), BLOCK):
        live = np.arange(at, min(at + BLOCK, len(y)))
        yl = np.ascontiguousarray(y[live].T)
        w, room = np.ones_like(yl), np.empty((3, yl.size))
        for _ in range(rounds):
            z = _solve_channels(w, yl, lam, room)
            r = yl - z
            low, neg = np.minimum(r, 0.0), r < 0
            n = neg.sum(axis=0)
            m = low.sum(axis=0) / np.maximum(n, 1)
            low -= m
            low *= neg
            s = np.sqrt(np.einsum("kb,kb->b", low, low) / np.maximum(n, 1))
            by = 2 / np.maximum(s, 1e-12)
            r -= 2 * s - m
            r *= by
            new = np.exp(np.clip(r, -50, 50, out=r), out=r)
            new += 1
            np.divide(1.0, new, out=new)
            turn = np.subtract(new, w, out=low)
            move = np.sqrt(np.einsum("kb,kb->b", turn, turn)) / np.maximum(np.sqrt(np.einsum("kb,kb->b", w, w)), 1e-12)
            on = (n >= 2) & (move >= tol)
            if on.all():
                w = new
                continue
            out[live[~on]] = z[:, ~on].T
            live, yl, w, z = live[on], yl[:, on], new[:, on], z[:, on]
            if not len(live):
                break
        else:
            out[live] = z.T
    return out


def als(y: np.ndarray, lam: float = 1e5, p: float = 0.01, rounds: int = 10) -> np.ndarray:
    """Asymmetric least squares with fixed weights above and below; a reading on the curve weighs nothing."""
    if y.shape[1] < 5:
        return np.repeat(y.min(axis=1, keepdims=True), y.shape[1], axis=1)
    w, z = np.ones_like(y), y
    for _ in range(rounds):
        z = solve_penta(w, y, lam)
        w = np.where(y > z, p, 0.0) + np.where(y < z, 1 - p, 0.0)
    return z


def modpoly(y: np.ndarray, axis: np.ndarray, order: int = 3, rounds: int = 24, tol: float = 1e-3) -> np.ndarray:
    """Polynomial fitted again and again to the spectrum cut off at the fits before; each row stops when its own fit stands still."""
    x = (axis - axis.mean()) / (axis.std() or 1.0)
    v = np.vander(x, order + 1)
    hat = (v @ np.linalg.pinv(v)).T
    capped, base = y.copy(), np.full_like(y, np.inf)
    live = np.arange(len(y))
    for r in range(rounds):
        fit = capped[live] @ hat
        capped[live] = np.minimum(capped[live], fit)
        still = np.zeros(len(live), bool)
        if r:
            old = base[live]
            still = np.linalg.norm(fit - old, axis=1) < tol * (np.linalg.norm(old, axis=1) + 1e-9)
        base[live] = fit
        live = live[~still]
        if not len(live):
            break
    return base


def without_baseline(y: np.ndarray, method: str, axis: np.ndarray | None, **options) -> tuple[np.ndarray, np.ndarray]:
    """The spectra without their baseline, and what is missing in them: gaps are bridged for the fit. Rows without a reading stay."""
    y, gap = y.copy(), ~np.isfinite(y)
    keep, missing, k = ~gap.all(axis=1), np.isnan(y), np.arange(y.shape[1])
    for i in np.flatnonzero(gap.any(axis=1) & keep):
        y[i] = np.interp(k, k[~gap[i]], y[i, ~gap[i]])
    if keep.any():
        full = y[keep]
        y[keep] = full - ({"arpls": arpls, "als": als}[method](full, **options) if method != "poly" else modpoly(full, axis, **options))
        missing[keep] = gap[keep]
    return y, missing


def subtract_baseline(pts: DataFrame, method: str, **options) -> DataFrame:
    """The points with the baseline (arpls, als or poly) taken off; missing readings are bridged for the fit and stay null.

    Spectra without a reading pass unchanged.
    """
    if method not in ("arpls", "als", "poly"):
        raise ValueError(f"unknown baseline {method!r}: arpls, als or poly")

    def run(batches):
        for batch in batches:
            flat, size = flat_values(batch.column("y"))
            axis = flat_values(batch.column("w"))[0] if method == "poly" else None
            first, missing = np.cumsum(size) - size, np.isnan(flat)
            shapes: dict[tuple, list[int]] = {}
            for i, n in enumerate(size.tolist()):
                shapes.setdefault((n, axis[first[i] : first[i] + n].tobytes() if method == "poly" else b""), []).append(i)
            for (n, w), rows in shapes.items():
                at = first[rows][:, None] + np.arange(n)
                flat[at], missing[at] = without_baseline(flat[at], method, np.frombuffer(w) if w else None, **options)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, mask=missing))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("acq_id", "pt", "i", "j", "w")), out], names=["acq_id", "pt", "i", "j", "w", "y"])

    return pts.select("acq_id", F.col("pt").cast("int"), F.col("i").cast("int"), F.col("j").cast("int"), "w", "y").mapInArrow(run, "acq_id string, pt int, i int, j int, w array<double>, y array<double>")


def flat_values(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists (missing ones NaN), in an array that may be written to, and each list's length."""
    return np.array(lists.flatten().to_numpy(zero_copy_only=False), float), lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
