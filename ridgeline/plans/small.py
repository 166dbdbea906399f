"""Solvers for systems that fit one task: methods whose steps follow one another, with incomplete factorisations.

Each system (key, row, col, v) with right side (key, row, v) is solved in a task of its own, so
many systems are solved in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Apply = Callable[[np.ndarray], np.ndarray]


def _lower_solve(m: np.ndarray, b: np.ndarray, unit: bool) -> np.ndarray:
    x = b.astype(float).copy()
    for i in range(len(b)):
        x[i] -= m[i, :i] @ x[:i]
        if not unit:
            x[i] /= m[i, i]
    return x


def _upper_solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b.astype(float).copy()
    for i in reversed(range(len(b))):
        x[i] = (x[i] - m[i, i + 1 :] @ x[i + 1 :]) / m[i, i]
    return x


def incomplete_lu(a: np.ndarray, fill: int = 0, threshold: float = 0.0) -> np.ndarray:
    """L and U in one matrix on the pattern of a; fill more entries a row above the threshold (relative to the row's norm) may stay."""
    m = a.astype(float).copy()
    n = len(m)
    pattern = a != 0
    for i in range(n):
        norm = np.linalg.norm(a[i]) or 1.0
        for k in np.flatnonzero(m[i, :i]):
            f = m[i, k] / m[k, k]
            if not pattern[i, k] and abs(f) < threshold * norm:
                m[i, k] = 0
                continue
            m[i, k] = f
            m[i, k + 1 :] -= f * m[k, k + 1 :]
            if not fill:
                m[i, k + 1 :][~pattern[i, k + 1 :]] = 0
        new = np.flatnonzero((m[i] != 0) & ~pattern[i])
        if len(new):
            weak = new[(np.abs(m[i, new]) < threshold * norm) | (np.argsort(np.argsort(-np.abs(m[i, new]))) >= fill)]
            m[i, weak] = 0
    return m


def preconditioner(a: np.ndarray, kind: str) -> Apply:
    """none, diagonal, ilu0 or ilut as a function that approximates the inverse."""
    if kind == "none":
        return lambda r: r
    if kind == "diagonal":
        d = np.where(np.diag(a) != 0, np.diag(a), 1.0)
        return lambda r: r / d
    if kind in ("ilu0", "ilut"):
        m = incomplete_lu(a) if kind == "ilu0" else incomplete_lu(a, fill=5, threshold=1e-3)
        return lambda r: _upper_solve(m, _lower_solve(m, r, True))
    raise ValueError(f"no such preconditioner: {kind}")


def sor(a: np.ndarray, b: np.ndarray, m: Apply, tolerance: float, most: int, omega: float = 1.2) -> np.ndarray:
    """Successive over-relaxation, row by row."""
    x = np.zeros(len(b))
    d = np.diag(a)
    for _ in range(most):
        for i in range(len(b)):
            x[i] += omega * (b[i] - a[i] @ x) / d[i]
        if np.linalg.norm(b - a @ x) <= tolerance * (np.linalg.norm(b) or 1.0):
            break
    return x


def tfqmr(a: np.ndarray, b: np.ndarray, m: Apply, tolerance: float, most: int) -> np.ndarray:
    """Transpose-free quasi-minimal residuals."""
    x, r = np.zeros(len(b)), m(b)
    w, u = r.copy(), r.copy()
    v = m(a @ u)
    au, d, r0 = v.copy(), np.zeros(len(b)), r.copy()
    tau, theta, eta, rho = np.linalg.norm(r), 0.0, 0.0, r @ r
    goal = tolerance * (tau or 1.0)
    for k in range(2 * most):
        if tau <= goal or not rho:
            break
        if k % 2 == 0:
            alpha = rho / (v @ r0)
            ahead = u - alpha * v
        w = w - alpha * au
        d = u + (theta * theta * eta / alpha) * d
        theta = np.linalg.norm(w) / tau
        c = 1 / np.sqrt(1 + theta * theta)
        tau, eta = tau * theta * c, c * c * alpha
        x = x + eta * d
        if k % 2 == 0:
            u = ahead
            au = m(a @ u)
        else:
            after = w @ r0
            beta, rho = after / rho, after
            u = w + beta * u
            fresh = m(a @ u)
            v = fresh + beta * (au + beta * v)
            au = fresh
    return x


def idrs(a: np.ndarray, b: np.ndarray, m: Apply, tolerance: float, most: int, s: int = 4) -> np.ndarray:
    """Induced dimension reduction with s shadow vectors."""
    n = len(b)
    s = min(s, n)
    x, r = np.zeros(n), b.astype(float).copy()
    goal = tolerance * (np.linalg.norm(b) or 1.0)
    p = np.linalg.qr(np.random.default_rng(1).normal(size=(n, s)))[0].T
    g, u, mm, omega = np.zeros((n, s)), np.zeros((n, s)), np.eye(s), 1.0
    steps = 0
    while np.linalg.norm(r) > goal and steps < most * (s + 1):
        f = p @ r
        for k in range(s):
            c = np.linalg.lstsq(mm[k:, k:], f[k:], rcond=None)[0]
            v = m(r - g[:, k:] @ c)
            u[:, k] = u[:, k:] @ c + omega * v
            g[:, k] = a @ u[:, k]
            for i in range(k):
                alpha = (p[i] @ g[:, k]) / mm[i, i]
                g[:, k] -= alpha * g[:, i]
                u[:, k] -= alpha * u[:, i]
            mm[k:, k] = p[k:] @ g[:, k]
            if not mm[k, k]:
                return x
            beta = f[k] / mm[k, k]
            r = r - beta * g[:, k]
            x = x + beta * u[:, k]
            steps += 1
            if np.linalg.norm(r) <= goal:
                return x
            f[k + 1 :] -= beta * mm[k + 1 :, k]
        v = m(r)
        t = a @ v
        tt = t @ t
        if not tt:
            break
        omega = (t @ r) / tt
        x, r = x + omega * v, r - omega * t
        steps += 1
    return x


def bicgstab_l(a: np.ndarray, b: np.ndarray, m: Apply, tolerance: float, most: int, ell: int = 2) -> np.ndarray:
    """Stabilised bi-conjugate gradients with a polynomial of degree ell."""
    n = len(b)
    x, b0 = np.zeros(n), m(b)
    rhat, r0 = [b0.copy()], b0.copy()
    uhat = [np.zeros(n)]
    rho0, alpha, omega = 1.0, 0.0, 1.0
    goal = tolerance * (np.linalg.norm(b0) or 1.0)
    for _ in range(most):
        if np.linalg.norm(rhat[0]) <= goal:
            break
        rho0 = -omega * rho0
        r, u = [rhat[0]], [uhat[0]]
        for j in range(ell):
            rho1 = r[j] @ r0
            beta = alpha * rho1 / rho0 if rho0 else 0.0
            rho0 = rho1
            u = [r[i] - beta * u[i] for i in range(j + 1)]
            u.append(m(a @ u[j]))
            gamma = u[j + 1] @ r0
            if not gamma:
                return x
            alpha = rho0 / gamma
            r = [r[i] - alpha * u[i + 1] for i in range(j + 1)]
            r.append(m(a @ r[j]))
            x = x + alpha * u[0]
        basis = np.stack(r[1:], axis=1)
        c = np.linalg.lstsq(basis, r[0], rcond=None)[0]
        x = x + np.stack(r[:-1], axis=1) @ c
        rhat = [r[0] - basis @ c]
        uhat = [u[0] - np.stack(u[1:], axis=1) @ c]
        omega = c[-1]
        if not omega:
            break
    return x


METHODS = {"sor": sor, "tfqmr": tfqmr, "idrs": idrs, "bicgstabl": bicgstab_l}
PRECONDITIONERS = ("none", "diagonal", "ilu0", "ilut")


def solve(matrices: DataFrame, right: DataFrame, method: str = "tfqmr", precondition: str = "none", tolerance: float = 1e-10, most: int = 1000, key: str = "id") -> DataFrame:
    """(key, i, v): the solution of each system. A matrix (key, row, col, v) and its right side (key, row, v) must fit one task."""
    chosen = METHODS[method]
    if precondition not in PRECONDITIONERS:
        raise ValueError(f"no such preconditioner: {precondition}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        body, side = pdf[pdf.col >= 0], pdf[pdf.col < 0]
        n = int(side.row.max()) + 1
        a, b = np.zeros((n, n)), np.zeros(n)
        a[body.row, body.col] = body.v
        b[side.row] = side.v
        return pd.DataFrame({key: pdf[key].iloc[0], "i": np.arange(n), "v": chosen(a, b, preconditioner(a, precondition), tolerance, most)})

    rows = matrices.select(key, "row", "col", "v").unionByName(right.select(key, "row", F.lit(-1).cast("bigint").alias("col"), "v"))
    return rows.groupBy(key).applyInPandas(run, f"{key} bigint, i bigint, v double")
