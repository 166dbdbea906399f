"""Ordinary differential equations, many at a time: explicit Runge-Kutta methods over the rows of a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction as Q

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Method:
    """Coefficients: a stage's dependence on those before, its time, the weights, and for adaptive methods those of the error."""

    a: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    error: tuple[float, ...] | None = None

    @property
    def c(self) -> list[float]:
        return [float(sum(row)) for row in self.a]


def _f(*rows: str) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(float(Q(x)) for x in row.split()) for row in rows)


def _m(a: tuple[str, ...], b: str, lower: str | None = None) -> Method:
    weights = [Q(x) for x in b.split()]
    error = tuple(float(x - Q(y)) for x, y in zip(weights, lower.split(), strict=True)) if lower else None
    return Method(_f(*a), tuple(map(float, weights)), error)


#: The coefficients of published Runge-Kutta methods, in natural order (stages; weights; weights of the embedded method).
METHODS: dict[str, Method] = {
    "euler": _m(("",), "1"),
    "midpoint": _m(("", "1/2"), "0 1"),
    "heun2": _m(("", "1"), "1/2 1/2"),
    "ralston2": _m(("", "2/3"), "1/4 3/4"),
    "kutta": _m(("", "1/2", "-1 2"), "1/6 2/3 1/6"),
    "heun3": _m(("", "1/3", "0 2/3"), "1/4 0 3/4"),
    "vanderhouwenwray": _m(("", "8/15", "1/4 5/12"), "1/4 0 3/4"),
    "ralston3": _m(("", "1/2", "0 3/4"), "2/9 1/3 4/9"),
    "sspr3": _m(("", "1", "1/4 1/4"), "1/6 1/6 2/3"),
    "rungekutta": _m(("", "1/2", "0 1/2", "0 0 1"), "1/6 1/3 1/3 1/6"),
    "rule38": _m(("", "1/3", "-1/3 1", "1 -1 1"), "1/8 3/8 3/8 1/8"),
    "ralston4": Method(((), (0.4,), (0.29697761, 0.15875964), (0.21810040, -3.05096516, 3.83286476)), (0.17476028, -0.55148066, 1.20553560, 0.17118478)),
    "fehlberg2": _m(("", "1/2", "1/256 255/256"), "1/512 255/256 1/512", "1/256 255/256 0"),
    "bogackishampine": _m(("", "1/2", "0 3/4", "2/9 1/3 4/9"), "2/9 1/3 4/9 0", "7/24 1/4 1/3 1/8"),
    "merson": _m(("", "1/3", "1/6 1/6", "1/8 0 3/8", "1/2 0 -3/2 2"), "1/6 0 0 2/3 1/6", "1/10 0 3/10 2/5 1/5"),
    "fehlberg5": _m(("", "1/4", "3/32 9/32", "1932/2197 -7200/2197 7296/2197", "439/216 -8 3680/513 -845/4104", "-8/27 2 -3544/2565 1859/4104 -11/40"), "16/135 0 6656/12825 28561/56430 -9/50 2/55", "25/216 0 1408/2565 2197/4104 -1/5 0"),
    "cashkarp": _m(("", "1/5", "3/40 9/40", "3/10 -9/10 6/5", "-11/54 5/2 -70/27 35/27", "1631/55296 175/512 575/13824 44275/110592 253/4096"), "37/378 0 250/621 125/594 0 512/1771", "2825/27648 0 18575/48384 13525/55296 277/14336 1/4"),
    "dormandprince": _m(("", "1/5", "3/40 9/40", "44/45 -56/15 32/9", "19372/6561 -25360/2187 64448/6561 -212/729", "9017/3168 -355/33 46732/5247 49/176 -5103/18656", "35/384 0 500/1113 125/192 -2187/6784 11/84"), "35/384 0 500/1113 125/192 -2187/6784 11/84 0", "5179/57600 0 7571/16695 393/640 -92097/339200 187/2100 1/40"),
}
METHODS |= {"ode1": METHODS["euler"], "ode2": METHODS["heun2"], "ode23": METHODS["bogackishampine"], "ode45": METHODS["dormandprince"]}

Derivative = Callable[[np.ndarray, np.ndarray], np.ndarray]


def integrate(f: Derivative, t0: np.ndarray, t1: np.ndarray, u: np.ndarray, tau: np.ndarray, method: Method, adaptivity: float = 0.0, most_steps: int = 10_000_000) -> np.ndarray:
    """u at t1 of every row of u (rows x components), all rows stepping together.

    A step is taken where its error is below adaptivity (always without adaptivity or embedded
    weights); the next length is 0.8 * tau * (adaptivity / error) ** 0.2. Steps end exactly at t1.
    """
    t, u, tau = t0.astype(float).copy(), u.astype(float).copy(), tau.astype(float).copy()
    adaptive = adaptivity > 0 and method.error is not None
    live = np.flatnonzero(t < t1)
    while len(live) and most_steps:
        most_steps -= 1
        left = t1[live] - t[live]
        last = tau[live] >= left
        h = np.where(last, left, tau[live])
        k: list[np.ndarray] = []
        for row, c in zip(method.a, method.c, strict=True):
            at = u[live]
            for w, kk in zip(row, k, strict=False):
                if w:
                    at = at + (h * w)[:, None] * kk
            k.append(f(t[live] + c * h, at))
        new = u[live] + sum((h * w)[:, None] * kk for w, kk in zip(method.b, k, strict=True) if w)
        good = np.ones(len(live), bool)
        if adaptive:
            error = np.abs(sum((h * w)[:, None] * kk for w, kk in zip(method.error, k, strict=True) if w)).max(axis=1)
            good = error < adaptivity
            with np.errstate(divide="ignore"):
                tau[live] = np.where(error > 0, 0.8 * h * (adaptivity / error) ** 0.2, tau[live])
        done = live[good]
        u[done] = new[good]
        t[done] = np.where(last[good], t1[done], t[done] + h[good])
        live = live[t[live] < t1[live]]
    return u


def solve(rows: DataFrame, f: Derivative, method: str = "rungekutta", adaptivity: float = 0.0) -> DataFrame:
    """(id, u): the state at t1 of each row's equation u' = f(t, u).

    rows: id bigint, t0, t1, tau double, u array<double> (of one length in all rows). f takes times
    (rows) and states (rows x components) as arrays and gives derivatives. Each batch of rows is one
    array computation; no row leaves its partition.
    """
    chosen = METHODS[method]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            u = integrate(f, pdf.t0.to_numpy(), pdf.t1.to_numpy(), np.vstack(pdf.u.to_numpy()), pdf.tau.to_numpy(), chosen, adaptivity)
            yield pd.DataFrame({"id": pdf.id, "u": list(u)})

    return rows.select("id", "t0", "t1", "tau", "u").mapInPandas(run, "id bigint, u array<double>")
