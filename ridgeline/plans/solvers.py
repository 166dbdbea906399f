"""Fixpoint plans: linear solvers, eigenvalues and optimisers as loops of distributed products.

A vector of the iteration is a frame (i, ...) with one column for each of the method's vectors, so
updates are projections; a product with the matrix is one join and one sum. Each step's frame is
written to the shared folder, and only scalars (residues, dot products) come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.matrix import Matrix
from ridgeline.session import Workspace

#: A system of up to so many unknowns may be solved in one task.
SMALL = 4096


@dataclass
class Control:
    """When an iteration ends: below `convergence`, above `divergence` or at NaN, or after `most` steps; never before `least`. A monitor is told each step and its residue."""

    convergence: float = 1e-8
    divergence: float = 1e20
    most: int = 200
    least: int = 0
    monitor: Callable[[int, float], None] | None = None

    def goes_on(self, step: int, residue: float) -> bool:
        if self.monitor:
            self.monitor(step, residue)
        if step and (math.isnan(residue) or residue > self.divergence):
            return False
        if residue < self.convergence and step >= self.least:
            return False
        return step < self.most


@dataclass
class Result:
    x: DataFrame
    steps: int
    residue: float
    converged: bool


def held_by_column(a: Matrix, work: Workspace) -> Matrix:
    """The matrix with its elements written in buckets by column: products with it exchange vectors, never elements."""
    elements, _ = work.bucketed(a.general().elements.select("row", "col", "v"), "col")
    return Matrix(elements, a.rows, a.cols)


def _times(a: Matrix, rows: DataFrame, of: str, name: str) -> DataFrame:
    """rows with the product of the matrix and column `of` as column `name`."""
    product = a.vector_product(rows.select("i", F.col(of).alias("v")))
    return rows.join(product.withColumnRenamed("v", name), "i")


def _sums(rows: DataFrame, *values: Column) -> list[float]:
    got = rows.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{k}") for k, v in enumerate(values))).first()
    return list(got)


def _written(work: Workspace, rows: DataFrame, *values: Column) -> tuple[DataFrame, list[float]]:
    """The written rows and the sums of some expressions over them, from one job."""
    out, seen = work.measured(rows, **{f"s{k}": F.coalesce(F.sum(v), F.lit(0.0)) for k, v in enumerate(values)})
    return out, [seen[f"s{k}"] for k in range(len(values))]


def residue(a: Matrix, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the norm of A x - b over the norm of b."""
    rows = a.vector_product(x).withColumnRenamed("v", "ax").join(b.withColumnRenamed("v", "b"), "i")
    return rows.agg((F.sqrt(F.sum(F.pow(F.col("ax") - F.col("b"), 2))) / F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("value"))


def jacobi(a: Matrix, b: DataFrame, x0: DataFrame | None = None, omega: float = 1.0, control: Control | None = None) -> Result:
    """x becomes x + omega * (b - A x) / diagonal, until the residue is small."""
    control = control or Control()
    work = Workspace(b.sparkSession, "jacobi")
    start = b.withColumnRenamed("v", "b").join(a.diagonal().withColumnRenamed("v", "d"), "i")
    a = held_by_column(a, work)
    start = start.withColumn("x", F.lit(0.0)) if x0 is None else start.join(x0.withColumnRenamed("v", "x"), "i")
    now = work.write(start.select("i", "b", "d", "x"))
    norm = math.sqrt(_sums(now, F.col("b") * F.col("b"))[0]) or 1.0
    step, rest = 0, 1.0
    while control.goes_on(step, rest):
        after, (r2,) = _written(work, _times(a, now, "x", "ax").select("i", "b", "d", (F.col("x") + F.lit(omega) * (F.col("b") - F.col("ax")) / F.col("d")).alias("x"), (F.col("b") - F.col("ax")).alias("r")), F.col("r") * F.col("r"))
        step, rest = step + 1, math.sqrt(r2) / norm
        work.drop(now)
        now = after
    return Result(now.select("i", F.col("x").alias("v")), step, rest, rest < control.convergence)


def conjugate_gradients(a: Matrix, b: DataFrame, preconditioned: bool = False, control: Control | None = None) -> Result:
    """For symmetric positive definite matrices; preconditioned: by the diagonal. b = 0 gives x = 0."""
    control = control or Control()
    work = Workspace(b.sparkSession, "cg")
    d = a.diagonal().withColumnRenamed("v", "d") if preconditioned else b.select("i", F.lit(1.0).alias("d"))
    a = held_by_column(a, work)
    now = work.write(b.withColumnRenamed("v", "r").join(d, "i").select("i", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p")))
    rz, norm2 = _sums(now, F.col("r") * F.col("r") / F.col("d"), F.col("r") * F.col("r"))
    norm = math.sqrt(norm2)
    step, rest = 0, 1.0 if norm else 0.0
    while norm and control.goes_on(step, rest):
        product, (pap,) = _written(work, _times(a, now, "p", "ap"), F.col("p") * F.col("ap"))
        if not pap:
            break
        alpha = rz / pap
        moved = product.select("i", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        after_rz, r2 = _sums(moved, F.col("r") * F.col("r") / F.col("d"), F.col("r") * F.col("r"))
        after = work.write(moved.withColumn("p", F.col("r") / F.col("d") + (after_rz / rz) * F.col("p")))
        work.drop(now, product)
        now, rz, rest, step = after, after_rz, math.sqrt(r2) / norm, step + 1
    return Result(now.select("i", F.col("x").alias("v")), step, rest, rest < control.convergence)


def bicgstab(a: Matrix, b: DataFrame, control: Control | None = None) -> Result:
    """Stabilised bi-conjugate gradients, for general matrices."""
    control = control or Control()
    work = Workspace(b.sparkSession, "bicgstab")
    a = held_by_column(a, work)
    now = work.write(b.withColumnRenamed("v", "r").select("i", F.lit(0.0).alias("x"), "r", F.col("r").alias("r0"), F.col("r").alias("p")))
    (rho,) = _sums(now, F.col("r") * F.col("r0"))
    norm = math.sqrt(rho)
    step, rest = 0, 1.0 if norm else 0.0
    while norm and control.goes_on(step, rest):
        first, (apr,) = _written(work, _times(a, now, "p", "ap"), F.col("ap") * F.col("r0"))
        if not apr:
            break
        alpha = rho / apr
        second, (as_s, as_as) = _written(work, _times(a, first.withColumn("s", F.col("r") - alpha * F.col("ap")), "s", "as"), F.col("as") * F.col("s"), F.col("as") * F.col("as"))
        omega = as_s / as_as if as_as else 0.0
        moved = second.select("i", (F.col("x") + alpha * F.col("p") + omega * F.col("s")).alias("x"), (F.col("s") - omega * F.col("as")).alias("r"), "r0", "p", "ap")
        after_rho, r2 = _sums(moved, F.col("r") * F.col("r0"), F.col("r") * F.col("r"))
        beta = (after_rho / rho) * (alpha / omega) if omega and rho else 0.0
        after = work.write(moved.select("i", "x", "r", "r0", (F.col("r") + beta * (F.col("p") - omega * F.col("ap"))).alias("p")))
        work.drop(now, first, second)
        now, rho, rest, step = after, after_rho, math.sqrt(r2) / norm, step + 1
        if not omega:
            break
    return Result(now.select("i", F.col("x").alias("v")), step, rest, rest < control.convergence)


#: Ways to make the next vector of a basis orthogonal to the others: classical (all dot products in one pass) or modified Gram-Schmidt (one by one), once or twice.
ORTHOGONALISATIONS = ("cgs", "cgsr", "mgs", "mgsr")


def gmres(a: Matrix, b: DataFrame, restart: int = 10, orthogonalise: str = "cgs", control: Control | None = None) -> Result:
    """Generalised minimal residuals with restarts; the basis is columns of one frame, orthogonalised in one of ORTHOGONALISATIONS."""
    if orthogonalise not in ORTHOGONALISATIONS:
        raise ValueError(f"no such orthogonalisation: {orthogonalise}")
    control = control or Control()
    work = Workspace(b.sparkSession, "gmres")
    a = held_by_column(a, work)
    x = work.write(b.select("i", "v", F.lit(0.0).alias("x")))
    norm = math.sqrt(_sums(x, F.col("v") * F.col("v"))[0])
    step, rest = 0, 1.0 if norm else 0.0
    while norm and control.goes_on(step, rest):
        start = work.write(_times(a, x, "x", "ax").select("i", "v", "x", (F.col("v") - F.col("ax")).alias("q0")))
        beta = math.sqrt(_sums(start, F.col("q0") * F.col("q0"))[0])
        if not beta:
            rest = 0.0
            break
        basis = work.write(start.withColumn("q0", F.col("q0") / beta))
        h = np.zeros((restart + 1, restart))
        used = 0
        for k in range(restart):
            rows = work.write(_times(a, basis, f"q{k}", "w"))
            groups = [range(k + 1)] if orthogonalise.startswith("cgs") else [[j] for j in range(k + 1)]
            for group in groups * (2 if orthogonalise.endswith("r") else 1):
                dots = _sums(rows, *(F.col("w") * F.col(f"q{j}") for j in group))
                rest_w = F.col("w")
                for j, c in zip(group, dots, strict=True):
                    h[j, k] += c
                    rest_w = rest_w - c * F.col(f"q{j}")
                rows = rows.withColumn("w", rest_w)
            rows = work.write(rows)
            h[k + 1, k] = math.sqrt(_sums(rows, F.col("w") * F.col("w"))[0])
            used = k + 1
            step += 1
            if h[k + 1, k] <= 1e-14 * beta:
                break
            basis = work.write(rows.withColumn(f"q{k + 1}", F.col("w") / float(h[k + 1, k])).drop("w"))
        e = np.zeros(used + 1)
        e[0] = beta
        y, *_ = np.linalg.lstsq(h[: used + 1, :used], e, rcond=None)
        update = F.col("x")
        for j in range(used):
            update = update + float(y[j]) * F.col(f"q{j}")
        x = work.write(rows.select("i", "v", update.alias("x")))
        rest = float(np.linalg.norm(h[: used + 1, :used] @ y - e)) / norm
    return Result(x.select("i", F.col("x").alias("v")), step, rest, rest < control.convergence)


def gaussian_elimination(a: Matrix, b: DataFrame, pivoting: bool = True) -> DataFrame:
    """(i, v) of A x = b for a system of at most SMALL unknowns, eliminated in one task."""
    n = a.rows
    if n > SMALL or n != a.cols:
        raise ValueError(f"elimination takes square systems of at most {SMALL} unknowns")

    def run(frames):
        import pandas as pd

        rows = pd.concat(list(frames))
        m, r = np.zeros((n, n)), np.zeros(n)
        body = rows[rows.col >= 0]
        m[body.row, body.col] = body.v
        right = rows[rows.col < 0]
        r[right.row] = right.v
        yield pd.DataFrame({"i": np.arange(n), "v": _eliminate(m, r, pivoting)})

    rows = a.general().elements.unionByName(b.select(F.col("i").alias("row"), F.lit(-1).cast("bigint").alias("col"), "v"))
    return rows.coalesce(1).mapInPandas(run, "i bigint, v double")


def _eliminate(m: np.ndarray, r: np.ndarray, pivoting: bool) -> np.ndarray:
    n = len(r)
    for k in range(n):
        if pivoting:
            p = k + int(np.abs(m[k:, k]).argmax())
            m[[k, p]], r[[k, p]] = m[[p, k]], r[[p, k]]
        if m[k, k] == 0:
            raise ZeroDivisionError("the matrix is singular, or needs pivoting")
        f = m[k + 1 :, k] / m[k, k]
        m[k + 1 :, k:] -= f[:, None] * m[k, k:]
        r[k + 1 :] -= f * r[k]
    x = np.zeros(n)
    for k in reversed(range(n)):
        x[k] = (r[k] - m[k, k + 1 :] @ x[k + 1 :]) / m[k, k]
    return x


def lu(matrices: DataFrame, key: str = "id") -> DataFrame:
    """(key, row, col, v) of L and U in one matrix each, without pivoting, for many small matrices (key, row, col, v)."""

    def run(pdf):
        import pandas as pd

        n = int(max(pdf.row.max(), pdf.col.max())) + 1
        m = np.zeros((n, n))
        m[pdf.row, pdf.col] = pdf.v
        for k in range(n):
            m[k + 1 :, k] /= m[k, k]
            m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
        r, c = np.indices((n, n)).reshape(2, -1)
        return pd.DataFrame({key: pdf[key].iloc[0], "row": r, "col": c, "v": m.ravel()})

    return matrices.groupBy(key).applyInPandas(run, f"{key} bigint, row bigint, col bigint, v double")


SOLVERS: dict[str, Callable[..., Result]] = {"jacobi": jacobi, "cg": conjugate_gradients, "bicgstab": bicgstab, "gmres": gmres}
PRECONDITIONERS = {"none": False, "diagonal": True}


def power_iteration(a: Matrix, x0: DataFrame, shift: float = 0.0, control: Control | None = None) -> tuple[float, DataFrame, int]:
    """The eigenvalue farthest from `shift`, its vector, and the number of steps; 0 steps without convergence, -1 at NaN."""
    if a.rows != a.cols:
        raise ValueError("the matrix must be square")
    control = control or Control(convergence=1e-10, most=500)
    work = Workspace(x0.sparkSession, "power")
    a = held_by_column(a, work)
    now = work.write(x0.select("i", F.col("v").alias("x")))
    n, norm2 = now.agg(F.count(F.lit(1)), F.sum(F.col("x") * F.col("x"))).first()
    if n != a.rows:
        raise ValueError("the vector's size is not the matrix's")
    if not norm2:
        raise ValueError("the start must not be zero")
    norm, value = math.sqrt(norm2), 0.0
    for step in range(1, control.most + 1):
        unit = now.select("i", (F.col("x") / norm).alias("x"))
        after, (value, norm2) = _written(work, _times(a, unit, "x", "ax").select("i", F.col("x").alias("before"), (F.col("ax") - shift * F.col("x")).alias("x")), F.col("before") * F.col("x"), F.col("x") * F.col("x"))
        norm = math.sqrt(norm2) if norm2 == norm2 and norm2 > 0 else norm2
        if norm != norm:
            return value + shift, now.select("i", F.col("x").alias("v")), -1
        if not norm:
            return shift, unit.withColumnRenamed("x", "v"), step
        sign = 1.0 if value >= 0 else -1.0
        (gap,) = _sums(after, F.pow(F.col("x") / norm - sign * F.col("before"), 2))
        work.drop(now)
        now = after
        if math.sqrt(gap) < control.convergence:
            return value + shift, now.select("i", (F.col("x") / norm).alias("v")), step
    return value + shift, now.select("i", (F.col("x") / norm).alias("v")), 0


def qr_eigenvalues(matrices: DataFrame, key: str = "id", steps: int = 200) -> DataFrame:
    """(key, n, value): eigenvalues of many small symmetric matrices (key, row, col, v), descending, by shifted QR steps.

    The last row of what is left is taken off when all of it but the diagonal has vanished; `steps` bounds the steps for each.
    """

    def run(pdf):
        import pandas as pd

        n = int(max(pdf.row.max(), pdf.col.max())) + 1
        m = np.zeros((n, n))
        m[pdf.row, pdf.col] = pdf.v
        left, small = n, 1e-14 * max(np.abs(m).max(), 1e-300)
        while left > 1:
            part = m[:left, :left]
            for _ in range(steps):
                if np.abs(part[-1, :-1]).max() <= small:
                    break
                # The eigenvalue of the last two by two part that is nearer to its corner.
                a, b, c = part[-2, -2], part[-2, -1], part[-1, -1]
                half = (a - c) / 2
                shift = c - b * b / (half + math.copysign(math.hypot(half, b), half)) if b else c
                q, r = np.linalg.qr(part - shift * np.eye(left))
                part[:] = r @ q + shift * np.eye(left)
            left -= 1
        return pd.DataFrame({key: pdf[key].iloc[0], "n": np.arange(n), "value": np.sort(np.diag(m))[::-1]})

    return matrices.groupBy(key).applyInPandas(run, f"{key} bigint, n bigint, value double")


# Optimisers: parameters on the driver, gradients as one aggregate over the data.

Gradient = Callable[[list[float]], list[float]]


def gradient_of(rows: DataFrame, terms: Callable[[list[float]], list[Column]], mean: bool = True) -> Gradient:
    """A gradient from one aggregate query: the mean (or sum) of terms(w) over all rows."""

    def gradient(w: list[float]) -> list[float]:
        fold = F.avg if mean else F.sum
        return list(rows.agg(*(fold(t).alias(f"g{k}") for k, t in enumerate(terms(w)))).first())

    return gradient


def optimise(gradient: Gradient, w: list[float], method: str = "gradient_descent", rate: float = 0.1, momentum: float = 0.9, decay: float = 0.9, epsilon: float = 1e-8, control: Control | None = None) -> tuple[list[float], int, float]:
    """Parameters, steps and residue (mean change over rate) of: gradient_descent, momentum, nesterov, adagrad, rmsprop."""
    control = control or Control(convergence=1e-6, most=1000)
    now, speed, squares = np.array(w, float), np.zeros(len(w)), np.zeros(len(w))
    step, rest = 0, float("inf")
    while control.goes_on(step, rest):
        at = now - momentum * speed if method == "nesterov" else now
        g = np.array(gradient(at.tolist()), float)
        if method == "gradient_descent":
            change = rate * g
        elif method in ("momentum", "nesterov"):
            speed = momentum * speed + rate * g
            change = speed
        elif method == "adagrad":
            squares += g * g
            change = rate * g / (np.sqrt(squares) + epsilon)
        elif method == "rmsprop":
            squares = decay * squares + (1 - decay) * g * g
            change = rate * g / (np.sqrt(squares) + epsilon)
        else:
            raise ValueError(f"no such method: {method}")
        now = now - change
        step, rest = step + 1, float(np.abs(change).mean() / rate)
    return now.tolist(), step, rest
