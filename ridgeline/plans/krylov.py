"""Distributed Krylov methods and over-relaxation: vectors are columns of one frame, products joins, and only scalars come to the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.matrix import Matrix
from ridgeline.plans.solvers import SOLVERS, Control, Result, held_by_column
from ridgeline.session import Workspace


class Space:
    """Vectors of one length as columns of a frame (i, ...), with products by a matrix whose elements never move."""

    def __init__(self, a: Matrix, b: DataFrame, precondition: str, name: str, **columns: Column):
        self.work = Workspace(b.sparkSession, name)
        self.a = held_by_column(a, self.work)
        if precondition not in ("none", "diagonal"):
            raise ValueError(f"no such preconditioner: {precondition}")
        d = a.diagonal().select("i", F.when(F.col("v") != 0, F.col("v")).otherwise(1.0).alias("m")) if precondition == "diagonal" else b.select("i", F.lit(1.0).alias("m"))
        self.now = b.withColumnRenamed("v", "b").join(d, "i").withColumns(columns)
        self.held = False

    def let(self, **columns: Column) -> None:
        """Sets columns from those of before, all at once."""
        self.now, self.held = self._rows(self.now.withColumns(columns))

    def _rows(self, rows: DataFrame) -> tuple[DataFrame, bool]:
        if self.held:
            self.before = self.now
        return rows, False

    def hold(self) -> DataFrame:
        """The frame, written."""
        if not self.held:
            after = self.work.write(self.now)
            if getattr(self, "before", None) is not None:
                self.work.drop(self.before)
            self.now, self.held, self.before = after, True, None
        return self.now

    def times(self, of: Column, name: str) -> None:
        """name = M A of, M the preconditioner."""
        rows = self.hold()
        product = self.a.vector_product(rows.select("i", of.alias("v"))).withColumnRenamed("v", "__p")
        self.let_rows(rows.join(product, "i").withColumn(name, F.col("__p") / F.col("m")).drop("__p"))

    def let_rows(self, rows: DataFrame) -> None:
        self.now, self.held = self._rows(rows)

    def sums(self, *values: Column) -> list[float]:
        got = self.hold().agg(*(F.coalesce(F.sum(v), F.lit(0.0)) for v in values)).first()
        return list(got)

    def norm(self, value: Column) -> float:
        return math.sqrt(self.sums(value * value)[0])

    def result(self, x: str, steps: int, rest: float, control: Control) -> Result:
        return Result(self.hold().select("i", F.col(x).alias("v")), steps, rest, rest < control.convergence)


def _c(name: str) -> Column:
    return F.col(name)


def tfqmr(a: Matrix, b: DataFrame, precondition: str = "none", control: Control | None = None) -> Result:
    """Transpose-free quasi-minimal residuals; the residue is their bound."""
    control = control or Control()
    s = Space(a, b, precondition, "tfqmr", x=F.lit(0.0), d=F.lit(0.0), r0=F.col("b"))
    s.let(r0=_c("b") / _c("m"))
    s.let(w=_c("r0"), u=_c("r0"))
    s.times(_c("u"), "v")
    s.let(au=_c("v"))
    (rho,) = s.sums(_c("r0") * _c("r0"))
    norm = tau = math.sqrt(rho)
    theta = eta = alpha = 0.0
    step, rest = 0, 1.0 if norm else 0.0
    while norm and rho and control.goes_on(step, rest):
        even = step % 2 == 0
        if even:
            alpha = rho / s.sums(_c("v") * _c("r0"))[0]
            s.let(ahead=_c("u") - alpha * _c("v"))
        s.let(w=_c("w") - alpha * _c("au"), d=_c("u") + (theta * theta * eta / alpha) * _c("d"))
        theta = s.norm(_c("w")) / tau
        c = 1 / math.sqrt(1 + theta * theta)
        tau, eta = tau * theta * c, c * c * alpha
        s.let(x=_c("x") + eta * _c("d"))
        if even:
            s.let(u=_c("ahead"))
            s.times(_c("u"), "au")
        else:
            (after,) = s.sums(_c("w") * _c("r0"))
            beta, rho = after / rho, after
            s.let(u=_c("w") + beta * _c("u"))
            s.let(old=_c("au"))
            s.times(_c("u"), "au")
            s.let(v=_c("au") + beta * (_c("old") + beta * _c("v")))
        step, rest = step + 1, tau / norm
    return s.result("x", step, rest, control)


def idrs(a: Matrix, b: DataFrame, shadows: int = 4, precondition: str = "none", control: Control | None = None) -> Result:
    """Induced dimension reduction; the shadow vectors are signs from a hash of each place."""
    control = control or Control()
    n = min(shadows, a.rows)
    sign = {f"p{k}": F.when(F.xxhash64("i", F.lit(k)) >= 0, 1.0).otherwise(-1.0) for k in range(n)}
    s = Space(a, b, precondition, "idrs", x=F.lit(0.0), r=F.lit(0.0), **sign, **{f"g{k}": F.lit(0.0) for k in range(n)}, **{f"u{k}": F.lit(0.0) for k in range(n)})
    s.let(r=_c("b") / _c("m"))
    norm = s.norm(_c("r"))
    mm, omega, step, rest = np.eye(n), 1.0, 0, 1.0 if norm else 0.0
    while norm and control.goes_on(step, rest):
        f = np.array(s.sums(*(_c(f"p{k}") * _c("r") for k in range(n))))
        for k in range(n):
            c = np.linalg.lstsq(mm[k:, k:], f[k:], rcond=None)[0]
            v, u = _c("r"), F.lit(0.0)
            for j, y in enumerate(c.tolist()):
                v, u = v - y * _c(f"g{k + j}"), u + y * _c(f"u{k + j}")
            s.let(**{f"u{k}": u + omega * v})
            s.times(_c(f"u{k}"), f"g{k}")
            for i in range(k):
                alpha = s.sums(_c(f"p{i}") * _c(f"g{k}"))[0] / mm[i, i]
                s.let(**{f"g{k}": _c(f"g{k}") - alpha * _c(f"g{i}"), f"u{k}": _c(f"u{k}") - alpha * _c(f"u{i}")})
            mm[k:, k] = s.sums(*(_c(f"p{i}") * _c(f"g{k}") for i in range(k, n)))
            if not mm[k, k]:
                return s.result("x", step, rest, control)
            beta = float(f[k] / mm[k, k])
            s.let(r=_c("r") - beta * _c(f"g{k}"), x=_c("x") + beta * _c(f"u{k}"))
            step, rest = step + 1, s.norm(_c("r")) / norm
            if not control.goes_on(step, rest):
                return s.result("x", step, rest, control)
            f[k + 1 :] -= beta * mm[k + 1 :, k]
        s.times(_c("r"), "t")
        tt, tr = s.sums(_c("t") * _c("t"), _c("t") * _c("r"))
        if not tt:
            break
        omega = tr / tt
        s.let(x=_c("x") + omega * _c("r"), r=_c("r") - omega * _c("t"))
        step, rest = step + 1, s.norm(_c("r")) / norm
    return s.result("x", step, rest, control)


def bicgstab_l(a: Matrix, b: DataFrame, degree: int = 2, precondition: str = "none", control: Control | None = None) -> Result:
    """Stabilised bi-conjugate gradients with a polynomial of some degree; a step is one degree."""
    control = control or Control()
    s = Space(a, b, precondition, "bicgstabl", x=F.lit(0.0), u0=F.lit(0.0), r0=F.lit(0.0))
    s.let(r0=_c("b") / _c("m"))
    s.let(q=_c("r0"))
    norm = s.norm(_c("r0"))
    rho0, alpha, omega = 1.0, 0.0, 1.0
    step, rest = 0, 1.0 if norm else 0.0
    while norm and control.goes_on(step, rest):
        rho0 = -omega * rho0
        for j in range(degree):
            (rho1,) = s.sums(_c(f"r{j}") * _c("q"))
            beta, rho0 = (alpha * rho1 / rho0 if rho0 else 0.0), rho1
            s.let(**{f"u{i}": _c(f"r{i}") - beta * _c(f"u{i}") for i in range(j + 1)})
            s.times(_c(f"u{j}"), f"u{j + 1}")
            (gamma,) = s.sums(_c(f"u{j + 1}") * _c("q"))
            if not gamma:
                return s.result("x", step, rest, control)
            alpha = rho0 / gamma
            s.let(x=_c("x") + alpha * _c("u0"), **{f"r{i}": _c(f"r{i}") - alpha * _c(f"u{i + 1}") for i in range(j + 1)})
            s.times(_c(f"r{j}"), f"r{j + 1}")
        pairs = [(i, j) for i in range(1, degree + 1) for j in range(1, degree + 1)]
        got = s.sums(*(_c(f"r{i}") * _c(f"r{j}") for i, j in pairs), *(_c("r0") * _c(f"r{j}") for j in range(1, degree + 1)))
        c = np.linalg.lstsq(np.array(got[: degree**2]).reshape(degree, degree), np.array(got[degree**2 :]), rcond=None)[0].tolist()
        x, r, u = _c("x"), _c("r0"), _c("u0")
        for j, y in enumerate(c):
            x, r, u = x + y * _c(f"r{j}"), r - y * _c(f"r{j + 1}"), u - y * _c(f"u{j + 1}")
        s.let(x=x, r0=r, u0=u)
        omega = c[-1]
        step, rest = step + degree, s.norm(_c("r0")) / norm
        if not omega:
            break
    return s.result("x", step, rest, control)


def colours(a: Matrix, work: Workspace) -> tuple[DataFrame, int]:
    """(i, colour) of the rows, so that rows which meet in an element have different colours, and how many there are.

    In each round the rows whose hash is above those of all neighbours without a colour take the least
    colour that no neighbour has; the rounds grow with the logarithm of the rows.
    """
    pairs = a.general().elements.where("row != col and v != 0").select(F.explode(F.array(F.struct(F.col("row").alias("i"), F.col("col").alias("j")), F.struct(F.col("col").alias("i"), F.col("row").alias("j")))).alias("e")).select("e.i", "e.j")
    arcs, _ = work.bucketed(pairs.distinct(), "j")
    rank = F.struct(F.xxhash64("i"), F.col("i"))
    now, seen = work.measured(a.elements.sparkSession.range(a.rows).select(F.col("id").alias("i"), F.lit(None).cast("int").alias("colour")), left=F.count(F.lit(1)))
    while seen["left"]:
        around = now.select(F.col("i").alias("j"), F.when(F.col("colour").isNull(), F.struct(F.xxhash64("i"), F.col("i"))).alias("rank"), F.col("colour").alias("other")).join(arcs, "j")
        found = around.groupBy("i").agg(F.max("rank").alias("most"), F.collect_set("other").alias("taken"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("taken"), F.lit(0))), F.coalesce("taken", F.array().cast("array<int>"))))
        mine = F.col("colour").isNull() & (F.col("most").isNull() | (rank > F.col("most")))
        after = now.join(found, "i", "left").select("i", F.when(mine, free).otherwise(F.col("colour")).alias("colour"))
        before = now
        now, seen = work.measured(after, left=F.count_if(F.col("colour").isNull()))
        work.drop(before)
    return now, int(now.agg(F.coalesce(F.max("colour") + 1, F.lit(0))).first()[0])


def sor(a: Matrix, b: DataFrame, omega: float = 1.2, control: Control | None = None) -> Result:
    """Successive over-relaxation, colour by colour: rows of one colour do not meet, so they move together as they would one by one."""
    control = control or Control()
    s = Space(a, b, "diagonal", "sor", x=F.lit(0.0))
    known, number = colours(a, s.work)
    s.let_rows(s.now.join(known, "i"))
    norm = s.norm(_c("b"))
    step, rest = 0, 1.0 if norm else 0.0
    while norm and control.goes_on(step, rest):
        for k in range(number):
            s.times(_c("x"), "ax")  # divided by the diagonal already
            s.let(x=F.when(_c("colour") == k, _c("x") + F.lit(omega) * (_c("b") / _c("m") - _c("ax"))).otherwise(_c("x")))
        s.times(_c("x"), "ax")
        step, rest = step + 1, s.norm(_c("b") - _c("ax") * _c("m")) / norm
    return s.result("x", step, rest, control)


SOLVERS |= {"tfqmr": tfqmr, "idrs": idrs, "bicgstabl": bicgstab_l, "sor": sor}
