"""Scalar functions as Column expressions: element-wise math, discrete math, complex numbers, small vectors, strings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element-wise functions of one operand. Logarithms of numbers that have none follow IEEE, not SQL.


def _ieee_log(log: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def f(x: Column) -> Column:
        return F.when(x > 0, log(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))

    return f


UNARY: dict[str, Callable[[Column], Column]] = {
    "plus": F.positive,
    "minus": F.negative,
    "not": lambda x: ~x,
    "bit_not": F.bitwise_not,
    "abs": F.abs,
    "sign": F.signum,
    "exp": F.exp,
    "sqr": lambda x: x * x,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "log": _ieee_log(F.ln),
    "log10": _ieee_log(F.log10),
    "log2": _ieee_log(F.log2),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
}


def divide(a: Column, b: Column) -> Column:
    """IEEE division of doubles: by zero gives infinities and NaN, not an error."""
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def integer_divide(a: Column, b: Column) -> Column:
    """Division that truncates towards zero; by zero gives null."""
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint")))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "times": lambda a, b: a * b,
    "divide": divide,
    "modulo": F.try_mod,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "bit_and": lambda a, b: a.bitwiseAND(b),
    "bit_or": lambda a, b: a.bitwiseOR(b),
    "bit_xor": lambda a, b: a.bitwiseXOR(b),
    "minimum": F.least,
    "maximum": F.greatest,
    "pow": F.pow,
    "atan2": F.atan2,
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
}


def linear_combination(coefficients: Sequence[float], values: Sequence[Column]) -> Column:
    """The sum of coefficient times value; terms with coefficient 0 are left out of the plan."""
    terms = [F.lit(c) * v if c != 1 else v for c, v in zip(coefficients, values, strict=True) if c != 0]
    out = F.lit(0.0)
    for i, t in enumerate(terms):
        out = t if not i else out + t
    return out


def is_small(x: Column, epsilon: float = 1e-12) -> Column:
    return F.abs(x) < epsilon


def arg_min(a: Column, b: Column) -> Column:
    """Which of two values is the smaller: 0 or 1; the first wins ties."""
    return F.when(a <= b, 0).otherwise(1)


def arg_max(a: Column, b: Column) -> Column:
    return F.when(a >= b, 0).otherwise(1)


def norm(values: Sequence[Column], p: float = 2.0) -> Column:
    """The p-norm of a few values; infinity gives the largest absolute value."""
    sizes = [F.abs(v) for v in values]
    if p == float("inf"):
        return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    if p == 1:
        return sum(sizes[1:], sizes[0])
    if p == 2:
        squares = [v * v for v in values]
        return F.sqrt(sum(squares[1:], squares[0]))
    powers = [F.pow(s, F.lit(p)) for s in sizes]
    return F.pow(sum(powers[1:], powers[0]), F.lit(1 / p))


# Discrete math.


def round_up_division(a: Column, b: Column) -> Column:
    return F.ceil(a.cast("double") / b).cast("bigint")


def round_to_multiple(a: Column, b: Column) -> Column:
    """The least multiple of b that is not below a."""
    return round_up_division(a, b) * b


def is_pow2(a: Column) -> Column:
    return (a > 0) & (a.bitwiseAND(a - 1) == 0)


def discrete_log2(a: Column) -> Column:
    """The floor of the binary logarithm of a positive integer."""
    return (F.length(F.bin(a)) - 1).cast("bigint")


def discrete_pow(base: Column, exponent: Column) -> Column:
    """An exact integer power, by repeated multiplication."""
    return F.aggregate(F.when(exponent > 0, F.sequence(F.lit(1).cast("bigint"), exponent.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda acc, _: acc * base.cast("bigint"))


def discrete_product(first: Column, last: Column) -> Column:
    """The product of the integers from first to last; 1 if there are none."""
    return F.aggregate(F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda acc, x: acc * x)


def combinations(k: Column, n: Column) -> Column:
    """How many subsets of size k a set of n elements has; 0 outside 0 <= k <= n."""
    small = F.least(k, n - k).cast("bigint")
    steps = F.when(small > 0, F.sequence(F.lit(1).cast("bigint"), small)).otherwise(F.array().cast("array<bigint>"))
    exact = F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: integer_divide(acc * (n.cast("bigint") - small + i), i))
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(exact)


def first_combinations_sum(k: int, n: Column) -> Column:
    """The sum of combinations(i, n) over i below k."""
    out = F.lit(0).cast("bigint")
    for i in range(k):
        out = out + combinations(F.lit(i), n)
    return out


def multiply_overflows(a: Column, b: Column) -> Column:
    """Whether the product of two 64-bit integers leaves 64 bits."""
    return F.try_multiply(a.cast("bigint"), b.cast("bigint")).isNull()


def prime_factors(n: Column, limit: int = 1 << 16) -> Column:
    """The prime factors of a positive integer, ascending, with repetitions; none of 1.

    Primes below `limit` are divided out in whole numbers. What is left is a prime if it is below limit
    squared, and an error otherwise; so all integers below limit squared have factors. An integer is
    divided by the primes up to the first power of 2 that is not below its root, never by all of them.
    """
    sieve = np.ones(limit, bool)
    sieve[:2] = False
    for k in range(2, int(limit**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    whole = n.cast("bigint")
    upto = lambda most: F.split(F.lit(" ".join(map(str, np.flatnonzero(sieve[:most]).tolist()))), " ").cast("array<bigint>")  # noqa: E731, a constant
    primes = upto(limit)
    for k in reversed(range(2, (limit - 1).bit_length())):
        primes = F.when(whole < 1 << (2 * k), upto(1 << k)).otherwise(primes)
    start = F.struct(whole.alias("rest"), F.array().cast("array<bigint>").alias("out"))
    most = F.sequence(F.lit(1), F.lit(62))  # 2 divides a 64-bit integer at most so often

    def divide_out(acc: Column, p: Column) -> Column:
        once = lambda a, _: F.when(a["rest"] % p == 0, F.struct(integer_divide(a["rest"], p).alias("rest"), F.concat(a["out"], F.array(p)).alias("out"))).otherwise(a)
        return F.aggregate(most, acc, once)

    def finish(acc: Column) -> Column:
        last = F.when(acc["rest"] < limit * limit, F.array(acc["rest"])).otherwise(F.raise_error(F.lit("a factor is beyond the limit")))
        return F.when(acc["rest"] > 1, F.concat(acc["out"], last)).otherwise(acc["out"])

    return F.when(whole > 0, F.aggregate(F.filter(primes, lambda p: whole % p == 0), start, divide_out, finish))


def swap_bits(x: Column, i: int, j: int) -> Column:
    """x with two of its bits exchanged."""
    differ = F.shiftright(x, i).bitwiseXOR(F.shiftright(x, j)).bitwiseAND(F.lit(1).cast("bigint"))
    return x.bitwiseXOR(F.shiftleft(differ, i).bitwiseOR(F.shiftleft(differ, j)))


# Complex numbers as struct<re, im>.


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


def c_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def c_subtract(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def c_multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_norm(z: Column) -> Column:
    """The squared absolute value."""
    return z["re"] * z["re"] + z["im"] * z["im"]


def c_divide(a: Column, b: Column) -> Column:
    p, n = c_multiply(a, conj(b)), c_norm(b)
    return complex_(divide(p["re"], n), divide(p["im"], n))


def c_abs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def c_arg(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


# Vectors of a few components, as lists of Columns.


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [x * y for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def triangle_area(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """The area of a triangle in two or three dimensions."""
    u, v = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
    if len(u) == 2:
        return F.abs(u[0] * v[1] - u[1] * v[0]) / 2
    return norm(cross(u, v)) / 2


def lexicographic_less(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """a before b at the first component that differs."""
    return F.struct(*(x.alias(f"c{i}") for i, x in enumerate(a))) < F.struct(*(x.alias(f"c{i}") for i, x in enumerate(b)))


# Strings.


def split(text: Column, separator: str, skip_empty: bool = False) -> Column:
    parts = F.split(text, "".join("\\" + c if not c.isalnum() else c for c in separator), -1)
    return F.filter(parts, lambda p: p != "") if skip_empty else parts


STRING: dict[str, Callable[..., Column]] = {
    "replace": lambda s, old, new: F.replace(s, F.lit(old), F.lit(new)),
    "strip": F.trim,
    "split": split,
    "starts_with": lambda s, p: F.startswith(s, F.lit(p)),
    "ends_with": lambda s, p: F.endswith(s, F.lit(p)),
    "concat": F.concat,
    "length": F.length,
    "to_string": lambda x: x.cast("string"),
}
