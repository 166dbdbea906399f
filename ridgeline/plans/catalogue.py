"""The registered queries of the numerical and graph engine, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions import math as M
from ridgeline.operators import scan as S
from ridgeline.operators import sorting, vector
from ridgeline.operators.graph import Graph
from ridgeline.operators.matrix import Matrix
from ridgeline.operators.ndarray import Grid, NDArray, split_range
from ridgeline.operators.segments import Scope, Segments, from_keys
from ridgeline.plans import krylov, ode, solvers
from ridgeline.session import dealt

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same result where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """The vector of event values."""
    return table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"))


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in (names or [c for c, t in df.dtypes if t == "double"])})


# Reductions and searches over the vector of event values.


def _reduction(name: str, spark_value: Callable, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return spark_value(spark, d)

    f.__name__ = name
    query(sql)(f)


_reduction("reduce_sum", lambda s, d: rounded(vector.reduce(events(s, d), "plus"), 2), "SELECT round(sum(value), 2) AS value FROM events")
_reduction("reduce_min", lambda s, d: vector.reduce(events(s, d), "min"), "SELECT min(value) AS value FROM events")
_reduction("reduce_max", lambda s, d: vector.reduce(events(s, d), "max"), "SELECT max(value) AS value FROM events")
_reduction("reduce_product", lambda s, d: rounded(vector.reduce(events(s, d), "multiplies", lambda i, v: 1 + v / 1e7), 8), "SELECT round(product(1 + value / 1e7), 8) AS value FROM events")
for _bit in ("and", "or", "xor"):
    _reduction(f"reduce_bit_{_bit}", lambda s, d, b=_bit: table(s, d, "orders").agg(functors.of(f"bit_{b}").reduce(F.col("o_orderkey") + 1024, "bigint").alias("value")), f"SELECT bit_{_bit}(o_orderkey + 1024)::BIGINT AS value FROM orders")
_reduction("reduce_all", lambda s, d: vector.reduce(events(s, d), "logical_and", lambda i, v: v >= 0), "SELECT bool_and(value >= 0) AS value FROM events")
_reduction("reduce_any", lambda s, d: vector.reduce(events(s, d), "logical_or", lambda i, v: v > 1e9), "SELECT bool_or(value > 1e9) AS value FROM events")
_reduction("reduce_range", lambda s, d: rounded(vector.reduce(events(s, d), "plus", between=(100, 900)), 2), "SELECT round(sum(value), 2) AS value FROM events WHERE event_id >= 100 AND event_id < 900")
_reduction("reduce_empty_range", lambda s, d: vector.reduce(events(s, d), "plus", between=(100, 100)), "SELECT 0.0::DOUBLE AS value")
_reduction("argmin", lambda s, d: vector.reduce_with_argument(events(s, d), "min"), "SELECT value, event_id AS index FROM events ORDER BY value, event_id LIMIT 1")
_reduction("argmax", lambda s, d: vector.reduce_with_argument(events(s, d), "max"), "SELECT value, event_id AS index FROM events ORDER BY value DESC, event_id LIMIT 1")
_reduction("argany", lambda s, d: vector.reduce_with_argument(events(s, d), "any", lambda i, v: v > 20), "SELECT coalesce(bool_or(value > 20), false) AS value, min(event_id) FILTER (value > 20) AS index FROM events")
_reduction("vector_norms", lambda s, d: rounded(vector.norms(events(s, d))), "SELECT round(max(abs(value)), 4) AS max_norm, round(sum(abs(value)), 4) AS l1_norm, round(sqrt(sum(value * value)), 4) AS l2_norm FROM events")
_reduction("vector_l3_norm", lambda s, d: rounded(events(s, d).agg(vector.lp_norm(F.col("v"), 3).alias("value"))), "SELECT round(pow(sum(pow(abs(value), 3)), 1.0 / 3), 4) AS value FROM events")
_reduction("find_first", lambda s, d: vector.find(events(s, d), 12.31), "SELECT count(*) > 0 AS found, min(event_id) AS index FROM events WHERE value = 12.31")
_reduction("contains_value", lambda s, d: vector.contains(events(s, d), -1.0), "SELECT coalesce(bool_or(value = -1), false) AS value FROM events")
_reduction("contains_only_value", lambda s, d: vector.contains_only(events(s, d), 1.0), "SELECT coalesce(bool_and(value = 1), true) AS value FROM events")
_reduction("vector_dot", lambda s, d: rounded(vector.dot(events(s, d), table(s, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").cast("double").alias("v"))), 2), "SELECT round(sum(value * user_id), 2) AS value FROM events")


def cases(**found: DataFrame) -> DataFrame:
    """(name, value) of one-row frames."""
    rows = [df.select(F.lit(name).alias("name"), "value") for name, df in found.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _others(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Vectors like that of the event values: the same, one element more or less at 700, and without the last element."""
    v = events(spark, d)
    last = v.agg(F.max("i")).first()[0]
    change = lambda by: vector.for_elements(v, lambda i, x: x + by, (700, 701))
    return {"same": vector.evaluate(lambda x: x * 1.0, v), "more": change(1), "less": change(-1), "shorter": v.where(F.col("i") < last)}


@query("SELECT unnest(['same', 'more', 'less', 'shorter']) AS name, unnest([true, false, false, false]) AS value")
def vector_equal(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d)
    return cases(**{k: vector.equal(v, x) for k, x in _others(spark, d).items()})


@query("SELECT unnest(['same', 'more', 'less', 'shorter']) AS name, unnest([0, -1, 1, 1])::INTEGER AS value")
def vector_compare(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d)
    return cases(**{k: vector.compare(v, x).select(F.col("value").cast("int").alias("value")) for k, x in _others(spark, d).items()})


@query("SELECT true AS found, (SELECT count(*) FROM events WHERE value <= 20)::BIGINT AS index")
def upper_bound(spark: SparkSession, d: str) -> DataFrame:
    """Where the first value above 20 stands among the sorted values."""
    return vector.upper_bound(sorting.sort(events(spark, d)), 20.0)


# Element-wise expressions.


@query("SELECT event_id AS i, 2.5 * value + user_id AS v FROM events")
def axpy(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").cast("double").alias("v"))
    return vector.evaluate(lambda a, b: 2.5 * a + b, events(spark, d), y)


@query("SELECT event_id AS i, round(3 * value - 0.5 * user_id, 6) AS v FROM events")
def linear_combination(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select(F.col("event_id").alias("i"), F.round(M.linear_combination([3, 0, -0.5], [F.col("value"), F.col("value"), F.col("user_id")]), 6).alias("v"))


_UNARY_SQL = {
    "abs": "abs(value)", "sign": "sign(value)::DOUBLE", "exp": "exp(value / 1e3)", "sqr": "value * value", "sqrt": "sqrt(value)", "cbrt": "cbrt(value)", "log": "ln(value + 1)", "log10": "log10(value + 1)", "log2": "log2(value + 1)",
    "asin": "asin(value / 1e6)", "acos": "acos(value / 1e6)", "atanh": "atanh(value / 1e6)", "sin": "sin(value)", "cos": "cos(value)", "tan": "tan(value / 1e3)", "atan": "atan(value)", "sinh": "sinh(value / 1e3)", "cosh": "cosh(value / 1e3)", "tanh": "tanh(value)", "asinh": "asinh(value)", "acosh": "acosh(value + 1)", "floor": "floor(value)", "ceil": "ceil(value)",
}
_SHIFTED = {**dict.fromkeys(("asin", "acos", "atanh"), lambda v: v / 1e6), "exp": lambda v: v / 1e3, "tan": lambda v: v / 1e3, "sinh": lambda v: v / 1e3, "cosh": lambda v: v / 1e3, "log": lambda v: v + 1, "log10": lambda v: v + 1, "log2": lambda v: v + 1, "acosh": lambda v: v + 1}


@query("SELECT event_id AS i, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _UNARY_SQL.items()) + " FROM events")
def unary_math(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return events(spark, d).select("i", *(F.round(M.UNARY[n](_SHIFTED.get(n, lambda x: x)(v)), 6).alias(n) for n in _UNARY_SQL))


@query("SELECT event_id AS i, least(value, user_id::DOUBLE) AS minimum, greatest(value, user_id::DOUBLE) AS maximum, round(pow(value, 0.5), 6) AS pow, round(atan2(value, user_id + 1.0), 6) AS atan2, (event_id % 7)::BIGINT AS modulo, (event_id & user_id)::BIGINT AS bit_and, (event_id | user_id)::BIGINT AS bit_or, xor(event_id, user_id)::BIGINT AS bit_xor, value < user_id AS less FROM events")
def binary_math(spark: SparkSession, d: str) -> DataFrame:
    rows, b = table(spark, d, "events"), M.BINARY
    i, v, u = F.col("event_id"), F.col("value"), F.col("user_id")
    ud = u.cast("double")
    return rows.select(i.alias("i"), b["minimum"](v, ud).alias("minimum"), b["maximum"](v, ud).alias("maximum"), F.round(b["pow"](v, F.lit(0.5)), 6).alias("pow"), F.round(b["atan2"](v, ud + 1.0), 6).alias("atan2"), b["modulo"](i, F.lit(7)).cast("bigint").alias("modulo"), b["bit_and"](i, u).alias("bit_and"), b["bit_or"](i, u).alias("bit_or"), b["bit_xor"](i, u).alias("bit_xor"), b["less"](v, ud).alias("less"))


@query("SELECT p_partkey AS i, ((p_partkey + 6) // 7)::BIGINT AS up, (((p_partkey + 6) // 7) * 7)::BIGINT AS multiple, p_partkey > 0 AND bit_count(p_partkey) = 1 AS is_pow2, floor(log2(p_size + 1) + 1e-9)::BIGINT AS log2, CASE WHEN p_size >= 3 THEN (p_size::BIGINT * (p_size - 1) * (p_size - 2)) // 6 ELSE 0 END::BIGINT AS choose3, (p_size::BIGINT * p_size * p_size) AS cube FROM part")
def discrete_math(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table(spark, d, "part").select(k.alias("i"), M.round_up_division(k, F.lit(7)).alias("up"), M.round_to_multiple(k, F.lit(7)).alias("multiple"), M.is_pow2(k).alias("is_pow2"), M.discrete_log2(s + 1).alias("log2"), M.combinations(F.lit(3), s).alias("choose3"), M.discrete_pow(s, F.lit(3)).alias("cube"))


@query("WITH primes AS MATERIALIZED (SELECT p FROM (SELECT unnest(range(2, (SELECT max(p_partkey) + 3 FROM part))) AS p) WHERE len(list_filter(range(2, floor(sqrt(p))::BIGINT + 1), lambda q: p % q = 0)) = 0) SELECT p_partkey AS i, string_agg(p::VARCHAR, ' ' ORDER BY p) AS factors FROM part JOIN primes ON (p_partkey + 2) % p = 0 JOIN (SELECT unnest(range(1, 20)) AS e) ON (p_partkey + 2) % pow(p, e) = 0 AND pow(p, e) <= p_partkey + 2 GROUP BY 1")
def prime_factors(spark: SparkSession, d: str) -> DataFrame:
    """The prime factors of part numbers (plus 2), by as many tasks as the rows are worth: a file may be one task."""
    factors = M.prime_factors(F.col("p_partkey") + 2)
    part = table(spark, d, "part").select("p_partkey")
    return dealt(part, part.count(), "p_partkey", each=1 << 14).select(F.col("p_partkey").alias("i"), F.array_join(factors.cast("array<string>"), " ").alias("factors"))


@query("SELECT event_id AS i, round(value * user_id - (user_id + 1) * 2, 4) AS re, round(value * 2 + (user_id + 1) * user_id, 4) AS im, round(sqrt(value * value + (user_id + 1.0) * (user_id + 1.0)), 4) AS abs FROM events")
def complex_math(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("i"), M.complex_(F.col("value"), F.col("user_id") + 1).alias("a"), M.complex_(F.col("user_id"), F.lit(2)).alias("b"))
    p = M.c_multiply(F.col("a"), F.col("b"))
    return rows.select("i", F.round(p["re"], 4).alias("re"), F.round(p["im"], 4).alias("im"), F.round(M.c_abs(F.col("a")), 4).alias("abs"))


@query("SELECT p_partkey AS i, replace(p_name, 'e', 'E') AS replaced, length(p_name)::BIGINT AS length, starts_with(p_name, 's') AS starts, len(list_filter(string_split(p_name, ' '), lambda x: x <> ''))::BIGINT AS words FROM part")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), M.STRING["replace"](n, "e", "E").alias("replaced"), M.STRING["length"](n).cast("bigint").alias("length"), M.STRING["starts_with"](n, "s").alias("starts"), F.size(M.STRING["split"](n, " ", True)).cast("bigint").alias("words"))


@query("SELECT event_id AS i, CASE WHEN event_id >= 10 AND event_id < 500 THEN value * 2 ELSE value END AS v FROM events")
def for_elements(spark: SparkSession, d: str) -> DataFrame:
    return vector.for_elements(events(spark, d), lambda i, v: v * 2, (10, 500))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS slot, event_id AS i FROM events WHERE event_type = 'error'")
def compress(spark: SparkSession, d: str) -> DataFrame:
    return vector.compress(table(spark, d, "events").select(F.col("event_id").alias("i"), (F.col("event_type") == "error").alias("v")))


@query("SELECT user_id AS key, row_number() OVER (ORDER BY min(event_id)) - 1 AS index FROM events GROUP BY user_id")
def dictionary_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id")
    return vector.dictionary(rows, "key", "event_id")


@query("SELECT l_partkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey")
def scatter_add(spark: SparkSession, d: str) -> DataFrame:
    return vector.scatter_add(table(spark, d, "lineitem"), "l_partkey", "l_quantity")


def _scatter_query(operation: str, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        start = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("v"))
        rows = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("at"), F.col("l_orderkey").alias("u"))
        return vector.scatter(start, rows, "at", "u", operation)

    f.__name__ = f"scatter_{operation}"
    query(f"SELECT p_partkey AS i, (CASE WHEN u IS NULL THEN p_size ELSE {sql} END)::BIGINT AS v FROM part LEFT JOIN (SELECT l_partkey, {'sum' if operation == 'sub' else operation if operation in ('min', 'max') else 'bit_' + operation}(l_orderkey) AS u FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_partkey = p_partkey")(f)


for _name, _sql in (("sub", "p_size - u"), ("min", "least(p_size, u)"), ("max", "greatest(p_size, u)"), ("and", "p_size & u"), ("or", "p_size | u"), ("xor", "xor(p_size::BIGINT, u)")):
    _scatter_query(_name, _sql)


@query("SELECT event_id AS i, CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS v, event_type = 'error' AS done FROM events")
def compare_exchange(spark: SparkSession, d: str) -> DataFrame:
    """Values of errors are expected as they are and exchanged; for all others another value is expected."""
    rows = table(spark, d, "events")
    expected = rows.select(F.col("event_id").alias("i"), F.when(F.col("event_type") == "error", F.col("value")).otherwise(F.col("value") + 1).alias("old"), F.lit(-1.0).alias("new"))
    return vector.exchange_if(events(spark, d), expected)


@query("WITH f AS (SELECT user_id AS key, min(event_id) FILTER (event_type <> 'error') AS a, min(event_id) AS b, count(*) AS n FROM events GROUP BY 1), x AS (SELECT *, CASE WHEN a IS NOT NULL THEN row_number() OVER (ORDER BY a NULLS LAST) - 1 ELSE (SELECT count(a) FROM f) + row_number() OVER (PARTITION BY a IS NULL ORDER BY b) - 1 END AS index FROM f) SELECT key, index::BIGINT AS index, n AS count FROM x WHERE key % 3 <> 0")
def dictionary_updates(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of the users without errors first, extended by all others, with every third key erased, and how often its keys stand in the table."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    known = vector.dictionary_extended(vector.dictionary(rows.where("event_type <> 'error'"), "key", "event_id"), "key", rows, "event_id")
    left = vector.dictionary_erased(known, "key", rows.where("key % 3 = 0"))
    return left.join(vector.dictionary_counts(rows, "key", left), "key").select("key", F.col("index").cast("bigint").alias("index"), "count")


@query("SELECT CASE WHEN event_id >= 100 AND event_id < 700 THEN 99 + row_number() OVER (PARTITION BY event_id >= 100 AND event_id < 700 ORDER BY value, event_id) ELSE event_id END AS i, value AS v FROM events")
def sort_part(spark: SparkSession, d: str) -> DataFrame:
    return sorting.sort_range(events(spark, d), 100, 700)


@query("SELECT k.i, j.j, (k.i * 3 + j.j)::BIGINT AS v FROM (SELECT n_nationkey::BIGINT AS i FROM nation) k, (SELECT r_regionkey::BIGINT AS j FROM region) j")
def parallel_for(spark: SparkSession, d: str) -> DataFrame:
    """A function of every place of a nations x regions box."""
    n, r = table(spark, d, "nation").count(), table(spark, d, "region").count()
    return vector.indexes(spark, n, r).withColumn("v", F.col("i") * 3 + F.col("j"))


# Scans and sorts.


@query("SELECT event_id AS i, round(sum(value) OVER (ORDER BY event_id), 2) AS scan FROM events")
def scan_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.scan(events(spark, d)).select("i", "scan"), 2)


@query("SELECT event_id AS i, round(coalesce(sum(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS scan FROM events")
def scan_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.scan(events(spark, d), exclusive=True).select("i", "scan"), 2)


@query("SELECT event_id AS i, max(value) OVER (ORDER BY event_id) AS scan FROM events")
def scan_max(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(events(spark, d), "max", block=1000).select("i", "scan")


@query("SELECT event_id AS i, CASE WHEN event_id >= 100 AND event_id < 600 THEN round(sum(CASE WHEN event_id >= 100 AND event_id < 600 THEN value END) OVER (ORDER BY event_id), 2) ELSE value END AS scan FROM events")
def scan_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.scan(events(spark, d), between=(100, 600), keep_outside=True, block=128).select("i", "scan"), 2)


@query("SELECT event_id AS i, round(sum(value) OVER (PARTITION BY g ORDER BY event_id), 2) AS scan FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS g FROM events)")
def segmented_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"), (F.col("event_type") == "error").alias("flag"))
    return rounded(S.segmented_scan(rows, block=64).select("i", "scan"), 2)


@query("SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS i, value AS v FROM events")
def sort_ascending(spark: SparkSession, d: str) -> DataFrame:
    return sorting.sort(events(spark, d))


@query("SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS i, value AS v FROM events")
def sort_descending(spark: SparkSession, d: str) -> DataFrame:
    return sorting.sort(events(spark, d), descending=True)


@query("SELECT row_number() OVER (ORDER BY abs(o_totalprice - 250000), o_orderkey) - 1 AS i, o_totalprice AS v FROM orders")
def sort_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    return sorting.sort(rows, key=lambda v: F.abs(v - 250000))


@query("SELECT coalesce(bool_and(NOT value < before), true) AS value FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events)")
def is_sorted(spark: SparkSession, d: str) -> DataFrame:
    return sorting.is_sorted(events(spark, d))


@query("SELECT (SELECT count(*) FROM events) - 1 - event_id AS i, value AS v FROM events")
def permute(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    turned = rows.join(F.broadcast(n)).select(F.col("i").alias("old"), (F.col("n") - 1 - F.col("i")).alias("new"))  # one row of counts
    return sorting.permute(rows, turned)


# Segments: the lines of orders, and the events of users.


def order_segments(spark: SparkSession, d: str) -> Segments:
    """Lines by order; loc only tells elements apart here."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").cast("bigint").alias("loc"), F.col("l_extendedprice").alias("v"))
    return Segments.of(table(spark, d, "orders").select(F.col("o_orderkey").alias("seg")), lines)


def user_segments(spark: SparkSession, d: str) -> Segments:
    elements = from_keys(table(spark, d, "events"), "user_id", ["event_id"], "value")
    return Segments.of(elements.select("seg").distinct(), elements)


@query("SELECT o_orderkey AS seg, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0.0), 4) AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def seg_reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    """Revenue per order; orders without lines keep the identity 0."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").cast("bigint").alias("loc"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rounded(Segments(table(spark, d, "orders").select(F.col("o_orderkey").alias("seg")), lines).reduce("plus"), 4)


_LINES = "(SELECT o_orderkey AS seg, l_extendedprice AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"SELECT seg, coalesce(min(v), 'inf'::DOUBLE) AS value FROM {_LINES} GROUP BY seg")
def seg_reduce_min(spark: SparkSession, d: str) -> DataFrame:
    return order_segments(spark, d).reduce("min")


@query(f"SELECT seg, coalesce(max(v), '-inf'::DOUBLE) AS value FROM {_LINES} GROUP BY seg")
def seg_reduce_max(spark: SparkSession, d: str) -> DataFrame:
    return order_segments(spark, d).reduce("max")


@query(f"SELECT seg, round(coalesce(sum(v), 0.0), 2) AS value FROM {_LINES} WHERE seg >= 10 AND seg < 400 GROUP BY seg")
def seg_reduce_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(order_segments(spark, d).reduce("plus", scope=Scope(between=(10, 400))), 2)


@query(f"SELECT pos::BIGINT AS pos, seg, round(coalesce(sum(v), 0.0), 2) AS value FROM {_LINES} JOIN (SELECT unnest([7, 3, 7, 11]) AS id, unnest([0, 1, 2, 3]) AS pos) ON id = seg GROUP BY pos, seg")
def seg_reduce_ids(spark: SparkSession, d: str) -> DataFrame:
    return rounded(order_segments(spark, d).reduce("plus", scope=Scope(ids=[7, 3, 7, 11])), 2)


@query(f"SELECT seg, round(coalesce(sum(v), 0.0), 2) AS value FROM {_LINES} WHERE seg % 3 = 1 GROUP BY seg")
def seg_reduce_if(spark: SparkSession, d: str) -> DataFrame:
    return rounded(order_segments(spark, d).reduce("plus", scope=Scope(where=lambda seg: seg % 3 == 1)), 2)


_USERS = "(SELECT user_id AS seg, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS loc, value AS v, event_id FROM events)"


@query(f"SELECT seg, max(v) AS value, min(loc) FILTER (v = m) AS loc, false AS empty FROM (SELECT *, max(v) OVER (PARTITION BY seg) AS m FROM {_USERS}) GROUP BY seg")
def seg_argmax(spark: SparkSession, d: str) -> DataFrame:
    return user_segments(spark, d).reduce_with_argument("max")


@query(f"SELECT seg, min(v) AS value, min(loc) FILTER (v = m) AS loc, false AS empty FROM (SELECT *, min(v) OVER (PARTITION BY seg) AS m FROM {_USERS}) WHERE seg % 2 = 0 GROUP BY seg")
def seg_argmin_if(spark: SparkSession, d: str) -> DataFrame:
    return user_segments(spark, d).reduce_with_argument("min", scope=Scope(where=lambda seg: seg % 2 == 0))


@query(f"SELECT round(sum(v), 2) AS value FROM {_USERS} WHERE seg < 50")
def seg_reduce_all_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(user_segments(spark, d).reduce_all("plus", scope=Scope(between=(None, 50))), 2)


@query(f"SELECT round(sum(v), 2) AS value FROM {_USERS}")
def seg_reduce_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(user_segments(spark, d).reduce_all("plus"), 2)


@query(f"SELECT seg, loc, round(sum(v) OVER (PARTITION BY seg ORDER BY loc), 2) AS scan FROM {_USERS}")
def seg_scan_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(user_segments(spark, d).scan().select("seg", "loc", "scan"), 2)


@query(f"SELECT seg, loc, round(coalesce(sum(v) OVER (PARTITION BY seg ORDER BY loc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS scan FROM {_USERS} WHERE seg % 2 = 1")
def seg_scan_exclusive_if(spark: SparkSession, d: str) -> DataFrame:
    return rounded(user_segments(spark, d).scan(exclusive=True, scope=Scope(where=lambda s: s % 2 == 1)).select("seg", "loc", "scan"), 2)


@query(f"SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY v, loc) - 1 AS loc, v FROM {_USERS}")
def seg_sort(spark: SparkSession, d: str) -> DataFrame:
    return user_segments(spark, d).sort()


@query(f"SELECT seg, count(*) FILTER (v > 25) > 0 AS found, min(loc) FILTER (v > 25) AS loc FROM {_USERS} GROUP BY seg")
def seg_find(spark: SparkSession, d: str) -> DataFrame:
    return user_segments(spark, d).find(lambda seg, loc, v: v > 25)


@query(f"SELECT seg, loc, CASE WHEN seg < 20 THEN v + loc ELSE v END AS v FROM {_USERS}")
def seg_for_elements(spark: SparkSession, d: str) -> DataFrame:
    return user_segments(spark, d).for_elements(lambda seg, loc, v: v + loc, Scope(between=(None, 20)))


@query(f"SELECT seg, round(sum(v * (loc + 1)), 2) AS value FROM {_USERS} GROUP BY seg")
def seg_for_segments(spark: SparkSession, d: str) -> DataFrame:
    """The sum of every segment's values, each times its place from 1."""
    weighted = lambda values: F.aggregate(F.transform(values, lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(user_segments(spark, d).for_segments(weighted), 2)


@query("SELECT seg, size, coalesce(sum(size) OVER (ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM (SELECT o_orderkey AS seg, count(l_orderkey) AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")
def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return order_segments(spark, d).offsets()


@query(f"SELECT seg, loc, v, row_number() OVER (ORDER BY seg, loc) - 1 AS gid FROM {_USERS}")
def seg_global_index(spark: SparkSession, d: str) -> DataFrame:
    s = user_segments(spark, d)
    return s.with_global_index().select("seg", "loc", "v", F.col("gid").cast("bigint").alias("gid"))


# Matrices: quantity by customer and part.

_A = "(SELECT o_custkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def quantities(spark: SparkSession, d: str) -> Matrix:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("v"))
    count = lines.count()
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("row"))
    rows = dealt(orders, count, "o_orderkey").join(dealt(lines, count, "o_orderkey"), "o_orderkey")
    n, m = table(spark, d, "customer").count(), table(spark, d, "part").count()
    return Matrix.of(rows.select("row", "col", "v"), n, m, duplicates="sum", count=count)


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


def balances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))


@query(f"SELECT c_custkey AS i, round(coalesce(sum(v * p_retailprice), 0.0), 2) AS v FROM customer LEFT JOIN ({_A} a JOIN part ON c = p_partkey) ON r = c_custkey GROUP BY c_custkey")
def spmv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantities(spark, d).vector_product(prices(spark, d)), 2)


@query(f"SELECT c_custkey AS i, round(2 * coalesce(sum(v * p_retailprice), 0.0) + 0.5 * c_acctbal, 4) AS v FROM customer LEFT JOIN ({_A} a JOIN part ON c = p_partkey) ON r = c_custkey GROUP BY c_custkey, c_acctbal")
def spmv_alpha_beta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantities(spark, d).vector_product(prices(spark, d), balances(spark, d), 2.0, 0.5), 4)


@query(f"SELECT p_partkey AS i, round(coalesce(sum(v * c_acctbal), 0.0), 2) AS v FROM part LEFT JOIN ({_A} a JOIN customer ON r = c_custkey) ON c = p_partkey GROUP BY p_partkey")
def spmv_transposed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quantities(spark, d).transposed_vector_product(balances(spark, d)), 2)


@query(f'SELECT c AS "row", r AS col, 3 * v AS v FROM {_A}')
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).transpose(3.0).elements


@query(f'SELECT c_custkey AS "row", count(v) AS length FROM customer LEFT JOIN {_A} ON r = c_custkey GROUP BY c_custkey')
def row_lengths(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).row_lengths()


@query(f'SELECT c_custkey AS "row", max(v) AS value, min(c) FILTER (v = m) AS col FROM customer LEFT JOIN (SELECT *, max(v) OVER (PARTITION BY r) AS m FROM {_A}) ON r = c_custkey GROUP BY c_custkey')
def row_argmax(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).reduce_rows_with_argument("max")


@query(f'SELECT c_custkey AS "row", coalesce(sum(v), 0) AS value FROM customer LEFT JOIN {_A} ON r = c_custkey WHERE c_custkey < 100 GROUP BY c_custkey')
def row_reduce_range(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).reduce_rows("plus", scope=Scope(between=(None, 100)))


@query(f"SELECT i, coalesce(max(v), 0) AS v FROM (SELECT p_partkey AS i FROM part WHERE p_partkey < (SELECT count(*) FROM customer)) LEFT JOIN {_A} ON r = i AND c = i GROUP BY i")
def diagonal(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).diagonal()


@query(f'SELECT r AS "row", c AS col, sum(v) AS v FROM (SELECT r, c, 2 * v AS v FROM {_A} UNION ALL SELECT c, r, v FROM {_A}) GROUP BY 1, 2')
def matrix_add(spark: SparkSession, d: str) -> DataFrame:
    a = quantities(spark, d)
    return a.add(a.transpose(), 1.0, 2.0).elements


@query(f'SELECT r AS "row", c AS col, avg(v) AS v FROM (SELECT r, c, v FROM {_A} UNION ALL SELECT c, r, v FROM {_A} WHERE r <> c) GROUP BY 1, 2')
def symmetric_part(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).symmetric_part().elements


_B = "(SELECT c_nationkey::BIGINT AS r, s_nationkey::BIGINT AS c, sum(l_quantity) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def trade(spark: SparkSession, d: str) -> Matrix:
    """Quantity by the nations of customer and supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    lines = lines.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("row")), "c_custkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("col")), "l_suppkey")
    n = table(spark, d, "nation").count()
    return Matrix.of(lines.select("row", "col", F.col("l_quantity").alias("v")), n, n, duplicates="sum")


@query(f'SELECT a.r AS "row", b.c AS col, round(sum(a.v * b.v), 2) AS v FROM {_B} a JOIN {_B} b ON a.c = b.r GROUP BY 1, 2')
def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    a = trade(spark, d)
    return rounded(a.product(a).elements, 2)


@query(f"SELECT count(*)::BIGINT AS value FROM {_B} WHERE v <> 0")
def matrix_nonzeros(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).nonzeros()


@query("SELECT unnest(['turned twice', 'turned', 'one changed', 'stored zero']) AS name, unnest([true, false, false, true]) AS value")
def matrix_equals(spark: SparkSession, d: str) -> DataFrame:
    a = trade(spark, d)
    change = lambda row, col, v: spark.createDataFrame([(row, col, v)], "row bigint, col bigint, v double")
    b = a.set_elements(change(2, 3, 0.0))
    return cases(**{"turned twice": a.equals(a.transpose().transpose()), "turned": a.equals(a.transpose()), "one changed": a.equals(a.add_elements(change(3, 4, 1.0), 1.0)), "stored zero": b.equals(Matrix(b.elements.where("v != 0"), b.rows, b.cols))})


@query(f"SELECT c AS col, v FROM {_B} WHERE r = 3")
def matrix_get_row(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).get_row(3)


@query(f"SELECT name, count(v) > 0 AS found, max(v) AS value FROM (SELECT unnest(['there', 'outside']) AS name, unnest([4, 400]) AS place) LEFT JOIN {_B} ON r = 3 AND c = place GROUP BY name")
def matrix_find_element(spark: SparkSession, d: str) -> DataFrame:
    a = trade(spark, d)
    return a.find_element(3, 4).withColumn("name", F.lit("there")).unionByName(a.find_element(3, 400).withColumn("name", F.lit("outside")))


@query(f'SELECT n_nationkey::BIGINT AS "row", round(coalesce(sum(v * (c + 1)), 0), 2)::DOUBLE AS value FROM nation LEFT JOIN {_B} ON r = n_nationkey WHERE n_nationkey < 20 GROUP BY 1')
def matrix_for_rows(spark: SparkSession, d: str) -> DataFrame:
    """The sum of each row's elements, each times its column from 1."""
    weighted = lambda row, e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x["v"] * (x["col"] + 1))
    return rounded(trade(spark, d).for_rows(weighted, Scope(between=(None, 20))), 2)


@query(f'SELECT r AS "row", row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS loc, c AS col, v FROM {_B}')
def matrix_sorted_columns(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).sorted_columns()


@query(f'SELECT DISTINCT r AS "row", c AS col FROM (SELECT r, c FROM {_B} UNION SELECT c, r FROM {_B}) WHERE r <> c')
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).adjacency()


@query(f'SELECT i AS "row", j AS col, coalesce(v, 0.0) AS v FROM (SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j FROM nation a, nation b) LEFT JOIN {_B} ON r = i AND c = j')
def matrix_dense(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).dense()


@query("SELECT a.event_id AS i, round(2 * a.value - coalesce(b.value, 0) - coalesce(c.value, 0), 4) AS v FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 1 LEFT JOIN events c ON c.event_id = a.event_id + 1")
def tridiagonal_spmv(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d)
    a = Matrix.tridiagonal(spark, x.count(), lambda r, c: F.when(r == c, 2.0).otherwise(-1.0))
    return rounded(a.vector_product(x))


@query("SELECT a.event_id AS i, round(4 * a.value - coalesce(b.value, 0) - coalesce(c.value, 0), 4) AS v FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 7 LEFT JOIN events c ON c.event_id = a.event_id + 5")
def multidiagonal_spmv(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d)
    n = x.count()
    return rounded(Matrix.banded(spark, n, n, (-7, 0, 5), lambda r, c: F.when(r == c, 4.0).otherwise(-1.0)).vector_product(x))


@query("SELECT a.event_id AS i, round(a.value + coalesce(b.value, 0) / 2, 4) AS v FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1")
def lambda_spmv(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d)
    n = x.count()
    a = Matrix.from_functions(spark, n, n, lambda r: F.least(F.lit(2), F.lit(n) - r), lambda r, k: (r + k, F.when(k == 0, 1.0).otherwise(0.5)))
    return rounded(a.vector_product(x))


@query("SELECT vec_id AS i, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def row_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norms of array rows, inside each row."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.round(F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)), 4).alias("norm"))


@query('SELECT a.k AS "row", b.k AS col, round(sum(a.v * b.v), 3) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) a JOIN (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) b USING (vec_id) GROUP BY 1, 2')
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """X'X of the embeddings: a sum of outer products with partial sums before the exchange."""
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", F.col("col").cast("bigint").alias("col"), F.col("v").cast("double").alias("v"))
    m = Matrix(x, 0, 64)
    return rounded(m.transpose().product(m).elements, 3)


# N-dimensional arrays and grids: balances by nation and segment.


@query("SELECT c_nationkey::BIGINT AS i0, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def reduction_2d(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("i0"), F.col("c_custkey").alias("i1"), F.col("c_acctbal").alias("v"))
    return rounded(NDArray(rows, (25, 0)).reduce("plus", axes=[1]), 2)


@query("SELECT c_nationkey::BIGINT AS i0, c_mktsegment AS i1, max(c_acctbal) AS value FROM customer GROUP BY 1, 2")
def reduction_3d(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("i0"), F.col("c_mktsegment").alias("i1"), F.col("c_custkey").alias("i2"), F.col("c_acctbal").alias("v"))
    return NDArray(rows, (25, 5, 0)).reduce("max", axes=[2])


@query("SELECT i0, i1, (i0 * 10 + i1 + CASE WHEN i0 >= 1 AND i0 < 24 AND i1 >= 1 AND i1 < 4 THEN 1000 ELSE 0 END)::BIGINT AS v FROM (SELECT n_nationkey::BIGINT AS i0, r_regionkey::BIGINT AS i1 FROM nation, region)")
def ndarray_interior(spark: SparkSession, d: str) -> DataFrame:
    sizes = (table(spark, d, "nation").count(), table(spark, d, "region").count())
    return NDArray.of(spark, sizes, lambda i, j: i * 10 + j).for_interior(lambda i, j, v: v + 1000).elements


@query("SELECT i0, i1, (4 * (i0 * 5 + i1) - CASE WHEN i0 > 0 THEN (i0 - 1) * 5 + i1 ELSE 0 END - CASE WHEN i0 < 24 THEN (i0 + 1) * 5 + i1 ELSE 0 END - CASE WHEN i1 > 0 THEN i0 * 5 + i1 - 1 ELSE 0 END - CASE WHEN i1 < 4 THEN i0 * 5 + i1 + 1 ELSE 0 END)::DOUBLE AS v FROM (SELECT n_nationkey::BIGINT AS i0, r_regionkey::BIGINT AS i1 FROM nation, region)")
def stencil_2d(spark: SparkSession, d: str) -> DataFrame:
    sizes = (table(spark, d, "nation").count(), table(spark, d, "region").count())
    a = NDArray.of(spark, sizes, lambda i, j: (i * 5 + j).cast("double"))
    return a.stencil({(0, 0): 4.0, (1, 0): -1.0, (-1, 0): -1.0, (0, 1): -1.0, (0, -1): -1.0}).elements


@query("SELECT (r_regionkey * 25 + n_nationkey)::BIGINT AS cell, n_nationkey IN (0, 24) OR r_regionkey IN (0, 4) AS boundary, (0.5 + n_nationkey)::DOUBLE AS x0, (1 + 2 * r_regionkey)::DOUBLE AS x1 FROM nation, region")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    sizes = (table(spark, d, "nation").count(), table(spark, d, "region").count())
    g = Grid(sizes, (0.0, 0.0), (1.0, 2.0))
    return g.cells(spark).select("cell", g.is_boundary().alias("boundary"), "x0", "x1")


@query("SELECT n_nationkey::BIGINT AS part, (n_nationkey * 400 + least(n_nationkey, 0))::BIGINT AS first, (n_nationkey * 400 + 400)::BIGINT AS stop FROM nation")
def block_partitioning(spark: SparkSession, d: str) -> DataFrame:
    begin, end = split_range(10_000, 25, F.col("part"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("part")).select("part", begin.cast("bigint").alias("first"), end.cast("bigint").alias("stop"))


# Graphs over parts: each part is tied to its half and to one that a rule picks.

_ARCS = "(SELECT src, dst, min(w) AS w FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst, p_size::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, (p_partkey * 7 + 3) % (SELECT count(*) FROM part), p_size + 0.5 FROM part) WHERE src <> dst GROUP BY 1, 2)"
_BOTH = f"(SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM {_ARCS} UNION ALL SELECT dst, src, w FROM {_ARCS}) GROUP BY 1, 2)"


def part_graph(spark: SparkSession, d: str, directed: bool) -> Graph:
    part = table(spark, d, "part")
    n = part.count()
    k = F.col("p_partkey")
    half = part.select(k.alias("src"), F.call_function("div", k, F.lit(2)).alias("dst"), F.col("p_size").cast("double").alias("w"))
    ruled = part.select(k.alias("src"), ((k * 7 + 3) % n).alias("dst"), (F.col("p_size") + 0.5).alias("w"))
    return Graph.of(half.unionByName(ruled).where("src != dst"), part.select(k.alias("v")), directed)


@query(f"SELECT p_partkey AS v, count(src) AS degree FROM part LEFT JOIN {_BOTH} ON src = p_partkey GROUP BY p_partkey")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, False).degrees()


@query(f"SELECT count(*)::BIGINT AS value FROM {_BOTH} WHERE src <= dst")
def graph_edge_count(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, False).edge_count()


@query(f"SELECT sum(w) / 2 AS value FROM {_BOTH}")
def graph_total_weight(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, False).total_weight()


@query(f"SELECT p_partkey AS v, max(w) AS value, min(dst) FILTER (w = m) AS dst FROM part LEFT JOIN (SELECT *, max(w) OVER (PARTITION BY src) AS m FROM {_BOTH}) ON src = p_partkey GROUP BY p_partkey")
def graph_heaviest_edge(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, False).reduce_vertices_with_argument("max")


@query(f"SELECT p_partkey AS v, coalesce(sum(w), 0) AS value FROM part LEFT JOIN {_ARCS} ON src = p_partkey WHERE p_partkey % 2 = 0 GROUP BY p_partkey")
def graph_reduce_if(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, True).reduce_vertices("plus", scope=Scope(where=lambda v: v % 2 == 0))


@query(f"WITH RECURSIVE arcs AS MATERIALIZED (SELECT * FROM {_BOTH}), r(v, dist) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT a.dst, r.dist + 1 FROM r JOIN arcs a ON a.src = r.v WHERE r.dist < 24) SELECT p_partkey AS v, coalesce(min(dist), -1)::BIGINT AS dist FROM part LEFT JOIN r ON r.v = p_partkey GROUP BY p_partkey")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, False).breadth_first(0)


@query(f"WITH RECURSIVE arcs AS MATERIALIZED (SELECT * FROM {_ARCS}), r(v, dist) USING KEY (v) AS (SELECT 3::BIGINT, 0::DOUBLE UNION SELECT a.dst, min(r.dist + a.w) FROM r JOIN arcs a ON a.src = r.v LEFT JOIN recurring.r k ON k.v = a.dst WHERE k.dist IS NULL OR r.dist + a.w < k.dist GROUP BY a.dst) SELECT p_partkey AS v, coalesce(dist, -1) AS dist FROM part LEFT JOIN r ON r.v = p_partkey")
def graph_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, True).shortest_paths(3)


@query("SELECT p_partkey AS v, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS component FROM part")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Chains of parts: each is tied to the next of its brand and type."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("src"), "p_brand", "p_type")
    following = F.lead("src").over(Window.partitionBy("p_brand", "p_type").orderBy("src"))
    edges = part.withColumn("dst", following).where("dst is not null").select("src", "dst")
    return Graph.of(edges, part.select(F.col("src").alias("v")), False).components()


def _hierarchies(spark: SparkSession, d: str) -> dict[str, Graph]:
    """Nations under regions: alone, under one root, and with an edge between the first two nations as well."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint") + 100, F.col("n_regionkey").cast("bigint") + 1).toDF("src", "dst")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint") + 1, F.lit(0).cast("bigint")).toDF("src", "dst")
    more = spark.createDataFrame([(100, 101)], "src bigint, dst bigint")
    edges = {"parts": n, "rooted": n.unionByName(r), "parts joined": n.unionByName(more), "cycle": n.unionByName(r).unionByName(more)}
    return {k: Graph.of(e, e.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), False) for k, e in edges.items()}


_HIERARCHIES = "(SELECT 'parts' AS name, n AS edges, n + r AS vertices, r AS trees FROM k UNION ALL SELECT 'rooted', n + r, n + r + 1, 1 FROM k UNION ALL SELECT 'parts joined', n + 1, n + r, r - 1 FROM k UNION ALL SELECT 'cycle', n + r + 1, n + r + 1, 1 FROM k)"
_COUNTS = "WITH k AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(DISTINCT n_regionkey) FROM nation) AS r)"


@query(f"{_COUNTS} SELECT name, edges = vertices - trees AND trees = 1 AS value FROM {_HIERARCHIES}")
def graph_is_tree(spark: SparkSession, d: str) -> DataFrame:
    return cases(**{k: g.is_tree() for k, g in _hierarchies(spark, d).items()})


@query(f"{_COUNTS} SELECT name, edges = vertices - trees AS value FROM {_HIERARCHIES}")
def graph_is_forest(spark: SparkSession, d: str) -> DataFrame:
    return cases(**{k: g.is_forest() for k, g in _hierarchies(spark, d).items()})


@query(f"WITH RECURSIVE arcs AS MATERIALIZED (SELECT src, dst, w, least(src, dst) AS a, greatest(src, dst) AS b FROM {_BOTH}), t(v, w, a, b) USING KEY (v) AS (SELECT 0::BIGINT, 0::DOUBLE, -1::BIGINT, -1::BIGINT UNION (SELECT e.dst, e.w, e.a, e.b FROM recurring.t JOIN arcs e ON e.src = t.v ANTI JOIN recurring.t k ON k.v = e.dst ORDER BY e.w, e.a, e.b LIMIT 1)) SELECT a, b, w FROM t WHERE a >= 0")
def graph_spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d, False).minimum_spanning_forest()


# Fixpoints: small systems over the nations.


def _system(spark: SparkSession, d: str) -> tuple[Matrix, DataFrame, DataFrame]:
    nation = table(spark, d, "nation")
    n = nation.count()
    a = Matrix.tridiagonal(spark, n, lambda r, c: F.when(r == c, 4.0).otherwise(-1.0))
    x = nation.select(F.col("n_nationkey").cast("bigint").alias("i"), (F.col("n_regionkey") + 1.0).alias("v"))
    return a, x, a.vector_product(x)


_SOLUTION = "SELECT n_nationkey::BIGINT AS i, (n_regionkey + 1)::DOUBLE AS v FROM nation"


@query(_SOLUTION)
def solve_cg(spark: SparkSession, d: str) -> DataFrame:
    a, _, b = _system(spark, d)
    return rounded(solvers.conjugate_gradients(a, b, preconditioned=True, control=solvers.Control(1e-10)).x)


@query(_SOLUTION)
def solve_bicgstab(spark: SparkSession, d: str) -> DataFrame:
    a, _, b = _system(spark, d)
    return rounded(solvers.bicgstab(a, b, solvers.Control(1e-10)).x)


@query(_SOLUTION)
def solve_gmres(spark: SparkSession, d: str) -> DataFrame:
    a, _, b = _system(spark, d)
    return rounded(solvers.gmres(a, b, restart=12, control=solvers.Control(1e-9)).x)


def _krylov_query(name: str, solver: Callable, **options: object) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        a, _, b = _system(spark, d)
        return rounded(solver(a, b, control=solvers.Control(1e-8), **options).x)

    f.__name__ = name
    query(_SOLUTION)(f)


_krylov_query("solve_gmres_modified", solvers.gmres, restart=8, orthogonalise="mgs")
_krylov_query("solve_tfqmr", krylov.tfqmr, precondition="diagonal")
_krylov_query("solve_idrs", krylov.idrs, shadows=3)
_krylov_query("solve_bicgstabl", krylov.bicgstab_l, degree=2)
_krylov_query("solve_sor_coloured", krylov.sor, omega=1.1)


@query(_SOLUTION)
def solve_elimination(spark: SparkSession, d: str) -> DataFrame:
    a, _, b = _system(spark, d)
    return rounded(solvers.gaussian_elimination(a, b), 6)


@query("WITH RECURSIVE s(k, x) AS (SELECT 0, list_transform(range(0, 25), lambda i: 0.0::DOUBLE) UNION ALL SELECT k + 1, list_transform(range(1, 26), lambda i: (i + coalesce(x[i - 1], 0) * (i > 1)::INT + coalesce(x[i + 1], 0)) / 4) FROM s WHERE k < 8) SELECT unnest(range(0, 25))::BIGINT AS i, round(unnest(x), 6) AS v FROM s WHERE k = 8")
def jacobi_steps(spark: SparkSession, d: str) -> DataFrame:
    """Eight steps for the right side 1, 2, ..., over the nations."""
    n = table(spark, d, "nation").count()
    a = Matrix.tridiagonal(spark, n, lambda r, c: F.when(r == c, 4.0).otherwise(-1.0))
    b = spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v"))
    return rounded(solvers.jacobi(a, b, control=solvers.Control(0.0, most=8)).x, 6)


@query("SELECT round(1 + sum((n_regionkey + 1) * (n_regionkey + 1)), 6)::DOUBLE AS value FROM nation")
def power_iteration(spark: SparkSession, d: str) -> DataFrame:
    """The largest eigenvalue of 1 + u u'."""
    u = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"), (F.col("n_regionkey") + 1.0).alias("v"))
    n = u.count()
    outer = Matrix(u.select(F.col("i").alias("row"), F.lit(0).cast("bigint").alias("col"), "v"), n, 1)
    unit = Matrix.banded(spark, n, n, (0,), lambda r, c: F.lit(1.0))
    a = outer.product(outer.transpose()).add(unit)
    value, _, _ = solvers.power_iteration(a, u.select("i", F.lit(1.0).alias("v")), control=solvers.Control(1e-9, most=20))
    return spark.range(1).select(F.round(F.lit(value), 6).alias("value"))


@query("SELECT c_custkey AS id, round(c_acctbal * exp(-(c_nationkey + 1) / 25.0), 3) AS u FROM customer")
def ode_decay(spark: SparkSession, d: str) -> DataFrame:
    """Each balance decays at its nation's rate for one unit of time."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(0.02).alias("tau"), F.array(F.col("c_acctbal"), (F.col("c_nationkey") + 1) / 25.0).alias("u"))

    def decay(t, u):
        import numpy as np

        return np.column_stack((-u[:, 0] * u[:, 1], 0 * t))

    return ode.solve(rows, decay, "dormandprince").select("id", F.round(F.col("u")[0], 3).alias("u"))


@query("SELECT round(avg(o_totalprice), 3) AS w0, round(regr_slope(o_totalprice, o_custkey) * stddev_pop(o_custkey), 3) AS w1 FROM orders")
def gradient_descent(spark: SparkSession, d: str) -> DataFrame:
    """A line through prices over standardised customer numbers, from gradients that are one aggregate each."""
    orders = table(spark, d, "orders").select(F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))
    mean, std = orders.agg(F.avg("x"), F.stddev_pop("x")).first()
    z = (F.col("x") - mean) / std
    gradient = solvers.gradient_of(orders, lambda w: [w[0] + w[1] * z - F.col("y"), (w[0] + w[1] * z - F.col("y")) * z])
    w, _, _ = solvers.optimise(gradient, [0.0, 0.0], rate=1.0, control=solvers.Control(1e-9, most=5))
    return spark.range(1).select(F.round(F.lit(w[0]), 3).alias("w0"), F.round(F.lit(w[1]), 3).alias("w1"))
