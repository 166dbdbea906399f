"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over the trigrams that its matches must hold
(lower-cased). The index has a posting for each document and each trigram that some rule asks for;
intersected postings give a rule's candidates, and only these are searched with the expression.
Rules without mandatory trigrams search every text. Texts stay where they are read but for those that
hold the rarest trigram of a clause; of these rows alone texts meet their candidates in an exchange.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import Workspace

_parser = re._parser  # the standard library's own parse of a regular expression
_MOST = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and not overlapping, whose group has `least` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # maximal runs, so the bound can stand in the pattern
)
EXTRA = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

Clauses = frozenset[frozenset[str]]
_ANY: Clauses = frozenset({frozenset()})


def _absorbed(clauses: set[frozenset[str]]) -> Clauses:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _absorbed({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Clauses:
    """What a text must hold if it holds one of the strings."""
    return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _finite(op, arg) -> set[str] | None:
    """The lower-cased strings that a node matches, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _finite_sequence(arg[3])
    if name == "BRANCH":
        parts = [_finite_sequence(s) for s in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        one = _finite_sequence(inner)
        if one is None or high > 4:
            return None
        return {"".join(p) for n in range(low, int(high) + 1) for p in product(one, repeat=n)}
    return None


def _finite_sequence(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _finite(op, arg)
        if part is None or len(out) * len(part) > _MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(nodes) -> Clauses:
    found, run = _ANY, {""}
    for op, arg in nodes:
        part = _finite(op, arg)
        if part is not None and len(run) * len(part) <= _MOST:
            run = {a + b for a in run for b in part}
            continue
        found, run = _both(found, _of_strings(run)), part if part is not None else {""}
        if part is not None:
            continue
        name = str(op)
        if name == "SUBPATTERN":
            found = _both(found, _query(arg[3]))
        elif name == "BRANCH":
            found = _both(found, _absorbed(set().union(*(_query(s) for s in arg[1]))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            found = _both(found, _query(arg[2]))
    return _both(found, _of_strings(run))


def trigram_query(pattern: str) -> Clauses:
    """Alternatives, each a set of lower-cased trigrams that a text with a match holds; one empty set if none is mandatory."""
    return _query(_parser.parse(pattern))


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans as (start, kind, end), from the lengths of the matches and of the gaps between them."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"))
    parts = F.slice(parts, 1, F.size(whole))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + part["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        kept = F.when(part["value"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.when(F.regexp_like(text, pattern), F.aggregate(parts, state, step)["out"]).otherwise(empty)


def _clauses(rules: tuple[Rule, ...]) -> list[tuple[int, frozenset[str]]]:
    """(rule, trigrams that must stand together) of all rules that have mandatory trigrams, in one order."""
    return [(i, c) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != _ANY for c in sorted(q, key=sorted)]


def _strings(values: list[str]) -> Column:
    """A constant array of strings, as one expression."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({', '.join(quoted)})").cast("array<string>")


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index of rows (row_key, text): (gram, row_key) for every trigram that a rule asks for and the lower-cased text holds."""
    grams = sorted(set().union(*(c for _, c in _clauses(rules))))
    low = rows.select("row_key", F.lower("text").alias("low"))
    return low.select(F.explode(F.filter(_strings(grams), lambda g: F.contains(F.col("low"), g))).alias("gram"), "row_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row_key, rules): for each row of the postings (gram, row_key) that satisfy the query of a rule, the bits of these rules.

    Rows with equal keys count as one. Postings are counted by row and clause, first where they are
    read, so only counts are exchanged and a very common trigram is no hot key.
    """
    clauses = _clauses(rules)
    if not clauses:
        return index.select("row_key", F.lit(0).cast("long").alias("rules")).where("false")
    grams = sorted(set().union(*(c for _, c in clauses)))
    # The clauses that ask for a trigram: a constant list, as long as the rules make it.
    lists = ", ".join("array(" + ", ".join(str(k) for k, (_, c) in enumerate(clauses) if g in c) + ")" for g in grams)
    asks = F.element_at(F.map_from_arrays(_strings(grams), F.expr(f"array({lists})")), F.col("gram"))
    need = F.expr(f"element_at(array({', '.join(str(len(c)) for _, c in clauses)}), clause + 1)")
    rule = F.expr(f"element_at(array({', '.join(f'{1 << i}L' for i, _ in clauses)}), clause + 1)")
    met = index.select("row_key", "gram", F.explode(asks).alias("clause")).groupBy("row_key", "clause").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    return met.groupBy("row_key").agg(F.bit_or(rule).alias("rules"))


def _anchors(index: DataFrame, rules: tuple[Rule, ...]) -> list[str]:
    """The trigram with the shortest list of postings of each clause that can be met: every candidate holds one of them."""
    sizes = {r["gram"]: r["count"] for r in index.groupBy("gram").count().collect()}  # a row for each trigram of the rules at most
    found = [min((sizes.get(g, 0), g) for g in c) for _, c in _clauses(rules)]
    return sorted({g for n, g in found if n})


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer where docs has them; column names are compared without regard to case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str, spans: str) -> DataFrame:
    """docs and the column `spans`. Texts without an anchor are searched where they are read; only those of possible candidates are exchanged."""
    key, bits = _unused(docs, spans, "row_key", "rule_bits")[1:]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Rows that share a key share their candidates, and more candidates than needed do no harm. doc_id keeps copies of a text apart.
    own = [F.col("doc_id")] if "doc_id" in docs.columns else []
    work = Workspace(docs.sparkSession, "secrets")
    index = work.write(postings(docs.select(F.xxhash64(body, *own).alias("row_key"), body.alias("text")), rules))
    found = work.write(candidates(index, rules)).select(F.col("row_key").alias(key), F.col("rules").alias(bits))
    anchors = _anchors(index, rules)
    work.drop(index)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # Lower-cased once: the function binds it to a name.
    possible = F.exists(F.array(F.lower(body)), lambda low: F.exists(_strings(anchors), lambda g: F.contains(low, g)))
    full = [i for i, r in enumerate(rules) if trigram_query(r.pattern) == _ANY]
    everywhere = docs.where(~possible).withColumn(spans, F.sort_array(F.concat(none, *(_spans(body, rules[i], i) for i in full))))
    joined = docs.where(possible).withColumn(key, F.xxhash64(body, *own)).join(found, key, "left").withColumn(bits, F.coalesce(F.col(bits), F.lit(0).cast("long")))
    each = [_spans(body, r, i) if i in full else F.when(F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0, _spans(body, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return everywhere.unionByName(joined.withColumn(spans, F.sort_array(F.concat(none, *each))).select(*(f"`{c}`" for c in docs.columns), spans))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with secret_spans: (start, kind, end) of every secret, kind an index into rules, sorted by start and kind.

    Places are in code points, the end exclusive; spans of different kinds may overlap. A null text
    counts as empty. All rows and columns stay as they are, also rows that repeat; a column
    `secret_spans` must not be there (ValueError). An empty table gives an empty result. A text of
    any length is searched whole.
    """
    if _unused(docs, "secret_spans") != ["secret_spans"]:
        raise ValueError("a column secret_spans is there already")
    return _scanned(docs, rules, text, "secret_spans")


def rendered(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans) and spans (all)."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every secret of the text replaced by mark; overlapping secrets give one mark.

    All rows and columns stay, whatever their names, and rows that repeat come back as often. Null
    texts stay null, empty ones empty; an empty table gives an empty result.
    """
    (spans,) = _unused(docs, "secret_spans")
    found = _scanned(docs, RULES, text, spans)
    body = F.col(text).cast("string")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        more = F.concat(acc["out"], F.substring(body, acc["at"] + 1, span["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    def done(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, state, step, done)).otherwise(body)
    return found.withColumn(text, clean).select(*(f"`{c}`" for c in docs.columns))


def oracle_sql() -> str:
    """The result of summary() in DuckDB SQL, from full searches of every text."""
    quoted = lambda s: s.replace("'", "''")
    steps, parts = [], []
    for i, r in enumerate(RULES):
        steps.append(f"regexp_extract_all(t, '{quoted(r.pattern)}', 0) AS w{i}, regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS v{i}, string_split_regex(t, '{quoted(r.pattern)}') AS g{i}")
        start = f"(list_sum(list_transform(g{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w{i}[1:k - 1], lambda x: length(x))), 0))::BIGINT"
        parts.append(f"list_transform(list_filter(range(1, len(w{i}) + 1), lambda k: length(v{i}[k]) >= {r.least}), lambda k: {{'s': {start}, 'k': {i}, 'e': {start} + length(w{i}[k])}})")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda spans: f"coalesce(array_to_string(list_transform({spans}, lambda x: concat({kinds}[x.k + 1], ':', x.s, ':', x.e)), ','), '')"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.k = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(steps)} FROM d),
s AS (SELECT doc_id, list_sort(flatten([{', '.join(parts)}])) AS spans FROM m)
SELECT doc_id, {counts}, sha256({text(f'list_filter(spans, lambda x: x.k < {len(BASE)})')}) AS base_sha256, {text('spans')} AS spans FROM s"""
