"""Secret scans: all rules compiled into one automaton, one pass over the bytes of a text.

A rule is a regular expression that ends in a repeated class or a fixed string, so that
all matches of a rule that touch end at the same byte: where the automaton stops accepting
the rule. From there the rule's reversed automaton is read back, no further than the end of
the rule's last match, and the furthest place where it accepts is the leftmost start. Text
is read once whatever the number of rules, and reading back stays within the matches.

Defined results: a null text counts as empty; an empty text has no spans; offsets are in
code points; repeated rows and null ids give a row each; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.automata import Automaton, backwards, combined
from marlstone.session import read_table


class Rule(NamedTuple):
    """``least``: characters of group ``group`` that a match must have to be kept."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The base rules. A run of four or more in the pattern spares the scan the many
# short runs of prose, which ``least`` drops anyway; nothing can begin in a run's middle.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{4,}", 16),
]
# The added rules.
ADDED = [
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+", 60),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = [*BASE, *ADDED]
SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"


class Backward(NamedTuple):
    """A rule's reversed automaton; from a ``dead`` state nothing is accepted any more."""

    classes: bytes
    step: list[list[int]]
    accepts: list[int]
    dead: list[bool]


class Compiled(NamedTuple):
    """The rules' transition arrays, as they are sent to the workers."""

    rules: tuple[Rule, ...]
    forward: Automaton
    back: list[Backward]


class Scanner(NamedTuple):
    """``rows``: a list per state, by column the next state's list, and last its accepted rules."""

    rules: tuple[Rule, ...]
    classes: bytes
    rows: list[list]
    back: list[Backward]
    checks: list[re.Pattern]


def _backward(pattern: str) -> Backward:
    found = backwards(pattern)
    step = found.step.tolist()
    dead = [not found.accepts[i] and all(to == i for to in row) for i, row in enumerate(step)]
    return Backward(found.classes, step, found.accepts, dead)


@lru_cache(4)
def compiled(rules: tuple[Rule, ...] = tuple(RULES)) -> Compiled:
    """Done once, on the driver."""
    return Compiled(rules, combined([r.pattern for r in rules]), [_backward(r.pattern) for r in rules])


def scanner(c: Compiled) -> Scanner:
    """The form that is fastest to walk in a worker."""
    rows: list[list] = [[] for _ in c.forward.accepts]
    for row, to, mask in zip(rows, c.forward.step.tolist(), c.forward.accepts, strict=True):
        row += [rows[x] for x in to] + [mask]
    return Scanner(c.rules, c.forward.classes, rows, c.back, [re.compile(r.pattern.encode()) for r in c.rules])


def _begin(back: Backward, data: bytes, end: int, limit: int) -> int | None:
    """The furthest place from ``end`` back to ``limit`` where a match can begin."""
    state, found = 0, None
    for i in range(end - 1, limit - 1, -1):
        state = back.step[state][back.classes[data[i]]]
        if back.accepts[state]:
            found = i
        elif back.dead[state]:
            break
    return found


def spans(s: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, leftmost and non-overlapping for each rule, by start."""
    rules = s.rules
    ends: list[tuple[int, int]] = []
    row, before = s.rows[0], 0
    for i, c in enumerate(data.translate(s.classes)):
        row = row[c]
        if row[-1] != before:
            over = before & ~row[-1]
            if over:
                ends += [(i, r) for r in range(len(rules)) if over >> r & 1]
            before = row[-1]
    ends += [(len(data), r) for r in range(len(rules)) if before >> r & 1]
    last, found = [0] * len(rules), []
    for end, r in ends:
        start = _begin(s.back[r], data, end, last[r])
        if start is not None:
            last[r] = end
            if rules[r].least <= _length(s.checks[r], data[start:end], rules[r].group):
                found.append((start, r, end))
    return sorted(found)


def _length(check: re.Pattern, part: bytes, group: int) -> int:
    return len(check.fullmatch(part)[group]) if group else len(part)


def _in_points(data: bytes, found: list[tuple[int, int, int]]) -> dict[int, int]:
    """Code points before each byte offset that the spans name."""
    at, points, known = 0, 0, {}
    for x in sorted({y for start, _, end in found for y in (start, end)}):
        points += len(data[at:x].decode("utf-8", "surrogatepass"))
        at, known[x] = x, points
    return known


def scan(s: Scanner, text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, rank, stop, kind) in code points."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = spans(s, data)
    if not found:
        return []
    known = _in_points(data, found)
    return [(known[a], r, known[b], s.rules[r].kind) for a, r, b in found]


def secrets(text: str | Column, spark, rules: tuple[Rule, ...] = tuple(RULES)) -> Column:
    """Array of (start, rank, stop, kind) of a text column, by start, then rule as listed."""
    shared = spark.sparkContext.broadcast(compiled(rules))

    @F.pandas_udf(SPANS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, names = scanner(shared.value), ("start", "rank", "stop", "kind")
        for s in texts:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in scan(own, t)] for t in s], dtype=object)

    return of(text)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = tuple(RULES)) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask`` (spans that overlap by one)."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scanner(shared.value)
        for s in texts:
            yield pd.Series([_masked(own, t, mask) for t in s], dtype=object)

    return docs.withColumn(text, masked(text))


def _masked(s: Scanner, text: str | None, mask: str) -> str | None:
    out, at = [], 0
    for start, _, stop, _ in scan(s, text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, stop)
    return "".join([*out, text[at:]]) if out else text


def _digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets("text", spark).alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    kinds = [F.size(F.filter("found", _of_rank(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *kinds, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def _sql() -> str:
    """The same spans by DuckDB's matcher: gaps and matches alternate, so their lengths add up to the starts.

    The base rules are written out as the query's contract has them, apart from the scan's own
    (a run of 16 or more is just what stays of ``[0-9a-f]+``, and spares the list of short runs).
    """
    stated = {
        "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]{16,}",
    }

    def matched(rank: int, rule: Rule) -> str:
        rule = rule._replace(pattern=stated.get(rule.kind, rule.pattern))
        p = rule.pattern.replace("'", "''")
        keep = f"length(regexp_extract(s.value, '{p}', {rule.group})) >= {rule.least}"
        return f"""list_filter(list_transform(regexp_extract_all(body, '{p}'), lambda v, i:
            {{'start': list_sum(list_transform(string_split_regex(body, '{p}')[1:i], lambda g: length(g)))
                      + coalesce(list_sum(list_transform(regexp_extract_all(body, '{p}')[1:i-1], lambda h: length(h))), 0),
              'rank': {rank}, 'kind': '{rule.kind}', 'value': v}}), lambda s: {keep}) AS m_{rule.kind}"""

    whole = lambda xs: f"array_to_string(list_transform(list_sort({xs}), lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start::BIGINT + length(s.value))), ',')"

    def joined(kinds: list[str]) -> str:
        return f"m_{kinds[0]}" if len(kinds) == 1 else f"list_concat({joined(kinds[:-1])}, m_{kinds[-1]})"

    counts = ", ".join(f"len(m_{r.kind})::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
    SELECT doc_id, {counts}, sha256({whole(joined([r.kind for r in BASE]))}) AS base_sha256, {whole(joined([r.kind for r in RULES]))} AS spans
    FROM (SELECT doc_id, {", ".join(matched(i, r) for i, r in enumerate(RULES))} FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))"""


QUERIES = {"op7_secrets": op7_secrets}
ORACLES = {"op7_secrets": _sql()}
