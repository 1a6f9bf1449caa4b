"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Everything is a DataFrame expression inside one scan: no Python worker, no shuffle. The
patterns below are written so that Java's matcher runs in linear time and constant stack
on texts of any length: repeated groups are possessive (nothing after them could need a
character back), and a run is tried from its first character only (``\\G`` lets the next
match begin where the last one ended). A text with very many spans costs in proportion: offsets
are summed by blocks of blocks, and a span's surroundings are taken out of short pieces.

Defined results: null text counts as empty; empty text has no spans; repeated rows and
repeated or null ids are scanned row by row; an empty table gives an empty result; other
columns pass through, but one named ``pii`` is replaced (the scan's own columns take free names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import free_name, read_table

# Kinds in report order, with the patterns that propose them.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED_PATTERNS = {
    "iban": r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9])++",
    "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
}
# A cheap sign without which a kind's pattern cannot match.
SIGNS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
# Words that, near a span, speak for its kind.
CONTEXT = {
    "email": r"e-?mail|contact|write|mailto",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|credit|visa|payment|account",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|bank|account|transfer",
    "ssn": r"ssn|social security",
}
KINDS = [*BASE_PATTERNS, *ADDED_PATTERNS]

_SPANS = "array<struct<start:int,stop:int,value:string>>"
BLOCK = 64  # numbers summed one after the other
PIECE = 256  # code points in a piece of text that surroundings are taken from


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def sums_before(numbers: Column, levels: int = 2) -> Column:
    """For each of an array of ints the sum of those ahead of it.

    An array that grows number by number is copied each time, so blocks are summed apart, and
    the blocks' own sums likewise: about n * BLOCK copies up to millions of numbers.
    """

    def one_by_one(own: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(own, start, step, lambda acc: acc["all"])

    def by_blocks(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, BLOCK))
        return _bound(blocks, summed)

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, sums_before(totals, levels - 1), one_by_one))

    if not levels:
        return one_by_one(numbers, F.lit(0))
    return _bound(numbers, lambda own: F.when(F.size(own) <= BLOCK, one_by_one(own, F.lit(0))).otherwise(by_blocks(own)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point offsets.

    ``split`` and ``regexp_extract_all`` walk the same sequence of matches, so the gaps'
    lengths and the matches' lengths add up to the offsets.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.filter(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("length"), h.alias("value"))),
        lambda p: p["value"].isNotNull(),
    )

    def placed(p: Column, before: Column) -> Column:
        begin = before + p["gap"]
        return F.struct(begin.alias("start"), (begin + p["length"]).alias("stop"), p["value"].alias("value"))

    return _bound(parts, lambda own: F.zip_with(own, sums_before(F.transform(own, lambda p: p["gap"] + p["length"])), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits in ``value`` pass the Luhn test."""
    d = F.split(F.reverse(_digits(value)), "")

    def weigh(x: Column, i: Column) -> Column:
        n = x.try_cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    total = F.aggregate(F.transform(d, weigh), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 test (first four characters moved to the end)."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 1000), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(12, 19) & luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


# The score before context; a checksum or a strict form is worth more.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}


def _confirming(kind: str):
    return lambda s: _confirmed(kind, s["value"])


def _around(pieces: Column, s: Column, window: int) -> Column:
    """A span with ``window`` code points on either side, out of the pieces of its text."""

    def cut(begin: Column, length: int | Column) -> Column:
        first = F.floor(begin / PIECE).cast("int")
        own = [F.coalesce(F.get(pieces, first + i), F.lit("")) for i in range(window // PIECE + 2)]
        return F.substring(F.concat(*own), begin - first * PIECE + 1, length)

    ahead = F.greatest(s["start"] - window, F.lit(0))
    return F.concat(cut(ahead, s["start"] - ahead), s["value"], cut(s["stop"], F.lit(window)))


def _scoring(kind: str, rank: int, window: int, pieces: Column):
    def scored(s: Column) -> Column:
        lift = F.when(F.lower(_around(pieces, s, window)).rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
        score = F.round(F.lit(PRIOR[kind]) + lift, 2)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value"), score.alias("score"))

    return scored


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def find_pii(docs: DataFrame, text: str = "text", window: int = 40, least: float = 0.5) -> DataFrame:
    """Add ``pii``: array of (kind, start, stop, value, score), ordered by start, then kind.

    A context word within ``window`` code points adds 0.2 to the score. Spans of the base
    kinds always stay; those of the added kinds need a score of ``least``.
    """
    body = free_name(docs, "body")
    found = {k: free_name(docs, k) for k in KINDS}
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    b, none, spans = F.col(body), F.expr(f"cast(array() as {_SPANS})"), {}
    for kind, pattern in (BASE_PATTERNS | ADDED_PATTERNS).items():
        sign = b.contains(SIGNS[kind]) if kind in SIGNS else b.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
        spans[found[kind]] = F.filter(F.when(sign, matches(b, pattern)).otherwise(none), _confirming(kind))
    out = out.withColumns(spans)
    every = [F.col(found[k]) for k in KINDS]
    cut = F.regexp_extract_all(b, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def scored(pieces: Column) -> Column:
        own = [F.transform(spans, _scoring(k, i, window, pieces)) for i, (k, spans) in enumerate(zip(KINDS, every, strict=True))]
        own = [F.filter(x, lambda s: s["score"] >= least) if k in ADDED_PATTERNS else x for k, x in zip(KINDS, own, strict=True)]
        return F.array_sort(F.concat(*own))

    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,stop:int,kind:string,value:string,score:double>>)")
    some = sum((F.size(x) for x in every), F.lit(0)) > 0
    return out.withColumn("pii", F.when(some, _bound(cut, scored)).otherwise(nothing)).drop(body, *found.values())


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_PATTERNS))
    counts = [F.size(F.filter("pii", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_PATTERNS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))


def _sql_matches(kind: str, pattern: str, keep: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all(body, '{pattern}'), lambda v, i:
        {{'start': list_sum(list_transform(string_split_regex(body, '{pattern}')[1:i], lambda g: length(g)))
                  + coalesce(list_sum(list_transform(regexp_extract_all(body, '{pattern}')[1:i-1], lambda h: length(h))), 0),
          'rank': {KINDS.index(kind)}, 'kind': '{kind}', 'value': v}}), lambda s: {keep})"""


def _op10_sql() -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '', 'g')"
    bare = "replace(s.value, ' ', '')"
    luhn_sql = f"""list_sum(list_transform(string_split(reverse({digits}), ''), lambda x, i:
        CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0"""
    mod_sql = f"""list_reduce(list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: ascii(c)::BIGINT),
        lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END, 0::BIGINT) = 1"""
    near = "lower(substr(body, greatest(s.start::INT - 39, 1), length(s.value) + 80))"
    rows = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(s.value, '.'), lambda p: p::HUGEINT)) <= 255"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sql}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9])+", f"length({bare}) BETWEEN 15 AND 34 AND {mod_sql}"),
        "ssn": (ADDED_PATTERNS["ssn"], f"regexp_matches({near}, 'ssn|social security')"),
    }
    lists = ", ".join(f"{_sql_matches(k, p, keep)} AS m_{k}" for k, (p, keep) in rows.items())
    text = lambda xs: f"array_to_string(list_transform(list_sort({xs}), lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start::BIGINT + length(s.value))), ',')"
    base = "list_concat(list_concat(m_email, m_ip), list_concat(m_card, m_phone))"
    return f"""
    SELECT doc_id, len(m_email)::BIGINT AS n_email, len(m_ip)::BIGINT AS n_ip, len(m_card)::BIGINT AS n_card,
           len(m_phone)::BIGINT AS n_phone, sha256({text(base)}) AS base_sha256,
           {text(f'list_concat({base}, list_concat(m_iban, m_ssn))')} AS spans
    FROM (SELECT doc_id, {lists} FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))"""


QUERIES = {"op10_pii": op10_pii}
ORACLES = {"op10_pii": _op10_sql()}
