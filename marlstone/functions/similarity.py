"""Similarity of two programs: n-grams, keyword-weighted n-grams, syntax subtrees and data flow, a quarter each.

A program's profile is made once, by an Arrow UDF: every part is a multiset, kept as an array of
hashes of (item, how many times it has been met before), so that the number of common items of two programs,
repeats counted, is the size of an array intersection. Pairs are compared by built-in functions alone.

Python has all four parts. C++, Java and JavaScript have subtrees of their brackets, no data
flow; other text has n-grams only. A part that the reference lacks counts as full, as nothing of it can be missed.
"""

from __future__ import annotations

import ast
import hashlib
import keyword
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.braces import WRAPPERS, Source

# N-grams of up to four tokens, the weight of what is no keyword, what stands for a precision of nothing, and reserved words.
LONGEST, PLAIN, LEAST = 4, 0.2, 0.1
KEYWORDS = {
    "python": frozenset(keyword.kwlist),
    "cpp": frozenset("alignas alignof and and_eq asm auto bitand bitor bool break case catch char class compl concept const const_cast consteval constexpr constinit continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq".split()),
    "java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()),
    "javascript": frozenset("await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield".split()),
}
PROFILE = "keywords array<long>, others array<long>, g2 array<long>, g3 array<long>, g4 array<long>, trees array<long>, flows array<long>"


def numbered(items: Iterable[str]) -> list[int]:
    """A hash for each item and the number of equal ones before it."""
    met: dict[str, int] = {}
    out = []
    for x in items:
        met[x] = n = met.get(x, -1) + 1
        out.append(_number(n, x))
    return out


@lru_cache(maxsize=1 << 16)
def _number(n: int, item: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{n}|{item}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def subtrees(code: str, language: str) -> list[str]:
    """The shapes of all nodes that have children; none if the program does not parse."""
    if language == "python":
        return _python_subtrees(tree) if (tree := _parsed(code)) else []
    return _bracket_subtrees(code, language) if language in WRAPPERS else []


@lru_cache(maxsize=1)
def _parsed(code: str) -> ast.Module | None:
    """A program's tree, for all parts that read it; null if it does not parse."""
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@lru_cache(maxsize=1 << 16)
def _hashed(shape: str) -> str:
    """A shape, its inner shapes hashed, so that its length is that of its children."""
    return hashlib.md5(shape.encode()).hexdigest()


def _python_subtrees(tree: ast.AST) -> list[str]:
    out: list[str] = []
    order, shape, below = [tree], {}, []
    for node in order:
        below.append(own := [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)])
        order += own
    for node, own in zip(reversed(order), reversed(below)):
        inner = [shape[id(c)] for c in own]
        shape[id(node)] = _hashed(f"{type(node).__name__}({','.join(inner)})")
        if inner:
            out.append(shape[id(node)])
    return out


def _bracket_subtrees(code: str, language: str) -> list[str]:
    s, out, open_ = Source(code, language), [], [[]]
    if s.faults:
        return []
    for t in s.solid:
        if t.kind == "open":
            open_.append([code[t.start]])
        elif t.kind == "close":
            out.append(_hashed("".join(open_.pop())))
            open_[-1].append(f"<{out[-1]}>")
        else:
            open_[-1].append(code[t.start : t.end] if t.kind == "mark" else t.kind)
    return [*out, _hashed("".join(open_[0]))] if open_[0] else out


class _Flows(ast.NodeVisitor):
    """Where values come from: (variable, relation, variables), in the order of the program."""

    def __init__(self) -> None:
        self.edges: list[tuple[str, str, tuple[str, ...]]] = []
        self.known: set[str] = set()

    def _names(self, node: ast.AST | None) -> list[str]:
        return [] if node is None else list(dict.fromkeys(n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)))

    def _used(self, node: ast.AST | None) -> None:
        for name in self._names(node):
            self.edges.append((name, "comesFrom", (name,) if name in self.known else ()))

    def _set(self, targets: list[ast.AST], value: ast.AST | None, also: tuple[str, ...] = ()) -> None:
        self._used(value)
        sources = tuple(dict.fromkeys([*also, *self._names(value)]))
        for target in targets:
            for n in ast.walk(target):
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    self.edges.append((n.id, "computedFrom", sources))
                    self.known.add(n.id)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._set(node.targets, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._set([node.target], node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._set([node.target], node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._set([node.target], node.value, (node.target.id,) if isinstance(node.target, ast.Name) else ())

    def visit_For(self, node: ast.For | ast.AsyncFor) -> None:
        self._set([node.target], node.iter)
        for x in [*node.body, *node.orelse]:
            self.visit(x)

    visit_AsyncFor = visit_For

    def visit_withitem(self, node: ast.withitem) -> None:
        self._set([node.optional_vars] if node.optional_vars else [], node.context_expr)

    def visit_arg(self, node: ast.arg) -> None:
        self.known.add(node.arg)

    def visit_Name(self, node: ast.Name) -> None:
        self._used(node)


def flows(code: str, language: str) -> list[str]:
    """Edges of the data flow, variables named by the order in which they are met; Python only."""
    if language != "python":
        return []
    found, tree = _Flows(), _parsed(code)
    try:
        found.visit(tree) if tree else None
    except RecursionError:
        return []
    name: dict[str, str] = {}
    of = lambda v: name.setdefault(v, f"v{len(name)}")
    return [f"{of(v)} {relation} {','.join(map(of, sources))}" for v, relation, sources in found.edges]


def profile_of(code: str, language: str) -> dict[str, list[int]]:
    tokens = code.split()
    words = KEYWORDS.get(language, frozenset())
    grams = lambda n: numbered(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    return {
        "keywords": numbered(t for t in tokens if t in words), "others": numbered(t for t in tokens if t not in words),
        "g2": grams(2), "g3": grams(3), "g4": grams(4), "trees": numbered(subtrees(code, language)), "flows": numbered(flows(code, language)),
    }


def profile(code: Column, language: Column) -> Column:
    """A program's profile; null for null."""
    names = [f.split(" ")[0] for f in PROFILE.split(", ")]

    @F.pandas_udf(PROFILE)
    def of(codes: pd.Series, languages: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(names) if c is None else profile_of(c, g) for c, g in zip(codes, languages, strict=True)]
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    made = of.asNondeterministic()(code, language)  # one pass, however many parts are used
    return made


PARTS = ("keywords", "others", *[f"g{i}" for i in range(2, LONGEST + 1)], "trees", "flows")


def similarity(reference: Column, hypothesis: Column) -> Column:
    """How much of a reference's profile is in another's, 0 to 1; null if one is. Not symmetric."""
    size = lambda side, part: F.size(side[part]).cast("double")
    met = [F.size(F.array_intersect(reference[p], hypothesis[p])).cast("double").alias(f"c_{p}") for p in PARTS]
    counts = F.struct(*met, *[size(reference, p).alias(f"r_{p}") for p in PARTS], *[size(hypothesis, p).alias(f"h_{p}") for p in PARTS])
    same = F.lit(True)
    for p in PARTS:
        same = same & (reference[p] == hypothesis[p])
    known = reference["others"].isNotNull() & hypothesis["others"].isNotNull()
    return F.when(known, F.when(same, 1.0).otherwise(F.get(F.transform(F.array(counts), _score), 0)))  # parts are counted once


def _score(counts: Column) -> Column:
    """The score from how many items of each part are common (c), the reference's (r) and the hypothesis's (h)."""
    n = lambda side, part: counts[f"{side}_{part}"]
    grams = [p for p in PARTS if p.startswith("g")]
    tokens = lambda side: n(side, "keywords") + n(side, "others")
    short = F.when(tokens("h") >= tokens("r"), 1.0).when(tokens("h") == 0, 0.0).otherwise(F.exp(1 - tokens("r") / tokens("h")))
    share = lambda some, whole: F.when(some > 0, some).otherwise(LEAST) / F.greatest(whole, F.lit(1.0))
    mean = lambda shares: F.exp(sum((F.log(x) for x in shares), F.lit(0.0)) / LONGEST)
    heavy = lambda side: n(side, "keywords") + PLAIN * n(side, "others")
    plain = mean([share(tokens("c"), tokens("h")), *[share(n("c", g), n("h", g)) for g in grams]])
    weighted = mean([share(heavy("c"), heavy("r")), *[share(n("c", g), n("r", g)) for g in grams]])
    worded = F.when(tokens("c") > 0, short * (plain + weighted)).otherwise(0.0)
    part = lambda p: F.when(n("r", p) > 0, n("c", p) / n("r", p)).otherwise(1.0)
    return (worded + part("trees") + part("flows")) / 4
