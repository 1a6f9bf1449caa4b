"""Meaning-keeping rewrites of C++, Java and JavaScript, on the tokens of ``braces``.

A counted loop becomes a ``while`` only where nothing in its body could tell: no ``continue`` (it would skip the step),
no label, and no function made in the body (it could hold on to the loop's own variable). Comments go or come, and statements
without effect are put in, at places where a statement begins. What can't be read soundly is left as it is, with the reason.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.braces import JAVASCRIPT, WRAPPERS, Source, functions
from marlstone.functions.code import APPLIED, NOT_APPLICABLE, RESULT, TOOL_ERROR, UNCHANGED, fresh_name, seeded

# Words that go on with the statement before, or belong to a switch, and remarks that are put in.
GOES_ON = {"else", "catch", "finally", "while", "case", "default"}
REMARKS = ("keep in step with the caller", "see the notes above", "checked by the tests")


@lru_cache(maxsize=1)
def statement_sites(s: Source) -> list[int]:
    """Places in functions' bodies where a statement begins: behind a brace of a block or a semicolon outside brackets."""
    out, blocks = [], _blocks(s)
    for i, t in enumerate(s.solid[:-1]):
        word, following = s.text(i), s.solid[i + 1]
        if word in ("{", ";", "}") and following.kind != "directive" and s.text(i + 1) not in GOES_ON and s.text(i + 1) not in (")", ",", ";", "."):
            inside = i if word == "{" else _around(s, i)
            closes_block = word != "}" or t.mate in blocks or _heads(s, t.mate) == "switch"
            if inside in blocks and closes_block and s.text(i + 1) != "}":
                out.append(following.start)
    return out


def _heads(s: Source, brace: int) -> str:
    """The word before the bracket that stands before a brace."""
    return s.text(s.solid[brace - 1].mate - 1) if s.text(brace - 1) == ")" else ""


def _around(s: Source, i: int) -> int:
    """The number of the bracket that a token stands in, or -1."""
    k = i - 1
    while k >= 0 and not (s.solid[k].kind == "open" and s.solid[k].mate > i):
        k = s.solid[k].mate - 1 if s.solid[k].kind == "close" and 0 <= s.solid[k].mate < k else k - 1
    return k


def _blocks(s: Source) -> set[int]:
    """Numbers of the braces that open blocks of statements within functions: bodies, and what stands behind ``)``, ``else``, ``do``, ``try``, ``finally`` or a statement's end there."""
    spans = [(f.body, f.end) for f in functions(s)]
    bodies, out = {a for a, _ in spans}, set()
    for i, t in enumerate(s.solid):
        if s.text(i) != "{" or t.mate < 0 or not any(a <= t.start < b for a, b in spans):
            continue
        before = s.text(i - 1)
        headed = _heads(s, i) in ("if", "for", "while", "catch", "synchronized")
        if t.start in bodies or headed or before in ("else", "do", "try", "finally", ";") or before in ("{", "}") and (s.solid[i - 1].mate in out or i - 1 in out):
            out.add(i)
    return out


def counted_to_while(s: Source, rng: random.Random, most: float) -> tuple[str, dict]:
    """Up to ``most`` counted loops as ``while`` loops, in a block of their own."""
    found = []
    for i, t in enumerate(s.solid):
        opening = i + 1
        if t.kind != "word" or s.text(i) != "for" or s.text(opening) != "(":
            continue
        closing = s.solid[opening].mate
        if closing < 0 or s.text(closing + 1) != "{":
            continue
        ends = [k for k in _flat(s, opening + 1, closing) if s.text(k) == ";"]
        last = s.solid[closing + 1].mate
        inner = range(closing + 2, last)
        if len(ends) != 2 or last < 0 or any(s.text(k) in ("continue", "function", "=>", "->", "goto") or s.text(k) == "[" and s.text(s.solid[k].mate + 1) in ("(", "{") for k in inner) or s.text(i - 1) == ":":
            continue
        found.append((i, opening, ends, closing, last))
    chosen = [x for k, x in enumerate(found) if k in set(rng.sample(range(len(found)), min(int(most), len(found))))]
    code, n = s.code, 0
    for i, opening, (first, second), closing, last in sorted(chosen, reverse=True):
        if any(a < i < b for a, b in ((x[0], x[4]) for x in chosen if x[0] != i)):
            continue  # of nested loops the outer one is rewritten
        cut = lambda a, b: s.code[s.solid[a].end : s.solid[b].start].strip()
        init, test, step = cut(opening, first), cut(first, second), cut(second, closing)
        body = s.code[s.solid[closing + 1].end : s.solid[last].start]
        if step:
            gap = re.search(r"\n[ \t]*$", body)
            body = f"{body.rstrip()} {step};" + (gap[0] if gap else " ") if not _ends_in_remark(s, last) else f"{body.rstrip()}\n{step};" + (gap[0] if gap else "\n")
        code = code[: s.solid[i].start] + "{ " + (f"{init}; " if init else "") + f"while ({test or 'true'}) {{{body}}} }}" + code[s.solid[last].end :]
        n += 1
    return (code, {"loops": str(n)}) if n else (s.code, {})


def _flat(s: Source, i: int, stop: int) -> list[int]:
    """Tokens between two places that stand in no further bracket."""
    out = []
    while i < stop:
        out.append(i)
        i = max(s.solid[i].mate, i) + 1
    return out


def _ends_in_remark(s: Source, last: int) -> bool:
    """Whether the last piece before a token is a comment to the line's end."""
    before = [t for t in s.tokens if t.end <= s.solid[last].start]
    return bool(before) and before[-1].kind == "comment" and s.code.startswith("//", before[-1].start)


def drop_comments(s: Source, rng: random.Random, share: float) -> tuple[str, dict]:
    """A share of the comments gone, and the lines that held nothing else."""
    found = [t for t in s.tokens if t.kind == "comment"]
    gone, code = rng.sample(found, round(share * len(found))), s.code
    for t in sorted(gone, reverse=True, key=lambda t: t.start):
        line, end = code.rfind("\n", 0, t.start) + 1, code.find("\n", t.end)
        alone = not code[line : t.start].strip() and not code[t.end : end if end >= 0 else len(code)].strip()
        code = code[:line] + code[end + 1 if end >= 0 else len(code) :] if alone else code[: t.start] + " " + code[t.end :]
    return (code, {"removed": str(len(gone))}) if gone else (code, {})


def add_comments(s: Source, rng: random.Random, density: float) -> tuple[str, dict]:
    """Remarks before a share of the statements, one at least."""
    sites = statement_sites(s)
    chosen = rng.sample(sites, min(len(sites), max(1, round(density * len(sites))))) if sites else []
    return _put(s.code, chosen, lambda: f"/* {rng.choice(REMARKS)} */ "), {"inserted": str(len(chosen))} if chosen else {}


def local_edits(s: Source, rng: random.Random, k: float) -> tuple[str, dict]:
    """k declarations of names that nothing uses."""
    sites, taken = statement_sites(s), {s.text(i) for i, t in enumerate(s.solid) if t.kind == "word"}
    if not sites:
        return s.code, {}
    kind = "var" if s.lang == JAVASCRIPT else "int"
    chosen = [rng.choice(sites) for _ in range(int(k))]
    return _put(s.code, chosen, lambda: f"{kind} {fresh_name(rng, taken)} = {rng.randrange(1000)}; "), {"edits": str(len(chosen))}


def _put(code: str, sites: list[int], text) -> str:
    for at in sorted(sites, reverse=True):
        code = code[:at] + text() + code[at:]
    return code


REWRITES = {"counted_to_while": counted_to_while, "drop_comments": drop_comments, "add_comments": add_comments, "local_edits": local_edits}


def _rewritten(name: str, s: Source, key: str | None, intensity: float) -> tuple:
    if s.faults:
        return s.code, TOOL_ERROR, {"error": f"does not close at {min(s.faults)}"}
    out, detail = REWRITES[name](s, seeded(name, intensity, key), intensity)
    if Source(out, s.lang).faults:
        return s.code, TOOL_ERROR, {"error": "the rewrite does not close"}
    return out, APPLIED if out != s.code else UNCHANGED, detail


def rewritten(name: str, code: Column, language: Column, ident: Column, intensity: float) -> Column:
    """Struct (code, status, detail) of a rewrite; the random choices come from the row's identity."""

    @F.pandas_udf(RESULT)
    def of(texts: pd.Series, langs: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = zip(texts, langs, keys, strict=True)
        return pd.DataFrame([(t, NOT_APPLICABLE, {}) if t is None or g not in WRAPPERS else _rewritten(name, Source(t, g), k, intensity) for t, g, k in rows], columns=["code", "status", "detail"])

    return of(code, language, ident)


def statuses(changes: list[tuple[str, float]], code: Column, language: Column, ident: Column) -> Column:
    """The status of each of several rewrites (name, intensity), an array: all are made and checked, from one reading of the program."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series, langs: pd.Series, keys: pd.Series) -> pd.Series:
        def each(t: str | None, g: str, k: str) -> list[str]:
            if t is None or g not in WRAPPERS:
                return [NOT_APPLICABLE] * len(changes)
            s = Source(t, g)
            return [_rewritten(name, s, k, x)[1] for name, x in changes]

        return pd.Series([each(*row) for row in zip(texts, langs, keys, strict=True)], dtype=object)

    return of(code, language, ident)
