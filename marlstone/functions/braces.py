"""C++, Java and JavaScript source: tokens, functions, line counts and prompts, as Arrow UDFs.

One pass cuts a program into comments, strings (raw ones, text blocks and templates too),
directives, words, numbers and marks, and pairs its brackets by a stack; what stands in a string or a
comment is never a bracket. Functions are read off the brackets: a block belongs to a function if
what is before it, back to the last boundary, is a function's head. It is no parser: a program is
taken as sound if its strings and brackets close, and heads are told by the rules below.

Nulls give nulls; an unknown language is an error of the caller, and raises.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CPP, JAVA, JAVASCRIPT = "cpp", "java", "javascript"
# What an isolated function is put in, tried in order; the longest line of a written function; starts of a documentation comment.
WRAPPERS = {CPP: (("", ""), ("struct __Wrapper__ {\n", "\n};")), JAVA: (("", ""), ("class __Wrapper__ {\n", "\n}")), JAVASCRIPT: (("", ""), ("(", ")"), ("class __Wrapper__ {\n", "\n}"))}
MAX_LINE = 200
DOXYGEN = ("/**", "/*!", "///", "//!")

CONTROL = {"if", "for", "while", "switch", "catch", "with", "synchronized", "return", "throw", "new", "sizeof", "alignof", "alignas", "decltype", "typeof", "noexcept", "static_assert", "requires", "else", "do", "case", "await", "yield", "delete", "in", "of", "void", "instanceof", "explicit", "__attribute__", "__declspec"}
SCOPES = {"class", "struct", "union", "enum", "namespace", "interface", "record", "module"}
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "sealed", "strictfp", "default", "export", "extern", "friend", "typedef", "inline", "constexpr"}
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}

_PARTS = {
    "comment": r"/\*[\s\S]*?\*/|//(?:\\\r?\n|[^\n])*",
    "raw": r'(?:u8|[uUL])?R"([^()\\\s"]{0,16})\([\s\S]*?\)\2"',
    "text": r'"""(?:\\[\s\S]|(?!""")[^\\])*"""',
    "directive": r'^[ \t]*\#(?:\\\r?\n|"(?:\\.|[^"\\\n])*"|(?!/[/*])[^\n])*',
    "string": r'"(?:\\[\s\S]|[^"\\\n])*"|\'(?:\\[\s\S]|[^\'\\\n])*\'',
    "number": r"\.?\d(?:[eEpP][+-]|'(?=\w)|[\w.])*",
    "word": r"[^\W\d][\w$]*|\$[\w$]*",
    "open": r"[({\[]",
    "close": r"[)}\]]",
    "mark": r"=>|->|::|\S",
}
_OWN = {CPP: {"raw", "directive"}, JAVA: {"text"}, JAVASCRIPT: set()}
_RULES = {
    lang: re.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '2', '(?P=fence)').replace('([^()', '(?P<fence>[^()')})" for k, p in _PARTS.items() if k not in {"raw", "text", "directive"} or k in own), re.MULTILINE)
    for lang, own in _OWN.items()
}
_LITERAL = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*+(`|\$\{)?")
_PAIR = {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    """A piece of the text; ``mate`` is the number of the bracket that belongs to it, or -1."""

    kind: str
    start: int
    end: int
    mate: int = -1


class Source:
    """A text and its tokens; ``faults`` are the places where a string or a bracket does not close."""

    def __init__(self, code: str, lang: str) -> None:
        self.code, self.lang, self.faults = code, lang, []
        self._found: list[tuple[str, int, int]] = []
        self._mates: dict[int, int] = {}
        self._cut()

    @cached_property
    def starts(self) -> list[int]:
        return [0, *[m.end() for m in re.finditer("\n", self.code)]]

    @cached_property
    def tokens(self) -> list[Token]:
        out, number, mate, new = [], 0, self._mates.get, tuple.__new__
        for kind, start, end in self._found:
            if kind == "comment":
                out.append(new(Token, (kind, start, end, -1)))
            else:
                out.append(new(Token, (kind, start, end, mate(number, -1))))
                number += 1
        return out

    @cached_property
    def solid(self) -> list[Token]:
        return [t for t in self.tokens if t.kind != "comment"]

    def _cut(self) -> None:
        code, search, found, mates, open_, at = self.code, _RULES[self.lang].search, self._found, self._mates, [], 0
        script = self.lang == JAVASCRIPT
        solid = 0  # tokens that are no comments: mates count these
        last: tuple[str, int, int] | None = None  # of those that are no comments
        while m := search(code, at):
            kind, (start, end) = m.lastgroup, m.span()
            if kind == "word" or kind == "number":
                found.append(last := (kind, start, end))
                solid += 1
                at = end
                continue
            kind = "raw" if kind == "fence" else kind
            c = code[start]
            if script and c == "/" and kind == "mark" and self._may_be_literal(last) and (m := _LITERAL.match(code, start)):
                kind, end = "string", m.end()
            if script and c == "`":
                kind, end = self._template(start, start + 1, open_, solid)
            elif kind == "close":
                if not open_ or code[open_[-1][1]] != _PAIR[c] and not (c == "}" and open_[-1][2]):
                    self.faults.append(start)
                else:
                    number, _, inside = open_.pop()
                    mates[number], mates[solid] = solid, number
                    if inside:  # back in a template
                        found.append(("close", start, end))
                        solid += 1
                        kind, end = self._template(start + 1, end, open_, solid)
                        start += 1
            elif kind == "open":
                open_.append((solid, start, False))
            elif kind == "mark" and (c in "\"'" or code.startswith("/*", start)):
                self.faults.append(start)
            if kind == "comment":
                found.append((kind, start, end))
            elif kind != "template":
                found.append(last := (kind, start, end))
                solid += 1
            else:
                found += [("string", start, end - 2), last := ("open", end - 2, end)]
                open_.append((solid + 1, end - 2, True))
                solid += 2
            at = max(end, at + 1) if end > start else end
        self.faults += [start for _, start, _ in open_]

    def _may_be_literal(self, last: tuple[str, int, int] | None) -> bool:
        if last is None or last[0] in ("open", "mark"):
            return True
        word = self.code[last[1] : last[2]]
        return word == "}" if last[0] == "close" else last[0] == "word" and word in BEFORE_REGEX

    def _template(self, start: int, at: int, open_: list, solid: int) -> tuple[str, int]:
        m = _TEMPLATE.match(self.code, at)
        if m[1] is None:
            self.faults.append(start)
        return ("template" if m[1] == "${" else "string"), m.end()

    def row(self, place: int) -> int:
        """Number of the line that holds a place, from 0."""
        return bisect_right(self.starts, place) - 1

    def rows(self, start: int = 0, end: int | None = None) -> set[int]:
        """Lines with something but comments between two places."""
        end = len(self.code) if end is None else end
        return {r for t in self.solid if start <= t.start < end and t.end > t.start for r in range(self.row(t.start), self.row(max(t.start, t.end - 1)) + 1)}

    def text(self, i: int) -> str:
        return self.code[self.solid[i].start : self.solid[i].end] if 0 <= i < len(self.solid) else ""

    def sound(self, start: int = 0, end: int | None = None) -> bool:
        return not any(start <= f < (len(self.code) if end is None else end) for f in self.faults)


class Function(NamedTuple):
    """An outermost function: where it begins (``anchor``: with its template line), its body's bracket and its end."""

    name: str | None
    anchor: int
    start: int
    body: int
    end: int


def functions(source: Source) -> list[Function]:
    """Functions that are in no other function, in order."""
    return _script_functions(source) if source.lang == JAVASCRIPT else _block_functions(source)


def _block_functions(s: Source) -> list[Function]:
    """C++ and Java: a block whose head names a function; other blocks are gone into."""
    out, i, head = [], 0, 0
    while i < len(s.solid):
        t, word = s.solid[i], s.text(i)
        if t.kind == "directive" or word in (";", "}") or word == ":" and s.text(i - 1) in ("public", "private", "protected", "default"):
            i = head = i + 1
        elif word in ("(", "[") and t.mate > i:
            i = t.mate + 1
        elif word == "{":
            named = _named(s, head, i)
            if named and t.mate > i and _is_member_value(s, named[1], i, t.mate):
                i = t.mate + 1
                continue
            if named and t.mate > i:
                begin = _behind_template(s, head)
                out.append(Function(named[0], s.solid[head].start, s.solid[begin].start, t.start, s.solid[t.mate].end))
                i = t.mate
            i = head = i + 1
        else:
            i += 1
    return out


def _named(s: Source, head: int, stop: int) -> tuple[str, int] | None:
    """(name, number of the parameters' closing bracket) of a function's head; null for another one's."""
    i = _behind_template(s, head)
    first = next((s.text(k) for k in range(i, stop) if s.solid[k].kind == "word" and s.text(k) not in MODIFIERS and s.text(k - 1) != "@"), "")
    if first in SCOPES:
        return None
    while i < stop:
        t, word = s.solid[i], s.text(i)
        if word == "=" and s.text(i - 1) != "operator" or word == "new" and s.text(i - 1) != "operator" or word in ("return", "throw", "else", "=>") or word == "->" and s.lang == JAVA:
            return None
        if word == "operator" and s.lang == CPP:
            k = i + 1
            k = k + 2 if s.text(k) == "(" and s.solid[k].mate == k + 1 else k + 1
            while k < stop and s.text(k) != "(":
                k += 1
            return ("operator" + "".join(s.text(x) for x in range(i + 1, k)), s.solid[k].mate) if k < stop and s.solid[k].mate > k else None
        if word == "(" and t.mate > i:
            name = s.text(i - 1)
            annotated = _annotated(s, i - 1)
            if i > head and s.solid[i - 1].kind == "word" and not annotated and name not in CONTROL:
                if name == first and s.lang == JAVA and _is_constant(s, name) or _assigned(s, t.mate + 1, stop):
                    return None
                return ("~" if s.text(i - 2) == "~" else "") + name, t.mate
            if not annotated and name in CONTROL - {"decltype", "alignas", "explicit", "__attribute__", "__declspec", "noexcept", "requires"}:
                return None
            i = t.mate
        i += 1
    return None


def _assigned(s: Source, i: int, stop: int) -> bool:
    """Whether an equals sign stands between two tokens, outside brackets."""
    while i < stop and s.text(i) != "=":
        i = max(s.solid[i].mate, i) + 1
    return i < stop


def _is_constant(s: Source, name: str) -> bool:
    """Whether what looks like a constructor is an enumeration's constant with a body: no type has its name."""
    types = {s.text(k + 1) for k in range(len(s.solid)) if s.text(k) in SCOPES}
    return any(s.text(k) == "enum" for k in range(len(s.solid))) and name not in types


def _annotated(s: Source, i: int) -> bool:
    """Whether the name that ends here belongs to an annotation."""
    while s.text(i - 1) == "." and i > 1:
        i -= 2
    return s.text(i - 1) == "@"


def _is_member_value(s: Source, closing: int, opening: int, mate: int) -> bool:
    """Whether a block is a member's value in a constructor's head (``: a{1}, b{2} {``)."""
    if s.lang != CPP or not any(s.text(k) == ":" for k in range(closing + 1, opening)):
        return False
    return (s.solid[opening - 1].kind == "word" or s.text(opening - 1) == ">") and s.text(mate + 1) in (",", "{")


def _behind_template(s: Source, head: int) -> int:
    """The number of the first token behind ``template <...>``."""
    while s.lang == CPP and s.text(head) == "template" and s.text(head + 1) == "<":
        depth, head = 1, head + 2
        while depth and head < len(s.solid):
            depth += {"<": 1, ">": -1}.get(s.text(head), 0)
            head += 1
    return head


def _script_functions(s: Source) -> list[Function]:
    """JavaScript: declarations, expressions, methods, and arrows with a block or an expression."""
    out, i = [], 0
    while i < len(s.solid):
        word, after, begin, name = s.text(i), -1, i, None
        if word == "function" and s.solid[i].kind == "word":
            k = i + 1 + (s.text(i + 1) == "*")
            name = s.text(k) if s.solid[k : k + 1] and s.solid[k].kind == "word" else None
            k += name is not None
            after = s.solid[k].mate + 1 if s.text(k) == "(" and s.solid[k].mate > k else -1
            if s.text(after) != "{":
                after = -1
        elif word == "(" and s.solid[i].mate > i:
            close = s.solid[i].mate
            if s.text(close + 1) == "=>":
                after = close + 2
            elif s.text(close + 1) == "{" and (s.solid[i - 1].kind in ("word", "string") and s.text(i - 1) not in CONTROL or s.text(i - 1) == "]") and i:
                after, name = close + 1, s.text(i - 1)
                begin = s.solid[i - 1].mate if s.text(i - 1) == "]" else i - 1
                while s.text(begin - 1) in ("static", "async", "get", "set", "*", "#"):
                    begin -= 1
        elif s.solid[i].kind == "word" and s.text(i + 1) == "=>":
            after = i + 2
        if after < 0 or after >= len(s.solid):
            i += 1
            continue
        if word != "(" or name is None:
            begin -= s.text(begin - 1) == "async"
            if name is None and s.text(begin - 1) == "=" and s.solid[begin - 2].kind == "word":
                name = s.text(begin - 2)
        if s.text(after) == "{":
            stop = s.solid[after].mate
            if stop < 0:
                i += 1
                continue
        else:
            stop = _expression_end(s, after)
        out.append(Function(name, s.solid[begin].start, s.solid[begin].start, s.solid[after].start, s.solid[stop].end))
        while out[-2:-1] and out[-2].end > out[-1].start:  # a method's head that began before the last one's end can't be
            out.pop()
        i = stop + 1
    return out


def _expression_end(s: Source, i: int) -> int:
    """The last token of an expression: a delimiter follows it, or a new line that can't go on with it."""
    while True:
        if s.solid[i].mate > i:
            i = s.solid[i].mate
        if i + 1 >= len(s.solid) or s.text(i + 1) in (",", ";", ")", "]", "}"):
            return i
        ends = s.solid[i].kind in ("word", "number", "string", "close") and s.text(i) not in BEFORE_REGEX
        goes_on = s.solid[i + 1].kind == "mark" or s.text(i + 1) in ("(", "[", "instanceof", "in")
        if ends and not goes_on and s.row(s.solid[i + 1].start) > s.row(s.solid[i].end - 1):
            return i
        i += 1


def function_lines(source: Source) -> int:
    """Lines of code within outermost functions; of the whole text if there are none."""
    found = functions(source)
    return len(set().union(*[source.rows(f.start, f.end) for f in found])) if found else len(source.rows())


def wrapper(code: str, lang: str) -> tuple[str, str] | None:
    """The first wrapper in which a text is sound: methods need a class, an anonymous function brackets; null if none is."""
    s = Source(code, lang)
    if s.faults or not s.solid:
        return None if s.faults else WRAPPERS[lang][0]
    if lang == JAVA:
        bare = any(s.text(k) in SCOPES | {"import", "package"} for k in range(len(s.solid)) if _top(s, k)) or not functions(s)
        return WRAPPERS[lang][0 if bare else 1]
    if lang == JAVASCRIPT:
        found = functions(s)
        if not found or s.solid[0].start < found[0].start:
            return WRAPPERS[lang][0]
        head = s.code[found[0].start : found[0].body]
        if re.match(r"(async\s+)?function\b", head):
            return WRAPPERS[lang][0 if re.match(r"(async\s+)?function\b\s*\*?\s*[\w$]", head) else 1]
        return WRAPPERS[lang][0 if "=>" in head else 2]
    return WRAPPERS[lang][1 if any(s.text(k) == ":" and s.text(k - 1) in ("public", "private", "protected") for k in range(len(s.solid)) if _top(s, k)) else 0]


def _top(s: Source, i: int) -> bool:
    """Whether a token stands in no bracket; ``depths`` are counted once."""
    if not hasattr(s, "depths"):
        depth, s.depths = 0, []
        for t in s.solid:
            depth -= t.kind == "close"
            s.depths.append(depth)
            depth += t.kind == "open"
    return s.depths[i] == 0


def _body_lines(s: Source, f: Function) -> int:
    return len(s.rows(f.body, f.end) - {s.row(f.start)})


def javadoc(text: str) -> str:
    """A documentation comment of a text."""
    return "/**\n" + "".join(f" * {line.rstrip()}".rstrip() + "\n" for line in text.strip().split("\n")) + " */\n"


def prompt_of(code: str, lang: str, documentation: str | None) -> dict:
    """Documentation and signature up to the body's brace, or why there is none."""
    around = wrapper(code, lang)
    if around is None:
        return {"reason": "parse_error"}
    s = Source(around[0] + code + around[1], lang)
    found = functions(s)
    if not found:
        return {"reason": "parse_error"}
    f, lead = found[0], len(around[0])
    if f.name is None or s.code[f.body] != "{":
        return {"reason": "no_name"}
    n = _body_lines(s, f)
    if not n:
        return {"reason": "empty_body"}
    start, head = f.start - lead, code[: f.start - lead]
    written = head.strip().startswith(("/*", "//"))
    line = code.rfind("\n", 0, start) + 1
    indent = code[line:start] if not code[line:start].strip() else ""
    doc = head.strip() + "\n" if written else javadoc(documentation or "")
    return {"prompt": doc + indent + code[start : f.body - lead].rstrip() + " {\n", "entry_point": f.name, "loc": n, "doc_kind": "source" if written else "built"}


def _comments_above(s: Source, anchor: int) -> tuple[int, int] | None:
    """Where the comments right above a place begin and end, with no blank line between."""
    before = [k for k, t in enumerate(s.tokens) if t.end <= anchor]
    row, found = s.row(anchor), []
    for k in reversed(before):
        t = s.tokens[k]
        if t.kind != "comment" or s.row(t.end - 1) < row - 1:
            break
        found.append(t)
        row = s.row(t.start)
    return (found[-1].start, found[0].end) if found else None


def documented(code: str, generated: re.Pattern) -> list[dict]:
    """Each outermost function of a C++ file with its documentation and prompt, or why it has none."""
    s, out = Source(code, CPP), []
    for f in functions(s):
        row = {"start_line": s.row(f.start), "entry_point": f.name, "human": code[f.start : f.end], "human_loc": len(s.rows(f.start, f.end)), "sound": s.sound(f.start, f.end)}
        out.append(row)
        doc = _comments_above(s, f.anchor)
        own, n = code[f.anchor : f.end], _body_lines(s, f)
        if not row["sound"]:
            row["reason"] = "parse_error"
        elif doc is None:
            row["reason"] = "no_doc"
        elif max(map(len, own.split("\n"))) > MAX_LINE or generated.search(own):
            row["reason"] = "generated_or_minified"
        elif f.name is None:
            row["reason"] = "no_name"
        elif not n:
            row["reason"] = "empty_body"
        else:
            text = code[doc[0] : doc[1]].rstrip()
            row |= {"doc": text, "code": text + "\n" + own, "prompt": text + "\n" + code[f.anchor : f.body].rstrip() + " {\n", "loc": n, "doc_kind": "doxygen" if text.lstrip().startswith(DOXYGEN) else "plain"}
    return out


def _rowwise(kind: str, one: Callable, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def of(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else one(*row) for row in zip(*parts, strict=True)], dtype=object)

    @F.pandas_udf(kind)
    def structs(*parts: pd.Series) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in kind.split(", ")]
        return pd.DataFrame([(None if row[0] is None else one(*row)) or {} for row in zip(*parts, strict=True)], columns=names).astype(object).where(lambda x: x.notna(), None)

    return structs(*columns) if ", " in kind and "<" not in kind else of(*columns)


def brace_functions(code: Column, lang: Column) -> Column:
    """Array of (name, code, start_line, loc) of a program's outermost sound functions."""

    def one(text: str, language: str) -> list[dict]:
        s = Source(text, language)
        return [{"name": f.name, "code": text[f.start : f.end], "start_line": s.row(f.start), "loc": len(s.rows(f.start, f.end))} for f in functions(s) if s.sound(f.start, f.end)]

    return _rowwise("array<struct<name: string, code: string, start_line: int, loc: int>>", one, code, lang)


def brace_lines(code: Column, lang: Column) -> Column:
    """Struct (code_lines, function_lines): lines with something but comments, and those within functions."""

    def one(text: str, language: str) -> dict:
        s = Source(text, language)
        return {"code_lines": len(s.rows()), "function_lines": function_lines(s)}

    return _rowwise("code_lines int, function_lines int", one, code, lang)


def standalone(code: Column, lang: Column) -> Column:
    """Struct (prefix, suffix): in which an isolated function is sound; nulls if in none."""
    return _rowwise("prefix string, suffix string", lambda t, g: dict(zip(("prefix", "suffix"), wrapper(t, g) or (None, None))), code, lang)


def brace_prompt(code: Column, lang: Column, documentation: Column) -> Column:
    """Struct (prompt, entry_point, loc, doc_kind, reason) of an isolated function."""
    return _rowwise("prompt string, entry_point string, loc int, doc_kind string, reason string", prompt_of, code, lang, documentation)


def cpp_functions(code: Column, generated_signs: str) -> Column:
    """Array of a C++ file's outermost functions with documentation and prompt, or the reason why there is none."""
    fields = "start_line: int, entry_point: string, human: string, human_loc: int, sound: boolean, doc: string, code: string, prompt: string, loc: int, doc_kind: string, reason: string"
    names = [f.split(":")[0] for f in fields.split(", ")]

    def one(text: str) -> list[dict]:
        return [dict.fromkeys(names) | row for row in documented(text, re.compile(generated_signs, re.IGNORECASE))]

    return _rowwise(f"array<struct<{fields}>>", one, code)
