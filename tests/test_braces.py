"""Tokens, functions, lines and prompts of brace languages: hostile programs put together from parts whose answer is known, and a plain scanner."""

import random
import re

import pytest

from marlstone.functions import braces
from marlstone.functions.braces import CPP, JAVA, JAVASCRIPT, Source, functions
from marlstone.functions.text import GENERATED_SIGNS

HOSTILE = {
    CPP: ['s = "}{\\"";', "c = '{';", "// } {\n", "/* { \n } */", 'r = R"q(\n } )" {)q";', "n = 1'000;", "if (x) { y(); }", "#define Z { \\\n }}\n", "a[0] = {1, 2};", "f([](int x) { return x; });", "while (x) { }", "do { x(); } while (y);", "switch (x) { case 1: { } default: ; }", 's = u8R"({)";'],
    JAVA: ['s = "}{\\"";', "c = '{';", "// } {\n", "/* { \n } */", 's = """\n } " { \\""" """;', "if (x) { y(); }", "int[] a = {1, 2};", "try { x(); } catch (E e) { }", "synchronized (x) { }", "g(() -> { return 1; });", "for (;;) { }", "@B(x = '{') int q = 1;"],
    JAVASCRIPT: ['s = "}{\\"";', "c = '{';", "// } {\n", "/* { \n } */", "t = `} ${ g(`{${'}'}`) } {`;", "r = /[/}]{1,2}\\/}/g;", "a = b / 2 / (c);", "if (x) { y(); }", "o = {p: 1, q: {}};", "switch (x) { case 1: break; }", "for (const k of [1]) { }", "return /}/.test(s);"],
}


def plain_brackets(code, lang):
    """The brackets outside strings and comments, character by character."""
    out, i, templates, depth = [], 0, [], 0
    while i < len(code):
        c = code[i]
        if lang == CPP and c == "#" and not code[code.rfind("\n", 0, i) + 1 : i].strip():
            while i < len(code) and code[i] != "\n":
                i += 2 if code.startswith("\\\n", i) else 1
        elif code.startswith("//", i):
            i = code.find("\n", i) if "\n" in code[i:] else len(code)
        elif code.startswith("/*", i):
            i = code.index("*/", i) + 2
        elif lang == CPP and (m := re.match(r'(?:u8|[uUL])?R"([^()\s]*)\(', code[i:])) and not (i and code[i - 1].isalnum()):
            i = code.index(")" + m[1] + '"', i) + len(m[1]) + 2
        elif lang == JAVA and code.startswith('"""', i):
            i += 3
            while not code.startswith('"""', i):
                i += 2 if code[i] == "\\" else 1
            i += 3
        elif c in "\"'" and not (c == "'" and code[i - 1].isdigit()):
            i += 1
            while code[i] != c:
                i += 2 if code[i] == "\\" else 1
            i += 1
        elif lang == JAVASCRIPT and c == "/" and re.search(r"(^|[=(,:;{}]|\breturn)\s*$", code[:i]):
            i, inside = i + 1, False
            while code[i] != "/" or inside:
                inside = code[i] == "[" or inside and code[i] != "]"
                i += 2 if code[i] == "\\" else 1
            i += 1
        elif lang == JAVASCRIPT and (c == "`" or c == "}" and templates and templates[-1] == depth):
            if c == "}":
                templates.pop()
                out.append((i, c))
                depth -= 1
            i += 1
            while code[i] != "`" and not code.startswith("${", i):
                i += 2 if code[i] == "\\" else 1
            if code[i] == "`":
                i += 1
            else:
                depth += 1
                templates.append(depth)
                out.append((i, "${"))
                i += 2
        else:
            if c in "(){}[]":
                out.append((i, c))
                depth += c in "({["
                depth -= c in ")}]"
            i += 1
    return out


def body(rng, lang):
    return "\n".join(rng.choice(HOSTILE[lang]) for _ in range(rng.randint(0, 4)))


def function(rng, lang, n):
    """(text, name) of a function."""
    name, inside = f"fn{n}", body(rng, lang)
    inside = f"\n{inside}\n" if inside else " "
    heads = {
        CPP: [f"int {name}(int a, F<int(int)> b)", f"static auto {name}(A a) -> B", f"void A::{name}(int x) const noexcept(true)", f"{name}(int a) : x(a), y{{1}}"],
        JAVA: [f"public int {name}(int a) throws X, Y", f"@Override @A(x = 1) <T extends U> T {name}(T a)", f"void {name}()"],
        JAVASCRIPT: [f"function {name}(a, b = {{}})", f"async function* {name}()"],
    }
    return f"{rng.choice(heads[lang])} {{{inside}}}", name


@pytest.mark.parametrize("lang", [CPP, JAVA, JAVASCRIPT])
def test_hostile_programs(lang):
    rng = random.Random(11)
    scopes = {CPP: ["namespace a::b", "struct S : public B<int(int)>", 'extern "C"'], JAVA: ["class C extends D<E>", "interface I", "record R(int x)"], JAVASCRIPT: ["{"]}
    for _ in range(400):
        parts, expected, n = [], [], 0
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.5:
                text, name = function(rng, lang, n := n + 1)
                parts.append(text)
                expected.append((name, text))
            elif kind < 0.7:
                text, name = function(rng, lang, n := n + 1)
                scope = rng.choice(scopes[lang])
                parts.append(f"{scope}{' {' if scope != '{' else ''} {text}\n}};" if lang != JAVASCRIPT else f"{{ {text} }}")
                expected.append((name, text))
            else:
                parts.append(rng.choice(["// } (\n", "/* ) \n { */", "int x = 1;", 's = "{";', ";"]))
        code = "\n".join(parts)
        s = Source(code, lang)
        assert [(f.name, code[f.start : f.end]) for f in functions(s)] == expected, code
        assert not s.faults
        found = [(t.start, code[t.start : t.end]) for t in s.solid if t.kind in ("open", "close")]
        assert found == plain_brackets(code, lang), code
        for t in s.solid:
            if t.kind == "open":
                assert s.solid[t.mate].mate == s.solid.index(t)


@pytest.mark.parametrize("lang", [CPP, JAVA, JAVASCRIPT])
def test_faults(lang):
    for broken in ("f( { ) }", "{", "}", 's = "x', "a = 'b", "/* x", "int f() { return 1;", "(]"):
        assert Source(broken, lang).faults and braces.wrapper(broken, lang) is None
    assert not Source("", lang).faults and braces.wrapper("", lang) == ("", "")
    assert Source("`${", JAVASCRIPT).faults and Source("`x", JAVASCRIPT).faults


def test_script_forms():
    code = "const a = (x) => ({}), b = async y => y\n  .z + 1\nclass K { static async m(q) {} get p() { return 1 } ['c' + 1](z) {} #h() {} }\nlet o = { k(a) { if (a) {} }, f: function () {} };\nrun(function named() {}, x => x)\nif (b) { c() }\nwhile (q()) { }"
    found = [(f.name, code[f.start : f.end]) for f in functions(Source(code, JAVASCRIPT))]
    assert found == [("a", "(x) => ({})"), ("b", "async y => y\n  .z + 1"), ("m", "static async m(q) {}"), ("p", "get p() { return 1 }"), ("]", "['c' + 1](z) {}"), ("h", "#h() {}"), ("k", "k(a) { if (a) {} }"), (None, "function () {}"), ("named", "function named() {}"), (None, "x => x")]


def test_java_forms():
    code = 'class C { enum E { ONE(1) { int q() { return 1; } }; E(int x) { } } Runnable r = new Runnable() { public void run() { } }; static { f(); } C() { } int g = h(new int[]{1}); record P(int a) { int z() { return a; } } }'
    assert [f.name for f in functions(Source(code, JAVA))] == ["q", "E", "run", "C", "z"]


def test_cpp_forms():
    code = "template <class T, template <class> class U>\nT f(T a) { }\nbool operator==(A a, A b) { }\nA& A::operator()(int i) { }\nA::~A() { }\nauto l = [](int x) { return x; };\nclass D; struct E { E() = default; int m{1}; explicit E(int a) : m{a} { } };\nint (*p)(int) = {};\nenum class G : int { x, y };"
    found = functions(Source(code, CPP))
    assert [f.name for f in found] == ["f", "operator==", "operator()", "~A", "E"]
    assert code[found[0].anchor :].startswith("template") and code[found[0].start :].startswith("T f")


def test_lines_and_wrappers():
    code = "// a\nint f() {\n  // b\n  /* c\n  */ return 1; // d\n\n}\nint x;"
    s = Source(code, CPP)
    assert s.rows() == {1, 4, 6, 7} and braces.function_lines(s) == 3 and braces.function_lines(Source("int x;\n\n// y\nint z;", CPP)) == 2
    assert braces.wrapper("int f() { }", JAVA)[0].startswith("class") and braces.wrapper("class A { int f() { } }", JAVA) == ("", "")
    assert braces.wrapper("function (a) { }", JAVASCRIPT) == ("(", ")") and braces.wrapper("function f(a) { }", JAVASCRIPT) == ("", "") and braces.wrapper("m(a) { }", JAVASCRIPT)[0].startswith("class")
    assert braces.wrapper("public: int f() { }", CPP)[0].startswith("struct") and braces.wrapper("int f() { }", CPP) == ("", "")


def test_prompts():
    code = "/* Says it. */\n  public int f(int x)\n  {\n    return x;\n  }"
    assert braces.prompt_of(code, JAVA, None) == {"prompt": "/* Says it. */\n  public int f(int x) {\n", "entry_point": "f", "loc": 3, "doc_kind": "source"}
    assert braces.prompt_of("m(a) {\n return a }", JAVASCRIPT, " one\n\n two ")["prompt"] == "/**\n * one\n *\n *  two\n */\nm(a) {\n"
    assert [braces.prompt_of(c, g, "x")["reason"] for c, g in (("int f( {", JAVA), ("int x;", JAVA), ("function () {\n return 1 }", JAVASCRIPT), ("int f() { }", JAVA))] == ["parse_error", "parse_error", "no_name", "empty_body"]


def test_documented_cpp():
    code = "//! Adds.\n// Well.\ntemplate <class T>\nT f(T a) {\n  return a;\n}\n// far\n\nint g() {\n  return 1;\n}\n/* Long. */ int h() {\n  return " + "1 + " * 60 + "1;\n}\n// Auto-generated by x\nint k() {\n  return 1; // do not edit\n}\n// None.\nint e() { }\n"
    rows = braces.documented(code, re.compile(GENERATED_SIGNS, re.IGNORECASE))
    assert [(r["entry_point"], r.get("reason")) for r in rows] == [("f", None), ("g", "no_doc"), ("h", "generated_or_minified"), ("k", "generated_or_minified"), ("e", "empty_body")]
    assert rows[0]["prompt"] == "//! Adds.\n// Well.\ntemplate <class T>\nT f(T a) {\n" and rows[0]["loc"] == 2 and rows[0]["doc_kind"] == "doxygen" and rows[0]["start_line"] == 3


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "int f() {\n return 1;\n}", CPP), (2, None, JAVA), (3, "", JAVASCRIPT), (4, "int f( {", JAVA), (5, "é\n" * 50_000 + "function q() { }", JAVASCRIPT)]
    t = spark.createDataFrame(rows, "i int, c string, lang string")
    got = t.select("i", braces.brace_functions(F.col("c"), F.col("lang")).alias("f"), braces.brace_lines(F.col("c"), F.col("lang")).alias("n"), braces.standalone(F.col("c"), F.col("lang")).alias("w"), braces.brace_prompt(F.col("c"), F.col("lang"), F.lit("d")).alias("p")).orderBy("i").collect()
    assert [len(r.f) if r.f is not None else None for r in got] == [1, None, 0, 0, 1]
    assert [tuple(r.n) for r in got] == [(3, 3), (None, None), (0, 0), (1, 1), (50_001, 1)]
    assert [r.w.prefix for r in got] == ["", None, "", None, ""] and got[0].p.loc == 2 and got[3].p.reason == "parse_error"
