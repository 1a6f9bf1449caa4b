"""Rewrites of brace languages: what is left when comments and additions are taken out again, and loops run by a small interpreter of their own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rewrites
from marlstone.functions.braces import CPP, JAVA, JAVASCRIPT, Source
from marlstone.plans import code_queries
from tests.oracles import SMALL
from tests.test_braces import function

RNG = random.Random


def words(code, lang):
    s = Source(code, lang)
    return [s.text(i) for i in range(len(s.solid))]


def run(code, n):
    """What a program of the small language below appends, loops run as written: Python's own for each form."""
    lines, depth, out = [], 1, []
    tokens = re.findall(r"\{|\}|(?:while|for|if) \([^)]*\)|[^{};\s][^{};]*;", code)
    steps = []
    for t in tokens:
        pad = "    " * depth
        if m := re.match(r"for \((.*?);(.*?);(.*?)\)", t):
            lines += [pad + stated(m[1]), pad + f"while {m[2].strip()}:"]
            steps.append((depth, stated(m[3])))
        elif t.startswith(("while", "if")):
            lines.append(pad + t + ":")
        elif t == "{":
            if not lines or not lines[-1].endswith(":"):
                lines.append(pad + "if True:")
            depth += 1
            lines.append("    " * depth + "pass")
        elif t == "}":
            depth -= 1
            if steps and steps[-1][0] == depth:
                lines.append("    " * (depth + 1) + steps.pop()[1])
        else:
            lines.append(pad + stated(t))
    exec("def program(n, out):\n    pass\n" + "\n".join(lines), space := {})  # noqa: S102  a program made below
    space["program"](n, out)
    return out


def stated(text):
    """A statement of the small language as Python's."""
    text = text.strip().rstrip(";").strip()
    text = re.sub(r"^(int|let|var) ", "", text)
    text = re.sub(r"(\w+)\+\+", r"\1 += 1", text)
    return text.replace("log(", "out.append(") or "pass"


def loops(rng, depth=0, names="ijk"):
    parts = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        if kind < 0.5 and depth < 3:
            v = names[depth]
            parts.append(f"for (int {v} = {rng.randint(0, 3)}; {v} < n; {v}++) {{ {loops(rng, depth + 1)} }}")
        elif kind < 0.65 and depth:
            parts.append(f"if ({names[depth - 1]} == {rng.randint(0, 4)}) {{ log({rng.randint(0, 9)}); {rng.choice(['', 'break;'])} }}")
        else:
            parts.append(f"log({names[depth - 1] if depth else 7});")
    return " ".join(parts)


def test_loops_do_the_same():
    rng = RNG(5)
    changed = 0
    for _ in range(150):
        inner = loops(rng)
        code = f"void f(int n) {{ {inner} }}"
        out, detail = rewrites.counted_to_while(Source(code, JAVA), RNG(1), rng.choice([1, 9]))
        body = lambda c: c[c.index("{") + 1 : c.rindex("}")]
        for n in (0, 1, 4):
            assert run(body(out), n) == run(body(code), n), (code, out)
        changed += bool(detail)
    assert changed > 60


def test_loops_that_stay():
    stay = ["for (;;) { continue; }", "for (let i = 0; i < 3; i++) { g(() => i); }", "for (let i = 0; i < 3; i++) { g(function () { }); }", "for (const x of y) { z(); }", "for (i = 0; i < 3; i++) z();", "a: for (;;) { break; }"]
    for code in stay:
        assert rewrites.counted_to_while(Source(f"function f() {{ {code} }}", JAVASCRIPT), RNG(1), 9) == (f"function f() {{ {code} }}", {})
    assert rewrites.counted_to_while(Source("void f() { for (int x : y) { z(); } for (int i = 0; i < 2; i++) { auto g = [&](int q) { return i; }; } }", CPP), RNG(1), 9)[1] == {}
    code = "void f() {\n  for (;;) {\n    g(); // last\n  }\n  for (int i = 0, j = h(1, 2); i < j; i++, j--) {\n    g(\"; } {\"); // last\n  }\n}"
    out, detail = rewrites.counted_to_while(Source(code, CPP), RNG(1), 9)
    assert detail == {"loops": "2"} and not Source(out, CPP).faults
    assert words(out, CPP) == words('void f() { { while (true) { g(); } } { int i = 0, j = h(1, 2); while (i < j) { g("; } {"); i++, j--; } } }', CPP)


@pytest.mark.parametrize("lang", [CPP, JAVA, JAVASCRIPT])
def test_additions_come_out_again(lang):
    rng = RNG(3)
    for turn in range(150):
        code = "\n".join(function(rng, lang, n)[0] for n in range(rng.randint(1, 3)))
        s = Source(code, lang)
        with_remarks, _ = rewrites.add_comments(s, RNG(turn), 0.5)
        assert words(with_remarks, lang) == words(code, lang)
        bare, _ = rewrites.drop_comments(s, RNG(turn), 1.0)
        assert words(bare, lang) == words(code, lang) and not any(t.kind == "comment" for t in Source(bare, lang).tokens)
        edited, detail = rewrites.local_edits(s, RNG(turn), 3)
        assert not Source(edited, lang).faults
        if detail:
            assert words(re.sub(r"(int|var) v_[a-z]{6} = \d+; ", "", edited), lang) == words(code, lang)


def test_sites():
    code = "int f() { int a[] = {1, 2}; if (x) { y(); } else { z(); } for (int i = 0; i < 2; i++) { } do { q(); } while (r); switch (s) { case 1: t(); break; default: u(); } return a; }\nstruct S { int b; };"
    found = [code[at:].split("(")[0].split(" ")[0] for at in rewrites.statement_sites(Source(code, CPP))]
    assert found == ["int", "if", "y", "z", "for", "do", "q", "switch", "return"]


def test_columns(spark):
    rows = [(1, "int f() { // a\n return 1; }", CPP), (2, None, JAVA), (3, "f( {", JAVASCRIPT), (4, "x", "python"), (5, "", JAVA)]
    t = spark.createDataFrame(rows, "i int, c string, lang string")
    got = {r.i: r.x for r in t.select("i", rewrites.rewritten("drop_comments", F.col("c"), F.col("lang"), F.col("i").cast("string"), 1.0).alias("x")).collect()}
    assert [got[i].status for i in range(1, 6)] == ["APPLIED", "NOT_APPLICABLE", "TOOL_ERROR", "NOT_APPLICABLE", "UNCHANGED"] and "//" not in got[1].code


def test_all_rewrites_from_one_reading(spark):
    """The statuses are those of each rewrite alone, and the query reads a program in one function, not in one for each rewrite."""
    p = code_queries.programs(spark, SMALL).unionByName(spark.createDataFrame([(-1, "n", 1, "cobol", "x"), (-2, "n", 1, "java", None)], "p_partkey long, p_name string, p_size int, language string, code string"))
    changes = [(name, 1.0) for name in rewrites.REWRITES]
    args = (F.col("code"), F.col("language"), F.col("p_partkey").cast("string"))
    found = p.select(rewrites.statuses(changes, *args).alias("all"), F.array(*[rewrites.rewritten(name, *args, x)["status"] for name, x in changes]).alias("each")).collect()
    assert all(r["all"] == r["each"] for r in found) and len({tuple(r["all"]) for r in found}) > 2
    plan = code_queries.QUERIES["q6_brace_rewrites"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
