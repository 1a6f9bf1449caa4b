"""Text expressions, page parsing, and code rewrites that keep a program's results."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import code, html, text, workers

PROGRAM = '''
def work(a, b):
    """Adds up.

    >>> work(1, 2)
    3
    """
    total = a
    for i in range(b):
        total += i  # note
    if total > 3:
        left = total
    else:
        left = -total
    while b > 0:
        b -= 1
    return left + total


def other(x):
    y = 2 + 3
    return x if x < y else y
'''


def results(source):
    space = {}
    exec(source, space)  # noqa: S102  a program of this test's own
    return [space["work"](a, b) for a in range(-3, 4) for b in range(5)] + [space["other"](x) for x in range(9)]


@pytest.mark.parametrize("name", ["refactor", "rename", "drop_comments", "add_comments", "local_edits"])
def test_rewrites_keep_results(name):
    for i in range(8):
        out, detail = code.TRANSFORMS[name](PROGRAM, code.seeded(name, i), 3.0 if name in ("refactor", "local_edits") else 1.0)
        ast.parse(out)
        assert results(out) == results(PROGRAM)
        assert out != PROGRAM and detail
        assert (out, detail) == code.TRANSFORMS[name](PROGRAM, code.seeded(name, i), 3.0 if name in ("refactor", "local_edits") else 1.0)


def test_truncation():
    assert "left" not in code.truncate(PROGRAM, code.seeded(1), 0.3)[0]
    assert code.keep_functions(PROGRAM, code.seeded(1), 1.0)[1]["kept"] in ("work", "other")


def test_transform_statuses(spark):
    rows = [("1", "python", PROGRAM), ("2", "java", PROGRAM), ("3", "python", "def ("), ("4", "python", "x = 1\n"), ("5", "python", None), ("6", None, "x")]
    out = spark.createDataFrame(rows, "id string, lang string, code string").withColumn("t", code.transformed("rename", F.col("code"), F.col("lang"), F.col("id"), 1.0)).orderBy("id").collect()
    assert [r.t.status for r in out] == ["APPLIED", "NOT_APPLICABLE", "TOOL_ERROR", "UNCHANGED", "NOT_APPLICABLE", "NOT_APPLICABLE"]
    assert all(r.t.code == r.code for r in out[1:])


def test_code_columns(spark):
    frame = spark.createDataFrame([(PROGRAM, "def work(a, b):"), ("def (", ""), (None, None)], "c string, p string")
    rows = frame.select(code.functions_of(F.col("c")).alias("f"), code.identifiers(F.col("c")).alias("n"), code.valid_python(F.col("c")).alias("v"), code.signature_prompt(F.col("c")).alias("s"), code.prompt_examples(F.col("c")).alias("e"), code.n_free_identifiers(F.col("c"), F.col("p")).alias("k")).collect()
    assert [f.name for f in rows[0].f] == ["work", "other"] and rows[0].v and not rows[1].v and not rows[2].v
    assert rows[0].s.endswith('"""\n') and rows[0].e == ["work(1, 2)"] and rows[1].f is None
    assert set(rows[0].n) == {"work", "other", "a", "b", "total", "i", "left", "x", "y"} and rows[0].k == 6


def test_fences(spark):
    raw = ["a\n```py\nx\n```\n```python\ny\n```", "```\nplain\n```", "```js\nq\n```", "say\n```python\nopen end", "none", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").withColumn("c", text.fenced_code(F.col("r"), "python", "py")).withColumn("o", text.fence_open(F.col("r"))).orderBy("i").collect()
    assert [r.c for r in rows] == ["x\n", "plain\n", None, "open end", None, None]
    assert [r.o for r in rows] == [False, False, False, True, False, None]


def test_text_rules(spark):
    row = spark.createDataFrame([("/* keep   this\tnote */", "a  \n\n\n\nb\t\n", "3 warnings\n/tmp/x/b:12:3: failed")], "c string, l string, e string").select(
        text.clean_comment(F.col("c")).alias("c"), text.format_free(F.col("l")).alias("l"), text.normal_output(F.col("l")).alias("o"), text.error_key(F.col("e")).alias("e"), text.initial(F.lit("_1Éa")).alias("i"), text.task_number(F.lit("T/7"), "T").alias("t"), text.task_number(F.lit("T/x"), "T").alias("u"),
    ).first()
    assert row.c == "keep this note" and row.l == "a\n\nb\n" and row.o == "a\n\n\n\nb" and row.e == "b: failed" and row.i == "é" and (row.t, row.u) == (7, None)


def test_drop_reasons_are_in_order(spark):
    rows = ["", "# ab", "x" * 200, "a line\nanother", "Copyright 2020 by someone", "Generated by a tool", "noqa for this line", "value = call(x);", "return the value (of it)", "это не английский текст", "12 34 56 7 ab", "a plain and useful comment", "/* # // kept text **/ */", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", text.comment_drop_reason(F.col("r")).alias("d"), text.doc_drop_reason(F.col("r")).alias("b")).orderBy("i").collect()
    assert [r.d for r in got] == ["length", "length", "length", "multiline", "license", "generated", "directive", "code", "code", "non_english", "non_english", None, None, "length"]
    assert got[3].b is None and got[2].b is None and got[13].b == "length"
    doc = spark.createDataFrame([("/** The first line.\n   * and more\n   *\n   **/",)], "t string").select(text.clean_doc(F.col("t"))).first()[0]
    assert doc == "The first line. and more"


def test_versions(spark):
    rows = [("python", "Python (3.8)", True), ("python", "PyPy3", True), ("python", "Python (2.7)", False), ("python", "Python", False), ("cpp", "C++ (GCC)", True), ("cpp", "C++ 20", False), ("cpp", "MSVC", False), ("java", "any", True), ("javascript", "Node.js", True), ("javascript", " JavaScript", True), ("javascript", "JavaScript (V8)", False), ("rust", "1.0", False)]
    got = spark.createDataFrame(rows, "l string, v string, e boolean").select("e", text.compatible(F.col("l"), F.col("v")).alias("f")).collect()
    assert all(r.e == r.f for r in got)


@settings(deadline=None, max_examples=200)
@given(st.text(st.sampled_from("<>/abpre dnivtyl=\"&;\n"), max_size=80))
def test_any_page_parses(page):
    found = html.parsed(page)
    assert isinstance(found[0], str) and len(found) == 6


def test_pages(spark):
    page = '<html><head><title>t</title></head><body><span class="en">A <span>nested</span> &amp; b<br>c</span><span class="ja">x</span><pre>  k\n  l</pre><table><tr><td>1</td></tr></table><script>no()</script><img src=x></body>'
    row = spark.createDataFrame([(page,)], "h string").select(html.described(F.col("h")).alias("d"), html.described(F.col("h"), "en").alias("e")).first()
    assert row.d.has_image and row.d.has_table and row.d.has_script and not row.d.has_math and row.d.n_pre == 1
    assert "no()" not in row.d.text and "  k\n  l" not in row.e.text and row.e.text == "A nested & b\nc"


def test_workers_isolate_failures(spark):
    items = spark.createDataFrame([("a", "x", 2), ("b", "please fail", 2), ("c", None, 1), ("d", "y", 0)], "item_id string, code string, n int").coalesce(1)
    rows = workers.run_workers(items, workers.Echo, {}).collect()
    assert sorted((r.item_id, r.sample_index, r.status) for r in rows) == [("a", 0, "OK"), ("a", 1, "OK"), ("b", 0, "FAILED"), ("b", 1, "FAILED"), ("c", 0, "OK")]


def _ran(program):
    space = {}
    exec(program, space)  # noqa: S102  programs of this test
    return space["f"]()


def _looped(rng, depth=0):
    """Statements with counted while loops, of which some may be turned."""
    out = []
    for _ in range(rng.randint(1, 2)):
        v, n = "ijk"[depth] + str(rng.randint(0, 2)), rng.choice(["3", "0", "limit", "len(out)"])
        body = [rng.choice([f"out.append({v})", f"out.append({v} * 2)", "out.append(7)", f"if {v} == 1:\n    break", "pass", f"out.append([{v} + x for x in (1, 2)])"]) for _ in range(rng.randint(0, 2))]
        if depth < 2 and rng.random() < 0.4:
            body.append(_looped(rng, depth + 1))
        if rng.random() < 0.1:
            body.append(f"{v} += 1")
        lines = "\n".join(body).split("\n") if body else []
        guard = "if len(out) > 200:\n    return out"
        out.append(f"{v} = {rng.choice([0, 1, -2])}\nwhile {v} < {n}:\n" + "\n".join("    " + x for x in [*guard.split("\n"), *lines, f"{v} += 1"]))
        if rng.random() < 0.15:
            out.append(f"out.append({v})")
    return "\n".join(out)


def test_while_loops_that_are_turned_do_the_same():
    import ast
    import random

    from marlstone.functions import code

    rng, turned = random.Random(12), 0
    for _ in range(300):
        text = "def f():\n    out = [5]\n    limit = 2\n" + "\n".join("    " + x for x in _looped(rng).split("\n")) + "\n    return out\n"
        rule = code._WhileToFor()
        new = ast.unparse(ast.fix_missing_locations(rule.visit(ast.parse(text))))
        assert _ran(new) == _ran(text), (text, new)
        turned += rule.n
    assert turned > 100


def test_while_loops_that_stay():
    import ast

    from marlstone.functions import code

    loop = "i = 0\n    while i < 3:\n        {}\n        i += 1"
    stay = [loop.format("continue"), loop.format("i = i"), loop.format("g(lambda: i)"), loop.format("g(x + i for x in y)"), loop.format("pass") + "\n    return i", "i = 0.0\n    while i < 3:\n        i += 1", "i = 0\n    while i < n:\n        i += 1", "i = 0\n    while i < 3:\n        pass\n        i += 2", "global i\n    " + loop.format("pass"), "i = 0\n    while i <= 3:\n        i += 1"]
    for body in stay:
        rule = code._WhileToFor()
        rule.visit(ast.parse(f"def f(n, y):\n    {body}\n"))
        assert rule.n == 0, body
    rule = code._WhileToFor()
    assert "for i in range(0, 3)" in ast.unparse(ast.fix_missing_locations(rule.visit(ast.parse(f"def f():\n    {loop.format('g(i)')}\n"))))
