"""Scores against a plain form with counters; what each part sees."""

import ast
import keyword
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.functions.similarity import flows, profile, profile_of, similarity, subtrees
from marlstone.plans import code_queries
from tests.oracles import SMALL

PROGRAMS = [
    "def f(a, b):\n    total = a\n    for i in range(b):\n        total += i\n    return total\n",
    "def g(x, y):\n    s = x\n    for k in range(y):\n        s += k\n    return s\n",
    "def f(a, b):\n    return a + b if a else b\n",
    "x = 1\nx = 1\ny = x\n",
    "not python (",
    "",
    "word " * 2000,
]


def plain(reference, hypothesis, words, language="python"):
    """All four parts by counting; subtrees and flows as the module lists them."""
    if reference == hypothesis:
        return 1.0
    r, h = reference.split(), hypothesis.split()
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    both = lambda a, b: (a & b).total()
    share = lambda some, whole: (some or 0.1) / max(1, whole)
    one_r, one_h = Counter(r), Counter(h)
    worded = 0.0
    if both(one_r, one_h):
        weight = lambda c: sum(n * (1 if t in words else 0.2) for t, n in c.items())
        pairs = [(grams(r, n), grams(h, n)) for n in (2, 3, 4)]
        precisions = [share(both(one_r, one_h), len(h)), *[share(both(a, b), b.total()) for a, b in pairs]]
        recalls = [share(weight(one_r & one_h), weight(one_r)), *[share(both(a, b), a.total()) for a, b in pairs]]
        short = 1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))
        worded = short * sum(math.exp(sum(map(math.log, own)) / 4) for own in (precisions, recalls))
    rest = 0.0
    for part in (subtrees, flows):
        a, b = Counter(part(reference, language)), Counter(part(hypothesis, language))
        rest += both(a, b) / a.total() if a else 1.0
    return (worded + rest) / 4


def test_every_pair(spark):
    t = spark.createDataFrame([(i, p) for i, p in enumerate(PROGRAMS)], "i int, c string").select("i", profile(F.col("c"), F.lit("python")).alias("p"))
    got = t.alias("r").crossJoin(t.alias("h")).select(F.col("r.i"), F.col("h.i").alias("j"), similarity(F.col("r.p"), F.col("h.p")).alias("s")).collect()
    for r in got:
        assert r.s == pytest.approx(plain(PROGRAMS[r.i], PROGRAMS[r.j], set(keyword.kwlist))), (r.i, r.j)
    score = {(r.i, r.j): r.s for r in got}
    assert score[0, 1] > score[0, 2] > score[0, 6] and score[0, 0] == 1.0


def test_subtrees_have_no_names():
    assert Counter(subtrees(PROGRAMS[0], "python")) == Counter(subtrees(PROGRAMS[1], "python"))
    inner = [n for n in ast.walk(ast.parse(PROGRAMS[0])) if any(not isinstance(c, ast.expr_context) for c in ast.iter_child_nodes(n))]
    assert len(subtrees(PROGRAMS[0], "python")) == len(inner) and subtrees("x(", "python") == [] and subtrees("a b", "text") == []
    deep = "x = " + "(" * 150 + "1" + ")" * 150
    assert subtrees(deep, "python") == subtrees("x = 2", "python")


def test_flows():
    assert flows("def f(a):\n    b = a + c\n    b += a\n    return b\n", "python") == ["v0 comesFrom v0", "v1 comesFrom ", "v2 computedFrom v0,v1", "v0 comesFrom v0", "v2 computedFrom v2,v0", "v2 comesFrom v2"]
    assert flows(PROGRAMS[0], "python") == flows(PROGRAMS[1], "python") and flows("int x = y;", "java") == []


def test_brackets_of_other_languages():
    a, b = "int f(int x) { return x + 1; }", "int g(int y) { return y + 2; }"
    assert subtrees(a, "java") == subtrees(b, "java") != subtrees("int g(int y) { return y - 2; }", "java")
    assert subtrees("int f( {", "cpp") == [] and len(subtrees('f("}")', "javascript")) == 2


def test_query(spark):
    """The mean over a problem's rows, each row's mean over the reference, by loops over the same programs."""
    marked, reference = (t.select("problem_key", "sample_id", "code").collect() for t in code_queries.similar_programs(spark, SMALL))
    expected = {}
    for r in marked:
        own = [plain(o.code, r.code, set(keyword.kwlist)) for o in reference if o.problem_key == r.problem_key]
        if own:
            expected.setdefault(r.problem_key, []).append(sum(own) / len(own))
    found = {r.problem_key: r.cross_mean for r in code_queries.QUERIES["m30_cross_similarity"](spark, SMALL).collect()}
    assert found.keys() == expected.keys() and len(found) > 20
    assert all(found[k] == pytest.approx(sum(v) / len(v)) for k, v in expected.items())


def test_nulls_and_repeats(spark):
    rows = [(None, "a b"), ("a b", None), ("a a a", "a"), ("a", "a a a"), ("", "x")]
    t = spark.createDataFrame(rows, "r string, h string").select("r", "h", similarity(profile(F.col("r"), F.lit("text")), profile(F.col("h"), F.lit("text"))).alias("s")).collect()
    assert [r.s is None for r in t] == [True, True, False, False, False]
    assert [r.s for r in t[2:]] == [pytest.approx(plain(r.r, r.h, set(), "text")) for r in t[2:]]
    assert len(set(profile_of("a a a", "text")["others"])) == 3


def test_profiles_are_not_broadcast(spark):
    """Spark takes a profile for a few bytes before it is made; the driver must not gather one side of the pairs."""
    plan = code_queries.QUERIES["m30_cross_similarity"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_program_is_parsed_once(monkeypatch):
    parsed, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda code: parsed.append(code) or parse(code))
    assert profile_of("x = some_name + 1\n", "python")["trees"] and parsed == ["x = some_name + 1\n"]
