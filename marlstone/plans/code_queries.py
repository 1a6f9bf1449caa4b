"""Queries over programs in several languages, each made of a row of ``part``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import braces, rewrites
from marlstone.functions.similarity import profile, similarity
from marlstone.operators import metrics
from marlstone.session import read_table
from marlstone.sources import loaders

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Each program has brackets in strings and comments, a function with p_size % 4 lines of work, and one in an inner scope.
_CPP = """#include <x{.h>
#define PAIR(a) { a, \\
  "{" }
/// %2$s, told well.
template <class T>
int part_%1$d(T a, int b) noexcept {
  // } %2$s
  const char *s = "} %2$s {", c = '{'; auto r = R"z(" } )" )z";
%3$s  return a;
}

namespace inner { struct S : B<int(int)> { S(int y) : x{y}, z{1'000} { /* } */ } int x, z; }; }
"""
_JAVA = """package p;
@A("{") class C { enum E { ONE(1) { } }
  /** %2$s */
  @B(x = '}') public int part_%1$d(int a, int b) throws X {
    // } %2$s
    String s = \"\"\" 
      } "%2$s" {
    \"\"\"; char c = '{';
%3$s    return a;
  }
  int n = f(new int[]{1, 2}); static { n = 1; }
  C() { if (n > 1) { n = 2; } }
}
"""
_SCRIPT = """'use {strict';
const part_%1$d = async (a, b) => {
  // } %2$s
  const s = `} ${ g({x: "}"}) } %2$s {`, r = /[}"]{2}/g;
%3$s  return a / b / 2;
};
const o = { inner(x) { if (x) { return "}"; } }, y: {} };
"""
_LANGUAGE = "['cpp', 'java', 'javascript'][1 + (p_partkey % 3)::INT]"


def programs(spark, sf_dir):
    """(p_partkey, p_name, language, code); a program in 11 lacks its last bracket."""
    p = read_table(spark, sf_dir, "part")
    work = F.repeat(F.lit("  a += 1; /* { */\n"), F.col("p_size") % 4)
    args = (F.col("p_partkey"), F.col("p_name"), work)
    kind = F.col("p_partkey") % 3
    code = F.when(kind == 0, F.format_string(_CPP, *args)).when(kind == 1, F.format_string(_JAVA, *args)).otherwise(F.format_string(_SCRIPT, *args))
    language = F.when(kind == 0, "cpp").when(kind == 1, "java").otherwise("javascript")
    return p.select("p_partkey", "p_name", "p_size", language.alias("language"), F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("int broken(int x) { return 1;\n"), code)).otherwise(code).alias("code"))


@query(
    "f29_brace_functions",
    f"""WITH p AS (SELECT p_partkey, p_size % 4 AS w, {_LANGUAGE} AS language, 'part_' || p_partkey::VARCHAR AS own FROM part WHERE p_partkey % 11 <> 0)
    SELECT p_partkey, language, own AS name, CASE language WHEN 'cpp' THEN 5 WHEN 'java' THEN 3 ELSE 1 END::INT AS start_line, (w + CASE language WHEN 'cpp' THEN 4 WHEN 'java' THEN 6 ELSE 4 END)::INT AS loc FROM p
    UNION ALL SELECT p_partkey, language, CASE language WHEN 'cpp' THEN 'S' WHEN 'java' THEN 'C' ELSE 'inner' END, (w + CASE language WHEN 'cpp' THEN 11 WHEN 'java' THEN 11 ELSE 6 END)::INT, 1::INT FROM p""",
)
def f29(spark, sf_dir):
    p = programs(spark, sf_dir).where("p_partkey % 11 <> 0")
    return p.select("p_partkey", "language", F.explode(braces.brace_functions(F.col("code"), F.col("language"))).alias("f")).select("p_partkey", "language", "f.name", "f.start_line", "f.loc")


@query(
    "f28_brace_lines",
    f"""WITH p AS (SELECT p_partkey, p_size % 4 AS w, {_LANGUAGE} AS language FROM part WHERE p_partkey % 11 <> 0)
    SELECT p_partkey, (w + CASE language WHEN 'cpp' THEN 9 WHEN 'java' THEN 11 ELSE 6 END)::INT AS code_lines, (w + CASE language WHEN 'cpp' THEN 5 WHEN 'java' THEN 7 ELSE 5 END)::INT AS function_lines FROM p""",
)
def f28(spark, sf_dir):
    p = programs(spark, sf_dir).where("p_partkey % 11 <> 0")
    return p.select("p_partkey", braces.brace_lines(F.col("code"), F.col("language")).alias("n")).select("p_partkey", "n.*")


def _isolated(p) -> Column:
    """A method, or a function without a name, of each program's language."""
    own = F.concat(F.lit("part_"), F.col("p_partkey"))
    body = F.concat(F.lit("(a) {\n  return \"} "), F.col("p_name"), F.lit("\"; // {\n}"))
    return F.when(F.col("language") == "cpp", F.concat(F.lit("public: int "), own, body)).when(F.col("language") == "java", F.concat(F.lit("int "), own, body)).when(F.col("p_size") % 2 == 0, F.concat(F.lit("function "), body)).otherwise(F.concat(own, body))


@query(
    "f31_standalone",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CASE {_LANGUAGE} WHEN 'cpp' THEN 'struct __Wrapper__ {{' || chr(10) WHEN 'java' THEN 'class __Wrapper__ {{' || chr(10) ELSE CASE WHEN p_size % 2 = 0 THEN '(' ELSE 'class __Wrapper__ {{' || chr(10) END END END AS prefix FROM part""",
)
def f31(spark, sf_dir):
    p = programs(spark, sf_dir)
    one = F.when(F.col("p_partkey") % 11 == 0, F.concat(_isolated(p), F.lit(" }"))).otherwise(_isolated(p))
    return p.select("p_partkey", braces.standalone(one, F.col("language"))["prefix"].alias("prefix"))


@query(
    "f39_brace_prompts",
    """SELECT p_partkey, '/**' || chr(10) || ' * ' || p_name || chr(10) || ' */' || chr(10) || CASE WHEN p_partkey % 3 = 1 THEN 'int ' ELSE '' END || 'part_' || p_partkey::VARCHAR || '(a) {' || chr(10) AS prompt,
       'part_' || p_partkey::VARCHAR AS entry_point, 2::INT AS loc, 'built' AS doc_kind FROM part WHERE p_partkey % 3 <> 0 AND NOT (p_partkey % 3 = 2 AND p_size % 2 = 0)""",
)
def f39(spark, sf_dir):
    p = programs(spark, sf_dir).where("language <> 'cpp'")
    found = p.select("p_partkey", braces.brace_prompt(_isolated(p), F.col("language"), F.col("p_name")).alias("x")).where("x.reason is null")
    return found.select("p_partkey", "x.prompt", "x.entry_point", "x.loc", "x.doc_kind")


@query(
    "q6_brace_rewrites",
    """WITH p AS (SELECT p_partkey, p_partkey % 3 AS g, p_partkey % 11 = 0 AS broken FROM part), r AS (SELECT unnest(['add_comments', 'counted_to_while', 'drop_comments', 'local_edits']) AS name)
    SELECT name, CASE WHEN broken THEN 'TOOL_ERROR' ELSE 'APPLIED' END AS status, count(*) AS n FROM p, r GROUP BY ALL""",
)
def q6_braces(spark, sf_dir):
    """Rewrites of each program with a counted loop added; a rewrite that would not close is refused."""
    p = programs(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    loop = F.when(F.col("language") == "javascript", "\nfunction loop(n) { for (let i = 0; i < n; i++) { g(i); } /* } */ }\n").otherwise("\nclass L { void loop(int n) { for (int i = 0; i < n; i++) { g(i); } /* } */ } };\n")
    whole, key = F.concat("code", loop), F.col("p_partkey").cast("string")
    changes = [("counted_to_while", 9.0), ("drop_comments", 1.0), ("add_comments", 0.5), ("local_edits", 2.0)]
    made = F.arrays_zip(F.array(*[F.lit(name) for name, _ in changes]).alias("name"), rewrites.statuses(changes, whole, F.col("language"), key).alias("status"))
    return p.select(F.explode(made).alias("r")).select("r.*").groupBy("name", "status").agg(F.count("*").alias("n"))


_FILES = "WITH p AS (SELECT p_partkey, p_size % 4 AS w, p_name, p_brand, 'part_' || p_partkey::VARCHAR AS own FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 11 <> 0 AND p_size % 2 = 0)"


def _corpus(spark, sf_dir):
    p = programs(spark, sf_dir).join(read_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    files = p.where("language = 'cpp' and p_partkey % 11 <> 0").withColumn("bucket", F.when(F.col("p_size") % 2 == 0, "test").otherwise("train"))
    return loaders.cpp_corpus(files, "cppfiles", "L3", "p_partkey", "code", "p_brand", "bucket", ["test"])


@query(
    "f40_cpp_prompts",
    f"""{_FILES} SELECT 'cppfiles/' || p_partkey::VARCHAR || ':5' AS problem_key, own AS entry_point, (w + 3)::BIGINT AS loc_to_generate,
       '/// ' || p_name || ', told well.' || chr(10) || 'template <class T>' || chr(10) || 'int ' || own || '(T a, int b) noexcept {{' || chr(10) AS prompt_text FROM p""",
)
def f40(spark, sf_dir):
    return _corpus(spark, sf_dir)[0].select("problem_key", "entry_point", "loc_to_generate", "prompt_text")


@query("s22_cpp_negatives", f"{_FILES} SELECT 'cppfiles/' || p_partkey::VARCHAR || ':5' AS problem_key, (w + 4)::INT AS loc, p_brand AS repo FROM p UNION ALL SELECT 'cppfiles/' || p_partkey::VARCHAR || ':' || (w + 11)::VARCHAR, 1, p_brand FROM p")
def s22(spark, sf_dir):
    return _corpus(spark, sf_dir)[1].select("problem_key", "loc", "repo")


@query("s22_cpp_counts", f"{_FILES} SELECT unnest(['kept', 'no_doc']) AS reason, count(*) AS n FROM p GROUP BY 1")
def s22_counts(spark, sf_dir):
    return _corpus(spark, sf_dir)[2]


def similar_programs(spark, sf_dir):
    """(marked, reference): Python programs, eight to a problem, of which one in three is marked; one in seven does not parse."""
    p = read_table(spark, sf_dir, "part")
    step = F.when(F.col("p_size") % 2 == 0, "total += i * %d\n").otherwise("total = total + i\n        last = total - %d\n")
    body = F.concat(F.format_string('def part_%d(a, b):\n    """%s"""\n    total = a\n    for i in range(b):\n        ', F.col("p_partkey") % 5, F.col("p_name")), F.replace(step, F.lit("%d"), F.col("p_size").cast("string")), F.lit("    return total\n"))
    code = F.when(F.col("p_partkey") % 7 == 0, F.concat(body, F.lit(")"))).otherwise(body)
    rows = p.select(F.floor(F.col("p_partkey") / 8).alias("problem_key"), F.col("p_partkey").alias("sample_id"), code.alias("code"), (F.col("p_partkey") % 3 == 0).alias("marked"))
    return rows.where("marked"), rows.where("not marked")


@query("m30_cross_similarity")
def m30(spark, sf_dir):
    """Per problem, how much of the reference programs is in the marked ones: profiles are made once a program, pairs by built-ins.

    Programs are dealt by problem before they have profiles, which are many times their size and so are not shuffled.
    """
    dealt = lambda t: t.repartition(4 * spark.sparkContext.defaultParallelism, "problem_key")
    marked, reference = (dealt(t).select("problem_key", "sample_id", profile(F.col("code"), F.lit("python")).alias("profile")) for t in similar_programs(spark, sf_dir))
    return metrics.cross_mean(marked, reference, "problem_key", "sample_id", similarity(F.col("r.profile"), F.col("m.profile")))
