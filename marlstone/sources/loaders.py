"""Corpora of several shapes to one table of problems, and the negatives that come with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.braces import cpp_functions
from marlstone.functions.code import functions_of, valid_python
from marlstone.functions.hashing import problem_key
from marlstone.functions.text import GENERATED_SIGNS, doc_drop_reason, newlines

PROBLEM = ("problem_key", "dataset", "level", "language", "split", "prompt_text", "entry_point", "canonical_solution", "test_ref", "contamination_risk", "loc_to_generate")


def as_problems(table: DataFrame, dataset: str, level: str, language: Column, ident: Column, prompt: Column, entry: Column | None = None, solution: Column | None = None, risk: bool = False, loc: Column | None = None) -> DataFrame:
    """A projection to the problem schema; keys are dataset/id, the same in every language."""
    none = F.lit(None).cast("string")
    return table.select(
        problem_key(F.lit(dataset), ident.cast("string")).alias("problem_key"), F.lit(dataset).alias("dataset"), F.lit(level).alias("level"), language.alias("language"), none.alias("split"),
        newlines(prompt).alias("prompt_text"), (none if entry is None else entry).alias("entry_point"), (none if solution is None else newlines(solution)).alias("canonical_solution"), none.alias("test_ref"),
        F.lit(risk).alias("contamination_risk"), (F.lit(None) if loc is None else loc).cast("long").alias("loc_to_generate"),
    )


def negatives_of(problems: DataFrame) -> DataFrame:
    """The canonical solutions as human-written negatives."""
    return problems.where(F.col("canonical_solution").isNotNull()).select("problem_key", "dataset", "language", "level", F.lit("human").alias("source"), F.col("canonical_solution").alias("code"), "contamination_risk")


def merged_files(parts: dict[str, DataFrame], ident: str, text: str) -> DataFrame:
    """Several files of one corpus with the file's role, line ends made equal; an id is expected once."""
    out = None
    for role, part in parts.items():
        one = part.select(ident, newlines(F.col(text)).alias(text), F.lit(role).alias("role"))
        out = one if out is None else out.unionByName(one)
    return out


def without(problems: DataFrame, excluded: DataFrame, key: str = "problem_key") -> DataFrame:
    return problems.join(excluded.select(key).distinct(), key, "left_anti")


def documented_functions(table: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose documentation makes a prompt, and the others with the reason."""
    marked = table.withColumn("drop_reason", doc_drop_reason(F.col(doc)))
    return marked.where("drop_reason is null").drop("drop_reason"), marked.where("drop_reason is not null")


def parsed_candidates(table: DataFrame, code: str, url: str, repo: str) -> DataFrame:
    """Candidates that parse, keyed by a hash of their address, with their repository."""
    return table.where(valid_python(F.col(code))).select(F.md5(url).alias("key"), F.col(code).alias("code"), F.col(repo).alias("repo"))


def file_functions(files: DataFrame, content: str, bucket: str, wanted: list[str]) -> DataFrame:
    """A row per function of the files in the wanted buckets."""
    kept = files.where(F.col(bucket).isin(*wanted))
    return kept.withColumn("function", F.explode(functions_of(F.col(content)))).select(*[c for c in files.columns if c != content], "function.name", "function.code", "function.loc")


def cpp_corpus(files: DataFrame, dataset: str, level: str, ident: str, content: str, repo: str, bucket: str, wanted: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C++ files of the wanted buckets: (problems, negatives, counts).

    Problems are functions whose documentation is English prose, with prompt and body lines; negatives (problem_key, code, loc, repo)
    are all sound functions; counts (reason, n) say why functions make no problem (``kept``: they do). A file is read once.
    """
    found = files.where(F.col(bucket).isin(*wanted)).select(F.col(ident).alias("_file"), F.col(repo).alias("repo"), F.explode(cpp_functions(newlines(F.col(content)), GENERATED_SIGNS)).alias("f"))
    found = found.select("repo", F.concat_ws(":", "_file", "f.start_line").alias("id"), "f.*").withColumn("reason", F.coalesce("reason", F.concat(F.lit("doc_"), doc_drop_reason(F.col("doc")))))
    problems = as_problems(found.where("reason is null"), dataset, level, F.lit("cpp"), F.col("id"), F.col("prompt"), F.col("entry_point"), F.col("code"), True, F.col("loc"))
    negatives = found.where("sound").select(problem_key(F.lit(dataset), F.col("id")).alias("problem_key"), F.col("human").alias("code"), F.col("human_loc").alias("loc"), "repo")
    return problems, negatives, found.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
