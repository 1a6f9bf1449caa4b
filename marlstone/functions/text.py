"""Text expressions: cleaning, fenced code, drop reasons, layout-free form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def is_empty(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True))


def clean_comment(text: Column) -> Column:
    """Comment markers off both ends as long as there are any, white space runs as one space."""
    bare = F.regexp_replace(text, r"^(?:#++|/{2,}+|/\*++|\s++)++", "")
    bare = F.regexp_replace(bare, r"(?:\*+/|\s)++$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def letter_share(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit("[A-Za-z]")).cast("double"), F.length(text).cast("double"))


def non_english(text: Column) -> Column:
    """A character beyond ASCII, or under 60 % letters."""
    return text.rlike(r"[^\x00-\x7F]") | (F.coalesce(letter_share(text), F.lit(0.0)) < 0.6)


# What makes a comment no prose.
LICENSE_SIGNS = r"copyright|\blicen[cs]e|spdx|all rights reserved|permission is hereby granted|\(c\)\s*\d"
GENERATED_SIGNS = r"@generated|auto-?generated|autogenerated|generated by|do not edit|code generator"
DIRECTIVE_SIGNS = (
    r"noqa|\btype:\s|pylint:|pyright:|mypy:|eslint|jshint|jslint|istanbul|prettier-ignore|clang-format|clang-tidy|nolint|\bfmt:\s|@ts-|"
    r"#\s*pragma|\bpragma\b|#?region\b|nosec|sourcemappingurl|coverage:|iwyu|lgtm|codecov|@flow|@jsx|@license|@preserve"
)
CODE_STARTS = (
    r"^(if|for|while|return|import|from|def|class|var|let|const|int|long|double|float|bool|public|private|protected|static|void|auto|std::|"
    r"#include|print|console\.|System\.)\b"
)
CODE_MARKS = r"[;{}()=<>\[\]]"
MOST_MARKS = 0.1  # of a text's characters


def looks_like_code(text: Column) -> Column:
    """Many marks, the end of a statement or block, or a statement's first word and a mark."""
    marks = F.regexp_count(text, F.lit(CODE_MARKS))
    share = F.coalesce(F.try_divide(marks.cast("double"), F.length(text).cast("double")), F.lit(0.0))
    return (share > MOST_MARKS) | text.rlike(r"[;{}]\z") | (text.rlike(CODE_STARTS) & (marks > 0))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(rule, name) for name, rule in rules])


def _prose_rules(cleaned: Column, shortest: int, longest: int) -> list[tuple[str, Column]]:
    sign = lambda pattern: cleaned.rlike(f"(?i){pattern}")
    return [
        ("length", ~F.length(cleaned).between(shortest, longest)), ("license", sign(LICENSE_SIGNS)), ("generated", sign(GENERATED_SIGNS)),
        ("directive", sign(DIRECTIVE_SIGNS)), ("code", looks_like_code(cleaned)), ("non_english", non_english(cleaned)),
    ]


def comment_drop_reason(text: Column, shortest: int = 3, longest: int = 120) -> Column:
    """Why a comment is no one-line English prose; null if it is. A null comment counts as empty."""
    raw = F.coalesce(text, F.lit(""))
    inner = F.regexp_replace(F.regexp_replace(raw, r"^\s++", ""), r"\s++$", "")
    return first_reason(("multiline", inner.contains("\n")), *_prose_rules(clean_comment(raw), shortest, longest))


def doc_drop_reason(text: Column, shortest: int = 10, longest: int = 2000) -> Column:
    """The same for a whole block of documentation, whose lines are joined."""
    return first_reason(*_prose_rules(clean_doc(F.coalesce(text, F.lit(""))), shortest, longest))


def clean_doc(text: Column) -> Column:
    """A documentation block without its markers, on one line."""
    opened = lambda x: F.regexp_replace(x, r"^\s*(?:/\*+!?|//+!?|\*+/|\*)\s?", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(opened(x), r"\s*\*+/\s*$", ""))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))


def compatible(language: Column, version: Column) -> Column:
    """Whether a submission's language version runs: Python 3 or PyPy 3, C++ by GCC or Clang up to C++17, any Java, Node."""
    told = F.lower(F.trim(version))
    return (
        F.when(language == "python", told.rlike(r"(python|pypy)\s*\(?\s*3"))
        .when(language == "cpp", ~told.rlike(r"msvc|visual|c\+\+\s*20|c\+\+2a"))
        .when(language == "java", F.lit(True))
        .when(language == "javascript", told.contains("node") | (told == "javascript"))
        .otherwise(False)
    )


def fence_tag(info: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(info), r"[\s,{]"), 1))


def fenced_blocks(text: Column) -> Column:
    """(tag, body) of each closed fence."""
    blocks = F.regexp_extract_all(newlines(text), F.lit(r"(?s)```([^\n`]*)\n(.*?)```"), F.lit(0))
    return F.transform(blocks, lambda b: F.struct(fence_tag(F.regexp_extract(b, r"(?s)^```([^\n`]*)\n", 1)).alias("tag"), F.regexp_replace(F.regexp_replace(b, r"(?s)^```[^\n`]*\n", ""), r"```$", "").alias("body")))


def fenced_code(text: Column, *tags: str) -> Column:
    """The first block with one of the tags, else the first without a tag, else an unclosed one's rest; null if none."""
    blocks = fenced_blocks(text)
    tagged = F.get(F.filter(blocks, lambda b: b["tag"].isin(*tags)), 0)["body"]
    plain = F.get(F.filter(blocks, lambda b: b["tag"] == ""), 0)["body"]
    rest = F.when(fence_open(text), F.regexp_extract(newlines(text), r"(?s)```[^\n`]*\n((?:(?!```).)*)$", 1))
    return F.coalesce(tagged, plain, F.when(rest != "", rest))


def fence_open(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FENCE)) % 2 == 1


def last_block(text: Column) -> Column:
    """Body of the last closed fence."""
    return F.get(F.reverse(fenced_blocks(text)), 0)["body"]


def normal_output(text: Column) -> Column:
    """Program output without blanks at line ends and newlines at the end."""
    return F.regexp_replace(F.regexp_replace(newlines(text), r"[ \t]+(?=\n|$)", ""), r"\n+$", "")


def task_number(task: Column, prefix: str) -> Column:
    return F.regexp_extract(task, rf"^{prefix}/(\d+)$", 1).try_cast("long")


def initial(name: Column) -> Column:
    """First letter, lower case; null without one."""
    found = F.lower(F.regexp_extract(name, r"(\p{L})", 1))
    return F.when(found != "", found)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def format_free(text: Column) -> Column:
    """Blanks at line ends gone, runs of blank lines as one, one newline at the end."""
    bare = F.regexp_replace(F.regexp_replace(newlines(text), r"\t", "    "), r"[ ]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""), F.lit("\n"))


# A compiler's message, and lines that say nothing.
ERROR_MESSAGE = r"(?:\berror: |\.java:\[\d+,\d+\] )([^\n]+)"
ERROR_NOISE = r"^(?:exit \d+: )?(?:\d+ warnings?|Suppressed|Use -header-filter|Error while)"
ERROR_LONGEST = 160


def error_key(message: Column) -> Column:
    """The first message of a compiler, or else the first line that says something, without folders and line numbers; cut."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    telling = F.get(F.filter(lines, lambda x: ~x.rlike(ERROR_NOISE)), 0)
    bare = F.regexp_replace(F.regexp_replace(telling, r"(?<!\S)/\S*/", ""), r":\d+:\d+:", ":")
    found = F.nullif(F.trim(F.regexp_extract(message, ERROR_MESSAGE, 1)), F.lit(""))
    return F.substring(F.coalesce(found, bare, F.get(lines, 0), message), 1, ERROR_LONGEST)


def share(text: Column) -> Column:
    """K/M or K/M:k/m as a struct; null if it is neither."""
    form = r"^(\d+)/(\d+)(?::(\d+)/(\d+))?$"
    part = lambda i: F.regexp_extract(text, form, i).try_cast("int")
    return F.when(text.rlike(form), F.struct(part(1).alias("k"), part(2).alias("m"), part(3).alias("sub_k"), part(4).alias("sub_m")))


def n_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n"))


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor a comment; an approximation without a parser."""
    return F.size(F.filter(F.split(newlines(text), "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(?:#|//|/\*|\*)")))


def code_tokens(text: Column) -> Column:
    """Identifiers, numbers and single marks. Each is given a line of its own and the lines are split: linear in the text's length."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[A-Za-z_]\w*|\d+|[^\w\s]", "$0\n"), r"\s+"), "")


def messages(system: Column, user: Column) -> Column:
    """Prompt messages in order, without an empty system message."""
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return F.filter(F.array(message("system", system), message("user", user)), lambda m: m["content"].isNotNull() & (m["content"] != ""))


def line_multisets_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "\n")) == F.array_sort(F.split(b, "\n"))
