"""Metrics over executions, detections, pairs and repeated measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scores import detected
from marlstone.operators.ordered import exact_quantiles, running_sums

STATUSES = ("PASSED", "FAILED", "SYNTAX_ERROR", "COMPILE_ERROR", "RUNTIME_ERROR", "TIMEOUT", "NO_TESTS", "EXTRACTION_FAILED", "SANDBOX_ERROR")


def pass_at_1(table: DataFrame, group: list[str], problem: str = "problem_key", passed: Column | None = None) -> DataFrame:
    """Macro mean over problems of the share of passing samples."""
    ok = F.col("status") == "PASSED" if passed is None else passed
    shares = table.groupBy(*group, problem).agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("share"))
    return shares.groupBy(*group).agg(F.avg("share").alias("pass_at_1"), F.count("*").alias("problems"))


def detection_rate(table: DataFrame, group: list[str], threshold: Column | float) -> DataFrame:
    """Micro mean of hits; rows that don't apply are no positives."""
    hit = detected(F.col("score"), F.col("status"), F.col("embed_status"), threshold)
    kept = table.where(~F.col("status").eqNullSafe(F.lit("NOT_APPLICABLE")))
    return kept.groupBy(*group).agg(F.count_if(hit).alias("detected"), F.count("*").alias("positives"), F.avg(hit.cast("double")).alias("tpr"))


def rates_by_level(table: DataFrame, cell: str, part: str, hit: Column) -> DataFrame:
    """The rate of each cell and of each of its parts in one pass; the cell's own row has a null part."""
    return table.withColumn("_hit", hit.cast("double")).groupingSets([[F.col(cell), F.col(part)], [F.col(cell)]], cell, part).agg(F.avg("_hit").alias("rate"), F.count("*").alias("n"), F.grouping(part).alias("whole"))


def status_histogram(table: DataFrame, status: str = "status", known: tuple[str, ...] = STATUSES) -> DataFrame:
    """A count for each known status, zero included."""
    every = table.sparkSession.createDataFrame([(s,) for s in known], f"{status} string")
    counts = table.groupBy(status).agg(F.count("*").alias("n"))
    return every.join(counts, status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def score_summary(table: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Count, mean, extremes of the finite scores."""
    finite = F.when(~F.isnan(score) & (F.abs(F.col(score)) != float("inf")), F.col(score))
    return table.groupBy(*group).agg(F.count(finite).alias("n"), F.avg(finite).alias("mean"), F.min(finite).alias("min"), F.max(finite).alias("max"))


def spread(table: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation and extremes."""
    return table.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def paired_difference(a: DataFrame, b: DataFrame, problem: str, value: str) -> DataFrame:
    """Per problem that both have, mean of a less mean of b."""
    means = lambda t, name: t.groupBy(problem).agg(F.avg(value).alias(name))
    return means(a, "mean_a").join(means(b, "mean_b"), problem).withColumn("difference", F.col("mean_a") - F.col("mean_b"))


def cross_mean(marked: DataFrame, reference: DataFrame, problem: str, ident: str, distance) -> DataFrame:
    """Per problem, the mean over marked rows of their mean distance to the problem's reference rows.

    Rows may hold whole profiles, whose size Spark takes for a few bytes before they are made: so neither side is broadcast.
    """
    pairs = marked.alias("m").join(reference.hint("merge").alias("r"), F.col(f"m.{problem}") == F.col(f"r.{problem}"))
    per_row = pairs.groupBy(F.col(f"m.{problem}").alias(problem), F.col(f"m.{ident}")).agg(F.avg(distance).alias("mean"))
    return per_row.groupBy(problem).agg(F.avg("mean").alias("cross_mean"))


def within_mean(reference: DataFrame, problem: str, ident: str, distance) -> DataFrame:
    """Natural variability: the same among a problem's own rows, two at least."""
    pairs = reference.alias("m").join(reference.hint("merge").alias("r"), (F.col(f"m.{problem}") == F.col(f"r.{problem}")) & (F.col(f"m.{ident}") != F.col(f"r.{ident}")))
    per_row = pairs.groupBy(F.col(f"m.{problem}").alias(problem), F.col(f"m.{ident}")).agg(F.avg(distance).alias("mean"))
    return per_row.groupBy(problem).agg(F.avg("mean").alias("within_mean"))


def gap_means(marked: DataFrame, reference: DataFrame, problem: str, value: str) -> DataFrame:
    """(problem, cross_mean, within_mean) for the distance |a - b|, without pairs: from counts per value and running sums.

    Rows without a value don't count. A mean is null without a marked row and a reference row, or without two reference rows.
    """
    side = lambda t, m, r: t.where(F.col(value).isNotNull()).select(problem, F.col(value).cast("double").alias("_v"), F.lit(m).alias("_m"), F.lit(r).alias("_r"))
    both = side(marked, 1, 0).unionByName(side(reference, 0, 1))
    counts = both.groupBy(problem, "_v").agg(F.sum("_m").alias("_m"), F.sum("_r").alias("_r")).withColumn("_s", F.col("_v") * F.col("_r"))
    totals = counts.groupBy(problem).agg(F.sum("_m").alias("_ms"), F.sum("_r").alias("_rs"), F.sum("_s").alias("_ss"))
    gaps = F.col("_v") * (2 * F.col("cum__r") - F.col("_rs")) + F.col("_ss") - 2 * F.col("cum__s")  # sum of |v - w| over the reference
    cum = running_sums(counts, [problem], "_v", ["_r", "_s"]).join(totals, problem)
    mean = lambda own, pairs: F.try_divide(F.sum(F.col(own) * gaps), pairs.cast("double"))
    rows = F.max("_rs")
    return cum.groupBy(problem).agg(mean("_m", F.max("_ms") * rows).alias("cross_mean"), mean("_r", rows * (rows - 1)).alias("within_mean"))


def conditional_preservation(before: DataFrame, after: DataFrame, problem: str) -> DataFrame:
    """P(passes after | passed before), and how many passed before."""
    joined = before.select(F.col("sample_id").alias("parent_id"), F.col("status").alias("was")).join(after, "parent_id").where("was = 'PASSED'")
    return joined.agg(F.avg(F.when(F.col("status") == "PASSED", 1.0).otherwise(0.0)).alias("preserved"), F.count("*").alias("n"), F.countDistinct(problem).alias("problems"))


def capacity(table: DataFrame, group: list[str], width: int = 12) -> DataFrame:
    """Share of exact messages, of right bits, and of usable rows."""
    ok = F.col("status") == "OK"
    return table.groupBy(*group).agg(F.avg(F.when(ok & (F.col("bits_correct") == width), 1.0).otherwise(0.0)).alias("exact"), F.avg(F.when(ok, F.col("bits_correct") / F.lit(float(width))).otherwise(0.0)).alias("bit_accuracy"), F.avg(ok.cast("double")).alias("ok_rate"))


def funnel(table: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, remaining): rows left after each step, in one pass."""
    left, counts = F.lit(True), []
    for name, keep in steps:
        left = left & F.coalesce(keep, F.lit(False))
        counts.append((name, F.count_if(left)))
    row = table.agg(F.count("*").alias("n0"), *[c.alias(f"n{i + 1}") for i, (_, c) in enumerate(counts)])
    names = ["all", *[name for name, _ in counts]]
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(x).alias("name"), F.col(f"n{i}").alias("remaining")) for i, x in enumerate(names)])).alias("s")).select("s.*")


def filter_table(table: DataFrame, reason: Column, order: list[str]) -> DataFrame:
    """(step, name, dropped, remaining) by the first reason of each row."""
    row = table.select(reason.alias("_reason")).agg(F.count("*").alias("all"), *[F.count_if(F.col("_reason") == x).alias(f"d{i}") for i, x in enumerate(order)])
    total = lambda i: F.col("all") - sum((F.col(f"d{j}") for j in range(1, i + 1)), F.col("d0"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(x).alias("name"), F.col(f"d{i}").alias("dropped"), total(i).alias("remaining")) for i, x in enumerate(order)])).alias("s")).select("s.*")


def letter_histogram(names: DataFrame, name: str) -> DataFrame:
    """How many names begin with each letter."""
    letter = F.lower(F.regexp_extract(name, r"(\p{L})", 1))
    return names.select(letter.alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))


def four_way(table: DataFrame, group: list[str], first: Column, second: Column) -> DataFrame:
    """Shares of rows that both keys, one, or neither detect; they add up to one."""
    mean = lambda c: F.avg(c.cast("double"))
    return table.groupBy(*group).agg(mean(first & second).alias("both"), mean(first & ~second).alias("only_first"), mean(~first & second).alias("only_second"), mean(~first & ~second).alias("neither"), F.count("*").alias("n"))


def overlap_bins(table: DataFrame, a: str, b: str, hit: Column, most: int = 3) -> DataFrame:
    """Rows and hit share by size of the overlap of two arrays; the last bin is open."""
    overlap = F.least(F.size(F.array_intersect(a, b)), F.lit(most))
    return table.groupBy(overlap.alias("overlap")).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("share"))


def median_with_fallback(table: DataFrame, levels: list[list[str]], value: str, wanted: DataFrame) -> DataFrame:
    """Median of ``value`` for each wanted row at the first level of keys that has measurements."""
    out, found = wanted, []
    for i, keys in enumerate(levels):
        medians = exact_quantiles(table, keys, value, {f"_m{i}": 0.5})
        out = out.join(medians, keys, "left") if keys else out.crossJoin(medians)
        found.append(f"_m{i}")
    level = F.coalesce(*[F.when(F.col(m).isNotNull(), i) for i, m in enumerate(found)])
    return out.select(*wanted.columns, F.coalesce(*found).alias("median"), level.alias("level"))


def top_messages(table: DataFrame, key: Column, n: int = 10) -> DataFrame:
    """The most frequent keys, ties by name."""
    return table.groupBy(key.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(n)


def pivot_first(long: DataFrame, index: list[str], names: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A column per metric: the first value that is there."""
    return long.groupBy(*index).pivot(name, names).agg(F.first(value, ignorenulls=True))


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty if they are unique."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def split_violations(table: DataFrame, problem: str, split: str) -> DataFrame:
    """Problems that are in more than one split."""
    return table.groupBy(problem).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
