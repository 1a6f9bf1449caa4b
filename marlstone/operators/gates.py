"""Checks that stop a run: row conservation, split integrity, frozen configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Violation(ValueError):
    """One or more checks failed; the message names them all."""


def conserved(table: DataFrame, expected: int, write) -> None:
    """Write a table (``write`` gets it) and check the rows on the way, in the same job."""
    seen = Observation("rows")
    write(table.observe(seen, F.count(F.lit(1)).alias("n")))
    if (n := seen.get["n"]) != expected:
        raise Violation(f"{n} rows instead of {expected}")


def with_split(table: DataFrame, splits: DataFrame, key: str = "problem_key") -> DataFrame:
    """Every row's split; a row without one raises."""
    joined = table.join(splits.select(key, F.col("split").alias("_split")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no split for "), F.col(key).cast("string")))
    return joined.withColumn("split", F.when(F.col("_split").isNull(), missing).otherwise(F.col("_split"))).drop("_split")


def freeze_violations(selected: DataFrame, thresholds: DataFrame, candidates: DataFrame, levels: list[str]) -> DataFrame:
    """(cell columns, reason): everything that stands against freezing, in one table."""
    cell = ["method", "model_id", "language"]
    joined = selected.alias("s").join(thresholds.alias("t"), [*cell, "config_hash"], "left")
    hashes = candidates.groupBy("method").agg(F.countDistinct("config_hash").alias("hashes"))
    per_cell = candidates.groupBy(*cell).agg(F.countDistinct("config_hash").alias("own"))  # of the method's, so equal counts are equal sets
    reasons = F.array(
        F.when(F.col("s.provisional"), "selection is provisional"), F.when(F.col("t.threshold").isNull(), "no threshold"), F.when(F.col("t.provisional"), "threshold is provisional"),
        F.when(F.array_sort(F.col("s.levels")) != F.array_sort(F.array(*[F.lit(x) for x in levels])), "levels differ"), F.when(F.col("own") != F.col("hashes"), "candidates differ between cells"),
    )
    found = joined.join(hashes, "method", "left").join(per_cell, cell, "left").where(~F.col("s.not_applicable"))
    return found.select(*cell, F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason"))


def freeze(selected: DataFrame, thresholds: DataFrame, candidates: DataFrame, levels: list[str]) -> DataFrame:
    """The frozen cells, hashes of selection and threshold included; raises with all that stands against it."""
    against = freeze_violations(selected, thresholds, candidates, levels).limit(50).collect()
    if against:
        raise Violation("; ".join(f"{r['method']}/{r['model_id']}/{r['language']}: {r['reason']}" for r in against))
    joined = selected.alias("s").join(thresholds.alias("t"), ["method", "model_id", "language", "config_hash"], "left")
    return joined.select("method", "model_id", "language", "config_hash", "t.threshold", "s.not_applicable", F.sha2(F.concat_ws("|", "method", "model_id", "language", "config_hash"), 256).alias("selected_sha256"), F.sha2(F.concat_ws("|", "config_hash", F.col("t.threshold").cast("string")), 256).alias("threshold_sha256"))


def ensure_not_frozen(frozen: DataFrame, method: str, override: bool = False) -> None:
    if not override and frozen.where(F.col("method") == method).limit(1).count():
        raise Violation(f"{method} is frozen")


def frozen_only(cells: DataFrame, frozen: DataFrame) -> DataFrame:
    """Test cells whose configuration and threshold are the frozen ones; any other raises."""
    cell = ["method", "model_id", "language"]
    held = frozen.select(*cell, F.col("config_hash").alias("_config"), F.col("threshold_sha256").alias("_threshold"))
    same = F.col("config_hash").eqNullSafe(F.col("_config")) & F.col("threshold_sha256").eqNullSafe(F.col("_threshold"))
    joined = cells.join(held, cell, "left")
    return joined.withColumn("config_hash", F.when(same, F.col("config_hash")).otherwise(F.raise_error(F.concat(F.lit("not the frozen configuration: "), F.concat_ws("/", *cell))))).drop("_config", "_threshold")


def results_for_all(items: DataFrame, results: DataFrame, n: str = "n") -> DataFrame:
    """A row for each item and expected index; where the worker gave none, a FAILED one."""
    expected = items.where(F.col(n) > 0).select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias("sample_index"))
    joined = expected.join(results, ["item_id", "sample_index"], "left")
    return joined.withColumn("error", F.when(F.col("status").isNull(), "no result").otherwise(F.col("error"))).withColumn("status", F.coalesce("status", F.lit("FAILED")))


def complete_items(results: DataFrame, items: DataFrame, n: str = "n") -> DataFrame:
    """Rows of items that have all their results; the others are done again."""
    whole = results.groupBy("item_id").agg(F.countDistinct("sample_index").alias("_n")).join(items.select("item_id", n), "item_id").where(F.col("_n") == F.col(n))
    return results.join(whole.select("item_id"), "item_id", "left_semi")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty if the sets are equal."""
    keys = lambda t, name: t.select(key).distinct().withColumn(name, F.lit(True))
    return keys(a, "in_a").join(keys(b, "in_b"), key, "full").where("in_a is null or in_b is null").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
