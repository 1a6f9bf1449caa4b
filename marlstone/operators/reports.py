"""Long metric tables to report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scores import shown
from marlstone.operators.metrics import pivot_first
from marlstone.operators.ordered import last_per


def annotated(long: DataFrame, annotations: DataFrame, axes: list[str]) -> DataFrame:
    """Adds ``deviations``: the texts of all annotations that apply, an empty list matching any value.

    ``annotations`` is a hand-written table (arrays per axis, text), small by nature.
    """
    applies = F.lit(True)
    for axis in axes:
        applies = applies & ((F.size(F.col(f"a.{axis}")) == 0) | F.array_contains(F.col(f"a.{axis}"), F.col(f"l.{axis}")))
    tagged = long.withColumn("_row", F.xxhash64(*long.columns))
    hits = tagged.select("_row", *axes).distinct().alias("l").join(annotations.alias("a"), applies).groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("a.text")), "; ").alias("deviations"))
    return tagged.join(hits, "_row", "left").drop("_row").withColumn("deviations", F.coalesce("deviations", F.lit("")))


def interval_table(long: DataFrame, index: list[str], metrics: list[str]) -> DataFrame:
    """A row per index and a column per metric, each value with its interval."""
    return pivot_first(long.withColumn("_shown", shown(F.col("value"), F.col("ci_low"), F.col("ci_high"))), index, metrics, value="_shown")


def per_dataset(long: DataFrame) -> DataFrame:
    """Metrics named metric|dataset, taken apart."""
    parts = F.split("metric", r"\|", 2)
    return long.where(F.contains("metric", F.lit("|"))).withColumn("dataset", parts[1]).withColumn("metric", parts[0])


def efficiency(results: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds per sample of the last line of each (item, index), by phase and device."""
    last = last_per(results, ["item_id", "sample_index", *keys], "line")
    return last.groupBy(*keys).agg(F.count("*").alias("samples"), (F.sum("elapsed_s") / F.count("*")).alias("seconds_per_sample"))


def parameter_curve(candidates: DataFrame, selected: DataFrame, group: list[str], param: str, others: list[str]) -> DataFrame:
    """Candidates that differ from the selected one in one parameter only."""
    from pyspark.sql import Window

    chosen = selected.select(*group, *[F.col(o).alias(f"_{o}") for o in others])
    same = [F.col(o).eqNullSafe(F.col(f"_{o}")) for o in others]
    kept = candidates.join(chosen, group)
    for s in same:
        kept = kept.where(s)
    return kept.select(*candidates.columns, (F.col("tpr_dev") - F.lag("tpr_dev").over(Window.partitionBy(*group).orderBy(param))).alias("gain"))


def report_index(written: DataFrame, long: DataFrame) -> DataFrame:
    """(position, line): the index of a report, a line per file and how many metric rows are at risk of contamination.

    ``written`` has a row per file (column name): a small table.
    """
    head = written.sparkSession.createDataFrame([(0, "# Report"), (1, ""), (2, "## Files"), (3, "")], "part int, line string")
    files = written.select(F.lit(4).alias("part"), F.concat(F.lit("- `"), "name", F.lit("`")).alias("line"))
    risk = long.agg(F.count_if("contamination_risk").alias("n")).select(F.lit(5).alias("part"), F.concat(F.lit("- metric rows with `contamination_risk`: "), "n").alias("line"))
    lines = head.unionByName(files).unionByName(risk)
    return lines.select((F.row_number().over(Window.orderBy("part", "line"))).alias("position"), "line")
