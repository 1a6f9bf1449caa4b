"""Scans with declared columns: what is missing is an error, not a null column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.functions.hashing import unit
from marlstone.operators.ordered import cumulative_buckets


class MissingColumns(ValueError):
    """A scan lacks columns that it was asked for."""


def _required(table: DataFrame, columns: list[str], path: str) -> DataFrame:
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise MissingColumns(f"{path}: no column {', '.join(missing)}")
    return table.select(*columns)


def read_parquet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    return _required(spark.read.parquet(path), required, path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, required: list[str]) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line or a missing required field raises."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = [F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"{path}: a line has no "), F.lit(c)))).otherwise(F.col(c)).alias(c) if c in required else F.col(c) for c in rows.columns]
    return rows.select(*whole)


def read_growing_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines that a writer may have left half written: an undecodable last line of a file without an
    end is ignored, any other raises. Adds nothing to the schema."""
    corrupt = StructType([*schema.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.where(F.trim("value") != "").select("file", "line", F.from_json("value", corrupt, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    last = parsed.groupBy("file").agg(F.max("line").alias("last"))
    broken = F.col("r._corrupt").isNotNull()
    joined = parsed.join(last, "file").where(~(broken & (F.col("line") == F.col("last"))))
    checked = joined.select(F.when(broken, F.raise_error(F.concat(F.lit("malformed line in "), F.col("file")))).otherwise(F.col("r")).alias("r"))
    return checked.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def checked_rows(table: DataFrame, expected: int, what: str) -> DataFrame:
    """The table, if it has the rows it is declared to have (a count over the scan's footers where possible)."""
    found = table.count()
    if found != expected:
        raise ValueError(f"{what}: {found} rows, {expected} declared")
    return table


def check_not_excluded(keys: DataFrame, excluded: DataFrame, key: str, what: str) -> DataFrame:
    """The keys, if none of them is excluded."""
    some = [r[0] for r in keys.join(excluded.select(key).distinct(), key, "left_semi").select(key).limit(5).collect()]
    if some:
        raise ValueError(f"{what}: excluded keys {some}")
    return keys


def groups_of_ids(lines: DataFrame, line: str, pattern: str) -> DataFrame:
    """(group, ids): the ids that a line names, for lines that name two or more."""
    ids = F.array_distinct(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))
    return lines.select(ids.alias("ids")).where(F.size("ids") > 1).select(F.md5(F.array_join("ids", ",")).alias("group"), "ids")


def groups_of_files(files: DataFrame, content: str, pattern: str) -> DataFrame:
    """(group, ids) of whole files: a group is a block where blank lines part them, else a line."""
    whole = F.trim(F.regexp_replace(content, "\r\n", "\n"), F.lit(" \n\t"))
    blank = r"\n[ \t]*\n"
    chunks = F.when(whole.rlike(blank), F.split(whole, blank)).otherwise(F.split(whole, "\n"))
    return groups_of_ids(files.select(F.explode(chunks).alias("chunk")), "chunk", pattern)


def group_index(groups: DataFrame) -> DataFrame:
    """(id, group, place): a row per id of each group."""
    return groups.select("group", F.posexplode("ids").alias("place", "id")).select("id", "group", "place")


def bucketed(table: DataFrame, repo: Column, weights: list[tuple[str, float]], base: int = 42) -> DataFrame:
    """Adds ``bucket``: all rows of a repository in one bucket, buckets in proportion to their weights."""
    return table.withColumn("bucket", cumulative_buckets(weights, unit(F.lit("bucket"), F.lit(base), repo)))


def without_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has no finished row yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def exploded_functions(files: DataFrame, content: str) -> DataFrame:
    """A row per top-level function of each (Python) file."""
    from marlstone.functions.code import functions_of

    return files.withColumn("function", F.explode(functions_of(F.col(content))))
