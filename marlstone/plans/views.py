"""The supplied tables as the engine's own: detections, executions, samples and problems.

Each view comes with the SQL that an oracle uses for the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import read_table

DETECTIONS = """det AS (SELECT event_id AS sample_id, 'fam' || (user_id % 3)::VARCHAR || '/' || user_id::VARCHAR AS problem_key, 'ds' || (user_id % 4)::VARCHAR AS dataset,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'NOT_APPLICABLE' ELSE 'OK' END AS status,
    CASE WHEN event_id % 17 = 0 THEN 'FAILED' ELSE 'OK' END AS embed_status, value AS score, event_type AS subject, event_id % 6 AS sample_index, props AS extra_json, user_id, ts FROM events)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output: error rows failed, sign-ups don't apply, views are the negatives."""
    e = read_table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "NOT_APPLICABLE").otherwise("OK")
    return e.select(
        F.col("event_id").alias("sample_id"), F.concat(F.lit("fam"), F.col("user_id") % 3, F.lit("/"), "user_id").alias("problem_key"), F.concat(F.lit("ds"), F.col("user_id") % 4).alias("dataset"),
        status.alias("status"), F.when(F.col("event_id") % 17 == 0, "FAILED").otherwise("OK").alias("embed_status"), F.col("value").alias("score"), F.col("event_type").alias("subject"),
        (F.col("event_id") % 6).alias("sample_index"), F.col("props").alias("extra_json"), "user_id", "ts",
    )


EXECUTIONS = """ex AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS sample_id, 'p/' || l_partkey::VARCHAR AS problem_key, l_linenumber AS sample_index, 'ds' || (l_suppkey % 4)::VARCHAR AS dataset,
    CASE l_returnflag WHEN 'R' THEN 'PASSED' WHEN 'A' THEN 'FAILED' ELSE 'TIMEOUT' END AS status, l_linestatus AS side, l_orderkey, l_partkey, l_suppkey, l_quantity AS loc, l_extendedprice AS elapsed_s FROM lineitem)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test outcomes: returned lines passed, accepted ones failed, the others timed out."""
    item = read_table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "PASSED").when(F.col("l_returnflag") == "A", "FAILED").otherwise("TIMEOUT")
    return item.select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("sample_id"), F.concat(F.lit("p/"), "l_partkey").alias("problem_key"), F.col("l_linenumber").alias("sample_index"), F.concat(F.lit("ds"), F.col("l_suppkey") % 4).alias("dataset"),
        status.alias("status"), F.col("l_linestatus").alias("side"), "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").alias("loc"), F.col("l_extendedprice").alias("elapsed_s"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


PROBLEMS = "pr AS (SELECT 'fam' || (o_custkey % 5)::VARCHAR || '/' || o_orderkey::VARCHAR AS problem_key, o_orderkey, o_custkey, o_orderpriority AS level, o_totalprice AS seconds FROM orders)"


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of five families, one for each order."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("fam"), F.col("o_custkey") % 5, F.lit("/"), "o_orderkey").alias("problem_key"), "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("seconds"))
