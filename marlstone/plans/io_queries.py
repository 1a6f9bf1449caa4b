"""Queries over sources, sinks and streams of this package's own, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import users
from marlstone.plans.views import EXECUTIONS, executions
from marlstone.session import new_path, read_table
from marlstone.sources.artifacts import Artifact
from marlstone.sources.growing import GrowingJsonLines
from marlstone.streaming import keyed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("s3_growing_lines", "SELECT event_id, user_id, event_type, value FROM events")
def s3(spark, sf_dir):
    """The events as JSON lines, read in ranges of bytes."""
    spark.dataSource.register(GrowingJsonLines)
    path = new_path(spark, "lines")
    read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props").write.json(path)
    return spark.read.format("growing_json_lines").schema("event_id long, user_id long, event_type string, value double").option("chunk", 1 << 20).load(path)


@query("k1_committed_artifact", "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, -value FROM events WHERE event_type = 'error'")
def k1(spark, sf_dir):
    """Two commits to one artifact, of which readers see both or the first."""
    spark.dataSource.register(Artifact)
    path = new_path(spark, "artifact")
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e.write.format("artifact").mode("append").save(path)
    e.where("event_type = 'error'").withColumn("value", -F.col("value")).write.format("artifact").mode("append").save(path)
    return spark.read.format("artifact").option("verify", "true").load(path)


@query(
    "r8_keyed_results",
    f"""WITH {EXECUTIONS}, r AS (SELECT l_partkey::VARCHAR AS item_id, (l_suppkey % 3)::BIGINT AS sample_index, l_orderkey * 8 + sample_index AS line, status, elapsed_s AS score FROM ex)
    SELECT item_id, sample_index, arg_max(status, line) AS status, arg_max(score, line) AS score FROM r GROUP BY ALL""",
)
def r8(spark, sf_dir):
    """Test outcomes as a stream of several batches: the last line of each key wins, time-outs are asked again once.

    Of outcomes under one line the table's first counts, as in the SQL; the stream gets that one.
    """
    e = executions(spark, sf_dir)
    rows = e.select(F.col("l_partkey").cast("string").alias("item_id"), (F.col("l_suppkey") % 3).cast("long").alias("sample_index"), (F.col("l_orderkey") * 8 + F.col("sample_index")).alias("line"), "status", F.col("elapsed_s").cast("double").alias("score"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    rows = rows.groupBy("item_id", "sample_index", "line").agg(F.min_by(F.struct("status", "score"), "place").alias("r")).select("item_id", "sample_index", "line", "r.*")
    source, state, out = (new_path(spark, x) for x in ("results", "results-state", "results-changes"))
    rows.withColumn("ts", F.timestamp_seconds(F.pmod(F.xxhash64("line"), F.lit(600)))).repartition(3, "line").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    changes = keyed.keyed_results(stream, "ts", "1 hour")

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changes.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return keyed.settled(spark.read.parquet(out)).drop("first_status")


class Drafts(users.PromptFunction):
    """Drafts of a part's name, each a word longer; a name of a certain size fails at its second."""

    def rows_of(self, item_id, prompt, n):
        words = prompt.split(" ")
        for i in range(n):
            if len(words) == 2 and i == 1 and int(item_id) % 2:
                raise ValueError("no second draft")
            yield " ".join(words[: i + 1])


@query(
    "x6_prompt_rows",
    """WITH p AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w, 1 + p_partkey % 3 AS n FROM part),
    r AS (SELECT p_partkey, p_brand, w, unnest(range(0, CASE WHEN len(w) = 2 AND p_partkey % 2 = 1 THEN least(n, 2) ELSE n END))::INT AS sample_index FROM p)
    SELECT p_brand AS partition_key, p_partkey::VARCHAR AS item_id, sample_index, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, sample_index) - 1 AS position,
        CASE WHEN len(w) = 2 AND p_partkey % 2 = 1 AND sample_index = 1 THEN 'no second draft' ELSE array_to_string(w[1:sample_index + 1], ' ') END AS text,
        CASE WHEN len(w) = 2 AND p_partkey % 2 = 1 AND sample_index = 1 THEN 'FAILED' ELSE 'OK' END AS status FROM r""",
)
def x6(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").withColumn("n", 1 + F.col("p_partkey") % 3)
    return users.prompted(p, Drafts, "p_brand", "p_partkey", "p_partkey", "p_name", "n")


@query(
    "x10_mean_interval",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_low,
       round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_high FROM events GROUP BY event_type""",
)
def x10(spark, sf_dir):
    found = users.estimated(read_table(spark, sf_dir, "events"), ["event_type"], users.MeanInterval("value"))
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])
