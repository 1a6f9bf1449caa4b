"""Queries over detections and executions: predicates, rates, thresholds, intervals, selection, reports.

Keys begin with the inventory's operator ids. Doubles that depend on the order of a sum are rounded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import hashing, scores
from marlstone.operators import gates, metrics, reports, selection, stats
from marlstone.plans.views import DETECTIONS, EXECUTIONS, PROBLEMS, detections, executions, problems
from marlstone.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


HIT = "coalesce(status = 'OK' AND embed_status IS DISTINCT FROM 'FAILED' AND score >= tau, false)"
TAU = """t AS (SELECT coalesce(min(CASE WHEN c * 1.0 / n <= 0.01 THEN score END), 'infinity'::DOUBLE) AS tau, max(n) AS n, coalesce(max(CASE WHEN c * 1.0 / n <= 0.01 THEN (c::DOUBLE / n) END), 0) AS achieved
    FROM (SELECT score, sum(count(*)) OVER (ORDER BY score DESC)::BIGINT AS c, sum(count(*)) OVER ()::BIGINT AS n FROM det WHERE subject = 'view' GROUP BY score))"""


def _threshold(d):
    return stats.fit_threshold(d.where("subject = 'view'"), [], target=0.01)


@query(
    "d10_calibrated_detection",
    f"""WITH {DETECTIONS}, {TAU}, h AS (SELECT *, {HIT} AS hit FROM det, t WHERE subject <> 'view' AND status <> 'NOT_APPLICABLE')
    SELECT dataset, count(*) FILTER (hit) AS detected, count(*) AS positives, avg(hit::INT)::DOUBLE AS tpr, max(tau) AS threshold FROM h GROUP BY dataset""",
)
def d10(spark, sf_dir):
    """The flagship: a threshold from the negatives at 1 % false positives, then the detection rate of each dataset."""
    d = detections(spark, sf_dir)
    joined = d.where("subject <> 'view'").crossJoin(F.broadcast(_threshold(d).select("threshold")))  # one row
    rates = metrics.detection_rate(joined, ["dataset", "threshold"], F.col("threshold"))
    return rates.select("dataset", "detected", "positives", "tpr", "threshold")


@query("m1_threshold", f"WITH {DETECTIONS}, {TAU} SELECT tau AS threshold, achieved AS achieved_fpr, n AS n_negatives, n < 1000 AS underpowered FROM t")
def m1(spark, sf_dir):
    return _threshold(detections(spark, sf_dir))


@query(
    "m1_threshold_by_dataset",
    f"""WITH {DETECTIONS}, c AS (SELECT dataset, score, sum(count(*)) OVER (PARTITION BY dataset ORDER BY score DESC)::BIGINT AS c, sum(count(*)) OVER (PARTITION BY dataset)::BIGINT AS n FROM det WHERE subject = 'view' GROUP BY dataset, score)
    SELECT dataset, coalesce(min(CASE WHEN c::DOUBLE / n <= 0.05 THEN score END), 'infinity'::DOUBLE) AS threshold, coalesce(max(CASE WHEN c::DOUBLE / n <= 0.05 THEN c::DOUBLE / n END), 0) AS achieved_fpr, max(n) AS n_negatives, max(n) < 1000 AS underpowered FROM c GROUP BY dataset""",
)
def m1_by(spark, sf_dir):
    return stats.fit_threshold(detections(spark, sf_dir).where("subject = 'view'"), ["dataset"], target=0.05)


@query("p1_detected", f"WITH {DETECTIONS} SELECT sample_id, coalesce(status = 'OK' AND embed_status IS DISTINCT FROM 'FAILED' AND score >= 25.0, false) AS hit FROM det")
def p1(spark, sf_dir):
    return detections(spark, sf_dir).select("sample_id", scores.detected(F.col("score"), F.col("status"), F.col("embed_status"), 25.0).alias("hit"))


@query("p3_floored_scores", f"WITH {DETECTIONS} SELECT sample_id, CASE WHEN status <> 'OK' OR embed_status = 'FAILED' THEN '-infinity'::DOUBLE ELSE score END AS floored FROM det")
def p3(spark, sf_dir):
    return detections(spark, sf_dir).select("sample_id", scores.floored(F.col("score"), F.col("status"), F.col("embed_status")).alias("floored"))


@query("p6_primary_view", f"WITH {DETECTIONS} SELECT sample_id, json_extract_string(extra_json, '$.k')::DOUBLE AS score, score AS native_score, status FROM det")
def p6(spark, sf_dir):
    return scores.primary_view(detections(spark, sf_dir), "k").select("sample_id", "score", "native_score", "status")


@query("p7_secondary_view", f"WITH {DETECTIONS}, v AS (SELECT *, CASE WHEN json_extract_string(extra_json, '$.k')::INT < 90 THEN json_extract_string(extra_json, '$.k')::DOUBLE END AS x FROM det) SELECT sample_id, x AS score, CASE WHEN x IS NULL AND status = 'OK' THEN 'FAILED' ELSE status END AS status FROM v")
def p7(spark, sf_dir):
    k = F.get_json_object("extra_json", "$.k").cast("int")
    return scores.secondary_view(detections(spark, sf_dir), F.when(k < 90, k)).select("sample_id", "score", "status")


@query("p8_flag_share", "SELECT event_id, CASE WHEN n = 0 THEN NULL ELSE t::DOUBLE / n END AS share FROM (SELECT event_id, 3 AS n, (event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT AS t FROM events)")
def p8(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    flags = F.to_json(F.create_map(F.lit("a"), F.col("event_id") % 2 == 0, F.lit("b"), F.col("event_id") % 3 == 0, F.lit("c"), F.col("event_id") % 5 == 0, F.lit("spaces"), F.col("event_id") % 7 == 0))
    return e.select("event_id", scores.flag_share(flags, ["spaces"]).alias("share"))


@query("p16_restatus", f"WITH {EXECUTIONS} SELECT CASE WHEN status = 'TIMEOUT' AND side = 'F' THEN 'SYNTAX_ERROR' ELSE status END AS status, count(*) AS n FROM ex GROUP BY 1")
def p16(spark, sf_dir):
    e = executions(spark, sf_dir)
    return e.groupBy(F.when((F.col("status") == "TIMEOUT") & F.startswith("side", F.lit("F")), "SYNTAX_ERROR").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("p25_shown", f"""WITH {EXECUTIONS}, a AS (SELECT dataset, avg(loc) AS v, min(loc) AS lo, max(loc) AS hi FROM ex GROUP BY dataset) SELECT dataset, printf('%.1f [%.1f, %.1f]', v, lo, hi) AS shown FROM a""")
def p25(spark, sf_dir):
    a = executions(spark, sf_dir).groupBy("dataset").agg(F.avg("loc").alias("v"), F.min("loc").alias("lo"), F.max("loc").alias("hi"))
    return a.select("dataset", scores.shown(F.col("v"), F.col("lo"), F.col("hi"), 1).alias("shown"))


@query("a1_pass_at_1", f"WITH {EXECUTIONS}, s AS (SELECT dataset, problem_key, avg((status = 'PASSED')::INT) AS share FROM ex GROUP BY ALL) SELECT dataset, round(avg(share), 9) AS pass_at_1, count(*) AS problems FROM s GROUP BY dataset")
def a1(spark, sf_dir):
    return metrics.pass_at_1(executions(spark, sf_dir), ["dataset"]).withColumn("pass_at_1", F.round("pass_at_1", 9))


@query("a4_fpr_by_part", f"WITH {DETECTIONS}, {TAU} SELECT dataset AS part, avg((score >= tau)::INT)::DOUBLE AS fpr, count(*) AS n FROM det, t WHERE subject = 'view' GROUP BY dataset")
def a4(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.where("subject = 'view'").crossJoin(F.broadcast(_threshold(d).select("threshold"))).groupBy(F.col("dataset").alias("part")).agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("fpr"), F.count("*").alias("n"))


@query("a6_rates_by_level", f"WITH {DETECTIONS} SELECT subject, dataset, avg((score >= 25)::INT)::DOUBLE AS rate, count(*) AS n, grouping(dataset)::INT AS whole FROM det GROUP BY GROUPING SETS ((subject, dataset), (subject))")
def a6(spark, sf_dir):
    return metrics.rates_by_level(detections(spark, sf_dir), "subject", "dataset", F.col("score") >= 25).withColumn("whole", F.col("whole").cast("int"))


@query(
    "a7_auroc",
    f"""WITH {DETECTIONS}, c AS (SELECT dataset, score, count(*) FILTER (subject = 'purchase') AS p, count(*) FILTER (subject = 'view') AS n FROM det WHERE subject IN ('purchase', 'view') GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY score) AS cn FROM c)
    SELECT dataset, sum(p * (cn - n * 0.5::DOUBLE)) / (sum(p)::DOUBLE * sum(n)) AS auroc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM r GROUP BY dataset""",
)
def a7(spark, sf_dir):
    d = detections(spark, sf_dir).where("subject in ('purchase', 'view')")
    return stats.auroc(d, ["dataset"], "score", F.col("subject") == "purchase")


@query("a8_paired_difference", f"WITH {EXECUTIONS}, s AS (SELECT problem_key, avg((status = 'PASSED')::INT) FILTER (side = 'F') AS a, avg((status = 'PASSED')::INT) FILTER (side = 'O') AS b FROM ex GROUP BY problem_key) SELECT count(*) AS problems, round(100 * avg(b - a), 6) AS delta_pp FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def a8(spark, sf_dir):
    e = executions(spark, sf_dir).withColumn("passed", F.when(F.col("status") == "PASSED", 1.0).otherwise(0.0))
    d = metrics.paired_difference(e.where("side = 'O'"), e.where("side = 'F'"), "problem_key", "passed")
    return d.agg(F.count("*").alias("problems"), F.round(100 * F.avg("difference"), 6).alias("delta_pp"))


@query("a9_conditional_preservation", f"WITH {EXECUTIONS}, b AS (SELECT DISTINCT ON (l_orderkey) l_orderkey, status FROM ex ORDER BY l_orderkey, sample_index, l_partkey, l_suppkey, loc) SELECT avg((e.status = 'PASSED')::INT)::DOUBLE AS preserved, count(*) AS n, count(DISTINCT e.problem_key) AS problems FROM ex e JOIN b ON e.l_orderkey = b.l_orderkey AND b.status = 'PASSED'")
def a9(spark, sf_dir):
    e = executions(spark, sf_dir)
    first = e.groupBy("l_orderkey").agg(F.min_by("status", F.struct("sample_index", "l_partkey", "l_suppkey", "loc")).alias("status"))
    return metrics.conditional_preservation(first.withColumnRenamed("l_orderkey", "sample_id"), e.withColumnRenamed("l_orderkey", "parent_id").drop("sample_id"), "problem_key")


@query("a10_capacity", "WITH b AS (SELECT 'ds' || (user_id % 4)::VARCHAR AS dataset, event_type <> 'error' AS ok, event_id % 13 AS bits FROM events) SELECT dataset, round(avg((ok AND bits = 12)::INT)::DOUBLE, 9) AS exact, round(avg(CASE WHEN ok THEN bits / 12.0::DOUBLE ELSE 0 END), 9) AS bit_accuracy, round(avg(ok::INT)::DOUBLE, 9) AS ok_rate FROM b GROUP BY dataset")
def a10(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("status", F.when(F.col("subject") == "error", "FAILED").otherwise("OK")).withColumn("bits_correct", F.col("sample_id") % 13)
    out = metrics.capacity(d, ["dataset"])
    return out.select("dataset", *[F.round(c, 9).alias(c) for c in ("exact", "bit_accuracy", "ok_rate")])


@query("a12_status_histogram", f"WITH {EXECUTIONS}, k AS (SELECT unnest(['PASSED','FAILED','SYNTAX_ERROR','COMPILE_ERROR','RUNTIME_ERROR','TIMEOUT','NO_TESTS','EXTRACTION_FAILED','SANDBOX_ERROR']) AS status) SELECT k.status, count(ex.status) AS n FROM k LEFT JOIN ex USING (status) GROUP BY k.status")
def a12(spark, sf_dir):
    return metrics.status_histogram(executions(spark, sf_dir))


@query("a13_score_summary", f"WITH {DETECTIONS} SELECT subject, count(score) AS n, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max FROM det GROUP BY subject")
def a13(spark, sf_dir):
    return metrics.score_summary(detections(spark, sf_dir), ["subject"]).withColumn("mean", F.round("mean", 6))


@query("a15_loc_statistics", f"WITH {EXECUTIONS} SELECT dataset, count(loc) AS n, round(avg(loc), 6) AS mean, round(stddev_pop(loc), 6) AS sd, min(loc) AS min, max(loc) AS max FROM ex GROUP BY dataset")
def a15(spark, sf_dir):
    return metrics.spread(executions(spark, sf_dir), ["dataset"], "loc").withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(
    "a16_funnel",
    f"""WITH {EXECUTIONS}, c AS (SELECT count(*) AS a, count(*) FILTER (status <> 'TIMEOUT') AS b, count(*) FILTER (status <> 'TIMEOUT' AND loc >= 10) AS c, count(*) FILTER (status <> 'TIMEOUT' AND loc >= 10 AND side = 'F') AS d FROM ex)
    SELECT 0 AS step, 'all' AS name, a AS remaining FROM c UNION ALL SELECT 1, 'ran', b FROM c UNION ALL SELECT 2, 'long enough', c FROM c UNION ALL SELECT 3, 'final', d FROM c""",
)
def a16(spark, sf_dir):
    return metrics.funnel(executions(spark, sf_dir), [("ran", F.col("status") != "TIMEOUT"), ("long enough", F.col("loc") >= 10), ("final", F.col("side") == "F")])


@query("a19_distinct_per_problem", f"WITH {EXECUTIONS}, d AS (SELECT problem_key, count(DISTINCT loc) AS n FROM ex GROUP BY problem_key) SELECT round(avg(n), 9) AS mean_distinct, count(*) AS problems FROM d")
def a19(spark, sf_dir):
    return executions(spark, sf_dir).groupBy("problem_key").agg(F.countDistinct("loc").alias("n")).agg(F.round(F.avg("n"), 9).alias("mean_distinct"), F.count("*").alias("problems"))


@query("a20_always_passing", f"WITH {EXECUTIONS} SELECT dataset, count(*) FILTER (every) AS always, count(*) AS problems, max(reps) AS most_repetitions FROM (SELECT dataset, problem_key, bool_and(status = 'PASSED') AS every, count(DISTINCT sample_index) AS reps FROM ex GROUP BY ALL) GROUP BY dataset")
def a20(spark, sf_dir):
    each = executions(spark, sf_dir).groupBy("dataset", "problem_key").agg(F.bool_and(F.col("status") == "PASSED").alias("every"), F.countDistinct("sample_index").alias("reps"))
    return each.groupBy("dataset").agg(F.count_if("every").alias("always"), F.count("*").alias("problems"), F.max("reps").alias("most_repetitions"))


@query(
    "a22_median_with_fallback",
    f"""WITH {EXECUTIONS}, w AS (SELECT DISTINCT dataset, sample_index FROM ex UNION SELECT 'ds0', 99 UNION SELECT 'none', 99),
    a AS (SELECT dataset, sample_index, median(elapsed_s) AS m FROM ex GROUP BY ALL), b AS (SELECT dataset, median(elapsed_s) AS m FROM ex GROUP BY ALL), c AS (SELECT median(elapsed_s) AS m FROM ex)
    SELECT w.dataset, w.sample_index, coalesce(a.m, b.m, c.m) AS median, CASE WHEN a.m IS NOT NULL THEN 0 WHEN b.m IS NOT NULL THEN 1 ELSE 2 END AS level FROM w LEFT JOIN a USING (dataset, sample_index) LEFT JOIN b USING (dataset), c""",
)
def a22(spark, sf_dir):
    e = executions(spark, sf_dir)
    extra = spark.createDataFrame([("ds0", 99), ("none", 99)], "dataset string, sample_index int")
    return metrics.median_with_fallback(e, [["dataset", "sample_index"], ["dataset"], []], "elapsed_s", e.select("dataset", "sample_index").distinct().unionByName(extra))


@query("a23_efficiency", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) SELECT event_type AS phase, count(*) AS samples, round(sum(value) / count(*), 6) AS seconds_per_sample FROM r WHERE n = 1 GROUP BY event_type")
def a23(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.lit(0).alias("sample_index"), F.col("event_type").alias("phase"), F.col("event_id").alias("line"), F.col("value").alias("elapsed_s"))
    return reports.efficiency(e, ["phase"]).withColumn("seconds_per_sample", F.round("seconds_per_sample", 6))


def _a25(e):
    means = metrics.gap_means(e.where("side = 'F'"), e.where("side = 'O'"), "problem_key", "loc")
    return means.where("cross_mean is not null and within_mean is not null").select("problem_key", F.round("cross_mean", 6).alias("cross_mean"), F.round("within_mean", 6).alias("within_mean"))


@query(
    "a25_cross_and_within_mean",
    f"""WITH {EXECUTIONS}, m AS (SELECT row_number() OVER (ORDER BY l_orderkey, sample_index, l_suppkey, loc, elapsed_s) AS id, * FROM ex),
    c AS (SELECT problem_key, avg(d) AS v FROM (SELECT a.problem_key, a.id, avg(abs(a.loc - b.loc)) AS d FROM m a JOIN m b ON a.problem_key = b.problem_key AND a.side = 'F' AND b.side = 'O' GROUP BY ALL) GROUP BY problem_key),
    w AS (SELECT problem_key, avg(d) AS v FROM (SELECT a.problem_key, a.id, avg(abs(a.loc - b.loc)) AS d FROM m a JOIN m b ON a.problem_key = b.problem_key AND a.side = 'O' AND b.side = 'O' AND a.id <> b.id GROUP BY ALL) GROUP BY problem_key)
    SELECT problem_key, round(c.v, 6) AS cross_mean, round(w.v, 6) AS within_mean FROM c JOIN w USING (problem_key)""",
)
def a25(spark, sf_dir):
    return _a25(executions(spark, sf_dir))


@query("a29_four_way", f"WITH {DETECTIONS}, x AS (SELECT dataset, score >= 20 AS a, json_extract_string(extra_json, '$.k')::INT >= 50 AS b FROM det) SELECT dataset, avg((a AND b)::INT)::DOUBLE AS \"both\", avg((a AND NOT b)::INT)::DOUBLE AS only_first, avg((NOT a AND b)::INT)::DOUBLE AS only_second, avg((NOT a AND NOT b)::INT)::DOUBLE AS neither, count(*) AS n FROM x GROUP BY dataset")
def a29(spark, sf_dir):
    return metrics.four_way(detections(spark, sf_dir), ["dataset"], F.col("score") >= 20, F.get_json_object("extra_json", "$.k").cast("int") >= 50)


@query("a30_overlap_bins", "WITH x AS (SELECT len(list_intersect(list_distinct([event_id % 5, event_id % 7, event_id % 11, event_id % 13]), list_distinct([user_id % 5, user_id % 7, user_id % 11, user_id % 13]))) AS o, value >= 25 AS h FROM events) SELECT least(o, 3)::INT AS overlap, count(*) AS n, avg(h::INT)::DOUBLE AS share FROM x GROUP BY 1")
def a30(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    rules = lambda c: F.array_distinct(F.array(*[F.col(c) % m for m in (5, 7, 11, 13)]))
    return metrics.overlap_bins(e.withColumn("a", rules("event_id")).withColumn("b", rules("user_id")), "a", "b", F.col("value") >= 25)


@query("a31_rule_set", "SELECT DISTINCT unnest(json_keys(props)) AS rule FROM events")
def a31(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("rule")).distinct()


@query("a34_pivot", f"WITH {DETECTIONS} SELECT dataset, count(*) FILTER (subject = 'click') AS click, count(*) FILTER (subject = 'error') AS error, count(*) FILTER (subject = 'purchase') AS purchase FROM det GROUP BY dataset")
def a34(spark, sf_dir):
    long = detections(spark, sf_dir).groupBy("dataset", F.col("subject").alias("metric")).agg(F.count("*").alias("value"))
    return metrics.pivot_first(long, ["dataset"], ["click", "error", "purchase"])


@query("a36_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a36(spark, sf_dir):
    return metrics.repeated_keys(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_Z = 1.959963984540054


@query(
    "m2_wilson",
    f"""WITH {EXECUTIONS}, c AS (SELECT dataset, count(*) FILTER (status = 'PASSED') AS k, count(*)::DOUBLE AS n FROM ex GROUP BY dataset), q AS (SELECT *, k / n AS p FROM c)
    SELECT dataset, k AS successes, round((p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n), 9) AS low,
    round((p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n), 9) AS high FROM q""",
)
def m2(spark, sf_dir):
    c = executions(spark, sf_dir).groupBy("dataset").agg(F.count_if(F.col("status") == "PASSED").alias("successes"), F.count("*").alias("n"))
    return c.withColumn("w", scores.wilson(F.col("successes"), F.col("n"))).select("dataset", "successes", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query("m3_clopper_pearson")
def m3(spark, sf_dir):
    """Exact tails have no closed form in SQL: held against known values in the tests."""
    c = executions(spark, sf_dir).groupBy("problem_key").agg(F.count_if(F.col("status") == "PASSED").alias("successes"), F.count("*").alias("n"))
    return c.withColumn("ci", scores.clopper_pearson(F.col("successes"), F.col("n"))).select("problem_key", "successes", "n", "ci.low", "ci.high")


def _seed_sql(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 16))::UBIGINT % 2147483647)::BIGINT"


@query(
    "m6_ratio_interval",
    f"""WITH {DETECTIONS}, s AS (SELECT dataset, user_id, sum((score >= 25)::INT)::DOUBLE AS hits, count(*) AS rows FROM det GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY user_id) - 1 AS j, count(*) OVER (PARTITION BY dataset) AS k FROM s),
    d AS (SELECT dataset, r.replicate, {_seed_sql("'ratio|42|' || r.replicate::VARCHAR || '|' || j::VARCHAR")} % k AS pick FROM n, (SELECT unnest(range(200)) AS replicate) r),
    v AS (SELECT d.dataset, d.replicate, sum(n.hits) / sum(n.rows) AS v FROM d JOIN n ON d.dataset = n.dataset AND d.pick = n.j GROUP BY ALL),
    b AS (SELECT dataset, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY dataset), p AS (SELECT dataset, sum(hits) / sum(rows) AS value, sum(rows)::BIGINT AS n FROM s GROUP BY dataset)
    SELECT dataset, round(value, 9) AS value, n, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high FROM p JOIN b USING (dataset)""",
)
def m6(spark, sf_dir):
    return _m6(spark, sf_dir, n=200, resampled=stats.replicates)  # the replicates of its SQL


@query("m6_ratio_interval_2000")
def m6_whole(spark, sf_dir):
    """The operator's own number of replicates; SQL of that size is too slow."""
    return _m6(spark, sf_dir)


def _m6(spark, sf_dir, **replicates):
    out = stats.ratio_interval(detections(spark, sf_dir), ["dataset"], "user_id", F.col("score") >= 25, **replicates)
    return out.select("dataset", F.round("value", 9).alias("value"), "n", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query(
    "m9_median_interval",
    f"""WITH {DETECTIONS}, s AS (SELECT dataset, user_id, avg(score) AS m FROM det GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY user_id) - 1 AS j, count(*) OVER (PARTITION BY dataset) AS k FROM s),
    d AS (SELECT dataset, r.replicate, {_seed_sql("'median|42|' || r.replicate::VARCHAR || '|' || j::VARCHAR")} % k AS pick FROM n, (SELECT unnest(range(100)) AS replicate) r),
    v AS (SELECT d.dataset, d.replicate, median(n.m) AS v FROM d JOIN n ON d.dataset = n.dataset AND d.pick = n.j GROUP BY ALL)
    SELECT dataset, round(any_value(p.value), 6) AS value, any_value(p.n) AS n, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM v JOIN (SELECT dataset, median(m) AS value, count(*) AS n FROM s GROUP BY dataset) p USING (dataset) GROUP BY dataset""",
)
def m9(spark, sf_dir):
    return _m9(spark, sf_dir, n=100, resampled=stats.drawn_medians)  # the replicates of its SQL


@query("m9_median_interval_1000")
def m9_whole(spark, sf_dir):
    """The operator's own number of replicates; SQL of that size is too slow."""
    return _m9(spark, sf_dir)


def _m9(spark, sf_dir, **replicates):
    out = stats.statistic_interval(detections(spark, sf_dir), ["dataset"], "user_id", "score", **replicates)
    return out.select("dataset", F.round("value", 6).alias("value"), "n", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("m5_auroc_interval")
def m5(spark, sf_dir):
    d = detections(spark, sf_dir).where("subject in ('purchase', 'view')")
    return stats.auroc_interval(d, ["dataset"], "user_id", "score", F.col("subject") == "purchase", n=1000, resampled=stats.split_areas)


@query(
    "m12_ks",
    f"""WITH {DETECTIONS}, c AS (SELECT dataset, score, count(*) FILTER (subject = 'purchase') AS p, count(*) FILTER (subject = 'view') AS n FROM det WHERE subject IN ('purchase', 'view') GROUP BY ALL),
    r AS (SELECT dataset, sum(p) OVER w::DOUBLE / sum(p) OVER (PARTITION BY dataset) AS a, sum(n) OVER w::DOUBLE / sum(n) OVER (PARTITION BY dataset) AS b FROM c WINDOW w AS (PARTITION BY dataset ORDER BY score))
    SELECT dataset, round(max(abs(a - b)), 9) AS ks FROM r GROUP BY dataset""",
)
def m12(spark, sf_dir):
    d = detections(spark, sf_dir).where("subject in ('purchase', 'view')")
    return stats.ks(d, ["dataset"], "score", F.col("subject") == "purchase").withColumn("ks", F.round("ks", 9))


@query(
    "w13_roc_points",
    f"""WITH {DETECTIONS}, c AS (SELECT score, count(*) FILTER (subject = 'purchase') AS p, count(*) FILTER (subject = 'view') AS n FROM det WHERE subject IN ('purchase', 'view') GROUP BY ALL)
    SELECT score, round(sum(p) OVER w::DOUBLE / sum(p) OVER (), 9) AS tpr, round(sum(n) OVER w::DOUBLE / sum(n) OVER (), 9) AS fpr FROM c WINDOW w AS (ORDER BY score DESC)""",
)
def w13(spark, sf_dir):
    d = detections(spark, sf_dir).where("subject in ('purchase', 'view')")
    return stats.roc_points(d, [], "score", F.col("subject") == "purchase").select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("m13_group_folds", f"WITH {DETECTIONS}, g AS (SELECT user_id, 2 * count(*) FILTER (subject = 'view') >= count(*) AS kind FROM det GROUP BY user_id), f AS (SELECT user_id, ((row_number() OVER (PARTITION BY kind ORDER BY {_seed_sql("'fold|42|' || user_id::VARCHAR")}, user_id) - 1) % 5)::INT AS fold FROM g) SELECT fold, count(*) AS rows, count(DISTINCT user_id) AS groups FROM det JOIN f USING (user_id) GROUP BY fold")
def m13(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("label", F.when(F.col("subject") == "view", 1).otherwise(0))
    return stats.group_folds(d, "user_id", "label").groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("groups"))


@query("m14_fold_violations", "SELECT user_id, 2::BIGINT AS folds FROM events WHERE false")
def m14(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("label", F.when(F.col("subject") == "view", 1).otherwise(0))
    return stats.fold_violations(stats.group_folds(d, "user_id", "label"), "user_id")


@query("m21_neg_log10", "SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'infinity'::DOUBLE ELSE round(-log10((event_id % 100) / 1000.0::DOUBLE), 9) END AS score FROM events")
def m21(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.round(scores.neg_log10((F.col("event_id") % 100) / F.lit(1000.0)), 9).alias("score"))


@query("m20_adaptive_p")
def m20(spark, sf_dir):
    c = executions(spark, sf_dir).groupBy("problem_key").agg(F.count_if(F.col("status") == "PASSED").alias("green"), F.count("*").alias("total"))
    return c.withColumn("p", scores.adaptive_p(F.col("green"), F.col("total"), 0.25))


@query("m22_green_z", f"WITH {EXECUTIONS}, c AS (SELECT problem_key, count(*) FILTER (status = 'PASSED') AS g, count(*)::DOUBLE AS n FROM ex GROUP BY problem_key) SELECT problem_key, round((g - 0.25 * n) / sqrt(n * 0.25 * 0.75), 9) AS z FROM c")
def m22(spark, sf_dir):
    c = executions(spark, sf_dir).groupBy("problem_key").agg(F.count_if(F.col("status") == "PASSED").alias("g"), F.count("*").alias("n"))
    return c.select("problem_key", F.round(scores.green_z(F.col("g"), F.col("n"), 0.25), 9).alias("z"))


_BITS = "lpad(bin({x} % 4096), 12, '0')"


@query("m24_bit_matches", f"WITH b AS (SELECT event_id, {_BITS.format(x='event_id')} AS a, {_BITS.format(x='user_id * 31')} AS b FROM events) SELECT event_id, list_sum(list_transform(range(1, 13), lambda i: (substr(a, i, 1) = substr(b, i, 1))::INT))::INT AS matches FROM b")
def m24(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", scores.bit_matches(hashing.message_bits(F.col("event_id")), hashing.message_bits(F.col("user_id") * 31)).alias("matches"))


@query(
    "m26_decode_rounds",
    f"""WITH b AS (SELECT event_id, substr({_BITS.format(x='event_id')} || {_BITS.format(x='user_id * 31')} || {_BITS.format(x='event_id * 7')} || {_BITS.format(x='user_id')}, 1, (event_id % 49)::INT) AS bits FROM events)
    SELECT event_id, array_to_string(list_transform(range(0, length(bits) // 24), lambda r: array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN substr(bits, r * 24 + i, 1) = substr(bits, r * 24 + 12 + i, 1) THEN '0' ELSE '1' END), '')), ',') AS rounds FROM b""",
)
def m26(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    m = hashing.message_bits
    bits = F.substr(F.concat(m(F.col("event_id")), m(F.col("user_id") * 31), m(F.col("event_id") * 7), m(F.col("user_id"))), F.lit(1), (F.col("event_id") % 49).cast("int"))
    return e.select("event_id", F.array_join(scores.decode_rounds(bits), ",").alias("rounds"))


_M27 = _seed_sql("'42|' || c_custkey::VARCHAR || '|python'")


@query("m27_message_bits", f"SELECT c_custkey, lpad(bin({_M27} % 4096), 12, '0') AS bits FROM customer")
def m27(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", hashing.message_bits(hashing.seed(F.lit(42), F.col("c_custkey"), F.lit("python"))).alias("bits"))


_CANDIDATES = """ca AS (SELECT p_brand AS method, p_type AS model_id, 'python' AS language, md5(p_partkey::VARCHAR) AS config_hash, (p_size * 2)::DOUBLE / 100 AS tpr_dev, (floor(p_retailprice)::BIGINT % 7)::DOUBLE AS pass1_drop_pp FROM part)"""


def _candidates(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("method"), F.col("p_type").alias("model_id"), F.lit("python").alias("language"), F.md5(F.col("p_partkey").cast("string")).alias("config_hash"), ((F.col("p_size") * 2).cast("double") / 100).alias("tpr_dev"), (F.floor("p_retailprice").cast("long") % 7).cast("double").alias("pass1_drop_pp"))


@query(
    "t1_constrained_best",
    f"""WITH {_CANDIDATES}, r AS (SELECT *, pass1_drop_pp <= 3 AS constraint_satisfied, count(*) OVER w AS n_candidates, count(*) FILTER (pass1_drop_pp <= 3) OVER w AS n_admissible,
    row_number() OVER (PARTITION BY method, model_id ORDER BY CASE WHEN pass1_drop_pp <= 3 THEN 0 ELSE 1 END, CASE WHEN pass1_drop_pp <= 3 THEN -tpr_dev END NULLS FIRST, pass1_drop_pp, config_hash) AS n FROM ca WINDOW w AS (PARTITION BY method, model_id))
    SELECT * EXCLUDE (n) FROM r WHERE n = 1""",
)
def t1(spark, sf_dir):
    return selection.constrained_best(_candidates(spark, sf_dir), ["method", "model_id"], 3.0)


@query(
    "d12_tuning",
    f"""WITH {EXECUTIONS}, m AS (SELECT dataset AS method, sample_index AS config, count(*) AS n_positives, count(*) FILTER (loc >= 25) AS n_detected, avg((status = 'PASSED')::INT)::DOUBLE AS p FROM ex GROUP BY ALL), b AS (SELECT dataset AS method, avg((status = 'PASSED')::INT)::DOUBLE AS p FROM ex GROUP BY ALL),
    c AS (SELECT method, config, n_positives, n_detected, n_detected::DOUBLE / n_positives AS tpr_dev, round(100 * (b.p - m.p), 9) AS pass1_drop_pp FROM m JOIN b USING (method)),
    r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY CASE WHEN pass1_drop_pp <= 0.2 THEN 0 ELSE 1 END, CASE WHEN pass1_drop_pp <= 0.2 THEN -tpr_dev END NULLS FIRST, pass1_drop_pp, config) AS n FROM c)
    SELECT method, config, n_positives, n_detected, tpr_dev, pass1_drop_pp, pass1_drop_pp <= 0.2 AS constraint_satisfied FROM r WHERE n = 1""",
)
def d12(spark, sf_dir):
    """Tuning: detection and pass rates of each configuration, then the constrained best."""
    e = executions(spark, sf_dir).select(F.col("dataset").alias("method"), F.col("sample_index").alias("config_hash"), "loc", (F.col("status") == "PASSED").cast("double").alias("passed"))
    own = e.groupBy("method", "config_hash").agg(F.count("*").alias("n_positives"), F.count_if(F.col("loc") >= 25).alias("n_detected"), F.avg("passed").alias("p"))
    base = e.groupBy("method").agg(F.avg("passed").alias("b"))
    c = own.join(base, "method").withColumn("tpr_dev", F.col("n_detected") / F.col("n_positives")).withColumn("pass1_drop_pp", F.round(100 * (F.col("b") - F.col("p")), 9))
    best = selection.constrained_best(c, ["method"], 0.2)
    return best.select("method", F.col("config_hash").alias("config"), "n_positives", "n_detected", "tpr_dev", "pass1_drop_pp", "constraint_satisfied")


@query("d13_freeze_violations", f"WITH {_CANDIDATES}, s AS (SELECT method, model_id, min(config_hash) AS h FROM ca GROUP BY ALL) SELECT method, model_id, 'python' AS language, 'no threshold' AS reason FROM s WHERE left(h, 1) = '0' UNION ALL SELECT method, model_id, 'python', 'candidates differ between cells' FROM s")
def d13(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    selected = c.groupBy("method", "model_id", "language").agg(F.min("config_hash").alias("config_hash")).select("*", F.lit(False).alias("provisional"), F.array(F.lit("L1")).alias("levels"), F.lit(False).alias("not_applicable"))
    thresholds = selected.where("left(config_hash, 1) <> '0'").select("method", "model_id", "language", "config_hash", F.lit(1.0).alias("threshold"), F.lit(False).alias("provisional"))
    return gates.freeze_violations(selected, thresholds, c, ["L1"])


@query(
    "w9_replay",
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value, event_type, ts) - 1 AS step, value AS score, event_type <> 'error' AS valid FROM events), k AS (SELECT * FROM s WHERE step < 20),
    c AS (SELECT user_id, coalesce(min(step) FILTER (valid AND score >= 60), arg_max(step, score * 1000000 - step) FILTER (valid), min(step)) AS step, coalesce(max((valid AND score >= 60)::INT), 0) = 1 AS reached FROM k GROUP BY user_id)
    SELECT user_id, step, score, valid, reached FROM k JOIN c USING (user_id, step)""",
)
def w9(spark, sf_dir):
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    steps = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id", "value", "event_type", "ts")) - 1).cast("long").alias("step"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("valid"))
    return selection.replay(steps, ["user_id"], "step", "score", "valid", 20, 60.0).select("user_id", "step", "score", "valid", "reached")


@query("b1_annotated", f"WITH {DETECTIONS}, l AS (SELECT dataset, subject, count(*) AS value FROM det GROUP BY ALL) SELECT dataset, subject, value, concat_ws('; ', CASE WHEN dataset = 'ds1' THEN 'a: one dataset' END, CASE WHEN subject IN ('view', 'error') THEN 'b: two subjects' END, 'c: everywhere') AS deviations FROM l")
def b1(spark, sf_dir):
    long = detections(spark, sf_dir).groupBy("dataset", "subject").agg(F.count("*").alias("value"))
    notes = spark.createDataFrame([(["ds1"], [], "a: one dataset"), ([], ["view", "error"], "b: two subjects"), ([], [], "c: everywhere")], "dataset array<string>, subject array<string>, text string")
    return reports.annotated(long, notes, ["dataset", "subject"])


@query("b3_per_dataset", f"WITH {DETECTIONS} SELECT 'tpr' AS metric, dataset, count(*) FILTER (score >= 25) AS value FROM det GROUP BY dataset")
def b3(spark, sf_dir):
    long = detections(spark, sf_dir).groupBy(F.concat(F.lit("tpr|"), "dataset").alias("metric")).agg(F.count_if(F.col("score") >= 25).alias("value"))
    return reports.per_dataset(long)


@query(
    "b15_parameter_curve",
    f"""WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY method, model_id ORDER BY tpr_dev DESC, config_hash) AS n FROM ca), s AS (SELECT * FROM r WHERE n = 1)
    SELECT r.method, r.model_id, r.language, r.config_hash, r.tpr_dev, r.pass1_drop_pp, r.tpr_dev - lag(r.tpr_dev) OVER (PARTITION BY r.method, r.model_id ORDER BY r.config_hash) AS gain FROM r JOIN s ON r.method = s.method AND r.model_id = s.model_id AND r.pass1_drop_pp = s.pass1_drop_pp""",
)
def b15(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    chosen = c.groupBy("method", "model_id").agg(F.min_by("pass1_drop_pp", F.struct(-F.col("tpr_dev"), "config_hash")).alias("pass1_drop_pp"))
    return reports.parameter_curve(c, chosen, ["method", "model_id"], "config_hash", ["pass1_drop_pp"])


@query("t9_lanes", f"WITH {PROBLEMS}, c AS (SELECT level, round(sum(seconds), 2) AS seconds FROM pr GROUP BY level), n AS (SELECT *, (row_number() OVER (ORDER BY seconds DESC, level) - 1) % 6 AS t FROM c) SELECT level, seconds, (CASE WHEN t < 3 THEN t ELSE 5 - t END)::INT AS lane FROM n")
def t9(spark, sf_dir):
    cells = problems(spark, sf_dir).groupBy("level").agg(F.round(F.sum("seconds"), 2).alias("seconds"))
    return selection.lanes(cells, "level", "seconds", 3)


@query(
    "t10_packed_jobs",
    f"""WITH {PROBLEMS}, c AS (SELECT level, o_custkey, round(sum(seconds), 2) AS seconds FROM pr GROUP BY ALL), m AS (SELECT *, round(seconds * 1000)::BIGINT AS ms FROM c),
    a AS (SELECT *, 2 * ms > 1999000000 AS alone FROM m),
    r AS (SELECT *, sum(CASE WHEN alone THEN 0 ELSE ms END) OVER o - CASE WHEN alone THEN 0 ELSE ms END AS begins, sum(alone::INT) OVER o AS place, sum(alone::INT) OVER (PARTITION BY level) AS larges,
        coalesce(max(CASE WHEN alone THEN NULL ELSE ms END) OVER (PARTITION BY level), 0) AS longest FROM a WINDOW o AS (PARTITION BY level ORDER BY seconds DESC, o_custkey))
    SELECT level, o_custkey, seconds, (CASE WHEN alone THEN place - 1 ELSE larges + floor(begins::DOUBLE / (1999000000 - longest)) END)::INT AS job FROM r""",
)
def t10(spark, sf_dir):
    tasks = problems(spark, sf_dir).groupBy("level", "o_custkey").agg(F.round(F.sum("seconds"), 2).alias("seconds"))
    return selection.packed_jobs(tasks, "level", "o_custkey", "seconds", 2_000_000.0, 1000.0)


@query(
    "t15_critical_path",
    """WITH RECURSIVE s(step, seconds) AS (VALUES ('a', 2.0::DOUBLE), ('b', 3.0), ('c', 1.0), ('d', 4.0)), e(step, needs) AS (VALUES ('b', 'a'), ('c', 'a'), ('d', 'b'), ('d', 'c')),
    p AS (SELECT step, seconds AS finish FROM s UNION ALL SELECT e.step, p.finish + s.seconds FROM p JOIN e ON e.needs = p.step JOIN s ON s.step = e.step)
    SELECT step, max(finish) AS finish FROM p GROUP BY step""",
)
def t15(spark, sf_dir):
    steps = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 1.0), ("d", 4.0)], "step string, seconds double")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "step string, needs string")
    return selection.critical_path(steps, edges)


@query("o14_grid_cost", f"WITH {PROBLEMS} SELECT level, count(*) AS cells, round(sum(seconds) / 3600, 6) AS hours, ceil(round(sum(seconds) / 3600, 6) / 24)::BIGINT AS wall_days FROM pr GROUP BY level")
def o14(spark, sf_dir):
    p = problems(spark, sf_dir).groupBy("level").agg(F.count("*").alias("cells"), F.round(F.sum("seconds") / 3600, 6).alias("hours"))
    return p.withColumn("wall_days", F.ceil(F.col("hours") / 24).cast("long"))
