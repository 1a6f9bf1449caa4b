"""Whole stages and the operators that the other query modules leave: loaders, attacks, metric tables, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import code, hashing, scores, text
from marlstone.operators import metrics, ordered, reports, selection, stats
from marlstone.plans.corpus_queries import _programs
from marlstone.plans.score_queries import HIT, TAU, _seed_sql
from marlstone.plans.views import DETECTIONS, EXECUTIONS, PROBLEMS, detections, documents, executions, problems
from marlstone.session import new_path, read_table
from marlstone.sources import loaders, readers
from marlstone.sources.store import Store
from marlstone.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Loaders


@query("s15_problems", "SELECT 'bench/' || item_id::VARCHAR AS problem_key, 'bench' AS dataset, 'L1' AS level, 'python' AS language, text AS prompt_text, true AS contamination_risk FROM benchmark")
def s15(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    out = loaders.as_problems(b, "bench", "L1", F.lit("python"), F.col("item_id"), F.col("text"), risk=True)
    return out.select("problem_key", "dataset", "level", "language", "prompt_text", "contamination_risk")


@query("s15_negatives", "SELECT 'parts/' || p_partkey::VARCHAR AS problem_key, 'human' AS source, p_name AS code FROM part WHERE p_size > 25")
def s15_negatives(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    out = loaders.as_problems(p, "parts", "L1", F.lit("python"), F.col("p_partkey"), F.col("p_type"), solution=F.when(F.col("p_size") > 25, F.col("p_name")))
    return loaders.negatives_of(out).select("problem_key", "source", "code")


@query("s18_merged_files", "SELECT role, count(*) AS n FROM (SELECT CASE WHEN turn % 2 = 0 THEN 'prompt' ELSE 'test' END AS role FROM conversations) GROUP BY role")
def s18(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    out = loaders.merged_files({"prompt": c.where("turn % 2 = 0"), "test": c.where("turn % 2 = 1")}, "conv_id", "text")
    return out.groupBy("role").agg(F.count("*").alias("n"))


@query("s20_without_excluded", f"WITH {PROBLEMS} SELECT problem_key FROM pr WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def s20(spark, sf_dir):
    p = problems(spark, sf_dir)
    poor = read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return loaders.without(p, p.join(poor, "o_custkey", "left_semi")).select("problem_key")


@query("s21_documented")
def s21(spark, sf_dir):
    kept, dropped = loaders.documented_functions(documents(spark, sf_dir), "text")
    return kept.agg(F.count("*").alias("kept")).crossJoin(dropped.agg(F.count("*").alias("dropped")))  # two single rows


@query("s11_parsed_candidates", "SELECT md5(p_partkey::VARCHAR) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'java' ELSE 'python' END AS repo FROM part WHERE p_partkey % 7 <> 0")
def s11(spark, sf_dir):
    return loaders.parsed_candidates(_programs(spark, sf_dir), "code", "sample_id", "language").select("key", "repo")


@query("s13_file_functions", "SELECT p_partkey::VARCHAR AS sample_id, unnest(['part_' || p_partkey::VARCHAR, 'other']) AS name FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0")
def s13(spark, sf_dir):
    return loaders.file_functions(_programs(spark, sf_dir), "code", "language", ["python"]).select("sample_id", "name")


@query("s24_guarded", "SELECT s_suppkey FROM supplier")
def s24(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    return readers.check_not_excluded(s, s.where("s_suppkey < 0"), "s_suppkey", "suppliers")


@query("s7_documents", "SELECT 'sweep' AS method, 2::BIGINT AS n")
def s7(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    store.write_document("grid", "one", {"method": "sweep", "gamma": [0.25, 0.5]})
    found = store.read_document("grid", "one")
    return spark.createDataFrame([(found["method"], len(found["gamma"]))], "method string, n long")


# Metrics


@query(
    "d19_metrics",
    f"""WITH {DETECTIONS}, {TAU}, h AS (SELECT dataset, subject, {HIT} AS hit, score >= tau AS above FROM det, t WHERE status <> 'NOT_APPLICABLE')
    SELECT dataset, 'tpr' AS metric, round(avg(hit::INT), 9)::DOUBLE AS value, count(*) AS n FROM h WHERE subject <> 'view' GROUP BY dataset
    UNION ALL SELECT dataset, 'fpr', round(avg(above::INT), 9)::DOUBLE, count(*) FROM h WHERE subject = 'view' GROUP BY dataset""",
)
def d19(spark, sf_dir):
    """The metrics stage: one long table of rates per dataset."""
    d = detections(spark, sf_dir)
    tau = F.broadcast(stats.fit_threshold(d.where("subject = 'view'"), [], target=0.01).select("threshold"))  # one row
    cut = d.crossJoin(tau)
    tpr = metrics.detection_rate(cut.where("subject <> 'view'"), ["dataset"], F.col("threshold")).select("dataset", F.lit("tpr").alias("metric"), F.round("tpr", 9).alias("value"), F.col("positives").alias("n"))
    fpr = cut.where("subject = 'view'").groupBy("dataset").agg(F.lit("fpr").alias("metric"), F.round(F.avg((F.col("score") >= F.col("threshold")).cast("double")), 9).alias("value"), F.count("*").alias("n"))
    return tpr.unionByName(fpr)


@query("b2_main_table", f"WITH {DETECTIONS} SELECT dataset, printf('%.3f', avg((score >= 25)::INT) FILTER (subject = 'click')) AS click, printf('%.3f', avg((score >= 25)::INT) FILTER (subject = 'view')) AS view FROM det GROUP BY dataset")
def b2(spark, sf_dir):
    long = detections(spark, sf_dir).groupBy("dataset", F.col("subject").alias("metric")).agg(F.avg((F.col("score") >= 25).cast("double")).alias("value"))
    none = F.lit(None).cast("double")
    return reports.interval_table(long.select("*", none.alias("ci_low"), none.alias("ci_high")), ["dataset"], ["click", "view"])


@query(
    "m8_mean_interval",
    f"""WITH {EXECUTIONS}, s AS (SELECT side, l_suppkey, avg((status = 'PASSED')::INT)::DOUBLE AS m FROM ex GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY l_suppkey) - 1 AS j, count(*) OVER (PARTITION BY side) AS k FROM s),
    d AS (SELECT side, r.replicate, {_seed_sql("'mean|42|' || r.replicate::VARCHAR || '|' || j::VARCHAR")} % k AS pick FROM n, (SELECT unnest(range(100)) AS replicate) r),
    v AS (SELECT d.side, d.replicate, avg(n.m) AS v FROM d JOIN n ON d.side = n.side AND d.pick = n.j GROUP BY ALL)
    SELECT side, round(any_value(p.value), 9) AS value, any_value(p.n) AS n, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM v JOIN (SELECT side, avg(m) AS value, count(*) AS n FROM s GROUP BY side) p USING (side) GROUP BY side""",
)
def m8(spark, sf_dir):
    return _m8(spark, sf_dir, n=100, resampled=stats.replicates)  # the replicates of its SQL


@query("m8_mean_interval_2000")
def m8_whole(spark, sf_dir):
    """The operator's own number of replicates; SQL of that size is too slow."""
    return _m8(spark, sf_dir)


def _m8(spark, sf_dir, **replicates):
    out = stats.mean_interval(executions(spark, sf_dir), ["side"], "l_suppkey", F.when(F.col("status") == "PASSED", 1.0).otherwise(0.0), **replicates)
    return out.select("side", F.round("value", 9).alias("value"), "n", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query("a11_attack_effects", f"WITH {EXECUTIONS} SELECT dataset, round(avg((status <> 'FAILED')::INT), 9)::DOUBLE AS changed, round(avg((status = 'TIMEOUT')::INT), 9)::DOUBLE AS tool_errors, round(avg(loc) FILTER (status <> 'FAILED'), 6) AS mean_distance FROM ex GROUP BY dataset")
def a11(spark, sf_dir):
    e = executions(spark, sf_dir)
    changed = F.col("status") != "FAILED"
    return e.groupBy("dataset").agg(F.round(F.avg(changed.cast("double")), 9).alias("changed"), F.round(F.avg((F.col("status") == "TIMEOUT").cast("double")), 9).alias("tool_errors"), F.round(F.avg(F.when(changed, F.col("loc"))), 6).alias("mean_distance"))


@query("a14_detail_means", "SELECT event_type, 'k' AS detail, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def a14(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("detail", "v"))
    return e.groupBy("event_type", "detail").agg(F.round(F.avg(F.col("v").try_cast("double")), 6).alias("mean"), F.count("*").alias("n"))


@query("a33_fold_auroc", f"WITH {DETECTIONS}, c AS (SELECT user_id % 3 AS fold, score, count(*) FILTER (subject = 'purchase') AS p, count(*) FILTER (subject = 'view') AS n FROM det WHERE subject IN ('purchase', 'view') GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY fold ORDER BY score) AS cn FROM c), a AS (SELECT fold, sum(p * (cn - n * 0.5::DOUBLE)) / (sum(p)::DOUBLE * sum(n)) AS auroc FROM r GROUP BY fold) SELECT round(avg(auroc), 9) AS mean, round(stddev_samp(auroc), 9) AS sd, count(*) AS folds FROM a")
def a33(spark, sf_dir):
    d = detections(spark, sf_dir).where("subject in ('purchase', 'view')").withColumn("fold", F.col("user_id") % 3)
    each = stats.auroc(d, ["fold"], "score", F.col("subject") == "purchase")
    return each.agg(F.round(F.avg("auroc"), 9).alias("mean"), F.round(F.stddev_samp("auroc"), 9).alias("sd"), F.count("*").alias("folds"))


@query("a35_status_means", f"WITH {EXECUTIONS} SELECT status, round(avg(elapsed_s), 4) AS mean FROM ex GROUP BY status")
def a35(spark, sf_dir):
    return executions(spark, sf_dir).groupBy("status").agg(F.round(F.avg("elapsed_s"), 4).alias("mean"))


@query("a24_failures_by_entry", "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'unparsable' WHEN p_size > 25 THEN 'kept' ELSE 'renamed' END AS state, count(*) AS n FROM part GROUP BY 1")
def a24(spark, sf_dir):
    p = _programs(spark, sf_dir).join(read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), "p_size"), "sample_id")
    wanted = F.when(F.col("p_size") > 25, F.lit("other")).otherwise(F.lit("gone"))
    return p.groupBy(code.entry_status(F.col("code"), wanted, F.lit("def other(x):\n    return x\n")).alias("state")).agg(F.count("*").alias("n"))


@query("m25_xor", "SELECT event_id, list_aggregate(list_transform(range(1, 13), lambda i: CASE WHEN substr(lpad(bin(event_id % 4096), 12, '0'), i, 1) = substr(lpad(bin(user_id % 4096), 12, '0'), i, 1) THEN '0' ELSE '1' END), 'string_agg', '') AS bits FROM events")
def m25(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", scores.xor_bits(hashing.message_bits(F.col("event_id")), hashing.message_bits(F.col("user_id"))).alias("bits"))


@query("m23_residual_z", f"WITH {EXECUTIONS}, c AS (SELECT problem_key, count(*) FILTER (status <> 'TIMEOUT') AS g, count(*) FILTER (status = 'FAILED') AS s, count(*)::DOUBLE AS n FROM ex GROUP BY problem_key) SELECT problem_key, round((g - s - 0.25 * n) / sqrt(n * 0.25 * 0.75), 9) AS z FROM c")
def m23(spark, sf_dir):
    c = executions(spark, sf_dir).groupBy("problem_key").agg(F.count_if(F.col("status") != "TIMEOUT").alias("g"), F.count_if(F.col("status") == "FAILED").alias("s"), F.count("*").alias("n"))
    return c.select("problem_key", F.round(scores.residual_z(F.col("g"), F.col("s"), F.col("n"), 0.25), 9).alias("z"))


# Selection and planning


@query("t8_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t8(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("t11_one_per_problem", "SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey ORDER BY l_partkey LIMIT 20")
def t11(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey")).orderBy("l_partkey").limit(20)


@query("t12_half_up", "SELECT o_orderkey, floor((o_orderkey % 50) * 3 / 20.0::DOUBLE + 0.5)::BIGINT AS dev FROM orders")
def t12(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", selection.extra_dev_count(F.col("o_orderkey") % 50, 3, 20).alias("dev"))


@query("u9_attack_grid", "SELECT share, budget, md5('rename|{\"budget\":\"' || budget::VARCHAR || '\",\"share\":\"' || share || '\"}|1') AS digest FROM (SELECT unnest(['0.25', '0.5']) AS share), (SELECT unnest([1, 5])::BIGINT AS budget)")
def u9(spark, sf_dir):
    grid = selection.parameter_grid(spark, {"share": ["0.25", "0.5"], "budget": [1, 5]})
    params = F.create_map(F.lit("share"), F.col("share"), F.lit("budget"), F.col("budget").cast("string"))
    return grid.withColumn("digest", F.md5(F.concat_ws("|", F.lit("rename"), hashing.canonical_json(params), F.lit("1"))))


@query("g4_config_hash", "SELECT n_nationkey, substr(sha256('{\"name\":\"' || n_name || '\"}|2|abc'), 1, 12) AS config_hash FROM nation")
def g4(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", hashing.config_hash(F.create_map(F.lit("name"), F.col("n_name")), "2", "abc").alias("config_hash"))


@query("g12_indexed_quantiles", "SELECT o_orderpriority AS level, list_sort(list(o_totalprice))[1 + floor(0.9 * (count(*) - 1))::INT] AS p90, median(o_totalprice) AS p50 FROM orders GROUP BY 1")
def g12(spark, sf_dir):
    """The value at an index of the sorted list, as an exact percentile of the discrete kind."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), "o_totalprice")
    return stats.indexed_quantiles(o, ["level"], "o_totalprice")


_LANGUAGES = ["python", "cpp", "java", "javascript", "rust"]
_VERSIONS = ["Python (3.8.2)", "PyPy3 (7.3.0)", "Python (2.7.6)", "Python", "C++ (GCC 9.2.1)", "C++20 (GCC 12)", "Visual C++ 2010", "C++ 14 (Clang 10)", "Java8 (OpenJDK)", " JavaScript ", "JavaScript (Node.js 12.16.1)", "JavaScript (V8)", "rust"]


@query(
    "p13_compatible",
    f"""WITH v AS (SELECT o_orderkey, ({_LANGUAGES!r})[1 + (o_orderkey % 5)::INT] AS l, lower(trim(({_VERSIONS!r})[1 + (o_custkey % 13)::INT])) AS v FROM orders)
    SELECT o_orderkey, CASE l WHEN 'python' THEN regexp_matches(v, '(python|pypy)\\s*\\(?\\s*3') WHEN 'cpp' THEN NOT regexp_matches(v, 'msvc|visual|c\\+\\+\\s*20|c\\+\\+2a')
        WHEN 'java' THEN true WHEN 'javascript' THEN contains(v, 'node') OR v = 'javascript' ELSE false END AS fits FROM v""",
)
def p13(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    of = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    return o.select("o_orderkey", text.compatible(of(_LANGUAGES, F.col("o_orderkey")), of(_VERSIONS, F.col("o_custkey"))).alias("fits"))


@query(
    "p18_applicable",
    """WITH p AS (SELECT p_partkey, p_size % 4 AS kind, 'm' || (p_partkey % 3)::VARCHAR AS a, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'java' END AS b FROM part),
    n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'm' || (n_nationkey % 3)::VARCHAR END AS model, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE 'java' END AS language FROM nation)
    SELECT n_nationkey, count(*) AS points FROM p JOIN n ON kind = 0 OR ((model IS NULL OR model = a) AND (language IS NULL OR language = b)) OR (kind = 1 AND (model IS NULL OR model = 'm0') AND (language IS NULL OR language = 'java')) GROUP BY n_nationkey""",
)
def p18(spark, sf_dir):
    """How many grid points hold for each cell: points without a list, with one pair, or with two."""
    pair = lambda m, lang: F.struct(m.alias("model_id"), lang.alias("language"))
    own = pair(F.concat(F.lit("m"), F.col("p_partkey") % 3), F.when(F.col("p_partkey") % 2 == 0, "python").otherwise("java"))
    kind = F.col("p_size") % 4
    cells = F.when(kind == 0, None).when(kind == 1, F.array(own, pair(F.lit("m0"), F.lit("java")))).otherwise(F.array(own))
    points = read_table(spark, sf_dir, "part").groupBy(cells.alias("cells")).agg(F.count("*").alias("n"))  # different lists: few
    n = read_table(spark, sf_dir, "nation")
    asked = n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("m"), F.col("n_nationkey") % 3)).alias("model"), F.when(F.col("n_nationkey") % 7 != 0, "java").alias("language"))
    return asked.join(points, scores.applies_to(F.col("cells"), F.col("model"), F.col("language"))).groupBy("n_nationkey").agg(F.sum("n").alias("points"))


@query("m31_distance", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE round_even(1 - l_tax / 3, 6) END AS distance FROM lineitem")
def m31(spark, sf_dir):
    i = read_table(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", "l_linenumber", scores.distance(F.col("l_tax") / 3, F.col("l_discount") == 0).alias("distance"))


@query("w10_sample_order", "SELECT l_partkey, l_linenumber, l_orderkey, row_number() OVER (ORDER BY l_partkey, l_linenumber, l_orderkey) AS position FROM lineitem")
def w10(spark, sf_dir):
    i = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey")
    return ordered.in_sample_order(i, "l_partkey", "l_linenumber", "l_orderkey")


@query("k12_report_index", """WITH l AS (SELECT 0 AS part, '# Report' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '## Files' UNION ALL SELECT 3, '' UNION ALL SELECT 4, '- `' || r_name || '`' FROM region
    UNION ALL SELECT 5, '- metric rows with `contamination_risk`: ' || (SELECT count(*) FILTER (event_type = 'error') FROM events)) SELECT row_number() OVER (ORDER BY part, line)::INT AS position, line FROM l""")
def k12(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("contamination_risk"))
    return reports.report_index(read_table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), events)


@query("s26_blocks", "SELECT CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 3 END::BIGINT AS groups, count(*) AS files FROM region GROUP BY 1")
def s26_blocks(spark, sf_dir):
    """Files with a blank line have one group of two names and more; without, a group for each line of two names."""
    r = read_table(spark, sf_dir, "region")
    own = F.when(F.col("r_regionkey") % 2 == 0, F.lit("s1\ns2\n \ns3\n")).otherwise(F.lit("s1 s2\r\ns3\ns4 s5\ns6 s7\n"))
    found = [readers.groups_of_files(r.where(F.col("r_regionkey") == k).select(own.alias("t")), "t", r"s\d").agg(F.count("*").alias("groups")) for k in range(5)]  # five files
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("groups").agg(F.count("*").alias("files"))


# Text


@query("f3_clean_comment", "SELECT item_id, trim(regexp_replace(CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' #' ELSE text END, '\\s+', ' ', 'g')) AS cleaned FROM benchmark")
def f3(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    marked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("/* # "), "text", F.lit(" **/ */ "))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("### // "), "text", F.lit(" #"))).otherwise(F.concat(F.lit("//"), "text"))
    return b.select("item_id", text.clean_comment(marked).alias("cleaned"))


_DOC_SQL = """trim(regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x:
    regexp_replace(regexp_replace(x, '^\\s*(?:/\\*+!?|//+!?|\\*+/|\\*)\\s?', ''), '\\s*\\*+/\\s*$', '')), ' '), '\\s+', ' ', 'g'))"""


@query("f6_clean_doc", f"SELECT doc_id, md5({_DOC_SQL}) AS digest FROM documents")
def f6(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.clean_doc(F.coalesce("text", F.lit("")))).alias("digest"))


def _reason_sql(t: str, shortest: int, longest: int) -> str:
    sign = lambda pattern: f"regexp_matches({t}, '(?i){pattern}')"
    marks = f"length(regexp_replace({t}, '[^;{{}}()=<>\\[\\]]', '', 'g'))"
    return f"""CASE WHEN length({t}) < {shortest} OR length({t}) > {longest} THEN 'length' WHEN {sign(text.LICENSE_SIGNS)} THEN 'license' WHEN {sign(text.GENERATED_SIGNS)} THEN 'generated'
        WHEN {sign(text.DIRECTIVE_SIGNS)} THEN 'directive' WHEN {marks}::DOUBLE / length({t}) > 0.1 OR regexp_matches({t}, '[;{{}}]$') OR (regexp_matches({t}, '{text.CODE_STARTS}') AND {marks} > 0) THEN 'code'
        WHEN regexp_matches({t}, '[^\\x00-\\x7F]') OR length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))::DOUBLE / length({t}) < 0.6 THEN 'non_english' END"""


@query(
    "p10_doc_drop_reasons",
    f"""WITH c AS (SELECT doc_id, {_DOC_SQL} AS d, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS raw,
        trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^(?:#+|/{{2,}}|/\\*+|\\s+)+', ''), '(?:\\*+/|\\s)+$', ''), '\\s+', ' ', 'g')) AS m FROM documents)
    SELECT doc_id, {_reason_sql("d", 10, 2000)} AS doc_reason, CASE WHEN contains(raw, chr(10)) THEN 'multiline' ELSE {_reason_sql("m", 3, 120)} END AS comment_reason FROM c""",
)
def p10(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.doc_drop_reason(F.col("text")).alias("doc_reason"), text.comment_drop_reason(F.col("text")).alias("comment_reason"))


@query("f27_code_lines", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|//|/\\*|\\*)')))::INT AS code_lines FROM documents")
def f27(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", text.n_lines(F.col("text")).cast("long").alias("lines"), text.code_lines(F.col("text")).alias("code_lines"))


@query("f32_valid", "SELECT p_partkey::VARCHAR AS sample_id, p_partkey % 7 <> 0 AS valid FROM part")
def f32(spark, sf_dir):
    return _programs(spark, sf_dir).select("sample_id", code.valid_python(F.col("code")).alias("valid"))


@query("f34_free_identifiers", "SELECT p_partkey::VARCHAR AS sample_id, CASE WHEN p_partkey % 7 <> 0 THEN 5 END AS n FROM part")
def f34(spark, sf_dir):
    n = code.n_free_identifiers(F.col("code"), F.concat(F.lit("def part_"), "sample_id", F.lit("(a, b)")))
    return _programs(spark, sf_dir).withColumn("n", n).select("sample_id", F.when(F.col("n") >= 0, F.col("n")).alias("n"))


@query("f38_signature_prompts", "SELECT p_partkey::VARCHAR AS sample_id, CASE WHEN p_partkey % 7 <> 0 THEN 'def part_' || p_partkey::VARCHAR || '(a, b):' || chr(10) || '    \"\"\"' || p_name || '\"\"\"' || chr(10) END AS prompt FROM part")
def f38(spark, sf_dir):
    return _programs(spark, sf_dir).select("sample_id", code.signature_prompt(F.col("code")).alias("prompt"))


@query("f22_line_diff", "SELECT p_partkey::VARCHAR AS sample_id, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN '1' ELSE '0' END AS changed FROM part")
def f22(spark, sf_dir):
    p = _programs(spark, sf_dir).withColumn("t", code.transformed("drop_comments", F.col("code"), F.col("language"), F.col("sample_id"), 1.0))
    diff = code.line_diff(F.col("code"), F.col("t.code"))
    return p.withColumn("d", diff).select("sample_id", F.when((F.col("d.insert").cast("int") + F.col("d.delete").cast("int") + F.col("d.replace").cast("int")) > 0, "1").otherwise("0").alias("changed"))


# Streams


@query("r3_late_results", "SELECT user_id::VARCHAR AS item_id, event_type AS sample_index, arg_max(value, event_id) AS score FROM events GROUP BY ALL")
def r3(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    results = e.select(F.col("user_id").cast("string").alias("item_id"), F.col("event_type").alias("sample_index"), F.lit("OK").alias("status"), F.col("value").alias("score"), F.col("event_id").alias("line"))
    return jobs.latest_results(results).select("item_id", "sample_index", "score")


@query("j6_pairs", "SELECT a.l_orderkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = 'F' AND b.l_linestatus = 'O' GROUP BY 1")
def j6(spark, sf_dir):
    item = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus")
    pairs = item.where("l_linestatus = 'F'").alias("a").join(item.where("l_linestatus = 'O'").alias("b"), "l_orderkey")
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


@query("j22_errors_of_passed", f"WITH {EXECUTIONS}, p AS (SELECT DISTINCT l_partkey FROM ex WHERE status = 'PASSED' AND sample_index = 1) SELECT status, count(*) AS n FROM ex WHERE status <> 'PASSED' AND l_partkey IN (SELECT l_partkey FROM p) GROUP BY status")
def j22(spark, sf_dir):
    e = executions(spark, sf_dir)
    passed = e.where("status = 'PASSED' and sample_index = 1").select("l_partkey").distinct()
    return e.where("status <> 'PASSED'").join(passed, "l_partkey", "left_semi").groupBy("status").agg(F.count("*").alias("n"))
