"""Queries over texts, problems and keys: scans, splits, deduplication, sampling, text functions, joins, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import code, hashing, html, text, workers
from marlstone.operators import gates, metrics, ordered, selection
from marlstone.plans.views import DETECTIONS, EXECUTIONS, PROBLEMS, detections, documents, executions, problems
from marlstone.session import new_path, read_table
from marlstone.sources import readers
from marlstone.sources.store import Store
from marlstone.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+"  # the oracle's spelling of the white space class


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _seed_sql(label: str, value: str) -> str:
    return f"(('0x' || substr(sha256('{label}|' || {value}), 1, 16))::UBIGINT % 2147483647)::BIGINT"


# Sources and sinks


@query("s1_parquet_scan", "SELECT doc_id, lang, n_chars FROM documents")
def s1(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("s2_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def s2(spark, sf_dir):
    path = new_path(spark, "jsonl")
    read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    return readers.read_json_lines(spark, path, "conv_id long, turn long, role string, text string", ["conv_id", "turn", "role"])


@query("s4_csv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s4(spark, sf_dir):
    path = new_path(spark, "csv")
    read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return readers.read_csv(spark, path)


@query("s6_store", "SELECT 'table' AS kind, count(*) AS rows, true AS complete FROM nation")
def s6(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    nation = read_table(spark, sf_dir, "nation")
    store.write("table", "nation", nation, expected=nation.count())
    store.write("table", "copy", store.read("table", "nation"), inputs=[("table", "nation")])
    return store.manifests.where("path = 'copy'").select("kind", F.col("n_rows_out").alias("rows"), (F.col("status") == "complete").alias("complete"))


@query("s8_count_rows", "SELECT count(*) AS rows FROM lineitem")
def s8(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"))


@query("s12_repositories", "SELECT DISTINCT source FROM documents")
def s12(spark, sf_dir):
    return documents(spark, sf_dir).select("source").distinct()


@query("s14_buckets", f"WITH u AS (SELECT *, {_seed_sql('bucket|42', 'c_name')} / 2147483648.0::DOUBLE AS u FROM customer) SELECT CASE WHEN u < 0.5 THEN 'prompts' WHEN u < 0.8 THEN 'negatives' ELSE 'pool' END AS bucket, count(*) AS n FROM u GROUP BY 1")
def s14(spark, sf_dir):
    out = readers.bucketed(read_table(spark, sf_dir, "customer"), F.col("c_name"), [("prompts", 5), ("negatives", 3), ("pool", 2)])
    return out.groupBy("bucket").agg(F.count("*").alias("n"))


@query("s26_groups", r"WITH g AS (SELECT list_distinct(regexp_extract_all(p_name, '[a-z]+')) AS n, regexp_extract_all(p_name, '[a-z]+') AS ids FROM part) SELECT id, count(*) AS groups FROM (SELECT unnest(list_distinct(ids)) AS id, md5(array_to_string(ids, ',')) AS g FROM g WHERE len(n) > 1) GROUP BY id")
def s26(spark, sf_dir):
    groups = readers.groups_of_ids(read_table(spark, sf_dir, "part"), "p_name", "[a-z]+")
    return readers.group_index(groups).groupBy("id").agg(F.count("*").alias("groups"))


@query("s28_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s28(spark, sf_dir):
    done = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.without_done(read_table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("k4_superseded", "SELECT 'region' AS path, true AS superseded, 2::BIGINT AS version")
def k4(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    store.write("table", "region", read_table(spark, sf_dir, "region"))
    store.supersede("table", "region")
    return store.manifests.select("path", "superseded", "version")


# Hashing and keys


@query("g1_seed", f"SELECT c_custkey, {_seed_sql('split|42', 'c_custkey::VARCHAR')} AS seed FROM customer")
def g1(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", hashing.seed(F.lit("split"), F.lit(42), F.col("c_custkey")).alias("seed"))


@query("g2_canonical_json", """SELECT n_nationkey, '{"a":"' || n_name || '","b":"' || n_regionkey::VARCHAR || '"}' AS json, sha256('{"a":"' || n_name || '","b":"' || n_regionkey::VARCHAR || '"}') AS hash FROM nation""")
def g2(spark, sf_dir):
    entries = F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))
    return read_table(spark, sf_dir, "nation").select("n_nationkey", hashing.canonical_json(entries).alias("json"), hashing.json_hash(entries).alias("hash"))


@query("g3_sample_id", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, md5('llm|p/' || l_partkey::VARCHAR || '|python|||||' || l_linenumber::VARCHAR || '|||') AS sample_id FROM lineitem")
def g3(spark, sf_dir):
    ident = hashing.sample_id(source=F.lit("llm"), problem_key=F.concat(F.lit("p/"), "l_partkey"), language=F.lit("python"), sample_index=F.col("l_linenumber"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ident.alias("sample_id"))


@query("g9_flattened", "SELECT n_nationkey, 'name=' || n_name || ';region=' || n_regionkey::VARCHAR AS cell FROM nation")
def g9(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", hashing.flattened(F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))).alias("cell"))


@query("p23_cell_key", r"SELECT o_orderkey, concat_ws('__', o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END) AS cell, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.=-]+', '-', 'g') AS slug FROM orders")
def p23(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", hashing.cell_key(F.col("o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority"))).alias("cell"), hashing.slug(F.col("o_orderpriority")).alias("slug"))


@query("f2_fingerprint", f"SELECT doc_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS fp FROM documents")
def f2(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", hashing.fingerprint(F.col("text")).alias("fp"))


# Splits, deduplication, sampling


@query("w1_split", f"WITH {PROBLEMS}, r AS (SELECT *, split_part(problem_key, '/', 1) AS family FROM pr), n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_seed_sql('split|42', 'problem_key')}, problem_key) AS n FROM r) SELECT problem_key, family, CASE WHEN n <= CASE family WHEN 'fam0' THEN 100 WHEN 'fam1' THEN 50 ELSE 0 END THEN 'dev' ELSE 'test' END AS split FROM n")
def w1(spark, sf_dir):
    return selection.assign_splits(problems(spark, sf_dir), {"fam0": 100, "fam1": 50}).select("problem_key", "family", "split")


@query("t13_assign_extra", f"WITH {PROBLEMS}, r AS (SELECT problem_key, split_part(problem_key, '/', 1) AS family FROM pr WHERE o_orderkey % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_seed_sql('extra|42', 'problem_key')}, problem_key) AS n, count(*) OVER (PARTITION BY family) AS c FROM r) SELECT problem_key, family, CASE WHEN n <= floor(c * 3 / 20.0::DOUBLE + 0.5) THEN 'dev' ELSE 'test' END AS split FROM n")
def t13(spark, sf_dir):
    p = problems(spark, sf_dir)
    return selection.assign_extra(p, p.where("o_orderkey % 3 <> 0"), 3, 20)


@query("a37_split_violations", "SELECT o_orderpriority AS level, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def a37(spark, sf_dir):
    return metrics.split_violations(read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), "o_orderstatus"), "level", "o_orderstatus")


@query("w3_deduplicate", f"WITH d AS (SELECT *, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS fp FROM documents), x AS (SELECT md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS fp FROM benchmark) SELECT min(doc_id) AS doc_id, fp FROM d WHERE fp NOT IN (SELECT fp FROM x) GROUP BY fp")
def w3(spark, sf_dir):
    excluded = read_table(spark, sf_dir, "benchmark").select(hashing.fingerprint(F.col("text")).alias("fp"))
    return selection.deduplicate(documents(spark, sf_dir), "doc_id", "text", excluded).select("doc_id", "fp")


@query("w4_one_per_cluster", f"WITH {PROBLEMS}, t AS (SELECT *, CASE WHEN o_custkey % 3 > 0 THEN 'c' || o_custkey::VARCHAR ELSE 'k' || problem_key END AS own FROM pr) SELECT problem_key FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY seconds, problem_key) AS n FROM t) WHERE n = 1")
def w4(spark, sf_dir):
    p = problems(spark, sf_dir)
    clusters = p.where("o_custkey % 3 > 0").select("problem_key", F.col("o_custkey").alias("cluster"))
    return selection.one_per_cluster(p, clusters, "problem_key", "seconds").select("problem_key")


@query("w5_last_line", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def w5(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return ordered.last_per(e, ["user_id", "event_type"], "event_id")


@query("w6_pick_without_reuse")
def w6(spark, sf_dir):
    """Held against a plain loop in the tests: each choice depends on the ones before."""
    e = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("rank"))
    return selection.pick_without_reuse(e, ["l_orderkey"], "rank", "l_suppkey", "l_partkey", 2)


@query("w7_distinct_codes", f"WITH d AS (SELECT *, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS fp FROM documents), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) AS a FROM d) WHERE a = 1), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b FROM f) SELECT source, doc_id FROM n WHERE b <= 5")
def w7(spark, sf_dir):
    return selection.distinct_codes(documents(spark, sf_dir), ["source"], "text", ["doc_id"], 5).select("source", "doc_id")


@query("w8_cumulative", "SELECT lang, n_chars, n, sum(n) OVER (PARTITION BY lang ORDER BY n_chars)::BIGINT AS cum_n FROM (SELECT lang, n_chars, count(*) AS n FROM documents GROUP BY ALL)")
def w8(spark, sf_dir):
    counts = documents(spark, sf_dir).groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    return ordered.running_sums(counts, ["lang"], "n_chars", ["n"])


@query("t2_first_by_rank", f"WITH {PROBLEMS} SELECT problem_key, seconds FROM pr ORDER BY seconds, problem_key LIMIT 25")
def t2(spark, sf_dir):
    return problems(spark, sf_dir).orderBy("seconds", "problem_key").limit(25).select("problem_key", "seconds")


@query("t3_largest_remainder", "WITH w AS (SELECT c_mktsegment AS segment, count(*) AS w FROM customer GROUP BY 1), q AS (SELECT *, w * 100.0::DOUBLE / sum(w) OVER () AS q FROM w), f AS (SELECT *, floor(q)::BIGINT AS f FROM q), r AS (SELECT *, row_number() OVER (ORDER BY round(q - f, 9) DESC, segment) AS n, 100 - sum(f) OVER () AS left_over FROM f) SELECT segment, w, (f + (n <= left_over)::INT)::BIGINT AS allocated FROM r")
def t3(spark, sf_dir):
    w = read_table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("w"))
    return ordered.shares_of(w, 100, "segment", "w")


@query("t4_stratified_counts")
def t4(spark, sf_dir):
    """Counts by quantile bin are held against a plain loop in the tests."""
    d = documents(spark, sf_dir)
    reference, candidates = d.where("lang = 'fr'"), d.where("lang = 'en'")
    return ordered.stratified(reference, candidates, "n_chars", 60, hashing.seed(F.lit("negatives"), F.col("doc_id"))).select("doc_id", "n_chars")


@query("t5_quantile_edges", "SELECT lang, array_to_string(list_transform(list_sort(list_distinct(list_concat(quantile_cont(n_chars, [0.25, 0.5, 0.75]), [max(n_chars)::DOUBLE]))), lambda x: printf('%.4f', x)), ',') AS edges FROM documents WHERE lang = 'fr' GROUP BY lang")
def t5(spark, sf_dir):
    edges = ordered.quantile_edges(documents(spark, sf_dir).where("lang = 'fr'"), "n_chars", 4)
    return edges.select(F.lit("fr").alias("lang"), F.array_join(F.transform("edges", lambda x: F.format_string("%.4f", x)), ",").alias("edges"))


@query("t7_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {_seed_sql('pool|42', 'doc_id::VARCHAR')}, doc_id LIMIT 20")
def t7(spark, sf_dir):
    return documents(spark, sf_dir).orderBy(hashing.seed(F.lit("pool"), F.lit(42), F.col("doc_id")), "doc_id").limit(20).select("doc_id")


@query("t16_deciles", "SELECT lang, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90 FROM documents GROUP BY lang")
def t16(spark, sf_dir):
    return ordered.exact_quantiles(documents(spark, sf_dir), ["lang"], "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


# Joins


@query("j2_composite", f"WITH {EXECUTIONS}, m AS (SELECT problem_key, sample_index, count(*) AS n_m FROM ex WHERE side = 'F' GROUP BY ALL), r AS (SELECT problem_key, sample_index, count(*) AS n_r FROM ex WHERE side = 'O' GROUP BY ALL) SELECT problem_key, sample_index, n_m, n_r FROM m JOIN r USING (problem_key, sample_index)")
def j2(spark, sf_dir):
    e = executions(spark, sf_dir)
    side = lambda s, n: e.where(F.col("side") == s).groupBy("problem_key", "sample_index").agg(F.count("*").alias(n))
    return side("F", "n_m").join(side("O", "n_r"), ["problem_key", "sample_index"])


@query("j3_parent", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j3(spark, sf_dir):
    item, o = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    return item.join(o, item.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus")


@query("j8_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j8(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read_table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("j10_anti_repo", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def j10(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return read_table(spark, sf_dir, "customer").join(s, "c_nationkey", "left_anti").select("c_custkey")


@query("j14_with_split", f"WITH {PROBLEMS} SELECT problem_key, CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM pr")
def j14(spark, sf_dir):
    p = problems(spark, sf_dir)
    splits = p.select("problem_key", F.when(F.col("o_custkey") % 2 == 0, "dev").otherwise("test").alias("split"))
    return gates.with_split(p, splits).select("problem_key", "split")


@query("j16_optional", "SELECT p_partkey, l.n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) l ON l_partkey = p_partkey")
def j16(spark, sf_dir):
    n = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return read_table(spark, sf_dir, "part").join(n, "p_partkey", "left").select("p_partkey", "n")


@query("j21_filled_results", "WITH i AS (SELECT o_orderkey, unnest(range(0, 1 + (o_orderkey % 3)::INT))::BIGINT AS sample_index FROM orders), r AS (SELECT DISTINCT l_orderkey, (l_linenumber - 1)::BIGINT AS sample_index FROM lineitem) SELECT o_orderkey::VARCHAR AS item_id, i.sample_index, CASE WHEN r.l_orderkey IS NULL THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN r.l_orderkey IS NULL THEN 'no result' END AS error FROM i LEFT JOIN r ON r.l_orderkey = o_orderkey AND r.sample_index = i.sample_index")
def j21(spark, sf_dir):
    items = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), (1 + F.col("o_orderkey") % 3).alias("n"))
    results = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), (F.col("l_linenumber") - 1).cast("long").alias("sample_index")).distinct().select("*", F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error"))
    return gates.results_for_all(items, results).select("item_id", "sample_index", "status", "error")


@query("r6_complete_items", "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), w AS (SELECT l_orderkey FROM r JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderkey HAVING count(*) = 1 + o_orderkey % 3) SELECT l_orderkey::VARCHAR AS item_id, l_linenumber::BIGINT AS sample_index FROM r WHERE l_orderkey IN (SELECT l_orderkey FROM w)")
def r6(spark, sf_dir):
    items = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), (1 + F.col("o_orderkey") % 3).alias("n"))
    results = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").cast("long").alias("sample_index")).distinct()
    return gates.complete_items(results, items)


@query("j24_bins", "SELECT doc_id, (n_chars > 500)::INT + (n_chars > 2000)::INT + (n_chars > 5000)::INT AS bin FROM documents")
def j24(spark, sf_dir):
    edges = F.array(*[F.lit(float(x)) for x in (500, 2000, 5000, 10**9)])
    return documents(spark, sf_dir).select("doc_id", ordered.bin_of(F.col("n_chars"), edges).alias("bin"))


# Sets


@query("u2_tagged_union", "SELECT 'human' AS part, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'machine', user_id FROM events WHERE event_type = 'click'")
def u2(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    tagged = lambda kind, name: e.where(F.col("event_type") == kind).select(F.lit(name).alias("part"), "user_id")
    return tagged("view", "human").unionByName(tagged("click", "machine"))


@query("u4_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u4(spark, sf_dir):
    item = read_table(spark, sf_dir, "lineitem")
    return item.where("l_returnflag = 'R'").select("l_partkey").intersect(item.where("l_returnflag = 'A'").select("l_partkey"))


@query("u5_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u5(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("u6_same_keys", "WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT s_suppkey AS k FROM supplier) SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u6(spark, sf_dir):
    a = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    return gates.same_keys(a, read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("u7_array_sets", "SELECT event_id, array_to_string(list_sort(list_filter(list_distinct([event_id % 4, event_id % 6]), lambda x: x = user_id % 4 OR x = user_id % 6)), ',') AS shared FROM events")
def u7(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(F.array_sort(F.array_intersect(F.array(F.col("event_id") % 4, F.col("event_id") % 6), F.array(F.col("user_id") % 4, F.col("user_id") % 6))).cast("array<string>"), ",").alias("shared"))


@query("u8_parameter_grid", "SELECT gamma, delta, method FROM (SELECT unnest([0.25, 0.5])::DOUBLE AS gamma), (SELECT unnest([1, 2, 4])::BIGINT AS delta), (SELECT unnest(['sweet', 'stone']) AS method)")
def u8(spark, sf_dir):
    return selection.parameter_grid(spark, {"gamma": [0.25, 0.5], "delta": [1, 2, 4], "method": ["sweet", "stone"]})


@query("u10_planned_cells", "SELECT method, level, method || '__' || level AS cell, CASE method WHEN 'acw' THEN 'abc' END AS config_hash FROM (SELECT unnest(['acw', 'stone']) AS method), (SELECT unnest(['L1', 'L2']) AS level)")
def u10(spark, sf_dir):
    frozen = spark.createDataFrame([("acw", "abc")], "method string, config_hash string")
    return selection.plan_cells(spark, {"method": ["acw", "stone", "acw"], "level": ["L1", "L2"]}, frozen).select("method", "level", "cell", "config_hash")


@query("u11_line_multisets", "SELECT a.doc_id, list_sort(string_split(a.text, chr(10))) = list_sort(string_split(b.text, chr(10))) AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def u11(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return d.join(after, "doc_id").select("doc_id", text.line_multisets_equal(F.col("text"), F.col("next")).alias("same"))


# Text


@query("f1_newlines", r"SELECT page_id, length(regexp_replace(html, '\r\n?', chr(10), 'g')) AS n, length(html) - length(replace(html, chr(10), '')) AS lines FROM pages")
def f1(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(text.newlines(F.col("html"))).cast("long").alias("n"), text.n_lines(F.col("html")).cast("long").alias("lines"))


@query("f5_non_english", "SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') OR length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / length(text) < 0.6 AS foreign_text FROM documents")
def f5(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.non_english(F.col("text")).alias("foreign_text"))


@query("f16_task_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS number FROM orders")
def f16(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.task_number(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Task").otherwise("Other"), F.lit("/"), "o_orderkey"), "Task").alias("number"))


@query("f17_family", f"WITH {PROBLEMS} SELECT split_part(problem_key, '/', 1) AS family, count(*) AS n FROM pr GROUP BY 1")
def f17(spark, sf_dir):
    return problems(spark, sf_dir).groupBy(hashing.key_family(F.col("problem_key")).alias("family")).agg(F.count("*").alias("n"))


@query("a18_letters", r"SELECT lower(regexp_extract(c_name, '(\pL)', 1)) AS letter, count(*) AS n FROM customer WHERE regexp_matches(c_name, '\pL') GROUP BY 1")
def a18(spark, sf_dir):
    return metrics.letter_histogram(read_table(spark, sf_dir, "customer"), "c_name")


@query("a32_top_messages", "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'a.js: unexpected token' WHEN 1 THEN 'unknown type ' || s_nationkey ELSE s_name END AS message, count(*) AS n FROM supplier GROUP BY 1 ORDER BY n DESC, message LIMIT 10")
def a32(spark, sf_dir):
    noisy = F.concat(F.lit("exit 1: 3 warnings\n/tmp/b"), "s_nationkey", F.lit("/a.js:"), "s_suppkey", F.lit(":7: unexpected token\nmore"))
    compiler = F.concat(F.lit("note\n/w/x.cpp:3:1: error: unknown type "), "s_nationkey", F.lit("\n1 error"))
    raw = F.when(F.col("s_suppkey") % 3 == 0, noisy).when(F.col("s_suppkey") % 3 == 1, compiler).otherwise(F.concat(F.lit("  \n "), "s_name", F.lit(" \n")))
    return metrics.top_messages(read_table(spark, sf_dir, "supplier"), text.error_key(raw))


@query("f19_tokens", r"SELECT item_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]'))::INT AS n FROM benchmark")
def f19(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", text.n_tokens(F.col("text")).alias("n"))


@query("f20_format_free", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(9), '    '), ' +(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') || chr(10)) AS digest FROM documents")
def f20(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.format_free(F.col("text"))).alias("digest"))


@query("f26_open_fences", "SELECT conv_id, turn, (length(text) - length(replace(text, '```', ''))) // 3 % 2 = 1 AS open FROM conversations")
def f26(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fence_open(F.col("text")).alias("open"))


@query("f12_fenced_code", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || chr(10) WHEN 1 THEN 'plain' || chr(10) END AS code FROM conversations")
def f12(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("see\n```js\nx()\n```\nand\n```Python\n"), "text", F.lit("\n```\n"))).when(F.col("turn") % 3 == 1, F.lit("a\n```\nplain\n```")).otherwise(F.lit("nothing fenced"))
    return c.select("conv_id", "turn", text.fenced_code(raw, "python", "py").alias("code"))


@query("f15_output", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n+$', '', 'g')) AS digest FROM documents")
def f15(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.normal_output(F.col("text"))).alias("digest"))


@query("f25_share", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey::INT END AS k, CASE WHEN n_nationkey % 3 < 2 THEN 25 END AS m, CASE WHEN n_nationkey % 3 = 1 THEN 1 END AS sub_k FROM nation")
def f25(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    given = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_nationkey", F.lit("/25"))).when(F.col("n_nationkey") % 3 == 1, F.concat("n_nationkey", F.lit("/25:1/2"))).otherwise(F.lit("all"))
    return n.withColumn("s", text.share(given)).select("n_nationkey", "s.k", "s.m", "s.sub_k")


@query("p9_drop_reasons", "SELECT name, step, dropped, (SELECT count(*) FROM benchmark) - sum(dropped) OVER (ORDER BY step)::BIGINT AS remaining FROM (SELECT 0 AS step, 'empty' AS name, count(*) FILTER (trim(text) = '') AS dropped FROM benchmark UNION ALL SELECT 1, 'long', count(*) FILTER (trim(text) <> '' AND length(text) > 400) FROM benchmark)")
def p9(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    reason = text.first_reason(("empty", text.is_empty(F.col("text"))), ("long", F.length("text") > 400))
    return metrics.filter_table(b, reason, ["empty", "long"])


@query("p24_empty_counts", "SELECT lang, count(*) FILTER (trim(text) = '' OR text IS NULL) AS empty, count(*) AS n FROM documents GROUP BY lang")
def p24(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count_if(text.is_empty(F.col("text"))).alias("empty"), F.count("*").alias("n"))


@query("f37_messages", "SELECT conv_id, turn, 1 + (role = 'user')::INT AS n FROM conversations")
def f37(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(text.messages(F.when(F.col("role") == "user", "be brief"), F.col("text"))).alias("n"))


@query("f8_pages")
def f8(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.withColumn("d", html.described(F.col("html"))).select("page_id", F.length("d.text").alias("n_chars"), "d.has_table", "d.has_script", "d.n_pre")


# Code, as programs made from the parts table: no supplied table holds any


def _programs(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    body = F.format_string("def part_%d(a, b):\n    \"\"\"%s\"\"\"\n    total = a\n    # note\n    for i in range(b):\n        total += %d\n    if a < b:\n        total = total + 1\n    else:\n        total = b\n    return total\n\ndef other(x):\n    y = x\n    return y\n", F.col("p_partkey"), F.col("p_name"), F.col("p_size"))
    return p.select(F.col("p_partkey").cast("string").alias("sample_id"), F.when(F.col("p_partkey") % 5 == 0, "java").otherwise("python").alias("language"), F.when(F.col("p_partkey") % 7 == 0, "def broken(").otherwise(body).alias("code"))


@query("q6_transforms", "SELECT name, CASE WHEN p_partkey % 5 = 0 THEN 'NOT_APPLICABLE' WHEN p_partkey % 7 = 0 THEN CASE WHEN name = 'drop_comments' THEN 'TOOL_ERROR' ELSE 'TOOL_ERROR' END ELSE 'APPLIED' END AS status, count(*) AS n FROM part, (SELECT unnest(['refactor', 'rename', 'drop_comments', 'add_comments', 'local_edits', 'truncate', 'keep_functions']) AS name) GROUP BY ALL")
def q6(spark, sf_dir):
    wanted = {"refactor": 5.0, "rename": 1.0, "drop_comments": 1.0, "add_comments": 0.5, "local_edits": 2.0, "truncate": 0.5, "keep_functions": 1.0}
    p = _programs(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "sample_id")  # small rows, much work each
    out = p.select(F.explode(code.all_transformed(wanted, F.col("code"), F.col("language"), F.col("sample_id"))).alias("t")).select("t.name", "t.status")
    return out.groupBy("name", "status").agg(F.count("*").alias("n"))


@query("f30_functions", "SELECT p_partkey::VARCHAR AS sample_id, unnest([{'name': 'part_' || p_partkey::VARCHAR, 'loc': 11}, {'name': 'other', 'loc': 3}], recursive := true) FROM part WHERE p_partkey % 7 <> 0")
def f30(spark, sf_dir):
    out = _programs(spark, sf_dir).withColumn("f", F.explode(code.functions_of(F.col("code"))))
    return out.select("sample_id", "f.name", "f.loc")


@query("f33_identifiers", "SELECT p_partkey::VARCHAR AS sample_id, CASE WHEN p_partkey % 7 <> 0 THEN 8 END AS n FROM part")
def f33(spark, sf_dir):
    out = _programs(spark, sf_dir).withColumn("names", code.identifiers(F.col("code")))
    return out.select("sample_id", F.when(F.col("names").isNotNull(), F.size("names")).alias("n"))


@query("x5_workers", "SELECT p_partkey::VARCHAR AS item_id, unnest(range(0, 1 + (p_partkey % 3)::INT))::BIGINT AS sample_index, CASE WHEN p_partkey % 50 = 0 THEN 'FAILED' ELSE 'OK' END AS status FROM part")
def x5(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_partkey") % 50 == 0, "fail").otherwise(F.col("p_name")).alias("code"), (1 + F.col("p_partkey") % 3).alias("n"))
    return workers.run_workers(items, workers.Echo, {}).select("item_id", "sample_index", "status")


@query("e7_final_status", f"WITH {EXECUTIONS}, f AS (SELECT l_partkey::VARCHAR AS sample_id, CASE WHEN l_partkey % 4 = 0 THEN 'TIMEOUT' ELSE 'PASSED' END AS status FROM (SELECT DISTINCT l_partkey FROM ex)) SELECT sample_id, CASE WHEN status = 'TIMEOUT' AND sample_id::INT % 8 = 0 THEN 'PASSED' ELSE status END AS status, status AS first_attempt_status, CASE WHEN sample_id::INT % 8 = 0 THEN 'PASSED' END AS retry_status FROM f")
def e7(spark, sf_dir):
    keys = executions(spark, sf_dir).select("l_partkey").distinct()
    first = keys.select(F.col("l_partkey").cast("string").alias("sample_id"), F.when(F.col("l_partkey") % 4 == 0, "TIMEOUT").otherwise("PASSED").alias("status"))
    again = keys.where("l_partkey % 8 = 0").select(F.col("l_partkey").cast("string").alias("sample_id"), F.lit("PASSED").alias("status"))
    return jobs.retried(first, again)


# Streams


def _stream(spark, sf_dir, label):
    """Run a streaming job to its end over the events and read what it wrote."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = new_path(spark, f"{label}-in")
    spark.read.parquet(path).repartition(4).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


@query("r2_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r2(spark, sf_dir):
    """Beyond the reference: event-time windows over the stream, finished by the end of the input."""
    out, state = new_path(spark, "windows"), new_path(spark, "windows-state")
    counted = jobs.window_counts(_stream(spark, sf_dir, "windows").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "40 days", "1 day", keys=("event_type",))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(out)

    q = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("r4_resumed_ingest", "SELECT event_id, user_id, value, 'cfg' AS fingerprint FROM events")
def r4(spark, sf_dir):
    source, sink, state = (new_path(spark, f"ingest-{x}") for x in ("in", "out", "state"))
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    for part in (0, 1):  # the second run takes up what the first left
        rows.where(F.col("event_id") % 2 == part).write.mode("append").json(source)
        jobs.ingest(spark, source, "event_id long, user_id long, value double", sink, state, "cfg").awaitTermination()
    return spark.read.parquet(f"{sink}/cfg")


@query("r7_worker_batches", f"WITH {DETECTIONS} SELECT sample_id, floor(score) AS score FROM det")
def r7(spark, sf_dir):
    source, sink, state = (new_path(spark, f"batches-{x}") for x in ("in", "out", "state"))
    d = detections(spark, sf_dir).select("sample_id", "score")
    d.repartition(4).write.parquet(source)
    work = lambda batch: batch.select("sample_id", F.floor("score").cast("double").alias("score"))
    jobs.each_batch(spark.readStream.schema(d.schema).parquet(source), work, sink, state).awaitTermination()
    return spark.read.parquet(sink).select("sample_id", "score")


@query("v1_row_conservation", "SELECT count(*) AS rows FROM orders")
def v1(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    path = new_path(spark, "conserved")
    gates.conserved(o, o.count(), lambda t: t.write.parquet(path))
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@query("o15_missing_cells", "SELECT 'table' AS kind, r_name AS path FROM region WHERE r_regionkey > 0")
def o15(spark, sf_dir):
    region = read_table(spark, sf_dir, "region")
    store = Store(spark, new_path(spark, "store"))
    store.write("table", region.where("r_regionkey = 0").first()["r_name"], region)
    return store.missing(region.select(F.lit("table").alias("kind"), F.col("r_name").alias("path")))


@query("m18_ngrams", "SELECT item_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\x0B]'))::INT AS n FROM benchmark")
def m18(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.size(text.code_tokens(F.col("text"))).alias("n"))


@query("m15_classifier")
def m15(spark, sf_dir):
    """Out-of-fold scores of a linear classifier over token n-grams; folds keep sources together."""
    from marlstone.operators.classifier import out_of_fold

    d = documents(spark, sf_dir).where("lang in ('en', 'fr')").select("doc_id", "source", "text", F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))
    return out_of_fold(d, "doc_id", "source", "text", "label", folds=3)


