"""Ordered and greedy operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import hashing
from marlstone.operators import gates, metrics, ordered, reports, selection


def test_running_sums_cross_ranges(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(9)) for g in ("a", "b", None) for i in range(300 if g == "a" else 20)]
    out = ordered.running_sums(spark.createDataFrame(rows, "g string, i int, n long"), ["g"], "i", ["n"], descending=True).collect()
    for r in out:
        assert r.cum_n == sum(n for g, i, n in rows if g == r.g and i >= r.i)


def test_largest_remainder(spark):
    frame = spark.createDataFrame([(i, w) for i, w in enumerate([1, 1, 1])], "i int, w long")
    assert [r.allocated for r in ordered.shares_of(frame, 10, "i", "w").orderBy("i").collect()] == [4, 3, 3]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate([3, 5, 7, 11])], "i int, w long")
    assert [r.allocated for r in ordered.shares_of(frame, 20, "i", "w").orderBy("i").collect()] == [2, 4, 5, 9]


def test_stratified_follows_the_reference_and_refills(spark):
    reference = spark.createDataFrame([(i, float(i)) for i in range(100)], "i int, v double")
    many = spark.createDataFrame([(i, i % 100 + 0.5) for i in range(1000)], "i int, v double")
    picked = ordered.stratified(reference, many, "v", 50, hashing.seed(F.col("i")), bins=10).collect()
    bins = [sum(10 * b <= r.v < 10 * (b + 1) for r in picked) for b in range(10)]
    assert len(picked) == 50 and max(bins) - min(bins) <= 3  # the candidates lie half a step beside the edges
    few = many.where("v > 50")
    assert len(ordered.stratified(reference, few, "v", 50, hashing.seed(F.col("i")), bins=10).collect()) == 50
    none = few.limit(7)
    assert len(ordered.stratified(reference, none, "v", 50, hashing.seed(F.col("i")), bins=10).collect()) == 7


def test_pick_without_reuse(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(6), rng.choice([None, 1, 2, 3, 4])) for g in range(8) for i in range(25)]
    got = selection.pick_without_reuse(spark.createDataFrame(rows, "g int, o int, u int, d int"), ["g"], "o", "u", "d", 4).collect()
    expected = set()
    for g in range(8):
        users, dups, n = set(), set(), 0
        for row in [r for r in rows if r[0] == g]:
            if n < 4 and row[2] not in users and (row[3] is None or row[3] not in dups):
                users.add(row[2])
                dups.add(row[3])
                expected.add(row)
                n += 1
    assert {tuple(r) for r in got} == expected


def test_deduplicate(spark):
    rows = [(3, "a  b"), (1, "a b "), (2, "c"), (5, None), (4, None), (9, "gone")]
    excluded = spark.createDataFrame([("gone",)], "t string").select(hashing.fingerprint(F.col("t")).alias("fp"))
    got = selection.deduplicate(spark.createDataFrame(rows, "k int, code string"), "k", "code", excluded).select("k").collect()
    assert {r.k for r in got} >= {1, 2} and not {3, 9} & {r.k for r in got}


def test_constrained_best(spark):
    rows = [("m", "h1", 0.9, 5.0), ("m", "h2", 0.8, 1.0), ("m", "h3", 0.8, 0.5), ("n", "h1", 0.9, 9.0), ("n", "h2", 0.1, 4.0)]
    got = selection.constrained_best(spark.createDataFrame(rows, "method string, config_hash string, tpr_dev double, pass1_drop_pp double"), ["method"], 3.0).collect()
    assert {(r.method, r.config_hash, r.constraint_satisfied, r.n_admissible) for r in got} == {("m", "h3", True, 2), ("n", "h2", False, 0)}


def test_lanes_and_jobs(spark):
    frame = spark.createDataFrame([("g", k, float(w)) for k, w in zip("abcdef", (7, 6, 5, 4, 3, 2), strict=True)], "g string, k string, w double")
    load = {r.lane: r.total for r in selection.lanes(frame, "k", "w", 3).groupBy("lane").agg(F.sum("w").alias("total")).collect()}
    assert load == {0: 9.0, 1: 9.0, 2: 9.0}
    jobs = {r.job: r.total for r in selection.packed_jobs(frame, "g", "k", "w", 10.0, 1.0).groupBy("job").agg(F.sum("w").alias("total")).collect()}
    assert all(v <= 9.0 for v in jobs.values()) and sum(jobs.values()) == 27
    rng = random.Random(2)
    many = spark.createDataFrame([(g, i, rng.randrange(1, 400) / 100) for g in "ab" for i in range(300)], "g string, k int, w double")
    loads = [r.total for r in selection.packed_jobs(many, "g", "k", "w", 20.0, 1.0).groupBy("g", "job").agg(F.sum("w").alias("total")).collect()]
    assert max(loads) <= 19.0 and len(loads) < 1.4 * sum(loads) / 19.0
    large = selection.packed_jobs(many.withColumn("w", F.col("w") * 8), "g", "k", "w", 20.0, 1.0).groupBy("g", "job").agg(F.sum("w").alias("total"), F.count("*").alias("n")).collect()
    assert all(r.total <= 19.0 or r.n == 1 for r in large) and {r.job for r in large if r.g == "a"} == set(range(sum(r.g == "a" for r in large)))
    spread = sorted(r.total for r in selection.lanes(many, "k", "w", 7).groupBy("lane").agg(F.sum("w").alias("total")).collect())
    assert spread[-1] - spread[0] <= 4.0


def test_critical_path(spark):
    steps = spark.createDataFrame([(c, float(i + 1)) for i, c in enumerate("abcde")], "step string, seconds double")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "step string, needs string")
    assert {(r.step, r.finish) for r in selection.critical_path(steps, edges).collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0), ("d", 8.0), ("e", 5.0)}
    with pytest.raises(ValueError, match="need each other"):
        selection.critical_path(steps, edges.union(spark.createDataFrame([("a", "d")], edges.schema)))


def test_pick_without_reuse_in_a_hot_group(spark):
    """One group of all rows, nulls and equal places among them, against the plain loop."""
    rng = random.Random(7)
    rows = [("g" if i % 3 else None, rng.randrange(40), rng.choice([None, *range(60)]), rng.choice([None, *range(80)])) for i in range(500)]
    schema = "g string, o int, u int, d int"
    got = selection.pick_without_reuse(spark.createDataFrame([r for r in rows if r[0]], schema), ["g"], "o", "u", "d", 1000).collect()
    users, groups, expected = set(), set(), []
    for r in sorted((r for r in rows if r[0]), key=lambda r: (r[1], (r[2] is not None, r[2] or 0), (r[3] is not None, r[3] or 0))):
        if r[2] in users or r[3] in groups:
            continue
        users |= {r[2]} - {None}
        groups |= {r[3]} - {None}
        expected.append(r)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert selection.pick_without_reuse(spark.createDataFrame([], schema), ["g"], "o", "u", "d", 2).count() == 0


def test_small_groups_are_not_written_and_large_ones_agree(spark, monkeypatch):
    """Groups on both sides of the size that is walked, nulls and equal places among them, against the plain loop."""
    tables, write = [], selection.written
    monkeypatch.setattr(selection, "written", lambda *x: tables.append(x[1]) or write(*x))
    rng = random.Random(11)
    rows = [(g, rng.randrange(9), rng.choice([None, *range(7)]), rng.choice([None, *range(9)])) for g, k in (("a", 30), (None, 60), ("c", 5)) for _ in range(k)]
    frame = spark.createDataFrame(rows, "g string, o int, u int, d int")
    expected = []
    for g in ("a", None, "c"):
        users, groups, n = set(), set(), 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], (r[2] is not None, r[2] or 0), (r[3] is not None, r[3] or 0))):
            if n < 6 and r[2] not in users and r[3] not in groups:
                users, groups, n = users | ({r[2]} - {None}), groups | ({r[3]} - {None}), n + 1
                expected.append(r)
    for most, writes in ((1000, False), (40, True), (1, True)):
        monkeypatch.setattr(selection, "FOLDED", most)
        tables.clear()
        got = selection.pick_without_reuse(frame, ["g"], "o", "u", "d", 6)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected)) and bool(tables) == writes
        assert got.columns == frame.columns


def test_splits_and_gates(spark):
    problems = spark.createDataFrame([(f"f{i % 3}/{i}",) for i in range(30)], "problem_key string")
    split = selection.assign_splits(problems, {"f0": 4})
    assert {r.family: r["count"] for r in split.where("split = 'dev'").groupBy("family").count().collect()} == {"f0": 4}
    assert metrics.split_violations(split, "problem_key", "split").count() == 0
    with pytest.raises(Exception, match="no split"):
        gates.with_split(problems, split.where("family = 'f0'")).collect()


def test_freezing(spark):
    selected = spark.createDataFrame([("m", "x", "py", "h", False, ["L1"], False)], "method string, model_id string, language string, config_hash string, provisional boolean, levels array<string>, not_applicable boolean")
    thresholds = spark.createDataFrame([("m", "x", "py", "h", 1.5, False)], "method string, model_id string, language string, config_hash string, threshold double, provisional boolean")
    candidates = spark.createDataFrame([("m", "x", "py", "h")], "method string, model_id string, language string, config_hash string")
    frozen = gates.freeze(selected, thresholds, candidates, ["L1"])
    assert frozen.count() == 1
    with pytest.raises(gates.Violation, match="levels differ"):
        gates.freeze(selected, thresholds, candidates, ["L1", "L2"])
    with pytest.raises(gates.Violation):
        gates.ensure_not_frozen(frozen, "m")
    gates.ensure_not_frozen(frozen, "m", override=True)
    assert gates.frozen_only(frozen, frozen).count() == 1
    with pytest.raises(Exception, match="not the frozen configuration"):
        gates.frozen_only(frozen.withColumn("threshold_sha256", F.lit("other")), frozen).collect()


def test_row_conservation(spark, tmp_path):
    with pytest.raises(gates.Violation):
        gates.conserved(spark.range(5), 6, lambda t: t.write.parquet(str(tmp_path / "x")))


def test_reports(spark):
    long = spark.createDataFrame([("a", "tpr", 0.5, 0.4, 0.6), ("a", "fpr", None, None, None), ("b", "tpr", 0.25, None, None)], "method string, metric string, value double, ci_low double, ci_high double")
    rows = {r.method: (r.tpr, r.fpr) for r in reports.interval_table(long, ["method"], ["tpr", "fpr"]).collect()}
    assert rows == {"a": ("0.500 [0.400, 0.600]", ""), "b": ("0.250", None)}
    parts = reports.per_dataset(spark.createDataFrame([("tpr|x|y", 1.0), ("tpr", 2.0)], "metric string, value double")).collect()
    assert [(r.metric, r.dataset) for r in parts] == [("tpr", "x|y")]


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 rows, each sharing its user with the next and its duplicate group with the one before: one pick blocks the next row only."""
    rows = [("g", i, (i + 1) // 2, i // 2) for i in range(10_000)]
    written, counted = selection.written, []
    monkeypatch.setattr(selection, "written", lambda df, label: counted.append(label) or written(df, label))
    got = selection.pick_without_reuse(spark.createDataFrame(rows, "g string, o int, u int, d int"), ["g"], "o", "u", "d", 5).collect()
    users, groups, expected = set(), set(), []
    for r in rows:
        if r[2] not in users and r[3] not in groups:
            users.add(r[2])
            groups.add(r[3])
            expected.append(r)
    assert sorted(map(tuple, got)) == expected[:5] and counted.count("pick-taken") <= 5


def test_constrained_best_keeps_nulls_and_whole_rows(spark):
    rows = [(None, "h1", 0.9, 1.0, "x"), (None, "h2", None, 1.0, "y"), ("n", "h1", None, None, None), ("n", "h0", 0.1, 9.0, "z")]
    got = selection.constrained_best(spark.createDataFrame(rows, "method string, config_hash string, tpr_dev double, pass1_drop_pp double, other string"), ["method"], 3.0)
    assert got.columns == ["method", "config_hash", "tpr_dev", "pass1_drop_pp", "other", "constraint_satisfied", "n_candidates", "n_admissible"]
    assert {(r.method, r.other, r.n_candidates, r.n_admissible) for r in got.collect()} == {(None, "y", 2, 2), ("n", None, 2, 0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
