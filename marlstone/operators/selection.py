"""Splits, deduplication, ranked and constrained choices, balancing, and replayed selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.hashing import fingerprint, key_family, seed
from marlstone.operators.ordered import first_per, numbered, running_sums
from marlstone.session import scratch, written


def assign_splits(problems: DataFrame, dev: dict[str, int], base: int = 42, key: str = "problem_key") -> DataFrame:
    """Adds ``family`` and ``split``: of each family the first k by seed are dev, the rest test."""
    own = problems.withColumn("family", key_family(F.col(key)))
    ranked = numbered(own, ["family"], [seed(F.lit("split"), F.lit(base), F.col(key)), F.col(key)], "_place")
    wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in dev.items() for x in (k, n)]), F.col("family")), F.lit(0))
    return ranked.withColumn("split", F.when(F.col("_place") <= wanted, "dev").otherwise("test")).drop("_place")


def extra_dev_count(n_extra: Column, dev: int, total: int) -> Column:
    """The extra keys' share of dev, halves up."""
    return F.floor(n_extra * dev / F.lit(float(total)) + 0.5).cast("long")


def assign_extra(keys: DataFrame, assigned: DataFrame, dev: int, total: int, base: int = 42, key: str = "problem_key") -> DataFrame:
    """Splits for keys that have none yet."""
    extra = keys.select(key).distinct().join(assigned.select(key), key, "left_anti").withColumn("family", key_family(F.col(key)))
    ranked = numbered(extra, ["family"], [seed(F.lit("extra"), F.lit(base), F.col(key)), F.col(key)], "_place")
    counts = extra.groupBy("family").agg(F.count("*").alias("_n"))
    return ranked.join(counts, "family").withColumn("split", F.when(F.col("_place") <= extra_dev_count(F.col("_n"), dev, total), "dev").otherwise("test")).select(key, "family", "split")


def deduplicate(candidates: DataFrame, key: str, code: str, excluded: DataFrame | None = None) -> DataFrame:
    """One row of each fingerprint, that with the smallest key; none whose fingerprint is excluded (column fp).

    An aggregate with partial results finds the keys, so a group of many copies isn't sorted in one task.
    """
    marked = candidates.withColumn("fp", fingerprint(F.col(code)))
    if excluded is not None:
        marked = marked.join(excluded.select("fp").distinct(), "fp", "left_anti")
    kept = marked.groupBy("fp").agg(F.min(key).alias(key))
    return marked.join(kept, ["fp", key], "left_semi").dropDuplicates(["fp", key])


def one_per_cluster(ranked: DataFrame, clusters: DataFrame, key: str, rank: str) -> DataFrame:
    """The best-ranked row of each cluster; rows without a cluster all stay."""
    tagged = ranked.join(clusters, key, "left")
    own = F.coalesce(F.concat(F.lit("c"), F.col("cluster").cast("string")), F.concat(F.lit("k"), F.col(key).cast("string")))
    return first_per(tagged.withColumn("_own", own), ["_own"], [F.col(rank), F.col(key)]).drop("_own")


def distinct_codes(rows: DataFrame, group: list[str], code: str, order: list[str], n: int) -> DataFrame:
    """The first n different fingerprints of each group, in order."""
    marked = rows.withColumn("fp", fingerprint(F.col(code)))
    by = [F.col(c) for c in order]
    return first_per(first_per(marked, [*group, "fp"], by), group, by, n)


FOLDED = 1000  # rows of a group that are walked as one array


def pick_without_reuse(rows: DataFrame, group: list[str], order: str, user: str, duplicate: str, n: int) -> DataFrame:
    """In order, rows whose user and duplicate group are not used yet, up to n of each group.

    Groups of up to FOLDED rows are walked in order as arrays: their rows are shuffled once, and no table is written. Larger
    ones, if there are any, are picked from in rounds. Equal places in the order go by the row's other columns, equal
    rows by number; a row without a user or duplicate group shares it with none.
    """
    large = rows.groupBy(*group).agg(F.count("*").alias("_size")).where(F.col("_size") > FOLDED)
    if not large.limit(1).count():
        return _picked_in_order(rows, group, order, user, duplicate, n)
    if not group:
        return _picked_in_rounds(rows, group, order, user, duplicate, n)
    large = large.select(*[F.col(g).alias(f"_of_{g}") for g in group])
    of = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    small = _picked_in_order(rows.join(large, of, "left_anti"), group, order, user, duplicate, n)
    return small.unionByName(_picked_in_rounds(rows.join(large, of, "left_semi"), group, order, user, duplicate, n))


def _picked_in_order(rows: DataFrame, group: list[str], order: str, user: str, duplicate: str, n: int) -> DataFrame:
    """``pick_without_reuse`` for groups of few rows each, as an aggregate."""
    rest = [c for c in rows.columns if c not in (*group, order)]
    walked = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("_rows"))

    def step(picked: Column, x: Column) -> Column:
        shared = F.coalesce(F.exists(picked, lambda p: (p[user] == x[user]) | (p[duplicate] == x[duplicate])), F.lit(False))
        return F.when((F.size(picked) >= n) | shared, picked).otherwise(F.concat(picked, F.array(x)))

    picks = walked.select(*group, F.inline(F.aggregate("_rows", F.slice("_rows", 1, 0), step)))
    return picks.select(*rows.columns)


def _picked_in_rounds(rows: DataFrame, group: list[str], order: str, user: str, duplicate: str, n: int) -> DataFrame:
    """``pick_without_reuse`` for groups of any size, none of which is gathered.

    A row that is the first left both of its user and of its duplicate group is picked whatever else
    happens, and those sharing either with it go; repeated until none is left, that is the choice made
    one by one. Each round is aggregates and joins. A round picks at least the first row that
    a group has left, and what comes behind a group's n-th pick is dropped: so there are n rounds at
    most, whatever chains the rows form. Of what is picked the first n of each group are kept.
    """
    spark, columns = rows.sparkSession, rows.columns
    rows = rows.withColumns({g: F.struct(F.col(g).alias("of")) for g in group})  # a null key equals itself
    rest = [c for c in rows.columns if c not in (*group, order)]
    with scratch(spark) as own:
        marked = written(rows.withColumn("_row", F.monotonically_increasing_id()), "pick-rows")
        alone = lambda c, tag: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.concat(F.lit(tag), F.col("_row").cast("string")))
        left = written(marked.select(*group, F.struct(order, *rest, "_row").alias("_at"), alone(user, "u").alias("_user"), alone(duplicate, "d").alias("_group")), "pick-left")
        own.drop(marked)
        picked, least = left.limit(0), lambda c: F.min("_at").alias(f"_first{c}")
        while left.limit(1).count():
            by_user = left.groupBy(*group, "_user").agg(least("_user"))
            by_group = left.groupBy(*group, "_group").agg(least("_group"))
            told = left.join(by_user, [*group, "_user"]).join(by_group, [*group, "_group"])
            taken = written(told.where((F.col("_at") == F.col("_first_user")) & (F.col("_at") == F.col("_first_group"))).select(*left.columns), "pick-taken")
            before, rest_before = picked, left
            picked = written(first_per(picked.unionByName(taken), group, [F.col("_at")], n), "picked")  # n rows of a group at most
            full = picked.groupBy(*group).agg(F.count("*").alias("_n"), F.max("_at").alias("_last")).where(F.col("_n") >= n)
            left = left.join(taken.select(*group, "_user"), [*group, "_user"], "left_anti").join(taken.select(*group, "_group"), [*group, "_group"], "left_anti")
            left = written(left.join(full, group, "left").where("_last is null or _at < _last").select(*taken.columns), "pick-left")
            for read in (before, taken, rest_before):
                own.drop(read)  # no more than a round's tables are on disk
        own.keep(picked)
    return picked.select(*[F.col(g)["of"].alias(g) for g in group], "_at.*").select(*columns)


def constrained_best(candidates: DataFrame, group: list[str], most: float) -> DataFrame:
    """Per group, of the candidates whose drop is at most ``most`` that with the largest tpr, then smallest drop, then
    hash; if none is admissible, that with the smallest drop. Adds n_candidates and n_admissible."""
    fits = F.col("pass1_drop_pp") <= most
    order = F.struct(F.when(fits, 0).otherwise(1), F.when(fits, -F.col("tpr_dev")), F.col("pass1_drop_pp"), F.col("config_hash"))
    own = [*[c for c in candidates.columns if c not in group], "constraint_satisfied"]
    marked = candidates.withColumn("constraint_satisfied", fits)
    best = marked.groupBy(*group).agg(F.min_by(F.struct(*own), order).alias("_best"), F.count("*").alias("n_candidates"), F.count_if(fits).alias("n_admissible"))
    return best.select(*group, "_best.*", "n_candidates", "n_admissible").select(*candidates.columns, "constraint_satisfied", "n_candidates", "n_admissible")


def replay(steps: DataFrame, keys: list[str], step: str, score: str, valid: str, cap: int, z: float) -> DataFrame:
    """The first step up to ``cap`` that is valid and reaches z; else the valid one with the best score, else the first."""
    kept = steps.where(F.col(step) < cap)
    good = F.col(valid) & (F.col(score) >= z)
    usable = F.when(F.col(valid), F.struct(F.col(score).alias("s"), (-F.col(step)).alias("t")))
    chosen = kept.groupBy(*keys).agg(F.coalesce(F.min(F.when(good, F.col(step))), -F.max(usable).getField("t"), F.min(step)).alias(step), F.max(good).alias("reached"))
    return kept.join(chosen, [*keys, step])


def lanes(cells: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """(key, weight, lane): longest first, dealt to and fro, so that lanes differ by the longest cell at most.

    By rank alone, which is spread over many tasks; no cell waits for the one before.
    """
    place = numbered(cells.select(key, weight), [], [-F.col(weight), F.col(key)], "_place").withColumn("_turn", F.pmod(F.col("_place") - 1, F.lit(2 * n)))
    lane = F.when(F.col("_turn") < n, F.col("_turn")).otherwise(2 * n - 1 - F.col("_turn"))
    return place.select(key, weight, lane.cast("int").alias("lane"))


def packed_jobs(tasks: DataFrame, group: str, key: str, seconds: str, budget: float, startup: float) -> DataFrame:
    """(group, key, seconds, job): tasks laid end to end, longest first, and cut into jobs of ``budget`` seconds.

    A job has room for the budget less ``startup``. Tasks over half the room are jobs of their own; of the
    others a job takes those that begin within its stretch, which is the room less the longest of them, so
    none is over its room, nor less than half full but the last. From running sums: no group is packed in one task.
    """
    room = round((budget - startup) * 1000)
    exact = F.round(F.col(seconds) * 1000).cast("long")  # whole milliseconds: the same sums in any order
    large = 2 * exact > room
    order = F.struct((-F.col(seconds)).alias("s"), F.col(key).alias("k"))
    amounts = [F.when(large, 0).otherwise(exact).cast("long").alias("_ms"), large.cast("long").alias("_alone")]
    laid = running_sums(tasks.select(group, key, seconds, order.alias("_order"), *amounts), [group], "_order", ["_ms", "_alone"])
    told = tasks.groupBy(F.col(group).alias("_g")).agg(F.coalesce(F.max(F.when(~large, exact)), F.lit(0)).alias("_longest"), F.count_if(large).alias("_larges"))
    among = F.floor((F.col("cum__ms") - F.col("_ms")) / (F.lit(room) - F.col("_longest")))
    job = F.when(F.col("_alone") == 1, F.col("cum__alone") - 1).otherwise(F.col("_larges") + among)
    return laid.join(told, laid[group].eqNullSafe(told["_g"])).select(group, key, seconds, job.cast("int").alias("job"))


def critical_path(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, finish): earliest end of each step (columns step, seconds) after all it needs (step, needs).

    Levels of the step graph are relaxed one after another, a written table each; only the number of
    steps that moved reaches the driver. Steps on a cycle raise.
    """
    with scratch(steps.sparkSession) as own:
        now = written(steps.select("step", "seconds", F.col("seconds").cast("double").alias("finish"), F.lit(True).alias("moved")), "path")
        for _ in range(steps.count() + 1):
            if not now.where("moved").limit(1).count():
                break
            ends = edges.join(now.select(F.col("step").alias("needs"), F.col("finish").alias("_end")), "needs").groupBy("step").agg(F.max("_end").alias("_start"))
            finish = F.col("seconds") + F.coalesce("_start", F.lit(0.0))
            now = written(now.join(ends, "step", "left").select("step", "seconds", finish.alias("finish"), (finish != F.col("finish")).alias("moved")), "path")
        else:
            raise ValueError("steps need each other")
        own.keep(now)
    return now.select("step", "finish")


def parameter_grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values, a column each."""
    out = None
    for name, values in axes.items():
        kind = "double" if any(isinstance(v, float) for v in values) else "long" if all(isinstance(v, int) for v in values) else "string"
        one = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        out = one if out is None else out.crossJoin(one)
    return out


def plan_cells(spark, axes: dict[str, list], frozen: DataFrame | None = None) -> DataFrame:
    """Distinct cells of the axes with their key; bound to the frozen configuration where there is one."""
    cells = parameter_grid(spark, axes).distinct()
    keyed = cells.withColumn("cell", F.concat_ws("__", *[F.col(a).cast("string") for a in axes]))
    if frozen is None:
        return keyed
    on = [c for c in frozen.columns if c in axes]
    return keyed.join(frozen, on, "left")
