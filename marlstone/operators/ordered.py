"""Order-dependent operators that never need a whole group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written


def running_sums(table: DataFrame, group: list[str], order: str, amounts: list[str], descending: bool = False) -> DataFrame:
    """Adds ``cum_<amount>``: the sum over the rows up to and with this one, in each group.

    Rows are dealt out by ranges of (group, order); sums of the ranges ahead are added to sums
    within a range. A group spreads over as many tasks as its rows need. (group, order) is
    expected to be unique, as after an aggregation.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g) for g in group], F.col(order).desc() if descending else F.col(order).asc()]
    dealt = written(table.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "running")
    sums = dealt.groupBy(*group, "_part").agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_part", *[F.coalesce(F.sum(f"_sum_{a}").over(ahead), F.lit(0)).alias(f"_before_{a}") for a in amounts])
    within = Window.partitionBy(*group, "_part").orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("*", *[F.sum(a).over(within).alias(f"_own_{a}") for a in amounts])
    joined = own.join(offsets, [own[c].eqNullSafe(offsets[c]) for c in [*group, "_part"]])
    return joined.select(*[own[c] for c in table.columns], *[(F.col(f"_own_{a}") + F.col(f"_before_{a}")).alias(f"cum_{a}") for a in amounts])


def numbered(table: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: each row's place in its group's order, from 1; large groups spread over many tasks."""
    marked = table.withColumn("_order", F.struct(*order)).withColumn("_one", F.lit(1).cast("long"))
    return running_sums(marked, group, "_order", ["_one"]).drop("_order", "_one").withColumnRenamed("cum__one", name)


def first_per(table: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order (ties cut by the order's last columns)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def in_sample_order(samples: DataFrame, problem: str = "problem_key", index: str = "sample_index", ident: str = "sample_id") -> DataFrame:
    """Adds ``position`` from 1 in the order (problem, index, id), and sorts by it."""
    return numbered(samples, [], [F.col(problem), F.col(index), F.col(ident)], "position").orderBy("position")


def last_per(table: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The row of the largest ``line`` of each key: an aggregate with partial results, no sort."""
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), line).alias("_row")).select(*keys, "_row.*").select(*table.columns)


def shares_of(weights: DataFrame, total: int, order: str, weight: str) -> DataFrame:
    """Largest remainder: whole numbers proportional to the weights that add up to ``total``; ties to the first by order.

    A row per weight is expected: a small table.
    """
    quota = F.col(weight) * F.lit(float(total)) / F.sum(weight).over(Window.partitionBy())
    base = weights.withColumn("_quota", quota).withColumn("_floor", F.floor("_quota").cast("long"))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_quota") - F.col("_floor"), 9)), order))
    return base.select(*weights.columns, (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).alias("allocated"))


def cumulative_buckets(weights: list[tuple[str, float]], u: Column) -> Column:
    """Name of the bucket whose range of cumulative shares holds u in [0, 1)."""
    whole, cut, out = sum(w for _, w in weights), 0.0, None
    for name, w in weights:
        cut += w / whole
        out = F.when(u < cut, name) if out is None else out.when(u < cut, name)
    return out.otherwise(weights[-1][0])


def bin_of(value: Column, edges: Column) -> Column:
    """Index of the first edge that is not below the value: bins (edge before, edge]; the last bin takes the rest."""
    return F.least(F.size(F.filter(edges, lambda e: e < value)), F.size(edges) - 1)


def exact_quantiles(table: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): quantiles with linear interpolation between neighbours, null without values.

    From counts per value and running sums, whose ranges split a hot group: no group's values meet in one task.
    """
    counts = table.groupBy(*group, value).agg(F.count(value).alias("n"))  # a group without values has one row that counts nothing
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("_n")).select(*[F.col(g).alias(f"_of_{g}") for g in group], "_n")
    laid = running_sums(counts, group, value, ["n"])
    low = laid.join(sizes, [laid[g].eqNullSafe(sizes[f"_of_{g}"]) for g in group]) if group else laid.crossJoin(sizes)  # one row
    columns = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_n") - 1)
        at = lambda index: F.min(F.when(F.col("cum_n") > index, F.col(value))).cast("double")
        weight = F.max(place - F.floor(place))  # the same in all of a group's rows
        columns.append(F.when(F.max("_n") > 0, at(F.floor(place)) * (1 - weight) + at(F.ceil(place)) * weight).alias(name))
    return low.groupBy(*group).agg(*columns)


def quantile_edges(table: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """One row with the distinct quantile edges of a column, the maximum last."""
    names = {f"q{i}": i / bins for i in range(1, bins)}
    found = exact_quantiles(table, [], value, names).crossJoin(table.agg(F.max(value).cast("double").alias("most")))  # one row each
    return found.select(F.array_sort(F.array_distinct(F.array(*names, "most"))).alias("edges"))


def stratified(reference: DataFrame, candidates: DataFrame, value: str, n: int, rank: Column, bins: int = 10) -> DataFrame:
    """n candidates whose values are spread as the reference's, by quantile bins of the reference.

    Bins get their share by largest remainder; what a bin lacks is taken from the nearest bins with
    rows to spare, the lower one first. Within a bin, by ``rank``. Only bin counts (``bins`` rows)
    are settled in order, on the driver; rows are never collected.
    """
    edges = quantile_edges(reference, value, bins).first()["edges"]
    cut = F.array(*[F.lit(float(e)) for e in edges])
    binned = lambda t: t.withColumn("_bin", bin_of(F.col(value), cut))
    held = {r["_bin"]: r["n"] for r in binned(candidates).groupBy("_bin").agg(F.count("*").alias("n")).collect()}
    wanted = {r["_bin"]: r["allocated"] for r in shares_of(binned(reference).groupBy("_bin").agg(F.count("*").alias("w")), n, "_bin", "w").collect()}
    take = {b: min(wanted.get(b, 0), held.get(b, 0)) for b in range(len(edges))}
    for b in range(len(edges)):
        lack = wanted.get(b, 0) - take[b]
        for donor in sorted(take, key=lambda d: (abs(d - b), d)):
            own_need = max(0, wanted.get(donor, 0) - take[donor]) if donor != b else 0
            moved = max(0, min(lack, held.get(donor, 0) - take[donor] - own_need))
            take[donor] += moved
            lack -= moved
    quota = F.element_at(F.create_map(*[F.lit(x) for b, k in take.items() for x in (b, k)]), F.col("_bin"))
    return numbered(binned(candidates), ["_bin"], [rank], "_place").where(F.col("_place") <= quota).drop("_place", "_bin")
