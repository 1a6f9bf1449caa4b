"""Thresholds, rank statistics and bootstrap intervals over groups (cells)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import seed
from marlstone.functions.scores import HIGHEST
from marlstone.operators.ordered import exact_quantiles, numbered, running_sums
from marlstone.session import written

LEAST_NEGATIVES = 1000  # below, a 1 % threshold rests on too few rows


def fit_threshold(negatives: DataFrame, group: list[str], score: str = "score", target: float = 0.01) -> DataFrame:
    """Per group the smallest score, or infinity, that at most ``target`` of the negatives reach.

    Columns: group, threshold, achieved_fpr, n_negatives, underpowered. Scores may be -inf; null or
    NaN scores raise, as does an empty group, which has no row.
    """
    bad = F.col(score).isNull() | F.isnan(score)
    checked = negatives.withColumn(score, F.when(bad, F.raise_error(F.lit("a negative has no score"))).otherwise(F.col(score)))
    counts = checked.groupBy(*group, score).agg(F.count("*").alias("n"))
    reached = running_sums(counts, group, score, ["n"], descending=True)
    totals = counts.groupBy(*group).agg(F.sum("n").alias("n_negatives"))
    low = _beside(reached, totals, group)
    rate = F.col("cum_n") / F.col("n_negatives").cast("double")
    fits = rate <= target
    return low.groupBy(*group).agg(
        F.coalesce(F.min(F.when(fits, F.col(score))), F.lit(HIGHEST)).alias("threshold"),
        F.coalesce(F.max(F.when(fits, rate)), F.lit(0.0)).alias("achieved_fpr"),
        F.max("n_negatives").alias("n_negatives"),
        (F.max("n_negatives") < LEAST_NEGATIVES).alias("underpowered"),
    )


def _beside(table: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Each row with its group's totals; null groups too."""
    named = totals.select(*[F.col(g).alias(f"_of_{g}") for g in group], *[c for c in totals.columns if c not in group])
    if not group:
        return table.crossJoin(named)  # one row
    return table.join(named, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]).drop(*[f"_of_{g}" for g in group])


def _by_score(table: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    return table.groupBy(*group, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def auroc(table: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """Per group the chance that a positive outranks a negative, ties by half; null without either kind."""
    cum = running_sums(_by_score(table, group, score, positive), group, score, ["pos", "neg"])
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return cum.groupBy(*group).agg(F.try_divide(won, pairs).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def indexed_quantiles(table: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, p90, p50): the value at index 9 (n - 1) / 10, rounded down, of the group's sorted values, and their median.

    From counts per value and running sums, so no group is gathered; rows without a value don't count.
    """
    counts = table.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    low = _beside(running_sums(counts, group, value, ["n"]), counts.groupBy(*group).agg(F.sum("n").alias("_n")), group)
    at = lambda index: F.min(F.when(F.col("cum_n") > F.expr(index), F.col(value)))
    return low.groupBy(*group).agg(at("(9 * (_n - 1)) div 10").alias("p90"), ((at("(_n - 1) div 2") + at("_n div 2")) / 2).alias("p50"))


def ks(table: DataFrame, group: list[str], value: str, first: Column) -> DataFrame:
    """Per group the largest gap between the two empirical distributions."""
    cum = running_sums(_by_score(table, group, value, first), group, value, ["pos", "neg"])
    totals = cum.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = _beside(cum, totals, group)
    gap = F.abs(F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos").cast("double")) - F.try_divide(F.col("cum_neg").cast("double"), F.col("all_neg").cast("double")))
    return joined.groupBy(*group).agg(F.max(gap).alias("ks"))


def roc_points(table: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """(group, score, tpr, fpr): the curve's point at each threshold."""
    cum = running_sums(_by_score(table, group, score, positive), group, score, ["pos", "neg"], descending=True)
    totals = cum.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = _beside(cum, totals, group)
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return joined.select(*group, score, rate("cum_pos", "all_pos").alias("tpr"), rate("cum_neg", "all_neg").alias("fpr"))


def replicates(clusters: DataFrame, group: list[str], cluster: str, amounts: list[str], n: int, label: str, base: int = 42) -> DataFrame:
    """Sums of ``amounts`` over resampled clusters: a row per group and replicate.

    ``clusters`` has a row per cluster. Replicate r draws as many clusters as there are, draw j taking
    the cluster numbered seed(label, base, r, j) modulo their number: the same on every run.
    """
    return _drawn(clusters, group, cluster, n, label, base).groupBy(*group, "replicate").agg(*[F.sum(a).alias(a) for a in amounts])


def _drawn(clusters: DataFrame, group: list[str], cluster: str, n: int, label: str, base: int) -> DataFrame:
    """The clusters that each replicate draws, a row per draw."""
    placed = numbered(clusters, group, [F.col(cluster)], "_at").withColumn("_pick", F.col("_at") - 1).drop("_at")
    sized = _beside(placed, clusters.groupBy(*group).agg(F.count("*").alias("_k")), group)
    draws = sized.select(*group, F.col("_pick").alias("_j"), "_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    draws = draws.select(*group, "replicate", F.pmod(seed(F.lit(label), F.lit(base), F.col("replicate"), F.col("_j")), F.col("_k")).alias("_pick"))
    return _beside(draws, placed, [*group, "_pick"])


BLOCK = 1 << 10  # clusters whose draws are told apart together


def _split(label: str, n_draws: int, clusters: int, block: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For n replicates of ``n_draws`` draws from so many clusters: how many fall ahead of a block of them, and how many on it.

    The blocks are the leaves of a binary tree. At a node, each replicate's draws are split by a binomial of
    the two sides' shares of clusters, from a generator named after the node: every block that passes the node
    finds the same split, so the blocks' counts add up without being seen together.
    """
    lo, hi = 0, -(-clusters // width)
    ahead, here = np.zeros(n, np.int64), np.full(n, n_draws, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = mid * width - lo * width, min(hi * width, clusters) - lo * width
        first = _generator(label, lo, hi).binomial(here, left / whole)
        if block < mid:
            hi, here = mid, first
        else:
            lo, ahead, here = mid, ahead + first, here - first
    return ahead, here


def _generator(label: str, *node: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256("|".join(map(str, (label, *node))).encode()).digest()[:16], "big")))


def _block_draws(label: str, clusters: int, block: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws ahead of a block for each replicate, how often each replicate draws each of the block's clusters)."""
    ahead, here = _split(label, clusters, clusters, block, n, width)
    size = min(width, clusters - block * width)
    return ahead, _generator(label, "block", block).multinomial(here, np.full(size, 1 / size))


def _blocks(clusters: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Clusters numbered in their group, with its size, its name and their block."""
    placed = _beside(numbered(clusters, group, order, "_at"), clusters.groupBy(*group).agg(F.count("*").alias("_k")), group)
    named = F.to_json(F.struct(F.lit(0).alias("_"), *group))
    return placed.withColumn("_name", named).withColumn("_block", F.floor((F.col("_at") - 1) / BLOCK))


def split_replicates(clusters: DataFrame, group: list[str], cluster: str, amounts: list[str], n: int, label: str, base: int = 42) -> DataFrame:
    """As ``replicates``, by exact multinomial counts: no row is made for a draw.

    Each block of clusters counts its own draws and gives n rows of sums, so rows are as many as blocks times replicates.
    """
    seed_, width = f"{label}|{base}", BLOCK

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        _, counts = _block_draws(f"{seed_}|{rows['_name'].iloc[0]}", int(rows["_k"].iloc[0]), int(rows["_block"].iloc[0]), n, width)
        sums = counts @ np.nan_to_num(rows[amounts].to_numpy(float))  # a missing amount adds nothing
        return pd.DataFrame({"_name": rows["_name"].iloc[0], "replicate": np.arange(n)} | {a: sums[:, i] for i, a in enumerate(amounts)})

    blocks = _blocks(clusters, group, [F.col(cluster)])
    shape = ", ".join(["_name string", "replicate int", *[f"`{a}` double" for a in amounts]])
    sums = blocks.select("_name", "_block", "_at", "_k", *amounts).groupBy("_name", "_block").applyInPandas(summed, shape)
    sums = sums.groupBy("_name", "replicate").agg(*[F.sum(a).alias(a) for a in amounts])
    names = blocks.where("_at = 1").select("_name", *group)
    return sums.join(names, "_name").select(*group, "replicate", *amounts)


def split_medians(clusters: DataFrame, group: list[str], cluster: str, value: str, n: int, label: str, base: int = 42) -> DataFrame:
    """(group, replicate, median): the median of ``value`` over resampled clusters.

    Clusters are numbered by value, so a block knows which ranks of a replicate's draws are its own,
    and only the block that holds a middle rank answers for it.
    """
    seed_, width = f"{label}|{base}", BLOCK

    def middle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        k, values = int(rows["_k"].iloc[0]), rows[value].to_numpy(float)
        ahead, counts = _block_draws(f"{seed_}|{rows['_name'].iloc[0]}", k, int(rows["_block"].iloc[0]), n, width)
        until, out = ahead[:, None] + counts.cumsum(axis=1), np.zeros(n)
        found = np.zeros(n, bool)
        for rank in ((k - 1) // 2, k // 2):
            own = (ahead <= rank) & (rank < until[:, -1])
            out[own] += values[(until[own] <= rank).sum(axis=1)] / 2
            found |= own
        return pd.DataFrame({"_name": rows["_name"].iloc[0], "replicate": np.flatnonzero(found), "median": out[found]})

    blocks = _blocks(clusters.where(F.col(value).isNotNull()), group, [F.col(value), F.col(cluster)])
    found = blocks.select("_name", "_block", "_at", "_k", value).groupBy("_name", "_block").applyInPandas(middle, "_name string, replicate int, median double")
    halves = found.groupBy("_name", "replicate").agg(F.sum("median").alias("median"))
    return halves.join(blocks.where("_at = 1").select("_name", *group), "_name").select(*group, "replicate", "median")


def percentile_interval(samples: DataFrame, group: list[str], value: Column, alpha: float = 0.05) -> DataFrame:
    bounds = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return samples.groupBy(*group).agg(bounds.alias("_b")).select(*group, F.col("_b")[0].alias("ci_low"), F.col("_b")[1].alias("ci_high"))


def ratio_interval(table: DataFrame, group: list[str], cluster: str, hit: Column, n: int = 2000, label: str = "ratio", alpha: float = 0.05, resampled=split_replicates) -> DataFrame:
    """Micro mean of ``hit`` per group with a cluster-bootstrap interval."""
    sums = table.groupBy(*group, cluster).agg(F.sum(hit.cast("double")).alias("hits"), F.count("*").alias("rows"))
    point = sums.groupBy(*group).agg((F.sum("hits") / F.sum("rows")).alias("value"), F.sum("rows").alias("n"))
    bounds = percentile_interval(resampled(sums, group, cluster, ["hits", "rows"], n, label), group, F.col("hits") / F.col("rows"), alpha)
    return _with(point, bounds, group)


def mean_interval(table: DataFrame, group: list[str], cluster: str, value: Column, n: int = 2000, label: str = "mean", alpha: float = 0.05, resampled=split_replicates) -> DataFrame:
    """Macro mean: the mean over clusters of their means, with its bootstrap interval."""
    means = table.groupBy(*group, cluster).agg(F.avg(value).alias("mean"), F.lit(1).alias("one"))
    point = means.groupBy(*group).agg(F.avg("mean").alias("value"), F.count("*").alias("n"))
    bounds = percentile_interval(resampled(means, group, cluster, ["mean", "one"], n, label), group, F.col("mean") / F.col("one"), alpha)
    return _with(point, bounds, group)


def drawn_medians(clusters: DataFrame, group: list[str], cluster: str, value: str, n: int, label: str, base: int = 42) -> DataFrame:
    """As ``split_medians``, with the draws of ``replicates``: a row for each."""
    return _drawn(clusters, group, cluster, n, label, base).groupBy(*group, "replicate").agg(F.median(value).alias("median"))


def statistic_interval(table: DataFrame, group: list[str], cluster: str, value: str, n: int = 1000, label: str = "median", alpha: float = 0.05, resampled=split_medians) -> DataFrame:
    """Median over per-cluster means, with its bootstrap interval."""
    means = table.groupBy(*group, cluster).agg(F.avg(value).alias("mean"))
    point = _beside(exact_quantiles(means, group, "mean", {"value": 0.5}), means.groupBy(*group).agg(F.count("*").alias("n")), group)
    return _with(point, percentile_interval(resampled(means, group, cluster, "mean", n, label), group, F.col("median"), alpha), group)


def auroc_interval(table: DataFrame, group: list[str], cluster: str, score: str, positive: Column, n: int = 200, label: str = "auroc", resampled=None) -> DataFrame:
    """AUROC with an interval: positives resampled by cluster, negatives row by row, by seeds unless ``resampled`` draws them."""
    rows = table.select(*group, cluster, F.col(score).alias("_score"), positive.alias("_positive"))
    return _with(auroc(table, group, score, positive), percentile_interval((resampled or seeded_areas)(rows, group, cluster, n, label), group, F.col("auroc")), group)


def seeded_areas(rows: DataFrame, group: list[str], cluster: str, n: int, label: str) -> DataFrame:
    """(group, replicate, auroc) of rows with ``_score`` and ``_positive``, by the draws of ``replicates``: a row for each."""
    kept = written(rows.withColumn("_unit", F.when(F.col("_positive"), F.concat(F.lit("c"), F.col(cluster).cast("string"))).otherwise(F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))), "auroc-rows")
    units = kept.groupBy(*group, "_positive", "_unit").agg(F.lit(1).alias("one"))
    placed = numbered(units, [*group, "_positive"], [F.col("_unit")], "_at").withColumn("_pick", F.col("_at") - 1).drop("_at")
    sized = _beside(placed, units.groupBy(*group, "_positive").agg(F.count("*").alias("_k")), [*group, "_positive"])
    draws = sized.select(*group, "_positive", F.col("_pick").alias("_j"), "_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    draws = draws.withColumn("_pick", F.pmod(seed(F.lit(label), F.col("_positive").cast("string"), F.col("replicate"), F.col("_j")), F.col("_k")))
    times = draws.groupBy(*group, "_positive", "replicate", "_pick").agg(F.count("*").alias("times"))
    drawn = times.join(placed.select(*group, "_positive", "_pick", "_unit"), [*group, "_positive", "_pick"])
    rows = drawn.join(kept, [*group, "_positive", "_unit"]).groupBy(*group, "replicate", "_score").agg(F.sum(F.when(F.col("_positive"), F.col("times")).otherwise(0)).alias("pos"), F.sum(F.when(~F.col("_positive"), F.col("times")).otherwise(0)).alias("neg"))
    cum = running_sums(rows, [*group, "replicate"], "_score", ["pos", "neg"])
    return cum.groupBy(*group, "replicate").agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


WIDE = 16  # blocks whose draws are held together


def _uniform_draws(label: str, units: int, block: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_block_draws``, a row per unit and a column per replicate: draws of equal chances, counted."""
    ahead, here = _split(label, units, units, block, n, BLOCK)
    size = min(BLOCK, units - block * BLOCK)
    picks = _generator(label, "block", block).integers(0, size, int(here.sum()))
    return ahead, np.bincount(picks * n + np.repeat(np.arange(n), here), minlength=size * n).reshape(size, n)


def _packed(counts: np.ndarray) -> np.ndarray:
    """The same counts in as few bytes as hold them."""
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not counts.size or counts.max() <= np.iinfo(t).max))


def split_areas(rows: DataFrame, group: list[str], cluster: str, n: int, label: str, base: int = 42) -> DataFrame:
    """As ``seeded_areas``, by exact multinomial counts: no row is made for a draw.

    Negatives are numbered by score, so a block of them knows for each replicate how many draws fall on the first i
    of them, and a positive only says between which it stands: behind those below it, and behind those not above, by
    half each. Blocks of clusters give the draws of the positives at each such place, as one array of n counts; these meet
    the negatives' draws by ranges of places, so neither a group nor a score with many rows is one task.
    """
    spark, seed_ = rows.sparkSession, f"{label}|{base}"
    kept = rows.where(F.col("_positive").isNotNull())
    by_score = _by_score(kept, group, "_score", F.col("_positive"))
    below = running_sums(by_score, group, "_score", ["neg"]).select(*group, "_score", F.array(F.col("cum_neg") - F.col("neg"), "cum_neg").alias("_places"))
    sizes = by_score.groupBy(*group).agg(F.sum("neg").alias("_negatives"))
    own = kept.where("_positive").groupBy(*group, cluster, "_score").agg(F.count("*").alias("_w"))
    clusters = _blocks(own.select(*group, cluster).distinct(), group, [F.col(cluster)]).select(*group, cluster, "_name", "_at", "_k")
    placed = _beside(_beside(own, below, [*group, "_score"]), clusters, [*group, cluster])
    placed = _beside(placed, sizes, group).select("_name", "_at", "_k", "_negatives", "_w", F.explode(F.concat("_places", F.array(F.lit(-1).cast("long")))).alias("_place"))  # at -1 all are counted
    placed = placed.where("_place <> 0").groupBy("_name", "_at", "_k", "_negatives", "_place").agg(F.sum("_w").alias("_w")).withColumn("_wide", F.floor((F.col("_at") - 1) / (BLOCK * WIDE)))
    dealt = lambda t, *by: t.repartitionByRange(4 * spark.sparkContext.defaultParallelism, *by).sortWithinPartitions(*by)

    def of_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts = None, None
        for batch in batches:
            for (name, wide), part in batch.groupby(["_name", "_wide"], sort=False):
                if held != (name, wide):
                    k = int(part["_k"].iloc[0])
                    held, blocks = (name, wide), range(int(wide) * WIDE, min((int(wide) + 1) * WIDE, -(-k // BLOCK)))
                    counts = np.concatenate([_packed(_uniform_draws(f"{seed_}|positive|{name}", k, b, n)[1]) for b in blocks])
                for i in range(0, len(part), BLOCK):
                    some = part.iloc[i : i + BLOCK]
                    places = some["_place"].to_numpy()
                    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
                    drawn = np.add.reduceat(counts[some["_at"].to_numpy() - 1 - int(wide) * WIDE * BLOCK] * some["_w"].to_numpy()[:, None], first, axis=0)
                    yield pd.DataFrame({"_name": name, "_negatives": some["_negatives"].iloc[0], "_place": places[first], "_draws": [_packed(x).tobytes() for x in drawn]})

    def of_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, until, sums = None, None, {}
        for batch in batches:
            for (name, block), part in batch.groupby(["_name", (batch["_place"] - 1) // BLOCK], sort=False):
                won, drawn = sums.setdefault(name, (np.zeros(n), np.zeros(n)))
                if block >= 0 and held != (name, block):
                    ahead, counts = _uniform_draws(f"{seed_}|negative|{name}", int(part["_negatives"].iloc[0]), int(block), n)
                    held, until = (name, block), ahead + counts.cumsum(axis=0)
                for i in range(0, len(part), BLOCK):
                    some = part.iloc[i : i + BLOCK]
                    draws = np.stack([np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(x) // n]) for x in some["_draws"]]).astype(float)
                    if block < 0:
                        drawn += draws.sum(axis=0)
                    else:
                        won += (draws * until[some["_place"].to_numpy() - 1 - int(block) * BLOCK]).sum(axis=0) / 2
        for name, (won, drawn) in sums.items():
            yield pd.DataFrame({"_name": name, "replicate": np.arange(n), "_won": won, "_drawn": drawn})

    by_place = dealt(placed, "_name", "_wide", "_place").mapInPandas(of_clusters, "_name string, _negatives long, _place long, _draws binary")
    sums = dealt(by_place, "_name", "_place").mapInPandas(of_negatives, "_name string, replicate int, _won double, _drawn double")
    sums = sums.groupBy("_name", "replicate").agg(F.sum("_won").alias("_won"), F.sum("_drawn").alias("_drawn"))
    every = sizes.select(*group, "_negatives", F.to_json(F.struct(F.lit(0).alias("_"), *group)).alias("_name"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    return every.join(sums, ["_name", "replicate"], "left").select(*group, "replicate", F.try_divide("_won", F.col("_drawn") * F.col("_negatives")).alias("auroc"))


def _with(point: DataFrame, bounds: DataFrame, group: list[str]) -> DataFrame:
    return _beside(point, bounds, group)


def _dealt_groups(table: DataFrame, group: str, label: str, base: int) -> DataFrame:
    """(group, _place): groups of each majority label numbered by seed rank, from 1."""
    groups = table.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count("*").alias("rows"))
    kind = groups.withColumn("_kind", 2 * F.col("ones") >= F.col("rows"))
    return numbered(kind, ["_kind"], [seed(F.lit("fold"), F.lit(base), F.col(group)), F.col(group)], "_place").select(group, "_place")


def group_folds(table: DataFrame, group: str, label: str, folds: int = 5, base: int = 42) -> DataFrame:
    """Adds ``fold``: all rows of a group in one fold, classes balanced by dealing groups of each majority label in turn."""
    placed = _dealt_groups(table, group, label, base)
    return table.join(placed.select(group, F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int").alias("fold")), group)


def nested_folds(table: DataFrame, group: str, label: str, folds: int = 5, inner: int = 3, base: int = 42) -> DataFrame:
    """Adds ``fold`` as ``group_folds`` and ``inner``: for each fold left out, the inner fold among the other groups (-1 in the fold itself).

    Inner folds deal the groups that remain in turn, in the same order, so one numbering gives all. A null group is one group.
    """
    place = (F.col("_place") - 1).cast("int")
    rank = [place - F.floor((place + folds - 1 - f) / folds).cast("int") for f in range(folds)]  # without those of fold f ahead
    within = F.array(*[F.when(F.pmod(place, F.lit(folds)) == f, -1).otherwise(F.pmod(r, F.lit(inner))).cast("int") for f, r in enumerate(rank)])
    placed = _dealt_groups(table, group, label, base).select(F.col(group).alias("_group"), F.pmod(place, F.lit(folds)).cast("int").alias("fold"), within.alias("inner"))
    return table.join(placed, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def fold_violations(table: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one fold; empty if the folds are sound."""
    return table.groupBy(group).agg(F.countDistinct("fold").alias("folds")).where("folds > 1")
