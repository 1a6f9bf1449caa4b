"""Score predicates, views over JSON extras, and closed-form statistics of one row."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = float("-inf"), float("inf")
NEGLIGIBLE = 1e-25  # a term beside the largest one of a sum


def clean(x: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(x), x)


def detected(score: Column, status: Column, embed_status: Column, threshold: Column | float) -> Column:
    """Status OK, a score that is there, no failed insertion, and at the threshold or above."""
    tau = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    usable = (status == "OK") & ~embed_status.eqNullSafe(F.lit("FAILED")) & ~F.isnan(score)
    return F.coalesce(usable & (score >= tau), F.lit(False))


def floored(score: Column, status: Column, embed_status: Column | None = None) -> Column:
    """Failures and missing scores as minus infinity."""
    bad = ~status.eqNullSafe(F.lit("OK")) | score.isNull() | F.isnan(score)
    if embed_status is not None:
        bad = bad | embed_status.eqNullSafe(F.lit("FAILED"))
    return F.when(bad, F.lit(LOWEST)).otherwise(score)


def primary_view(table: DataFrame, field: str, score: str = "score", extra: str = "extra_json", status: str = "status") -> DataFrame:
    """Score from a JSON field; the native score stays beside it; a missing field is a failure."""
    promoted = F.get_json_object(extra, f"$.{field}").try_cast("double")
    return table.withColumn("native_score", F.col(score)).withColumn(score, promoted).withColumn(status, F.when(F.col(score).isNull() & (F.col(status) == "OK"), "FAILED").otherwise(F.col(status)))


def secondary_view(table: DataFrame, value: Column, score: str = "score", status: str = "status") -> DataFrame:
    """Another value as the score; rows without it fail."""
    held = table.withColumn("_value", clean(value.cast("double")))
    out = held.withColumn(status, F.when(F.col("_value").isNull() & (F.col(status) == "OK"), "FAILED").otherwise(F.col(status)))
    return out.withColumn(score, F.col("_value")).drop("_value")


def flag_share(flags_json: Column, left_out: list[str] | None = None) -> Column:
    """Share of true flags in a JSON object of flags, without the rules left out; null if none is left."""
    flags = F.map_values(F.map_filter(F.from_json(flags_json, "map<string,boolean>"), lambda k, v: ~k.isin(*(left_out or [""])) & v.isNotNull()))
    return F.try_divide(F.size(F.filter(flags, lambda v: v)).cast("double"), F.size(flags).cast("double"))


def json_threshold(tau: Column) -> Column:
    return F.when(tau == HIGHEST, "Infinity").otherwise(tau.cast("string"))


def shown(value: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """value [low, high], or the value alone."""
    form = f"%.{digits}f"
    bounded = F.format_string(f"{form} [{form}, {form}]", value, low, high)
    return F.when(value.isNull() | F.isnan(value), "").when(low.isNull() | high.isNull(), F.format_string(form, value)).otherwise(bounded)


def wilson(successes: Column, n: Column, alpha: float = 0.05) -> Column:
    """Struct (low, high) of Wilson's interval; null without trials."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    trials = F.when(n > 0, n.cast("double"))
    p = successes / trials
    middle = (p + z * z / (2 * trials)) / (1 + z * z / trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / (1 + z * z / trials)
    bound = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when(trials.isNotNull(), F.struct(bound(middle - half).alias("low"), bound(middle + half).alias("high")))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for n trials of probability p, summed in logs from the largest term both ways, until terms no longer count."""
    if k <= 0:
        return 1.0
    if p in (0.0, 1.0):
        return p
    whole, yes, no = math.lgamma(n + 1), math.log(p), math.log1p(-p)
    log = lambda i: whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * yes + (n - i) * no
    first = min(n, max(k, int((n + 1) * p)))
    top, total = log(first), 0.0
    for side in (range(first, n + 1), range(first - 1, k - 1, -1)):
        for i in side:
            total += (x := math.exp(log(i) - top))
            if x < NEGLIGIBLE:
                break
    return min(1.0, math.exp(top) * total)


def _solved(test, low: float = 0.0, high: float = 1.0) -> float:
    for _ in range(100):
        mid = (low + high) / 2
        if mid in (low, high):
            break  # neighbours
        low, high = (mid, high) if test(mid) else (low, mid)
    return (low + high) / 2


@lru_cache(maxsize=1 << 16)
def exact_bounds(k: int, n: int, alpha: float) -> tuple[float, float]:
    """Clopper and Pearson's interval, by bisection on the exact tails; many cells share few pairs (k, n), so a worker keeps them."""
    low = 0.0 if k == 0 else _solved(lambda p: _tail(k, n, p) < alpha / 2)
    high = 1.0 if k == n else _solved(lambda p: 1 - _tail(k + 1, n, p) > alpha / 2)
    return low, high


def clopper_pearson(successes: Column, n: Column, alpha: float = 0.05) -> Column:
    """Struct (low, high); null without trials. For aggregated counts: an Arrow UDF, a row per cell."""

    @F.pandas_udf("low double, high double")
    def of(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        rows = [exact_bounds(int(k), int(m), alpha) if m == m and m and m > 0 else (None, None) for k, m in zip(ks, ns, strict=True)]
        return pd.DataFrame(rows, columns=["low", "high"])

    return of(successes, n)


def adaptive_p(green: Column, total: Column, gamma: float) -> Column:
    """Upper tail of a binomial: exact below 100 trials, normal from there on."""

    @F.pandas_udf("double")
    def of(gs: pd.Series, ts: pd.Series) -> pd.Series:
        def one(g: int, t: int) -> float:
            if t < 100:
                return _tail(g, t, gamma)
            return 0.5 * math.erfc((g - gamma * t) / math.sqrt(2 * t * gamma * (1 - gamma)))

        return pd.Series([one(int(g), int(t)) if t and t == t else None for g, t in zip(gs, ts, strict=True)], dtype="float64")

    return of(green, total)


def neg_log10(p: Column) -> Column:
    return F.when(p <= 0, F.lit(HIGHEST)).otherwise(-F.log10(p))


def green_z(n_green: Column, n: Column, gamma: float) -> Column:
    """Standard score of the green count; null without tokens."""
    trials = F.when(n > 0, n.cast("double"))
    return (n_green - gamma * trials) / F.sqrt(trials * gamma * (1 - gamma))


def residual_z(n_green: Column, n_marked: Column, n_other: Column, gamma: float) -> Column:
    """Green tokens beyond those that the marked ones and chance explain."""
    trials = F.when(n_other > 0, n_other.cast("double"))
    return (n_green - n_marked - gamma * trials) / F.sqrt(trials * gamma * (1 - gamma))


def bit_matches(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x)


def xor_bits(a: Column, b: Column) -> Column:
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == "", "").when(x == y, "0").otherwise("1")), "")


def decode_rounds(bits: Column, width: int = 24) -> Column:
    """Complete rounds of a bit string: each one's first half XOR its second."""
    rounds = F.transform(F.sequence(F.lit(0), F.floor(F.length(bits) / width).cast("int") - 1), lambda r: F.substr(bits, r * width + 1, F.lit(width)))
    half = width // 2
    return F.when(F.length(bits) >= width, F.transform(rounds, lambda b: xor_bits(F.substr(b, F.lit(1), F.lit(half)), F.substr(b, F.lit(half + 1), F.lit(half))))).otherwise(F.expr("cast(array() as array<string>)"))


def applies_to(cells: Column, model: Column, language: Column) -> Column:
    """Whether a grid point holds for a cell: no list of (model, language) is every cell, a null axis excludes nothing."""
    fits = lambda c: (model.isNull() | (c["model_id"] == model)) & (language.isNull() | (c["language"] == language))
    return cells.isNull() | F.coalesce(F.exists(cells, fits), F.lit(False))


def distance(similarity: Column, same: Column) -> Column:
    """One less the similarity, to six places, halves to even; none between equal texts."""
    return F.when(same, 0.0).otherwise(F.bround(1 - similarity, 6))
