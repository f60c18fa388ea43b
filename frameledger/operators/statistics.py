"""Group bootstrap, calibration and percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import right_closed_bin
from ..sources.shared import stored
from .resampling import resample, resampled_sums


def running(rows: DataFrame, by: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """Adds ``before_<c>`` for each of ``columns``: its sum over the rows of the group that come before in the order.

    Rows are dealt to ranges of the order and written; a range's start comes from the sums of those before it, of which
    there are as many as partitions, so neither a group nor the whole table is sorted in one task. The values of ``order`` differ
    inside a group.
    """
    key = F.col(order).desc() if descending else F.col(order)
    ranged = stored(rows.repartitionByRange(*[F.col(c) for c in by], key).withColumn("__r", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    earlier = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__r").alias("__at"), *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__start_{c}") for c in columns])
    same = F.col("__r") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = Window.partitionBy(*by, "__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(starts, same).withColumns({f"before_{c}": F.col(f"__start_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return placed.select(*rows.columns, *[f"before_{c}" for c in columns])


def numbered_groups(sums: DataFrame, group: str) -> DataFrame:
    """Adds g, the place of each group in order, and k, their number; a group has one row."""
    numbered = running(sums.withColumn("__one", F.lit(1).cast("long")), [], group, ["__one"])
    return numbered.withColumnRenamed("before___one", "g").drop("__one").crossJoin(F.broadcast(sums.agg(F.count_distinct(group).alias("k"))))  # one row


def intervals(sums: DataFrame, group: str, statistics: dict[str, Callable[[DataFrame, list[str]], DataFrame]], replicates: int = 2000, seed: int = 0, confidence: float = 0.95, summed: list[str] | None = None) -> DataFrame:
    """(statistic, estimate, low, high, n_groups, few_groups) of each of ``statistics`` under the same resampling of whole groups; no groups give nulls.

    ``sums`` is already summed by group, a row a group, so a replicate draws group rows and not the rows under them.
    A statistic gets the drawn rows with columns r and times (1: a group drawn twice is two rows) and the columns to group by, and returns (r, value); columns that belong to several runs or
    sides of a comparison are drawn together. Undefined values are left out of the interval. Where statistics take nothing but ``F.sum`` of
    columns, ``summed`` names these: they get sums of drawn rows, added up where they are drawn.
    """
    rows = stored(numbered_groups(sums, group).withColumn("times", F.lit(1).cast("long")), "groups")
    k = rows.count()
    tail = (1 - confidence) / 2
    if summed is None:
        drawn = resample(rows.drop("k"), k, replicates, seed)
    else:  # a row a replicate, written for the statistics
        drawn = stored(resampled_sums(rows, k, summed, replicates, seed).groupBy("r").agg(*[F.sum(c).alias(c) for c in summed]), "sums")
    out = None
    for name, statistic in statistics.items():
        values = statistic(drawn, ["r"]).where(~F.isnan("value"))  # a row a replicate
        cuts = values.agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
        whole = statistic(rows.drop("k").withColumn("r", F.lit(0).cast("long")), ["r"]).agg(F.max("value").alias("estimate"))
        one = whole.crossJoin(cuts).select(F.lit(name).alias("statistic"), "estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.lit(k).cast("long").alias("n_groups"), F.lit(k < 5).alias("few_groups"))  # one row each
        out = one if out is None else out.union(one)
    return out


def interval(sums: DataFrame, group: str, statistic: Callable[[DataFrame, list[str]], DataFrame], replicates: int = 2000, seed: int = 0, confidence: float = 0.95, summed: list[str] | None = None) -> DataFrame:
    """(estimate, low, high, n_groups, few_groups): :func:`intervals` of one statistic."""
    return intervals(sums, group, {"": statistic}, replicates, seed, confidence, summed).drop("statistic")


def bootstrap(sums: DataFrame, group: str, statistic: Callable[[DataFrame, list[str]], DataFrame], replicates: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(low, high, n_groups, few_groups): :func:`interval` without the estimate."""
    return interval(sums, group, statistic, replicates, seed, confidence).drop("estimate")


def ece_bins(predictions: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, gap) over right-closed equal bins; empty bins have no row."""
    return predictions.groupBy(right_closed_bin(F.col(confidence), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    ).withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def nll(predictions: DataFrame, p_true: Column) -> DataFrame:
    return predictions.agg(F.avg(-F.ln(F.greatest(p_true, F.lit(1e-12)))).alias("nll"))


def fit_temperature(predictions: DataFrame, logits: str, truth: str, low: float = 0.05, high: float = 20.0, grid: int = 24, passes: int = 3) -> float:
    """The temperature of the least NLL: a grid of log temperatures in one aggregation, then refined.

    Every pass is one job over all predictions; the driver sees ``grid`` numbers.
    """
    import math

    lo, hi = math.log(low), math.log(high)
    best = 1.0
    for _ in range(passes):
        steps = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
        top = F.array_max(logits)

        def loss(log_t: float) -> Column:
            t = F.lit(math.exp(log_t))
            total = F.aggregate(F.transform(logits, lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, b: a + b)
            return F.avg(F.ln(total) - (F.get(logits, F.col(truth)) - top) / t)

        row = predictions.agg(*[loss(s).alias(f"s{i}") for i, s in enumerate(steps)]).first()
        at = min(range(grid), key=lambda i: (row[i] if row[i] is not None else math.inf, i))
        best = math.exp(steps[at])
        lo, hi = steps[max(0, at - 1)], steps[min(grid - 1, at + 1)]
    return round(best, 4)


def class_temperatures(predictions: DataFrame, logits: str, truth: str, predicted: str, classes: int, low: float = 0.05, high: float = 20.0, grid: int = 24, passes: int = 3) -> list[float]:
    """A temperature for each predicted class, as :func:`fit_temperature` fits one; 1 for a class that is never predicted.

    A pass is one aggregation by class; the driver sees ``classes * grid`` numbers.
    """
    import math

    ends = [(math.log(low), math.log(high))] * classes
    best = [1.0] * classes
    top = F.array_max(logits)
    for _ in range(passes):
        lows, spans = (F.array(*[F.lit(v) for v in vs]) for vs in ([a for a, _ in ends], [b - a for a, b in ends]))

        def loss(i: int) -> Column:
            t = F.exp(F.get(lows, F.col(predicted)) + F.get(spans, F.col(predicted)) * i / F.lit(float(grid - 1)))
            total = F.aggregate(F.transform(logits, lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, b: a + b)
            return F.avg(F.ln(total) - (F.get(logits, F.col(truth)) - top) / t)

        for row in predictions.where(F.col(predicted).between(0, classes - 1)).groupBy(predicted).agg(*[loss(i).alias(f"s{i}") for i in range(grid)]).collect():  # a row a class
            k, losses = row[0], row[1:]
            at = min(range(grid), key=lambda i: (losses[i] if losses[i] is not None else math.inf, i))
            lo, hi = ends[k]
            best[k] = math.exp(lo + (hi - lo) * at / (grid - 1))
            ends[k] = (lo + (hi - lo) * max(0, at - 1) / (grid - 1), lo + (hi - lo) * min(grid - 1, at + 1) / (grid - 1))
    return [round(t, 4) for t in best]


def _counted(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., column, k, before_k, n): how often each value of a group occurs, how many are less, and the group's rows with one."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("k"))
    placed = running(counts, by, column, ["k"])
    whole = placed.groupBy(*by).agg(F.sum("k").alias("n")).select(*[F.col(c).alias(f"__of_{c}") for c in by], "n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(whole, same).select(*by, column, "k", "before_k", "n") if by else placed.crossJoin(F.broadcast(whole))  # one row


def _cut(column: str, q: float) -> Column:
    """The value at the quantile ``q`` over a group's :func:`_counted` rows, with linear interpolation."""

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_k") <= place) & (place < F.col("before_k") + F.col("k")), F.col(column)))

    place = F.lit(q) * (F.col("n") - 1)
    low, high = at(F.floor(place)), at(F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def quantiles(rows: DataFrame, column: str, qs: list[float], by: list[str] = []) -> DataFrame:
    """(by..., q0, q1...): exact quantiles by counting values in ranges, so that no task holds a column; one row of nulls without values and groups."""
    return _counted(rows, column, by).groupBy(*by).agg(*[_cut(column, q).alias(f"q{i}") for i, q in enumerate(qs)])


def percentiles(rows: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """(by..., p50, p95, max, mean, n): exact, with linear interpolation, by counting values in ranges."""
    mean = F.sum(F.col(column) * F.col("k")) / F.sum("k")
    return _counted(rows, column, by).groupBy(*by).agg(_cut(column, 0.5).alias("p50"), _cut(column, 0.95).alias("p95"), F.max(column).alias("max"), mean.alias("mean"), F.sum("k").alias("n"))


def nearest_rank(rows: DataFrame, column: str, q: float, by: list[str]) -> DataFrame:
    """The value at place round-half-even(q * (n - 1)) of each group, by counting and not by collecting."""
    counted = _counted(rows, column, by)
    place = F.bround(F.lit(q) * (F.col("n") - 1)).cast("long")
    return counted.where((F.col("before_k") <= place) & (place < F.col("before_k") + F.col("k"))).select(*by, F.col(column).alias("value"))


def cumulative_histogram(rows: DataFrame, column: str, bounds: list[float], by: list[str] = []) -> DataFrame:
    """(by..., le, n): one conditional count a bound in a single aggregation, then turned into rows."""
    wide = rows.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("h")).select(*by, "h.*")
