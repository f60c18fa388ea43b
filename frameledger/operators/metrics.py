"""Confusion cells, overlap metrics, coverage, slices and galleries of pixel tables (t truth, p prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES, IGNORED, TARGETS
from .statistics import quantiles


def confusion_cells(px: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., t, p, n) over the pixels whose truth isn't ignored."""
    return px.where(F.col("t") != IGNORED).groupBy(*by, "t", "p").agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., cls, tp, truth, pred) in one aggregation; classes that don't occur have no row."""
    sides = F.explode(
        F.array(
            F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("pred")),
            F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("pred")),
        )
    )
    return cells.select(*by, sides.alias("s")).groupBy(*by, F.col("s.cls").alias("cls")).agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "truth", "pred")])


def class_metrics(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """IoU, Dice, precision and recall of every class; a ratio without a denominator is null."""
    tp, truth, pred = F.col("tp").cast("double"), F.col("truth"), F.col("pred")
    return class_counts(cells, by).select(
        *by,
        "cls",
        F.try_divide(tp, truth + pred - F.col("tp")).alias("iou"),
        F.try_divide(2 * tp, truth + pred).alias("dice"),
        F.try_divide(tp, pred).alias("precision"),
        F.try_divide(tp, truth).alias("recall"),
        "tp",
        "truth",
        "pred",
    )


def label_rows(metrics: DataFrame) -> DataFrame:
    """One row for each class of the label dimension, null where it doesn't occur."""
    labels = metrics.sparkSession.createDataFrame(list(CLASSES.items()), "cls int, name string")
    return F.broadcast(labels).join(metrics, "cls", "left")


def summary(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., fg_macro_iou, mean_iou, accuracy, n_px): macro means skip undefined classes, a missed class counts 0."""
    target = F.col("cls").isin(*TARGETS)
    return class_metrics(cells, by).groupBy(*by).agg(
        F.avg(F.when(target, F.col("iou"))).alias("fg_macro_iou"),
        F.avg("iou").alias("mean_iou"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("truth")).alias("accuracy"),
        F.sum("truth").alias("n_px"),
    )


def row_normalized(cells: DataFrame) -> DataFrame:
    """(t, p, share) of the cells over their truth's total."""
    summed = cells.groupBy("t", "p").agg(F.sum("n").alias("n"))
    whole = F.greatest(F.sum("n").over(Window.partitionBy("t")), F.lit(1))  # at most 25 rows
    return summed.select("t", "p", "n", (F.col("n") / whole).alias("share"))


def coverage(px: DataFrame, by: list[str], column: str = "p", region: Column | None = None) -> DataFrame:
    """(by..., cov_<class>..., total_target): shares of the valid pixels in the region; groups without any are left out."""
    valid = px.where(F.col("t") != IGNORED)
    if region is not None:
        valid = valid.where(region)
    shares = [(F.count_if(F.col(column) == c) / F.count(F.lit(1))).alias(f"cov_{name}") for c, name in CLASSES.items()]
    total = (F.count_if(F.col(column).isin(*TARGETS)) / F.count(F.lit(1))).alias("total_target")
    return valid.groupBy(*by).agg(*shares, total, F.count(F.lit(1)).alias("n_px"))


def coverage_errors(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Mean absolute errors and bias in percentage points, over the keys both sides have."""
    names = ["total_target", *[f"cov_{CLASSES[c]}" for c in TARGETS]]
    t, p = truth.select(key, *[F.col(n).alias(f"t_{n}") for n in names]), predicted.select(key, *[F.col(n).alias(f"p_{n}") for n in names])
    diff = {n: F.col(f"p_{n}") - F.col(f"t_{n}") for n in names}
    return t.join(p, key).agg(
        *[(F.avg(F.abs(d)) * 100).alias(f"mae_{n}") for n, d in diff.items()],
        (F.avg(diff["total_target"]) * 100).alias("bias_total_target"),
    )


def audit_positive(total: Column, threshold: float = 0.05) -> Column:
    return total > F.lit(threshold)


def time_block(sequence: Column, frame: Column, size: int = 1000) -> Column:
    return F.concat_ws(":", F.coalesce(sequence.cast("string"), F.lit("None")), F.coalesce(F.floor(frame / size).cast("string"), F.lit("na")))


def top_per_gallery(stats: DataFrame, keys: list[str], k: int, id_col: str) -> DataFrame:
    """(gallery, rank, id, key): the k largest positive values of each key column, ties by id.

    The rows of all galleries are ranked in one window with a group limit, so only k of each are sorted whole.
    """
    long = stats.select(id_col, F.explode(F.array(*[F.struct(F.lit(c).alias("gallery"), F.col(c).cast("double").alias("key")) for c in keys])).alias("g")).select(id_col, "g.*")
    rank = F.row_number().over(Window.partitionBy("gallery").orderBy(F.col("key").desc(), id_col))
    return long.where("key > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("gallery", "rank", id_col, "key")


def quantile_bins(values: DataFrame, column: str, parts: int = 3) -> DataFrame:
    """Adds ``bin``: how many of the linear quantiles are <= the value; not ntile, whose ties differ."""
    found = quantiles(values.select(column), column, [k / parts for k in range(1, parts)])
    cuts = found.select(F.array(*found.columns).alias("cuts"))
    return values.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col(column)))).drop("cuts")  # one row


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (n_a, n_b, only_a, only_b, comparable): whether two reports are of the same keys."""
    left, right = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    n = left.join(right, key, "full").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return n.withColumn("comparable", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def differing_fields(observed: DataFrame, declared: DataFrame, field: str, value: str, tolerance: float) -> DataFrame:
    """(field, observed, declared) where the values differ by more than the tolerance or one side has none."""
    joined = observed.select(field, F.col(value).alias("observed")).join(declared.select(field, F.col(value).alias("declared")), field, "full")
    return joined.where(F.col("observed").isNull() | F.col("declared").isNull() | (F.abs(F.col("observed") - F.col("declared")) > tolerance))
