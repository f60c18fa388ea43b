"""Per-image records of an evaluation: cells, coverages, seconds and a sample of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES, TARGETS


class ShapeError(ValueError):
    """A prediction that doesn't cover its image."""


def check_shapes(truth: DataFrame, predicted: DataFrame, image: str) -> None:
    """Refuses predictions of another number of pixels than their image has, images of one side alone included."""
    a, b = (rows.groupBy(image).agg(F.count(F.lit(1)).alias("n")) for rows in (truth, predicted))
    wrong = a.alias("a").join(b.alias("b"), F.col(f"a.{image}") == F.col(f"b.{image}"), "full").where(~F.col("a.n").eqNullSafe(F.col("b.n")))
    n = wrong.count()
    if n:
        raise ShapeError(f"{n} images have a prediction of another shape")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order: each task keeps n of its own, and one merges them."""
    return rows.orderBy(*order).limit(n)


def members_by_prefix(names: DataFrame, prefix: str, n: int, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg"), name: str = "name") -> DataFrame:
    """The first n image files right under ``prefix`` in the order of their names; deeper ones and other files are passed over."""
    rest = F.substring(F.col(name), F.lit(len(prefix) + 1), F.length(name))
    image = F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(F.lower(F.col(name)), s))
    return first_n(names.where(F.startswith(F.col(name), F.lit(prefix)) & ~F.contains(rest, F.lit("/")) & (F.length(rest) > 0) & image), n, name)


def pixel_sample(px: DataFrame, image: str, pixel: str, n: int, seed: int = 0) -> DataFrame:
    """(image, sample): ids of n pixels of each image, all if it has fewer, in the order of a hash that makes every choice as likely.

    The limit on ranks goes into the tasks before the exchange, so each sends n pixels of an image at most.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(pixel).cast("string")).cast("binary"))
    ranked = px.select(image, pixel, order.alias("__o")).withColumn("__k", F.row_number().over(Window.partitionBy(image).orderBy("__o", pixel))).where(F.col("__k") <= n)
    return ranked.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", pixel))), lambda x: x[pixel]).alias("sample"))


def image_records(px: DataFrame, image: str, pixel: str, seconds: str, n_sample: int, seed: int = 0) -> DataFrame:
    """(image, n_px, cells, true_total, pred_total, seconds, sample): a row an image from its valid pixels (t, p).

    ``cells`` has a count for each truth and prediction, row by row. Counts are summed before the one exchange of each side, and both sides
    are dealt by the image, so joining them needs no other.
    """
    classes = list(CLASSES)
    cells = [F.count_if((F.col("t") == t) & (F.col("p") == p)).alias(f"c{t}_{p}") for t in classes for p in classes]
    share = {side: (F.count_if(F.col(c).isin(*TARGETS)) / F.count(F.lit(1))).alias(side) for side, c in (("true_total", "t"), ("pred_total", "p"))}
    counts = px.groupBy(image).agg(F.count(F.lit(1)).alias("n_px"), *cells, *share.values(), F.max(seconds).alias("seconds"))
    whole = counts.select(image, "n_px", F.array(*[f"c{t}_{p}" for t in classes for p in classes]).alias("cells"), *share, "seconds")
    return whole.join(pixel_sample(px, image, pixel, n_sample, seed), image)
