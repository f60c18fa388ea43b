"""Inspection regions as runs of pixels: polygons filled by scan lines, with their outline, joined to pixels by row.

A region is rasterised once for all images that share it, whatever their number, and as runs, of which a row has
at most as many as the polygon has edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CLASSES, IGNORED, TARGETS


class RegionError(ValueError):
    """A polygon that is no region."""


def check_regions(regions: DataFrame) -> None:
    """Refuses polygons of fewer than three vertices and vertices outside of [0, 1]; a null polygon is an empty region."""
    known = regions.where("vertices IS NOT NULL")
    outside = F.exists("vertices", lambda v: v.isNull() | ~F.coalesce(v["x"].between(0, 1) & v["y"].between(0, 1), F.lit(False)))
    few, out = known.agg(F.count_if(F.size("vertices") < 3), F.count_if(outside)).first()
    if few:
        raise RegionError(f"{few} regions have fewer than 3 vertices")
    if out:
        raise RegionError(f"{out} regions have vertices outside of the normalized [0, 1] range")


def _edges(regions: DataFrame) -> DataFrame:
    """(region, width, height, x1, y1, x2, y2) in pixels, the last vertex leading to the first."""
    after = F.concat(F.slice("vertices", F.lit(2), F.size("vertices")), F.slice("vertices", 1, 1))
    each = regions.where("vertices IS NOT NULL").select("region", "width", "height", F.explode(F.arrays_zip(F.col("vertices").alias("a"), after.alias("b"))).alias("e"))
    return each.select("region", "width", "height", *[(F.col(f"e.{v}.{c}") * F.col(side)).alias(f"{c}{i}") for i, v in ((1, "a"), (2, "b")) for c, side in (("x", "width"), ("y", "height"))])


def region_runs(regions: DataFrame) -> DataFrame:
    """(region, y, x0, x1): the pixels [x0, x1) of each row of each region, as the fewest runs.

    ``regions`` has (region, width, height, vertices as array of (x, y) in [0, 1]). A pixel belongs to a region if its centre
    lies inside by the even-odd rule, or if an edge passes through the pixel. Edges may cross and touch; a null polygon has no runs.
    """
    e = _edges(regions)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    last = F.col("height") - 1
    rows = F.sequence(F.least(F.floor(low).cast("int"), last), F.least(F.floor(high).cast("int"), last))
    on = e.withColumn("y", F.explode(rows))
    rise = F.col("y2") - F.col("y1")

    def at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(rise, F.lit(0.0))

    a, b = at(F.greatest(low, F.col("y").cast("double"))), at(F.least(high, F.col("y") + F.lit(1.0)))
    left, right = F.coalesce(F.least(a, b), F.least("x1", "x2")), F.coalesce(F.greatest(a, b), F.greatest("x1", "x2"))
    side = F.col("width") - 1
    outline = on.select("region", "y", F.least(F.floor(left).cast("int"), side).alias("x0"), (F.least(F.floor(right).cast("int"), side) + 1).alias("x1"))
    centre = F.col("y") + F.lit(0.5)
    crossing = on.where((F.col("y1") > centre) != (F.col("y2") > centre)).select("region", "width", "y", at(centre).alias("x"))
    order = Window.partitionBy("region", "y").orderBy("x")
    pairs = crossing.withColumn("k", F.row_number().over(order)).withColumn("until", F.lead("x").over(order)).where("k % 2 = 1")
    start, end = F.greatest(F.lit(0), F.ceil(F.col("x") - 0.5).cast("int")), F.least(F.col("width"), F.ceil(F.col("until") - 0.5).cast("int"))
    filled = pairs.select("region", "y", start.alias("x0"), end.alias("x1")).where("x1 > x0")
    ordered = Window.partitionBy("region", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = outline.unionByName(filled).withColumn("fresh", F.when(F.col("x0") <= reach, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("region", "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select("region", "y", "x0", "x1")


def mask_runs(px: DataFrame, by: list[str], value: str = "p") -> DataFrame:
    """(by..., y, x0, x1, value): the runs of equal values in each row of masks given as pixels (x, y)."""
    order = Window.partitionBy(*by, "y").orderBy("x")
    changed = (F.col("x") - F.lag("x").over(order) != 1) | ~F.col(value).eqNullSafe(F.lag(value).over(order)) | F.lag("x").over(order).isNull()
    numbered = px.withColumn("__new", F.when(changed, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "y", "__run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.first(value).alias(value)).drop("__run")


def coverage_in_regions(masks: DataFrame, runs: DataFrame, by: list[str], value: str = "p") -> DataFrame:
    """(by..., n_px, cov_<class>..., total_target): shares of the pixels of runs ``masks`` that lie in their region's runs.

    ``masks`` has (by..., region, y, x0, x1, value), ignored values left out. Both sides are joined by region and row, and the overlap of two
    runs is counted, not their pixels. Images without a pixel in their region have no row.
    """
    m, r = masks.where(F.col(value) != IGNORED).alias("m"), runs.alias("r")
    overlap = F.least("m.x1", "r.x1") - F.greatest("m.x0", "r.x0")
    met = m.join(r, (F.col("m.region") == F.col("r.region")) & (F.col("m.y") == F.col("r.y")) & (F.col("m.x0") < F.col("r.x1")) & (F.col("r.x0") < F.col("m.x1")))
    n = met.select(*[F.col(f"m.{c}").alias(c) for c in by], F.col(f"m.{value}").alias("cls"), overlap.cast("long").alias("n"))
    shares = [(F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"cov_{name}") for c, name in CLASSES.items()]
    total = (F.sum(F.when(F.col("cls").isin(*TARGETS), F.col("n")).otherwise(0)) / F.sum("n")).alias("total_target")
    return n.groupBy(*by).agg(F.sum("n").alias("n_px"), *shares, total)
