"""Queries of regions, resampling, pixel features and per-image records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import COVERAGE_COLUMNS, query, r6
from .functions import scalars as S
from .operators import imaging, records, regions
from .plans import views as V
from .plans.views import PX, table
from .schemas import CLASSES

# regions

#: A concave region, one that touches itself in a point, a slanted one and an empty one, by the image's number.
POLYGONS = {
    0: [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.35), (0.1, 0.9)],
    1: [(0.2, 0.2), (0.8, 0.8), (0.8, 0.2), (0.2, 0.8)],
    2: [(0.305, 0.05), (0.95, 0.455), (0.55, 0.975)],
    3: None,
}
GRID = 100
_EDGES_SQL = " UNION ALL ".join(
    f"SELECT {k} AS region, {x1 * 1.0} * {GRID}::DOUBLE AS x1, {y1 * 1.0} * {GRID}::DOUBLE AS y1, {x2 * 1.0} * {GRID}::DOUBLE AS x2, {y2 * 1.0} * {GRID}::DOUBLE AS y2"
    for k, v in POLYGONS.items() if v for (x1, y1), (x2, y2) in zip(v, v[1:] + v[:1])
)
#: Every pixel against every edge: crossings of its centre's row to the left, and whether an edge passes through it.
REGION_SQL = f"""e AS (SELECT region, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM ({_EDGES_SQL})), grid AS (SELECT unnest(range({GRID})) AS y),
on_ AS (SELECT region, y, x1, y1, x2, y2, x1 + (greatest(least(y1, y2), y) - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS a, x1 + (least(greatest(y1, y2), y + 1) - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS b FROM e JOIN grid ON y BETWEEN least(floor(least(y1, y2)), {GRID - 1}) AND least(floor(greatest(y1, y2)), {GRID - 1})),
line AS (SELECT region, y, least(floor(coalesce(least(a, b), least(x1, x2))), {GRID - 1}) AS lo, least(floor(coalesce(greatest(a, b), greatest(x1, x2))), {GRID - 1}) AS hi FROM on_),
cut AS (SELECT region, y, x1 + (y + 0.5 - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS x FROM on_ WHERE (y1 > y + 0.5) <> (y2 > y + 0.5)),
inside AS (
  SELECT DISTINCT region, y, x FROM (SELECT region, y, unnest(range(lo::BIGINT, hi::BIGINT + 1)) AS x FROM line)
  UNION SELECT region, c.y, g.y AS x FROM cut c JOIN grid g ON c.x <= g.y + 0.5 GROUP BY region, c.y, g.y HAVING count(*) % 2 = 1
)"""


def region_table(spark):
    rows = [(k, GRID, GRID, v) for k, v in POLYGONS.items()]
    return spark.createDataFrame(rows, "region int, width int, height int, vertices array<struct<x: double, y: double>>")


def grid_pixels(spark, d):
    """The pixels with whole places and the number of their image's region; of pixels of one place the latest counts."""
    px = V.pixels(spark, d).select("image_id", (F.col("image_id") % 4).cast("int").alias("region"), (F.col("event_id") % GRID).cast("int").alias("x"), (F.floor(F.col("event_id") / GRID) % GRID).cast("int").alias("y"), "t", "p", "event_id")
    return px.groupBy("image_id", "region", "y", "x").agg(F.max_by(F.struct("t", "p"), "event_id").alias("v")).select("image_id", "region", "y", "x", "v.t", "v.p")


GRID_SQL = f"gp AS (SELECT image_id, image_id % 4 AS region, (event_id // {GRID}) % {GRID} AS y, event_id % {GRID} AS x, max_by(p, event_id) AS p FROM px GROUP BY ALL)"


@query(f"WITH {REGION_SQL}, f AS (SELECT *, x - row_number() OVER (PARTITION BY region, y ORDER BY x) AS run FROM inside) SELECT region::INT AS region, y::INT AS y, min(x)::INT AS x0, (max(x) + 1)::INT AS x1, n::BIGINT AS n_images FROM f JOIN (SELECT user_id % 4 AS region, count(DISTINCT user_id) AS n FROM events GROUP BY ALL) USING (region) GROUP BY region, y, run, n")
def region_runs(spark, d):
    """The runs of every region that an image has, with the number of its images."""
    n = table(spark, d, "events").groupBy((F.col("user_id") % 4).cast("int").alias("region")).agg(F.count_distinct("user_id").alias("n_images"))
    return regions.region_runs(region_table(spark)).join(n, "region")


@query(
    f"WITH {PX}, {GRID_SQL}, {REGION_SQL} SELECT image_id, count(*) AS n_px, " + ", ".join(f"round(count_if(p = {c}) / count(*)::DOUBLE, 6) AS cov_{n}" for c, n in CLASSES.items())
    + ", round(count_if(p BETWEEN 1 AND 4) / count(*)::DOUBLE, 6) AS total_target FROM gp JOIN inside USING (region, y, x) GROUP BY image_id"
)
def coverage_in_regions(spark, d):
    """Coverage inside of each image's region, from runs of its mask and runs of the region."""
    masks = regions.mask_runs(grid_pixels(spark, d), ["image_id", "region"])
    found = regions.coverage_in_regions(masks, regions.region_runs(region_table(spark)), ["image_id"])
    return r6(found, *COVERAGE_COLUMNS)


# resampling

_AT = "greatest(0, least({n} - 1, (o + 0.5::DOUBLE) * ({n} / {m}::DOUBLE) - 0.5::DOUBLE))"
#: Bilinear weights from n to m places, as rows (o, i, w).
_WEIGHTS = "{name} AS (SELECT o, floor(pos)::BIGINT AS i, 1 - (pos - floor(pos)) AS w FROM (SELECT o, {at} AS pos FROM (SELECT unnest(range({m})) AS o)) UNION ALL SELECT o, least(floor(pos) + 1, {n} - 1)::BIGINT, pos - floor(pos) FROM (SELECT o, {at} AS pos FROM (SELECT unnest(range({m})) AS o)))"
IMAGES_SQL = "im AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings))"


def _weights(name: str, n: int, m: int) -> str:
    return _WEIGHTS.format(name=name, m=m, n=n, at=_AT.format(n=n, m=m))


def _resized_sql(name: str, source: str, n: int, m: int) -> str:
    return f"{name} AS (SELECT vec_id, wy.o AS y, wx.o AS x, sum(v * wy.w * wx.w) AS v FROM {source} JOIN w{n}_{m} wy ON wy.i = y JOIN w{n}_{m} wx ON wx.i = x GROUP BY ALL)"


def _grey(spark, d):
    return V.grey_images(spark, d).select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), "pixels")


@query(
    f"WITH {IMAGES_SQL}, {_weights('w8_13', 8, 13)}, {_weights('w13_8', 13, 8)}, {_resized_sql('up', 'im', 8, 13)}, {_resized_sql('back', 'up', 13, 8)}"
    " SELECT vec_id AS image_id, round(u.s, 5) AS resized_sum, round(b.s, 5) AS restored_sum, round(b.d, 5) AS largest_change, pad_sum FROM (SELECT vec_id, sum(v * (x + 2 * y)) AS s FROM up GROUP BY vec_id) u"
    " JOIN (SELECT vec_id, sum(back.v * (x + 2 * y)) AS s, max(abs(back.v - im.v)) AS d FROM back JOIN im USING (vec_id, x, y) GROUP BY vec_id) b USING (vec_id)"
    " JOIN (SELECT vec_id, round(sum((v - 0.45::DOUBLE * 255) / (0.25::DOUBLE * 255)) - 2 * (16 * 16 - 13 * 13), 5) AS pad_sum FROM up GROUP BY vec_id) p USING (vec_id)"
)
def resize_round_trip(spark, d):
    """Images resized to 13 by 13, normalised and padded to 16 by 16, and the way back: cropped and restored to their size."""
    up = imaging.resample(_grey(spark, d), F.lit(13), F.lit(13))
    ready = imaging.padded(imaging.normalized(F.col("pixels"), 0.45, 0.25), F.lit(13), F.lit(13), F.lit(16), F.lit(16), -2.0)
    up = up.withColumn("ready", ready)

    def total(c, width: int):
        return F.aggregate(F.transform(c, lambda v, i: v * (i % width + 2 * F.floor(i / width))), F.lit(0.0), lambda a, b: a + b)

    back = up.select("image_id", total(F.col("pixels"), 13).alias("resized_sum"), F.aggregate("ready", F.lit(0.0), lambda a, b: a + b).alias("pad_sum"), F.lit(13).alias("height"), F.lit(13).alias("width"), imaging.cropped(F.col("ready"), F.lit(16), F.lit(13), F.lit(13)).alias("pixels"))
    back = back.withColumn("pixels", F.transform("pixels", lambda v: v * F.lit(0.25 * 255) + F.lit(0.45 * 255)))
    restored = imaging.resample(back, F.lit(8), F.lit(8)).join(V.grey_images(spark, d).select("image_id", F.col("pixels").alias("original")), "image_id")
    change = F.array_max(F.zip_with("pixels", "original", lambda a, b: F.abs(a - b)))
    rows = restored.select("image_id", "resized_sum", total(F.col("pixels"), 8).alias("restored_sum"), change.alias("largest_change"), "pad_sum")
    return rows.select("image_id", *[F.round(c, 5).alias(c) for c in ("resized_sum", "restored_sum", "largest_change", "pad_sum")])


@query(
    f"WITH {IMAGES_SQL}, {_weights('w8_32', 8, 32)}, {_resized_sql('up', 'im', 8, 32)}, k AS (SELECT unnest(range(8)) AS k),"
    " r AS (SELECT vec_id, y, k AS u, sum(v * cos(pi() * (2 * x + 1) * k / 64) * sqrt(CASE k WHEN 0 THEN 1 ELSE 2 END / 32::DOUBLE)) AS s FROM up, k GROUP BY ALL),"
    " c AS (SELECT vec_id, u, k AS w, sum(s * cos(pi() * (2 * y + 1) * k / 64) * sqrt(CASE k WHEN 0 THEN 1 ELSE 2 END / 32::DOUBLE)) AS c FROM r, k GROUP BY ALL),"
    " m AS (SELECT vec_id, median(c) FILTER (u + w > 0) AS m FROM c GROUP BY vec_id) SELECT vec_id AS image_id, string_agg((c > m)::INT::VARCHAR, '' ORDER BY w, u) AS bits FROM c JOIN m USING (vec_id) GROUP BY vec_id"
)
def resampled_hash_bits(spark, d):
    """The perceptual hash as it is meant: the image at 32 by 32, its cosine transform's low corner against their median."""
    big = imaging.resample(_grey(spark, d), F.lit(32), F.lit(32))
    return big.select("image_id", S.cosine_bits(F.col("pixels"), 32).alias("bits"))


# records of images

_SAMPLE = 5


@query(
    f"WITH {PX}, v AS (SELECT *, md5('0:' || event_id) AS o FROM px WHERE t <> 255), s AS (SELECT image_id, string_agg(event_id::VARCHAR, ',' ORDER BY o, event_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o, event_id) AS k FROM v) WHERE k <= {_SAMPLE} GROUP BY image_id)"
    " SELECT image_id, count(*) AS n_px, " + "array_to_string([" + ", ".join(f"count_if(t = {t} AND p = {p})" for t in range(5) for p in range(5)) + "], ',') AS cells,"
    " round(count_if(t BETWEEN 1 AND 4) / count(*)::DOUBLE, 6) AS true_total, round(count_if(p BETWEEN 1 AND 4) / count(*)::DOUBLE, 6) AS pred_total, round(max(value), 6) AS seconds, max(sample) AS sample FROM v JOIN s USING (image_id) GROUP BY image_id"
)
def image_records(spark, d):
    """Per image its confusion cells, both coverages, seconds and a uniform sample of at most five valid pixels without replacement."""
    px = V.pixels(spark, d).where("t <> 255")
    found = records.image_records(px, "image_id", "event_id", "value", _SAMPLE)
    return r6(found.select("image_id", "n_px", F.array_join("cells", ",").alias("cells"), "true_total", "pred_total", "seconds", F.array_join("sample", ",").alias("sample")), "true_total", "pred_total", "seconds")


@query(f"WITH {PX} SELECT DISTINCT image_id FROM px ORDER BY image_id LIMIT 20")
def first_images(spark, d):
    """The first images in the order of their ids: a limited run."""
    return records.first_n(V.pixels(spark, d).select("image_id").distinct(), 20, "image_id")


# features


@query()
def tile_features(spark, d):
    """Multi-scale features of every pixel of a frame per sequence of 100 by 100, from tiles with halos."""
    px = grid_pixels(spark, d).select("image_id", "y", "x", F.col("p").cast("double").alias("value"))
    found = imaging.pixel_features(px, ["image_id"], size=50)
    return found.select("image_id", "y", "x", F.transform("features", lambda v: F.round(v, 6)).alias("features"))
