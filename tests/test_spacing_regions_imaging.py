"""Resampling of groups, spacing of frames, regions, image kernels and records against plain Python and NumPy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger import catalog
from frameledger.operators import duplicates, imaging, records, regions, resampling, spacing, statistics


# resampling


def test_binomial_is_the_inverse_of_its_distribution(spark):
    rng = random.Random(1)
    cases = [(n, p, rng.random()) for n in (1, 2, 7, 50, 333, 5000) for p in (0.02, 0.4, 0.5, 0.93) for _ in range(6)]
    df = spark.createDataFrame(cases, "n long, p double, u double")
    got = df.select("n", "p", "u", resampling.binomial(F.col("n"), F.col("p"), F.col("u")).alias("x")).collect()
    for r in got:
        total = 0.0
        for x in range(r.n + 1):
            total += math.exp(math.lgamma(r.n + 1) - math.lgamma(x + 1) - math.lgamma(r.n - x + 1) + x * math.log(r.p) + (r.n - x) * math.log(1 - r.p))
            if r.u < total:
                break
        assert r.x == x, (r, x)


@pytest.mark.parametrize("k", [1, 2, 5, 63, 150])
def test_every_replicate_draws_as_many_groups_as_there_are(spark, k):
    rows = spark.range(k).select(F.col("id").alias("g"), (F.col("id") * 10).alias("v"))
    drawn = resampling.resample(rows, k, replicates=300, block=8)
    per = Counter(r.r for r in drawn.collect())
    assert set(per.values()) == {k} and len(per) == 300
    times = Counter(r.g for r in drawn.collect())
    if k > 1:  # each group is drawn once a replicate on the average
        assert all(abs(times[g] / 300 - 1) < 6 * math.sqrt((1 - 1 / k) / 300) for g in range(k))
    assert drawn.where("v <> g * 10").count() == 0


def test_sums_of_draws_equal_those_of_drawn_rows(spark, monkeypatch):
    """Blocks of 4, so several tasks' ranges, some halved a few at a time; nulls, values that aren't finite, a column of nulls, and draws hashed in many parts."""
    monkeypatch.setattr(resampling, "SLOTS", 50)
    monkeypatch.setattr(resampling, "NODES", 7)
    k, columns = 75, ["v", "w", "x", "z"]
    rows = spark.range(k).select(
        F.col("id").alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") * 10).alias("v"), (F.col("id") / 8).alias("w"), F.when(F.col("id") == 5, F.lit(math.inf)).otherwise(1.0).alias("x"), F.when(F.col("id") < 0, 1).alias("z")
    )

    def by_replicate(drawn):
        return {r.r: r[1:] for r in drawn.groupBy("r").agg(*[F.sum(c).alias(c) for c in columns]).collect()}

    want = by_replicate(resampling.resample(rows, k, 40, 3, 4))
    assert len(want) == 40 and by_replicate(resampling.resampled_sums(rows, k, columns, 40, 3, 4)) == want
    assert resampling.resampled_sums(rows.where("g < 0"), 0, columns, 40).count() == 0
    with pytest.raises(TypeError):
        resampling.resampled_sums(rows.withColumn("v", F.col("v").cast("string")), k, ["v"])


def test_many_binomials_equal_the_expression(spark):
    rng = random.Random(5)
    cases = [(n, p, rng.random()) for n in (1, 2, 60, 5000, 540000) for p in (0.02, 0.5, 0.93) for _ in range(5)] + [(60, 0.5, 0.0), (60, 0.5, 1 - 2**-48)]
    df = spark.createDataFrame(cases, "n long, p double, u double")
    assert resampling.binomials(*[np.array(v) for v in zip(*cases)]).tolist() == [r.x for r in df.select(resampling.binomial(F.col("n"), F.col("p"), F.col("u")).alias("x")).collect()]


def test_draws_and_groups_are_not_broadcast(spark):
    """Both grow with the groups: 1,000 of them with two replicates, and the planner would take them for small."""
    rows = spark.range(1000).select(F.col("id").alias("g"), "id")
    for drawn in (resampling.resample(rows, 1000, 2), resampling.resampled_sums(rows, 1000, ["id"], 2)):
        assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap", "bootstrap_macro_iou", "participant_bootstrap"])
def test_queries_sum_groups_where_they_are_drawn(spark, monkeypatch, name):
    """A row for each draw never arises."""
    monkeypatch.setattr(statistics, "resample", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_bootstrap_of_equal_groups_and_of_a_paired_difference(spark):
    def mean(rows, by):
        return rows.groupBy(*by).agg((F.sum("good").cast("double") / F.sum("n")).alias("value"))

    equal = spark.createDataFrame([(i, 5, 10) for i in range(10)], "image long, good long, n long")
    assert statistics.interval(equal, "image", mean).first().asDict() == {"estimate": 0.5, "low": 0.5, "high": 0.5, "n_groups": 10, "few_groups": False}

    def difference(rows, by):
        return rows.groupBy(*by).agg(((F.sum("a") - F.sum("b")).cast("double") / F.sum("n")).alias("value"))

    sides = spark.createDataFrame([(i, 16, 8, 20) for i in range(10)], "image long, a long, b long, n long")
    got = statistics.interval(sides, "image", difference).first()
    assert got.estimate == pytest.approx(0.4) and got.low > 0
    none = statistics.interval(equal.where("false"), "image", mean).first()
    assert none.n_groups == 0 and none.low is None and none.estimate is None


# spacing


def frames(spark, rows):
    return spark.createDataFrame(rows, "seq string, at long, id long")


def random_frames(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(0, 400), i) for i in range(n)] + [("c", None, n + 1), ("d", 5, n + 2)]


def test_spaced_selection_equals_a_walk(spark):
    for gap in (1, 7, 60):
        rows = random_frames(300, gap)
        want = set()
        for seq in {r[0] for r in rows}:
            last = None
            for at, i in sorted((r[1], r[2]) for r in rows if r[0] == seq and r[1] is not None):
                if last is None or at - last >= gap:
                    want.add((seq, i))
                    last = at
        named = [r for r in rows if r[0] is not None]
        got = {(r.seq, r.id) for r in spacing.spaced_selection(frames(spark, named), "seq", "at", "id", gap).collect()}
        assert got == {w for w in want if w[0] is not None}
    assert spacing.spaced_selection(frames(spark, []), "seq", "at", "id", 3).count() == 0


def test_spaced_draw_equals_going_through_the_pool(spark):
    rng = random.Random(8)
    pool = [(rng.choice(["a", "b", None]), rng.randrange(0, 900), i, f"{rng.randrange(40):02d}") for i in range(250)]
    chosen = [("a", 450, 1000, "x"), ("b", 10, 1001, "x"), pool[0]]
    schema = "seq string, at long, id long, priority string"
    for n in (0, 5, 1000):
        want, taken = [], list(chosen)
        for seq, at, i, p in sorted(pool, key=lambda r: (r[3], r[2])):
            if len(want) < n and all(o[2] != i and (o[0] is None or o[0] != seq or abs(o[1] - at) >= 40) for o in taken):
                want.append(i)
                taken.append((seq, at, i, p))
        got = spacing.spaced_draw(spark.createDataFrame(pool, schema), spark.createDataFrame(chosen, schema), n, 40)
        assert sorted(r.id for r in got.collect()) == sorted(want)
    assert spacing.spaced_draw(spark.createDataFrame([], schema), spark.createDataFrame(chosen, schema), 3, 40).count() == 0


def test_nearest_gap_and_split_gaps_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(0, 5000), i, rng.choice(["train", "val", "test"])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq string, at long, id long, split string").repartition(5)
    got = {r.id: r.gap for r in duplicates.nearest_gap(df.where("split = 'train'"), df.where("split <> 'train'"), "seq", "at", "id").collect()}
    want = {i: min(abs(at - b) for s, b, _, t in rows if s == seq and t != "train") for seq, at, i, split in rows if split == "train" and seq}
    assert got == want
    pairs = {}
    for (s, a, _, x), (t, b, _, y) in ((p, q) for p in rows for q in rows):
        if s and s == t and x < y:
            pairs[f"{x}|{y}"] = min(abs(a - b), pairs.get(f"{x}|{y}", 1 << 30))
    assert {r.pair: r.min_gap for r in duplicates.min_split_gaps(df, "seq", "at").collect()} == pairs


# regions


def twin(vertices, w, h):
    """The region's mask pixel by pixel: even-odd at centres, and edges cut to each pixel's row."""
    mask = np.zeros((h, w), dtype=bool)
    pts = [(x * w, y * h) for x, y in vertices]
    edges = list(zip(pts, pts[1:] + pts[:1]))
    for j in range(h):
        c = j + 0.5
        xs = sorted(x1 + (c - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in edges if (y1 > c) != (y2 > c))
        for a, b in zip(xs[::2], xs[1::2]):
            for i in range(w):
                mask[j, i] |= a <= i + 0.5 < b
        for (x1, y1), (x2, y2) in edges:
            lo, hi = min(y1, y2), max(y1, y2)
            if not min(math.floor(lo), h - 1) <= j <= min(math.floor(hi), h - 1):
                continue
            ends = (x1, x2) if y1 == y2 else [x1 + (y - y1) * (x2 - x1) / (y2 - y1) for y in (max(lo, j), min(hi, j + 1))]
            mask[j, min(math.floor(min(ends)), w - 1) : min(math.floor(max(ends)), w - 1) + 1] = True
    return mask


SHAPES = {
    0: [(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)],
    1: [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.3), (0.1, 0.9)],
    2: [(0.2, 0.2), (0.8, 0.8), (0.8, 0.2), (0.2, 0.8)],
    3: [(0.33, 0.01), (0.99, 0.5), (0.41, 0.97), (0.02, 0.6)],
    4: [(0.5, 0.5), (0.5, 0.5), (0.5, 0.5)],
    5: [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)],
}
REGIONS = "region int, width int, height int, vertices array<struct<x: double, y: double>>"


def test_regions_equal_their_pixels(spark):
    rows = [(k, 20, 10, v) for k, v in SHAPES.items()] + [(k + 10, 31, 47, v) for k, v in SHAPES.items()] + [(99, 5, 5, None)]
    df = spark.createDataFrame(rows, REGIONS)
    regions.check_regions(df)
    got = {k: np.zeros((h, w), dtype=int) for k, w, h, _ in rows}
    runs = regions.region_runs(df).collect()
    for r in runs:
        got[r.region][r.y, r.x0 : r.x1] += 1
    for k, w, h, v in rows:
        assert got[k].tolist() == (twin(v, w, h) if v else np.zeros((h, w))).astype(int).tolist(), k
    ends = Counter((r.region, r.y, r.x1) for r in runs)
    assert not any((r.region, r.y, r.x0) in ends for r in runs)  # the fewest runs
    assert got[0][:, :10].all() and not got[0][:, 12:].any() and got[5].all()


def test_regions_that_are_none(spark):
    for vertices, says in (([(0.0, 0.0), (1.0, 1.0)], "at least 3|fewer than 3"), ([(0.0, 0.0), (1.5, 0.0), (0.0, 1.0)], "outside"), ([(0.0, 0.0), (None, 0.0), (0.0, 1.0)], "outside")):
        with pytest.raises(regions.RegionError, match=says):
            regions.check_regions(spark.createDataFrame([(1, 10, 10, vertices)], REGIONS))


def test_coverage_in_regions_counts_overlaps(spark):
    rng = random.Random(2)
    px = [(img, img % 7, x, y, rng.choice([0, 0, 1, 4, 255])) for img in range(9) for x in range(20) for y in range(10)]
    df = spark.createDataFrame(px, "image int, region int, x int, y int, p int")
    runs = regions.region_runs(spark.createDataFrame([(k, 20, 10, v) for k, v in SHAPES.items()] + [(6, 20, 10, None)], REGIONS))
    got = {r.image: (r.n_px, round(r.cov_metal, 9), round(r.total_target, 9)) for r in regions.coverage_in_regions(regions.mask_runs(df, ["image", "region"]), runs, ["image"]).collect()}
    want = {}
    for img in range(9):
        if img % 7 == 6:
            continue
        mask = twin(SHAPES[img % 7], 20, 10)
        inside = [p for i, _, x, y, p in px if i == img and mask[y, x] and p != 255]
        if inside:
            want[img] = (len(inside), round(inside.count(4) / len(inside), 9), round(sum(1 <= p <= 4 for p in inside) / len(inside), 9))
    assert got == want


# image kernels


def test_resampling_equals_numpy_for_mixed_sizes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, h, w, rng.random(h * w).tolist()) for i, (h, w) in enumerate([(8, 8), (5, 9), (8, 8), (1, 1), (3, 7)])] + [(9, 2, 2, None)]
    df = spark.createDataFrame(rows, "n int, height int, width int, pixels array<double>")
    for how in imaging.MATRICES:
        got = {r.n: r for r in imaging.resample(df, F.col("height") + 3, F.lit(4), how).collect()}
        assert got[9].pixels is None and got[9].height == 5
        for n, h, w, p in rows[:-1]:
            image, out = np.array(p).reshape(h, w), np.zeros((h + 3, 4))
            for y in range(h + 3):
                for x in range(4):
                    sy, sx = (y + 0.5) * h / (h + 3) - 0.5, (x + 0.5) * w / 4 - 0.5
                    if how == "nearest":
                        out[y, x] = image[min(int(sy + 0.5), h - 1), min(int(sx + 0.5), w - 1)]
                    elif how == "bilinear":
                        sy, sx = min(max(sy, 0), h - 1), min(max(sx, 0), w - 1)
                        y0, x0 = int(sy), int(sx)
                        y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
                        a, b = sy - y0, sx - x0
                        out[y, x] = (1 - a) * ((1 - b) * image[y0, x0] + b * image[y0, x1]) + a * ((1 - b) * image[y1, x0] + b * image[y1, x1])
            if how != "area":
                assert np.allclose(np.array(got[n].pixels).reshape(h + 3, 4), out)
    whole = imaging.resample(df.where("n = 0"), F.lit(4), F.lit(2), "area").first().pixels
    assert np.allclose(np.array(whole).reshape(4, 2), np.array(rows[0][3]).reshape(4, 2, 2, 4).mean(axis=(1, 3)))
    same = imaging.resample(df, F.col("height"), F.col("width")).where("n = 1").first().pixels
    assert np.allclose(same, rows[1][3])


def test_padding_is_undone_by_cropping(spark):
    df = spark.createDataFrame([(2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "height int, width int, pixels array<double>")
    grown = df.select(imaging.padded(F.col("pixels"), F.col("height"), F.col("width"), F.lit(3), F.lit(4), -1.0).alias("pixels"))
    assert grown.first().pixels == [1, 2, 3, -1, 4, 5, 6, -1, -1, -1, -1, -1]
    assert grown.select(imaging.cropped(F.col("pixels"), F.lit(4), F.lit(2), F.lit(3)).alias("p")).first().p == [1, 2, 3, 4, 5, 6]


def test_features_of_tiles_equal_those_of_the_whole(spark):
    rng = np.random.default_rng(2)
    image = rng.random((37, 53))
    px = spark.createDataFrame([(1, y, x, float(image[y, x]), "t") for y in range(37) for x in range(53)], "image int, y int, x int, value double, ty string")
    whole = imaging.features_of(image)
    for size in (11, 64):
        got = imaging.pixel_features(px.drop("ty"), ["image"], size=size).collect()
        assert len(got) == image.size
        assert all(np.allclose(r.features, whole[:, r.y, r.x]) for r in got)
    flat = imaging.features_of(np.full((20, 20), 3.0))
    assert np.allclose(flat[0], 3) and np.allclose(flat[1:4], 0, atol=1e-9)


def test_features_of_scattered_pixels_equal_those_of_the_whole(spark):
    """Images of few pixels, one wholly filled, narrow ones, corners and a value that isn't finite, in batches that cut tiles apart."""
    rng = np.random.default_rng(7)
    images = {}
    for name, (h, w), n in (("a", (120, 90), 150), ("b", (70, 70), 4900), ("c", (1, 60), 9), ("d", (40, 2), 12), ("e", (1, 1), 1), ("f", (60, 60), 40)):
        spots = {int(i) for i in rng.choice(h * w, min(n, h * w), replace=False)} | {0, w - 1, (h - 1) * w, h * w - 1}
        images[name] = (h, w, {(i // w, i % w): float(rng.integers(0, 5)) for i in spots})
    images["f"][2][(30, 30)] = math.inf
    rows = [(name, y, x, v) for name, (_, _, px) in images.items() for (y, x), v in px.items()]
    df = spark.createDataFrame(rows, "image string, y int, x int, value double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        found = imaging.pixel_features(df, ["image"], size=30)
        got = {(r.image, r.y, r.x): r.features for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for name, (h, w, px) in images.items():
        image = np.zeros((h, w))
        for spot, v in px.items():
            image[spot] = v
        whole = imaging.features_of(image)
        for (y, x) in px:
            if name != "f" or max(abs(y - 30), abs(x - 30)) > 2 * imaging.halo():
                assert np.allclose(got[name, y, x], whole[:, y, x], rtol=0, atol=1e-12), (name, y, x)
    assert not np.isfinite(got["f", 30, 30]).any()
    # Python is called for many tiles at once, not for each
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


# records


def test_samples_are_uniform_and_shapes_are_checked(spark):
    px = spark.range(6000).select((F.col("id") % 30).alias("image"), F.col("id").alias("pixel"), F.lit(1).alias("t"), F.lit(1).alias("p"), F.lit(0.5).alias("s"))
    got = records.image_records(px, "image", "pixel", "s", 20).collect()
    assert len(got) == 30 and all(len(set(r.sample)) == 20 and r.n_px == 200 and sum(r.cells) == 200 for r in got)
    places = Counter(p // 30 // 50 for r in got for p in r.sample)
    assert all(abs(n - 150) < 60 for n in places.values())
    assert all(len(r.sample) == 200 for r in records.image_records(px, "image", "pixel", "s", 500).collect())
    records.check_shapes(px, px, "image")
    with pytest.raises(records.ShapeError, match="1 images"):
        records.check_shapes(px, px.where("pixel <> 7"), "image")
    plan = records.pixel_sample(px, "image", "pixel", 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_members_by_prefix(spark):
    names = spark.createDataFrame([("a/b2.png",), ("a/b1.PNG",), ("a/x/b0.png",), ("a/notes.txt",), ("b/c.png",), ("a/",), ("a/c.jpg",)], "name string")
    assert [r.name for r in records.members_by_prefix(names, "a/", 2).collect()] == ["a/b1.PNG", "a/b2.png"]
