"""Hand-computed cases of the engine's operators."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from frameledger.functions import scalars as S
from frameledger.sources import images
from frameledger.operators import duplicates, jobs, metrics, review, splits, statistics


def one(df):
    return df.first().asDict()


def px(spark, truth, pred, image="a"):
    return spark.createDataFrame([(image, t, p) for t, p in zip(truth, pred)], "image_id string, t int, p int")


def test_confusion_ignores_255(spark):
    rows = metrics.confusion_cells(px(spark, [0, 1, 255], [0, 2, 4])).collect()
    assert {(r.t, r.p, r.n) for r in rows} == {(0, 0, 1), (1, 2, 1)}


def test_iou_family(spark):
    cells = metrics.confusion_cells(px(spark, [1] * 10 + [0] * 10, [1] * 6 + [0] * 4 + [1] * 2 + [0] * 8))
    by = {r.cls: r for r in metrics.label_rows(metrics.class_metrics(cells)).collect()}
    assert by[1].iou == pytest.approx(6 / 12) and by[1].dice == pytest.approx(12 / 18)
    assert by[1].precision == pytest.approx(6 / 8) and by[1].recall == pytest.approx(6 / 10)
    assert by[0].iou == pytest.approx(8 / 14) and by[4].iou is None
    assert one(metrics.summary(cells))["fg_macro_iou"] == pytest.approx(0.5)


def test_missed_class_counts_zero(spark):
    assert one(metrics.summary(metrics.confusion_cells(px(spark, [4], [0]))))["fg_macro_iou"] == 0


def test_micro_aggregation(spark):
    rows = px(spark, [1], [1], "a").union(px(spark, [1] * 99, [0] * 99, "b"))
    by = {r.cls: r for r in metrics.class_metrics(metrics.confusion_cells(rows)).collect()}
    assert by[1].iou == pytest.approx(0.01)


def test_strict_threshold(spark):
    df = spark.createDataFrame([(0.051,), (0.05,)], "x double").select(metrics.audit_positive(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [True, False]


def test_workload(spark):
    rows = spark.createDataFrame([(1, 0.9, True), (2, 0.8, True), (3, 0.1, False), (4, 0.0, False)], "id int, s double, p boolean")
    curve = review.workload_curve(rows, "id", "s", "p")
    assert {r.workload: r.recall for r in review.recall_at(curve, [0.25, 0.5]).collect()} == {0.25: 0.5, 0.5: 1.0}
    assert one(review.workload_area(curve))["area"] > 0.7
    none = review.workload_curve(rows.withColumn("p", F.lit(False)), "id", "s", "p")
    assert one(none.agg(F.max("recall").alias("r")))["r"] is None


def test_time_blocks(spark):
    df = spark.createDataFrame([("01", 10), ("01", 1500), (None, None)], "s string, f int").select(metrics.time_block(F.col("s"), F.col("f")).alias("b"))
    assert [r.b for r in df.collect()] == ["01:0", "01:1", "None:na"]


def test_bootstrap_of_equal_groups(spark):
    sums = spark.createDataFrame([(str(i), 1, 2) for i in range(10)], "g0 string, good long, n long")

    def stat(rows, by):
        return rows.groupBy(*by).agg((F.sum(F.col("good") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("value"))

    row = one(statistics.bootstrap(sums, "g0", stat, replicates=20))
    assert row == {"low": 0.5, "high": 0.5, "n_groups": 10, "few_groups": False}


@pytest.mark.parametrize("k", [0, 2, 6])
def test_banded_pairs_are_all_pairs(spark, k):
    rng = random.Random(k)
    base = [rng.getrandbits(63) for _ in range(60)]
    hashes = base + [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in base] + [-1, -2]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    mask = (1 << 64) - 1
    want = {(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if ((hashes[a] ^ hashes[b]) & mask).bit_count() <= k}
    got = duplicates.hamming_pairs(rows, "id", "h", k).collect()
    assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == want


def test_min_gaps(spark):
    rows = [("01", 1000, "train"), ("01", 2000, "train"), ("01", 991, "val"), ("01", 3000, "test"), ("01", 1500, "test"), ("06", 5, "train")]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index int, split string")
    assert {r.pair: r.min_gap for r in duplicates.min_split_gaps(df).collect()} == {"test|train": 500, "test|val": 509, "train|val": 9}


def test_split_buffer_and_duplicates(spark):
    rows = [("t", "test", "09", 3000), ("a", "train", "09", 2950), ("b", "train", "09", 3100), ("c", "train", "09", 3101), ("d", "train", "05", 3000), ("v", "val", "01", 1), ("w", "train", "02", 1)]
    images = spark.createDataFrame(rows, "image_id string, official_split string, sequence_id string, frame_index long")
    pairs = spark.createDataFrame([(1, "v", "t"), (2, "w", "v")], "pair_no int, id_a string, id_b string")
    got = {r.image_id: (r.split, r.exclusion_reason) for r in splits.assign_splits(images, pairs, [], 100).collect()}
    assert got["a"] == ("excluded", "within_buffer_of_eval(gap=50)") and got["b"][0] == "excluded"
    assert got["c"] == ("train", None) and got["d"] == ("train", None)
    assert got["v"] == ("excluded", "duplicate_of_test(t)") and got["w"] == ("train", None)


def test_frame_names(spark):
    df = spark.createDataFrame([("01_frame_001160.PNG",), ("09_frame_002000-2.PNG",), ("odd.png",)], "n string")
    got = [tuple(r) for r in df.select(*S.frame_name(F.col("n")).values()).collect()]
    assert got == [("01", 1160, None), ("09", 2000, 2), (None, None, None)]


def test_lease_fold(spark):
    events = [("a", 0.0, "w1", "claim"), ("a", 5.0, "w2", "claim"), ("a", 11.0, "w2", "claim"), ("a", 30.0, "w1", "claim"), ("b", 1.0, "w1", "claim"), ("b", 2.0, "w1", "finish")]
    got = {r.audit_id: (r.status, r.attempts) for r in jobs.lease_fold(spark.createDataFrame(events, "audit_id string, at double, worker string, kind string"), 10.0, 2).collect()}
    assert got == {"a": ("failed", 2), "b": ("complete", 1)}


def test_idempotent_requests(spark):
    df = spark.createDataFrame([("k", "x", 1), ("k", "x", 2), ("m", "x", 1), ("m", "y", 2)], "key string, digest string, n int")
    assert {r.key: (r.accepted, r.conflict) for r in jobs.idempotent_requests(df, "key", "digest", "n").collect()} == {"k": ("x", False), "m": ("x", True)}


def test_policy_metrics(spark):
    empty = []
    rows = [(1, "a", True, 0.2, 0.0, empty), (2, "b", True, 0.0, 0.3, empty), (3, "c", False, 0.9, 0.9, ["blurred"])]
    df = spark.createDataFrame(rows, "id int, sha256 string, positive boolean, total_target double, uncertain double, quality_issues array<string>")
    got = {r.id: (r.route, r.reasons, r.priority) for r in review.decide(df).collect()}
    assert got[1] == ("review", ["coverage"], 0.2) and got[2] == ("review", ["uncertainty"], 0.15) and got[3] == ("retake_image", ["blurred"], 1.0)


def test_stream_dedupe_takes_files_in_any_order_of_time(spark, tmp_path):
    import datetime
    import os
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from frameledger.streaming import jobs as streams

    hours = list(range(70))
    random.Random(3).shuffle(hours)
    for k, hour in enumerate(hours):  # the last event of each file is one that all files repeat
        at = [datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=6 * hour, minutes=m) for m in range(3)]
        path = tmp_path / f"events-{k:02}.parquet"
        pq.write_table(pa.table({"event_id": [2 * hour, 2 * hour + 1, 1000], "ts": pa.array(at, pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 + 10 * k,) * 2)
    out = streams.drain_append(streams.once_per_key(streams.read_events(spark, f"file://{tmp_path}/event*.parquet"), ["event_id"]).select("event_id"))
    assert sorted(r.event_id for r in out.collect()) == [*range(140), 1000]


@pytest.mark.parametrize(("k", "bits", "bands"), [(6, 64, 4), (3, 20, 4), (0, 16, 2), (5, 32, 3)])
def test_hamming_pairs_equal_brute_force(spark, k, bits, bands):
    rng = random.Random(k)
    hashes = [rng.getrandbits(bits) for _ in range(40)]
    for h in hashes[:20]:
        for _ in range(2):
            hashes.append(h ^ sum(1 << i for i in rng.sample(range(bits), rng.randint(0, min(bits, k + 2)))))
    rows = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "id int, h long")
    got = sorted((r.id_a, r.id_b, r.distance) for r in duplicates.hamming_pairs(rows, "id", "h", k, bits, bands).collect())
    assert got == [(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (hashes[a] ^ hashes[b]).bit_count() <= k]


def grey_png(path, width, values):
    rows = b"".join(b"\0" + bytes(values[i : i + width]) for i in range(0, len(values), width))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(values) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_image_sources(spark, tmp_path):
    (tmp_path / "set").mkdir()
    grey_png(tmp_path / "set" / "a.png", 4, [0, 1, 1, 255, 7, 0, 0, 0])
    (tmp_path / "set" / "b.PNG").write_bytes(b"no image")
    root = f"file://{tmp_path}"
    assert [r.n for r in images.count_images(spark, root).collect()] == [2]
    read = images.read_images(spark, root)
    assert sorted(r.readable for r in read.collect()) == [False, True]
    counts = images.mask_counts(read)
    assert sorted((r.cls, r.n) for r in counts.collect()) == [(0, 4), (1, 2), (7, 1), (255, 1)]
    assert [r["values"] for r in images.unexpected_classes(counts, [0, 1]).collect()] == [[7]]
    digests = images.file_digests(spark, root)
    good = digests.first().asDict()
    expected = spark.createDataFrame([(good["path"], good["length"], good["md5"]), (good["path"] + "x", 1, "")], "path string, length long, md5 string")
    assert [r.problem for r in images.wrong_files(digests, expected).collect()] == ["missing"]
    one = images.directory_digest(spark, root + "/set").first()
    assert one.files == 2 and len(one.sha256) == 64


def test_tables_of_manifests(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, name string")
    images.write_csv(df, f"file://{tmp_path}/m", ["id"])
    assert [tuple(r) for r in images.read_csv(spark, f"file://{tmp_path}/m", "id int, name string").orderBy("id").collect()] == [(1, None), (2, "b")]
    for _ in range(2):
        images.append_json_lines(df, f"file://{tmp_path}/j")
    assert images.read_json_lines(spark, f"file://{tmp_path}/j", "id int, name string").count() == 4
    assert images.complete_samples(df, df.where("id = 1"), "id").count() == 1
    with pytest.raises(ValueError, match="1 wanted images are missing, 9 first"):
        images.complete_samples(df, spark.createDataFrame([(9,)], "id int"), "id")


def test_annotations(spark, tmp_path):
    doc = {
        "categories": [{"id": 1, "name": "metal"}],
        "images": [{"id": 1, "file_name": "a", "width": 10, "height": 10}, {"id": 1, "file_name": "a", "width": 10, "height": 10}],
        "annotations": [{"id": 1, "image_id": 5, "category_id": 1, "iscrowd": 0, "segmentation": []}, {"id": 2, "image_id": 1, "category_id": 8, "iscrowd": 0, "segmentation": []}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    parts = images.read_annotations(spark, f"file://{tmp_path}/c.json")
    assert sorted((r.kind, r.id, r.n) for r in images.annotation_errors(parts).collect()) == [("duplicate_file", "a", 2), ("duplicate_id", "1", 2), ("no_category", "8", 1), ("no_image", "5", 1)]
    rows = spark.createDataFrame([([],), ([1.0, 1.0],), ([0.0, 0.0, 5.0, 0.0, 5.0, 5.0],), ([0.0, 0.0, 12.0, 0.0, 5.0, 5.0],), ([1.0, 1.0, 2.0, 2.0, 3.0, 3.0],)], "c array<double>")
    got = [r.i for r in rows.select(images.polygon_issues(F.col("c"), F.lit(10), F.lit(10)).alias("i")).collect()]
    assert got == [["empty"], ["degenerate"], [], ["out_of_bounds"], ["zero_area"]]


def test_split_policy_refuses(spark):
    """Unknown official splits, and a calibration sequence without a val image, are errors."""
    pairs = spark.createDataFrame([], "pair_no long, id_a string, id_b string")
    schema = "image_id string, official_split string, sequence_id string, frame_index long"
    for rows, calibration in (([("a", "dev", "s", 1)], []), ([("a", None, "s", 1)], []), ([("a", "train", "s", 1)], ["s"]), ([], ["s"])):
        with pytest.raises(splits.SplitPolicyError):
            splits.assign_splits(spark.createDataFrame(rows, schema), pairs, calibration, 10)
    assert splits.assign_splits(spark.createDataFrame([("a", "val", "s", 1)], schema), pairs, ["s"], 10).first()["split"] == "calibration"


def test_cosine_bits_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for n, low in ((8, 8), (16, 8), (32, 8)):
        image = rng.integers(0, 256, (n, n)).astype(float)
        k, i = np.arange(n)[:, None], np.arange(n)[None, :]
        m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)
        corner = (m @ image @ m.T)[:low, :low]
        want = "".join("1" if c > np.median(corner.ravel()[1:]) else "0" for c in corner.ravel())
        got = spark.createDataFrame([(image.ravel().tolist(),)], "pixels array<double>").select(S.cosine_bits(F.col("pixels"), n, low)).first()[0]
        assert got == want


def test_geometry_and_rates(spark):
    row = spark.createDataFrame([(1920, 1080, 1, 5)], "w long, h long, a long, b long")
    w, h = S.resized(F.col("w"), F.col("h"), 768)
    assert tuple(row.select(w, h, S.padded(h, 32)).first()) == (768, 432, 448)
    w, h = S.resized(F.col("a"), F.col("b"), 2)  # 0.4 is at least 1
    assert tuple(row.select(w, h).first()) == (1, 2)
    w, _ = S.resized(F.col("b"), F.lit(10), 5)  # 2.5 goes to the even number
    assert row.select(w).first()[0] == 2
    steps = spark.range(10).select(F.round(S.rate_factor(F.col("id"), F.lit(10), 2), 6)).collect()
    assert [r[0] for r in steps[:3]] == [0.5, 1.0, 1.0] and steps[6][0] == 0.5
    assert spark.range(1).select(S.last_parts(F.lit("/home/x/data/a.png"))).first()[0] == "data/a.png"


def test_leases_end_by_timers(spark, tmp_path):
    """A lease nobody finishes ends by event time without an event of its own; a finish without the lease doesn't count."""
    import datetime

    from frameledger.streaming import jobs as streams

    def at(hour: float) -> datetime.datetime:
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)

    first = [(1, 1, at(0), "w1", "claim"), (2, 2, at(0), "w1", "claim"), (2, 3, at(0.5), "w2", "finish"), (2, 4, at(0.5), "w1", "finish"), (3, 5, at(1), "w1", "claim"), (3, 6, at(1.1), "w1", "release")]
    late = [(4, 7, at(9), "w2", "claim")]
    for n, rows in enumerate((first, late)):
        spark.createDataFrame(rows, "audit_id long, seq long, at timestamp, worker string, kind string").coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
    events = spark.readStream.schema("audit_id long, seq long, at timestamp, worker string, kind string").parquet(str(tmp_path / "b*"))
    got = {r.audit_id: (r.status, r.attempts, r.owner) for r in streams.drain_latest(streams.lease_states(events, 2 * 3_600_000, 3), ["audit_id"]).collect()}
    assert got == {1: ("queued", 1, None), 2: ("complete", 1, None), 3: ("queued", 1, None), 4: ("running", 1, "w2")}


def test_image_quality_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    for rows, cols in ((8, 8), (5, 9)):
        image = rng.integers(0, 256, (rows, cols)).astype(float)
        image[0, :3] = (0, 2, 253)
        bends = image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:] - 4 * image[1:-1, 1:-1]
        q = S.image_quality(F.col("x"), rows, cols)
        got = spark.createDataFrame([(image.ravel().tolist(),)], "x array<double>").select(*q.values()).first()
        assert tuple(got) == pytest.approx((bends.var(), image.mean(), ((image <= 2) | (image >= 253)).mean()))
    assert spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>").select(S.image_quality(F.col("x"), 2, 2)["sharpness"]).first()[0] == 0.0
    seen = spark.createDataFrame([(19.9, 24.0, 0.3), (20.0, 25.0, 0.25), (50.0, 236.0, 0.0)], "sharpness double, brightness double, clipped double").select(review.quality_issues()).collect()
    assert [r[0] for r in seen] == [["blurred", "underexposed", "clipped_exposure"], [], ["overexposed"]]
