"""Canonical keys, the append-only log, the artifact sink, feedback batches and audits as a stream."""

import hashlib
import json
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.operators import canonical, guards, jobs
from frameledger.sources import artifacts, ledger
from frameledger.streaming import audits


def test_cache_key_equals_canonical_json(spark):
    values = [0, 1, 0.5, 0.1, 0.123456, 1 / 3, 0.0001, 0.00012, 0.00005, 0.000012, 0.000001, 0.0000001, 0.999999]
    rows = [(f"sha{i}", [(x, 1.0), (0.25, x)], "1", 'm "q" \\', "p") for i, x in enumerate(values)]
    df = spark.createDataFrame([(a, [(float(x), float(y)) for x, y in r], b, c, d) for a, r, b, c, d in rows], "image string, region array<struct<x: double, y: double>>, pre string, model string, policy string")
    got = [r.k for r in df.select(canonical.cache_key(*[F.col(c) for c in ("image", "region", "pre", "model", "policy")]).alias("k")).collect()]
    want = []
    for image, region, pre, model, policy in rows:
        text = json.dumps({"image": image, "region": [[round(float(x), 6), round(float(y), 6)] for x, y in region], "preprocessing": pre, "model": model, "policy": policy}, sort_keys=True)
        want.append(hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_flattened_records_have_one_digest_for_any_order_of_keys(spark):
    docs = ['{"a": {"x": 1, "y": [true, {"z": "q"}]}, "b": null}', '{"b": null, "a": {"y": [true, {"z": "q"}], "x": 1}}', '{"a": {"x": 2}}', "{}", None, "[5, [6]]"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string").select("id", F.parse_json("doc").alias("doc"))
    leaves = canonical.flattened(df, "id", "doc")
    found = {}
    for r in leaves.collect():
        found.setdefault(r.id, {})[r.key] = r.value
    assert found == {0: {"a.x": "1", "a.y.0": "true", "a.y.1.z": "q"}, 1: {"a.x": "1", "a.y.0": "true", "a.y.1.z": "q"}, 2: {"a.x": "2"}, 5: {"0": "5", "1.0": "6"}}
    digests = {r.id: r.digest for r in canonical.record_digest(leaves, "id").collect()}
    assert digests[0] == digests[1] != digests[2]


def test_a_replayed_batch_adds_nothing_and_changes_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    schema = "id long, note string"

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), schema)

    def log():
        return Counter(tuple(r) for r in ledger.read_log(spark, folder, rows((1, "")).schema).collect())

    assert not log()
    assert ledger.append_batch(rows((1, "a"), (2, "b"), (2, "b")), folder, 0, ["id"]) == 2
    assert ledger.append_batch(rows((1, "a"), (2, "b")), folder, 0, ["id"]) == 2  # the same batch again
    assert ledger.append_batch(rows((2, "b"), (3, None)), folder, 1, ["id"]) == 1  # a row that another batch has
    before = log()
    assert before == Counter([(1, "a"), (2, "b"), (3, None)])
    with pytest.raises(ledger.AppendOnlyError, match="1 rows would change"):
        ledger.append_batch(rows((1, "other"), (4, "d")), folder, 2, ["id"])
    with pytest.raises(ledger.AppendOnlyError, match="1 keys"):
        ledger.append_batch(rows((5, "x"), (5, "y")), folder, 2, ["id"])
    assert log() == before


def test_a_restarted_stream_delivers_each_row_once(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/log"
    schema = "id long, note string"
    for k in range(3):
        spark.createDataFrame([(k, f"n{k}"), (k + 10, "m")], schema).coalesce(1).write.mode("append").json(source)

    def run(checkpoint, fail_at=None):
        add = ledger.appender(folder, ["id"])

        def each(batch, number):
            add(batch, number)
            if number == fail_at:
                raise RuntimeError("lost after the write")

        query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost after the write"):
        run(f"file://{tmp_path}/c", fail_at=1)
    run(f"file://{tmp_path}/c")
    got = [r.id for r in ledger.read_log(spark, folder, spark.createDataFrame([], schema).schema).collect()]
    assert sorted(got) == [0, 1, 2, 10, 11, 12]


def decode(data):
    """A PNG's pixels; its chunks' sums are checked."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind] = body
        at += 12 + n
    w, h, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, -1)
    assert depth == 8 and not rows[:, 0].any()
    return rows[:, 1:].reshape((h, w) if colour == 0 else (h, w, 3))


def test_png_and_overlay():
    rng = np.random.default_rng(1)
    for shape in ((3, 5), (1, 1), (4, 2, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (decode(artifacts.png_bytes(image)) == image).all()
    image, mask = np.full((2, 2), 100, np.uint8), np.array([[0, 1], [2, 255]])
    out = artifacts.overlay(image, mask, {1: (200, 0, 0), 2: (0, 0, 255)}, 0.5)
    assert out.tolist() == [[[100] * 3, [150, 50, 50]], [[50, 50, 178], [100] * 3]]


def test_artifacts_appear_at_the_commit_only(spark, tmp_path):
    spark.dataSource.register(artifacts.ArtifactSource)
    folder = str(tmp_path / "out")
    masks = spark.range(20).select(F.format_string("m%02d.png", "id").alias("name"), artifacts.mask_png(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("id") + i) % 5), F.lit(2), F.lit(3)).alias("content"))
    masks.repartition(4).write.format("artifacts").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == [f"m{k:02d}.png" for k in range(20)]
    assert decode(open(f"{folder}/m03.png", "rb").read()).tolist() == [[3, 4, 0], [1, 2, 3]]
    before = sorted(os.listdir(folder))
    broken = spark.range(40).repartition(4).select(F.format_string("x%02d.png", "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("artifacts").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == before
    twice = spark.createDataFrame([("a.png", b"1"), ("a.png", b"2")], "name string, content binary").repartition(2)
    for rows in (twice, spark.createDataFrame([("../a.png", b"1")], "name string, content binary")):
        with pytest.raises(Exception, match="same name|no name"):
            rows.write.format("artifacts").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == before


def test_feedback_batch_takes_the_first_reason(spark):
    images = [(1, True, "complete", True, True, True, None), (2, True, "complete", False, False, True, None), (3, True, "complete", True, False, True, "bad"), (4, True, "complete", True, True, True, "bad"), (5, True, "complete", True, True, False, "bad"), (6, False, "complete", True, True, True, None), (7, True, "failed", True, True, True, None), (8, True, "complete", True, True, True, None)]
    df = spark.createDataFrame([(i, i * 10, *rest) for i, *rest in images], "image_id long, audit_id long, consent boolean, status string, stored boolean, digest_holds boolean, has_mask boolean, mask_problem string")
    said = spark.createDataFrame([(i, k, "corrected" if k else "confirmed") for i in range(1, 8) for k in (1, 0)] + [(1, 5, "needs_retake")], "image_id long, feedback_id long, decision string")
    got = {r.image_id: (r.label_kind, r.n_feedback, r.history, r.reason) for r in jobs.feedback_batch(df, said).collect()}
    two = (2, "confirmed>corrected")
    assert got == {
        1: ("retake", 3, "confirmed>corrected>needs_retake", None),
        2: ("pixel_mask", *two, "upload no longer in app storage"),
        3: ("pixel_mask", *two, "upload does not match its SHA-256"),
        4: ("pixel_mask", *two, "bad"),
        5: ("image_level", *two, None),
    }


# audits

LIMITS = audits.Limits(lease=10_000, deadline=30_000, retention=100_000, attempts=2, images=2)


def walk(events, now):
    """The audit after events (second, kind, worker, position), and the passing of time until ``now``."""
    a = audits.Audit(images={0: "pending", 1: "pending"})
    for at, kind, worker, position in events:
        a.pass_time(at * 1000, LIMITS)
        a.event(kind, worker, position, at * 1000, LIMITS)
    a.pass_time(now * 1000, LIMITS)
    return a.status, a.attempts, a.error, ",".join(a.images[k] for k in sorted(a.images)), a.deleted


CASES = {
    "finished": ([(0, "claim", "w", 0), (1, "done", "w", 0), (2, "failed", "w", 1), (3, "finish", "w", 0)], ("partial", 1, None, "complete,unreadable", 0)),
    "not its worker": ([(0, "claim", "w", 0), (1, "done", "v", 0), (2, "finish", "v", 0), (40, "claim", "v", 0)], ("running", 2, None, "pending,pending", 0)),
    "early finish": ([(0, "claim", "w", 0), (1, "done", "w", 0), (2, "finish", "w", 0), (44, "claim", "v", 0)], ("running", 2, None, "complete,pending", 0)),
    "extended until the deadline": ([(0, "claim", "w", 0), (1, "done", "w", 0), *[(k, "extend", "w", 0) for k in range(5, 36, 5)]], ("partial", 1, audits.DEADLINE, "complete,job_deadline_exceeded", 0)),
    "out of attempts": ([(0, "claim", "w", 0), (20, "claim", "v", 0), (40, "claim", "w", 0)], ("failed", 2, audits.EXHAUSTED, "attempts_exhausted,attempts_exhausted", 0)),
    "requeued": ([(30, "claim", "w", 0)], ("queued", 1, None, "pending,pending", 0)),
    "deleted": ([(-190, "claim", "w", 0), (-189, "done", "w", 0), (-188, "done", "w", 1), (-187, "finish", "w", 0)], ("queued", 0, None, "pending,pending", 1)),
}


def test_audit_rules():
    for name, (events, want) in CASES.items():
        assert walk(events, 45) == want, name


def test_audits_as_a_stream_over_several_batches(spark, tmp_path):
    """Events of all audits in five files, one a batch: the same as walking each, timers included; state of ended audits goes."""
    from frameledger.streaming import jobs as streams

    rng = random.Random(4)
    told = {name: events for name, (events, _) in CASES.items()}
    for k in range(20):
        at, events = -250, []
        while at < 40:
            at += rng.randrange(1, 25)
            events.append((at, rng.choice(["claim", "claim", "done", "failed", "extend", "finish"]), rng.choice("wv"), rng.randrange(2)))
        told[f"random {k}"] = events
    rows = sorted((at, name, n, kind, worker, position) for name, events in told.items() for n, (at, kind, worker, position) in enumerate(events))
    rows.append((45, "clock", 0, "extend", "w", 0))
    cut = max(1, len(rows) // 5)
    for k in range(0, len(rows), cut):
        part = [(name, n, kind, worker, position, 1_000_000 + at * 1000) for at, name, n, kind, worker, position in rows[k : k + cut]]
        df = spark.createDataFrame(part, "audit_id string, seq long, kind string, worker string, position int, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("audit_id string, seq long, kind string, worker string, position int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    found = streams.drain_latest(audits.audit_states(stream.withColumnRenamed("ts", "at"), LIMITS), ["audit_id"])
    got = {r.audit_id: (r.status, r.attempts, r.error, r.images, r.deleted) for r in found.collect()}
    for name, events in told.items():
        late = walk([(at + 1000, *rest) for at, *rest in events], 1000 + max(r[0] for r in rows))
        assert got[name] == late, name
    assert any(v[4] for v in got.values()) and any(v[2] == audits.DEADLINE for v in got.values())


# guards


def test_names_map_one_to_one_or_are_refused(spark):
    def remap(*rows):
        return {r.source_id: r.cls for r in guards.name_remap(spark.createDataFrame(list(rows), "id int, name string")).collect()}

    good = [(0, "background"), (1, "Rigid-Plastic"), (2, "CARDBOARD"), (3, " metal"), (4, "soft plastic")]
    assert remap(*good) == {0: 0, 1: 3, 2: 1, 3: 4, 4: 2}
    for rows, says in ((good + [(5, "glass")], "no class is named glass"), (good + [(5, "Metal")], "several categories are named metal"), (good[:-1], "no category is named soft_plastic")):
        with pytest.raises(guards.LabelError, match=says):
            remap(*rows)


def test_parity_and_versions_are_checked(spark):
    a = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], "id int, p array<double>")
    near = spark.createDataFrame([(1, [0.5, 0.500001]), (2, [0.1, 0.9])], "id int, p array<double>")
    assert guards.check_parity(guards.parity(a, near, "id")) == pytest.approx(1e-6)
    for rows, says in (([(1, [0.5, 0.6]), (2, [0.1, 0.9])], "differ by 0.1"), ([(1, [0.5, 0.5])], "1 rows"), ([(1, [0.5]), (2, [0.1, 0.9])], "1 rows"), ([(1, [0.5, float("nan")]), (2, [0.1, 0.9])], "1 rows")):
        with pytest.raises(guards.ParityError, match=says):
            guards.check_parity(guards.parity(a, spark.createDataFrame(rows, "id int, p array<double>"), "id"))
    assert guards.check_parity(guards.parity(a.where("false"), a.where("false"), "id")) == 0.0
    guards.check_versions({"labels": [0, 1], "preprocessing": "1", "more": 2}, {"labels": [0, 1], "preprocessing": "1"})
    with pytest.raises(guards.VersionError, match="labels is None, not .*; preprocessing is '2', not '1'"):
        guards.check_versions({"preprocessing": "2"}, {"labels": [0, 1], "preprocessing": "1"})
