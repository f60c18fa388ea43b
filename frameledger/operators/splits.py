"""Leakage-safe split assignment in ordered stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .duplicates import nearest_gap

EVALUATION = ("val", "calibration", "test")


def calibration_stage(images: DataFrame, sequences: list) -> DataFrame:
    """Adds split and exclusion_reason; val rows of a calibration sequence become ``calibration``."""
    moved = (F.col("official_split") == "val") & F.col("sequence_id").isin(sequences)
    return images.withColumns({"split": F.when(moved, "calibration").otherwise(F.col("official_split")), "exclusion_reason": F.lit(None).cast("string")})


def _exclude_pairs(rows: DataFrame, pairs: DataFrame, from_: tuple[str, ...], against: tuple[str, ...], reason: str) -> DataFrame:
    """Rows of some splits that are paired with a row of others go; the first pair in order names the reason."""
    both = pairs.select("pair_no", F.col("id_a").alias("me"), F.col("id_b").alias("partner")).union(pairs.select("pair_no", F.col("id_b"), F.col("id_a")))
    state = rows.select("image_id", "split")
    hits = both.join(state.withColumnRenamed("image_id", "me").where(F.col("split").isin(*from_)).drop("split"), "me").join(state.withColumnRenamed("image_id", "partner").where(F.col("split").isin(*against)).drop("split"), "partner")
    first = hits.groupBy("me").agg(F.min_by("partner", F.struct("pair_no", "partner")).alias("partner"))
    marked = rows.join(first.withColumnRenamed("me", "image_id"), "image_id", "left")
    hit = F.col("partner").isNotNull()
    return marked.withColumns({"split": F.when(hit, "excluded").otherwise(F.col("split")), "exclusion_reason": F.when(hit, F.concat(F.lit(f"{reason}("), F.col("partner").cast("string"), F.lit(")"))).otherwise(F.col("exclusion_reason"))}).drop("partner")


def duplicate_stages(rows: DataFrame, pairs: DataFrame, drop_train: bool = True) -> DataFrame:
    """Val and calibration rows paired with test go first; then train rows paired with what is left of the evaluation."""
    rows = stored(_exclude_pairs(rows, pairs, ("val", "calibration"), ("test",), "duplicate_of_test"), "splits")
    return _exclude_pairs(rows, pairs, ("train",), EVALUATION, "duplicate_of_eval") if drop_train else rows


def buffer_stage(rows: DataFrame, buffer: int) -> DataFrame:
    """Train rows within ``buffer`` frames of a remaining evaluation row of their sequence go; the reason has the gap."""
    train, held = rows.where(F.col("split") == "train"), rows.where(F.col("split").isin(*EVALUATION))
    near = nearest_gap(train, held, "sequence_id", "frame_index", "image_id").where(F.col("gap") <= buffer).groupBy("image_id").agg(F.min("gap").alias("gap"))
    marked = rows.join(near, "image_id", "left")
    hit = F.col("gap").isNotNull()
    return marked.withColumns({"split": F.when(hit, "excluded").otherwise(F.col("split")), "exclusion_reason": F.when(hit, F.concat(F.lit("within_buffer_of_eval(gap="), F.col("gap").cast("string"), F.lit(")"))).otherwise(F.col("exclusion_reason"))}).drop("gap")


def mark_unseen(rows: DataFrame) -> DataFrame:
    """Adds unseen_sequence: a test row whose sequence has no remaining train row; a null sequence never is."""
    trained = rows.where((F.col("split") == "train") & F.col("sequence_id").isNotNull()).select("sequence_id").distinct().withColumn("trained", F.lit(True))
    joined = rows.join(trained, "sequence_id", "left")
    return joined.withColumn("unseen_sequence", (F.col("split") == "test") & F.col("sequence_id").isNotNull() & F.col("trained").isNull()).drop("trained")


class SplitPolicyError(ValueError):
    """The images or the policy don't allow a safe assignment."""


def check_policy(images: DataFrame, calibration: list) -> None:
    """Refuses official splits of other names, and calibration sequences without a val row."""
    val = F.when((F.col("official_split") == "val") & F.col("sequence_id").isin(calibration), F.col("sequence_id"))
    unknown = ~F.coalesce(F.col("official_split").isin("train", "val", "test"), F.lit(False))
    row = images.agg(F.count_if(unknown).alias("unknown"), F.collect_set(val).alias("found")).first()  # at most the configured sequences
    if row["unknown"]:
        raise SplitPolicyError(f"{row['unknown']} images are of no official split")
    lost = [s for s in calibration if s not in row["found"]]
    if lost:
        raise SplitPolicyError(f"calibration sequences without val images: {lost}")


def check_test_kept(assigned: DataFrame) -> None:
    """Refuses an assignment that adds images to test or takes some away."""
    moved = assigned.where((F.col("official_split") == "test") != (F.col("split") == "test")).count()
    if moved:
        raise SplitPolicyError(f"{moved} images entered or left the test split")


def assign_splits(images: DataFrame, pairs: DataFrame, calibration: list, buffer: int, drop_train: bool = True) -> DataFrame:
    """The whole policy on (image_id, official_split, sequence_id, frame_index) and pairs (pair_no, id_a, id_b).

    Each stage reads the one before several times, so stages are written. Raises SplitPolicyError where the policy can't hold.
    """
    check_policy(images, calibration)
    rows = calibration_stage(images, calibration)
    rows = stored(duplicate_stages(rows, pairs, drop_train), "splits")
    rows = stored(buffer_stage(rows, buffer), "splits")
    check_test_kept(rows)
    return mark_unseen(rows)


def split_summary(assigned: DataFrame) -> DataFrame:
    """(split, reason, n): counts of all five splits, 0 where empty, and of the exclusions by reason."""
    names = assigned.sparkSession.createDataFrame([(s,) for s in ("train", "val", "calibration", "test", "excluded")], "split string")
    reason = F.coalesce(F.substring_index("exclusion_reason", "(", 1), F.lit(""))
    counts = assigned.groupBy("split", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "split", "left").select("split", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))


def manifest_id(assigned: DataFrame) -> DataFrame:
    """A digest of the whole assignment: per salted part of the rows, then of the parts in order."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("image_id", "official_split", "split", "exclusion_reason", "sequence_id", "frame_index", "unseen_sequence")])
    digest = F.sha2(row.cast("binary"), 256)
    parts = assigned.groupBy(F.substring(digest, 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), "").cast("binary"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "").cast("binary"), 256).alias("manifest_id"))
