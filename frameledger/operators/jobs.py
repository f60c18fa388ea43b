"""Audit jobs, feedback and study tables: states, histories, integrity and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The row of the largest ``order`` of each key, by one aggregation."""
    last = F.max_by(F.struct(*columns), order).alias("last")
    return rows.groupBy(key).agg(F.max(order).alias(order), last).select(key, order, "last.*")


def history(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, n, history): the values of a key in order; keys have a few rows each."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column])
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(entries, ">").alias("history"))


def status_counts(images: DataFrame, audit: str, status: str, values: list[str]) -> DataFrame:
    return images.groupBy(audit).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values], F.count(F.lit(1)).alias("n"))


def final_status(failed: Column, complete: Column) -> Column:
    return F.when(failed == 0, "complete").when(complete > 0, "partial").otherwise("failed")


def queue_metrics(audits: DataFrame, status: str, waiting: str, created: str, now: str) -> DataFrame:
    """(queue_length, oldest_age_seconds), 0 for an empty queue."""
    queued = F.when(F.col(status) == waiting, F.col(created))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.min(queued))
    return audits.agg(F.count(queued).alias("queue_length"), F.coalesce(age, F.lit(0)).cast("long").alias("oldest_age_seconds"))


def idempotent_requests(requests: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """(key, accepted, n, conflict): the first request of a key counts; other digests conflict with it."""
    first = F.min_by(digest, order)
    return requests.groupBy(key).agg(first.alias("accepted"), F.count(F.lit(1)).alias("n"), (F.count_distinct(digest) > 1).alias("conflict"))


def cached_results(images: DataFrame, cache_key: str, result: str, completed: str) -> DataFrame:
    """(cache_key, result): the earliest completed result of each key."""
    return images.where(F.col(completed).isNotNull()).groupBy(cache_key).agg(F.min_by(result, completed).alias("result"), F.count(F.lit(1)).alias("n"))


def expired(audits: DataFrame, expires: str, status: str, active: tuple[str, ...], now: str) -> DataFrame:
    return audits.where((F.col(expires) < F.lit(now).cast("timestamp")) & ~F.col(status).isin(*active))


def missing_artifacts(images: DataFrame, artifacts: DataFrame, image: str, wanted: int) -> DataFrame:
    """Images with another number of artifacts than wanted, those without any included."""
    counts = artifacts.groupBy(image).agg(F.count(F.lit(1)).alias("n_artifacts"))
    return images.join(counts, image, "left").select(image, F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts")).where(F.col("n_artifacts") != wanted)


def review_queue(images: DataFrame, required: Column, priority: str, position: str, audit: str) -> DataFrame:
    """Adds place: by priority downwards, null as 0, then by position."""
    order = Window.partitionBy(audit).orderBy(F.coalesce(priority, F.lit(0.0)).desc(), position)
    return images.where(required).withColumn("place", F.row_number().over(order))


def label_kind(decision: Column, has_mask: Column) -> Column:
    return F.when(decision == "needs_retake", "retake").when((decision == "corrected") & has_mask, "pixel_mask").otherwise("image_level")


def lease_fold(events: DataFrame, lease_seconds: float, max_attempts: int) -> DataFrame:
    """(audit_id, status, attempts, owner): the claims of each audit applied in time order.

    Events are (audit_id, at, worker, kind) with kind claim, finish or release. A claim is granted if the
    audit is open and no lease is running; past ``max_attempts`` it fails the audit. The state depends on
    the one before, so an audit's events, of which there are a few, are folded in order.
    """
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("owner"), F.lit(-1e300).alias("until"))

    def step(s: Column, e: Column) -> Column:
        free = (s["status"] == "queued") | ((s["status"] == "running") & (s["until"] < e["at"]))
        claim, held = e["kind"] == "claim", (s["status"] == "running") & (s["owner"] == e["worker"]) & (s["until"] >= e["at"])

        def state(status: Column, attempts: Column, owner: Column, until: Column) -> Column:
            return F.struct(status.alias("status"), attempts.alias("attempts"), owner.alias("owner"), until.alias("until"))

        none, never = F.lit(None).cast("string"), F.lit(-1e300)
        return (
            F.when(claim & free & (s["attempts"] >= max_attempts), state(F.lit("failed"), s["attempts"], none, never))
            .when(claim & free, state(F.lit("running"), s["attempts"] + 1, e["worker"], e["at"] + F.lit(float(lease_seconds))))
            .when((e["kind"] == "finish") & held, state(F.lit("complete"), s["attempts"], none, never))
            .when((e["kind"] == "release") & held, state(F.lit("queued"), s["attempts"], none, never))
            .otherwise(s)
        )

    ordered = F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), "kind", "worker")))
    folded = events.groupBy("audit_id").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("audit_id", "s.status", "s.attempts", "s.owner")


def material_scores(trials: DataFrame, materials: list[str], answered: str, truth: str, by: list[str]) -> DataFrame:
    """(by..., material, precision, recall) of sets of materials; null without a denominator."""
    each = trials.select(*by, answered, truth, F.explode(F.array(*[F.lit(m) for m in materials])).alias("material"))
    said, is_ = F.array_contains(answered, F.col("material")), F.array_contains(truth, F.col("material"))
    both = F.count_if(said & is_).cast("double")
    return each.groupBy(*by, "material").agg(F.try_divide(both, F.count_if(said)).alias("precision"), F.try_divide(both, F.count_if(is_)).alias("recall"))


def changed_suggestions(trials: DataFrame, given: str, answered: str, by: list[str]) -> DataFrame:
    size = F.size(F.array_except(given, answered)) + F.size(F.array_except(answered, given))
    return trials.groupBy(*by).agg(F.avg((size > 0).cast("double")).alias("share_changed"), F.avg(size.cast("double")).alias("mean_changes"))


def arm(participant: Column) -> Column:
    """The counterbalanced arm of a participant from 1 up."""
    return F.pmod(participant - 1, F.lit(4))


def stratified_sample(rows: DataFrame, by: list[str], id_col: str, k: int, seed: int = 0) -> DataFrame:
    """At most k rows of each stratum, in the order of a hash of the id."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(order, id_col))).where(F.col("__r") <= k).drop("__r")


def prior_ratio(whole: DataFrame, sample: DataFrame, cls: str) -> DataFrame:
    """(cls, ratio): share in the whole over share in the sample, 1 where a side lacks the class."""
    a, b = whole.groupBy(cls).agg(F.count(F.lit(1)).alias("n")), sample.groupBy(cls).agg(F.count(F.lit(1)).alias("m"))
    every = Window.partitionBy()  # a row a class
    both = a.join(b, cls, "full").select(cls, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    ratio = F.try_divide(F.col("n") / F.sum("n").over(every), F.col("m") / F.sum("m").over(every))
    return both.select(cls, F.when((F.col("n") > 0) & (F.col("m") > 0), ratio).otherwise(F.lit(1.0)).alias("ratio"))


def pair_assignment(rows: DataFrame, order: str, id_col: str, group: str, seed: int = 0) -> DataFrame:
    """(id, pair, set): neighbours in the order of each group form pairs, whose members go to sets A and B by a hash."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, id_col)) - 1
    paired = rows.select(id_col, group, F.floor(place / 2).alias("pair"))
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    first = F.row_number().over(Window.partitionBy(group, "pair").orderBy(tie, id_col)) == 1
    return paired.select(id_col, group, "pair", F.when(first, "A").otherwise("B").alias("set"))


def feedback_skips(candidates: DataFrame) -> DataFrame:
    """(reason, n) of candidates (consent, status, decision) that no batch takes, the first reason that holds."""
    reason = F.when(~F.col("consent"), "no_consent").when(F.col("status") != "complete", "not_complete").when(F.col("decision").isNull(), "no_feedback")
    return candidates.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def feedback_batch(images: DataFrame, feedback: DataFrame) -> DataFrame:
    """(image_id, audit_id, label_kind, n_feedback, history, reason): what a batch takes, and with a reason what it skips.

    ``images`` has (image_id, audit_id, consent, status, stored, digest_holds, has_mask, mask_problem), ``feedback`` (image_id, feedback_id,
    decision). Only consented, complete images with feedback are looked at; the first reason that holds is given, and a mask's only
    where the last feedback makes it the label.
    """
    entries = F.transform(F.array_sort(F.collect_list(F.struct("feedback_id", "decision"))), lambda x: x["decision"])
    last = feedback.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_feedback"), F.array_join(entries, ">").alias("history"), F.max_by("decision", "feedback_id").alias("decision"))
    rows = images.where(F.col("consent") & (F.col("status") == "complete")).join(last, "image_id")
    kind = label_kind(F.col("decision"), F.col("has_mask"))
    reason = F.when(~F.col("stored"), "upload no longer in app storage").when(~F.col("digest_holds"), "upload does not match its SHA-256").when(kind == "pixel_mask", F.col("mask_problem"))
    return rows.select("image_id", "audit_id", kind.alias("label_kind"), "n_feedback", "history", reason.alias("reason"))


def remap(rows: DataFrame, cls: str, mapping: dict[int, int], ignored: int = 255) -> DataFrame:
    """Adds ``mapped``: the internal id of a source id; the ignored one passes through, others without an entry are null."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn("mapped", F.when(F.col(cls) == ignored, F.lit(ignored)).otherwise(F.try_element_at(table, F.col(cls))))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, by one aggregation; a rule that gives null isn't broken."""
    counts = rows.agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])).alias("r")).select("r.*")


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds place, from 1, in the order inside each group; a group is an audit of a few images."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
