"""Review workload, routing policies and their tuning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compact, uniform_draw
from .statistics import running


@dataclass(frozen=True)
class Policy:
    """Thresholds of a review policy (defaults are fixed values)."""

    version: str = "review-policy-1"
    coverage: float = 0.05
    uncertain: float = 0.10
    weight: float = 0.5
    audit_rate: float = 0.10
    sharpness: float = 20.0
    brightness: tuple[float, float] = (25.0, 235.0)
    clipped: float = 0.25


def workload_curve(scored: DataFrame, id_col: str, score: str, positive: str) -> DataFrame:
    """(rank, fraction, recall): reviewing by score, ties by a hash of the id.

    Ranks over a whole table are cumulative counts of score ranges first and of rows inside them after,
    so no task sorts the table.
    """
    tie = F.sha2(F.col(id_col).cast("string").cast("binary"), 256)
    rows = scored.select(F.col(id_col), F.col(score).alias("__s"), F.col(positive).cast("int").alias("__p"), tie.alias("__tie"))
    per_score = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("k"), F.sum("__p").alias("pos"))
    starts = running(per_score, [], "__s", ["k", "pos"], descending=True).select("__s", F.col("before_k").alias("k0"), F.col("before_pos").alias("p0"))
    inside = Window.partitionBy("__s").orderBy("__tie").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__p").alias("all_pos"))
    placed = rows.withColumns({"r": F.count(F.lit(1)).over(inside), "c": F.sum("__p").over(inside)}).join(starts, "__s").crossJoin(F.broadcast(totals))  # one row
    return placed.select(F.col(id_col), (F.col("k0") + F.col("r")).alias("rank"), ((F.col("k0") + F.col("r")) / F.col("n")).alias("fraction"), F.try_divide((F.col("p0") + F.col("c")).cast("double"), F.col("all_pos")).alias("recall"), "n")


def recall_at(curve: DataFrame, workloads: list[float]) -> DataFrame:
    """(workload, recall): the recall of the first ceil(w * n) rows."""
    wanted = F.explode(F.array(*[F.struct(F.lit(w).alias("workload"), F.ceil(F.lit(w) * F.col("n")).alias("k")) for w in workloads]))
    return curve.select("rank", "recall", wanted.alias("w")).where("rank = w.k").select(F.col("w.workload").alias("workload"), "recall")


def workload_area(curve: DataFrame) -> DataFrame:
    """The trapezoid area under the curve from (0, 0), as the sum of its ordinates: all but half the last."""
    last = F.max_by("recall", "rank")
    return curve.agg(F.coalesce((F.sum("recall") - last / 2) / F.max("n"), F.lit(0.0)).alias("area"))


def random_audit(version: str, sha: Column, rate: float) -> Column:
    return uniform_draw(F.concat(F.lit(version + ":"), sha)) < F.lit(rate)


def decide(images: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds route, reasons and priority from total_target, uncertain, quality_issues and sha256.

    A bad picture is retaken first; an audit is drawn only where nothing else asks for a review.
    """
    found = compact((F.col("total_target") >= policy.coverage, "coverage"), (F.col("uncertain") >= policy.uncertain, "uncertainty"))
    bad = F.size("quality_issues") > 0
    drawn = random_audit(policy.version, F.col("sha256"), policy.audit_rate)
    reasons = F.when(bad, F.col("quality_issues")).when(F.size(found) > 0, found).when(drawn, F.array(F.lit("random_audit"))).otherwise(F.expr("cast(array() as array<string>)"))
    route = F.when(bad, "retake_image").when(F.size(found) > 0, "review").when(drawn, "manual_audit").otherwise("none")
    priority = F.when(bad, F.lit(1.0)).otherwise(F.round(F.col("total_target") + F.lit(policy.weight) * F.col("uncertain"), 6))
    return images.withColumns({"route": route, "reasons": reasons, "priority": priority})


def quality_issues(policy: Policy = Policy()) -> Column:
    return compact(
        (F.col("sharpness") < policy.sharpness, "blurred"),
        (F.col("brightness") < policy.brightness[0], "underexposed"),
        (F.col("brightness") > policy.brightness[1], "overexposed"),
        (F.col("clipped") > policy.clipped, "clipped_exposure"),
    )


def policy_metrics(decided: DataFrame, by: list[str] = [], positive: str = "positive") -> DataFrame:
    """Counts of routes, review rate, recall (null without positives) and false alarms among the flagged."""
    flagged = F.col("route") != "none"
    n, pos = F.count(F.lit(1)), F.count_if(F.col(positive))
    hit, flags = F.count_if(flagged & F.col(positive)), F.count_if(flagged)
    return decided.groupBy(*by).agg(
        n.alias("n"),
        *[F.count_if(F.col("route") == r).alias(f"n_{r}") for r in ("retake_image", "review", "manual_audit", "none")],
        (flags / n).alias("review_rate"),
        F.try_divide(hit.cast("double"), pos).alias("recall"),
        F.try_divide((flags - hit).cast("double"), flags).alias("false_alarm_share"),
        (pos - hit).alias("misses"),
    )


def policy_reasons(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def policy_grid(images: DataFrame, grid: list[tuple[float, float]], positive: str = "positive", policy: Policy = Policy()) -> DataFrame:
    """Metrics of every (coverage, uncertain) pair: images are read once and aggregated by their pattern of passed thresholds.

    The patterns, at most (thresholds + 1) squared, are what the grid is applied to.
    """
    covs, uncs = sorted({c for c, _ in grid}), sorted({u for _, u in grid})
    cov_level = sum((F.when(F.col("total_target") >= c, 1).otherwise(0) for c in covs), F.lit(0))
    unc_level = sum((F.when(F.col("uncertain") >= u, 1).otherwise(0) for u in uncs), F.lit(0))
    drawn = random_audit(policy.version, F.col("sha256"), policy.audit_rate)
    patterns = images.groupBy(cov_level.alias("cl"), unc_level.alias("ul"), (F.size("quality_issues") > 0).alias("bad"), drawn.alias("drawn"), F.col(positive).alias("pos")).agg(F.count(F.lit(1)).alias("k"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("coverage"), F.lit(u).alias("uncertain"), F.lit(covs.index(c) + 1).alias("nc"), F.lit(uncs.index(u) + 1).alias("nu")) for i, (c, u) in enumerate(grid)]))
    rows = patterns.select("*", each.alias("g"))
    flagged = F.col("bad") | (F.col("cl") >= F.col("g.nc")) | (F.col("ul") >= F.col("g.nu")) | F.col("drawn")
    zero = F.lit(0).cast("long")
    k = F.col("k")
    sums = rows.groupBy(F.col("g.idx").alias("idx"), F.col("g.coverage").alias("coverage"), F.col("g.uncertain").alias("uncertain")).agg(
        F.sum(k).alias("n"), F.sum(F.when(flagged, k).otherwise(zero)).alias("flags"), F.sum(F.when(F.col("pos"), k).otherwise(zero)).alias("positives"), F.sum(F.when(flagged & F.col("pos"), k).otherwise(zero)).alias("hits")
    )
    return sums.select("idx", "coverage", "uncertain", (F.col("flags") / F.col("n")).alias("review_rate"), F.try_divide(F.col("hits").cast("double"), F.col("positives")).alias("recall"), F.try_divide((F.col("flags") - F.col("hits")).cast("double"), F.col("flags")).alias("false_alarm_share"))


def select_policy(grid: DataFrame, recall_floor: float) -> DataFrame:
    """The candidate over the floor of the lowest review rate, then false-alarm share, then place."""
    return grid.where(F.col("recall") >= recall_floor).orderBy("review_rate", "false_alarm_share", "idx").limit(1)
