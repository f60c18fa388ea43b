"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import duplicates, jobs, metrics, models, review, spacing, splits, statistics
from .operators.resampling import draws_sql
from .plans import views as V
from .plans.views import AUDIT_IMAGES, AUDITS, COPIES, FEEDBACK, FRAME_PAIRS, FRAMES, PX, SCORED, TRIALS, table
from .schemas import CLASSES, TARGETS
from .streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2000-06-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds in the last projection only."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


CELLS = f"{PX}, cells AS (SELECT image_id, t, p, count(*) AS n FROM px WHERE t <> 255 GROUP BY ALL)"
SIDES = "sides AS (SELECT t AS cls, CASE WHEN t = p THEN n ELSE 0 END AS tp, n AS truth, 0 AS pred, image_id FROM cells UNION ALL SELECT p, 0, 0, n, image_id FROM cells)"
PER_CLASS = "iou AS (SELECT cls, sum(tp)::BIGINT AS tp, sum(truth)::BIGINT AS truth, sum(pred)::BIGINT AS pred FROM sides GROUP BY cls)"


# pixels: confusion, overlap, coverage


@query(f"WITH {CELLS} SELECT t, p, sum(n)::BIGINT AS n FROM cells GROUP BY ALL")
def confusion_cells(spark, d):
    return metrics.confusion_cells(V.pixels(spark, d))


@query(f"WITH {CELLS} SELECT image_id, t, p, n FROM cells")
def confusion_by_image(spark, d):
    return metrics.confusion_cells(V.pixels(spark, d), ["image_id"])


@query(
    f"WITH {CELLS}, {SIDES}, {PER_CLASS}, l(cls, name) AS (VALUES (0, 'background'), (1, 'cardboard'), (2, 'soft_plastic'), (3, 'rigid_plastic'), (4, 'metal'))"
    " SELECT cls, name, round(tp / nullif(truth + pred - tp, 0)::DOUBLE, 6) AS iou, round(2 * tp / nullif(truth + pred, 0)::DOUBLE, 6) AS dice, round(tp / nullif(pred, 0)::DOUBLE, 6) AS precision, round(tp / nullif(truth, 0)::DOUBLE, 6) AS recall, tp, truth, pred FROM l LEFT JOIN iou USING (cls)"
)
def iou_per_class(spark, d):
    return r6(metrics.label_rows(metrics.class_metrics(metrics.confusion_cells(V.pixels(spark, d)))), "iou", "dice", "precision", "recall")


def _summary_sql(by: str) -> str:
    sel, grp = (f"{by}, ", f"{by}, ") if by else ("", "")
    return (
        f"WITH {CELLS}, {SIDES}, c AS (SELECT {sel}cls, sum(tp) AS tp, sum(truth) AS truth, sum(pred) AS pred FROM sides GROUP BY {grp}cls), i AS (SELECT *, tp / nullif(truth + pred - tp, 0)::DOUBLE AS iou FROM c)"
        f" SELECT {sel}round(avg(iou) FILTER (cls BETWEEN 1 AND 4), 6) AS fg_macro_iou, round(avg(iou), 6) AS mean_iou, round(sum(tp) / nullif(sum(truth), 0)::DOUBLE, 6) AS accuracy, sum(truth)::BIGINT AS n_px FROM i" + (f" GROUP BY {by}" if by else "")
    )


@query(_summary_sql(""))
def seg_summary(spark, d):
    return r6(metrics.summary(metrics.confusion_cells(V.pixels(spark, d))), "fg_macro_iou", "mean_iou", "accuracy")


@query(_summary_sql("image_id"))
def seg_summary_by_image(spark, d):
    return r6(metrics.summary(metrics.confusion_cells(V.pixels(spark, d), ["image_id"]), ["image_id"]), "fg_macro_iou", "mean_iou", "accuracy")


@query(f"WITH {CELLS}, s AS (SELECT t, p, sum(n)::BIGINT AS n FROM cells GROUP BY ALL) SELECT t, p, n, round(n / greatest(sum(n) OVER (PARTITION BY t), 1)::DOUBLE, 6) AS share FROM s")
def confusion_row_normalized(spark, d):
    return r6(metrics.row_normalized(metrics.confusion_cells(V.pixels(spark, d))), "share")


COVERAGE = ", ".join(f"round(count_if({{c}} = {i}) / count(*)::DOUBLE, 6) AS cov_{n}" for i, n in CLASSES.items()) + ", round(count_if({c} BETWEEN 1 AND 4) / count(*)::DOUBLE, 6) AS total_target, count(*) AS n_px"
COVERAGE_COLUMNS = [*[f"cov_{n}" for n in CLASSES.values()], "total_target"]


@query(f"WITH {PX} SELECT image_id, {COVERAGE.format(c='p')} FROM px WHERE t <> 255 GROUP BY image_id")
def coverage_per_image(spark, d):
    return r6(metrics.coverage(V.pixels(spark, d), ["image_id"]), *COVERAGE_COLUMNS)


REGION = [(0.105, 0.105), (0.805, 0.105), (0.805, 0.705), (0.105, 0.705)]


@query(f"WITH {PX} SELECT image_id, {COVERAGE.format(c='p')} FROM px WHERE t <> 255 AND x > 0.105 AND x < 0.805 AND y > 0.105 AND y < 0.705 GROUP BY image_id")
def coverage_region(spark, d):
    return r6(metrics.coverage(V.pixels(spark, d), ["image_id"], region=S.in_polygon(F.col("x"), F.col("y"), REGION)), *COVERAGE_COLUMNS)


_ERRS = ["total_target", *[f"cov_{CLASSES[c]}" for c in TARGETS]]
_RAW = "SELECT image_id, " + ", ".join(f"count_if({{c}} = {i}) / count(*)::DOUBLE AS cov_{n}" for i, n in CLASSES.items()) + ", count_if({c} BETWEEN 1 AND 4) / count(*)::DOUBLE AS total_target FROM px WHERE t <> 255 GROUP BY image_id"


@query(
    f"WITH {PX}, a AS ({_RAW.format(c='t')}), b AS ({_RAW.format(c='p')}) SELECT " + ", ".join(f"round(avg(abs(b.{n} - a.{n})) * 100, 6) AS mae_{n}" for n in _ERRS) + ", round(avg(b.total_target - a.total_target) * 100, 6) AS bias_total_target FROM a JOIN b USING (image_id)"
)
def coverage_errors(spark, d):
    px = V.pixels(spark, d)
    return r6(metrics.coverage_errors(metrics.coverage(px, ["image_id"], "t"), metrics.coverage(px, ["image_id"], "p"), "image_id"), *[f"mae_{n}" for n in _ERRS], "bias_total_target")


@query(f"WITH {PX}, a AS ({_RAW.format(c='t')}) SELECT image_id, total_target > 0.05 AS positive FROM a")
def audit_positive(spark, d):
    return metrics.coverage(V.pixels(spark, d), ["image_id"], "t").select("image_id", metrics.audit_positive(F.col("total_target")).alias("positive"))


@query(
    f"WITH {PX}, c AS (SELECT coalesce(image_id::VARCHAR, 'None') || ':' || coalesce((floor(frame_index / 1000000))::BIGINT::VARCHAR, 'na') AS block, t, p FROM px WHERE t <> 255)"
    " SELECT block, count(*) AS n, count_if(t = p) AS n_right FROM c GROUP BY block"
)
def time_block_groups(spark, d):
    px = V.pixels(spark, d).where("t <> 255")
    return px.groupBy(metrics.time_block(F.col("image_id"), F.col("frame_index"), 1_000_000).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == F.col("p")).alias("n_right"))


_GALLERIES = [*[f"{side}_{CLASSES[c]}" for c in TARGETS for side in ("fp", "fn")], "coverage_error", "confident_wrong", "uncertain_right"]
_SIDES_OF = {"fp": "p", "fn": "t"}


@query(
    f"WITH {PX}, k AS (SELECT image_id, "
    + ", ".join(f"count_if({_SIDES_OF[side]} = {c} AND t <> p)::DOUBLE AS {side}_{CLASSES[c]}" for c in TARGETS for side in ("fp", "fn"))
    + ", abs(count_if(p BETWEEN 1 AND 4) - count_if(t BETWEEN 1 AND 4)) / count(*)::DOUBLE AS coverage_error, count_if(t <> p AND value > 90)::DOUBLE AS confident_wrong, count_if(t = p AND value < 10)::DOUBLE AS uncertain_right FROM px WHERE t <> 255 GROUP BY image_id),"
    f" g AS (SELECT * FROM k UNPIVOT (key FOR gallery IN ({', '.join(_GALLERIES)}))), r AS (SELECT *, row_number() OVER (PARTITION BY gallery ORDER BY key DESC, image_id) AS rank FROM g WHERE key > 0) SELECT gallery, rank, image_id, round(key, 9) AS key FROM r WHERE rank <= 8"
)
def gallery_topk(spark, d):
    """The images of most false and missed pixels of each class, of the largest coverage error, and of confident or lucky pixels."""
    wrong = F.col("t") != F.col("p")
    counts = [F.count_if((F.col(_SIDES_OF[side]) == c) & wrong).alias(f"{side}_{CLASSES[c]}") for c in TARGETS for side in ("fp", "fn")]
    error = F.abs(F.count_if(F.col("p").isin(*TARGETS)) - F.count_if(F.col("t").isin(*TARGETS))) / F.count(F.lit(1))
    stats = V.pixels(spark, d).where("t <> 255").groupBy("image_id").agg(*counts, error.alias("coverage_error"), F.count_if(wrong & (F.col("value") > 90)).alias("confident_wrong"), F.count_if(~wrong & (F.col("value") < 10)).alias("uncertain_right"))
    return metrics.top_per_gallery(stats, _GALLERIES, 8, "image_id").withColumn("key", F.round("key", 9))


@query(f"WITH {PX}, v AS (SELECT image_id, avg(value) AS v FROM px GROUP BY image_id), q AS (SELECT quantile_cont(v, 1/3::DOUBLE) AS a, quantile_cont(v, 2/3::DOUBLE) AS b FROM v) SELECT (CASE WHEN a <= v THEN 1 ELSE 0 END + CASE WHEN b <= v THEN 1 ELSE 0 END) AS bin, count(*) AS n FROM v, q GROUP BY 1")
def quantile_bins(spark, d):
    v = V.pixels(spark, d).groupBy("image_id").agg(F.avg("value").alias("v"))
    return metrics.quantile_bins(v, "v").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {PX}, c AS (SELECT (CASE WHEN value >= 10 THEN 1 ELSE 0 END + CASE WHEN value >= 30 THEN 1 ELSE 0 END + CASE WHEN value >= 80 THEN 1 ELSE 0 END) AS slice, 0 AS image_id, t, p, count(*) AS n FROM px WHERE t <> 255 GROUP BY ALL),"
    " s AS (SELECT slice, t AS cls, CASE WHEN t = p THEN n ELSE 0 END AS tp, n AS truth, 0 AS pred FROM c UNION ALL SELECT slice, p, 0, 0, n FROM c), m AS (SELECT slice, cls, sum(tp) AS tp, sum(truth) AS truth, sum(pred) AS pred FROM s GROUP BY ALL)"
    " SELECT slice, round(avg(tp / nullif(truth + pred - tp, 0)::DOUBLE) FILTER (cls BETWEEN 1 AND 4), 4) AS fg_macro_iou, sum(truth)::BIGINT AS n_px FROM m GROUP BY slice"
)
def slice_metrics(spark, d):
    px = V.pixels(spark, d).withColumn("slice", S.edge_bin(F.col("value"), [10, 30, 80]))
    return metrics.summary(metrics.confusion_cells(px, ["slice"]), ["slice"]).select("slice", F.round("fg_macro_iou", 4).alias("fg_macro_iou"), "n_px")


# review: workload and policies

CURVE = f"{SCORED}, curve AS (SELECT doc_id, row_number() OVER o AS rank, row_number() OVER o / (count(*) OVER ())::DOUBLE AS fraction, sum(positive::INT) OVER (o ROWS UNBOUNDED PRECEDING) / nullif(sum(positive::INT) OVER (), 0)::DOUBLE AS recall, count(*) OVER () AS n FROM scored WINDOW o AS (ORDER BY total_target DESC, sha256(doc_id::VARCHAR)))"


def _curve(spark, d):
    return review.workload_curve(V.scored(spark, d), "doc_id", "total_target", "positive")


@query(f"WITH {CURVE} SELECT doc_id, rank, round(fraction, 6) AS fraction, round(recall, 6) AS recall, n FROM curve")
def workload_curve(spark, d):
    return r6(_curve(spark, d), "fraction", "recall")


@query(f"WITH {CURVE}, w(workload) AS (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) SELECT workload, round(recall, 6) AS recall FROM curve JOIN w ON rank = ceil(workload * n)")
def workload_recall_at(spark, d):
    return r6(review.recall_at(_curve(spark, d), [0.05, 0.1, 0.25, 0.5]), "recall")


@query(f"WITH {CURVE} SELECT round((sum(recall) - max_by(recall, rank) / 2) / max(n), 6) AS area FROM curve")
def workload_area(spark, d):
    return r6(review.workload_area(_curve(spark, d)), "area")


DRAW = "(('0x' || substr(sha256('review-policy-1:' || sha256), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE)"
DECIDED = f"""{SCORED}, f AS (SELECT *, list_filter([CASE WHEN total_target >= 0.05 THEN 'coverage' END, CASE WHEN uncertain >= 0.1 THEN 'uncertainty' END], lambda x: x IS NOT NULL) AS found, {DRAW} < 0.1 AS drawn FROM scored),
decided AS (SELECT *, CASE WHEN len(quality_issues) > 0 THEN 'retake_image' WHEN len(found) > 0 THEN 'review' WHEN drawn THEN 'manual_audit' ELSE 'none' END AS route,
  CASE WHEN len(quality_issues) > 0 THEN quality_issues WHEN len(found) > 0 THEN found WHEN drawn THEN ['random_audit'] ELSE [] END AS reasons,
  CASE WHEN len(quality_issues) > 0 THEN 1::DOUBLE ELSE round(total_target + 0.5::DOUBLE * uncertain, 6) END AS priority FROM f)"""


@query(f"WITH {SCORED} SELECT doc_id FROM scored WHERE {DRAW} < 0.1")
def random_audit_sample(spark, d):
    return V.scored(spark, d).where(review.random_audit("review-policy-1", F.col("sha256"), 0.1)).select("doc_id")


@query(f"WITH {DECIDED} SELECT doc_id, route, array_to_string(reasons, ';') AS reasons, round(priority, 5) AS priority FROM decided")
def review_decisions(spark, d):
    return review.decide(V.scored(spark, d)).select("doc_id", "route", F.array_join("reasons", ";").alias("reasons"), F.round("priority", 5).alias("priority"))


@query(
    f"WITH {DECIDED} SELECT count(*) AS n, count_if(route = 'retake_image') AS n_retake_image, count_if(route = 'review') AS n_review, count_if(route = 'manual_audit') AS n_manual_audit, count_if(route = 'none') AS n_none,"
    " round(count_if(route <> 'none') / count(*)::DOUBLE, 6) AS review_rate, round(count_if(route <> 'none' AND positive) / nullif(count_if(positive), 0)::DOUBLE, 6) AS recall,"
    " round(count_if(route <> 'none' AND NOT positive) / nullif(count_if(route <> 'none'), 0)::DOUBLE, 6) AS false_alarm_share, count_if(positive AND route = 'none') AS misses FROM decided"
)
def policy_metrics(spark, d):
    return r6(review.policy_metrics(review.decide(V.scored(spark, d))), "review_rate", "recall", "false_alarm_share")


@query(f"WITH {DECIDED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM decided) GROUP BY reason")
def policy_reasons(spark, d):
    return review.policy_reasons(review.decide(V.scored(spark, d)))


GRID = [(c, u) for c in (0.02, 0.03, 0.05, 0.08, 0.10, 0.15) for u in (0.05, 0.10, 0.20, 0.30)]
GRID_SQL = f"""{SCORED}, grid(idx, coverage, thr) AS (VALUES {', '.join(f'({i}, {c}::DOUBLE, {u}::DOUBLE)' for i, (c, u) in enumerate(GRID))}),
x AS (SELECT idx, coverage, thr, positive, len(quality_issues) > 0 OR total_target >= coverage OR scored.uncertain >= thr OR {DRAW} < 0.1 AS flag FROM scored, grid),
rates AS (SELECT idx, coverage, thr AS uncertain, count_if(flag) / count(*)::DOUBLE AS review_rate, count_if(flag AND positive) / nullif(count_if(positive), 0)::DOUBLE AS recall, count_if(flag AND NOT positive) / nullif(count_if(flag), 0)::DOUBLE AS false_alarm_share FROM x GROUP BY ALL)"""
_RATES = "round(review_rate, 6) AS review_rate, round(recall, 6) AS recall, round(false_alarm_share, 6) AS false_alarm_share"


@query(f"WITH {GRID_SQL} SELECT idx, coverage, uncertain, {_RATES} FROM rates")
def policy_grid(spark, d):
    return r6(review.policy_grid(V.scored(spark, d), GRID), "review_rate", "recall", "false_alarm_share")


@query(f"WITH {GRID_SQL} SELECT idx, coverage, uncertain, {_RATES} FROM rates r WHERE r.recall >= 0.95 ORDER BY r.review_rate, r.false_alarm_share, idx LIMIT 1")
def policy_select(spark, d):
    return r6(review.select_policy(review.policy_grid(V.scored(spark, d), GRID), 0.95), "review_rate", "recall", "false_alarm_share")


# duplicates and splits


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return duplicates.exact_groups(rows, "sha256", "doc_id")


_BITS = [(r * 8 + c) for r in range(8) for c in range(7)]
DHASH_SQL = "h AS (SELECT vec_id AS image_id, " + " + ".join(f"(CASE WHEN embedding[{i + 2}] > embedding[{i + 1}] THEN {1 << (55 - k)} ELSE 0 END)::BIGINT" for k, i in enumerate(_BITS)) + " AS dhash FROM embeddings)"


COPIES_SQL = f"{COPIES}, {DHASH_SQL.replace('FROM embeddings', 'FROM copies')}"


def _hashed(images: DataFrame) -> DataFrame:
    return images.select("image_id", S.row_difference_bits(F.col("pixels"), 8, 8).alias("dhash"))


@query(f"WITH {DHASH_SQL} SELECT image_id, dhash FROM h")
def dhash_bits(spark, d):
    return _hashed(V.grey_images(spark, d))


@query("WITH v AS (SELECT vec_id, embedding[2:64] AS e FROM embeddings), m AS (SELECT vec_id, e, list_sort(e)[32] AS m FROM v) SELECT vec_id AS image_id, list_reduce(list_prepend(0::BIGINT, list_transform(e, lambda x: (x > m)::BIGINT)), lambda a, b: a * 2 + b) AS phash FROM m")
def phash_bits(spark, d):
    return V.grey_images(spark, d).select("image_id", S.median_bits(F.col("pixels"), 64).alias("phash"))


@query(f"WITH {COPIES_SQL} SELECT a.image_id AS id_a, b.image_id AS id_b, bit_count(xor(a.dhash, b.dhash))::BIGINT AS distance FROM h a JOIN h b ON a.image_id < b.image_id WHERE bit_count(xor(a.dhash, b.dhash)) <= 6")
def near_pairs_banded(spark, d):
    return duplicates.hamming_pairs(_hashed(V.images_with_copies(spark, d)), "image_id", "dhash", 6, 56)


@query(
    f"WITH {COPIES_SQL}, p AS (SELECT a.image_id AS a, b.image_id AS b FROM h a JOIN h b ON a.image_id < b.image_id WHERE bit_count(xor(a.dhash, b.dhash)) <= 6), s AS (SELECT vec_id, CASE (vec_id // 3) % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM copies)"
    " SELECT array_to_string(list_sort([x.split, y.split]), '|') AS splits, count(*) AS n, count_if(x.split <> y.split) AS n_cross FROM p JOIN s x ON x.vec_id = a JOIN s y ON y.vec_id = b GROUP BY 1"
)
def dup_summary(spark, d):
    def split(c: str) -> Column:
        r = F.floor(F.col(c) / 3) % 10
        return F.when(r == 0, "test").when(r == 1, "val").otherwise("train")

    pairs = duplicates.hamming_pairs(_hashed(V.images_with_copies(spark, d)), "image_id", "dhash", 6, 56)
    return duplicates.duplicate_summary(pairs.select(split("id_a").alias("split_a"), split("id_b").alias("split_b")))


@query(f"WITH {FRAMES} SELECT array_to_string(list_sort([a.official_split, b.official_split]), '|') AS pair, min(abs(a.frame_index - b.frame_index)) AS min_gap FROM frames a JOIN frames b ON a.sequence_id = b.sequence_id AND a.official_split < b.official_split GROUP BY 1")
def cross_split_min_gap(spark, d):
    return duplicates.min_split_gaps(V.frames(spark, d).withColumnRenamed("official_split", "split"))


CALIBRATION, BUFFER = list(V.SEQUENCES_FOR_CALIBRATION), 2000
SPLIT_SQL = f"""{FRAMES}, {FRAME_PAIRS}, twice AS (SELECT pair_no, id_a AS me, id_b AS partner FROM frame_pairs UNION ALL SELECT pair_no, id_b, id_a FROM frame_pairs),
s0 AS (SELECT *, CASE WHEN official_split = 'val' AND sequence_id IN (7, 11) THEN 'calibration' ELSE official_split END AS split FROM frames),
h1 AS (SELECT me, min_by(partner, (pair_no, partner)) AS partner FROM twice JOIN s0 a ON a.image_id = me JOIN s0 b ON b.image_id = partner WHERE a.split IN ('val', 'calibration') AND b.split = 'test' GROUP BY me),
s1 AS (SELECT s0.* REPLACE (CASE WHEN h1.me IS NULL THEN split ELSE 'excluded' END AS split), 'duplicate_of_test(' || partner || ')' AS exclusion_reason FROM s0 LEFT JOIN h1 ON me = image_id),
h2 AS (SELECT me, min_by(partner, (pair_no, partner)) AS partner FROM twice JOIN s1 a ON a.image_id = me JOIN s1 b ON b.image_id = partner WHERE a.split = 'train' AND b.split IN ('val', 'calibration', 'test') GROUP BY me),
s2 AS (SELECT s1.* REPLACE (CASE WHEN h2.me IS NULL THEN split ELSE 'excluded' END AS split, coalesce('duplicate_of_eval(' || partner || ')', exclusion_reason) AS exclusion_reason) FROM s1 LEFT JOIN h2 ON me = image_id),
g AS (SELECT t.image_id, min(abs(t.frame_index - e.frame_index)) AS gap FROM s2 t JOIN s2 e ON t.sequence_id = e.sequence_id WHERE t.split = 'train' AND e.split IN ('val', 'calibration', 'test') GROUP BY 1),
s3 AS (SELECT s2.* REPLACE (CASE WHEN gap <= {BUFFER} THEN 'excluded' ELSE split END AS split, CASE WHEN gap <= {BUFFER} THEN 'within_buffer_of_eval(gap=' || gap || ')' ELSE exclusion_reason END AS exclusion_reason) FROM s2 LEFT JOIN g USING (image_id)),
s4 AS (SELECT image_id, sequence_id, frame_index, official_split, split, exclusion_reason, split = 'test' AND sequence_id NOT IN (SELECT sequence_id FROM s3 WHERE split = 'train') AS unseen_sequence FROM s3)"""


def _assigned(spark, d):
    return splits.assign_splits(V.frames(spark, d).drop("value"), V.frame_pairs(spark, d), CALIBRATION, BUFFER)


@query(f"WITH {SPLIT_SQL} SELECT * FROM s4")
def split_assign(spark, d):
    return _assigned(spark, d).select("image_id", "sequence_id", "frame_index", "official_split", "split", "exclusion_reason", "unseen_sequence")


@query(f"WITH {SPLIT_SQL}, c AS (SELECT split, coalesce(split_part(exclusion_reason, '(', 1), '') AS reason, count(*) AS n FROM s4 GROUP BY ALL) SELECT x.split, coalesce(reason, '') AS reason, coalesce(n, 0) AS n FROM (VALUES ('train'), ('val'), ('calibration'), ('test'), ('excluded')) x(split) LEFT JOIN c USING (split)")
def split_summary(spark, d):
    return splits.split_summary(_assigned(spark, d))


@query(f"WITH {SPLIT_SQL} SELECT DISTINCT sequence_id FROM s4 WHERE unseen_sequence")
def unseen_sequences(spark, d):
    return _assigned(spark, d).where("unseen_sequence").select("sequence_id").distinct()


@query(
    f"WITH {SPLIT_SQL}, h AS (SELECT sha256(concat_ws(',', coalesce(image_id::VARCHAR, ''), coalesce(official_split, ''), coalesce(split, ''), coalesce(exclusion_reason, ''), coalesce(sequence_id::VARCHAR, ''), coalesce(frame_index::VARCHAR, ''), coalesce(unseen_sequence::VARCHAR, ''))) AS h FROM s4),"
    " q AS (SELECT substr(h, 1, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY part)) AS manifest_id FROM q"
)
def split_manifest_id(spark, d):
    return splits.manifest_id(_assigned(spark, d))


# calibration, bootstrap, percentiles

SOFT = """v AS (SELECT vec_id, label % 5 AS truth, list_transform(embedding[1:5], lambda x: x::DOUBLE * 8) AS z FROM embeddings), e AS (SELECT vec_id, truth, z, list_transform(z, lambda x: exp((x - list_max(z)) / 1.5::DOUBLE)) AS w FROM v),
soft AS (SELECT vec_id, truth, list_transform(w, lambda x: x / list_sum(w)) AS p FROM e)"""


def _soft(spark, d):
    z = F.transform(F.slice("pixels", 1, 5), lambda x: x.cast("double") * 8)
    rows = V.grey_images(spark, d).select(F.col("image_id").alias("vec_id"), (F.col("label") % 5).alias("truth"), z.alias("z"))
    return rows.select("vec_id", "truth", "z", S.softmax(F.col("z"), 1.5).alias("p"))


@query(f"WITH {SOFT} SELECT vec_id, round(list_max(p), 6) AS confidence, list_position(p, list_max(p))::INT - 1 AS predicted, round(-list_sum(list_transform(p, lambda x: greatest(1e-8, least(1, x)) * ln(greatest(1e-8, least(1, x))))) / ln(5), 6) AS entropy FROM soft")
def softmax_entropy(spark, d):
    return _soft(spark, d).select("vec_id", F.round(F.array_max("p"), 6).alias("confidence"), S.argmax(F.col("p")).alias("predicted"), F.round(S.entropy_fraction(F.col("p")), 6).alias("entropy"))


@query(
    f"WITH {SOFT}, c AS (SELECT round(list_max(p), 9) AS conf, list_position(p, list_max(p)) - 1 = truth AS ok FROM soft), b AS (SELECT *, " + " + ".join(f"(conf > {k} / 15::DOUBLE)::INT" for k in range(1, 15)) + " AS bin FROM c)"
    " SELECT bin, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(ok::INT), 6) AS accuracy, round(abs(avg(ok::INT) - avg(conf)), 6) AS gap FROM b GROUP BY bin"
)
def ece_bins(spark, d):
    rows = _soft(spark, d).select(F.round(F.array_max("p"), 9).alias("conf"), (S.argmax(F.col("p")) == F.col("truth")).alias("ok"))
    return r6(statistics.ece_bins(rows, "conf", "ok"), "mean_confidence", "accuracy", "gap")


@query(f"WITH {SOFT} SELECT round(avg(-ln(greatest(p[truth + 1], 1e-12))), 6) AS nll FROM soft")
def nll(spark, d):
    return r6(statistics.nll(_soft(spark, d), F.get("p", F.col("truth"))), "nll")


def _temperature_sql() -> str:
    """The grid search on log temperatures: three passes, each between the neighbours of the last one's best."""
    parts = ["b0 AS (SELECT ln(0.05::DOUBLE) AS lo, ln(20::DOUBLE) AS hi)"]
    for k in range(3):
        parts.append(f"g{k} AS (SELECT i, lo, hi, lo + (hi - lo) * i / 23::DOUBLE AS s FROM b{k}, (SELECT unnest(range(24)) AS i))")
        parts.append(f"l{k} AS (SELECT i, lo, hi, s, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / exp(s))))) - (z[truth + 1] - list_max(z)) / exp(s)) AS loss FROM g{k}, soft_z GROUP BY ALL)")
        parts.append(f"b{k + 1} AS (SELECT lo + (hi - lo) * greatest(0, i - 1) / 23::DOUBLE AS lo, lo + (hi - lo) * least(23, i + 1) / 23::DOUBLE AS hi, s FROM l{k} ORDER BY loss, i LIMIT 1)")
    return f"WITH {SOFT}, soft_z AS (SELECT z, truth FROM v), {', '.join(parts)}, t AS (SELECT round(exp(s), 4) AS t FROM b3) SELECT round(avg(-ln(greatest(exp((z[truth + 1] - list_max(z)) / t) / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t))), 1e-12))), 6) AS nll, max(t) AS temperature FROM soft_z, t"


@query(_temperature_sql())
def fitted_temperature(spark, d):
    """The fitted temperature and the NLL it gives, over all vectors."""
    rows = _soft(spark, d)
    t = statistics.fit_temperature(rows, "z", "truth")
    return statistics.nll(rows, F.get(S.softmax(F.col("z"), t), F.col("truth"))).select(F.round("nll", 6).alias("nll"), F.lit(t).alias("temperature"))


GROUP_SUMS = f"{CELLS}, gs AS (SELECT image_id, sum(CASE WHEN t = p THEN n ELSE 0 END) AS good, sum(n) AS n FROM cells GROUP BY image_id)"
BOOT_SQL = f"""{GROUP_SUMS}, g AS (SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS g FROM gs),
{draws_sql()},
vals AS (SELECT r, sum(good) / sum(n)::DOUBLE AS value FROM draws JOIN g USING (g) GROUP BY r)"""
INTERVAL = "round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, (SELECT k FROM k) AS n_groups, (SELECT k FROM k) < 5 AS few_groups"


def _accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum("good").cast("double") / F.sum("n")).alias("value"))


def _group_sums(spark, d):
    cells = metrics.confusion_cells(V.pixels(spark, d), ["image_id"])
    return cells.groupBy("image_id").agg(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"))


@query(f"WITH {BOOT_SQL} SELECT (SELECT round(sum(good) / sum(n)::DOUBLE, 6) FROM g) AS estimate, {INTERVAL} FROM vals")
def bootstrap_ci(spark, d):
    return r6(statistics.interval(_group_sums(spark, d), "image_id", _accuracy, summed=["good", "n"]), "estimate", "low", "high")


#: Two runs of each of two sides, all of the same images: the given prediction and ones that miss or confuse a part of it.
RUNS = {"a1": ("p", lambda: F.col("p")), "a2": ("CASE WHEN event_id % 11 = 0 THEN (p + 1) % 5 ELSE p END", lambda: F.when(F.col("event_id") % 11 == 0, (F.col("p") + 1) % 5).otherwise(F.col("p"))),
        "b1": ("CASE WHEN event_id % 3 = 0 THEN 0 ELSE p END", lambda: F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("p"))), "b2": ("CASE WHEN event_id % 4 = 1 THEN 0 ELSE p END", lambda: F.when(F.col("event_id") % 4 == 1, 0).otherwise(F.col("p")))}
_SUMS = [f"{what}_{run}_{c}" for run in RUNS for c in TARGETS for what in ("both", "either")]
_RUN_SQL = ", ".join(f"count_if(t = {c} AND {p} = {c}) AS both_{run}_{c}, count_if(t = {c} OR {p} = {c}) AS either_{run}_{c}" for run, (p, _) in RUNS.items() for c in TARGETS)


def _macro_sql(run: str) -> str:
    return "list_avg([" + ", ".join(f"sum(both_{run}_{c}) / nullif(sum(either_{run}_{c}), 0)::DOUBLE" for c in TARGETS) + "])"


_DIFFERENCE = f"({_macro_sql('a1')} + {_macro_sql('a2')}) / 2 - ({_macro_sql('b1')} + {_macro_sql('b2')}) / 2"
PAIRED_SQL = f"""{PX}, gs AS (SELECT image_id, {_RUN_SQL} FROM px WHERE t <> 255 GROUP BY image_id), g AS (SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS g FROM gs),
{draws_sql()}"""


def run_sums(spark, d):
    """A row an image: for each run and target class the pixels of truth and prediction, and of either."""
    px = V.pixels(spark, d).where("t <> 255")
    sums = []
    for run, (_, made) in RUNS.items():
        for c in TARGETS:
            t, p = F.col("t") == c, made() == c
            sums += [F.count_if(t & p).alias(f"both_{run}_{c}"), F.count_if(t | p).alias(f"either_{run}_{c}")]
    return px.groupBy("image_id").agg(*sums)


def macro_iou(run: str) -> Column:
    """Macro IoU of the target classes from summed counts, classes that occur nowhere left out."""
    ious = F.filter(F.array(*[F.try_divide(F.col(f"both_{run}_{c}").cast("double"), F.col(f"either_{run}_{c}")) for c in TARGETS]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(ious, F.lit(0.0), lambda a, b: a + b), F.size(ious))


def mean_difference(side_a: list[str], side_b: list[str]):
    """The statistic of a comparison: the mean macro IoU over the runs of one side less that over the other's, of summed counts."""

    def statistic(rows: DataFrame, by: list[str]) -> DataFrame:
        summed = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])
        mean = [sum((macro_iou(run) for run in side), F.lit(0.0)) / len(side) for side in (side_a, side_b)]
        return summed.select(*by, (mean[0] - mean[1]).alias("value"))

    return statistic


@query(f"WITH {PAIRED_SQL}, vals AS (SELECT r, {_DIFFERENCE} AS value FROM draws JOIN g USING (g) GROUP BY r) SELECT (SELECT round({_DIFFERENCE}, 6) FROM g) AS estimate, {INTERVAL} FROM vals")
def paired_bootstrap(spark, d):
    """Two runs of each of two sides under shared draws: the interval of the difference of their mean macro IoU."""
    return r6(statistics.interval(run_sums(spark, d), "image_id", mean_difference(["a1", "a2"], ["b1", "b2"]), summed=_SUMS), "estimate", "low", "high")


@query(f"WITH {PAIRED_SQL}, vals AS (SELECT r, {_macro_sql('a1')} AS value FROM draws JOIN g USING (g) GROUP BY r) SELECT (SELECT round({_macro_sql('a1')}, 6) FROM g) AS estimate, {INTERVAL} FROM vals")
def bootstrap_macro_iou(spark, d):
    """The interval of one run's macro IoU of summed counts."""

    def statistic(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS]).select(*by, macro_iou("a1").alias("value"))

    return r6(statistics.interval(run_sums(spark, d), "image_id", statistic, summed=_SUMS), "estimate", "low", "high")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return r6(statistics.percentiles(table(spark, d, "events"), "value", ["event_type"]), "p50", "p95", "mean")


@query("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value FROM o WHERE r = round_even(0.95 * (n - 1), 0)")
def nearest_rank_p95(spark, d):
    return statistics.nearest_rank(table(spark, d, "events"), "value", 0.95, ["event_type"])


_BOUNDS = [1, 5, 10, 50, 100, 500]


@query("SELECT event_type, le::DOUBLE AS le, count_if(value <= le) AS n FROM events, (SELECT unnest([1, 5, 10, 50, 100, 500]) AS le) GROUP BY ALL")
def latency_histogram(spark, d):
    return statistics.cumulative_histogram(table(spark, d, "events"), "value", _BOUNDS, ["event_type"])


@query("SELECT count(*) AS n, round(count_if(event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second FROM events")
def run_summary(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 6).alias("success_rate"), F.round(F.count(F.lit(1)) / (F.max(seconds) - F.min(seconds)), 6).alias("per_second"))


# jobs, reports, feedback


@query(f"WITH {AUDIT_IMAGES} SELECT audit_id, count_if(status = 'failed') AS n_failed, count_if(status = 'pending') AS n_pending, count_if(status = 'complete') AS n_complete, count(*) AS n FROM audit_images GROUP BY audit_id")
def audit_progress(spark, d):
    return jobs.status_counts(V.audit_images(spark, d), "audit_id", "status", ["failed", "pending", "complete"])


@query(f"WITH {AUDIT_IMAGES}, c AS (SELECT audit_id, count_if(status = 'failed') AS f, count_if(status = 'complete') AS c FROM audit_images GROUP BY audit_id) SELECT audit_id, CASE WHEN f = 0 THEN 'complete' WHEN c > 0 THEN 'partial' ELSE 'failed' END AS final_status FROM c")
def final_status(spark, d):
    c = jobs.status_counts(V.audit_images(spark, d), "audit_id", "status", ["failed", "pending", "complete"])
    return c.select("audit_id", jobs.final_status(F.col("n_failed"), F.col("n_complete")).alias("final_status"))


@query(f"WITH {AUDIT_IMAGES} SELECT audit_id, position, row_number() OVER (PARTITION BY audit_id ORDER BY coalesce(priority, 0) DESC, position) AS place FROM audit_images WHERE l_linestatus = 'O'")
def review_queue(spark, d):
    return jobs.review_queue(V.audit_images(spark, d), F.col("l_linestatus") == "O", "priority", "position", "audit_id").select("audit_id", "position", "place")


@query(f"WITH {AUDITS} SELECT count_if(status = 'queued') AS queue_length, coalesce(epoch('{NOW}'::TIMESTAMP)::BIGINT - epoch(min(created_at) FILTER (status = 'queued'))::BIGINT, 0) AS oldest_age_seconds FROM audits")
def oldest_pending(spark, d):
    return jobs.queue_metrics(V.audits(spark, d), "status", "queued", "created_at", NOW)


@query(f"WITH {AUDITS} SELECT idempotency_key, min_by(request_hash, audit_id) AS accepted, count(*) AS n, count(DISTINCT request_hash) > 1 AS conflict FROM audits GROUP BY idempotency_key")
def idempotency(spark, d):
    return jobs.idempotent_requests(V.audits(spark, d), "idempotency_key", "request_hash", "audit_id")


@query(f"WITH {AUDIT_IMAGES} SELECT cache_key, min_by(result, (completed_at, audit_id, position)) AS result, count(*) AS n FROM audit_images WHERE completed_at IS NOT NULL GROUP BY cache_key")
def cached_result(spark, d):
    images = V.audit_images(spark, d).withColumn("moment", F.struct("completed_at", "audit_id", "position"))
    return jobs.cached_results(images.where("completed_at IS NOT NULL"), "cache_key", "result", "moment")


@query(f"WITH {AUDITS} SELECT audit_id, status FROM audits WHERE created_at + INTERVAL 72 HOUR < '{NOW}'::TIMESTAMP AND status NOT IN ('queued', 'running')")
def retention_expired(spark, d):
    rows = V.audits(spark, d).withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 72 HOURS"))
    return jobs.expired(rows, "expires_at", "status", ("queued", "running"), NOW).select("audit_id", "status")


@query(
    f"WITH {AUDITS}, {AUDIT_IMAGES}, n AS (SELECT audit_id, count(*) AS n FROM audit_images GROUP BY audit_id) SELECT 'finished_with_pending' AS check_name, count(*) AS violations FROM audit_images i JOIN audits a USING (audit_id) WHERE a.status = 'complete' AND i.status = 'pending'"
    " UNION ALL SELECT 'audits_without_three_images', count(*) FROM audits LEFT JOIN n USING (audit_id) WHERE coalesce(n, 0) <> 3 UNION ALL SELECT 'repeated_positions', count(*) FROM (SELECT audit_id, position FROM audit_images GROUP BY ALL HAVING count(*) > 1)"
)
def integrity_checks(spark, d):
    a, i = V.audits(spark, d), V.audit_images(spark, d)
    pending = i.where("status = 'pending'").select("audit_id").join(a.where("status = 'complete'").select("audit_id"), "audit_id")
    repeated = i.groupBy("audit_id", "position").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = None
    for name, rows in (("finished_with_pending", pending), ("audits_without_three_images", jobs.missing_artifacts(a, i, "audit_id", 3)), ("repeated_positions", repeated)):
        one = rows.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations"))
        out = one if out is None else out.union(one)
    return out


def lease_events(spark, d):
    """Claims and finishes of audits (one a user and day) in event order."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "release").otherwise("claim")
    return e.select(F.concat_ws("-", "user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")).alias("audit_id"), (F.col("event_id").cast("double")).alias("at"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("worker"))


_OPEN = "(w.status = 'queued' OR (w.status = 'running' AND w.until < e.moment))"
_HELD = "(w.status = 'running' AND w.owner = e.worker AND w.until >= e.moment)"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY moment) AS n FROM (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS audit_id, event_id::DOUBLE AS moment,
  CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'release' ELSE 'claim' END AS kind, 'w' || event_id % 3 AS worker FROM events)),
w AS (SELECT DISTINCT audit_id, 0::BIGINT AS n, 'queued' AS status, 0 AS attempts, NULL::VARCHAR AS owner, -1e300::DOUBLE AS until FROM e
  UNION ALL SELECT e.audit_id, e.n,
    CASE WHEN kind = 'claim' AND {_OPEN} THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'running' END WHEN kind = 'finish' AND {_HELD} THEN 'complete' WHEN kind = 'release' AND {_HELD} THEN 'queued' ELSE w.status END,
    CASE WHEN kind = 'claim' AND {_OPEN} AND attempts < 3 THEN attempts + 1 ELSE attempts END,
    CASE WHEN kind = 'claim' AND {_OPEN} THEN CASE WHEN attempts >= 3 THEN NULL ELSE e.worker END WHEN kind IN ('finish', 'release') AND {_HELD} THEN NULL ELSE w.owner END,
    CASE WHEN kind = 'claim' AND {_OPEN} THEN CASE WHEN attempts >= 3 THEN -1e300 ELSE e.moment + 500 END WHEN kind IN ('finish', 'release') AND {_HELD} THEN -1e300 ELSE w.until END
  FROM w JOIN e ON e.audit_id = w.audit_id AND e.n = w.n + 1)
SELECT audit_id, max_by(status, n) AS status, max_by(attempts, n) AS attempts, max_by({{'o': owner}}, n).o AS owner FROM w GROUP BY audit_id"""
)
def lease_fold(spark, d):
    return jobs.lease_fold(lease_events(spark, d), 500.0, 3)


@query(f"WITH {AUDITS}, {AUDIT_IMAGES} SELECT a.audit_id, a.status, count(position) AS n_images, count(*) FILTER (i.status = 'complete') AS n_done, array_to_string(list(i.position || ':' || i.status ORDER BY i.position, i.status), ';') AS images FROM audits a LEFT JOIN audit_images i USING (audit_id) GROUP BY a.audit_id, a.status")
def audit_report(spark, d):
    i = V.audit_images(spark, d).select("audit_id", "position", F.col("status").alias("image_status"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "image_status")))), lambda x: F.concat_ws(":", x["position"], x["image_status"]))
    return V.audits(spark, d).join(i, "audit_id", "left").groupBy("audit_id", "status").agg(F.count("position").alias("n_images"), F.count_if(F.col("image_status") == "complete").alias("n_done"), F.nullif(F.array_join(lines, ";"), F.lit("")).alias("images"))


@query(f"WITH {FEEDBACK} SELECT image_id, max(feedback_id) AS feedback_id, max_by(decision, feedback_id) AS decision FROM feedback GROUP BY image_id")
def latest_feedback(spark, d):
    return jobs.latest_per_key(V.feedback(spark, d), "image_id", "feedback_id", ["decision"])


@query(f"WITH {FEEDBACK} SELECT image_id, count(*) AS n, array_to_string(list(decision ORDER BY feedback_id), '>') AS history FROM feedback GROUP BY image_id")
def feedback_history(spark, d):
    return jobs.history(V.feedback(spark, d), "image_id", "feedback_id", "decision")


@query(f"WITH {FEEDBACK} SELECT CASE WHEN decision = 'needs_retake' THEN 'retake' WHEN decision = 'corrected' AND note_chars > 200 THEN 'pixel_mask' ELSE 'image_level' END AS kind, count(*) AS n FROM feedback GROUP BY 1")
def label_kind(spark, d):
    return V.feedback(spark, d).groupBy(jobs.label_kind(F.col("decision"), F.col("note_chars") > 200).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEEDBACK}, l AS (SELECT image_id, max_by(decision, feedback_id) AS decision FROM feedback GROUP BY image_id) SELECT doc_id AS image_id, coalesce(decision, 'none') AS decision, CASE WHEN decision IS NULL THEN 'no_feedback' WHEN decision = 'needs_retake' THEN 'retake' WHEN n_chars < 100 THEN 'too_small' ELSE 'eligible' END AS state FROM documents LEFT JOIN l ON image_id = doc_id")
def eligible_candidates(spark, d):
    last = jobs.latest_per_key(V.feedback(spark, d), "image_id", "feedback_id", ["decision"]).select("image_id", "decision")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "n_chars")
    state = F.when(F.col("decision").isNull(), "no_feedback").when(F.col("decision") == "needs_retake", "retake").when(F.col("n_chars") < 100, "too_small").otherwise("eligible")
    return docs.join(last, "image_id", "left").select("image_id", F.coalesce("decision", F.lit("none")).alias("decision"), state.alias("state"))


# study


@query(f"WITH {TRIALS}, m AS (SELECT participant, quantile_cont(seconds, 0.5) FILTER (condition = 'assisted') / quantile_cont(seconds, 0.5) FILTER (condition = 'unaided') AS ratio FROM trials GROUP BY participant) SELECT round(quantile_cont(ratio, 0.5), 6) AS median_ratio, count(ratio) AS n FROM m")
def study_medians(spark, d):
    medians = statistics.quantiles(V.trials(spark, d).select("participant", "condition", "seconds"), "seconds", [0.5], ["participant", "condition"])

    def of(condition: str) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col("q0")))

    per = medians.groupBy("participant").agg(F.try_divide(of("assisted"), of("unaided")).alias("ratio"))
    return statistics.percentiles(per, "ratio").select(F.round("p50", 6).alias("median_ratio"), "n")


@query(f"WITH {TRIALS} SELECT condition, round(count_if(positive AND follow_up) / nullif(count_if(positive), 0)::DOUBLE, 6) AS recall, count(*) AS n FROM trials GROUP BY condition")
def study_recall(spark, d):
    hit = F.count_if(F.col("positive") & F.col("follow_up")).cast("double")
    return V.trials(spark, d).groupBy("condition").agg(F.round(F.try_divide(hit, F.count_if("positive")), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {TRIALS}, x AS (SELECT condition, m AS material, list_contains(materials, m) AS said, list_contains(suggested, m) AS truth FROM trials, (SELECT unnest(['cardboard', 'soft_plastic', 'rigid_plastic', 'metal']) AS m))"
    " SELECT condition, material, round(count_if(said AND truth) / nullif(count_if(said), 0)::DOUBLE, 6) AS precision, round(count_if(said AND truth) / nullif(count_if(truth), 0)::DOUBLE, 6) AS recall FROM x GROUP BY ALL"
)
def material_pr(spark, d):
    return r6(jobs.material_scores(V.trials(spark, d), ["cardboard", "soft_plastic", "rigid_plastic", "metal"], "materials", "suggested", ["condition"]), "precision", "recall")


@query(f"WITH {TRIALS}, x AS (SELECT condition, len(list_filter(suggested, lambda m: NOT list_contains(materials, m))) + len(list_filter(materials, lambda m: NOT list_contains(suggested, m))) AS size FROM trials) SELECT condition, round(avg((size > 0)::INT), 6) AS share_changed, round(avg(size), 6) AS mean_changes FROM x GROUP BY condition")
def changed_suggestions(spark, d):
    return r6(jobs.changed_suggestions(V.trials(spark, d), "suggested", "materials", ["condition"]), "share_changed", "mean_changes")


@query(f"WITH {TRIALS} SELECT participant, ((participant - 1) % 4 + 4) % 4 AS arm FROM trials GROUP BY participant")
def arm_plan(spark, d):
    return V.trials(spark, d).groupBy("participant").agg(F.first(jobs.arm(F.col("participant"))).alias("arm"))


@query(f"WITH {PX}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, t ORDER BY md5('0:' || event_id), event_id) AS r FROM px WHERE t <> 255) SELECT event_id, image_id, t FROM o WHERE r <= 5")
def stratified_pixels(spark, d):
    return jobs.stratified_sample(V.pixels(spark, d).where("t <> 255"), ["image_id", "t"], "event_id", 5).select("event_id", "image_id", "t")


@query(f"WITH {PX}, w AS (SELECT t, count(*) AS n FROM px WHERE t <> 255 GROUP BY t), s AS (SELECT t, count(*) AS m FROM (SELECT t, row_number() OVER (PARTITION BY image_id, t ORDER BY md5('0:' || event_id), event_id) AS r FROM px WHERE t <> 255) WHERE r <= 5 GROUP BY t) SELECT t, round((n / sum(n) OVER ()) / (m / sum(m) OVER ()), 6) AS ratio FROM w JOIN s USING (t)")
def prior_ratio(spark, d):
    px = V.pixels(spark, d).where("t <> 255")
    return r6(jobs.prior_ratio(px, jobs.stratified_sample(px, ["image_id", "t"], "event_id", 5), "t"), "ratio")


# names, labels, validation


@query("SELECT p_partkey, lower(replace(replace(p_name, '-', ' '), ' ', '_')) AS name, upper(p_type) AS kind FROM part")
def label_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalize_name(F.col("p_name")).alias("name"), F.upper("p_type").alias("kind"))


@query("SELECT event_id, lpad((event_id % 12)::VARCHAR, 2, '0') AS sequence_id, event_id::INT AS frame_index, CASE WHEN event_id % 3 = 0 THEN (event_id % 5)::INT END AS variant FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 7 = 0")
def frame_name_parse(spark, d):
    name = F.when(F.col("event_id") % 7 == 0, F.lit("odd.png")).otherwise(
        F.concat(F.lpad((F.col("event_id") % 12).cast("string"), 2, "0"), F.lit("_frame_"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("-"), (F.col("event_id") % 5).cast("string"))).otherwise(""), F.lit(".PNG"))
    )
    return table(spark, d, "events").select("event_id", name.alias("name")).select("event_id", *[c.alias(n) for n, c in S.frame_name(F.col("name")).items()])


@query(f"WITH {PX}, c AS (SELECT image_id, t FROM px) SELECT image_id, " + ", ".join(f"count_if(t = {i}) AS px_{n}" for i, n in CLASSES.items()) + " FROM c GROUP BY image_id")
def class_pivot(spark, d):
    return V.pixels(spark, d).groupBy("image_id").agg(*[F.count_if(F.col("t") == i).alias(f"px_{n}") for i, n in CLASSES.items()])


@query("SELECT n_nationkey, n_name, CASE WHEN s.k IS NULL THEN 'supplier' WHEN c.k IS NULL THEN 'customer' ELSE '' END AS missing FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON s.k = n_nationkey LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer) c ON c.k = n_nationkey")
def orphan_names(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("s", F.lit(1))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("c", F.lit(1))
    missing = F.when(F.col("s").isNull(), "supplier").when(F.col("c").isNull(), "customer").otherwise("")
    return table(spark, d, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_nationkey", "n_name", missing.alias("missing"))


@query("WITH i AS (SELECT unnest(list_filter([CASE WHEN n_chars < 50 THEN 'too_small' END, CASE WHEN text IS NULL THEN 'missing' END, CASE WHEN n_chars <> length(text) THEN 'size' END, CASE WHEN n_chars > 10000 THEN 'too_large' END], lambda x: x IS NOT NULL)) AS code FROM documents) SELECT code, count(*) AS n FROM i GROUP BY code")
def issue_code_counts(spark, d):
    issues = S.compact((F.col("n_chars") < 50, "too_small(50)"), (F.col("text").isNull(), "missing"), (F.col("n_chars") != F.length("text"), "size(n_chars)"), (F.col("n_chars") > 10000, "too_large"))
    return table(spark, d, "documents").select(F.explode(issues).alias("issue")).groupBy(S.issue_code(F.col("issue")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY source")
def validation_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


# streams and models


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    """The first event of each user, type and day through the stream: repeats of a key are accepted once."""
    events = streams.read_events(spark, f"{d}/event*.parquet").select("user_id", "event_type", F.date_format("at", "yyyy-MM-dd").alias("day"))
    return streams.drain_append(streams.once_per_key(events, ["user_id", "event_type", "day"]))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_queue_metrics(spark, d):
    return streams.drain_complete(streams.queue_metrics(streams.read_events(spark, f"{d}/event*.parquet"))).select("event_type", F.col("day").cast("string").alias("day"), "n")


@query()
def rf_predict(spark, d):
    """Forest probabilities of every image, corrected to uniform priors."""
    rows = V.grey_images(spark, d).withColumn("cls", F.col("label") % 5)
    found = models.forest_probabilities(rows.where("image_id % 2 = 0"), rows, "pixels", "cls")
    return found.select("image_id", "cls", S.argmax(models.correct_prior(F.col("proba"), [1.0] * 5, 1.0)).alias("predicted"))


@query()
def forest_tuning(spark, d):
    """Two forests with three powers of the prior correction: fitted on one part of the images, scored on the others."""
    rows = V.grey_images(spark, d).withColumn("cls", F.col("label") % 5).withColumn("held", S.uniform_draw(F.concat(F.lit("tune:"), F.col("image_id").cast("string"))) < 0.3)
    train = jobs.stratified_sample(rows.where("NOT held"), ["cls"], "image_id", 1000)
    shares = {r["cls"]: r["ratio"] for r in jobs.prior_ratio(rows.where("NOT held"), train, "cls").collect()}  # a row a class
    ratio = [shares.get(c) or 1.0 for c in range(len(CLASSES))]
    scores = models.tune_forest(train, rows.where("held"), "pixels", "cls", ratio, [{"trees": 20, "depth": 5}, {"trees": 20, "depth": 10}], [0.0, 0.5, 1.0])
    return scores.join(F.broadcast(models.best_candidate(scores).select("forest", "power_no", F.lit(True).alias("best"))), ["forest", "power_no"], "left").select("forest", "power_no", "power", F.round("fg_macro_iou", 6).alias("fg_macro_iou"), F.coalesce("best", F.lit(False)).alias("best"))


# further stages and study queries


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n FROM s0 GROUP BY split")
def split_calibration(spark, d):
    return splits.calibration_stage(V.frames(spark, d), CALIBRATION).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPLIT_SQL} SELECT image_id, exclusion_reason FROM s2 WHERE split = 'excluded'")
def split_dup_exclusion(spark, d):
    rows = splits.duplicate_stages(splits.calibration_stage(V.frames(spark, d), CALIBRATION), V.frame_pairs(spark, d))
    return rows.where("split = 'excluded'").select("image_id", "exclusion_reason")


@query(f"WITH {FRAMES}, g AS (SELECT t.image_id, min(abs(t.frame_index - e.frame_index)) AS gap FROM frames t JOIN frames e USING (sequence_id) WHERE t.official_split = 'train' AND e.official_split <> 'train' GROUP BY 1) SELECT image_id, gap FROM g WHERE gap <= {BUFFER}")
def split_buffer_exclusion(spark, d):
    f = V.frames(spark, d)
    near = duplicates.nearest_gap(f.where("official_split = 'train'"), f.where("official_split <> 'train'"), "sequence_id", "frame_index", "image_id")
    return near.where(F.col("gap") <= BUFFER).select("image_id", "gap")


@query(f"WITH {GROUP_SUMS} SELECT image_id, good::BIGINT AS good, n::BIGINT AS n FROM gs")
def group_sums(spark, d):
    return _group_sums(spark, d)


@query(f"WITH {SOFT}, m AS (SELECT truth, list_position(p, list_max(p)) - 1 AS c, list_max(p) AS x FROM soft) SELECT count(*) AS n, count_if(c > 0) AS n_foreground, round(avg(x) FILTER (c > 0), 6) AS mean_confidence FROM m")
def foreground_mask(spark, d):
    rows = _soft(spark, d).select(S.argmax(F.col("p")).alias("c"), F.array_max("p").alias("x"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") > 0).alias("n_foreground"), F.round(F.avg(F.when(F.col("c") > 0, F.col("x"))), 6).alias("mean_confidence"))


@query(f"WITH {PX} SELECT CASE t WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 255 THEN 255 END AS mapped, count(*) AS n FROM px GROUP BY 1")
def remap_labels(spark, d):
    return jobs.remap(V.pixels(spark, d), "t", {0: 0, 1: 3, 2: 1, 3: 4, 4: 2}).groupBy("mapped").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PX} SELECT image_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS unmapped FROM px WHERE t NOT IN (0, 1, 2, 255) GROUP BY image_id")
def unmapped_values(spark, d):
    rows = jobs.remap(V.pixels(spark, d), "t", {0: 0, 1: 1, 2: 2}).where("mapped IS NULL")
    return rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("unmapped"))


@query(f"WITH {PX}, c AS ({_RAW.format(c='p')}), q AS (SELECT quantile_cont(total_target, 1/3::DOUBLE) AS a, quantile_cont(total_target, 2/3::DOUBLE) AS b FROM c) SELECT CASE WHEN total_target <= a THEN 'low' WHEN total_target <= b THEN 'middle' ELSE 'high' END AS tertile, count(*) AS n FROM c, q GROUP BY 1")
def stratified_coverage_tertiles(spark, d):
    c = metrics.coverage(V.pixels(spark, d), ["image_id"])
    cuts = statistics.quantiles(c, "total_target", [1 / 3, 2 / 3])
    name = F.when(F.col("total_target") <= F.col("q0"), "low").when(F.col("total_target") <= F.col("q1"), "middle").otherwise("high")
    return c.crossJoin(F.broadcast(cuts)).groupBy(name.alias("tertile")).agg(F.count(F.lit(1)).alias("n"))  # one row


@query(f"WITH {FRAMES}, o AS (SELECT image_id, sequence_id, (row_number() OVER (PARTITION BY sequence_id ORDER BY value, image_id) - 1) // 2 AS pair FROM frames) SELECT image_id, sequence_id, pair, CASE WHEN row_number() OVER (PARTITION BY sequence_id, pair ORDER BY md5('0:' || image_id), image_id) = 1 THEN 'A' ELSE 'B' END AS set FROM o")
def pair_assignment(spark, d):
    return jobs.pair_assignment(V.frames(spark, d), "value", "image_id", "sequence_id")


@query(f"WITH {FEEDBACK}, l AS (SELECT image_id, max_by(decision, feedback_id) AS decision FROM feedback GROUP BY image_id), c AS (SELECT doc_id % 3 <> 0 AS consent, CASE WHEN n_chars > 200 THEN 'complete' ELSE 'failed' END AS status, decision FROM documents LEFT JOIN l ON image_id = doc_id), r AS (SELECT CASE WHEN NOT consent THEN 'no_consent' WHEN status <> 'complete' THEN 'not_complete' WHEN decision IS NULL THEN 'no_feedback' END AS reason FROM c) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def feedback_skips(spark, d):
    last = jobs.latest_per_key(V.feedback(spark, d), "image_id", "feedback_id", ["decision"]).select(F.col("image_id").alias("doc_id"), "decision")
    docs = table(spark, d, "documents").join(last, "doc_id", "left")
    return jobs.feedback_skips(docs.select((F.col("doc_id") % 3 != 0).alias("consent"), F.when(F.col("n_chars") > 200, "complete").otherwise("failed").alias("status"), "decision"))


@query(
    f"""WITH RECURSIVE {FRAMES}, f AS (SELECT sequence_id, frame_index, min(image_id) AS image_id FROM frames GROUP BY ALL),
n AS (SELECT a.sequence_id, a.frame_index, a.image_id, b.frame_index AS next FROM f a ASOF LEFT JOIN f b ON a.sequence_id = b.sequence_id AND a.frame_index + 20000 <= b.frame_index),
t AS (SELECT n.* FROM n JOIN (SELECT sequence_id, min(frame_index) AS frame_index FROM f GROUP BY 1) USING (sequence_id, frame_index) UNION ALL SELECT n.* FROM t JOIN n ON n.sequence_id = t.sequence_id AND n.frame_index = t.next)
SELECT sequence_id, image_id FROM t"""
)
def spaced_frames(spark, d):
    return spacing.spaced_selection(V.frames(spark, d), "sequence_id", "frame_index", "image_id", 20_000)


@query("SELECT c_mktsegment, n_name, count(*) AS n, count_if(o_orderstatus = 'F') AS n_finished, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def audits_by_site(spark, d):
    """Audits by the profile and site of their camera: a filter-free star join, its dimensions by their checked size."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total_cents"))


from . import checks, reports, service, vision  # noqa: E402, F401  register their queries here
