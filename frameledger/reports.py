"""Reports and checks as queries: nested and flat audit reports, error statistics, validation, study and job tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _RAW, CELLS, DECIDED, NOW, SIDES, SOFT, _soft, query
from .functions.scalars import compact
from .operators import jobs, metrics, review, spacing, statistics
from .plans import views as V
from .plans.views import AUDIT_IMAGES, AUDITS, FEEDBACK, PX, TRIALS, table
from .schemas import CLASSES, TARGETS

# audit reports


@query(
    f"WITH {AUDITS}, {AUDIT_IMAGES}, i AS (SELECT audit_id, list({{'position': position, 'status': status}} ORDER BY position, status) AS images FROM audit_images GROUP BY audit_id),"
    f" {FEEDBACK}, f AS (SELECT image_id AS audit_id, list({{'feedback_id': feedback_id, 'decision': decision}} ORDER BY feedback_id, decision) AS feedback FROM feedback GROUP BY image_id)"
    " SELECT audit_id, to_json({'audit_id': audit_id, 'status': status, 'images': coalesce(images, []), 'feedback': coalesce(feedback, [])})::VARCHAR AS report FROM audits LEFT JOIN i USING (audit_id) LEFT JOIN f USING (audit_id)"
)
def audit_report_json(spark, d):
    """An audit with its images and the feedback on it as one nested document."""
    i = V.audit_images(spark, d).groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("position", "status"))).alias("images"))
    f = V.feedback(spark, d).groupBy(F.col("image_id").alias("audit_id")).agg(F.array_sort(F.collect_list(F.struct("feedback_id", "decision"))).alias("feedback"))
    joined = V.audits(spark, d).select("audit_id", "status").join(i, "audit_id", "left").join(f, "audit_id", "left")
    none = {c: F.coalesce(c, F.from_json(F.lit("[]"), dict(joined.dtypes)[c])).alias(c) for c in ("images", "feedback")}
    return joined.select("audit_id", F.to_json(F.struct("audit_id", "status", none["images"], none["feedback"])).alias("report"))


@query(
    f"WITH {PX}, {FEEDBACK}, c AS ({_RAW.format(c='p')}), l AS (SELECT image_id, max(feedback_id) AS feedback_id, max_by(decision, feedback_id) AS decision FROM feedback GROUP BY image_id)"
    " SELECT image_id, " + ", ".join(f"round(cov_{CLASSES[k]}, 6) AS cov_{CLASSES[k]}" for k in TARGETS) + ", feedback_id, coalesce(decision, '') AS decision FROM c LEFT JOIN l USING (image_id)"
)
def audit_report_rows(spark, d):
    """The flat report: an image's coverage as columns beside its latest feedback."""
    c = metrics.coverage(V.pixels(spark, d), ["image_id"])
    last = jobs.latest_per_key(V.feedback(spark, d), "image_id", "feedback_id", ["decision"])
    return c.join(last, "image_id", "left").select("image_id", *[F.round(f"cov_{CLASSES[k]}", 6).alias(f"cov_{CLASSES[k]}") for k in TARGETS], "feedback_id", F.coalesce("decision", F.lit("")).alias("decision"))


@query(
    f"WITH {AUDIT_IMAGES}, {FEEDBACK}, h AS (SELECT image_id, array_to_string(list(decision ORDER BY feedback_id), '>') AS history FROM feedback GROUP BY image_id), a AS (SELECT audit_id, position, status, cache_key FROM audit_images)"
    " SELECT audit_id, position, status, cache_key, coalesce(history, '') AS history FROM a LEFT JOIN h ON image_id = cache_key"
)
def image_detail(spark, d):
    h = jobs.history(V.feedback(spark, d), "image_id", "feedback_id", "decision").select(F.col("image_id").alias("cache_key"), "history")
    return V.audit_images(spark, d).select("audit_id", "position", "status", "cache_key").join(h, "cache_key", "left").select("audit_id", "position", "status", "cache_key", F.coalesce("history", F.lit("")).alias("history"))


# evaluation, comparison and error reports


@query(
    f"WITH {CELLS}, {SIDES}, c AS (SELECT cls, sum(tp) AS tp, sum(truth) AS truth, sum(pred) AS pred FROM sides GROUP BY cls), i AS (SELECT *, tp / nullif(truth + pred - tp, 0)::DOUBLE AS iou FROM c), a AS ({_RAW.format(c='t')}), b AS ({_RAW.format(c='p')}),"
    " e AS (SELECT count(*) AS n_images, avg(abs(b.total_target - a.total_target)) * 100 AS mae FROM a JOIN b USING (image_id)), s AS (SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM px)"
    " SELECT max(n_images) AS n_images, round(avg(iou) FILTER (cls BETWEEN 1 AND 4), 6) AS fg_macro_iou, round(sum(tp) / sum(truth)::DOUBLE, 6) AS accuracy, round(max(mae), 6) AS coverage_mae, round(max(p50), 6) AS seconds_p50, round(max(p95), 6) AS seconds_p95 FROM i, e, s"
)
def evaluation_report(spark, d):
    """One row: overlap of the summed cells, coverage error and time."""
    px = V.pixels(spark, d)
    whole = metrics.summary(metrics.confusion_cells(px))
    t, p = metrics.coverage(px, ["image_id"], "t"), metrics.coverage(px, ["image_id"], "p")
    errors = metrics.coverage_errors(t, p, "image_id").select("mae_total_target").crossJoin(t.agg(F.count(F.lit(1)).alias("n_images")))
    times = statistics.quantiles(px.select("value"), "value", [0.5, 0.95])
    one = whole.crossJoin(errors).crossJoin(times)  # one row each
    return one.select("n_images", *[F.round(c, 6).alias(n) for n, c in (("fg_macro_iou", F.col("fg_macro_iou")), ("accuracy", F.col("accuracy")), ("coverage_mae", F.col("mae_total_target")), ("seconds_p50", F.col("q0")), ("seconds_p95", F.col("q1")))])


@query(
    f"WITH {PX}, r AS (SELECT event_id % 2 AS side, event_id % 6 // 2 AS run, count_if(t = p) / count(*)::DOUBLE AS accuracy, count_if(t = p AND t = 4) / nullif(count_if(t = 4 AND value < 500), 0)::DOUBLE AS metal FROM px WHERE t <> 255 GROUP BY ALL)"
    " SELECT side::BIGINT AS side, count(*) AS n_runs, round(CASE WHEN count(accuracy) = count(*) THEN avg(accuracy) END, 6) AS accuracy, round(CASE WHEN count(metal) = count(*) THEN avg(metal) END, 6) AS metal FROM r GROUP BY side"
)
def comparison_sides(spark, d):
    """Each side's mean over its runs, null where a run has none."""
    px = V.pixels(spark, d).where("t <> 255")
    right = F.col("t") == F.col("p")
    runs = px.groupBy((F.col("event_id") % 2).alias("side"), F.floor(F.col("event_id") % 6 / 2).alias("run")).agg(
        (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"), F.try_divide(F.count_if(right & (F.col("t") == 4)).cast("double"), F.count_if((F.col("t") == 4) & (F.col("value") < 500))).alias("metal")
    )

    def mean(c: str):
        return F.round(F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)), 6).alias(c)

    return runs.groupBy("side").agg(F.count(F.lit(1)).alias("n_runs"), mean("accuracy"), mean("metal"))


@query(
    f"WITH {PX} SELECT image_id, count(*) AS n_valid, count_if(t <> p AND value > 90) AS confident_wrong, round(count_if(value < 10) / greatest(count(*), 1)::DOUBLE, 6) AS uncertain_share, round(count_if(t <> p) / greatest(count(*), 1)::DOUBLE, 6) AS error_share, round(avg(value), 6) AS brightness, round(var_pop(value), 4) AS spread FROM px WHERE t <> 255 GROUP BY image_id"
)
def error_statistics(spark, d):
    """Per image what an error analysis sorts by."""
    n, wrong = F.greatest(F.count(F.lit(1)), F.lit(1)), F.col("t") != F.col("p")
    return V.pixels(spark, d).where("t <> 255").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_valid"), F.count_if(wrong & (F.col("value") > 90)).alias("confident_wrong"), F.round(F.count_if(F.col("value") < 10) / n, 6).alias("uncertain_share"), F.round(F.count_if(wrong) / n, 6).alias("error_share"),
        F.round(F.avg("value"), 6).alias("brightness"), F.round(F.var_pop("value"), 4).alias("spread"),
    )


@query(
    f"WITH {SOFT}, k AS (SELECT unnest(range(1, 5)) AS c), d AS (SELECT c, sum(CASE WHEN truth = c THEN p[c + 1] ELSE 0 END) AS i, sum(p[c + 1]) + count_if(truth = c) AS s FROM soft, k GROUP BY c) SELECT round(1 - avg((2 * i + 1) / (s + 1)), 6) AS loss FROM d"
)
def soft_dice(spark, d):
    """The foreground soft Dice loss of the whole table: one aggregation, a column a class."""
    rows = _soft(spark, d)
    sums = rows.agg(*[F.struct(F.sum(F.when(F.col("truth") == c, F.get("p", F.lit(c))).otherwise(0.0)).alias("i"), (F.sum(F.get("p", F.lit(c))) + F.count_if(F.col("truth") == c)).alias("s")).alias(f"c{c}") for c in TARGETS])
    each = [(2 * F.col(f"c{c}.i") + 1) / (F.col(f"c{c}.s") + 1) for c in TARGETS]
    return sums.select(F.round(1 - sum(each[1:], each[0]) / len(each), 6).alias("loss"))


@query(f"WITH {DECIDED}, m AS (SELECT count_if(route <> 'none') / count(*)::DOUBLE AS rate, count_if(route <> 'none' AND positive) / nullif(count_if(positive), 0)::DOUBLE AS recall FROM decided) SELECT recall >= 0.95 AS meets_floor, round(rate, 6) AS review_rate, round(recall, 6) AS recall FROM m")
def policy_record(spark, d):
    """The current policy against the recall floor."""
    m = review.policy_metrics(review.decide(V.scored(spark, d)))
    return m.select((F.col("recall") >= 0.95).alias("meets_floor"), F.round("review_rate", 6).alias("review_rate"), F.round("recall", 6).alias("recall"))


# validation


@query(
    "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN n_chars < 100 THEN 'too_small' WHEN n_chars <> length(text) THEN 'size' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unexpected_language' ELSE 'ok' END AS state FROM documents"
)
def pair_check(spark, d):
    """The first check that a document fails, in a fixed order."""
    first = F.when(F.col("text").isNull(), "missing").when(F.col("n_chars") < 100, "too_small").when(F.col("n_chars") != F.length("text"), "size").when(~F.col("lang").isin("en", "de", "fr", "es"), "unexpected_language").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", first.alias("state"))


@query("SELECT CASE WHEN o.k IS NULL THEN 'customer_only' WHEN c.k IS NULL THEN 'order_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k GROUP BY 1")
def one_sided_names(spark, d):
    """Names of one list or of both, by a full outer join."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("c", F.lit(True))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("o", F.lit(True))
    side = F.when(F.col("o").isNull(), "customer_only").when(F.col("c").isNull(), "order_only").otherwise("both")
    return c.join(o, "k", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT (SELECT count(*) FROM documents WHERE doc_id IN (FROM w)) AS n_samples, (SELECT count(*) FROM w WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_missing")
def sample_completeness(spark, d):
    """Samples of the wanted ids by a semi join, and wanted ids without a sample by an anti join."""
    docs, wanted = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    have, lost = docs.join(wanted, "doc_id", "left_semi"), wanted.join(docs, "doc_id", "left_anti")
    return have.agg(F.count(F.lit(1)).alias("n_samples")).crossJoin(lost.agg(F.count(F.lit(1)).alias("n_missing")))  # one row each


@query("WITH p AS (SELECT doc_id, 'text' AS kind, sha256(text) AS sha FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 'lang', sha256(lang) FROM documents WHERE source IS NOT NULL) SELECT doc_id, kind, sha FROM p")
def manifest_digests(spark, d):
    """A row a file of the manifest: name, kind and digest, unpivoted in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.sha2(F.col(c).cast("binary"), 256).alias("sha")) for c in ("text", "lang")]))
    return table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", each.alias("f")).select("doc_id", "f.*")


@query(
    r"SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(p_name, '[\w.-]{1,64}') THEN 'camera_id' END, CASE WHEN p_size NOT BETWEEN 3 AND 64 THEN 'region' END, CASE WHEN p_type NOT IN ('LARGE', 'ECONOMY', 'SMALL') THEN 'profile' END], lambda x: x IS NOT NULL), ';') AS errors FROM part"
)
def option_errors(spark, d):
    """Every option that is out of its domain, in a fixed order."""
    errors = compact((~F.col("p_name").rlike(r"^[\w.-]{1,64}$"), "camera_id"), (~F.col("p_size").between(3, 64), "region"), (~F.col("p_type").isin("LARGE", "ECONOMY", "SMALL"), "profile"))
    return table(spark, d, "part").select("p_partkey", F.array_join(errors, ";").alias("errors"))


# study


@query(
    f"WITH {TRIALS}, s AS (SELECT participant, count(*) AS n, count(DISTINCT condition) AS conditions, count_if(seconds IS NULL) AS open FROM trials GROUP BY participant) SELECT participant, n, CASE WHEN open > 0 THEN 'not_completed' WHEN conditions <> 2 THEN 'one_condition' WHEN n < 4 THEN 'too_few_answers' ELSE 'valid' END AS state FROM s"
)
def session_validity(spark, d):
    s = V.trials(spark, d).groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("condition").alias("conditions"), F.count_if(F.col("seconds").isNull()).alias("open"))
    return s.select("participant", "n", F.when(F.col("open") > 0, "not_completed").when(F.col("conditions") != 2, "one_condition").when(F.col("n") < 4, "too_few_answers").otherwise("valid").alias("state"))


@query(f"WITH {TRIALS} SELECT condition, count(*) AS n, count(DISTINCT participant) AS n_participants, round(avg(positive::INT), 6) AS prevalence, round(avg(seconds), 6) AS mean_seconds FROM trials GROUP BY condition")
def set_summary(spark, d):
    return V.trials(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("participant").alias("n_participants"), F.round(F.avg(F.col("positive").cast("int")), 6).alias("prevalence"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


_STRATA = (("negative", 20), ("low", 10), ("middle", 9), ("high", 9))
_GAP = 20_000


def _quota_sql() -> str:
    """Each stratum in turn: the next image by its hash that keeps the gap from all that were taken, until the quota is full."""
    parts = [f"pool AS (SELECT event_id AS id, user_id AS seq, floor(epoch(ts))::BIGINT AS pos, md5('0:' || event_id) AS o, CASE WHEN event_type <> 'purchase' THEN 'negative' WHEN value < 100 THEN 'low' WHEN value < 200 THEN 'middle' ELSE 'high' END AS stratum FROM events)"]
    before = "(SELECT [] :: STRUCT(id BIGINT, seq BIGINT, pos BIGINT, stratum VARCHAR)[] AS got)"
    for i, (name, quota) in enumerate(_STRATA):
        parts.append(
            f"w{i} AS (SELECT 0 AS k, got FROM {before} UNION ALL SELECT k + 1, list_append(got, n) FROM (SELECT k, got, (SELECT min_by(struct_pack(id := id, seq := seq, pos := pos, stratum := stratum), struct_pack(o := o, id := id)) FROM pool WHERE stratum = '{name}'"
            f" AND len(list_filter(got, lambda g: g.id = pool.id OR (g.seq = pool.seq AND abs(g.pos - pool.pos) < {_GAP}))) = 0) AS n FROM w{i} WHERE k < {quota}) WHERE n IS NOT NULL)"
        )
        before = f"(SELECT got FROM w{i} ORDER BY k DESC LIMIT 1)"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT g.id AS event_id, g.stratum AS stratum FROM (SELECT unnest(got) AS g FROM {before})"


@query(_quota_sql())
def quota_draw(spark, d):
    """The images of a study: quotas of negatives and of three strata of coverage, no two of a sequence within the gap."""
    positive = F.col("event_type") == "purchase"
    stratum = F.when(~positive, "negative").when(F.col("value") < 100, "low").when(F.col("value") < 200, "middle").otherwise("high")
    order = F.md5(F.concat(F.lit("0:"), F.col("event_id").cast("string")).cast("binary"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    pool = table(spark, d, "events").select(F.col("user_id").alias("seq"), at.alias("at"), F.col("event_id").alias("id"), order.alias("priority"), stratum.alias("stratum"))
    chosen, out = pool.drop("stratum").limit(0), None
    for name, quota in _STRATA:
        drawn = spacing.spaced_draw(pool.where(F.col("stratum") == name), chosen, quota, _GAP)
        chosen = chosen.unionByName(drawn)
        named = drawn.select(F.col("id").alias("event_id"), F.lit(name).alias("stratum"))
        out = named if out is None else out.unionByName(named)
    return out


@query(f"WITH {TRIALS} SELECT participant, event_id, row_number() OVER (PARTITION BY participant ORDER BY sha256('1:' || participant || ':' || event_id)) AS place FROM trials")
def unaided_order(spark, d):
    """A reproducible order of each participant's trials that tells nothing of them."""
    order = F.sha2(F.concat_ws(":", F.lit("1"), F.col("participant").cast("string"), F.col("event_id").cast("string")).cast("binary"), 256)
    return V.trials(spark, d).select("participant", "event_id", F.row_number().over(Window.partitionBy("participant").orderBy(order)).alias("place"))


# jobs


@query("WITH l AS (SELECT user_id, max(ts) AS seen, max_by(event_type, (ts, event_id)) AS release FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT release, count(*) AS n_workers, count_if(seen >= now - INTERVAL 6 HOUR) AS n_live FROM l, n GROUP BY release")
def workers_by_release(spark, d):
    """The last heartbeat of every worker, and how many of each release are live."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("release"))
    live = F.count_if(F.col("seen") >= F.col("now") - F.expr("INTERVAL 6 HOURS"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).groupBy("release").agg(F.count(F.lit(1)).alias("n_workers"), live.alias("n_live"))  # one row


@query("SELECT o_custkey, o_orderkey, o_orderpriority AS version, lag(o_orderpriority) OVER w AS replaces, lead(o_orderkey) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def release_history(spark, d):
    """Activations in order: what each replaces and whether it is the active one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("version"), F.lag("o_orderpriority").over(w).alias("replaces"), F.lead("o_orderkey").over(w).isNull().alias("active"))


_EXPIRED = f"x AS (SELECT audit_id FROM audits WHERE created_at + INTERVAL 72 HOUR < '{NOW}'::TIMESTAMP AND status = 'complete')"


def _expired(spark, d):
    rows = V.audits(spark, d).withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 72 HOURS"))
    return jobs.expired(rows, "expires_at", "status", ("queued", "running"), NOW).select("audit_id")


@query(f"WITH {AUDITS}, {AUDIT_IMAGES}, {_EXPIRED} SELECT audit_id, position, status FROM audit_images WHERE audit_id NOT IN (FROM x)")
def after_deletion(spark, d):
    """The images that stay when expired audits go with all that belongs to them."""
    return V.audit_images(spark, d).join(_expired(spark, d), "audit_id", "left_anti").select("audit_id", "position", "status")


@query(f"WITH {AUDITS}, {AUDIT_IMAGES}, {_EXPIRED}, i AS (SELECT * FROM audit_images WHERE audit_id IN (FROM x)) SELECT 'upload/' || cache_key AS path FROM i UNION SELECT 'artifact/' || result FROM i")
def paths_to_delete(spark, d):
    """The files of expired audits, each once."""
    gone = V.audit_images(spark, d).join(_expired(spark, d), "audit_id", "left_semi")
    return gone.select(F.concat(F.lit("upload/"), F.col("cache_key").cast("string")).alias("path")).union(gone.select(F.concat(F.lit("artifact/"), F.col("result").cast("string")))).distinct()


@query(f"WITH {AUDITS} SELECT audit_id, created_at FROM audits WHERE status = 'queued' ORDER BY created_at, audit_id LIMIT 1")
def next_claim(spark, d):
    """The audit that a worker takes next: the oldest that waits."""
    return V.audits(spark, d).where("status = 'queued'").orderBy("created_at", "audit_id").limit(1).select("audit_id", F.col("created_at").cast(dict(table(spark, d, "orders").dtypes)["o_orderdate"]).alias("created_at"))


@query(f"WITH {AUDIT_IMAGES}, e AS (SELECT audit_id, position, completed_at, result, l_linestatus = 'F' AS held FROM audit_images WHERE status <> 'failed') SELECT audit_id, position, min(completed_at) AS completed_at, count(*) AS attempts FROM e WHERE held GROUP BY audit_id, position")
def completed_once(spark, d):
    """The first accepted completion of each image; later ones and those without the lease don't count."""
    e = V.audit_images(spark, d).where("status <> 'failed' AND l_linestatus = 'F'")
    kind = dict(table(spark, d, "lineitem").dtypes)["l_shipdate"]
    return e.groupBy("audit_id", "position").agg(F.min("completed_at").cast(kind).alias("completed_at"), F.count(F.lit(1)).alias("attempts"))
