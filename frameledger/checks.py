"""Further queries: hashes and geometry, calibration by class, guards before a comparison, study and job checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _RAW, COPIES_SQL, SOFT, _hashed, _soft, query, r6
from .functions import scalars as S
from .operators import duplicates, jobs, metrics, review, statistics
from .operators.resampling import draws_sql
from .plans import views as V
from .plans.views import AUDIT_IMAGES, AUDITS, FEEDBACK, PX, TRIALS, table
from .schemas import CLASSES, TARGETS
from .streaming import jobs as streams

# hashes, pairs, geometry


@query(
    "WITH px AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), k AS (SELECT unnest(range(8)) AS k),"
    " r AS (SELECT vec_id, i // 8 AS y, k AS u, sum(v * cos(pi() * (2 * (i % 8) + 1) * k / 16) * sqrt(CASE k WHEN 0 THEN 1 ELSE 2 END / 8::DOUBLE)) AS s FROM px, k GROUP BY ALL),"
    " c AS (SELECT vec_id, u, k AS w, sum(s * cos(pi() * (2 * y + 1) * k / 16) * sqrt(CASE k WHEN 0 THEN 1 ELSE 2 END / 8::DOUBLE)) AS c FROM r, k GROUP BY ALL),"
    " m AS (SELECT vec_id, median(c) FILTER (u + w > 0) AS m FROM c GROUP BY vec_id) SELECT vec_id AS image_id, string_agg((c > m)::INT::VARCHAR, '' ORDER BY w, u) AS bits FROM c JOIN m USING (vec_id) GROUP BY vec_id"
)
def cosine_hash_bits(spark, d):
    """The cosine hash of every grey image."""
    return V.grey_images(spark, d).select("image_id", S.cosine_bits(F.col("pixels"), 8).alias("bits"))


@query(
    f"WITH {COPIES_SQL}, x AS (SELECT vec_id AS image_id, sha256(array_to_string(list_transform(embedding, lambda v: (v > 0)::INT), '')) AS sha FROM copies),"
    " near AS (SELECT a.image_id AS id_a, b.image_id AS id_b FROM h a JOIN h b ON a.image_id < b.image_id WHERE bit_count(xor(a.dhash, b.dhash)) <= 6),"
    " o AS (SELECT image_id AS id_b, min(image_id) OVER (PARTITION BY sha) AS id_a FROM x QUALIFY id_a <> id_b), same AS (SELECT id_a, id_b FROM o),"
    " u AS (SELECT * FROM near UNION SELECT * FROM same) SELECT id_a, id_b, p.sha = q.sha AS exact FROM u JOIN x p ON p.image_id = id_a JOIN x q ON q.image_id = id_b"
)
def duplicate_candidates(spark, d):
    """Pairs of near hashes and of equal content in one list, each once; equal ones are paired with their first, not expanded."""
    images = V.images_with_copies(spark, d)
    near = duplicates.hamming_pairs(_hashed(images), "image_id", "dhash", 6, 56).select("id_a", "id_b")
    signs = F.array_join(F.transform("pixels", lambda v: F.when(v > 0, "1").otherwise("0")), "")
    content = images.select("image_id", F.sha2(signs.cast("binary"), 256).alias("sha"))
    pairs = near.union(duplicates.pairs_to_first(content, ["sha"], "image_id")).distinct()
    a, b = (content.select(F.col("image_id").alias(f"id_{s}"), F.col("sha").alias(f"sha_{s}")) for s in "ab")
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", (F.col("sha_a") == F.col("sha_b")).alias("exact"))


@query(
    "WITH p AS (SELECT p_partkey, floor(p_retailprice)::BIGINT AS w, (p_size * 20 + 1)::BIGINT AS h FROM part), s AS (SELECT *, 640::DOUBLE / greatest(w, h) AS s FROM p),"
    " r AS (SELECT p_partkey, greatest(1, round_even(w * s, 0))::BIGINT AS width, greatest(1, round_even(h * s, 0))::BIGINT AS height FROM s)"
    " SELECT p_partkey, width, height, (ceil(width / 32::DOUBLE) * 32)::BIGINT AS padded_width, (ceil(height / 32::DOUBLE) * 32)::BIGINT AS padded_height FROM r"
)
def resize_geometry(spark, d):
    """Sizes after scaling the long side to 640 and padding to a multiple of 32."""
    w, h = S.resized(F.floor("p_retailprice").cast("long"), (F.col("p_size") * 20 + 1).cast("long"), 640)
    rows = table(spark, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))
    return rows.select("*", S.padded(F.col("width"), 32).cast("long").alias("padded_width"), S.padded(F.col("height"), 32).cast("long").alias("padded_height"))


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id, round(CASE WHEN event_id < 100 THEN (event_id + 1) / 100::DOUBLE ELSE (cos(least(1, (event_id - 100) / greatest(1, n - 100)::DOUBLE) * pi()) + 1) / 2 END, 6) AS factor FROM events, n")
def rate_schedule(spark, d):
    """The learning-rate factor of every step, a step an event."""
    e = table(spark, d, "events").select("event_id")
    total = e.agg(F.count(F.lit(1)).alias("n"))  # one row
    return e.crossJoin(F.broadcast(total)).select("event_id", F.round(S.rate_factor(F.col("event_id"), F.col("n"), 100), 6).alias("factor"))


@query("SELECT page_id, array_to_string(string_split(url, '/')[-2:], '/') AS short FROM pages")
def short_paths(spark, d):
    return table(spark, d, "pages").select("page_id", S.last_parts(F.col("url")).alias("short"))


@query(
    f"WITH {PX}, g AS (SELECT image_id, t, event_id, md5('c:' || image_id || ':' || t) AS a, md5('p:' || event_id) AS b FROM px WHERE t BETWEEN 1 AND 4) SELECT image_id, min_by(t, (a, b, event_id)) AS material, min_by(event_id, (a, b, event_id)) AS event_id FROM g GROUP BY image_id"
)
def crop_origins(spark, d):
    """Of each image a uniform material that it shows, and of this a uniform pixel, by hash order in one aggregation."""
    px = V.pixels(spark, d).where(F.col("t").isin(*TARGETS))
    a = F.md5(F.concat_ws(":", F.lit("c"), "image_id", "t").cast("binary"))
    order = F.struct(a, F.md5(F.concat_ws(":", F.lit("p"), "event_id").cast("binary")), "event_id")
    return px.groupBy("image_id").agg(F.min_by(F.struct("t", "event_id"), order).alias("s")).select("image_id", F.col("s.t").alias("material"), "s.event_id")


GREY = "g AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + v::DOUBLE * 500)))::BIGINT) AS e FROM embeddings)"
_INSIDE = "[" + ", ".join(str(r * 8 + c + 1) for r in range(1, 7) for c in range(1, 7)) + "]"


@query(
    f"WITH {GREY}, l AS (SELECT image_id, e, list_transform({_INSIDE}, lambda i: e[i - 1] + e[i + 1] + e[i - 8] + e[i + 8] - 4 * e[i]) AS b FROM g),"
    " q AS (SELECT image_id, list_sum(list_transform(b, lambda x: x * x)) / 36::DOUBLE - (list_sum(b) / 36::DOUBLE) ** 2 AS sharpness, list_sum(e) / 64::DOUBLE AS brightness, len(list_filter(e, lambda x: x <= 2 OR x >= 253)) / 64::DOUBLE AS clipped FROM l)"
    " SELECT image_id, round(sharpness, 3) AS sharpness, round(brightness, 3) AS brightness, round(clipped, 6) AS clipped, array_to_string(list_filter([CASE WHEN sharpness < 20 THEN 'blurred' END, CASE WHEN brightness < 25 THEN 'underexposed' END, CASE WHEN brightness > 235 THEN 'overexposed' END, CASE WHEN clipped > 0.25 THEN 'clipped_exposure' END], lambda x: x IS NOT NULL), ';') AS issues FROM q"
)
def quality_statistics(spark, d):
    """Sharpness, brightness and clipping of every image, and the issues that they mean for it."""
    grey = F.transform("pixels", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 500 + 128))))
    images = V.grey_images(spark, d).select("image_id", grey.alias("grey"))
    rows = images.select("image_id", *[c.alias(n) for n, c in S.image_quality(F.col("grey"), 8, 8).items()])
    return rows.select("image_id", F.round("sharpness", 3).alias("sharpness"), F.round("brightness", 3).alias("brightness"), F.round("clipped", 6).alias("clipped"), F.array_join(review.quality_issues(), ";").alias("issues"))


# calibration by class


def _class_temperature_sql() -> str:
    parts = ["pz AS (SELECT list_position(z, list_max(z)) - 1 AS k, z, truth FROM v)", "b0 AS (SELECT DISTINCT k, ln(0.05::DOUBLE) AS lo, ln(20::DOUBLE) AS hi FROM pz)"]
    for n in range(3):
        parts.append(f"g{n} AS (SELECT k, i, lo, hi, lo + (hi - lo) * i / 23::DOUBLE AS s FROM b{n}, (SELECT unnest(range(24)) AS i))")
        parts.append(f"l{n} AS (SELECT k, i, lo, hi, s, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / exp(s))))) - (z[truth + 1] - list_max(z)) / exp(s)) AS loss FROM g{n} JOIN pz USING (k) GROUP BY ALL)")
        parts.append(f"b{n + 1} AS (SELECT k, lo + (hi - lo) * greatest(0, i - 1) / 23::DOUBLE AS lo, lo + (hi - lo) * least(23, i + 1) / 23::DOUBLE AS hi, s FROM l{n} QUALIFY row_number() OVER (PARTITION BY k ORDER BY loss, i) = 1)")
    return f"WITH {SOFT}, {', '.join(parts)} SELECT c AS cls, coalesce(round(exp(s), 4), 1) AS temperature FROM (SELECT unnest(range(5)) AS c) LEFT JOIN b3 ON k = c"


@query(_class_temperature_sql())
def class_temperatures(spark, d):
    """A temperature for each predicted class, over all vectors."""
    found = statistics.class_temperatures(_soft(spark, d).withColumn("k", S.argmax(F.col("z"))), "z", "truth", "k", len(CLASSES))
    return spark.range(len(CLASSES)).select(F.col("id").alias("cls"), F.get(F.array(*[F.lit(t) for t in found]), F.col("id").cast("int")).alias("temperature"))


# guards and differences


@query(
    f"WITH {PX}, a AS (SELECT DISTINCT image_id FROM px WHERE t <> 255), b AS (SELECT DISTINCT image_id FROM px WHERE p > 0),"
    " n AS (SELECT count(a.image_id) AS n_a, count(b.image_id) AS n_b, count_if(b.image_id IS NULL) AS only_a, count_if(a.image_id IS NULL) AS only_b FROM a FULL JOIN b USING (image_id)) SELECT *, only_a + only_b = 0 AS comparable FROM n"
)
def comparison_guard(spark, d):
    """Two reports can be compared image by image only if they are of the same images."""
    px = V.pixels(spark, d)
    return metrics.same_ids(px.where("t <> 255"), px.where("p > 0"), "image_id")


@query(
    f"WITH {PX}, m AS (SELECT unnest(range(5)) AS cls), o AS (SELECT p AS cls, count_if(t = p) / count(*)::DOUBLE AS v FROM px WHERE t <> 255 GROUP BY p), q AS (SELECT p AS cls, count_if(t = p) / count(*)::DOUBLE AS v FROM px WHERE t <> 255 AND value < 100 GROUP BY p)"
    " SELECT cls, round(o.v, 6) AS observed, round(q.v, 6) AS declared FROM o FULL JOIN q USING (cls) WHERE o.v IS NULL OR q.v IS NULL OR abs(o.v - q.v) > 1e-5"
)
def declared_differences(spark, d):
    """Fields in which what is observed isn't what was declared, or that one side lacks."""
    px = V.pixels(spark, d).where("t <> 255").withColumn("right", (F.col("t") == F.col("p")).cast("double"))
    observed, declared = (rows.groupBy(F.col("p").alias("cls")).agg(F.avg("right").alias("v")) for rows in (px, px.where("value < 100")))
    return r6(metrics.differing_fields(observed, declared, "cls", "v", 1e-5), "observed", "declared")


@query(
    f"WITH {AUDITS}, {AUDIT_IMAGES}, a AS (SELECT audit_id, list_sort(list(DISTINCT position)) AS images FROM audit_images WHERE status <> 'failed' GROUP BY 1), b AS (SELECT audit_id, list_sort(list(DISTINCT position)) AS images FROM audit_images WHERE status = 'complete' GROUP BY 1)"
    " SELECT audit_id, CASE WHEN b.audit_id IS NULL THEN 'not_replayed' WHEN a.images <> b.images THEN 'other_images' ELSE 'same' END AS state FROM a LEFT JOIN b USING (audit_id)"
)
def replay_check(spark, d):
    """Recorded audits against replayed ones: present, and of the same images."""
    i = V.audit_images(spark, d)

    def sets(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("audit_id").agg(F.array_sort(F.collect_set("position")).alias(name))  # a few images an audit

    joined = sets(i.where("status <> 'failed'"), "a").join(sets(i.where("status = 'complete'"), "b"), "audit_id", "left")
    return joined.select("audit_id", F.when(F.col("b").isNull(), "not_replayed").when(F.col("a") != F.col("b"), "other_images").otherwise("same").alias("state"))


@query(
    "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.text IS NULL THEN 'empty' WHEN length(d.text) <> n_chars THEN 'changed' ELSE 'same' END AS state FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)"
)
def selection_integrity(spark, d):
    """Of each selected document whether it is there and what the manifest says."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(True).alias("here"), F.length("text").alias("n"), "n_chars")
    state = F.when(F.col("here").isNull(), "missing").when(F.col("n").isNull(), "empty").when(F.col("n") != F.col("n_chars"), "changed").otherwise("same")
    return table(spark, d, "labels").select("doc_id").distinct().join(docs, "doc_id", "left").select("doc_id", state.alias("state"))


@query(
    "SELECT page_id, CASE WHEN html IS NULL THEN 'empty' WHEN NOT starts_with(ltrim(html), '<') THEN 'format' WHEN length(html) > 20000 THEN 'too_large' WHEN length(html) < 500 THEN 'too_small' WHEN url IS NULL THEN 'no_name' ELSE 'ok' END AS code FROM pages"
)
def upload_codes(spark, d):
    """The first reason to reject an upload, in a fixed order."""
    n = F.length("html")
    code = F.when(F.col("html").isNull(), "empty").when(~F.startswith(F.ltrim("html"), F.lit("<")), "format").when(n > 20000, "too_large").when(n < 500, "too_small").when(F.col("url").isNull(), "no_name").otherwise("ok")
    return table(spark, d, "pages").select("page_id", code.alias("code"))


@query(
    f"WITH {AUDIT_IMAGES}, {FEEDBACK}, s AS (SELECT audit_id AS image_id, bool_and(status = 'complete') AS done FROM audit_images GROUP BY 1) SELECT f.image_id, feedback_id, CASE WHEN done IS NULL THEN 'no_image' WHEN NOT done THEN 'not_complete' WHEN note_chars > 200 THEN 'note_too_long' ELSE 'ok' END AS state FROM feedback f LEFT JOIN s USING (image_id)"
)
def feedback_checks(spark, d):
    """Whether each feedback may be taken: its image exists and is complete, and its note has a bounded length."""
    done = V.audit_images(spark, d).groupBy(F.col("audit_id").alias("image_id")).agg(F.bool_and(F.col("status") == "complete").alias("done"))
    state = F.when(F.col("done").isNull(), "no_image").when(~F.col("done"), "not_complete").when(F.col("note_chars") > 200, "note_too_long").otherwise("ok")
    return V.feedback(spark, d).join(done, "image_id", "left").select("image_id", "feedback_id", state.alias("state"))


@query(
    "WITH r AS (SELECT o_orderstatus NOT IN ('O', 'P', 'F') AS a, o_totalprice < 0 AS b, o_orderdate IS NULL AS c FROM orders) SELECT 'status_domain' AS rule, count_if(a) AS n FROM r UNION ALL SELECT 'negative_amount', count_if(b) FROM r UNION ALL SELECT 'no_date', count_if(c) FROM r"
)
def constraint_violations(spark, d):
    """Rows that break a rule of the table, by rule, in one pass."""
    rules = {"status_domain": ~F.col("o_orderstatus").isin("O", "P", "F"), "negative_amount": F.col("o_totalprice") < 0, "no_date": F.col("o_orderdate").isNull()}
    return jobs.violations(table(spark, d, "orders"), rules)


def _names(spark, d) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").cast("long").alias("k"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT user_id FROM events")
def common_names(spark, d):
    """Names that both lists have, once each."""
    a, b = _names(spark, d)
    return a.intersect(b)


@query("SELECT 'missing' AS side, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'unexpected', user_id FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer)")
def name_differences(spark, d):
    """What either list has and the other hasn't."""
    a, b = _names(spark, d)
    return a.subtract(b).select(F.lit("missing").alias("side"), "k").union(b.subtract(a).select(F.lit("unexpected").alias("side"), "k"))


# study


@query(
    f"WITH {PX}, c AS ({_RAW.format(c='p')}) SELECT image_id, total_target > 0.05 AS follow_up, array_to_string(list_sort(list_filter(["
    + ", ".join(f"CASE WHEN cov_{CLASSES[k]} >= 0.01 THEN '{CLASSES[k]}' END" for k in TARGETS)
    + "], lambda m: m IS NOT NULL)), ',') AS materials FROM c"
)
def suggestions(spark, d):
    """What a result suggests: a follow-up over 5 % of targets, and the materials that take 1 % or more, sorted."""
    present = S.compact(*[(F.col(f"cov_{CLASSES[k]}") >= 0.01, CLASSES[k]) for k in TARGETS])
    rows = metrics.coverage(V.pixels(spark, d), ["image_id"])
    return rows.select("image_id", metrics.audit_positive(F.col("total_target")).alias("follow_up"), F.array_join(F.array_sort(present), ",").alias("materials"))


BOOT_TRIALS = f"""{TRIALS}, gs AS (SELECT participant, sum(CASE condition WHEN 'assisted' THEN round(seconds * 100)::BIGINT ELSE 0 END) AS s1, count_if(condition = 'assisted') AS n1, sum(CASE condition WHEN 'unaided' THEN round(seconds * 100)::BIGINT ELSE 0 END) AS s0, count_if(condition = 'unaided') AS n0,
 count_if(positive AND follow_up) AS hits, count_if(positive) AS positives FROM trials GROUP BY participant), g AS (SELECT *, row_number() OVER (ORDER BY participant) - 1 AS g FROM gs),
{draws_sql()},
 vals AS (SELECT r, sum(s1) / nullif(sum(n1), 0)::DOUBLE - sum(s0) / nullif(sum(n0), 0)::DOUBLE AS seconds, sum(hits) / nullif(sum(positives), 0)::DOUBLE AS recall FROM draws JOIN g USING (g) GROUP BY r)"""


@query(
    f"WITH {BOOT_TRIALS} SELECT 'seconds' AS statistic, round(quantile_cont(seconds, 0.025) / 100, 6) AS low, round(quantile_cont(seconds, 0.975) / 100, 6) AS high, (SELECT k FROM k) AS n_groups FROM vals UNION ALL SELECT 'recall', round(quantile_cont(recall, 0.025), 6), round(quantile_cont(recall, 0.975), 6), (SELECT k FROM k) FROM vals"
)
def participant_bootstrap(spark, d):
    """Intervals of the seconds that help saves and of the recall, under resampling of whole participants."""
    cents = F.round(F.col("seconds") * 100).cast("long")
    helped = F.col("condition") == "assisted"
    sums = V.trials(spark, d).groupBy("participant").agg(
        F.sum(F.when(helped, cents).otherwise(0)).alias("s1"), F.count_if(helped).alias("n1"), F.sum(F.when(~helped, cents).otherwise(0)).alias("s0"), F.count_if(~helped).alias("n0"),
        F.count_if(F.col("positive") & F.col("follow_up")).alias("hits"), F.count_if("positive").alias("positives"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.sum(a).cast("double"), F.sum(b))

    parts = {"seconds": ratio("s1", "n1") - ratio("s0", "n0"), "recall": ratio("hits", "positives")}
    takes = {name: lambda rows, by, value=value: rows.groupBy(*by).agg(value.alias("value")) for name, value in parts.items()}
    found = statistics.intervals(sums, "participant", takes, summed=["s1", "n1", "s0", "n0", "hits", "positives"])
    scale = F.when(F.col("statistic") == "seconds", 100).otherwise(1)
    return found.select("statistic", F.round(F.col("low") / scale, 6).alias("low"), F.round(F.col("high") / scale, 6).alias("high"), "n_groups")


@query(
    f"WITH {AUDIT_IMAGES} SELECT audit_id, position, row_number() OVER (PARTITION BY audit_id ORDER BY status = 'pending' DESC, priority DESC, position, cache_key, result) AS place FROM audit_images"
)
def assisted_order(spark, d):
    """An audit's images as an assisted user sees them: those in the queue first, then the rest, each by priority."""
    rows = V.audit_images(spark, d)
    return jobs.placed(rows, ["audit_id"], [(F.col("status") == "pending").desc(), F.col("priority").desc(), F.col("position"), F.col("cache_key"), F.col("result")]).select("audit_id", "position", "place")


# jobs


@query("WITH l AS (SELECT user_id AS worker, max(ts) AS seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS n_workers, count_if(seen >= now - INTERVAL 6 HOUR) AS n_live, count_if(seen >= now - INTERVAL 6 HOUR) > 0 AS ready FROM l, n")
def readiness(spark, d):
    """One row: whether some worker's last heartbeat is recent."""
    e = table(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    last = e.groupBy("worker").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    live = F.count_if(F.col("seen") >= F.col("now") - F.expr("INTERVAL 6 HOURS"))
    return last.agg(F.count(F.lit(1)).alias("n_workers"), live.alias("n_live"), (live > 0).alias("ready"))


@query(f"WITH {AUDITS}, {AUDIT_IMAGES}, q AS (SELECT DISTINCT audit_id FROM audits WHERE status = 'queued') SELECT audit_id, position, audit_id IN (FROM q) AS in_queue FROM audit_images")
def review_screen(spark, d):
    """Every image with whether its audit is in the queue."""
    queue = V.audits(spark, d).where("status = 'queued'").select("audit_id").distinct().withColumn("here", F.lit(True))
    return V.audit_images(spark, d).join(queue, "audit_id", "left").select("audit_id", "position", F.col("here").isNotNull().alias("in_queue"))


@query("SELECT l_linestatus AS route, l_returnflag AS status, count(*) AS n, count_if(l_quantity <= 5) AS le_5, count_if(l_quantity <= 20) AS le_20, count_if(l_quantity <= 50) AS le_50 FROM lineitem GROUP BY ALL")
def route_counters(spark, d):
    """Requests by route and status with cumulative buckets of their time."""
    buckets = [F.count_if(F.col("l_quantity") <= b).alias(f"le_{b}") for b in (5, 20, 50)]
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("route"), F.col("l_returnflag").alias("status")).agg(F.count(F.lit(1)).alias("n"), *buckets)


LEASE_MS, LEASE_ATTEMPTS = 6 * 3_600_000, 3
_OPEN = "(w.status = 'queued' OR (w.status = 'running' AND w.until < e.moment))"
_HELD = "(w.status = 'running' AND w.owner = e.worker AND w.until >= e.moment)"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS audit_id, epoch_ms(ts) AS moment, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'release' ELSE 'claim' END AS kind, 'w' || event_id % 3 AS worker, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT DISTINCT audit_id, 0::BIGINT AS n, 'queued' AS status, 0 AS attempts, NULL::VARCHAR AS owner, -1::BIGINT AS until FROM e
  UNION ALL SELECT e.audit_id, e.n,
    CASE WHEN kind = 'claim' AND {_OPEN} THEN CASE WHEN attempts >= {LEASE_ATTEMPTS} THEN 'failed' ELSE 'running' END WHEN kind = 'finish' AND {_HELD} THEN 'complete' WHEN kind = 'release' AND {_HELD} THEN 'queued' ELSE w.status END,
    CASE WHEN kind = 'claim' AND {_OPEN} AND attempts < {LEASE_ATTEMPTS} THEN attempts + 1 ELSE attempts END,
    CASE WHEN kind = 'claim' AND {_OPEN} THEN CASE WHEN attempts >= {LEASE_ATTEMPTS} THEN NULL ELSE e.worker END WHEN kind IN ('finish', 'release') AND {_HELD} THEN NULL ELSE w.owner END,
    CASE WHEN kind = 'claim' AND {_OPEN} THEN CASE WHEN attempts >= {LEASE_ATTEMPTS} THEN -1 ELSE e.moment + {LEASE_MS} END WHEN kind IN ('finish', 'release') AND {_HELD} THEN -1 ELSE w.until END
  FROM w JOIN e ON e.audit_id = w.audit_id AND e.n = w.n + 1),
l AS (SELECT audit_id, max_by({{'s': status, 'a': attempts, 'o': owner, 'u': until}}, n) AS x FROM w GROUP BY audit_id), m AS (SELECT max(moment) AS now FROM e), z AS (SELECT audit_id, x, x.s = 'running' AND x.u < now AS over FROM l, m)
SELECT audit_id, CASE WHEN over THEN 'queued' ELSE x.s END AS status, x.a AS attempts, CASE WHEN over THEN NULL ELSE x.o END AS owner FROM z"""
)
def stream_leases(spark, d):
    """The lease of each audit (one a user) after all events, kept as a stream's state; timers end what nobody finished."""
    e = streams.read_events(spark, f"{d}/event*.parquet")
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "release").otherwise("claim")
    worker = F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string"))
    events = e.select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("seq"), "at", worker.alias("worker"), kind.alias("kind"))
    return streams.drain_latest(streams.lease_states(events, LEASE_MS, LEASE_ATTEMPTS), ["audit_id"])
