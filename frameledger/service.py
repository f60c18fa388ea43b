"""Queries of cache keys, flattened records, feedback batches and audit states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SOFT, _soft, query
from .operators import canonical, guards, jobs
from .plans import views as V
from .plans.views import FEEDBACK, table
from .streaming import audits
from .streaming import jobs as streams

# canonical keys

_K = "round_even({x} * 1000000, 0)::BIGINT"


def _short_sql(x: str) -> str:
    k = _K.format(x=x)
    small = f"substr({k}::VARCHAR, 1, 1) || CASE WHEN {k} >= 10 AND {k} % 10 <> 0 THEN '.' || substr({k}::VARCHAR, 2, 1) ELSE '' END || CASE WHEN {k} < 10 THEN 'e-06' ELSE 'e-05' END"
    return f"CASE WHEN {k} > 0 AND {k} < 100 THEN {small} ELSE regexp_replace(({k} // 1000000)::VARCHAR || '.' || lpad(({k} % 1000000)::VARCHAR, 6, '0'), '(\\.\\d+?)0+$', '\\1') END"


@query(
    "WITH r AS (SELECT l_partkey, l_suppkey, (l_orderkey % 1000003) / 1000003::DOUBLE AS x, (l_linenumber * l_linenumber) / 1000000::DOUBLE AS y FROM lineitem),"
    f" t AS (SELECT '{{\"image\": \"' || sha256(l_partkey::VARCHAR) || '\", \"model\": \"m-' || l_suppkey % 3 || '\", \"policy\": \"p\", \"preprocessing\": \"1\", \"region\": [[0.0, 0.0], [' || {_short_sql('x')} || ', ' || {_short_sql('y')} || '], [1.0, 1.0]]}}' AS text FROM r)"
    " SELECT sha256(text) AS cache_key, count(*) AS n FROM t GROUP BY 1"
)
def cache_keys(spark, d):
    """Images by the key of their result: digest, region to six places and versions."""
    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    region = F.array(point(F.lit(0), F.lit(0)), point((F.col("l_orderkey") % 1000003) / F.lit(1000003.0), F.col("l_linenumber") * F.col("l_linenumber") / F.lit(1000000.0)), point(F.lit(1), F.lit(1)))
    key = canonical.cache_key(F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256), region, F.lit("1"), F.concat(F.lit("m-"), (F.col("l_suppkey") % 3).cast("string")), F.lit("p"))
    return table(spark, d, "lineitem").select(key.alias("cache_key")).groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))


_RUN_SQL = """j AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0
  THEN '{"model": {"name": "' || o_orderstatus || '", "sizes": [' || o_custkey || ', null, ' || o_custkey % 7 || ']}, "seed": ' || o_custkey % 5 || ', "notes": {}, "tuned": true}'
  ELSE '{"tuned": true, "notes": {}, "seed": ' || o_custkey % 5 || ', "model": {"sizes": [' || o_custkey || ', null, ' || o_custkey % 7 || '], "name": "' || o_orderstatus || '"}}' END AS doc FROM orders),
leaf AS (SELECT run_id, replace(replace(replace(substr(fullkey, 3), '[', '.'), ']', ''), '"', '') AS key, CASE WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') ELSE atom::VARCHAR END AS value FROM j, json_tree(doc) WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL'))"""


def _runs(spark, d):
    """A run's nested parameters as JSON; those of odd runs name their keys in another order."""
    key, status, cust = (F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_custkey"))
    seed, size = (F.col("o_custkey") % 5).cast("string"), (F.col("o_custkey") % 7).cast("string")
    even = F.concat(F.lit('{"model": {"name": "'), status, F.lit('", "sizes": ['), cust, F.lit(", null, "), size, F.lit(']}, "seed": '), seed, F.lit(', "notes": {}, "tuned": true}'))
    odd = F.concat(F.lit('{"tuned": true, "notes": {}, "seed": '), seed, F.lit(', "model": {"sizes": ['), cust, F.lit(", null, "), size, F.lit('], "name": "'), status, F.lit('"}}'))
    doc = F.when(F.col("o_orderkey") % 2 == 0, even).otherwise(odd)
    return canonical.flattened(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.parse_json(doc).alias("doc")), "run_id", "doc")


@query(f"WITH {_RUN_SQL} SELECT run_id, key, value FROM leaf")
def flattened_parameters(spark, d):
    """Every parameter of every run by its dotted key."""
    return _runs(spark, d)


@query(f"WITH {_RUN_SQL}, g AS (SELECT run_id, count(*) AS n_leaves, sha256(string_agg(key || '=' || value, chr(10) ORDER BY key)) AS digest FROM leaf GROUP BY run_id) SELECT digest, n_leaves, count(*) AS n_runs FROM g GROUP BY ALL")
def equal_runs(spark, d):
    """Runs of equal parameters, whatever the order in which they were named."""
    found = canonical.record_digest(_runs(spark, d), "run_id")
    return found.groupBy("digest", "n_leaves").agg(F.count(F.lit(1)).alias("n_runs"))


# guards

_NAMES = {"view": "Background", "click": " Cardboard", "signup": "soft  plastic", "purchase": "Rigid-Plastic", "error": "METAL "}


@query("SELECT CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END::INT AS cls, event_type AS source_id, count(*) AS n FROM events GROUP BY ALL")
def remap_by_name(spark, d):
    """Annotations by class, their source categories mapped by normalized names; refusals come before any is counted."""
    e = table(spark, d, "events")
    names = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _NAMES.items()])
    mapping = guards.name_remap(e.select(F.col("event_type").alias("id"), names.alias("name")).distinct())
    return e.join(mapping, F.col("event_type") == F.col("source_id")).groupBy("cls", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SOFT} SELECT vec_id, round(list_max(list_transform(p, lambda x: abs(x - x::FLOAT::DOUBLE))), 10) AS largest FROM soft")
def runtime_parity(spark, d):
    """Probabilities of a double and a single precision runtime: the largest difference of each image, within the tolerance throughout."""
    whole = _soft(spark, d).select("vec_id", "p")
    found = guards.parity(whole, whole.select("vec_id", F.transform("p", lambda x: x.cast("float")).alias("p")), "vec_id")
    guards.check_parity(found)
    return found.select("vec_id", F.round("largest", 10).alias("largest"))


# feedback batch

_BATCH_SQL = f"""{FEEDBACK}, h AS (SELECT image_id, count(*) AS n_feedback, string_agg(decision, '>' ORDER BY feedback_id, decision) AS history, max_by(decision, feedback_id) AS decision FROM feedback GROUP BY image_id),
c AS (SELECT image_id, image_id // 3 AS audit_id, n_feedback, history, decision, CASE WHEN decision = 'needs_retake' THEN 'retake' WHEN decision = 'corrected' AND image_id % 2 = 0 THEN 'pixel_mask' ELSE 'image_level' END AS label_kind,
  CASE WHEN image_id % 11 = 3 THEN 'upload no longer in app storage' WHEN image_id % 13 = 1 THEN 'upload does not match its SHA-256' WHEN decision = 'corrected' AND image_id % 2 = 0 AND image_id % 6 = 2 THEN 'corrected mask contains unknown class IDs' END AS reason
  FROM h WHERE image_id % 5 <> 0 AND image_id % 7 <> 4)"""


def _batch(spark, d):
    f = V.feedback(spark, d)
    image = F.col("image_id")
    images = f.select("image_id").distinct().select(
        "image_id", F.floor(image / 3).alias("audit_id"), (image % 5 != 0).alias("consent"), F.when(image % 7 == 4, "failed").otherwise("complete").alias("status"), (image % 11 != 3).alias("stored"),
        (image % 13 != 1).alias("digest_holds"), (image % 2 == 0).alias("has_mask"), F.when(image % 6 == 2, "corrected mask contains unknown class IDs").alias("mask_problem"),
    )
    return jobs.feedback_batch(images, f.select("image_id", "feedback_id", "decision"))


@query(f"WITH {_BATCH_SQL} SELECT image_id, audit_id, label_kind, n_feedback, history, 'pending_annotation_review' AS status FROM c WHERE reason IS NULL")
def feedback_candidates(spark, d):
    """The batch of consented, complete and reviewed images, with their whole history and the kind of label that the last feedback gives."""
    return _batch(spark, d).where("reason IS NULL").select("image_id", "audit_id", "label_kind", "n_feedback", "history", F.lit("pending_annotation_review").alias("status"))


@query(f"WITH {_BATCH_SQL} SELECT CASE WHEN reason IS NULL THEN 'candidate' ELSE 'skipped' END AS part, coalesce(reason, label_kind) AS name, count(*) AS n FROM c GROUP BY ALL")
def feedback_batch_record(spark, d):
    """The batch's record: candidates by kind of label and what was skipped by its reason."""
    rows = _batch(spark, d).select(F.when(F.col("reason").isNull(), "candidate").otherwise("skipped").alias("part"), F.coalesce("reason", "label_kind").alias("name"))
    return rows.groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))


# audits as a stream

LIMITS = audits.Limits(lease=40_000_000, deadline=150_000_000, retention=500_000_000, attempts=3, images=3)
_FRESH = "{'status': 'queued', 'attempts': 0, 'owner': NULL::VARCHAR, 'until': -1::BIGINT, 'deadline': -1::BIGINT, 'completed': -1::BIGINT, 'error': NULL::VARCHAR, 'deleted': %s, 'images': ['pending', 'pending', 'pending'], 'at': 0::BIGINT, 'kind': '', 'worker': '', 'position': 0}"


def _audit(s: str, **changed: str) -> str:
    """An SQL struct of an audit: that of ``s`` but for what changes."""
    names = "status attempts owner until deadline completed error deleted images at kind worker position".split()
    return "{" + ", ".join(f"'{n}': {changed.get(n, f'{s}.{n}')}" for n in names) + "}"


def _closed(s: str, at: str, error: str | None) -> str:
    images = f"list_transform({s}.images, lambda y: CASE WHEN y = 'pending' THEN '{error}' ELSE y END)" if error else f"{s}.images"
    done = f"len(list_filter({s}.images, lambda y: y = 'complete'))"
    status = f"CASE WHEN {done} = 3 THEN 'complete' WHEN {done} > 0 THEN 'partial' ELSE 'failed' END"
    return _audit(s, status=status, images=images, error=f"'{error}'" if error else "NULL::VARCHAR", completed=at, owner="NULL::VARCHAR", until="-1::BIGINT", deadline="-1::BIGINT")


def _passed(s: str, now: str) -> str:
    """``s`` after what time alone does before ``now``."""
    first = f"CASE WHEN {s}.status = 'running' AND {s}.deadline <= {s}.until AND {s}.deadline < {now} THEN {_closed(s, f'{s}.deadline', audits.DEADLINE)} WHEN {s}.status = 'running' AND {s}.until < {now} THEN {_audit(s, status=chr(39) + 'queued' + chr(39), owner='NULL::VARCHAR', until='-1::BIGINT', deadline='-1::BIGINT')} ELSE {s} END"
    return f"list_transform([{first}], lambda z: CASE WHEN z.status NOT IN ('queued', 'running') AND z.completed + {LIMITS.retention} < {now} THEN {_FRESH % 'z.deleted + 1'} ELSE z END)[1]"


def _happened(s: str, e: str) -> str:
    held = f"{s}.status = 'running' AND {s}.owner = {e}.worker"
    image = f"list_transform({s}.images, lambda y, i: CASE WHEN i = {e}.position + 1 AND y = 'pending' THEN CASE {e}.kind WHEN 'done' THEN 'complete' ELSE '{audits.UNREADABLE}' END ELSE y END)"
    return (
        f"CASE WHEN {e}.kind = 'claim' AND {s}.status = 'queued' AND {s}.attempts >= {LIMITS.attempts} THEN {_closed(s, f'{e}.at', audits.EXHAUSTED)}"
        f" WHEN {e}.kind = 'claim' AND {s}.status = 'queued' THEN {_audit(s, status=chr(39) + 'running' + chr(39), attempts=f'{s}.attempts + 1', owner=f'{e}.worker', until=f'{e}.at + {LIMITS.lease}', deadline=f'{e}.at + {LIMITS.deadline}')}"
        f" WHEN {e}.kind = 'extend' AND {held} THEN {_audit(s, until=f'{e}.at + {LIMITS.lease}')} WHEN {e}.kind IN ('done', 'failed') AND {held} THEN {_audit(s, images=image)}"
        f" WHEN {e}.kind = 'finish' AND {held} AND NOT list_contains({s}.images, 'pending') THEN {_closed(s, f'{e}.at', None)} ELSE {s} END"
    )


_AUDIT_EVENTS = {"view": "claim", "click": "done", "signup": "extend", "error": "failed"}


@query(
    f"WITH e AS (SELECT user_id AS audit_id, event_id, epoch_ms(ts) AS at, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AUDIT_EVENTS.items()) + " ELSE 'finish' END AS kind, 'w' || event_id % 2 AS worker, (event_id % 3)::INT AS position FROM events),"
    f" l AS (SELECT audit_id, list({_audit('f', at='e.at', kind='e.kind', worker='e.worker', position='e.position')} ORDER BY e.at, e.event_id) AS es FROM e, (SELECT unnest([{_FRESH % '0'}]) AS f) GROUP BY audit_id),"
    f" r AS (SELECT audit_id, list_reduce(list_prepend({_FRESH % '0'}, es), lambda s, e: list_transform([{_passed('s', 'e.at')}], lambda x: {_happened('x', 'e')})[1]) AS s FROM l),"
    f" z AS (SELECT audit_id, {_passed('s', 'now')} AS s FROM r, (SELECT max(e.at) AS now FROM e)) SELECT audit_id, s.status AS status, s.attempts AS attempts, s.error AS error, array_to_string(s.images, ',') AS images, s.deleted AS deleted FROM z"
)
def stream_audits(spark, d):
    """Every audit (one a user) after all events: leases, deadlines that fail pending images, and retention, kept as a stream's state with timers."""
    e = streams.read_events(spark, f"{d}/event*.parquet")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _AUDIT_EVENTS.items()], F.lit("finish"))
    events = e.select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("seq"), "at", kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), (F.col("event_id") % 3).cast("int").alias("position"))
    return streams.drain_latest(audits.audit_states(events, LIMITS), ["audit_id"])
