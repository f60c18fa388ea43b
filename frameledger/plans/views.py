"""The engine's tables as views of the given ones, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.duplicates import pairs_to_first

SEQUENCES_FOR_CALIBRATION = (7, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """A pixel an event: truth from its type, prediction from its value, 255 for every 17th."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    v = F.col("value")
    return e.select(
        "event_id",
        F.col("user_id").alias("image_id"),
        F.when(F.col("event_id") % 17 == 0, 255).otherwise(kind).alias("t"),
        F.when(v < 5, 0).when(v < 20, 1).when(v < 50, 2).when(v < 100, 3).otherwise(4).alias("p"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("x"),
        ((F.floor(F.col("event_id") / F.lit(100.0)) % 100) / F.lit(100.0)).alias("y"),
        v.alias("value"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("frame_index"),
    )


PX = """px AS (SELECT event_id, user_id AS image_id, CASE WHEN event_id % 17 = 0 THEN 255 ELSE CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END END AS t,
  CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 50 THEN 2 WHEN value < 100 THEN 3 ELSE 4 END AS p,
  (event_id % 100) / 100::DOUBLE AS x, ((event_id // 100) % 100) / 100::DOUBLE AS y, value, floor(epoch(ts))::BIGINT AS frame_index FROM events)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """A frame an event: its user is the sequence, its second the place, its id decides the official split."""
    r = F.col("event_id") % 10
    return table(spark, d, "events").select(
        F.col("event_id").alias("image_id"),
        F.col("user_id").alias("sequence_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("frame_index"),
        F.when(r == 0, "test").when(r == 1, "val").otherwise("train").alias("official_split"),
        "value",
    )


FRAMES = """frames AS (SELECT event_id AS image_id, user_id AS sequence_id, floor(epoch(ts))::BIGINT AS frame_index,
  CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS official_split, value FROM events)"""


def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate pairs for the split policy: the first frame of equal content (type and value) with each later one."""
    pairs = pairs_to_first(table(spark, d, "events"), ["event_type", "value"], "event_id")
    return pairs.select(F.col("id_b").alias("pair_no"), "id_a", "id_b")


FRAME_PAIRS = "frame_pairs AS (SELECT event_id AS pair_no, min(event_id) OVER (PARTITION BY event_type, value) AS id_a, event_id AS id_b FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL QUALIFY id_a <> id_b)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """A scored image a labelled document."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    issues = F.when(F.col("n_chars") < 100, F.array(F.lit("blurred"))).otherwise(F.expr("cast(array() as array<string>)"))
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "sha256",
        (F.col("quality") == 1).alias("positive"),
        F.round((F.col("n_chars") % 1000) / F.lit(4000.0), 6).alias("total_target"),
        F.round((F.col("n_chars") % 313) / F.lit(1000.0), 6).alias("uncertain"),
        issues.alias("quality_issues"),
    )


SCORED = """scored AS (SELECT d.doc_id, sha256(coalesce(text, '')) AS sha256, quality = 1 AS positive, round((n_chars % 1000) / 4000::DOUBLE, 6) AS total_target,
  round((n_chars % 313) / 1000::DOUBLE, 6) AS uncertain, CASE WHEN n_chars < 100 THEN ['blurred'] ELSE []::VARCHAR[] END AS quality_issues
  FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


def grey_images(spark: SparkSession, d: str) -> DataFrame:
    """An 8 by 8 grey image a vector."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels"), "label")


COPY_IDS = 1_000_000_000


def images_with_copies(spark: SparkSession, d: str) -> DataFrame:
    """The grey images, and of every fifth a copy with one bright pixel, numbered from ``COPY_IDS``."""
    images = grey_images(spark, d).select("image_id", "pixels")
    bright = F.transform("pixels", lambda x, i: F.when(i == F.col("image_id") % 64, F.lit(1.0).cast("float")).otherwise(x))
    return images.union(images.where("image_id % 5 = 0").select(F.col("image_id") + COPY_IDS, bright))


COPIES = f"copies AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + {COPY_IDS}, list_transform(embedding, lambda x, i: CASE WHEN i = vec_id % 64 + 1 THEN 1::FLOAT ELSE x END) FROM embeddings WHERE vec_id % 5 = 0)"


def audit_images(spark: SparkSession, d: str) -> DataFrame:
    """An image a line item of an audit; its flag is its state."""
    state = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "pending").otherwise("complete")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("audit_id"), F.col("l_linenumber").alias("position"), state.alias("status"), (F.col("l_discount") * 10).alias("priority"), F.col("l_partkey").alias("cache_key"), F.col("l_suppkey").alias("result"), F.col("l_shipdate").cast("timestamp").alias("completed_at"), "l_linestatus", "l_quantity"
    )


AUDIT_IMAGES = """audit_images AS (SELECT l_orderkey AS audit_id, l_linenumber AS position, CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'pending' ELSE 'complete' END AS status,
  l_discount * 10 AS priority, l_partkey AS cache_key, l_suppkey AS result, l_shipdate AS completed_at, l_linestatus, l_quantity FROM lineitem)"""


def audits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("complete")
    return o.select(F.col("o_orderkey").alias("audit_id"), state.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_custkey").alias("idempotency_key"), F.col("o_orderpriority").alias("request_hash"))


AUDITS = """audits AS (SELECT o_orderkey AS audit_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'complete' END AS status, o_orderdate AS created_at,
  o_custkey AS idempotency_key, o_orderpriority AS request_hash FROM orders)"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """A feedback a turn: its role stands for the decision."""
    c = table(spark, d, "conversations")
    decision = F.when(F.col("role") == "assistant", "corrected").when(F.col("role") == "system", "needs_retake").otherwise("confirmed")
    return c.select(F.col("conv_id").alias("image_id"), F.col("turn").alias("feedback_id"), decision.alias("decision"), F.length("text").alias("note_chars"))


FEEDBACK = """feedback AS (SELECT conv_id AS image_id, turn AS feedback_id, CASE role WHEN 'assistant' THEN 'corrected' WHEN 'system' THEN 'needs_retake' ELSE 'confirmed' END AS decision, length(text) AS note_chars FROM conversations)"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    """A study trial an event: value is its seconds, the id's parity its condition."""
    e = table(spark, d, "events")
    names = ["cardboard", "soft_plastic", "rigid_plastic", "metal"]

    def some(mod: int):
        return F.filter(F.array(*[F.when((F.col("event_id") + i * mod) % (i + 2) == 0, F.lit(n)) for i, n in enumerate(names)]), lambda m: m.isNotNull())

    return e.select("event_id", F.col("user_id").alias("participant"), F.when(F.col("event_id") % 2 == 0, "assisted").otherwise("unaided").alias("condition"), F.col("value").alias("seconds"), (F.col("event_type") == "purchase").alias("positive"), (F.col("value") > 20).alias("follow_up"), some(1).alias("materials"), some(3).alias("suggested"))


def _some(mod: int) -> str:
    names = ["cardboard", "soft_plastic", "rigid_plastic", "metal"]
    return "list_filter([" + ", ".join(f"CASE WHEN (event_id + {i * mod}) % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate(names)) + "], lambda m: m IS NOT NULL)"


TRIALS = f"""trials AS (SELECT event_id, user_id AS participant, CASE WHEN event_id % 2 = 0 THEN 'assisted' ELSE 'unaided' END AS condition, value AS seconds, event_type = 'purchase' AS positive, value > 20 AS follow_up,
  {_some(1)} AS materials, {_some(3)} AS suggested FROM events)"""
