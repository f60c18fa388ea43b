"""A corpus pipeline of four stages over ``documents``: quality rules, near-dedup, mixing, tokens.

``run`` writes each stage as Parquet into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.llm import bpe, mixing, neardup, quality
from frameledger.llm.common import materialize, row_digest, table, whole_row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a rule of the production policy (operator 9).

    The ledger's id is the row itself, so repeated and null ids stay apart, and a row leaves by its bits in the pass that
    measures it. It leaves through an array of one or no row: a filter would be pushed into the measuring, which would then
    be done for every use of a word list. A null text has no words and goes; no rows give no rows.
    """
    rows = docs.select(whole_row(docs).alias("row"), "text")
    judged = quality.apply_policy(quality.measure(rows, "row", "text"), quality.PRODUCTION)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate component (operator 1).

    Of rows that share an id that of the smallest text stays, a null text being the smallest, of equal texts that of the smallest
    digest of all columns; an id goes if one of its rows is a near copy; rows without an id all stay. Further columns may have any name. No rows give no rows.
    """
    found = neardup.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id"))
    kept = found.agg(F.min("kept").alias("stays"), F.count(F.lit(1)).alias("rows_of_id")).where("stays")
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("key"))
    named = rows.where("key IS NOT NULL").join(kept, F.col("key") == F.col("kept_id"))
    single = named.where("rows_of_id = 1").select("row")
    one = named.where("rows_of_id > 1").groupBy("key").agg(F.min_by("row", F.struct("row.text", row_digest(rows, "row"))).alias("row")).select("row")
    return single.unionByName(one).unionByName(rows.where("key IS NULL").select("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows in the order that gives each source its target weight throughout (operator 3).

    The order is the files' order and the rows' order within them; every row stays, a null source being one of its own,
    rows without an id being drawn by their other columns and repeated rows following each other. Columns named as the mixing's own come
    through it unread. No rows give no rows.
    """
    packed = docs.select("doc_id", "source", whole_row(docs).alias("row"))
    return mixing.in_order(mixing.mix(packed)).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again (operator 5); a null text has no tokens, and no rows give no rows."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("bpe tokens", token_stage),
]

#: Tokens can't be expressed in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
