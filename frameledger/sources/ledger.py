"""An append-only log of batches: a batch that comes again adds nothing, and a row that would change one is refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class AppendOnlyError(ValueError):
    """A row whose key the log already has with other content, or twice in one batch."""


def read_log(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch=*")


def _content(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).cast("binary"), 256)


def append_batch(rows: DataFrame, folder: str, number: int, keys: list[str]) -> int:
    """Adds what is new of ``rows`` as batch ``number`` and returns its count.

    A batch is one folder that its number names and that is written whole, so writing it again replaces it by the same. Rows that other
    batches hold already, with the same content, are left out; with other content they are refused, and nothing is written.
    """
    spark = rows.sparkSession
    log = read_log(spark, folder, rows.schema).where(~F.contains(F.input_file_name(), F.lit(f"/batch={number}/")))
    marked = rows.distinct().withColumn("__new", _content(rows.columns))
    twice = marked.groupBy(*keys).agg(F.count_distinct("__new").alias("n")).where("n > 1").count()
    known = log.join(marked.select(*keys), keys, "left_semi").select(*keys, _content(rows.columns).alias("__old"))
    met = marked.join(known, keys, "left")
    changed = met.where("__old <> __new").count()
    if twice or changed:
        raise AppendOnlyError(f"{changed} rows would change the log, {twice} keys are in the batch with different content")
    fresh = met.where("__old IS NULL").select(*[F.col(f"`{c}`") for c in rows.columns])
    path = f"{folder}/batch={number}"
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count()


def appender(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that a restarted stream delivers again is the same folder again."""

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch, folder, number, keys)

    return add
