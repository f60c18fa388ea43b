"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_DELIMITERS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, also where a name holds a dot."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns made beside it can't clash with any of them."""
    return F.struct(*columns_of(df))


def row_digest(df: DataFrame, row: str | None = None) -> Column:
    """A digest of all columns, or of those packed in the column ``row``, that tells rows of one id apart; maps, which have no order, are left out."""
    fields = df.schema.fields if row is None else df.schema[row].dataType.fields
    plain = [f.name for f in fields if "map<" not in f.dataType.simpleString()]
    kept = [F.col("`" + c.replace("`", "``") + "`") if row is None else F.col(row).getField(c) for c in plain]
    return F.xxhash64(*kept) if kept else F.lit(0).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in tests, a temporary one is made and set; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frameledger-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the planner the table's real size,
    so that only tables known to be small are broadcast.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """As :func:`materialize`, to a path that :func:`remove` can drop later; ``zstd`` for tables of whole texts."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
