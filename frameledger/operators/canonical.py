"""Canonical forms: one text for equal settings, dotted keys of nested records, digests that don't depend on the order of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_number(x: Column, places: int = 6) -> Column:
    """A number in [0, 1] rounded to ``places`` as the shortest decimal text, with an exponent under a ten-thousandth."""
    k = F.bround(x * 10**places).cast("long")
    whole = F.concat(F.floor(k / 10**places).cast("string"), F.lit("."), F.lpad((k % 10**places).cast("string"), places, "0"))
    plain = F.regexp_replace(whole, r"(\.\d+?)0+$", "$1")
    small = F.concat(F.substring(k.cast("string"), 1, 1), F.when((k >= 10) & (k % 10 != 0), F.concat(F.lit("."), F.substring(k.cast("string"), 2, 1))).otherwise(F.lit("")))
    power = F.when(k < 10, F.lit(f"e-{places:02d}")).otherwise(F.lit(f"e-{places - 1:02d}"))
    return F.when((k > 0) & (k < 10 ** (places - 4)), F.concat(small, power)).otherwise(plain)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def cache_key(image: Column, region: Column, preprocessing: Column, model: Column, policy: Column) -> Column:
    """The digest under which a result is looked up: equal image, region to six places and versions give an equal key.

    ``region`` is an array of (x, y) in [0, 1]. The text has its keys in alphabetical order, so the order in which settings are named doesn't matter.
    """
    points = F.array_join(F.transform(region, lambda v: F.concat(F.lit("["), short_number(v["x"]), F.lit(", "), short_number(v["y"]), F.lit("]"))), ", ")
    parts = {"image": _quoted(image), "model": _quoted(model), "policy": _quoted(policy), "preprocessing": _quoted(preprocessing), "region": F.concat(F.lit("["), points, F.lit("]"))}
    text = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value) for name, value in sorted(parts.items())])
    return F.sha2(F.concat(F.lit("{"), text, F.lit("}")).cast("binary"), 256)


def flattened(rows: DataFrame, id_col: str, record: str) -> DataFrame:
    """(id, key, value): every leaf of a VARIANT column by its dotted key; array places count from 0; nulls are left out.

    One pass a level of nesting, over what is still nested: the passes end with the deepest record, and a leaf leaves at its own level. Empty
    objects and arrays have no leaf.
    """
    spark = rows.sparkSession
    nested, leaves = rows.select(F.col(id_col).alias("id"), F.lit("").alias("key"), F.col(record).alias("v")), None
    while True:
        nested.createOrReplaceTempView("__nested")
        opened = spark.sql("SELECT n.id, n.key AS above, e.pos, e.key, e.value AS v FROM __nested n, LATERAL variant_explode(n.v) AS e")
        name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        opened = opened.select("id", F.concat(F.when(F.col("above") == "", F.lit("")).otherwise(F.concat("above", F.lit("."))), name).alias("key"), "v")
        shape = F.schema_of_variant("v")
        inner = F.startswith(shape, F.lit("OBJECT")) | F.startswith(shape, F.lit("ARRAY"))
        found = opened.where(~inner & (shape != "VOID")).select("id", "key", F.col("v").cast("string").alias("value"))
        leaves = found if leaves is None else leaves.unionByName(found)
        nested = opened.where(inner)
        if not nested.limit(1).count():
            break
    return leaves.withColumnRenamed("id", id_col)


def record_digest(leaves: DataFrame, id_col: str) -> DataFrame:
    """(id, n_leaves, digest): one digest of a record's leaves in the order of their keys; a record has a few of them."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return leaves.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_leaves"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))
