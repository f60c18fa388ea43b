"""Refusals before work begins: class names that don't fit, runtimes that disagree, versions that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_name
from ..schemas import CLASSES


class LabelError(ValueError):
    """Source categories that don't map one to one to the classes."""


class VersionError(ValueError):
    """A model of other versions than the engine's."""


class ParityError(ValueError):
    """Two runtimes whose probabilities differ too much."""


def name_remap(categories: DataFrame, name: str = "name", source: str = "id", classes: dict[int, str] = CLASSES) -> DataFrame:
    """(source_id, cls): source categories by their normalized names; the rows are a category each.

    Refuses a name that no class has, a class that two categories name, and a class that none does.
    """
    spark = categories.sparkSession
    labels = spark.createDataFrame(list(classes.items()), "cls int, label string")  # one row a class
    named = categories.select(F.col(source).alias("source_id"), F.col(name).alias("given"), normalize_name(F.col(name)).alias("label"))
    joined = named.join(F.broadcast(labels), "label", "full")
    row = joined.agg(
        F.sort_array(F.collect_set(F.when(F.col("cls").isNull(), F.col("given")))).alias("unknown"),
        F.sort_array(F.collect_set(F.when(F.col("source_id").isNull(), F.col("label")))).alias("missing"),
    ).first()  # a few categories
    if row["unknown"]:
        raise LabelError(f"no class is named {', '.join(row['unknown'])}")
    twice = joined.groupBy("label").agg(F.count("source_id").alias("n")).where("n > 1").orderBy("label").collect()
    if twice:
        raise LabelError(f"several categories are named {', '.join(r['label'] for r in twice)}")
    if row["missing"]:
        raise LabelError(f"no category is named {', '.join(row['missing'])}")
    return joined.select("source_id", "cls")


def parity(a: DataFrame, b: DataFrame, key: str, proba: str = "p") -> DataFrame:
    """(key, largest): the largest difference of two runtimes' probabilities of each row; null where one side has none or another number of them."""
    left, right = a.select(key, F.col(proba).alias("x")), b.select(key, F.col(proba).alias("y"))
    largest = F.when(F.size("x") == F.size("y"), F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double")))))
    return left.join(right, key, "full").select(key, largest.alias("largest"))


def check_parity(found: DataFrame, tolerance: float = 1e-5) -> float:
    """The largest difference of all, refused above the tolerance or where a row can't be compared."""
    row = found.agg(F.max("largest").alias("largest"), F.count_if(F.col("largest").isNull() | F.isnan("largest")).alias("lost")).first()
    if row["lost"]:
        raise ParityError(f"{row['lost']} rows can't be compared")
    if row["largest"] is not None and row["largest"] > tolerance:
        raise ParityError(f"probabilities differ by {row['largest']:.3g}")
    return row["largest"] or 0.0


def check_versions(declared: dict[str, object], wanted: dict[str, object]) -> None:
    """Refuses a model whose declared fields are missing or differ from the wanted ones, naming all of them."""
    wrong = [f"{name} is {declared.get(name)!r}, not {value!r}" for name, value in sorted(wanted.items()) if declared.get(name) != value]
    if wrong:
        raise VersionError("; ".join(wrong))
