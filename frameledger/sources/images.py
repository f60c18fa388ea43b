"""Image trees, masks, annotations and digests as tables; CSV and JSON-lines sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import shoelace_area
from ..schemas import ANNOTATIONS, IGNORED


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, md5) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def wrong_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files (path, length, md5) that are missing, or of another length or digest."""
    e = expected.select("path", F.col("length").alias("want_length"), F.col("md5").alias("want_md5"))
    joined = e.join(files, "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("want_length"), "size").when(F.col("md5") != F.col("want_md5"), "digest")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def count_images(spark: SparkSession, path: str) -> DataFrame:
    """(directory, n): images by directory, from names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    image = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("png", "jpg", "jpeg")
    return files.where(image).groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.count(F.lit(1)).alias("n"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data, readable); what can't be decoded has no data."""
    image = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    good = F.col("height") > 0
    return image.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.when(good, F.col("data")).alias("data"), good.alias("readable"))


def mask_counts(images: DataFrame) -> DataFrame:
    """(path, cls, n): pixel counts of grey masks; bytes are unsigned."""

    def run(rows):
        for batch in rows:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], names=["path", "cls", "n"])

    return images.where("readable AND channels = 1").select("path", "data").mapInArrow(run, "path string, cls int, n long")


def unexpected_classes(counts: DataFrame, known: list[int]) -> DataFrame:
    return counts.where(~F.col("cls").isin(*known, IGNORED)).groupBy("path").agg(F.array_sort(F.collect_set("cls")).alias("values"))


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """COCO annotations as categories, images and annotations, one row each."""
    doc = spark.read.schema(ANNOTATIONS).json(path, multiLine=True)
    return {name: doc.select(F.explode(name).alias("x")).select("x.*") for name in ("categories", "images", "annotations")}


def annotation_errors(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, n): repeated image ids and file names, and annotations of no image or category."""
    images, notes, kinds = parts["images"], parts["annotations"], parts["categories"]

    def repeated(column: str, kind: str) -> DataFrame:
        return images.groupBy(F.col(column).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "id", "n")

    def dangling(column: str, to: DataFrame, kind: str) -> DataFrame:
        lost = notes.join(to.select(F.col("id").alias(column)), column, "left_anti")
        return lost.groupBy(F.col(column).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "id", "n")

    return repeated("id", "duplicate_id").union(repeated("file_name", "duplicate_file")).union(dangling("image_id", images, "no_image")).union(dangling("category_id", kinds, "no_category"))


def polygon_issues(coords: Column, width: Column, height: Column) -> Column:
    """Warnings of one polygon's flat coordinates, in order: empty, degenerate, out of bounds by over a pixel, of no area."""
    xs, ys = F.filter(coords, lambda _, i: i % 2 == 0), F.filter(coords, lambda _, i: i % 2 == 1)
    odd = (F.size(coords) < 6) | (F.size(coords) % 2 == 1)
    out = (F.array_min(xs) < -1) | (F.array_min(ys) < -1) | (F.array_max(xs) > width + 1) | (F.array_max(ys) > height + 1)
    flat = ~odd & (shoelace_area(xs, ys) == 0)
    return F.array_compact(F.array(F.when(F.size(coords) == 0, "empty"), F.when(odd & (F.size(coords) > 0), "degenerate"), F.when(~odd & out, "out_of_bounds"), F.when(flat, "zero_area")))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A manifest in a fixed order: ranges of the key to files in turn, so no task holds it all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("header", "true").option("nullValue", "").csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest as :func:`write_csv` writes it; the schema is given, and an empty cell is null."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def directory_digest(spark: SparkSession, path: str) -> DataFrame:
    """(files, sha256): one digest of a folder, over the paths below it and their digests in order; folders have few files."""
    files = file_digests(spark, path).select(F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1).alias("name"), "sha256")
    ordered = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["name"], x["sha256"])), "\n").cast("binary"), 256).alias("sha256"))


def complete_samples(images: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """The wanted images; wanted ids without an image are an error, named by the smallest."""
    lost = wanted.join(images, id_col, "left_anti").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")).first()
    if lost["n"]:
        raise ValueError(f"{lost['n']} wanted images are missing, {lost['first']} first")
    return images.join(wanted.select(id_col), id_col, "left_semi")
