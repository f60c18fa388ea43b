"""Duplicate audit: exact groups, banded Hamming pairs, nearest gaps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming
from .spacing import carried


def exact_groups(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, n, first_id) of the keys on more than one row."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def pairs_to_first(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(id_a, id_b): the least id of each group of equal keys with every other, so n copies give n - 1 pairs; null keys give none.

    The groups are counted before the shuffle, and a group of many copies is a skewed side of a join, which is split.
    """
    firsts = rows.groupBy(*keys).agg(F.min(id_col).alias("id_a"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return rows.select(*keys, F.col(id_col).alias("id_b")).join(firsts, keys).where("id_a <> id_b").select("id_a", "id_b")


def hamming_pairs(rows: DataFrame, id_col: str, hash_col: str, k: int, bits: int = 64, bands: int = 4) -> DataFrame:
    """(id_a, id_b, distance) of all pairs within Hamming distance k, ids ascending.

    The bits are cut into ``bands``; of k differences some band has ``k // bands`` at most. One side is indexed by each band
    as it is, the other by all values of the band that so few differences allow, so bands can be wide and buckets small. A pair
    is taken in its first such band only, so nothing has to be made distinct after the join.
    """
    edges = [bits * b // bands for b in range(bands + 1)]
    errors = k // bands

    def band(c, b: int):
        width = edges[b + 1] - edges[b]
        return F.shiftrightunsigned(c, edges[b]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))

    def masks(b: int) -> list[int]:
        width = edges[b + 1] - edges[b]
        return [sum(1 << i for i in spots) for e in range(errors + 1) for spots in itertools.combinations(range(width), e)]

    rows, h = rows.select(F.col(id_col).alias("id"), F.col(hash_col).cast("long").alias("h")), F.col("h")
    one = rows.select("id", "h", F.posexplode(F.array(*[band(h, b) for b in range(bands)])).alias("band", "v"))

    def reachable(b: int):
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks(b)]), lambda m: F.struct(F.lit(b).alias("band"), band(h, b).bitwiseXOR(m).alias("v")))

    near = F.explode(F.concat(*[reachable(b) for b in range(bands)]))
    many = rows.select("id", "h", near.alias("n")).select("id", "h", "n.*")
    a, b = one.alias("a"), many.alias("b")
    joined = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") < F.col("b.id")))
    earlier = F.lit(False)
    for n in range(bands - 1):
        earlier = earlier | ((F.col("a.band") > n) & (hamming(band(F.col("a.h"), n), band(F.col("b.h"), n)) <= errors))
    distance = hamming(F.col("a.h"), F.col("b.h"))
    return joined.where(~earlier & (distance <= k)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), distance.cast("long").alias("distance"))


def nearest_gap(left: DataFrame, right: DataFrame, group: str, at: str, id_col: str) -> DataFrame:
    """(id_col, gap): distance of each left row to the nearest right row of its group, both directions.

    One union, in ranges of (group, at) each way: no pair of rows is formed and no group lies in one task. Rows of a null group have no neighbour.
    """
    rows = left.select(group, at, id_col, F.lit(None).cast("long").alias("mark")).union(right.select(group, at, F.lit(None).cast(dict(left.dtypes)[id_col]), F.col(at).cast("long"))).where(F.col(group).isNotNull() & F.col(at).isNotNull())
    asks = F.col("mark").isNull()  # what asks comes after the marks of its place, each way
    seen = carried(carried(rows, [group], [F.col(at), asks], "mark", "before"), [group], [F.col(at).desc(), asks], "mark", "after")
    gap = F.least(F.col(at) - F.col("before"), F.col("after") - F.col(at))
    return seen.withColumn("gap", gap).where(F.col("mark").isNull() & F.col("gap").isNotNull()).select(id_col, "gap")


def min_split_gaps(frames: DataFrame, group: str = "sequence_id", at: str = "frame_index", split: str = "split") -> DataFrame:
    """(pair, min_gap): the least frame distance between each two splits inside a sequence.

    Of the frames in order only those next to each other can be nearest; per split the last frame seen is carried along, over
    ranges of the order. Of equal places one frame has to see the other, which the order of the splits settles.
    """
    names = ["train", "val", "test"]
    rows = frames.where(F.col(group).isNotNull()).select(group, F.col(split).alias("own"), F.col(at).alias("at"))
    for n in names:
        rows = carried(rows.withColumn("mark", F.when(F.col("own") == n, F.col("at"))), [group], [F.col("at"), F.col("own")], "mark", f"last_{n}")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("other"), F.col(f"last_{n}").alias("seen")) for n in names]))
    gaps = rows.select("own", "at", each.alias("o")).where("o.seen IS NOT NULL AND o.other <> own")
    pair = F.concat_ws("|", F.array_sort(F.array("own", "o.other")))
    return gaps.groupBy(pair.alias("pair")).agg(F.min(F.col("at") - F.col("o.seen")).alias("min_gap"))


def duplicate_summary(pairs: DataFrame, split_a: str = "split_a", split_b: str = "split_b") -> DataFrame:
    key = F.concat_ws("|", F.array_sort(F.array(split_a, split_b)))
    return pairs.groupBy(key.alias("splits")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(split_a) != F.col(split_b)).alias("n_cross"))
