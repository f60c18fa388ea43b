"""Frames that keep their distance: the next frame along a sequence, evenly spaced selections, draws under a minimum gap.

None of these sorts a sequence in one task: frames are dealt to ranges of the order or to cells of the gap's width, and what has to be known
of the ranges before is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def carried(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last value of ``value`` that isn't null, up to and with each row, in ``order`` inside its group.

    Rows are dealt to ranges of the order and written; each range starts from the last value before it, of which there is
    one for each group and range. Rows of a null group form a group.
    """
    ranged = stored(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__r", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("__here", F.last(value, ignorenulls=True).over(inside))
    final = Window.partitionBy(*by, "__r").orderBy(*order)
    ends = here.withColumn("__left", F.lead(F.lit(1)).over(final)).where("__left IS NULL").select(*by, "__r", F.col("__here").alias("__end"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(before)).select(*by, "__r", "__start")
    joined = here.alias("a").join(starts.alias("b"), same & (F.col("a.__r") == F.col("b.__r")))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], F.coalesce("a.__here", "b.__start").alias(name))


def next_frames(frames: DataFrame, group: str, at: str, id_col: str, gap: int) -> DataFrame:
    """(group, at, id, next): for each frame the first one of its sequence at least ``gap`` after it, the smallest id of equals; null if none."""
    marks = frames.select(group, F.col(at).cast("long").alias("at"), F.lit(0).alias("asks"), F.col(id_col).alias("id"), F.col(id_col).alias("mark"))
    asks = frames.select(group, (F.col(at).cast("long") + gap).alias("at"), F.lit(1).alias("asks"), F.col(id_col).alias("id"), F.lit(None).cast(dict(frames.dtypes)[id_col]).alias("mark"))
    # backwards, a place's frames before what asks there, so the last one seen is the first to come
    seen = carried(marks.unionByName(asks), [group], [F.col("at").desc(), F.col("asks"), F.col("id").desc()], "mark", "next")
    return seen.where("asks = 1").select(group, (F.col("at") - gap).alias("at"), "id", "next")


def spaced_selection(frames: DataFrame, group: str, at: str, id_col: str, gap: int) -> DataFrame:
    """(group, id): going up a sequence, each frame at least ``gap`` after the last one taken, from the first one.

    Frames point at their successors; those that the first frame reaches are taken. Pointers are composed with themselves,
    so the taken part doubles each round, and a sequence of n taken frames needs log n rounds of joins on ids. Ids are unique; frames
    without a place take no part.
    """
    known = frames.where(F.col(at).isNotNull())
    pointers = stored(next_frames(known, group, at, id_col, gap), "next")
    taken = pointers.groupBy(group).agg(F.min_by("id", F.struct("at", "id")).alias("id"))
    hops = pointers.where("next IS NOT NULL").select("id", "next")
    n = -1
    taken = stored(taken, "taken")
    while (now := taken.count()) != n:
        n = now
        reached = taken.join(hops, "id").select(group, F.col("next").alias("id"))
        taken = stored(taken.unionByName(reached).distinct(), "taken")
        hops = stored(hops.join(hops.select(F.col("id").alias("next"), F.col("next").alias("beyond")), "next").select("id", F.col("beyond").alias("next")), "hops")
    return taken.select(group, F.col("id").alias(id_col))


def _beside(rows: DataFrame, others: DataFrame, gap: int) -> DataFrame:
    """Each of ``rows`` with every other row less than ``gap`` away in its sequence; both have (seq, at, id, priority, cell)."""
    near = rows.select("seq", F.col("at").alias("at_a"), F.col("id").alias("a"), F.col("priority").alias("p_a"), F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cell"))
    b = others.select("seq", "cell", F.col("at").alias("at_b"), F.col("id").alias("b"), F.col("priority").alias("p_b"))
    return near.join(b, ["seq", "cell"]).where((F.abs(F.col("at_a") - F.col("at_b")) < gap) & (F.col("a") != F.col("b")))


def spaced_draw(pool: DataFrame, chosen: DataFrame, n: int, gap: int) -> DataFrame:
    """(seq, at, id, priority): the first ``n`` of ``pool`` in the order of (priority, id) that keep ``gap`` from ``chosen`` and from each other.

    The same as going through the pool in that order and taking what still fits. Of frames in a cell of the gap's width only the first can be
    taken; it is, once no undecided frame less than the gap away comes before it, and what is too near to it goes. In a
    random order a few rounds decide all. Fewer than ``n`` rows mean that no more fit. Frames without a sequence are far from all.
    """
    far = F.coalesce(F.col("seq").cast("string"), F.concat(F.lit("alone "), F.col("id").cast("string")))

    def celled(rows: DataFrame) -> DataFrame:
        return rows.select(far.alias("seq"), "at", "id", "priority", F.floor(F.col("at") / gap).alias("cell"))

    columns = pool.select("seq", "at", "id", "priority")
    blocked = _beside(celled(chosen), celled(columns), gap).select(F.col("b").alias("id"))
    open_ = stored(celled(columns.join(blocked.union(chosen.select("id")), "id", "left_anti")), "open")
    picked = None
    while open_.limit(1).count():
        order = F.struct("priority", "id")
        first = open_.groupBy("seq", "cell").agg(F.min_by(F.struct("at", "id", "priority"), order).alias("f")).select("seq", "cell", "f.*")
        earlier = _beside(first, open_, gap).where(F.struct("p_b", "b") < F.struct("p_a", "a")).select(F.col("a").alias("id")).distinct()
        free = stored(first.join(earlier, "id", "left_anti").select("seq", "at", "id", "priority", "cell"), "free")
        picked = free if picked is None else picked.unionByName(free)
        gone = _beside(free, open_, gap).select(F.col("b").alias("id")).union(free.select("id"))
        open_ = stored(open_.join(gone, "id", "left_anti"), "open")
    if picked is None:
        return columns.limit(0)
    rank = picked.orderBy("priority", "id").limit(n).select("id")
    return stored(columns.join(rank, "id", "left_semi").select("seq", "at", "id", "priority"), "drawn")
