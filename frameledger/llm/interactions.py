"""How filters interact: what each removes at each step of every order of them.

A document's fate in all orders depends on the set of filters that it fails (its mask) alone. The orders are numbered
lexicographically by their Lehmer code, and the orders in which a mask is removed at a given step are those that begin with one of a
few prefixes, each an interval of numbers. So a mask's count is added at the intervals' starts and taken off at their
ends, and a running sum over the numbers gives all orders at once; documents are read once and never repeated per order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_DELIMITERS, materialize, table

#: Names of the filters; a filter's bit in a mask is its place.
FILTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prefix_interval(prefix: Sequence[int], n: int) -> tuple[int, int]:
    """The numbers [first, end) of the orders of ``n`` filters that begin with ``prefix``, by its Lehmer code."""
    first = 0
    for i, f in enumerate(prefix):
        first += sum(1 for g in range(f) if g not in prefix[:i]) * math.factorial(n - 1 - i)
    return first, first + math.factorial(n - len(prefix))


def removal_intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """(step, first, end) of the orders in which a document failing ``mask`` is removed at ``step``, neighbours merged."""

    def grow(prefix: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
        for f in range(n):
            if f in prefix:
                continue
            if mask >> f & 1:
                yield (len(prefix) + 1, *prefix_interval((*prefix, f), n))
            else:
                yield from grow((*prefix, f))

    merged: list[tuple[int, int, int]] = []
    for step, first, end in sorted(grow(())):
        if merged and merged[-1][0] == step and merged[-1][2] == first:
            first = merged.pop()[1]
        merged.append((step, first, end))
    return merged


def orders(n: int) -> list[tuple[int, ...]]:
    """All orders by number."""
    return list(permutations(range(n)))


def content_bits(text: Column, words: Column) -> Column:
    """The bits of filters A to D: few words, few distinct words, many capitals, symbols."""
    n, points = F.size(words), F.char_length(text)
    capitals = points - F.char_length(F.translate(text, _UPPER, ""))
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * points, text.rlike("[#$%&*|]")]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def failure_patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters that they fail and by their labels.

    A null text is an empty one, a null source an empty part. Filter E fails a row whose text some smaller id has; a row without
    an id fails it never and makes no other row fail it, and rows that share the smallest id all pass. A
    document with several label rows is good (toxic) if one of them says so; without an id it has none. Repeated rows
    count each. Further columns are ignored. No documents give no rows.

    Texts leave the scan as digests only. Copies are counted by id and digest, then by digest and part, before any of them meet, so a text that
    a third of the rows share is a few rows per part by then.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("id", "part", "t", F.array_remove(F.split("t", WORD_DELIMITERS), "").alias("w"))
    rows = rows.select("id", "part", F.sha2("t", 256).alias("digest"), content_bits(F.col("t"), F.col("w")).alias("bits"))
    by_id = rows.groupBy("id", "digest", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    none = F.lit(False)
    named = by_id.where("id IS NOT NULL").join(marks, F.col("id") == F.col("label_id"), "left").select("id", "digest", "part", "bits", "n", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    groups = named.groupBy("digest", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    # a text's rows are by now at most four for each part
    earliest = F.min("first").over(Window.partitionBy("digest"))
    groups = groups.select("part", "bits", "good", "toxic", "n", F.when(F.col("first") == earliest, F.col("n_first")).otherwise(F.lit(0)).alias("originals"))
    split = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("originals").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    split = groups.select("part", "good", "toxic", split.alias("s")).select("part", "s.mask", "good", "toxic", "s.n")
    nameless = by_id.where("id IS NULL").select("part", F.col("bits").alias("mask"), none.alias("good"), none.alias("toxic"), "n")
    return split.unionByName(nameless).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the counts by mask; see :func:`failure_patterns`.

    Gives kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, zeros included. No rows give no rows.
    """
    spark, n = patterns.sparkSession, len(filters)
    total = math.factorial(n)
    ends = [(m, step, at, sign) for m in range(1, 1 << n) for step, first, end in removal_intervals(m, n) for at, sign in ((first, 1), (end, -1)) if at < total]
    # fixed by the number of filters, not by the data
    ends_of = F.broadcast(spark.createDataFrame(ends, "mask int, step int, number int, sign int"))
    good, toxic = F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)), F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))
    masks = patterns.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"))
    changes = masks.join(ends_of, "mask").select("part", "step", "number", *[(F.col(c) * F.col("sign")).alias(c) for c in ("n", "good", "toxic")])
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("number"), zero.alias("n"), zero.alias("good"), zero.alias("toxic"))
    arrays = changes.unionByName(grid).groupBy("part", "step", "number").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    running = Window.partitionBy("part", "step").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    sums = arrays.select("part", "step", "number", F.sum("n").over(running).alias("removed"), F.sum("good").over(running).alias("good_lost"), F.sum("toxic").over(running).alias("toxic_lost"))
    names = F.array(*[F.lit("".join(filters[f] for f in order)) for order in orders(n)])
    sums = sums.withColumn("filter_order", F.element_at(names, F.col("number") + 1))
    sums = sums.withColumn("letter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    # what doesn't depend on the order: failures of each filter, and failures of it alone
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(filters)]))
    per = masks.select("part", "mask", "n", each.alias("f")).select("part", "mask", "n", "f.*")
    per = per.groupBy("part", "letter").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(zero)).alias("failing"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(zero)).alias("unique_fails"),
    )
    so_far = F.sum("removed").over(Window.partitionBy("part", "number").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    whole = sums.join(per, ["part", "letter"]).join(parts, "part")
    return whole.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - so_far).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        shapley.alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(materialize(failure_patterns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "patterns"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)
), s AS (
  SELECT g.*, filter_order, step::INTEGER AS step, ascii(filter_order[step]) - 64 AS f, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[ascii(filter_order[k]) - 64])), 6) AS gone
  FROM g CROSS JOIN o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed, coalesce(sum(n) FILTER (fails[f] AND gone < step), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda y: y)) = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
