"""Mixing sources to target weights by Pfair scheduling, in native expressions only.

Weights are fractions c / period. Block i of a source is released at floor(i * period / c) and due
at ceil((i + 1) * period / c); the earliest deadline among the released blocks goes first. With
weights that sum to 1 every block meets its window, so after any number of slots each source has
had its target share to within less than one block. Windows repeat after a period of slots, so one
period's schedule, worked out once by a single expression, places every block of any corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, row_digest, store, table, whole_row

#: Slots of a period at least, and for each source, of which a period has whole thousands.
PERIOD = 1000
SLOTS_A_SOURCE = 10
BLOCK_ROWS = 16
#: Parts into which each source is dealt to be numbered, so that a hot source is many tasks' work.
PARTS = 1024
#: Production targets are the sources' own shares raised to this power: large ones give way.
FLATTEN = 0.7


def _key(source: Column) -> Column:
    """Null apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("0"))


def target_units(counts: DataFrame, weights: dict[str | None, float] | None, period: int, flatten: float) -> DataFrame:
    """(key, c): whole units of the period, at least one each, that sum to ``period``.

    One row per source; sources, unlike rows, are assumed to be at most a few thousand.
    """
    if weights is None:
        raw = counts.select("key", F.pow(F.col("n").cast("double"), F.lit(flatten)).alias("w"))
    else:
        pairs = [("0" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        given = counts.sparkSession.createDataFrame(pairs or [("0", 0.0)], "key string, w double")
        raw = counts.join(F.broadcast(given), "key", "left").select("key", F.coalesce("w", F.lit(0.0)).alias("w"))
    every = Window.partitionBy()
    share = raw.select("key", (F.col("w") / F.sum("w").over(every)).alias("s"), F.count(F.lit(1)).over(every).alias("k"))
    share = share.select("key", (F.coalesce("s", 1.0 / F.col("k")) * (F.lit(period) - F.col("k"))).alias("x"), "k")
    floors = share.select("key", "k", F.floor("x").alias("f"), (F.col("x") - F.floor("x")).alias("rest"))
    left = F.lit(period) - F.col("k") - F.sum("f").over(every)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("rest").desc(), "key"))
    return floors.select("key", "f", rank.alias("r"), left.alias("left")).select("key", (F.col("f") + 1 + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).cast("long").alias("c"))


def period_schedule(units: DataFrame, period: int = PERIOD) -> DataFrame:
    """(key, c, nth, slot): the slot of the nth block of each source within one period.

    One expression walks the slots: the state is the number of blocks each source has had.
    """
    sources = units.agg(F.array_sort(F.collect_list(F.struct("key", "c"))).alias("s"))
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("had"), F.expr("cast(array() as array<bigint>)").alias("order"))

    def step(state: Column, t: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            had = F.get(state["had"], i)
            release = F.floor(had * period / x["c"])
            due = F.ceil((had + 1) * period / x["c"])
            return F.struct(F.when((release <= t) & (had < x["c"]), due).otherwise(F.lit(period * 4).cast("long")).alias("due"), i.cast("long").alias("i"))

        chosen = F.array_min(F.transform("s", window))["i"]
        return F.transform(F.array(chosen), lambda k: F.struct(F.transform(state["had"], lambda h, i: F.when(i == k, h + 1).otherwise(h)).alias("had"), F.concat(state["order"], F.array(k)).alias("order")))[0]

    walked = sources.where(F.size("s") > 0).select("s", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step)["order"].alias("order"))
    slots = walked.select("s", F.posexplode("order").alias("slot", "i")).select(F.get("s", F.col("i").cast("int")).alias("x"), F.col("slot").cast("long").alias("slot"))
    nth = F.row_number().over(Window.partitionBy("x").orderBy("slot")) - 1
    return slots.select(F.col("x.key").alias("key"), F.col("x.c").alias("c"), nth.cast("long").alias("nth"), "slot")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
    parts: int = PARTS,
    flatten: float = FLATTEN,
) -> DataFrame:
    """All rows of ``docs`` with ``mix_block``, ``mix_slot`` and ``mix_offset``.

    Sorted by (mix_slot, mix_offset) the rows are the mix: a slot is one block of one source. Rows of a
    source are taken in the order of md5(id), so that every stretch is a fair draw. As long as no
    source has run out, each has had its weight to within less than one block; the slots of a source
    that has run out stay empty, and no row is dropped or repeated. Sources without a weight, or
    with weight 0, get the smallest share. A null source is one of its own; rows without an id are drawn by a
    digest of the whole row instead; rows with equal ids follow each other in the order of that digest, and only rows that are
    equal throughout may change places. Columns of these three names are replaced, any others may have any name. An empty
    table gives an empty result. ``period`` grows with the number of sources unless it is given; then more
    sources than it has slots are an error.
    """
    made = ["mix_block", "mix_slot", "mix_offset"]
    rows = docs.drop(*made)
    digest = row_digest(rows)
    drawn_by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), digest.cast("string")))
    rows = rows.select(whole_row(rows).alias("row"), _key(F.col(source_col)).alias("__key"), F.md5(drawn_by.cast("binary")).alias("__order"), F.col(id_col).cast("string").alias("__id"), digest.alias("__digest"))
    # the leading hex digits of the order: parts follow each other in it
    rows = rows.withColumn("__part", F.floor(F.conv(F.substring("__order", 1, 6), 16, 10).cast("long") * parts / (1 << 24)).cast("int"))
    counts = rows.groupBy(F.col("__key").alias("key"), F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = store(counts, fresh_path(docs.sparkSession, "counts"))  # ``parts`` rows a source at most
    n_sources = counts.select("key").distinct().count()
    if period is None:
        period = max(PERIOD, -(-SLOTS_A_SOURCE * n_sources // PERIOD) * PERIOD)
    if n_sources > period:
        raise ValueError(f"{n_sources} sources don't fit into a period of {period} slots")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("key").alias("__key"), F.col("part").alias("__part"), before.alias("__before"))
    schedule = period_schedule(target_units(counts.groupBy("key").agg(F.sum("n").alias("n")), weights, period, flatten), period)
    schedule = schedule.select(F.col("key").alias("__key"), F.col("c").alias("__c"), F.col("nth").alias("__nth"), F.col("slot").alias("__slot"))
    nth = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__order", "__id", "__digest")) - 1
    placed = rows.withColumn("__in_part", nth).join(starts, ["__key", "__part"])
    placed = placed.withColumn("__at", F.col("__before") + F.col("__in_part"))
    placed = placed.withColumn("mix_block", F.floor(F.col("__at") / block_rows)).withColumn("mix_offset", (F.col("__at") % block_rows).cast("int"))
    units = schedule.groupBy("__key").agg(F.first("__c").alias("__c"), F.map_from_entries(F.collect_list(F.struct("__nth", "__slot"))).alias("__slots"))
    placed = placed.join(F.broadcast(units), "__key")  # ``period`` slots in all, whatever the corpus
    within = F.element_at("__slots", F.col("mix_block") % F.col("__c"))
    placed = placed.withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("__c")) * period + within)
    return placed.select("row.*", *made)


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixed rows dealt to partitions by ranges of slots and sorted: reading them in file order reads the mix."""
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_offset")


#: The same schedule by a recursion over slots, and the same places by one numbering a source.
SQL = f"""
WITH RECURSIVE k AS (SELECT doc_id, source, coalesce('=' || source, '0') AS key, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents
), n AS (SELECT key, count(*) AS n FROM k GROUP BY key
), p AS (SELECT greatest({PERIOD}, (({SLOTS_A_SOURCE} * count(*) + {PERIOD - 1}) // {PERIOD}) * {PERIOD}) AS period, count(*) AS k FROM n
), x AS (SELECT key, pow(n::DOUBLE, {FLATTEN}::DOUBLE) / sum(pow(n::DOUBLE, {FLATTEN}::DOUBLE)) OVER () * (period - k) AS x, period, k FROM n, p
), f AS (SELECT key, floor(x)::BIGINT AS f, x - floor(x) AS rest, period, k FROM x
), u AS (SELECT key, (f + 1 + CASE WHEN row_number() OVER (ORDER BY rest DESC, key) <= period - k - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS c, period FROM f
), s AS (SELECT list(key ORDER BY key) AS ks, list(c ORDER BY key) AS cs, max(period)::BIGINT AS period FROM u
), w AS (
  SELECT 0::BIGINT AS t, list_transform(cs, lambda c: 0::BIGINT) AS had, 0::BIGINT AS pick FROM s
  UNION ALL SELECT t + 1, list_transform(had, lambda h, i: h + CASE WHEN i = first THEN 1 ELSE 0 END), first::BIGINT FROM (
    SELECT t, had, list_position(dues, list_min(dues)) AS first FROM (
      SELECT t, had, list_transform(cs, lambda c, i: CASE WHEN floor(had[i] * period / c::DOUBLE) <= t AND had[i] < c THEN ceil((had[i] + 1) * period / c::DOUBLE) ELSE period * 4.0 END) AS dues
      FROM w, s WHERE t < period))
), slots AS (SELECT ks[pick] AS key, cs[pick] AS c, period, t - 1 AS slot, had[pick] - 1 AS nth FROM w, s WHERE t > 0
), r AS (SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS place FROM k)
SELECT doc_id, source, place // {BLOCK_ROWS} AS mix_block, (place // {BLOCK_ROWS}) // c * period + slot AS mix_slot, (place % {BLOCK_ROWS})::INT AS mix_offset
FROM r JOIN slots ON slots.key = r.key AND nth = (place // {BLOCK_ROWS}) % c
"""
