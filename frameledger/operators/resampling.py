"""Resampling of groups by splitting: how many draws fall into each range of groups, then which groups in it.

A replicate draws k of k groups. Its draws are first dealt to blocks of groups, halving ranges of blocks, the draws of a range's first half being
binomial; each block then takes its own draws. So neither the draws of a replicate nor the groups are ever brought together:
a task handles blocks of one bounded size, and sums over a replicate are combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of a block.
BLOCK = 64
#: Blocks whose draws are summed together, ranges of blocks that are halved together, and draws that are hashed together.
BLOCKS_SUMMED = 4
NODES = 1 << 15
SLOTS = 1 << 16


def uniform(seed: int, *parts: Column) -> Column:
    """A double in [0, 1) from an MD5 digest of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after eight steps of the recurrence; exact to about 1e-13."""
    z = n.cast("double") + 9
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n + i)
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.ln(product)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """The binomial number of ``n`` trials that the uniform ``u`` gives: how many values have a distribution function up to it.

    ``0 < p < 1``. Only values within nine deviations of the mean are walked, whatever ``n``.
    """
    # each value is worked out once: a lambda's argument is, where an expression used often isn't

    def bounded(v: Column) -> Column:
        mean, deviation = v["n"] * v["p"], F.sqrt(v["n"] * v["p"] * (1 - v["p"]))
        low = F.greatest(F.lit(0).cast("long"), F.floor(mean - 9 * deviation - 9)).cast("long")
        return F.struct(v["n"].alias("n"), v["p"].alias("p"), v["u"].alias("u"), low.alias("low"), F.ceil(18 * deviation + 18).alias("reach"))

    def begun(v: Column) -> Column:
        n, p, low = v["n"], v["p"], v["low"]
        first = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) + low * F.ln(p) + (n - low) * F.ln(1 - p))
        return F.struct(n.alias("n"), low.alias("low"), first.alias("first"), (p / (1 - p)).alias("odds"), v["u"].alias("u"), F.sequence(F.lit(0).cast("long"), F.least(n - low, v["reach"])).alias("steps"))

    def walk(v: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            x = v["low"] + i
            total = s["total"] + s["weight"]
            weight = s["weight"] * (v["n"] - x) / (x + 1) * v["odds"]
            return F.struct(weight.alias("weight"), total.alias("total"), (s["below"] + F.when(total <= v["u"], 1).otherwise(0)).alias("below"))

        start = F.struct(v["first"].alias("weight"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("below"))
        return F.least(v["n"], v["low"] + F.aggregate(v["steps"], start, step)["below"])

    given = F.array(F.struct(n.cast("long").alias("n"), p.alias("p"), u.alias("u")))
    return F.transform(F.transform(F.transform(given, bounded), begun), walk)[0]


def hashed(texts: Iterable[bytes]) -> np.ndarray:
    """The uniform of each text, as :func:`uniform` makes it."""
    md5 = partial(hashlib.md5, usedforsecurity=False)
    digests = np.frombuffer(b"".join([md5(t).digest() for t in texts]), np.uint8).reshape(-1, 16)
    return digests[:, :6].astype(np.int64) @ (1 << np.arange(40, -1, -8, dtype=np.int64)) / float(1 << 48)


def _log_factorials(n: np.ndarray) -> np.ndarray:
    z, product = n + 9.0, np.ones(len(n))
    for i in range(1, 9):
        product = product * (n + i)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def binomials(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """:func:`binomial` of many numbers at once; a number is walked until its distribution function passes ``u``."""
    deviation = np.sqrt(n * p * (1 - p))
    low = np.maximum(0, np.floor(n * p - 9 * deviation - 9)).astype(np.int64)
    last = np.minimum(n - low, np.ceil(18 * deviation + 18).astype(np.int64))
    weight = np.exp(_log_factorials(n) - _log_factorials(low) - _log_factorials(n - low) + low * np.log(p) + (n - low) * np.log(1 - p))
    below, at, x = np.zeros(len(n), np.int64), np.arange(len(n)), low.copy()
    left, up, end, odds, total = n - low, u, low + last, p / (1 - p), np.zeros(len(n))
    while len(at):
        total = total + weight
        on = (total <= up) & (x <= end)
        below[at] += on
        weight, x, left = weight * left / (x + 1) * odds, x + 1, left - 1
        if np.count_nonzero(on) < len(at):
            at, weight, x, left, up, end, odds, total = (v[on] for v in (at, weight, x, left, up, end, odds, total))
    return np.minimum(n, low + below)


def block_draws(spark: SparkSession, k: int, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(r, b, n): how many of the k draws of each replicate fall into each block of groups. Row by row, without a shuffle.

    Ranges are halved many at once, the latest first, so a task holds a bounded number of them however many blocks there are.
    """
    blocks = max(1, -(-k // block))

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            pending = [np.stack([ids[i : i + NODES], *(np.full(len(ids[i : i + NODES]), v, np.int64) for v in (0, blocks, k))]) for i in range(0, len(ids), NODES)]
            while pending:
                nodes = pending.pop()
                whole = nodes[2] - nodes[1] == 1
                if whole.any():
                    yield pa.record_batch([nodes[i, whole] for i in (0, 1, 3)], names=["r", "b", "n"])
                r, lo, hi, n = nodes[:, ~whole]
                if not len(r):
                    continue
                middle = (lo + hi) // 2
                share = (np.minimum(middle * block, k) - lo * block) / (np.minimum(hi * block, k) - lo * block)
                draws = binomials(n, share, hashed([b"%d:%d:%d:%d" % (seed, *v) for v in zip(r.tolist(), lo.tolist(), hi.tolist())]))
                halves = np.concatenate([np.stack([r, lo, middle, draws]), np.stack([r, middle, hi, n - draws])], axis=1)
                halves = halves[:, halves[3] > 0]
                pending += [halves[:, i : i + NODES] for i in range(0, halves.shape[1], NODES)]

    return spark.range(replicates if k else 0).mapInArrow(halved, "r long, b long, n long")


def resample(rows: DataFrame, k: int, replicates: int = 2000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The drawn rows of every replicate: the columns of ``rows``, a row a group numbered g from 0, with r; a group drawn twice is two rows."""
    spark = rows.sparkSession
    packed = rows.groupBy(F.floor(F.col("g") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("g", F.struct(*rows.columns).alias("row")))).alias("members"))
    # both sides grow with the groups, and the planner takes the draws for few rows: neither may be broadcast
    draws = block_draws(spark, k, replicates, seed, block).join(packed.hint("merge"), "b")

    def member(slot: Column) -> Column:
        place = F.floor(uniform(seed, F.col("r"), F.col("b"), F.lit("slot"), slot) * F.size("members")).cast("int")
        return F.get("members", place)["row"]

    # picked before they become rows, as a row of its own for each draw would carry the whole block
    picked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), member)
    return draws.select("r", F.explode(picked).alias("row")).select("r", "row.*")


def resampled_sums(rows: DataFrame, k: int, columns: list[str], replicates: int = 2000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(r, columns...): sums of the drawn rows that :func:`resample` would give, by replicate and range of blocks; a sum of nulls is null.

    ``columns`` are whole or floating numbers. Draws meet their groups by ranges of blocks, and a group is counted, not repeated; there may be
    several rows a replicate and range.
    """
    kinds = dict(rows.dtypes)
    whole = {c: kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in columns}
    if odd := [c for c in columns if not whole[c] and kinds[c] not in ("float", "double")]:
        raise TypeError(f"no whole or floating numbers: {odd}")
    width = block * BLOCKS_SUMMED

    def summed(key: tuple[pa.Scalar, ...], draws: pa.Table, groups: pa.Table) -> pa.Table:
        first = key[0].as_py() * BLOCKS_SUMMED
        g = groups["g"].to_numpy() - first * block
        sizes = np.bincount(g // block, minlength=BLOCKS_SUMMED)
        given = {c: groups[c].is_valid().to_numpy() for c in columns}
        values = {c: groups[c].fill_null(0).to_numpy() for c in columns}
        draws = draws.sort_by("r")
        r, b, n = (draws[c].to_numpy() for c in ("r", "b", "n"))
        for c in columns:
            if whole[c] and len(g) and int(np.abs(values[c].astype(float)).max()) * int(n.sum()) >= 1 << 62:
                raise OverflowError(f"sums of {c} leave 64 bits")
        slots = [b"%d" % slot for slot in range(max(n, default=0))]
        ends = np.unique(np.searchsorted(np.cumsum(n), np.arange(SLOTS, int(n.sum()) + SLOTS, SLOTS)) + 1)
        out = [pa.table({c: pa.array([], t) for c, t in types.items()})]
        for i, j in zip([0, *ends[:-1]], ends):
            ids, replicate = np.unique(r[i:j], return_inverse=True)
            heads = [b"%d:%d:%d:slot:" % (seed, *v) for v in zip(r[i:j].tolist(), b[i:j].tolist())]
            texts = [head + slot for head, m in zip(heads, n[i:j].tolist()) for slot in slots[:m]]
            at = np.repeat(b[i:j] - first, n[i:j])
            spots = np.repeat(replicate, n[i:j]) * width + at * block + np.floor(hashed(texts) * sizes[at]).astype(np.int64)
            times = np.bincount(spots, minlength=len(ids) * width).reshape(len(ids), width)[:, g]
            sums = {c: times @ values[c] if np.isfinite(values[c]).all() else np.where(times > 0, times * values[c], 0).sum(axis=1) for c in columns}
            out.append(pa.table({"r": ids} | {c: pa.array(sums[c], types[c], mask=times @ given[c].astype(np.int64) == 0) for c in columns}))
        return pa.concat_tables(out)

    types = {"r": pa.int64()} | {c: pa.int64() if whole[c] else pa.float64() for c in columns}
    kept = rows.select("g", *[F.col(c).cast("long" if whole[c] else "double").alias(c) for c in columns])
    draws = block_draws(rows.sparkSession, k, replicates, seed, block)
    by_range = draws.groupBy(F.floor(F.col("b") / BLOCKS_SUMMED).alias("part")).cogroup(kept.groupBy(F.floor(F.col("g") / width).alias("part")))
    return by_range.applyInArrow(summed, ", ".join(["r long", *[f"`{c}` {'long' if whole[c] else 'double'}" for c in columns]]))


def draws_sql(groups: str = "g", replicates: int = 2000, seed: int = 0, levels: int = 8, block: int = BLOCK) -> str:
    """The same draws as CTEs k (one row) and draws (r, g) over a CTE of numbered groups, for at most ``block * 2 ** levels`` of them."""
    parts = [f"k AS (SELECT count(*) AS k, greatest(1, ceil(count(*) / {block}::DOUBLE))::BIGINT AS blocks FROM {groups})", f"n0 AS (SELECT unnest(range({replicates})) AS r, 0::BIGINT AS lo, blocks AS hi, k AS n FROM k)"]
    for i in range(levels):
        parts.append(
            f"s{i} AS (SELECT t.r, t.lo, t.hi, t.n, (lo + hi) // 2 AS mid, (least((lo + hi) // 2 * {block}, k) - lo * {block}) / (least(hi * {block}, k) - lo * {block})::DOUBLE AS p, ('0x' || substr(md5('{seed}:' || r || ':' || lo || ':' || hi), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u FROM n{i} t, k),"
            f"x{i} AS (SELECT *, unnest(range(greatest(0, floor(n * p - 9 * sqrt(n * p * (1 - p)) - 9))::BIGINT, least(n, ceil(n * p + 9 * sqrt(n * p * (1 - p)) + 9)::BIGINT) + 1)) AS x FROM s{i} WHERE mid > lo),"
            f"f{i} AS (SELECT r, lo, hi, n, u, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p))) OVER (PARTITION BY r, lo ORDER BY x) AS f FROM x{i}),"
            f"l{i} AS (SELECT r, lo, least(max(n), min(x) + count_if(f <= u)::BIGINT) AS a FROM f{i} GROUP BY r, lo),"
            f"n{i + 1} AS (SELECT r, lo, mid AS hi, a AS n FROM s{i} JOIN l{i} USING (r, lo) WHERE a > 0 UNION ALL SELECT r, mid, hi, n - coalesce(a, 0) FROM s{i} LEFT JOIN l{i} USING (r, lo) WHERE n > coalesce(a, 0))"
        )
    parts.append(
        f"draws AS (SELECT r, lo * {block} + floor(('0x' || substr(md5('{seed}:' || r || ':' || lo || ':slot:' || slot), 1, 12))::BIGINT / 281474976710656::DOUBLE * (least((lo + 1) * {block}, k) - lo * {block}))::BIGINT AS g FROM (SELECT r, lo, unnest(range(n)) AS slot FROM n{levels}), k)"
    )
    return ",\n".join(parts)
