"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_draw(text: Column) -> Column:
    """A double in [0, 1) from the first 8 bytes of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def row_difference_bits(image: Column, rows: int, cols: int) -> Column:
    """Difference hash of a flat grey image: a bit a pixel pair, set if the right one is brighter; rows first, high bit first."""
    spots = F.array(*[F.lit(r * cols + c) for r in range(rows) for c in range(cols - 1)])
    return F.aggregate(spots, F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.when(F.get(image, i + 1) > F.get(image, i), 1).otherwise(0))


def median_bits(values: Column, n: int) -> Column:
    """Median hash of the first n values without the first: set where a value exceeds their median."""
    part = F.slice(values, 2, n - 1)
    ordered = F.array_sort(part)
    median = F.get(ordered, F.lit((n - 2) // 2)) if (n - 1) % 2 else (F.get(ordered, F.lit((n - 1) // 2 - 1)) + F.get(ordered, F.lit((n - 1) // 2))) / 2
    return F.transform(F.array(median), lambda m: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > m, 1).otherwise(0)))[0]


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; the input is not empty."""
    return F.transform(
        F.array(F.transform(values, lambda x: F.exp((x - F.array_max(values)) / F.lit(float(temperature))))),
        lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)),
    )[0]


def entropy_fraction(p: Column) -> Column:
    """Shannon entropy as a share of the largest possible; probabilities are clipped to [1e-8, 1]."""
    clipped = F.transform(p, lambda x: F.greatest(F.lit(1e-8), F.least(F.lit(1.0), x)))
    return -F.aggregate(F.transform(clipped, lambda x: x * F.ln(x)), F.lit(0.0), lambda a, b: a + b) / F.ln(F.size(p).cast("double"))


def argmax(values: Column) -> Column:
    """The place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def frame_name(stem: Column) -> dict[str, Column]:
    """Sequence, frame and variant of a file name; null where it isn't of that form."""
    pattern = r"(?i)^(\d+)_frame_(\d+)(?:-(\d+))?(?:\.[a-z]+)?$"

    def part(n: int) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, n), F.lit(""))

    return {"sequence_id": part(1), "frame_index": part(2).try_cast("int"), "variant": part(3).try_cast("int")}


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.replace(name, F.lit("-"), F.lit(" ")))), r"\s+", "_")


def issue_code(issue: Column) -> Column:
    return F.substring_index(issue, "(", 1)


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule on the point itself; the polygon is a parameter of a few vertices."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - F.lit(y1)) + F.lit(x1))
        inside = inside != crosses
    return inside


def shoelace_area(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def edge_bin(value: Column, edges: list[float]) -> Column:
    """How many edges are <= the value: left-closed bins."""
    return sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))


def right_closed_bin(value: Column, bins: int) -> Column:
    """How many of the inner edges k / bins are < the value."""
    return sum((F.when(value > F.lit(k) / F.lit(float(bins)), 1).otherwise(0) for k in range(1, bins)), F.lit(0))


def compact(*cases: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in cases]))


def cosine_bits(image: Column, n: int, low: int = 8) -> Column:
    """Cosine hash of a flat n by n grey image, as text of low * low binary digits.

    The image goes through a two-dimensional DCT-II, rows and then columns; a digit is 1 where a coefficient of the low
    corner exceeds the median of all of them but the first.
    """

    def row(k: int) -> list[float]:
        return [math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)]

    basis = F.array(*[F.array(*[F.lit(v) for v in row(k)]) for k in range(low)])

    def dot(values: Column, weights: Column) -> Column:
        return F.aggregate(F.zip_with(values, weights, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda a, b: a + b)

    across = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda y: F.transform(basis, lambda w: dot(F.slice(image, y * n + 1, n), w)))

    def corner(rows: Column) -> Column:
        return F.flatten(F.transform(basis, lambda w: F.transform(F.sequence(F.lit(0), F.lit(low - 1)), lambda u: dot(F.transform(rows, lambda r: F.get(r, u)), w))))

    def digits(c: Column) -> Column:
        rest = low * low - 1
        middle = F.array_sort(F.slice(c, 2, rest))
        median = (F.get(middle, F.lit((rest - 1) // 2)) + F.get(middle, F.lit(rest // 2))) / 2
        return F.transform(F.array(median), lambda m: F.array_join(F.transform(c, lambda x: F.when(x > m, "1").otherwise("0")), ""))[0]

    return F.transform(F.transform(F.array(across), corner), digits)[0]


def resized(width: Column, height: Column, long_side: int) -> tuple[Column, Column]:
    """Width and height with the longer one scaled to ``long_side``; halves go to the even number."""
    scale = F.lit(float(long_side)) / F.greatest(width, height)
    return tuple(F.greatest(F.lit(1).cast("long"), F.bround(side * scale).cast("long")) for side in (width, height))


def padded(side: Column, multiple: int) -> Column:
    return F.ceil(side / F.lit(float(multiple))) * multiple


def rate_factor(step: Column, total: Column, warmup: int) -> Column:
    """Linear growth to 1 over the warm-up steps, then half a cosine down to 0 at the last."""
    progress = (step - warmup) / F.greatest(F.lit(1), total - warmup)
    falling = (F.cos(F.least(F.lit(1.0), progress) * math.pi) + 1) / 2
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(falling) if warmup else falling


def last_parts(path: Column, n: int = 2) -> Column:
    """The last parts of a path: enough to know a file by, without the machine's folders."""
    return F.substring_index(path, "/", -n)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


def image_quality(image: Column, rows: int, cols: int) -> dict[str, Column]:
    """Sharpness (population variance of the five-point Laplacian inside the border), brightness and share of clipped pixels of a flat grey image."""
    inside = F.array(*[F.lit(r * cols + c) for r in range(1, rows - 1) for c in range(1, cols - 1)])

    def bend(i: Column) -> Column:
        return F.get(image, i - 1) + F.get(image, i + 1) + F.get(image, i - cols) + F.get(image, i + cols) - F.get(image, i) * 4

    bends = F.transform(inside, lambda i: bend(i).cast("double"))
    spread = F.transform(F.array(bends), lambda b: _mean(F.transform(b, lambda x: x * x)) - _mean(b) * _mean(b))[0] if min(rows, cols) > 2 else F.lit(0.0)
    clipped = F.size(F.filter(image, lambda x: (x <= 2) | (x >= 253))) / F.size(image)
    return {"sharpness": spread, "brightness": _mean(F.transform(image, lambda x: x.cast("double"))), "clipped": clipped}
