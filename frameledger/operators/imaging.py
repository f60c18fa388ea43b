"""Image arithmetic on flat grey images: resampling by two matrices, normalising and padding, hashes, features of tiles.

An image is a row (height, width, pixels row by row). Kernels run in Arrow batches, a batch's images of one size at once, so
Spark deals the images and no image needs another one; images that are too large for a row are tiles with halos.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard deviations of the features' Gaussians, and how many of them a kernel reaches to each side.
SCALES = (1.0, 2.0)
REACH = 4.0


def bilinear_matrix(n_in: int, n_out: int) -> np.ndarray:
    """``n_out`` by ``n_in`` weights of linear interpolation between pixel centres, ends repeated; the identity if the sizes agree."""
    at = np.clip((np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5, 0, n_in - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n_in - 1)
    weights = np.zeros((n_out, n_in))
    np.add.at(weights, (np.arange(n_out), low), 1 - (at - low))
    np.add.at(weights, (np.arange(n_out), high), at - low)
    return weights


def area_matrix(n_in: int, n_out: int) -> np.ndarray:
    """Weights of the mean over each output pixel's stretch of the input, parts of pixels included; for reducing without aliasing."""
    edges = np.arange(n_out + 1) * (n_in / n_out)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(n_in)[None, :]
    shared = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
    return shared / shared.sum(axis=1, keepdims=True)


def nearest_matrix(n_in: int, n_out: int) -> np.ndarray:
    """Weights that pick the pixel under each output centre, so that masks get no new classes."""
    at = np.minimum(((np.arange(n_out) + 0.5) * (n_in / n_out)).astype(int), n_in - 1)
    weights = np.zeros((n_out, n_in))
    weights[np.arange(n_out), at] = 1
    return weights


MATRICES = {"bilinear": bilinear_matrix, "area": area_matrix, "nearest": nearest_matrix}


def resample(images: DataFrame, out_height: Column, out_width: Column, how: str = "bilinear", pixels: str = "pixels") -> DataFrame:
    """``images`` (height, width, pixels...) at the given sizes: ``rows @ image @ columns``, both axes in turn.

    Sizes may differ from row to row. A null image stays null; pixels become doubles; further columns stay. An image whose pixels don't
    fill its size is an error.
    """
    matrix = MATRICES[how]
    others = [c for c in images.columns if c not in ("height", "width", pixels)]
    sized = images.select(*[F.col(f"`{c}`") for c in others], "height", "width", F.col(pixels).cast("array<double>").alias(pixels), out_height.cast("int").alias("__h"), out_width.cast("int").alias("__w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list = [None] * len(batch)
            size = [batch[c].to_numpy() for c in ("height", "width", "__h", "__w")]
            groups: dict[tuple, list[int]] = {}
            for i, p in enumerate(batch[pixels]):
                if p is not None:
                    groups.setdefault(tuple(int(s[i]) for s in size), []).append(i)
            for (h, w, oh, ow), rows in groups.items():
                block = np.stack([np.asarray(batch[pixels].iloc[i], dtype=float).reshape(h, w) for i in rows])
                for i, out in zip(rows, matrix(h, oh) @ block @ matrix(w, ow).T, strict=True):
                    made[i] = out.ravel()
            out = batch[others].copy()
            out["height"], out["width"], out[pixels] = batch["__h"], batch["__w"], pd.Series(made, index=batch.index, dtype=object)
            yield out

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sized.select(*[F.col(f"`{c}`") for c in others]).schema.fields)
    return sized.mapInPandas(run, f"{schema}height int, width int, `{pixels}` array<double>")


def normalized(pixels: Column, mean: float, std: float) -> Column:
    """Pixels of 0 to 255 standardised with a mean and a deviation given on the scale of 0 to 1."""
    return F.transform(pixels, lambda x: (x.cast("double") - F.lit(mean * 255.0)) / F.lit(std * 255.0))


def padded(pixels: Column, height: Column, width: Column, out_height: Column, out_width: Column, fill: float = 0.0) -> Column:
    """A flat image grown to the right and downwards; padding is ``fill``."""
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.concat(F.slice(pixels, y * width + 1, width), F.array_repeat(F.lit(float(fill)), out_width - width)))
    return F.concat(F.flatten(rows), F.array_repeat(F.lit(float(fill)), (out_height - height) * out_width))


def cropped(pixels: Column, width: Column, out_height: Column, out_width: Column) -> Column:
    """The top left part of a flat image: what :func:`padded` grew."""
    return F.flatten(F.transform(F.sequence(F.lit(0), out_height - 1), lambda y: F.slice(pixels, y * width + 1, out_width)))


def gaussian(scale: float, order: int = 0) -> np.ndarray:
    """A sampled Gaussian kernel or its first or second derivative, reaching ``REACH`` deviations to each side."""
    n = math.ceil(REACH * scale)
    x = np.arange(-n, n + 1, dtype=float)
    g = np.exp(-0.5 * (x / scale) ** 2)
    g /= g.sum()
    if order == 1:
        return -x / scale**2 * g
    if order == 2:
        second = (x**2 / scale**4 - 1 / scale**2) * g
        return second - second.mean()
    return g


def halo(scales: tuple[float, ...] = SCALES) -> int:
    """Pixels around a tile that its features depend on."""
    return math.ceil(REACH * max(scales))


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    n = len(kernel) // 2
    ends = [(0, 0)] * image.ndim
    ends[axis] = (n, n)
    wide = np.pad(image, ends, mode="edge")
    out = np.zeros_like(image)
    for k, w in enumerate(kernel[::-1]):
        out += w * np.take(wide, np.arange(k, k + image.shape[axis]), axis=axis)
    return out


FEATURES = ("intensity", "edge", "ridge_high", "ridge_low")


def features_of(image: np.ndarray, scales: tuple[float, ...] = SCALES) -> np.ndarray:
    """(features, height, width): per scale the smoothed intensity, the gradient's length, and both eigenvalues of the Hessian."""
    out = []
    for s in scales:
        g, d, dd = (gaussian(s, order) for order in (0, 1, 2))
        smooth = {k: _along(_along(image, ky, 0), kx, 1) for k, (ky, kx) in {"": (g, g), "x": (g, d), "y": (d, g), "xx": (g, dd), "yy": (dd, g), "xy": (d, d)}.items()}
        middle, half = (smooth["xx"] + smooth["yy"]) / 2, np.hypot((smooth["xx"] - smooth["yy"]) / 2, smooth["xy"])
        out += [smooth[""], np.hypot(smooth["x"], smooth["y"]), middle + half, middle - half]
    return np.stack(out)


def tiles(px: DataFrame, by: list[str], size: int, margin: int, value: str = "value") -> DataFrame:
    """(by..., ty, tx, y, x, value): pixels dealt to tiles of ``size``, each also to the tiles whose margin it lies in."""

    def reached(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - margin) / size).cast("int"), F.floor((F.col(c) + margin) / size).cast("int"))

    return px.select(*by, "y", "x", value, F.explode(reached("y")).alias("ty")).select(*by, "y", "x", value, "ty", F.explode(reached("x")).alias("tx"))


#: Pairs of pixels from which on a tile is filtered whole, and pairs that are weighed at once.
DENSE = 50_000
PAIRS = 500_000


def _weights(scales: tuple[float, ...], margin: int) -> np.ndarray:
    """(scale and order, place of the source, distance): what a pixel gives to one at a distance along an axis of which it is an inner pixel, the first, the last or the only one."""
    out = np.zeros((3 * len(scales), 4, 2 * margin + 1))
    for i, kernel in enumerate(gaussian(s, order) for s in scales for order in (0, 1, 2)):
        n, w = len(kernel) // 2, kernel[::-1]  # an end stands for all that would lie beyond it
        for place, along in enumerate((w, np.cumsum(w), np.cumsum(kernel)[::-1], np.full(len(w), w.sum()))):
            out[i, place, margin - n : margin + n + 1] = along
    return out.reshape(len(out), -1)


def _pair_features(weights: np.ndarray, margin: int, tile: np.ndarray, sizes: np.ndarray, own: np.ndarray, y: np.ndarray, x: np.ndarray, h: np.ndarray, w: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(features, own pixels): :func:`features_of` at own pixels of several tiles' rows, from pairs of pixels no further apart than a kernel reaches."""
    many = sizes[tile[own]]
    target = np.repeat(own, many)
    source = np.arange(len(target)) + np.repeat((np.cumsum(sizes) - sizes)[tile[own]] - (np.cumsum(many) - many), many)
    dy, dx = y[source] - y[target], x[source] - x[target]
    near = (np.abs(dy) <= margin) & (np.abs(dx) <= margin)
    target, source, dy, dx = target[near], source[near], dy[near], dx[near]

    def along(d: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return weights[:, ((at == 0) + 2 * (at == length - 1)) * (2 * margin + 1) + d + margin]

    ky, kx = along(dy, y[source], h[source]) * value[source], along(dx, x[source], w[source])
    begin = np.flatnonzero(np.diff(target, prepend=-1))  # each own pixel is a source of its own
    out = []
    for k in range(0, len(weights), 3):
        smooth = {name: np.add.reduceat(ky[k + a] * kx[k + b], begin) for name, a, b in (("", 0, 0), ("x", 0, 1), ("y", 1, 0), ("xx", 0, 2), ("yy", 2, 0), ("xy", 1, 1))}
        middle, half = (smooth["xx"] + smooth["yy"]) / 2, np.hypot((smooth["xx"] - smooth["yy"]) / 2, smooth["xy"])
        out += [smooth[""], np.hypot(smooth["x"], smooth["y"]), middle + half, middle - half]
    return np.stack(out)


def pixel_features(px: DataFrame, by: list[str], size: int = 64, scales: tuple[float, ...] = SCALES, value: str = "value") -> DataFrame:
    """(by..., y, x, features): the features of every pixel of images given as pixels (y, x, value).

    Images are cut into tiles with halos, so an image of any size is many tasks' work, and the features are those of the whole image. Images are
    rectangles from (0, 0); a pixel that is missing inside counts as 0; further columns are ignored. Tiles of few pixels are worked out many at
    once, from pairs of near pixels instead of all places.
    """
    margin = halo(scales)
    ends = px.groupBy(*by).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    rows = tiles(px, by, size, margin, value).join(ends, by)
    rows = rows.where((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * size < F.col("__h")) & (F.col("tx") * size < F.col("__w")))
    weights = _weights(scales, margin)

    def dense(y: np.ndarray, x: np.ndarray, v: np.ndarray, own: np.ndarray, ty: int, tx: int, h: int, w: int) -> np.ndarray:
        top, left = max(0, ty * size - margin), max(0, tx * size - margin)
        bottom, right = min(h, (ty + 1) * size + margin), min(w, (tx + 1) * size + margin)
        image = np.zeros((bottom - top, right - left))
        image[y - top, x - left] = v
        return features_of(image, scales)[:, y[own] - top, x[own] - left]

    def whole_tiles(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, x, ty, tx, h, w = (table[c].to_numpy().astype(np.int64) for c in ("y", "x", "ty", "tx", "__h", "__w"))
        v = table[value].to_numpy().astype(float)
        is_own = (y // size == ty) & (x // size == tx)
        ends = np.append(starts[1:], len(y))
        pairs = (ends - starts) * np.add.reduceat(is_own.astype(np.int64), starts)
        few = pairs <= DENSE
        few &= np.logical_and.reduceat(np.isfinite(v), starts)  # what isn't finite spreads as far as its kernel does
        repeated = np.append((np.diff(y) == 0) & (np.diff(x) == 0), False)
        repeated[ends - 1] = False
        v = np.where(repeated & np.repeat(few, ends - starts), 0.0, v)  # of rows of one pixel the last counts
        made = np.empty((4 * len(scales), len(y)))
        for a, b in zip(starts[~few], ends[~few]):
            made[:, a:b][:, is_own[a:b]] = dense(y[a:b], x[a:b], v[a:b], is_own[a:b], *(int(c[a]) for c in (ty, tx, h, w)))
        few = np.flatnonzero(few & (pairs > 0))
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) // PAIRS)) + 1):
            if len(part):
                sizes = ends[part] - starts[part]
                at = np.repeat(starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                own = np.flatnonzero(is_own[at])
                made[:, at[own]] = _pair_features(weights, margin, np.repeat(np.arange(len(part)), sizes), sizes, own, *(c[at] for c in (y, x, h, w, v)))
        own = np.flatnonzero(is_own)
        features = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * len(made), made[:, own].T.ravel())
        yield from table.select([*by, "y", "x"]).take(own).append_column("features", features).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            new = np.zeros(len(table), bool)
            new[:1] = True
            for c in [*by, "ty", "tx"]:
                codes = table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= np.diff(codes) != 0
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield from whole_tiles(table.slice(0, starts[-1]), starts[:-1])
            kept = table.slice(starts[-1]) if len(starts) else kept  # the last tile may go on in the next batch
        if kept is not None and len(kept):
            yield from whole_tiles(kept, np.zeros(1, np.int64))

    types = dict(px.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, "y", "x"]) + ", features array<double>"
    return rows.repartition(*by, "ty", "tx").sortWithinPartitions(*by, "ty", "tx", "y", "x").mapInArrow(run, schema)
