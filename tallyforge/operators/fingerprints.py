"""Fingerprints of pictures that come as grey values (row by row, 0 to 255): cosine-transform hashes and standardised textures.

Pictures of one shape are taken together, a batch at a time, so a resize is two matrix products and so is a transform. Empty pictures, and those whose pixels don't
fill height x width or hold nulls, have a null fingerprint.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

#: Fixed values of the two fingerprints.
HASH_SIDE, HASH_KEPT = 32, 8
TEXTURE_SIDE, LIGHT_WEIGHT, HUE_WEIGHT, HUES, HUE_RANGE, COLOURFUL = 40, 10.0, 36.0, 12, 180, 45


@lru_cache(maxsize=256)
def _shrink(size: int, to: int) -> np.ndarray:
    """(to, size): each new pixel is the mean of the stretch of old ones it covers, those cut by an edge by their share."""
    edges = np.arange(to + 1) * (size / to)
    lo, hi = np.maximum(edges[:-1, None], np.arange(size)), np.minimum(edges[1:, None], np.arange(1, size + 1))
    return np.maximum(hi - lo, 0) * (to / size)


@lru_cache(maxsize=8)
def _cosines(size: int, kept: int) -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    k, n = np.arange(kept)[:, None], np.arange(size)[None]
    return np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size)) * np.cos(np.pi * (2 * n + 1) * k / (2 * size))


def _by_shape(pixels: pd.Series, height: pd.Series, width: pd.Series, made):
    """made(stack of pictures, their places) for the whole pictures of each shape."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (p, h, w) in enumerate(zip(pixels, height, width)):
        if p is not None and not pd.isna(h) and not pd.isna(w) and h > 0 and w > 0 and len(p) == h * w and not np.isnan(np.asarray(p, float)).any():
            shapes.setdefault((int(h), int(w)), []).append(i)
    for (h, w), at in shapes.items():
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            made(np.stack([np.asarray(pixels.iloc[i], float).reshape(h, w) for i in part]), part)


@F.pandas_udf(LongType())
def _hash(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(pixels), dtype="Int64")

    def made(x: np.ndarray, at: list[int]) -> None:
        c = _cosines(HASH_SIDE, HASH_KEPT)
        down, across = c @ _shrink(x.shape[1], HASH_SIDE), c @ _shrink(x.shape[2], HASH_SIDE)
        t = np.round(down @ x @ across.T, 6)
        bits = t >= np.median(t[:, 1:, 1:].reshape(len(x), -1), axis=1)[:, None, None]
        out.iloc[at] = np.packbits(bits.reshape(len(x), -1), axis=1).view(">i8").ravel().astype("int64")

    _by_shape(pixels, height, width, made)
    return out


def cosine_hash(pixels: Column, height: Column, width: Column) -> Column:
    """64 bits as a long, the first in the highest: of the lowest 8 x 8 frequencies of the picture at 32 x 32, which are at least the median of those without row and column 0.

    Frequencies are rounded to six decimals, so that what is equal but for rounding gives equal bits.
    """
    return _hash(pixels.cast("array<double>"), height.cast("int"), width.cast("int"))


@F.pandas_udf(ArrayType(DoubleType()))
def _texture(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(pixels), dtype=object)

    def made(x: np.ndarray, at: list[int]) -> None:
        small = (_shrink(x.shape[1], TEXTURE_SIDE) @ x @ _shrink(x.shape[2], TEXTURE_SIDE).T).reshape(len(x), -1)
        flat = (small - small.mean(1, keepdims=True)) / np.maximum(small.std(1, keepdims=True), 1.0)
        for i, v in zip(at, np.concatenate([flat, small / 255 * LIGHT_WEIGHT], axis=1)):
            out.iloc[i] = v

    _by_shape(pixels, height, width, made)
    return out


@lru_cache(maxsize=16)
def _short_frames(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of the maps from pixels to the deviations and to the light of a texture: they keep all lengths and angles."""
    light = np.kron(_shrink(height, TEXTURE_SIDE), _shrink(width, TEXTURE_SIDE))
    return np.linalg.qr(light - light.mean(0), mode="r"), np.linalg.qr(light, mode="r")


@F.pandas_udf(ArrayType(DoubleType()))
def _short_texture(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(pixels), dtype=object)

    def made(x: np.ndarray, at: list[int]) -> None:
        deviations, light = (x.reshape(len(x), -1) @ frame.T for frame in _short_frames(x.shape[1], x.shape[2]))
        spread = np.sqrt((deviations**2).sum(1, keepdims=True)) / TEXTURE_SIDE
        for i, v in zip(at, np.concatenate([deviations / np.maximum(spread, 1.0), light / 255 * LIGHT_WEIGHT], axis=1)):
            out.iloc[i] = v

    _by_shape(pixels, height, width, made)
    return out


def hue_shares(hue: Column, saturation: Column, least: int = COLOURFUL) -> Column:
    """Shares of 12 hue ranges (hues 0 to 179) among the pixels of a saturation of `least` or more; zeros if there are none."""
    seen = F.filter(F.zip_with(hue, saturation, lambda h, s: F.when(s >= least, F.floor(h * HUES / HUE_RANGE))), lambda b: b.isNotNull())
    shares = lambda s: F.transform(F.sequence(F.lit(0), F.lit(HUES - 1)), lambda k: F.size(F.filter(s, lambda b: b == k)) / F.greatest(F.lit(1), F.size(s)))
    return F.transform(F.array(seen), shares)[0]  # a variable of the lambda is taken once, an expression at each use


def texture(pixels: Column, height: Column, width: Column, hues: Column | None = None) -> Column:
    """The picture at 40 x 40 as deviations from its mean (in standard deviations, 1 at least), then its light, then the weighted hue shares."""
    t = _texture(pixels.cast("array<double>"), height.cast("int"), width.cast("int"))
    return t if hues is None else F.concat(t, F.transform(hues, lambda x: x * HUE_WEIGHT))


def short_texture(pixels: Column, height: Column, width: Column, hues: Column | None = None) -> Column:
    """Twice as many numbers as the picture has pixels (40 x 40 at most), then the weighted hue shares: of pictures of one height and width, lengths and angles are those of their textures.

    A texture is a linear map of the pixels but for its scale, so small pictures need no vector longer than they are. Those of different shapes can't be compared.
    """
    t = _short_texture(pixels.cast("array<double>"), height.cast("int"), width.cast("int"))
    return t if hues is None else F.concat(t, F.transform(hues, lambda x: x * HUE_WEIGHT))
