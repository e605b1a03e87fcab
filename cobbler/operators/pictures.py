"""Picture decisions over pixel arrays: whitening a border, how much of a picture is a bare pack shot, visible logos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Darkest border that counts as light, how far a shade may be off, near-white, share of a pack shot, faint logos.
LIGHT, TOLERANCE, NEAR_WHITE, PACK_SHOT, FAINT, VISIBLE = 200, 18, 250, 0.35, 215, 0.02
# How far a border's shade may be off when it is trimmed, the side of a stored picture, the share of it that the shoe may fill, how much larger a later logo must be.
TRIM, SIDE, FILL, LARGER = 12, 640, 0.88, 1.1


def whiten_border(rgb: np.ndarray) -> np.ndarray:
    """Pixels that join the border through shades near the top-left one become white; dark borders stay."""
    seed = rgb[0, 0].astype(int)
    if seed.min() < LIGHT:
        return rgb
    near = (np.abs(rgb.astype(int) - seed) <= TOLERANCE).all(axis=2)
    reached = np.zeros_like(near)
    reached[0], reached[-1], reached[:, 0], reached[:, -1] = near[0], near[-1], near[:, 0], near[:, -1]
    while True:  # four-connected growth, one ring of pixels a step
        grown = reached.copy()
        grown[1:] |= reached[:-1]
        grown[:-1] |= reached[1:]
        grown[:, 1:] |= reached[:, :-1]
        grown[:, :-1] |= reached[:, 1:]
        grown &= near
        if (grown == reached).all():
            break
        reached = grown
    out = rgb.copy()
    out[reached] = 255
    return out


def pack_shot_share(rgb: np.ndarray) -> float:
    """Share of near-white pixels."""
    return float((rgb > NEAR_WHITE).all(axis=2).mean())


def trimmed(rgb: np.ndarray) -> np.ndarray:
    """The picture without the rows and columns at its sides that have the top-left pixel's shade; a picture of one shade stays."""
    other = (np.abs(rgb.astype(int) - rgb[0, 0].astype(int)) > TRIM).any(axis=2)
    if not other.any():
        return rgb
    rows, cols = np.flatnonzero(other.any(axis=1)), np.flatnonzero(other.any(axis=0))
    return rgb[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def fitted(rgb: np.ndarray) -> np.ndarray:
    """The trimmed picture, scaled by its nearest pixels into ``FILL`` of a white square of ``SIDE``, in its middle."""
    small = trimmed(rgb)
    scale = SIDE * FILL / max(small.shape[:2])
    h, w = (max(1, round(n * scale)) for n in small.shape[:2])
    at = lambda n, size: np.minimum(((np.arange(n) + 0.5) * size / n).astype(int), size - 1)
    out = np.full((SIDE, SIDE, 3), 255, dtype=np.uint8)
    top, left = (SIDE - h) // 2, (SIDE - w) // 2
    out[top : top + h, left : left + w] = small[at(h, small.shape[0])][:, at(w, small.shape[1])]
    return out


def best_pack_shot(pictures: list[np.ndarray]) -> int | None:
    """Of up to four pictures the first that is a pack shot, else the one nearest to one; None without a picture."""
    shares = [pack_shot_share(whiten_border(x)) for x in pictures[:4]]
    return next((i for i, x in enumerate(shares) if x >= PACK_SHOT), int(np.argmax(shares)) if shares else None)


def chosen_logo(candidates: Column | str) -> Column:
    """Of an ordered array of (url, area) the candidate to keep: a later one must be ``LARGER`` than the best so far; null of none."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.reduce(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), lambda best, x: F.when(x["area"] > best["area"] * LARGER, x).otherwise(best))


def logo_visible(rgba: np.ndarray) -> bool:
    """Is enough of what is opaque dark enough to be seen on white?"""
    solid = rgba[..., 3] >= 128
    if not solid.any():
        return False
    light = rgba[..., 0] * 0.2126 + rgba[..., 1] * 0.7152 + rgba[..., 2] * 0.0722
    return bool((light[solid] < FAINT).mean() >= VISIBLE)


def score_pictures(df: DataFrame, id_col: str) -> DataFrame:
    """(id, share, accepted) of rows with height, width and interleaved ``pixels`` (RGB bytes); null where they don't fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, h, w, px in zip(pdf[id_col], pdf["height"], pdf["width"], pdf["pixels"], strict=True):
                if px is None or not h or not w or len(px) != h * w * 3:
                    out.append((i, None, None))
                    continue
                share = pack_shot_share(whiten_border(np.frombuffer(bytes(px), dtype=np.uint8).reshape(int(h), int(w), 3)))
                out.append((i, share, share >= PACK_SHOT))
            yield pd.DataFrame(out, columns=[id_col, "share", "accepted"])

    return df.select(id_col, "height", "width", "pixels").mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, share double, accepted boolean")
