"""Perceptual hashes of grey images, and their decoding.

Grids are rows of luminance. aHash and dHash over a grid in a column are expressions; pHash needs
a cosine transform and is an Arrow function. Binary PGM/PPM and BMP
are decoded with numpy; other formats go through Pillow where it is installed and are null otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def bits_hex(bits: np.ndarray) -> str:
    """Bits, the first the lowest, as hex digits, 16 at least."""
    value = sum(1 << int(i) for i in np.flatnonzero(bits))
    return f"{value:016x}"


def ahash(grid: np.ndarray) -> str:
    """One bit a pixel: at least the mean. grid: n x n."""
    return bits_hex((grid >= grid.mean()).ravel())


def dhash(grid: np.ndarray) -> str:
    """One bit a pixel: darker than its right neighbour. grid: n rows of n + 1."""
    return bits_hex((grid[:, :-1] < grid[:, 1:]).ravel())


def phash(grid: np.ndarray, n: int = 8) -> str:
    """One bit for each low frequency but the mean: above their upper median. grid: 4n x 4n."""
    size = len(grid)
    k, x = np.arange(n)[:, None], np.arange(size)[None]
    c = np.cos(np.pi * k * (2 * x + 1) / (2 * size))
    low = (c @ grid @ c.T).ravel()[1:]
    return bits_hex(low > np.sort(low)[len(low) // 2])


def whash(grid: np.ndarray) -> str:
    """One bit for each coefficient of the Haar transform's coarse half: above the median. grid: 2n x 2n."""
    half = (grid[0::2, 0::2] + grid[0::2, 1::2] + grid[1::2, 0::2] + grid[1::2, 1::2]) / 2
    return bits_hex((half > np.median(half)).ravel())


METHODS = {"dhash": (dhash, lambda n: (n, n + 1)), "ahash": (ahash, lambda n: (n, n)), "phash": (phash, lambda n: (4 * n, 4 * n)), "whash": (whash, lambda n: (2 * n, 2 * n))}


def resized(grey: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area means over an exact partition of the image; the shape is not kept."""
    def weights(n, m):
        edges = np.linspace(0, n, m + 1)
        i = np.arange(n)
        w = np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, None)
        return w / w.sum(1, keepdims=True)

    return weights(grey.shape[0], rows) @ grey @ weights(grey.shape[1], cols).T


def decoded(data: bytes) -> tuple[np.ndarray, str]:
    """(luminance, format) of an image; ValueError if it cannot be read."""
    import io
    import re

    if m := re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data):
        ch = 1 if m[1] == b"5" else 3
        w, h, top = int(m[2]), int(m[3]), int(m[4])
        if top > 255 or len(data) < m.end() + w * h * ch:
            raise ValueError("unreadable netpbm image")
        a = np.frombuffer(data, np.uint8, w * h * ch, m.end()).reshape(h, w, ch).astype(float)
        return (a[..., 0] if ch == 1 else a @ [0.299, 0.587, 0.114]), "pgm" if ch == 1 else "ppm"
    if data[:2] == b"BM" and len(data) > 54:
        at, w, h, depth = int.from_bytes(data[10:14], "little"), *(int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22)), int.from_bytes(data[28:30], "little")
        if depth not in (24, 32) or data[30:34] != b"\0\0\0\0":
            raise ValueError("unreadable BMP image")
        ch, stride = depth // 8, (w * depth // 8 + 3) // 4 * 4
        a = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * ch].reshape(abs(h), w, ch).astype(float)
        return (a[::-1] if h > 0 else a)[..., :3] @ [0.114, 0.587, 0.299], "bmp"
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("no decoder for this format") from None
    with Image.open(io.BytesIO(data)) as im:
        return np.asarray(im.convert("L"), dtype=float), (im.format or "").lower()


def image_hashes(images: DataFrame, method: str = "dhash", size: int = 8, key: str = "path", content: str = "content") -> DataFrame:
    """(key, hash, algorithm, width, height, format, error); an image that cannot be read is a row with an error."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    f, shape = METHODS[method]

    def run(frames):
        for pdf in frames:
            rows = []
            for k, data in zip(pdf[key], pdf[content], strict=True):
                try:
                    grey, fmt = decoded(bytes(data))
                    grid = resized(grey, *shape(size))
                    rows.append((k, f(grid, size) if method == "phash" else f(grid), method, grey.shape[1], grey.shape[0], fmt, None))
                except (ValueError, TypeError, OSError) as e:
                    rows.append((k, None, method, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "hash", "algorithm", "width", "height", "format", "error"])

    kind = dict(images.dtypes)[key]
    return images.select(key, content).mapInPandas(run, f"key {kind}, hash string, algorithm string, width int, height int, format string, error string").withColumnRenamed("key", key)


def grid_ahash(grid: Column) -> Column:
    """aHash of a flat array of 64 values, as a long (the first value the lowest bit)."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / F.size(grid)
    both = F.array(F.struct(grid.alias("g"), mean.alias("m")))
    return F.transform(both, lambda b: F.aggregate(F.transform(b["g"], lambda x, i: F.when(x >= b["m"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))[0]


@pandas_udf(StringType())
def grid_phash(grid: pd.Series) -> pd.Series:
    """pHash of a flat array of 1024 values."""
    return pd.Series([None if g is None else phash(np.asarray(g, dtype=float).reshape(32, 32)) for g in grid])
