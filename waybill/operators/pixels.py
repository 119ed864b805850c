"""Images as arrays: decoding, resizing, cropping, stretching, straightening of text strips, tensors for recognisers.

An image is an array (height, width, 4) of bytes; all of this is numpy over whole planes. ``over_images`` runs any of it on
a table, a batch of images at a time; what comes before and after (sizes, regions, scores) stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Means and deviations of the detector's input (fixed values).
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LONG_SIDE = 720


def read_pnm(data: bytes) -> np.ndarray:
    """A binary PGM or PPM of eight bits as an image; other formats need a decoder of their own."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("not a whole image")
        fields.append(data[at:end])
        at = end
    kind, w, h, most = fields[0], *map(int, fields[1:])
    planes = {b"P5": 1, b"P6": 3}.get(kind)
    if not planes or most != 255:
        raise ValueError("only binary PGM and PPM of eight bits")
    x = np.frombuffer(data, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
    return np.concatenate([np.broadcast_to(x, (h, w, 3)), np.full((h, w, 1), 255, np.uint8)], axis=2)


def half_pixel_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with centres of pixels on centres; values are cut to whole bytes."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.minimum(n - 1, (np.arange(m) + 0.5) * (n / m) - 0.5)
        low = np.maximum(0, np.floor(s)).astype(int)
        return low, np.minimum(n - 1, low + 1), s - low

    h, w = image.shape[:2]
    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    p = image.astype(float)
    rows = p[y0] * (1 - fy)[:, None, None] + p[y1] * fy[:, None, None]
    return (rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]).astype(np.int64).astype(np.uint8)


def fit_long_side(image: np.ndarray, long_side: int = LONG_SIDE) -> np.ndarray:
    """No larger than ``long_side`` pixels; a smaller image stays."""
    h, w = image.shape[:2]
    scale = min(1.0, long_side / max(h, w, 1))
    return image if scale == 1.0 else half_pixel_resize(image, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))


def crop(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A part of an image; beyond an edge, the pixels of the edge go on."""
    h, w = image.shape[:2]
    return image[np.clip(np.arange(y, y + height), 0, h - 1)][:, np.clip(np.arange(x, x + width), 0, w - 1)]


def stretch(image: np.ndarray) -> np.ndarray:
    """Contrast from the 2nd to the 98th percentile of grey to the whole range; an even image stays as it is."""
    grey = (image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    below = np.cumsum(np.bincount(grey.ravel(), minlength=256))
    last = lambda share, none: int(np.flatnonzero(below <= grey.size * share)[-1]) if (below <= grey.size * share).any() else none
    low, high = last(0.02, 0), last(0.98, 255)
    if high <= low:
        return image
    out = image.copy()
    out[..., :3] = np.clip((image[..., :3].astype(float) - low) * (255 / (high - low)), 0, 255).astype(np.uint8)
    out[..., 3] = 255
    return out


def strip_width(quad: np.ndarray, height: int, most: int) -> int:
    """Width of a strip of this height that keeps the proportions of a quadrangle (corners clockwise from top left)."""
    side = lambda i, j: float(np.hypot(*(quad[i] - quad[j])))
    wide, tall = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    return max(8, min(most, int(np.floor(height * wide / max(1.0, tall) + 0.5))))


def straighten(image: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrangle as a level strip: places blend between its corners, pixels between their four neighbours; what lies
    outside is white."""
    h, w = image.shape[:2]
    v = (np.arange(height) / max(1, height - 1))[:, None, None]
    u = (np.arange(width) / max(1, width - 1))[None, :, None]
    top, bottom = quad[0] + (quad[1] - quad[0]) * u, quad[3] + (quad[2] - quad[3]) * u
    at = top + (bottom - top) * v
    x, y = at[..., 0], at[..., 1]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x, y = np.where(inside, x, 0), np.where(inside, y, 0)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(w - 1, x0 + 1), np.minimum(h - 1, y0 + 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    p = image.astype(float)
    upper, lower = p[y0, x0] * (1 - fx) + p[y0, x1] * fx, p[y1, x0] * (1 - fx) + p[y1, x1] * fx
    return np.where(inside[..., None], np.floor(upper * (1 - fy) + lower * fy + 0.5), 255).astype(np.uint8)


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Four corners clockwise from the top left: by sum and difference of their places."""
    s, d = points.sum(1), points[:, 0] - points[:, 1]
    return points[[s.argmin(), d.argmax(), s.argmax(), d.argmin()]]


def _channels(image: np.ndarray, even_light: bool) -> np.ndarray:
    x = image[..., :3].astype(float) / 255
    if not even_light:
        return x
    grey = x @ np.array([0.299, 0.587, 0.114])
    return np.clip((x - grey.mean()) * min(1.45, max(1.0, 0.26 / max(0.08, float(grey.std())))) + 0.55, 0, 1)


def detector_tensor(image: np.ndarray, even_light: bool = False) -> np.ndarray:
    """Planes (3, height, width) for the detector."""
    return ((_channels(image, even_light) - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1).astype(np.float32)


def recogniser_tensor(image: np.ndarray, width: int = 320, even_light: bool = False) -> np.ndarray:
    """Planes (3, height, width) from -1 to 1 for the recogniser; what the strip doesn't fill is 1."""
    out = np.ones((3, image.shape[0], width), np.float32)
    out[:, :, : image.shape[1]] = (_channels(image, even_light)[:, :width] * 2 - 1).transpose(2, 0, 1)
    return out


def over_images(files: DataFrame, work: Callable[[np.ndarray], list[float]], decode: Callable[[bytes], np.ndarray] = read_pnm, id: str = "uri") -> DataFrame:
    """(id, width, height, values, error) of images (id, content): ``work`` of each decoded image, resized to LONG_SIDE.

    Decoder and work are injected; an image that can't be decoded has an error and no values, and holds up no other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content in zip(b[id], b["content"], strict=True):
                try:
                    image = fit_long_side(decode(bytes(content)))
                    out.append((key, image.shape[1], image.shape[0], [float(x) for x in work(image)], None))
                except Exception as e:
                    out.append((key, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[id, "width", "height", "values", "error"]).astype({"width": "Int64", "height": "Int64"})

    kind = dict(files.dtypes)[id]
    return files.select(id, "content").mapInPandas(run, f"{id} {kind}, width long, height long, values array<double>, error string")
