"""Numbers from images and recognisers: pixel statistics, quality scores, greedy decoding, text regions, prepared sizes.

Pixel tables (image, x, y, red, green, blue) are plain aggregations. Whole probability maps are arrays in a row and are
worked on by numpy within Arrow batches; each row is one image, so images run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.semantics import composed, let, round_half_up, trim_all

# Constants of the quality formula (fixed values).
IDEAL_BRIGHTNESS = 0.66
LONG_SIDE, SHORT_SIDE, DETECTOR_SIDE = 2400, 1080, 960
TILE_COLUMNS, TILE_ROWS = 6, 8
#: Full luminance in thousandths.
_FULL = 255_000.0


def percent(x: Column) -> Column:
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def brightness_score(mean: Column, dark: Column, blown: Column) -> Column:
    """Dark counts much, bright little: receipts are white."""
    off = F.when(mean < IDEAL_BRIGHTNESS, (F.lit(IDEAL_BRIGHTNESS) - mean) * 150).otherwise((mean - IDEAL_BRIGHTNESS) * 55)
    return percent(F.lit(100.0) - off - dark * 65 - blown * 20)


def sharpness_score(laplacian_variance: Column) -> Column:
    return percent(F.log10(laplacian_variance + 1) * 34)


def shadow_score(tile_std: Column) -> Column:
    return percent(F.lit(100.0) - tile_std * 185)


def skew_score(degrees: Column) -> Column:
    off = F.abs(degrees) % 90
    return F.when(degrees.isNull(), 35.0).otherwise(percent(F.lit(100.0) - F.least(off, F.lit(90.0) - off) * 5.5))


def coverage_score(box: Column, paper: Column) -> Column:
    return F.when(paper < 0.04, 20.0).when(box < 0.22, percent(box * 180)).when(box > 0.98, 88.0).otherwise(percent(box * 55 + 52))


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """Statistics of each image from its pixels: luminance, dark, blown and paper shares, box, skew, sharpness, tiles.

    Channels are whole numbers, so sums are whole numbers too (luminance in thousandths): a sum of doubles would depend on
    the order of the rows, and a score at the edge of two or an angle of none would come out by chance.
    """
    lum = (F.col("red") * 0.299 + F.col("green") * 0.587 + F.col("blue") * 0.114) / 255
    level = F.col("red").cast("long") * 299 + F.col("green").cast("long") * 587 + F.col("blue").cast("long") * 114
    hi, lo = F.greatest("red", "green", "blue"), F.least("red", "green", "blue")
    # dealt once by image: every window and aggregate below finds its rows together
    p = pixels.repartition("image").withColumn("lum", lum).withColumn("level", level).withColumn("paper", (F.col("lum") > 0.48) & (F.when(hi == 0, 0.0).otherwise((hi - lo) / hi) < 0.42))
    size = p.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    on = lambda c: F.when(F.col("paper"), F.col(c).cast("long"))
    whole = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(19,0)")
    # n * n times a covariance, exact; the factors have 19 digits at most, so their product has a decimal's 38
    spread_of = lambda a, b, n: n.cast("decimal(18,0)") * whole(a * b) - whole(a) * whole(b)
    variance = lambda c: F.try_divide(spread_of(c, c, F.count(c)).cast("double"), F.count(c).cast("double") * F.count(c)) / (_FULL * _FULL)
    x, y = on("x"), on("y")
    base = p.groupBy("image").agg(
        F.count("*").alias("pixels"), (F.sum("level") / (F.count("level") * _FULL)).alias("mean"), variance(F.col("level")).alias("variance"),
        F.avg((F.col("lum") < 0.18).cast("int")).alias("dark"), F.avg((F.col("lum") > 0.94).cast("int")).alias("blown"), F.avg(F.col("paper").cast("int")).alias("paper_ratio"),
        ((F.max(x) - F.min(x) + 1) * (F.max(y) - F.min(y) + 1) / F.count("*")).alias("box"),
        (F.degrees(F.atan2(spread_of(x, y, F.count(x)).cast("double") * 2, (spread_of(x, x, F.count(x)) - spread_of(y, y, F.count(x))).cast("double"))) / 2).alias("angle"),
    )
    row, col = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    lap = F.lag("level").over(row) + F.lead("level").over(row) + F.lag("level").over(col) + F.lead("level").over(col) - F.col("level") * 4
    sharp = p.withColumn("lap", lap).groupBy("image").agg((F.coalesce(variance(F.col("lap")), F.lit(0.0)) * 255 * 255).alias("laplacian"))
    # tile k holds x from floor(k * w / n) on, so x belongs to the last k with k * w <= x * n + n - 1
    tile = lambda c, n, s: F.floor((F.col(c) * n + n - 1) / F.col(s))
    tiles = p.join(size, "image").where("lum > 0.42").groupBy("image", tile("x", TILE_COLUMNS, "w").alias("tx"), tile("y", TILE_ROWS, "h").alias("ty")).agg((F.sum("level") / (F.count("level") * _FULL)).alias("m"), F.count("*").alias("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    deviation = lambda ms: let(total(ms) / F.size(ms), lambda mean: F.sqrt(total(F.transform(ms, lambda m: (m - mean) * (m - mean))) / F.size(ms)))
    spread = tiles.where("n > 20").groupBy("image").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("image", deviation(F.col("ms")).alias("tile_std"))
    has = (F.col("paper_ratio") > 0.035) & F.col("box").isNotNull()
    return (
        base.join(sharp, "image").join(spread, "image", "left")
        .withColumn("box", F.when(has, F.col("box")).otherwise(0.0)).withColumn("angle", F.when(has, F.col("angle"))).withColumn("tile_std", F.coalesce("tile_std", F.sqrt("variance")))
    )


def quality(stats: DataFrame) -> DataFrame:
    """Adds component scores, the weighted score and whether the image passes."""
    s = stats.withColumns({
        "blur": sharpness_score(F.col("laplacian")), "brightness": brightness_score(F.col("mean"), F.col("dark"), F.col("blown")), "coverage": coverage_score(F.col("box"), F.col("paper_ratio")),
        "skew": skew_score(F.col("angle")), "shadow": shadow_score(F.col("tile_std")),
    })
    score = round_half_up(F.col("blur") * 0.27 + F.col("brightness") * 0.22 + F.col("coverage") * 0.23 + F.col("skew") * 0.12 + F.col("shadow") * 0.16)
    return s.withColumn("score", score).withColumn("passed", (F.col("score") >= 68) & (F.col("blur") >= 50) & (F.col("brightness") >= 50) & (F.col("coverage") >= 50))


def report_quality(blur: Column, brightness: Column, coverage: Column, skew: Column, shadow: Column) -> tuple[Column, Column]:
    """(score, passed) by the older weights that earlier reports used."""
    score = round_half_up(blur * 0.27 + brightness * 0.19 + coverage * 0.24 + skew * 0.15 + shadow * 0.15)
    return score, score >= 62


def unmeasured_quality(width: Column, height: Column) -> Column:
    """Quality without pixels: it never passes."""
    lo, hi = F.least(width, height), F.greatest(width, height)
    cover = F.when((lo > 0) & (hi > 0), round_half_up(F.least(F.lit(100.0), lo / hi * 100))).otherwise(0.0)
    return F.struct(F.lit(0).alias("score"), cover.alias("coverage"), F.lit(False).alias("passed"), F.lit(False).alias("measured"))


def illumination(mean: Column, std: Column) -> Column:
    """Contrast factor of an image, between 1 and 1.45."""
    return F.least(F.lit(1.45), F.greatest(F.lit(1.0), F.lit(0.26) / F.greatest(F.lit(0.08), std)))


def prepared_size(width: Column, height: Column, long_side: int = LONG_SIDE) -> tuple[Column, Column]:
    """Size after scaling the long side down to ``long_side``."""
    scale = F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height))
    return round_half_up(width * scale).cast("int"), round_half_up(height * scale).cast("int")


def detector_size(width: Column, height: Column, long_side: int = DETECTOR_SIDE) -> tuple[Column, Column]:
    """Detector input: scaled down, then up to multiples of 32."""
    scale = F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height))
    up = lambda x: F.greatest(F.lit(32), F.ceil(x * scale / 32) * 32).cast("int")
    return up(width), up(height)


def ctc_collapse(steps: DataFrame, key: str = "sequence", step: str = "step", label: str = "label", dictionary: Column | None = None) -> DataFrame:
    """Best label of each step to text: blanks (0) and repeats of the step just before go. (key, labels, text)."""
    w = Window.partitionBy(key).orderBy(step)
    kept = steps.withColumn("_p", F.lag(label).over(w)).where((F.col(label) != 0) & (F.col("_p").isNull() | (F.col("_p") != F.col(label))))
    out = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, label))), lambda x: x[label]).alias("labels"))
    if dictionary is None:
        return out
    # letters that were read apart are joined to syllables
    joined = out.withColumn("text", F.array_join(F.transform("labels", lambda i: F.get(dictionary, i - 1)), ""))
    return joined.withColumn("text", trim_all(composed(F.col("text"), "NFC")))


def step_probability(logits: Column) -> Column:
    """struct(label, probability) of one step: scores that are probabilities stay, others go through softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + x)
    ready = (F.array_min(logits) >= 0) & (top <= 1.0001) & (F.abs(total - 1) < 0.05)
    soft = F.lit(1.0) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("label"), F.when(ready, top).otherwise(soft).alias("probability"))


_REGION = "array<struct<score:double,x:double,y:double,width:double,height:double>>"


def _components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of 8-connected regions by union of runs of neighbouring rows."""
    h, w = mask.shape
    label, parent = np.zeros((h, w), np.int64), [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        runs = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            near = {find(k) for s, e, k in before if s <= b and e >= a}
            if near:
                k = min(near)
                for n in near:
                    parent[n] = k
            else:
                k = len(parent)
                parent.append(k)
            label[y, a:b] = k
            runs.append((a, b, k))
        before = runs
    roots = np.array([find(i) for i in range(len(parent))])
    return roots[label], len(parent)


def text_regions(p: np.ndarray, source_w: float, source_h: float, threshold: float = 0.3, least_score: float = 0.5, least_pixels: int = 12, unclip: float = 1.6, most: int = 96) -> list[dict]:
    """Text regions of a probability map (height by width): components, boxes along their axes grown, rows merged."""
    h, w = p.shape
    label, _ = _components(p >= threshold)
    sx, sy = source_w / w, source_h / h
    boxes = []
    order = {k: i for i, k in enumerate(dict.fromkeys(label[label > 0].tolist()))}
    for k in order:
        ys, xs = np.nonzero(label == k)
        score = float(p[ys, xs].mean())
        if len(xs) < least_pixels or score < least_score:
            continue
        cx, cy = xs.mean(), ys.mean()
        xx, yy, xy = (xs * xs).mean() - cx * cx, (ys * ys).mean() - cy * cy, (xs * ys).mean() - cx * cy
        angle = 0.0 if abs(xy) < 1e-5 and abs(xx - yy) < 1e-5 else 0.5 * np.arctan2(2 * xy, xx - yy)
        ax, ay = np.cos(angle), np.sin(angle)
        along, across = (xs - cx) * ax + (ys - cy) * ay, (ys - cy) * ax - (xs - cx) * ay
        grow = lambda v: max(1.0, (v.max() - v.min() + 1) * (unclip - 1) / 2)
        lo, hi, dn, up = along.min() - grow(along), along.max() + grow(along), across.min() - grow(across), across.max() + grow(across)
        px = [min(max((cx + u * ax - v * ay) * sx, 0), source_w) for u, v in ((lo, dn), (hi, dn), (hi, up), (lo, up))]
        py = [min(max((cy + u * ay + v * ax) * sy, 0), source_h) for u, v in ((lo, dn), (hi, dn), (hi, up), (lo, up))]
        b = {"score": score, "x": float(np.floor(min(px))), "y": float(np.floor(min(py))), "width": float(max(1, np.ceil(max(px) - min(px)))), "height": float(max(1, np.ceil(max(py) - min(py))))}
        if b["width"] >= 8 and b["height"] >= 6 and b["width"] * b["height"] < source_w * source_h * 0.6:
            boxes.append(b)
    return sorted(merge_rows(boxes), key=lambda b: (b["y"], b["x"]))[:most]


def merge_rows(boxes: list[dict]) -> list[dict]:
    """Boxes join the first row that they overlap by 0.45 of the lower height and that is within three heights."""
    rows: list[dict] = []
    for b in sorted(boxes, key=lambda b: (b["y"], b["x"])):
        for i, r in enumerate(rows):
            over = max(0.0, min(r["y"] + r["height"], b["y"] + b["height"]) - max(r["y"], b["y"])) / max(1.0, min(r["height"], b["height"]))
            gap = max(0.0, b["x"] - r["x"] - r["width"], r["x"] - b["x"] - b["width"])
            if over >= 0.45 and gap <= 3 * max(r["height"], b["height"]):
                x, y = min(r["x"], b["x"]), min(r["y"], b["y"])
                rows[i] = {"score": max(r["score"], b["score"]), "x": x, "y": y, "width": max(r["x"] + r["width"], b["x"] + b["width"]) - x, "height": max(r["y"] + r["height"], b["y"] + b["height"]) - y}
                break
        else:
            rows.append(b)
    return rows


def detect(maps: DataFrame, **options: float) -> DataFrame:
    """Regions of each probability map (image, map array<float>, width, height, source_w, source_h)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            found = [text_regions(np.asarray(m, np.float64).reshape(h, w), sw, sh, **options) for m, w, h, sw, sh in zip(g["map"], g["width"], g["height"], g["source_w"], g["source_h"], strict=True)]
            yield pd.DataFrame({"image": g["image"], "regions": found})

    kind = dict(maps.dtypes)["image"]
    return maps.select("image", "map", "width", "height", "source_w", "source_h").mapInPandas(run, f"image {kind}, regions {_REGION}")


_STATS = "pixels long, mean double, variance double, dark double, blown double, paper_ratio double, box double, angle double, laplacian double, tile_std double"


def _statistics(rgb: np.ndarray, width: int) -> tuple:
    """``pixel_statistics`` of one image, pixels packed as 0xRRGGBB, row after row."""
    image = rgb.reshape(-1, width)
    channels = np.stack([image >> 16 & 255, image >> 8 & 255, image & 255]).astype(float)
    lum = (channels[0] * 0.299 + channels[1] * 0.587 + channels[2] * 0.114) / 255
    hi, lo = channels.max(axis=0), channels.min(axis=0)
    paper = (lum > 0.48) & ((hi - lo) / np.where(hi == 0, 1, hi) < 0.42)
    ratio, box, angle = float(paper.mean()), 0.0, None
    if ratio > 0.035:
        y, x = np.nonzero(paper)
        box = float((np.ptp(x) + 1) * (np.ptp(y) + 1) / lum.size)
        dx, dy = x - x.mean(), y - y.mean()
        angle = float(np.degrees(np.arctan2(2 * (dx * dy).mean(), (dx * dx).mean() - (dy * dy).mean())) / 2)
    inner = lum[1:-1, :-2] + lum[1:-1, 2:] + lum[:-2, 1:-1] + lum[2:, 1:-1] - 4 * lum[1:-1, 1:-1] if min(lum.shape) > 2 else np.zeros(0)
    # tile k holds x from floor(k * w / n) on, so x belongs to the last k with k * w <= x * n + n - 1
    h, w = lum.shape
    tile = ((np.arange(h) * TILE_ROWS + TILE_ROWS - 1) // h)[:, None] * TILE_COLUMNS + (np.arange(w) * TILE_COLUMNS + TILE_COLUMNS - 1) // w
    bright = lum > 0.42
    n = np.bincount(tile[bright], minlength=1)
    means = (np.bincount(tile[bright], weights=lum[bright], minlength=1) / np.maximum(n, 1))[n > 20]
    spread = float(means.std()) if len(means) else float(lum.std())
    return lum.size, float(lum.mean()), float(lum.var()), float((lum < 0.18).mean()), float((lum > 0.94).mean()), ratio, box, angle, float(inner.var() * 255 * 255) if inner.size else 0.0, spread


def packed_statistics(images: DataFrame) -> DataFrame:
    """``pixel_statistics`` of images that are rows: image, width, rgb (array<int>, 0xRRGGBB, row after row).

    An image is worked out where it lies, in Arrow: nothing is shuffled and no pixel is a row. An image that is null or
    empty, or whose width doesn't divide its pixels, has null statistics; repeated images are rows each.
    """
    names = [f.split()[0] for f in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for width, rgb in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat = rgb.values.to_numpy(zero_copy_only=False) if rgb.is_valid else np.zeros(0)
                whole = width and width > 0 and len(flat) and len(flat) % width == 0 and not rgb.values.null_count
                rows.append(_statistics(flat.astype(np.int64), width) if whole else (None,) * len(names))
            kinds = [pa.int64()] + [pa.float64()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["image", *names])

    kind = dict(images.dtypes)["image"]
    return images.select("image", F.col("width").cast("int"), F.col("rgb").cast("array<int>")).mapInArrow(run, f"image {kind}, {_STATS}")
