"""Pixel measures: over a relation of gray values in SQL windows, and over whole images in Arrow batches.

The window forms take ``photo_id, r, c, v`` and shuffle by photo; they are for small
grids and as an independent check. Photos as such go through ``measure_images``: one
row in, one row out, no shuffle, an image at a time in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian of each photo; borders are mirrored without the edge itself."""
    across, down = Window.partitionBy("photo_id", "r").orderBy("c"), Window.partitionBy("photo_id", "c").orderBy("r")

    def near(window, step: int):
        other = F.lead if step < 0 else F.lag
        this = F.lag if step < 0 else F.lead
        return F.coalesce(this("v").over(window), other("v").over(window), F.col("v"))

    out = pixels.withColumn("lap", near(across, -1) + near(across, 1) + near(down, -1) + near(down, 1) - 4.0 * F.col("v"))
    return out.groupBy("photo_id").agg(F.round(F.var_pop("lap"), 6).alias("sharpness"))


def brightness(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("photo_id").agg(F.round(F.avg("v"), 6).alias("brightness"))


def vertical_opening(pixels: DataFrame, half_width: int = 1, half_height: int = 1, threshold: float = 210) -> DataFrame:
    """Bright pixels that survive an opening with an odd rectangle: least, then greatest value over it."""

    def swept(df: DataFrame, name: str, pick) -> DataFrame:
        across = Window.partitionBy("photo_id", "r").orderBy("c").rowsBetween(-half_width, half_width)
        down = Window.partitionBy("photo_id", "c").orderBy("r").rowsBetween(-half_height, half_height)
        return df.withColumn(name, pick(name).over(across)).withColumn(name, pick(name).over(down))

    bright = pixels.withColumn("on", (F.col("v") > threshold).cast("int"))
    return swept(swept(bright, "on", F.min), "on", F.max).select("photo_id", "r", "c", "on")


def pre_check(measures: DataFrame, s: dict) -> DataFrame:
    """Adds ``passes``: whether a photo is worth detecting people in."""
    p = s["pre_check"]
    if not p["enabled"]:
        return measures.withColumn("passes", F.lit(True))
    fine = (F.col("sharpness") >= float(p["min_image_sharpness"])) & F.col("brightness").between(float(p["min_image_brightness"]), float(p["max_image_brightness"]))
    return measures.withColumn("passes", fine)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a height x width x 3 array in blue, green, red order."""
    return image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299


def laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected areas, from 1; 0 is background. Runs of rows are joined by union of their labels."""
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    labels, before = np.zeros(mask.shape, dtype=np.int32), []
    for r, row in enumerate(mask.astype(bool)):
        edges = np.flatnonzero(np.diff(np.r_[False, row, False].astype(np.int8)))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            touching = {root(k) for x, y, k in before if x <= b and y >= a}
            if touching:
                k = min(touching)
                for t in touching:
                    parent[t] = k
            else:
                k = len(parent)
                parent.append(k)
            labels[r, a:b] = k
            runs.append((a, b, k))
        before = runs
    names = np.array([root(i) for i in range(len(parent))])
    return np.unique(names, return_inverse=True)[1].astype(np.int32)[labels] if mask.any() else labels


def fence_figures(g: np.ndarray, person: tuple[float, float, float, float], s: dict) -> tuple[int, float, float, float]:
    """Vertical bright lines of a crop: number, cover of the person, of the central band, and of the crop."""
    f, (h, w) = s["fence_detection"], g.shape
    if not f["enabled"] or h < 50 or w < 50:
        return 0, 0.0, 0.0, 0.0
    bright, tall = g > f["bright_threshold"], max(10, round(h * f["vertical_kernel_height_ratio"]))

    def swept(m: np.ndarray, size: int, axis: int, anchor: int, pick, fill: bool) -> np.ndarray:
        width = [(0, 0), (0, 0)]
        width[axis] = (anchor, size - 1 - anchor)
        padded = np.pad(m, width, constant_values=fill)
        return pick(np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis), axis=-1)

    low = swept(swept(bright, 3, 1, 1, np.min, True), tall, 0, tall // 2, np.min, True)
    opened = swept(swept(low, 3, 1, 1, np.max, False), tall, 0, tall - 1 - tall // 2, np.max, False)
    labels = components(opened)
    lines = np.zeros_like(opened)
    count = 0
    for k in range(1, labels.max() + 1):
        rows, columns = np.nonzero(labels == k)
        ch, cw = np.ptp(rows) + 1, np.ptp(columns) + 1
        if ch >= h * f["min_component_height_ratio"] and cw <= max(3.0, w * f["max_component_width_ratio"]) and ch / cw >= f["min_component_aspect_ratio"]:
            lines[rows, columns], count = True, count + 1
    x1, y1, x2, y2 = (int(v) for v in person)
    inside, band = lines[y1:y2, x1:x2], max(1, round(w * f["central_band_width_ratio"]))
    left = max(0, (w - band) // 2)
    return count, float(inside.mean()) if inside.size else 0.0, float(lines[:, left : left + band].mean()), float(lines.mean())


def decoded(image: dict) -> np.ndarray | None:
    """A row of the ``image`` source as height x width x channels (blue, green, red) or height x width; None if it can't be read."""
    if not image or image["height"] <= 0 or image["nChannels"] not in (1, 3):
        return None
    shape = (image["height"], image["width"], image["nChannels"])
    if len(image["data"]) != shape[0] * shape[1] * shape[2]:
        return None
    data = np.frombuffer(image["data"], np.uint8).reshape(shape)
    return data if shape[2] == 3 else data[..., 0]


def area_resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image at another size, by means over the areas that its pixels stand for; near, not equal, to what imaging libraries give."""

    def means(x: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, len(x), n + 1)
        whole = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        low = np.floor(edges).astype(int)
        part = (edges - low).reshape(-1, *[1] * (x.ndim - 1))
        at = whole[low] + part * np.concatenate([x, x[-1:]])[low]
        return np.diff(at, axis=0) / np.diff(edges).reshape(-1, *[1] * (x.ndim - 1))

    return means(means(g.astype(float), height).swapaxes(0, 1), width).swapaxes(0, 1)


#: Side of the square at which a photo's sharpness and brightness are judged before people are looked for.
PRE_CHECK_SIDE = 256


def pre_check_measures(image: np.ndarray) -> tuple[float, float]:
    """Sharpness and brightness of a photo at the small size, in whole gray levels."""
    small = np.rint(area_resized(image, PRE_CHECK_SIDE, PRE_CHECK_SIDE))
    g = np.rint(gray(small)) if small.ndim == 3 else small
    return float(laplacian(g).var()), float(g.mean())


def measure_images(images: DataFrame) -> DataFrame:
    """``photo_id``, size, sharpness and brightness (at the small size) of rows of the ``image`` source; undecodable ones have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for image in batch.column("image"):
                x = image.as_py()
                data = decoded(x)
                out.append((x["origin"], None, None, None, None) if data is None else (x["origin"], x["width"], x["height"], *pre_check_measures(data)))
            names = ("photo_id", "w", "h", "sharpness", "brightness")
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return images.select("image").mapInArrow(rows, "photo_id string, w int, h int, sharpness double, brightness double")


def photo_rejects(measures: DataFrame, s: dict) -> DataFrame:
    """Decision rows of photos that can't be read, or that the check before detection stops; others give none."""
    checked = pre_check(measures, s)
    reason = F.when(F.col("w").isNull(), "cv2_read_failed").when(~F.col("passes"), "pre_check_failed")
    return checked.select("photo_id", F.lit("reject").alias("decision"), reason.alias("reason")).filter("reason is not null")


def relative_box(box: tuple[float, ...], crop: tuple[float, ...], w: int, h: int) -> tuple[float, float, float, float]:
    """A box of the photo in the crop's own pixels, inside it and a pixel wide at least."""
    x1, y1 = (max(0, min(v - o, n - 1)) for v, o, n in ((box[0], crop[0], w), (box[1], crop[1], h)))
    x2, y2 = (max(a + 1, min(v - o, n)) for v, o, n, a in ((box[2], crop[0], w, x1), (box[3], crop[1], h, y1)))
    return x1, y1, x2, y2


def roi(g: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image in a box, cut to whole pixels and to one pixel at least."""
    h, w = g.shape[:2]
    x1, y1 = (int(max(0, min(v, n - 1))) for v, n in ((box[0], w), (box[1], h)))
    x2, y2 = (int(max(a + 1, min(v, n))) for v, n, a in ((box[2], w, x1), (box[3], h, y1)))
    return g[y1:y2, x1:x2]


def shrunk(g: np.ndarray, height: int) -> np.ndarray:
    """A gray image at a smaller height, by area means."""
    return g if len(g) <= height else area_resized(g, height, max(1, round(g.shape[1] * height / len(g))))


def subject_sharpness(g: np.ndarray, region: tuple[float, float, float, float], height: int = 480) -> float:
    """Focus on a person: the smaller of the region's Laplacian variance and that of its middle half."""
    part = shrunk(roi(g, region), height)
    w = part.shape[1]
    middle = part[:, w // 4 : w - w // 4]
    whole = float(laplacian(part).var())
    return min(whole, float(laplacian(middle).var())) if middle.size else whole


# Strength of the unsharp mask by level; other levels count as medium.
SHARPEN = {"none": 0.0, "light": 0.35, "medium": 0.60, "strong": 0.90}


def unsharp(image: np.ndarray, level: str) -> np.ndarray:
    """An image with its difference to a blurred copy (sigma 1) added."""
    amount = SHARPEN.get(level, SHARPEN["medium"])
    if not amount:
        return image
    k = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    soft = image.astype(float)
    for axis in (0, 1):
        width = [(3, 3) if a == axis else (0, 0) for a in range(image.ndim)]
        padded = np.pad(soft, width, mode="reflect" if image.shape[axis] > 3 else "edge")
        soft = np.lib.stride_tricks.sliding_window_view(padded, 7, axis=axis) @ (k / k.sum())
    return np.clip(np.rint(image * (1 + amount) - soft * amount), 0, 255).astype(image.dtype)
