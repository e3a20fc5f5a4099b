"""Photos as files, and detections by a pluggable model."""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import config
from sightline.operators.suppress import suppressed

PATTERN = "*.{jpg,jpeg,JPG,JPEG}"
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
KEYPOINT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "conf")])
SIZE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height")])
DETECTION = T.StructType([T.StructField("box", BOX), T.StructField("conf", T.DoubleType()), T.StructField("kps", T.ArrayType(KEYPOINT))])


def images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Decoded photos of a folder, a row each; undecodable ones have a height of -1."""
    return spark.read.format("image").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", recursive).option("dropInvalid", False).load(folder)


def files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Photos as bytes: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", recursive).load(folder)


def jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the frame header; None if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(SIZE)
def _sizes(content: pd.Series) -> pd.DataFrame:
    found = [jpeg_size(x) or (None, None) for x in content]
    return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})


def with_size(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``size`` (width, height), read from the header without decoding."""
    return df.withColumn("size", _sizes(content))


def orientation(data: bytes | None) -> int:
    """How a JPEG's pixels are to be turned (1 to 8), by the tag in its EXIF block; 1 where there is none or it can't be read."""
    at = 2
    while data and data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        block = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and block[:6] == b"Exif\0\0":
            return _tag_of(block[6:])
        at += 2 + size
    return 1


def _tag_of(tiff: bytes) -> int:
    """The orientation in the first directory of a TIFF header."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (start,) = struct.unpack(f"{order}I", tiff[4:8])
        (entries,) = struct.unpack(f"{order}H", tiff[start : start + 2])
        for k in range(entries):
            tag, kind, count, value = struct.unpack(f"{order}HHIH", tiff[start + 2 + 12 * k : start + 12 + 12 * k])
            if tag == 0x0112:
                return value if kind == 3 and count == 1 and 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


@F.pandas_udf(T.IntegerType())
def _orientations(content: pd.Series) -> pd.Series:
    return content.map(orientation)


def with_orientation(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``orientation``, read from the header without decoding."""
    return df.withColumn("orientation", _orientations(content))


def is_valid_download(content: Column, least_bytes: int, sha256: str = "") -> Column:
    """Whether a fetched file is large enough, no web page, and has the expected checksum (if one is given)."""
    page = F.lower(F.substring(content.cast("string"), 1, 200)).rlike("<!doctype html|<html")
    right = F.sha2(content, 256) == sha256.lower() if sha256 else F.lit(True)
    return (F.length(content) >= least_bytes) & ~F.coalesce(page, F.lit(False)) & right


Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def isolated(model: Model) -> Model:
    """``model`` with faults kept to the rows that cause them.

    Rows are given in groups. One that raises is searched by halves for its first row that raises alone; that row comes back
    without detections and with the fault as ``error``, and what lies behind it is given anew. A group that raises halves
    the next one and a group that passes doubles it, so a fault costs about as many calls as there are halvings of the rows between two
    faults. A model that gives more or fewer rows than it got counts as raising. Each batch comes back as one.
    """

    def called(part: pd.DataFrame) -> list[pd.DataFrame] | Exception:
        try:
            made = list(model(iter([part])))
            if sum(map(len, made)) != len(part):
                raise ValueError(f"{sum(map(len, made))} rows for {len(part)}")
            return made
        except Exception as e:
            return e

    def searched(part: pd.DataFrame, fault: Exception) -> tuple[list[pd.DataFrame], int]:
        """The rows of a group that raised up to its first one that does so alone, and how many these are."""
        out, low, high = [], 0, len(part)
        while low < high:
            most = max(1, (high - low) // 2)
            made = fault if len(part) == 1 else called(part.iloc[low : low + most])
            if not isinstance(made, Exception):
                out, low = out + made, low + most
            elif most > 1:
                high = low + most
            else:
                row = part[["photo_id"]].iloc[low : low + 1]
                return [*out, row.assign(dets=None, error=f"batch_predict_exception: {made}")], low + 1
        return out, low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = sys.maxsize // 2  # all of a batch, until one raises
        for batch in batches:
            at, found = 0, []
            while at < len(batch):
                part = batch.iloc[at : at + size]
                made, passed = called(part), len(part)
                if isinstance(made, Exception):
                    size = max(1, len(part) // 2)
                    made, passed = searched(part, made)
                else:
                    size = max(size, 2 * len(part))
                found += made
                at += passed
            if found:
                out = pd.concat(found, ignore_index=True)
                yield out if "error" in out else out.assign(error=None)

    return run


def detect(rows: DataFrame, model: Model, s: dict = config.DEFAULTS, *, most: int | None = None) -> DataFrame:
    """Adds ``dets`` by a model that maps batches of ``photo_id`` and its inputs to batches of ``photo_id, dets``, and ``error`` where it fails.

    Detections that are sure enough and don't overlap a surer one stay, at most ``max_det`` (or ``most``) of them, surest first.
    """
    s = s if most is None else config.merged({"detector": {"max_det": most}}, s)
    kind = T.ArrayType(DETECTION)
    schema = T.StructType([rows.schema["photo_id"], T.StructField("dets", kind), T.StructField("error", T.StringType())])
    found = rows.mapInPandas(isolated(model), schema)
    return found.withColumn("dets", suppressed(F.coalesce("dets", F.array().cast(kind)), s, kind.simpleString()))


def predict_errors(found: DataFrame) -> DataFrame:
    """Decision rows of photos on which the model failed."""
    return found.filter("error is not null").select("photo_id", F.lit("reject").alias("decision"), F.col("error").alias("reason"))


def candidates(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per detection with its place in the photo's list and the photo's size; photos without one give none."""
    rows = found.join(sizes.select("photo_id", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h")), "photo_id")
    rows = rows.select("photo_id", "w", "h", F.posexplode("dets").alias("candidate_idx", "det"))
    return rows.select("photo_id", "candidate_idx", "w", "h", "det.box.*", F.coalesce("det.conf", F.lit(1.0)).alias("conf"), "det.kps")
