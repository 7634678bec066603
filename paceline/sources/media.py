"""Where boxes, frames and clips come from, and the hooks for a user's own models."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import schemas

PERSON = 0

# One frame (its row, as a mapping) to boxes (x1, y1, x2, y2, conf, cls).
DetectorFn = Callable[[dict], list[tuple[float, float, float, float, float, int]]]
# One frame's pixels and a clamped box (x1, y1, x2, y2) to a vector.
EmbedFn = Callable[[np.ndarray, tuple[int, int, int, int]], np.ndarray]


def read_detections(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """Per-frame boxes, whatever their confidence; as a stream with ``streaming``."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.DETECTIONS).format(fmt).load(path)


def read_scans(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.SCANS).format(fmt).load(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their bytes, for ``detect_frames``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_clip_index(spark: SparkSession, path: str) -> DataFrame:
    """Stored clips by path, size and time of last write. The bytes are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        "path", "length", (F.unix_micros("modificationTime") / F.lit(1e6)).alias("modified_ts"))


def detect_frames(frames: DataFrame, detector: DetectorFn) -> DataFrame:
    """Run a user's detector over ``frames`` (stream_id, frame_idx, ts, ...); boxes of people, in the order given.

    No box is left out for its confidence.
    """
    names = [c.split(" ")[0] for c in schemas.DETECTIONS.split(", ")]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for frame in part.to_dict("records"):
                for i, (x1, y1, x2, y2, conf, cls) in enumerate(detector(frame)):
                    if int(cls) == PERSON:
                        rows.append((frame["stream_id"], frame["frame_idx"], frame["ts"], i, i,
                                     float(x1), float(y1), float(x2), float(y2), float(conf), int(cls)))
            yield pd.DataFrame(rows, columns=names)

    return frames.mapInPandas(batches, schemas.DETECTIONS)


def clamp_box(shape: tuple[int, int], box: tuple[float, float, float, float]) -> tuple[int, int, int, int] | None:
    """Whole pixels of ``box`` inside an image of ``shape`` (height, width); None if nothing is left."""
    x1, y1, x2, y2 = (int(round(v)) for v in box)
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(shape[1], x2), min(shape[0], y2)
    return (x1, y1, x2, y2) if x2 > x1 and y2 > y1 else None


def embed(model: EmbedFn, pixels: Column, box: Column, size: int = 512) -> Column:
    """Appearance vectors by a user's model; zeros where the box is outside the image. ``pixels`` are saved arrays (npy)."""

    @F.pandas_udf("array<float>")
    def run(content: pd.Series, boxes: pd.DataFrame) -> pd.Series:
        out = []
        for raw, b in zip(content, boxes.itertuples(index=False)):
            image = np.load(io.BytesIO(raw))
            area = clamp_box(image.shape[:2], tuple(b))
            vector = np.zeros(size) if area is None else np.asarray(model(image, area), dtype="float64")
            out.append(vector.astype("float32").tolist())
        return pd.Series(out)

    return run(pixels, box)
