"""Images in and out: decoding to pixels, label blobs, PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import half_up
from ..operators import drawing, raster
from . import jpeg

_PIXELS = "image_id string, p long, x int, y int, r int, g int, b int, a int"


def read_images(spark: SparkSession, path: str, suffixes: str = "png|jpe?g|gif|bmp") -> DataFrame:
    """Pixels of the images under ``path``; files of other kinds are left out."""
    files = spark.read.format("image").option("dropInvalid", True).load(path).filter(F.lower("image.origin").rlike(rf"\.({suffixes})$"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, w, h, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                planes = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int32)
                blue, green, red = (planes[:, min(k, n - 1)] for k in range(3))
                yield _rows(name, w, h, red, green, blue, planes[:, 3] if n == 4 else np.full(h * w, 255, np.int32))

    return files.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInArrow(unpack, _PIXELS)


def unpack_rgba(images: DataFrame) -> DataFrame:
    """Pixels of images(image_id, width, height, data), data being RGBA in raster order."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, w, h, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _rows(name, w, h, *np.frombuffer(data, np.uint8).reshape(h * w, 4).T.astype(np.int32))

    return images.select("image_id", "width", "height", "data").mapInArrow(unpack, _PIXELS)


def _rows(name: str, w: int, h: int, *channels: np.ndarray) -> pa.RecordBatch:
    p = np.arange(w * h)
    return pa.RecordBatch.from_arrays([pa.array([name] * (w * h)), pa.array(p), pa.array((p % w).astype(np.int32)), pa.array((p // w).astype(np.int32)), *(pa.array(c) for c in channels)], ["image_id", "p", "x", "y", "r", "g", "b", "a"])


def labels_to_blob(labels: DataFrame) -> DataFrame:
    """(image_id, blob): labels(image_id, p, label) as little-endian 32-bit numbers; an image is one row, at most 1400 pixels a side."""
    packed = F.array_sort(F.collect_list(F.struct("p", "label")))
    flat = labels.groupBy("image_id").agg(F.transform(packed, lambda s: s["label"].cast("long")).alias("labels"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, "<u4").tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["image_id", "blob"])

    return flat.mapInArrow(pack, "image_id string, blob binary")


def blob_to_labels(blobs: DataFrame) -> DataFrame:
    """Inverse of ``labels_to_blob``."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(blob, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(np.arange(len(values))), pa.array(values)], ["image_id", "p", "label"])

    return blobs.select("image_id", "blob").mapInArrow(unpack, "image_id string, p long, label long")


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG file of 8-bit RGBA."""
    lines = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def to_png(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, png) of pixels(image_id, x, y, r, g, b, a) with sizes(image_id, width, height).

    Null for an image that lacks pixels or channels; an image is one row, at most 1400 pixels a side.
    """
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a")))
    whole = pixels.groupBy("image_id").agg(F.flatten(F.transform(cells, lambda s: F.array(s["r"], s["g"], s["b"], s["a"]))).alias("rgba"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for w, h, v in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                whole = w and h and v and len(v) == w * h * 4 and None not in v
                files.append(png(w, h, bytes(v)) if whole else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["image_id", "png"])

    kind = pixels.schema["image_id"].dataType.simpleString()
    return sizes.join(whole, "image_id", "left").select("image_id", "width", "height", "rgba").mapInArrow(encode, f"image_id {kind}, png binary")


THUMBNAIL = 96


def thumbnails(pixels: DataFrame, most: int = THUMBNAIL, kind: str = "png") -> DataFrame:
    """(image_id, png) of every image, at most ``most`` pixels a side; null where it has no whole pixels.

    With ``kind="jpeg"`` (image_id, jpeg), over white at a quality of 0.8; images without pixels give no row.
    """
    if kind not in ("png", "jpeg"):
        raise ValueError(f"kind {kind!r} is neither png nor jpeg")
    images = raster.scaled_sizes(raster.sizes(pixels), most)
    small = raster.downscale(pixels, most, ("r", "g", "b", "a"), images.select("image_id", "width", "height"))
    small = small.select("image_id", "x", "y", *[half_up(F.col(c)).cast("int").alias(c) for c in ("r", "g", "b", "a")])
    if kind == "jpeg":
        return jpeg.to_jpeg(drawing.export(small), 0.8, images.select("image_id", F.col("new_width").alias("width"), F.col("new_height").alias("height")))
    return to_png(small, images.select("image_id", F.col("new_width").alias("width"), F.col("new_height").alias("height")))
