"""Images as whole files: bytes of raw and PNG files, readers of many files over any path that Spark reads."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.validate import positive_size


def image_id(path: Column) -> Column:
    """An image's number: the hash of its file's name without folders and last extension, so that a raster, its edge map and its ground truth meet."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")).alias("image_id")


def files(spark, path: str) -> DataFrame:
    """(image_id, content) of whole files; path may be a folder or a pattern."""
    return spark.read.format("binaryFile").load(path).select(image_id(F.col("path")), "content")


def read_raw_files(spark, path: str, width: int, height: int, channels: int = 1) -> DataFrame:
    """Pixels of headerless rasters of one size, many files at once: (image_id, row, col, v), with ch before v for several channels. Bytes beyond the size are ignored; a shorter file raises."""
    positive_size(width, height, channels)
    line = width * channels

    def run(batches):
        for b in batches:
            for image, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(data) < line * height:
                    raise ValueError(f"image {image}: shorter than {width} x {height} x {channels} bytes")
                step = max(1, (1 << 18) // line)
                for low in range(0, height, step):
                    v = np.frombuffer(data, np.uint8, min(step, height - low) * line, low * line).astype(np.int32)
                    at = np.arange(len(v)) + low * line
                    place = [at // line, at % line // channels] + [at % channels] * (channels > 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), image)), *(pa.array(p.astype(np.int32)) for p in place), pa.array(v)], ["image_id", "row", "col"] + ["ch"] * (channels > 1) + ["v"])

    return files(spark, path).mapInArrow(run, "image_id long, row int, col int" + ", ch int" * (channels > 1) + ", v int")


def png(v: np.ndarray) -> bytes:
    """A PNG file of (height, width, channels) bytes; 1 gray, 2 gray and alpha, 3 RGB, 4 RGBA."""
    height, width, channels = v.shape

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    scan = np.concatenate([np.zeros((height, 1), np.uint8), v.astype(np.uint8).reshape(height, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(scan)) + chunk(b"IEND", b"")


ENCODERS = {"raw": lambda v: v.astype(np.uint8).tobytes(), "png": png}


def image_bytes(px: DataFrame, kind: str = "raw") -> DataFrame:
    """(image_id, height, width, channels, content): each image as one file's bytes, 'raw' or 'png'.

    px: (image_id, row, col[, ch], v). An image is one record, so its pixels meet in one task. A missing or
    repeated pixel, or a value outside 0..255, raises.
    """
    encode, long = ENCODERS[kind], "ch" in px.columns

    def run(key, t):
        at = [np.asarray(t.column(c)).astype(np.int64) for c in ("row", "col") + ("ch",) * long]
        v = np.asarray(t.column("v"))
        shape = [int(a.max()) + 1 for a in at] + [1] * (not long)
        if min(int(a.min()) for a in at) < 0 or len(v) != np.prod(shape) or v.min() < 0 or v.max() > 255:
            raise ValueError(f"image {key[0].as_py()}: missing or repeated pixels, or values beyond 0..255")
        seen, out = np.zeros(shape, bool), np.zeros(shape, np.uint8)
        place = (*at, *([np.zeros(len(v), np.int64)] * (not long)))
        seen[place], out[place] = True, v
        if not seen.all():
            raise ValueError(f"image {key[0].as_py()}: repeated pixels")
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([n], pa.int32()) for n in shape), pa.array([encode(out)], pa.binary())], names=["image_id", "height", "width", "channels", "content"])

    return px.groupBy("image_id").applyInArrow(run, "image_id long, height int, width int, channels int, content binary")


def write_images(px: DataFrame, folder: str, kind: str = "raw", name: str = "{image_id}") -> None:
    """One file an image in a folder that all executors share: name with image_id, width, height and channels filled in, and the kind as extension. A file appears whole or not at all, also when a task runs twice."""
    folder = os.path.abspath(folder.removeprefix("file://").removeprefix("file:"))
    os.makedirs(folder, exist_ok=True)

    def run(rows):
        import uuid

        for r in rows:
            path = os.path.join(folder, f"{name.format(**r.asDict())}.{kind}")
            with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                f.write(r.content)
            os.replace(f.name, path)

    image_bytes(px, kind).foreachPartition(run)
