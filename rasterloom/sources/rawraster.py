"""Headerless raw rasters as a data source: one partition a strip of rows, filters on row prune strips."""

from __future__ import annotations

import glob
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rasterloom.operators.validate import positive_size


def local(path: str) -> str:
    return re.sub(r"^file:(//)?", "", path)


def base_name(path: str) -> str:
    """File name without directory (either slash) and last extension."""
    return re.sub(r"\.[^.]*$", "", re.sub(r"^.*[/\\]", "", path))


def output_name(path: str, suffix: str, share: float | None = None) -> str:
    return f"{base_name(path)}{suffix}{'' if share is None else int(share + 0.5)}.raw"


class RawRaster(DataSource):
    """Options: path, width, height, channels (1), image_id (0), strip (rows of a partition, 256). Gray rasters have
    columns image_id, row, col, v; others image_id, row, col, ch, v. Bytes beyond the size are ignored; a shorter file raises."""

    @classmethod
    def name(cls) -> str:
        return "rawraster"

    def schema(self):
        return "image_id long, row int, col int, v int" if int(self.options.get("channels", 1)) == 1 else "image_id long, row int, col int, ch int, v int"

    def reader(self, schema):
        return (PruningReader if self.options.get("prune") == "true" else RawReader)(self.options)

    def writer(self, schema, overwrite):
        return RawWriter(self.options, [f.name for f in schema.fields])


@dataclass
class Strip(InputPartition):
    first: int
    last: int


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.path = local(options["path"])
        self.width, self.height, self.channels = (int(options.get(k, 1)) for k in ("width", "height", "channels"))
        positive_size(self.width, self.height, self.channels)
        self.image_id, self.strip = int(options.get("image_id", 0)), int(options.get("strip", 256))
        self.low, self.high = 0, self.height

    def partitions(self):
        if os.path.getsize(self.path) < self.width * self.height * self.channels:
            raise ValueError(f"{self.path}: shorter than {self.width} x {self.height} x {self.channels} bytes")
        return [Strip(r, min(r + self.strip, self.high)) for r in range(self.low, self.high, self.strip)] or [Strip(0, 0)]

    def read(self, part):
        line = self.width * self.channels
        with open(self.path, "rb") as f:
            f.seek(part.first * line)
            data = f.read((part.last - part.first) * line)
        v = np.frombuffer(data, np.uint8).astype(np.int32)
        at = np.arange(len(v)) + part.first * line
        cols = [pa.array(np.full(len(v), self.image_id, np.int64)), pa.array((at // line).astype(np.int32)), pa.array((at % line // self.channels).astype(np.int32))]
        names = ["image_id", "row", "col"]
        if self.channels > 1:
            cols.append(pa.array((at % self.channels).astype(np.int32)))
            names.append("ch")
        yield pa.RecordBatch.from_arrays([*cols, pa.array(v)], [*names, "v"])


class PruningReader(RawReader):
    """Conditions on row leave out strips; Spark allows that only while spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f


@dataclass
class Piece(WriterCommitMessage):
    first: int
    last: int
    path: str


class RawWriter(DataSourceArrowWriter):
    """Each task writes its pixels beside the file, the commit joins the pieces in order. Rows must come range-partitioned and sorted; a gap, a repeated pixel or a second image raises, in a task or at the commit, and leaves no file."""

    def __init__(self, options, names):
        self.path, self.names, self.run = local(options["path"]), names, uuid.uuid4().hex
        self.width, self.height, self.channels = (int(options.get(k, 1)) for k in ("width", "height", "channels"))

    def write(self, batches):
        path, first, last, image = f"{self.path}.{self.run}.{uuid.uuid4().hex}.part", None, None, None
        with open(path, "wb") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                row, col, v, own = (np.asarray(b.column(self.names.index(c))).astype(np.int64) for c in ("row", "col", "v", "image_id"))
                at = (row * self.width + col) * self.channels
                if "ch" in self.names:
                    at = at + np.asarray(b.column(self.names.index("ch")))
                image = int(own[0]) if image is None else image
                steps = np.diff(at if last is None else np.r_[last, at])
                if (steps != 1).any() or (own != image).any() or v.min() < 0 or v.max() > 255:
                    raise ValueError(f"{self.path}: missing or repeated pixels, several images, or values beyond 0..255")
                first, last = int(at[0]) if first is None else first, int(at[-1])
                f.write(v.astype(np.uint8).tobytes())
        if first is None:
            os.remove(path)
            return Piece(-1, -1, "")
        return Piece(first, last, path)

    def commit(self, messages):
        pieces = sorted((m for m in messages if m and m.path), key=lambda m: m.first)
        ends = [-1, *(m.last for m in pieces)]
        if [m.first for m in pieces] != [e + 1 for e in ends[:-1]] or ends[-1] + 1 != self.width * self.height * self.channels:
            self.abort(messages)
            raise ValueError(f"{self.path}: missing or repeated pixels")
        with open(f"{self.path}.{self.run}.part", "wb") as whole:
            for m in pieces:
                with open(m.path, "rb") as f:
                    while block := f.read(1 << 20):
                        whole.write(block)
        os.replace(f"{self.path}.{self.run}.part", self.path)
        self.abort(messages)

    def abort(self, messages):
        for path in glob.glob(f"{glob.escape(self.path)}.{self.run}.*part"):  # also those of tasks that failed
            os.remove(path)


def read_raw(spark, path: str, width: int, height: int, channels: int = 1, image_id: int = 0) -> DataFrame:
    """One large raw file by strips, from a path that every executor can open; see images.read_raw_files for many files and for other stores.

    With spark.sql.python.filterPushdown.enabled set, conditions on row leave out strips."""
    positive_size(width, height, channels)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.dataSource.register(RawRaster)
    return spark.read.format("rawraster").option("path", path).option("width", width).option("height", height).option("channels", channels).option("image_id", image_id).option("prune", prune.lower()).load()


def write_raw(px: DataFrame, path: str) -> None:
    """One image's pixels (long form for colour) as a raw file in row, column, channel order; an empty table, gaps, repeated pixels and several images raise. See images.write_images for one file an image."""
    keys = [c for c in ("row", "col", "ch") if c in px.columns]
    size = px.agg(*[(F.max(c) + 1).alias(c) for c in keys], F.min("image_id").alias("low"), F.max("image_id").alias("high")).collect()[0]
    if size.low is None or size.low != size.high:
        raise ValueError("a raw file holds the pixels of one image")
    px.sparkSession.dataSource.register(RawRaster)
    (px.select("image_id", *keys, F.col("v")).repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.format("rawraster").option("path", path).option("width", size["col"]).option("height", size["row"]).option("channels", size["ch"] if "ch" in keys else 1).mode("append").save())
