"""Frame stacks as a Spark data source: pixels of recorded frames, in batch and on a stream.

A stack is a ``.npy`` file of shape (frames, height, width) or (frames, height, width, 3); its name without ending is the
video. ``register`` it and read with format ``frame_stacks``:

    register(spark)
    spark.read.format("frame_stacks").option("path", folder).option("skip", 3).load()

Options: ``path`` (a folder or file that executors reach), ``skip`` (every so many frames, counted from 1), ``seconds`` and ``fps``
(only the first seconds; all when the rate is 0), ``first`` and ``last`` (frames, in batch ``first`` too), ``frames`` (frames of a partition), ``frames_per_batch`` (of each
stack, on a stream). Frames that the options leave out are never read: files are mapped, and only pages of wanted frames
are touched. Filters are not taken from Spark: in this version of it a source that takes one keeps it for later reads of
the same DataFrame. Batches are Arrow batches of one frame.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "video_id string, frame_id bigint, y int, x int, b int, g int, r int, gray int"
#: Weights of blue, green and red in a grey level.
GRAY = (0.114, 0.587, 0.299)


@dataclass
class Frames(InputPartition):
    path: str
    first: int  # frames count from 1
    last: int
    skip: int


def stacks_of(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".npy"))
    return [path]


def pixels_of(part: Frames) -> Iterator[pa.RecordBatch]:
    stack = np.load(part.path, mmap_mode="r")
    video = os.path.basename(part.path).removesuffix(".npy")
    height, width = stack.shape[1:3]
    y, x = (a.ravel().astype(np.int32) for a in np.indices((height, width)))
    for frame in range(-(-part.first // part.skip) * part.skip, part.last + 1, part.skip):
        image = np.asarray(stack[frame - 1])
        b, g, r = (image[..., c].ravel().astype(np.int32) for c in range(3)) if image.ndim == 3 else [image.ravel().astype(np.int32)] * 3
        gray = np.floor(GRAY[0] * b + GRAY[1] * g + GRAY[2] * r + 0.5).astype(np.int32) if image.ndim == 3 else b
        n = len(y)
        yield pa.RecordBatch.from_arrays([pa.array([video] * n, pa.string()), pa.array(np.full(n, frame)), *map(pa.array, (y, x, b, g, r, gray))], [c.split()[0] for c in SCHEMA.split(", ")])


class _Options:
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("frame_stacks needs a path")
        self.skip, self.frames = int(options.get("skip", 1)), int(options.get("frames", 64))
        self.per_batch = int(options.get("frames_per_batch", 64))
        seconds, fps = float(options.get("seconds", 0)), float(options.get("fps", 0))
        self.first = max(1, int(options.get("first", 1)))
        ends = [int(options["last"])] if "last" in options else []
        self.most = min([*ends, int(seconds * fps)] if seconds and fps else ends, default=None)
        if self.skip < 1 or self.frames < 1 or self.per_batch < 1:
            raise ValueError("skip, frames and frames_per_batch are at least 1")

    def length(self, path: str) -> int:
        n = len(np.load(path, mmap_mode="r"))
        return n if self.most is None else min(n, self.most)


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[Frames]:
        o, out = self.options, []
        for path in stacks_of(o.path):
            last = o.length(path)
            out += [Frames(path, first, min(first + o.frames - 1, last), o.skip) for first in range(o.first, last + 1, o.frames)]
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        return pixels_of(partition)


class StackStreamReader(DataSourceStreamReader):
    """The offset is a number of frames, up to which every stack was read."""

    def __init__(self, options: dict):
        self.options, self.at = _Options(options), 0

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        longest = max((self.options.length(p) for p in stacks_of(self.options.path)), default=0)
        self.at = min(longest, self.at + self.options.per_batch)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self.at = max(self.at, end["frame"])
        out = []
        for path in stacks_of(self.options.path):
            last = min(end["frame"], self.options.length(path))
            if last > start["frame"]:
                out.append(Frames(path, start["frame"] + 1, last, self.options.skip))
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        return pixels_of(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FrameStacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_stacks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StackReader:
        return StackReader(self.options)

    def streamReader(self, schema: StructType) -> StackStreamReader:
        return StackStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FrameStacks)
