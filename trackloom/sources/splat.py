"""Directories of fixed-width frames: a data source, its writer, and the manifest.

A frame is a file of 32-byte little-endian records: three float32 positions, three float32 linear scales, four bytes of colour and
opacity, four bytes of a quaternion (w, x, y, z; value * 128 + 128). The order of frames is that of the manifest `frames.json`, else of the
file names. One partition reads one frame; a filter on `frame` prunes partitions.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed value: the record's layout.
RECORD = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])
SCHEMA = "frame int, splat_id int, x float, y float, z float, sx float, sy float, sz float, r smallint, g smallint, b smallint, a smallint, q0 smallint, q1 smallint, q2 smallint, q3 smallint"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"int": pa.int32(), "float": pa.float32(), "smallint": pa.int16()}
DEFAULT_FPS = 30.0


def manifest(path: str) -> dict | None:
    at = os.path.join(path, "frames.json")
    if not os.path.exists(at):
        return None
    with open(at) as f:
        return json.load(f)


def frame_files(path: str) -> list[str]:
    m = manifest(path)
    names = [f["file"] for f in m["frames"]] if m else sorted(n for n in os.listdir(path) if n.endswith(".splat"))
    if not names:
        raise ValueError(f"{path} has no frames")
    return [os.path.join(path, n) for n in names]


def fps(path: str, given: float | None = None) -> float:
    """The manifest's rate; without one the given rate, else 30."""
    m = manifest(path)
    return float(m["fps"]) if m else float(given or DEFAULT_FPS)


def checked(files: list[str]) -> int:
    """Points of a frame; every file must be a whole number of records, and all equally long."""
    sizes = [os.stat(f).st_size for f in files]
    for f, size in zip(files, sizes):
        if size % RECORD.itemsize:
            raise ValueError(f"{f}: {size} bytes aren't a whole number of records")
        if size != sizes[0]:
            raise ValueError(f"{f}: frames differ in their number of points")
    return sizes[0] // RECORD.itemsize


def records(data: bytes, frame: int) -> pa.RecordBatch:
    r = np.frombuffer(data, RECORD)
    n = len(r)
    cols = [np.full(n, frame, np.int32), np.arange(n, dtype=np.int32), *(r["p"][:, k] for k in range(3)), *(r["s"][:, k] for k in range(3)), *(r["c"][:, k].astype(np.int16) for k in range(4)), *(r["q"][:, k].astype(np.int16) for k in range(4))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], COLUMNS)


def packed(table: dict[str, np.ndarray]) -> bytes:
    out = np.empty(len(table["x"]), RECORD)
    for name, cols in (("p", "xyz"), ("s", ("sx", "sy", "sz")), ("c", "rgba"), ("q", ("q0", "q1", "q2", "q3"))):
        for k, c in enumerate(cols):
            out[name][:, k] = table[c]
    return out.tobytes()


class FramePartition(InputPartition):
    def __init__(self, frame: int, file: str):
        self.frame, self.file = frame, file


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def pushed(filters, column: str, kept: list):
    """Yields the filters that Spark must still apply; those on `column` are kept as tests of its value."""
    for f in filters:
        test = _TESTS.get(type(f))
        if test and f.attribute == (column,):
            kept.append((test, f.value))
        else:
            yield f


class SplatReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        yield from pushed(filters, "frame", self.tests)

    def partitions(self):
        files = frame_files(self.path)
        checked(files)
        return [FramePartition(k, f) for k, f in enumerate(files) if all(test(k, v) for test, v in self.tests)]

    def read(self, partition):
        with open(partition.file, "rb") as f:
            yield records(f.read(), partition.frame)


class SplatWriter(DataSourceArrowWriter):
    """Rows of a frame must lie in one partition, in file order (repartition by frame, sort within). Tasks write aside; the commit renames."""

    def __init__(self, path: str, rate: float):
        self.path, self.rate, self.aside = path, rate, os.path.join(path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator):
        os.makedirs(self.aside, exist_ok=True)
        found: dict[int, list] = {}
        for batch in iterator:
            frames = batch.column("frame").to_numpy()
            table = {c: batch.column(c).to_numpy() for c in COLUMNS[2:]}
            for k in np.unique(frames):
                found.setdefault(int(k), []).append(packed({c: v[frames == k] for c, v in table.items()}))
        for k, parts in found.items():
            with open(os.path.join(self.aside, f"frame_{k:04d}.splat"), "wb") as f:
                f.write(b"".join(parts))
        message = WriterCommitMessage()
        message.frames = sorted(found)
        return message

    def commit(self, messages):
        frames = sorted(k for m in messages if m for k in m.frames)
        if len(frames) != len(set(frames)):
            self.abort(messages)
            raise ValueError("a frame lies in more than one partition")
        for k in frames:
            os.replace(os.path.join(self.aside, f"frame_{k:04d}.splat"), os.path.join(self.path, f"frame_{k:04d}.splat"))
        shutil.rmtree(self.aside, ignore_errors=True)
        with open(os.path.join(self.path, "frames.json"), "w") as f:
            json.dump({"fps": self.rate, "count": len(frames), "frames": [{"file": f"frame_{k:04d}.splat", "timestamp": k / self.rate} for k in frames]}, f)

    def abort(self, messages):
        shutil.rmtree(self.aside, ignore_errors=True)


class SplatSource(DataSource):
    """spark.read.format("splat").load(directory); df.write.format("splat").mode("append").save(directory)."""

    @classmethod
    def name(cls):
        return "splat"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SplatReader(self.options["path"])

    def writer(self, schema, overwrite):
        os.makedirs(self.options["path"], exist_ok=True)
        return SplatWriter(self.options["path"], float(self.options.get("fps", DEFAULT_FPS)))


def sequences(root: str) -> list[str]:
    """Names of the directories with a manifest, lower-case letters, digits and underscores only."""
    import re

    return sorted(n for n in os.listdir(root) if re.fullmatch("[a-z0-9_]+", n) and os.path.exists(os.path.join(root, n, "frames.json")))
