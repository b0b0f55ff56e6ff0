"""The container file: header, static section, independently readable frame groups, keys before deltas.

Layout (fixed values of the format): magic, version 1, flags (bit 0: denoised), length of the JSON header, the header, the static section of ten streams, then a chunk
a group: a 16-bit count, all stream headers, all payloads. A stream header is attribute, kind (0 key, 1 delta, 2 static), width, element count and
compressed length, 11 bytes. Offsets in the header are absolute, so its own length is found by iteration to a fixed point.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackloom.functions.arrow import compress, decompress, plane_entropy, planes, unplanes
from trackloom.sources.splat import pushed

MAGIC, VERSION = b"SP4D", 1
HEAD, STREAM = struct.Struct("<4sHHI"), struct.Struct("<BBBII")
STATIC_NAMES = ("mask_pos", "mask_rot", "mask_rgb", "mask_alpha", "mask_scale", "base_pos", "base_scale", "base_rgb", "base_alpha", "base_rot")
KEY, DELTA, STATIC = 0, 1, 2


def width_of(symbols: np.ndarray) -> int:
    most = int(symbols.max(initial=0))
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def pack_stream(attr: int, kind: int, symbols: np.ndarray, level: int) -> dict:
    width = width_of(symbols)
    raw = planes(symbols, width)
    payload = compress(raw, level)
    return {"attr": attr, "kind": kind, "width": width, "elems": len(symbols), "raw_bytes": len(raw), "entropy_bytes": plane_entropy(raw), "payload": payload}


def stream_head(s: dict) -> bytes:
    return STREAM.pack(s["attr"], s["kind"], s["width"], s["elems"], len(s["payload"]))


def unpack_payload(payload: bytes, width: int, elems: int) -> np.ndarray:
    return unplanes(decompress(payload, width * elems), width) if elems else np.zeros(0, np.int64)


def read_stream(data: bytes, at: int) -> tuple[dict, int]:
    attr, kind, width, elems, size = STREAM.unpack_from(data, at)
    end = at + STREAM.size + size
    if end > len(data):
        raise ValueError("a stream is cut short")
    return {"attr": attr, "kind": kind, "width": width, "elems": elems, "symbols": unpack_payload(data[at + STREAM.size : end], width, elems)}, end


def chunk(streams: list[dict]) -> bytes:
    """Keys first, the order of attributes kept."""
    ordered = sorted(streams, key=lambda s: s["kind"])
    return struct.pack("<H", len(ordered)) + b"".join(map(stream_head, ordered)) + b"".join(s["payload"] for s in ordered)


def keys_length(head: bytes) -> int:
    """Bytes of a chunk that hold its heads and keys."""
    (n,) = struct.unpack_from("<H", head)
    heads = [STREAM.unpack_from(head, 2 + k * STREAM.size) for k in range(n)]
    return 2 + n * STREAM.size + sum(h[4] for h in heads if h[1] == KEY)


def read_chunk(data: bytes, keys_only: bool = False) -> list[dict]:
    (n,) = struct.unpack_from("<H", data)
    at, out = 2 + n * STREAM.size, []
    for k in range(n):
        attr, kind, width, elems, size = STREAM.unpack_from(data, 2 + k * STREAM.size)
        if keys_only and kind != KEY:
            break
        if at + size > len(data):
            raise ValueError("a chunk is cut short")
        out.append({"attr": attr, "kind": kind, "width": width, "elems": elems, "comp_bytes": size + STREAM.size, "symbols": unpack_payload(data[at : at + size], width, elems)})
        at += size
    return out


def header_bytes(header: dict, static: int, chunks: list[dict], denoised: bool) -> bytes:
    """chunks: dicts with len, f0, f1, t0, t1, in order."""
    size = 0
    while True:
        at = HEAD.size + size + static
        gops = []
        for c in chunks:
            gops.append({"offset": at, **c})
            at += c["len"]
        text = json.dumps(header | {"denoised": denoised, "static_section": {"offset": HEAD.size + size, "len": static}, "gops": gops}, separators=(",", ":")).encode()
        if len(text) == size:
            return HEAD.pack(MAGIC, VERSION, int(denoised), size) + text
        size = len(text)


def read_header(path: str) -> dict:
    with open(path, "rb") as f:
        head = f.read(HEAD.size)
        if len(head) < HEAD.size:
            raise ValueError("not a container")
        magic, version, _, size = HEAD.unpack(head)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a container of this version")
        return json.loads(f.read(size))


def read_range(path: str, at: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(size)
    if len(data) < size:
        raise ValueError("the file is cut short")
    return data


def read_static(path: str) -> dict[str, np.ndarray]:
    span = read_header(path)["static_section"]
    data, at, out = read_range(path, span["offset"], span["len"]), 0, {}
    for name in STATIC_NAMES:
        s, at = read_stream(data, at)
        out[name] = s["symbols"]
    if at != len(data):
        raise ValueError("the static section has bytes to spare")
    return out


class GopPartition(InputPartition):
    def __init__(self, gop: int, offset: int, size: int, keys_only: bool):
        self.gop, self.offset, self.size, self.keys_only = gop, offset, size, keys_only


class GopReader(DataSourceReader):
    """Rows (gop, attr, kind, pos, sym). A filter on gop prunes partitions; kind = 0 reads only the chunks' prefixes."""

    def __init__(self, path: str):
        self.path, self.gops, self.kinds = path, [], []

    def pushFilters(self, filters):
        yield from pushed(pushed(filters, "gop", self.gops), "kind", self.kinds)

    def partitions(self):
        keys_only = bool(self.kinds) and not all(test(DELTA, v) for test, v in self.kinds)
        return [GopPartition(k, g["offset"], g["len"], keys_only) for k, g in enumerate(read_header(self.path)["gops"]) if all(test(k, v) for test, v in self.gops)]

    def read(self, partition):
        size = partition.size
        if partition.keys_only:
            (n,) = struct.unpack("<H", read_range(self.path, partition.offset, 2))
            size = keys_length(read_range(self.path, partition.offset, 2 + n * STREAM.size))
        for s in read_chunk(read_range(self.path, partition.offset, size), partition.keys_only):
            if all(test(s["kind"], v) for test, v in self.kinds):
                n = s["elems"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int64)) for v in (partition.gop, s["attr"], s["kind"])] + [pa.array(np.arange(n)), pa.array(s["symbols"].astype(np.int64))], ["gop", "attr", "kind", "pos", "sym"])


class ContainerSource(DataSource):
    """spark.read.format("trackpack").load(file)."""

    @classmethod
    def name(cls):
        return "trackpack"

    def schema(self):
        return "gop long, attr long, kind long, pos long, sym long"

    def reader(self, schema):
        return GopReader(self.options["path"])


def register(spark) -> None:
    from trackloom.session import ship
    from trackloom.sources.splat import SplatSource

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SplatSource)
    spark.dataSource.register(ContainerSource)
