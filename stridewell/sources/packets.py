"""Message streams of a header and binary packets, as a Spark data source.

A log holds length-prefixed messages: JSON headers, which may change midway, and
packets of an 8-byte start (ns) and samples.  ``format("packets")`` reads such
logs in batch (one partition a file) and as a stream (new files as they come),
from any file system that all workers see.
"""

from __future__ import annotations

import json
import re
import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Sample types named in headers, and units of steps in seconds.
TYPES = {"short": "<i2", "int": "<i4", "long": "<i8", "float": "<f4", "double": "<f8"}
UNITS = {"s": 0, "ms": 3, "us": 6, "ns": 9}

SCHEMA = "lane long, distance double, start_ns long, step_ns long, samples array<double>"


@dataclass(frozen=True)
class Layout:
    """What a header says of the packets after it."""

    record: np.dtype  # one packet: start and samples by time and channel
    distances: np.ndarray
    step_ns: int

    @classmethod
    def from_header(cls, header: dict) -> Layout:
        """Every region of interest is a ladder of channels, one after the other, ``dx`` apart after decimation."""
        channels, rows = header["nChannels"], header["nPackagesPerMessage"]
        record = np.dtype([("start", "<i8"), ("samples", TYPES[header["dataType"]], (rows, channels))])
        said = header.get("bytesPerPackage")
        if said is not None and 8 + said * rows != record.itemsize:
            raise ValueError(f"{said} bytes a row don't hold {channels} channels of {header['dataType']}")
        ends = [(r["roiStart"] // r["roiDec"], r["roiEnd"] // r["roiDec"]) for r in header["roiTable"]]
        counts = [channels] if len(ends) == 1 else [hi - lo + 1 for lo, hi in ends]
        if sum(counts) != channels:
            counts = [n - 1 for n in counts]  # ends that don't belong to their regions
        if sum(counts) != channels:
            raise ValueError("the regions don't have as many channels as the packets")
        last = [lo + n - 1 if len(ends) > 1 else hi for (lo, hi), n in zip(ends, counts)]
        ladders = [np.linspace(lo, hi, n) for (lo, _), hi, n in zip(ends, last, counts)]
        return cls(record, header["dx"] * np.concatenate(ladders), round(header["dt"] * 10 ** (9 - UNITS[header["dtUnit"]])))

    def rows(self, packet: bytes) -> Iterator[tuple]:
        (found,) = np.frombuffer(packet, self.record)
        for lane, (distance, samples) in enumerate(zip(self.distances.tolist(), found["samples"].T)):
            yield lane, distance, int(found["start"]), self.step_ns, samples.astype(float).tolist()


def as_header(message: bytes) -> dict | None:
    """The header that a message is, by what it holds; None for packets, whatever their bytes."""
    if message[:1] != b"{":
        return None
    try:
        found = json.loads(message)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "nChannels" in found else None


class Decoder:
    """Keeps the layout in force; yields rows of packets."""

    layout: Layout | None = None

    def feed(self, message: bytes) -> Iterator[tuple]:
        header = as_header(message)
        if header is not None:
            self.layout = Layout.from_header(header)
        elif self.layout is None:
            warnings.warn("packets before the first header are left out", stacklevel=2)
        elif len(message) != self.layout.record.itemsize:
            warnings.warn(f"a packet of {len(message)} bytes in place of {self.layout.record.itemsize} is left out", stacklevel=2)
        else:
            yield from self.layout.rows(message)


def header_for(n_samples: int, n_channels: int, kind: str, dt: float, unit: str = "s", dx: float = 1.0) -> dict:
    return {"bytesPerPackage": np.dtype(TYPES[kind]).itemsize * n_channels, "nPackagesPerMessage": n_samples, "nChannels": n_channels, "dataType": kind,
            "dx": dx, "dt": dt, "dtUnit": unit, "dxUnit": "m", "roiTable": [{"roiStart": 0, "roiEnd": n_channels - 1, "roiDec": 1}]}


def encode_packet(start_ns: int, data: np.ndarray, kind: str) -> bytes:
    return struct.pack("<q", start_ns) + np.ascontiguousarray(data, TYPES[kind]).tobytes()


def write_log(path: str, messages: list[bytes]) -> None:
    """A local log, which appears whole under its name."""
    import os

    part = f"{path}.part"
    with open(part, "wb") as f:
        for m in messages:
            f.write(struct.pack("<I", len(m)) + m)
    os.rename(part, path)


def listed(pattern: str) -> list[str]:
    """Files of a path pattern (``*``, ``?`` and ``[...]`` within a level), on any file system."""
    from pyarrow import fs

    from .opening import located

    levels = pattern.split("/")
    fixed = next((k for k, level in enumerate(levels) if re.search(r"[*?\[]", level)), len(levels) - 1)
    base, wanted = "/".join(levels[:fixed]) or "/", levels[fixed:]
    system, inner = located(base)
    found = []
    for info in system.get_file_info(fs.FileSelector(inner, recursive=len(wanted) > 1, allow_not_found=True)):
        below = info.path[len(inner.rstrip("/")) + 1 :].split("/")
        if info.type == fs.FileType.File and len(below) == len(wanted) and all(map(fnmatchcase, below, wanted)):
            found.append("/".join([base.rstrip("/"), *below]))
    return sorted(found)


def read_log(path: str) -> Iterator[tuple]:
    from .opening import file_of

    decoder = Decoder()
    with file_of(path) as f:
        while prefix := f.read(4):
            yield from decoder.feed(f.read(struct.unpack("<I", prefix)[0]))


class _Log(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = listed(options["path"])

    def partitions(self):
        return [_Log(p) for p in self.paths]

    def read(self, partition):
        return read_log(partition.path) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    """The offset is the set of files seen, so files may come late under any name.

    Offsets of earlier checkpoints, which had the last file's name only, are
    taken as all names up to it.
    """

    def __init__(self, options):
        self.pattern = options["path"]
        self.seen: set[str] = set()

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        self.seen.update(listed(self.pattern))
        return {"files": sorted(self.seen)}

    def partitions(self, start, end):
        files = end["files"] if "files" in end else [p for p in listed(self.pattern) if p <= end["last"]]
        self.seen.update(start.get("files", []), files)
        done, last = set(start.get("files", [])), start.get("last", "")
        return [_Log(p) for p in files if p not in done and p > last]

    def read(self, partition):
        return read_log(partition.path)


class PacketSource(DataSource):
    @classmethod
    def name(cls):
        return "packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
