"""File engines: how instruments lay out their files, and opening many of them.

An engine turns one file into (array, coordinates).  Engines for HDF5 work on
anything that looks like an open file (groups by key, ``attrs``), so they need
h5py only to open real ones.  Opening files is distributed: paths are listed by
Spark, headers are read in tasks, and only the headers (one row a file) are
combined; samples stay in tasks.
"""

from __future__ import annotations

import fnmatch
import io
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import coords as C
from ..setops import combine_bags
from . import tdms


@dataclass
class Opened:
    data: np.ndarray
    time: C.Coordinate
    distance: C.Coordinate
    name: str | None = None


class Engine:
    """Base: ``decode`` gets the file's bytes."""

    name = ""
    registry: dict[str, type[Engine]] = {}

    def __init_subclass__(cls, aliases: tuple[str, ...] = (), **kwargs):
        super().__init_subclass__(**kwargs)
        for n in (cls.name, *aliases):
            Engine.registry[n] = cls

    def decode(self, raw: bytes, **options) -> Opened:
        raise NotImplementedError

    def read(self, file, rows: slice = slice(None), columns: slice = slice(None), head: bool = False, **options) -> Opened:
        """From an open file; ``head``: coordinates only."""
        return _part(self.decode(file.read(), **options), rows, columns, head)


def _part(opened: Opened, rows: slice, columns: slice, head: bool) -> Opened:
    opened.data = None if head else np.asarray(opened.data[rows, columns])
    return opened


def _utc_ns(text) -> int:
    text = text.decode() if isinstance(text, bytes) else str(text)
    t = pd.Timestamp(text)
    return int((t.tz_convert("UTC") if t.tzinfo else t.tz_localize("UTC")).value)


class Hdf5Engine(Engine):
    def decode(self, raw: bytes, **options) -> Opened:
        try:
            import h5py
        except ImportError as e:
            raise ImportError("h5py is needed to open HDF5 files") from e
        with h5py.File(io.BytesIO(raw), "r") as f:
            return _part(self.decode_tree(f, **options), slice(None), slice(None), False)

    def read(self, file, rows=slice(None), columns=slice(None), head=False, **options):
        """Only the part asked for is read: arrays stay in the file until then."""
        try:
            import h5py
        except ImportError as e:
            raise ImportError("h5py is needed to open HDF5 files") from e
        with h5py.File(file, "r") as f:
            return _part(self.decode_tree(f, **options), rows, columns, head)

    def decode_tree(self, f, **options) -> Opened:
        raise NotImplementedError


class OptoEngine(Hdf5Engine):
    """Regions of interest become the pieces of the distance axis."""

    name = "asn"

    def decode_tree(self, f):
        header, sensors = f["header"], np.asarray(f["cableSpec"]["sensorDistances"])
        dx, data = float(np.asarray(header["dx"])), f["data"]
        step = round(1e9 * float(np.asarray(header["dt"])))
        ties: list[int] = []
        for lo, hi in zip(np.asarray(f["demodSpec"]["roiStart"]), np.asarray(f["demodSpec"]["roiEnd"])):
            first, last = bisect_left(sensors, lo * dx), bisect_right(sensors, hi * dx) - 1
            if first >= len(sensors) or last < 0:
                raise IndexError("a region lies outside the sensor distances")
            ties += [first, last]
        time = C.Sampled(np.array([round(float(np.asarray(header["time"])) * 1e9)]), [len(data)], step, "time", True)
        return Opened(data, time, C.Interp(ties, sensors[ties].astype(float), "distance"))


class FebusEngine(Hdf5Engine):
    """Overlapping blocks: trimmed and laid end to end, stamped at an offset in each block."""

    name = "febus"

    def decode_tree(self, f, overlaps: tuple[int, int] | None = None, offset: int | None = None):
        (device,) = list(f.keys())
        source = f[device]["Source1"]
        zone = source["Zone1"]
        key = "BlockRate" if "BlockRate" in zone.attrs else "FreqRes"
        if key not in zone.attrs:
            raise KeyError("neither BlockRate nor FreqRes is given")
        (name,) = list(zone.keys())
        blocks, stamps = np.asarray(zone[name]), np.asarray(source["time"], float)
        dt, dx = zone.attrs["Spacing"][1] / 1000, zone.attrs["Spacing"][0]
        if overlaps is None:
            warnings.warn("overlaps are guessed from the block rate", stacklevel=2)
            extra = blocks.shape[1] - round(1000 / zone.attrs[key][0] / dt)
            overlaps = (extra // 2, extra - extra // 2)
        if offset is None:
            warnings.warn("the place of the time stamp is guessed", stacklevel=2)
            offset = blocks.shape[1] // 2
        kept = blocks[:, overlaps[0] : blocks.shape[1] - overlaps[1], :]
        starts = np.rint(1e6 * (stamps + (overlaps[0] - offset) * dt)).astype(np.int64) * 1000
        time = C.Sampled(starts, [kept.shape[1]] * len(kept), int(np.rint(1e6 * dt)) * 1000, "time", True).simplify(0)
        x0 = zone.attrs["Extent"][0] * dx + zone.attrs["Origin"][0]
        snake = re.sub(r"(?=[A-Z])", "_", name).lower().lstrip("_")
        return Opened(kept.reshape(-1, kept.shape[2]), time, C.Interp.from_block(float(x0), kept.shape[2], float(dx), "distance"), snake)


class _Turned:
    """A stored array with its two dims swapped; parts of it are read as parts."""

    def __init__(self, stored):
        self.stored, self.shape = stored, stored.shape[::-1]

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, key):
        rows, columns = key
        return np.asarray(self.stored[columns, rows]).T

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self[:, :], dtype)


class ProdmlEngine(Hdf5Engine, aliases=("optasense", "sintela")):
    name = "prodml"

    def decode_tree(self, f, swapped_dims: bool = False):
        acquisition = f["Acquisition"]
        raw = acquisition["Raw[0]"]["RawData"]
        data = _Turned(raw) if swapped_dims else raw
        dx = float(acquisition.attrs["SpatialSamplingInterval"])
        n, m = data.shape
        ends = [_utc_ns(raw.attrs["PartStartTime"]), _utc_ns(raw.attrs["PartEndTime"])]
        time = C.Interp([0, n - 1] if n > 1 else [0], ends if n > 1 else ends[:1], "time", True)
        return Opened(data, time, C.Interp.from_block(dx * float(acquisition.attrs["StartLocusIndex"]), m, dx, "distance"))


class Terra15Engine(Hdf5Engine):
    name = "terra15"

    def decode_tree(self, f, tz: str = "UTC"):
        product = f["data_product"]
        stamps, data = np.asarray(product["gps_time"], float), product["data"]
        ends = [int(pd.Timestamp(s, unit="s", tz=tz).value) for s in (stamps[0], stamps[-1])]
        time = C.Interp([0, len(data) - 1] if len(data) > 1 else [0], ends if len(data) > 1 else ends[:1], "time", True)
        return Opened(data, time, C.Interp.from_block(float(f.attrs["sensing_range_start"]), data.shape[1], float(f.attrs["dx"]), "distance"))


class ApSensingEngine(Hdf5Engine):
    name = "apsensing"

    def decode_tree(self, f):
        start = np.asarray(f["Metadata"]["Timestamp"]).item()
        start = start.decode() if isinstance(start, bytes) else start
        if not start.endswith("Z"):
            raise NotImplementedError("only UTC time stamps are supported")
        server, data = f["ProcessingServer"], f["DAS"]
        step = round(1e9 / np.asarray(server["DataRate"]).item())
        time = C.Sampled(np.array([_utc_ns(start)]), [len(data)], step, "time", True)
        dx = float(np.asarray(server["SpatialSampling"]).item())
        return Opened(data, time, C.Interp.from_block(float(np.asarray(f["DAQ"]["PositionStart"]).item()), data.shape[1], dx, "distance"))


class SilixaEngine(Engine):
    name = "silixa"

    def decode(self, raw: bytes):
        f = tdms.parse(raw)
        p, data = f.root(), f.array()
        start = p["GPSTimeStamp"]
        start = start if isinstance(start, int) else _utc_ns(start)
        time = C.Sampled(np.array([start]), [len(data)], round(1e9 / p["SamplingFrequency[Hz]"]), "time", True)
        dx = p["Fibre Length Multiplier"] * p["SpatialResolution[m]"]
        return Opened(data, time, C.Interp.from_block(float(p["Start Distance (m)"]), data.shape[1], float(dx), "distance"))


def decode_any(raw: bytes, first: str | None = None, **options) -> tuple[str, Opened]:
    """Probe: TDMS by its tag, else each HDF5 engine, the last one that worked first."""
    names = ["silixa"] if raw[:4] == b"TDSm" else sorted({n for n in Engine.registry if n != "silixa"}, key=lambda n: n != first)
    for name in names:
        try:
            return name, Engine.registry[name]().decode(raw, **options)
        except ImportError:
            raise
        except Exception:  # noqa: BLE001 - another engine may know it
            continue
    raise ValueError("no engine can read this file")


def open_file(file, engine: str | Callable | None, last: str | None, rows: slice = slice(None), columns: slice = slice(None), head: bool = False, **options) -> tuple[str | None, Opened]:
    """An open file by a named engine, a function of its bytes, or a probe that begins with the engine that worked last."""
    if callable(engine):
        return None, _part(engine(file.read(), **options), rows, columns, head)
    if engine is None:
        tag = file.read(4)
        names = ["silixa"] if tag == b"TDSm" else sorted({e.name for e in Engine.registry.values() if e.name != "silixa"}, key=lambda n: n != last)
    else:
        names = [engine]
    for name in names:
        file.seek(0)
        try:
            return name, Engine.registry[name]().read(file, rows, columns, head, **options)
        except ImportError:
            raise
        except Exception:
            if engine is not None:
                raise
    raise ValueError("no engine can read this file")


_BLOCKS = "path string, name string, distance__i long, distance double, start_ns long, step_ns long, i0 long, samples array<double>"


def open_files(spark: SparkSession, paths: str | list[str], engine: str | Callable | None = None, on_error: str = "warn", **options) -> DataFrame:
    """Files as packed blocks: one row a file, channel and continuous stretch.

    ``engine``: a name, a function of (bytes) giving :class:`Opened`, or None to
    probe.  Corrupt files are skipped (``on_error='raise'`` fails).  Every file is
    one task's work.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    if callable(engine):
                        f = engine(bytes(content), **options)
                    elif engine:
                        f = Engine.registry[engine]().decode(bytes(content), **options)
                    else:
                        last, f = decode_any(bytes(content), last, **options)
                except Exception as e:
                    if on_error == "raise" or isinstance(e, ImportError):
                        raise
                    warnings.warn(f"{path} is skipped: {e}", stacklevel=2)
                    continue
                labels = f.distance.values()
                step = int(round(f.time.sampling_interval(cast=False) or 0))
                cuts = [0, *f.time.split_indices("discontinuities", 0).tolist(), f.time.size]
                rows = [
                    (path, f.name, x, float(labels[x]), int(f.time.label(np.array([lo]))[0]), step, lo, f.data[lo:hi, x].astype(float))
                    for lo, hi in zip(cuts, cuts[1:])
                    for x in range(f.data.shape[1])
                ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    return files.mapInPandas(run, _BLOCKS)


def template_pattern(template: str) -> str:
    """A pattern of paths with a group for each field."""
    pieces = re.split(r"([{\[]\w+[}\]]|\*)", template)
    return "".join(f"(?P<{m[1:-1]}>[^/]+)" if re.fullmatch(r"[{\[]\w+[}\]]", m) else "[^/]*" if m == "*" else re.escape(m) for m in pieces)


def open_tree(spark: SparkSession, template: str, **options) -> DataFrame:
    """Files of a path template: ``{field}`` names a mapping level, ``[field]`` a sequence level.

    Adds a column for each field: text, or the place in path order (a dense rank
    within the mapping fields) for sequences.
    """
    fields = re.findall(r"[{\[](\w+)[}\]]", template)
    sequences = re.findall(r"\[(\w+)\]", template)
    plain = re.sub(r"\(\?P<\w+>", "(", template_pattern(template))
    df = open_files(spark, re.sub(r"[{\[]\w+[}\]]", "*", template), **options)
    for k, name in enumerate(fields):
        df = df.withColumn(name, F.regexp_extract("path", plain + "$", k + 1))
    from pyspark.sql import Window

    if not sequences:
        return df
    # files are numbered from their paths, one row each, not from their samples
    listed = spark.read.format("binaryFile").load(re.sub(r"[{\[]\w+[}\]]", "*", template)).select("path")
    for k, name in enumerate(fields):
        listed = listed.withColumn(name, F.regexp_extract("path", plain + "$", k + 1))
    for name in sequences:
        w = Window.partitionBy(*[x for x in fields if x not in sequences]).orderBy(name)
        listed = listed.withColumn(f"__{name}", (F.dense_rank().over(w) - 1).cast("int"))
    df = df.drop(*sequences).join(listed.select("path", *[f"__{name}" for name in sequences]), "path")
    return df.withColumnsRenamed({f"__{name}": name for name in sequences})


def combine(blocks: DataFrame, tolerance_ns: int = 0) -> DataFrame:
    """Bags of compatible files along time, as :func:`combine_bags`, on one row a file."""
    heads = blocks.groupBy("path").agg(
        F.min("start_ns").alias("start"), F.min("step_ns").alias("step"), F.count_distinct("distance__i").alias("channels"), F.min("distance").alias("x0")
    )
    return combine_bags(heads, ["step", "channels", "x0"], "start")


def match_paths(names: list[str], pattern: str) -> list[str]:
    return sorted(n for n in names if fnmatch.fnmatchcase(n, pattern))
