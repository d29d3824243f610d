"""miniSEED 2 records, from the published SEED layout.

A file is a row of records of a power-of-two length: a fixed header, blockettes
(1000: encoding, byte order and length; 1001: microseconds) and samples as
integers, floats or Steim-compressed differences.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings that are plain arrays.
PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
STEIM1, STEIM2 = 10, 11

TRACES = "path string, network string, station string, location string, channel string, start_ns long, delta double, samples array<double>"


def _start_ns(raw: bytes, order: str, tenths_us: int, extra_us: int) -> int:
    year, day, hour, minute, second, _, _ = struct.unpack_from(order + "HHBBBBH", raw, 20)
    t = datetime(year, 1, 1, hour, minute, 0, tzinfo=timezone.utc) + timedelta(days=day - 1, seconds=second)
    return int(t.timestamp()) * 1_000_000_000 + tenths_us * 100_000 + extra_us * 1000


def _rate(factor: int, multiplier: int) -> float:
    if not factor:
        return 0.0
    f = float(factor) if factor > 0 else -1.0 / factor
    return f * multiplier if multiplier > 0 else f / -multiplier if multiplier else f


def records(data: bytes) -> Iterator[tuple]:
    """(network, station, location, channel, start_ns, rate, samples) of each record."""
    at = 0
    while at + 48 <= len(data):
        raw = memoryview(data)[at:]
        year = struct.unpack_from(">H", raw, 20)[0]
        order = ">" if 1900 <= year <= 2100 else "<"
        station, location, channel, network = (x.decode("ascii").strip() for x in struct.unpack_from("5s2s3s2s", raw, 8))
        fraction, count, factor, multiplier = struct.unpack_from(order + "HHhh", raw, 28)
        correction = struct.unpack_from(order + "i", raw, 40)[0]
        begin, blockette = struct.unpack_from(order + "HH", raw, 44)
        encoding, words, length, micro = None, order, 0, 0
        while blockette:
            kind, after = struct.unpack_from(order + "HH", raw, blockette)
            if kind == 1000:
                encoding, big, power = struct.unpack_from("BBB", raw, blockette + 4)
                words, length = ">" if big else "<", 1 << power
            elif kind == 1001:
                micro = struct.unpack_from("b", raw, blockette + 5)[0]
            blockette = after if after > blockette else 0
        if encoding is None:
            raise ValueError("a record has no data encoding")
        applied = raw[36] & 2
        start = _start_ns(raw, order, fraction + (0 if applied else correction), micro)
        yield network, station, location, channel, start, _rate(factor, multiplier), _samples(raw[begin:length], encoding, words, count)
        at += length


def _samples(raw: bytes, encoding: int, order: str, count: int) -> np.ndarray:
    if encoding in PLAIN:
        return np.frombuffer(raw, order + PLAIN[encoding], count).astype(float)
    if encoding in (STEIM1, STEIM2):
        return _steim(raw, order, count, encoding)
    raise ValueError(f"encoding {encoding} isn't supported")


def _fields(word: int, bits: int, n: int) -> list[int]:
    half, mask = 1 << (bits - 1), (1 << bits) - 1
    return [((word >> bits * (n - 1 - k)) & mask ^ half) - half for k in range(n)]


#: Fixed values: (bits, differences) by code, and by code and sub-code.
_ONE = {1: (8, 4), 2: (16, 2), 3: (32, 1)}
_TWO = {(2, 1): (30, 1), (2, 2): (15, 2), (2, 3): (10, 3), (3, 0): (6, 5), (3, 1): (5, 6), (3, 2): (4, 7)}


def _steim(raw: bytes, order: str, count: int, encoding: int) -> np.ndarray:
    """First value, last value and differences in frames of sixteen words."""
    words = np.frombuffer(raw[: len(raw) // 64 * 64], order + "u4")
    differences: list[int] = []
    first = last = 0
    for frame in words.reshape(-1, 16).tolist():
        for k in range(1, 16):
            code = frame[0] >> (30 - 2 * k) & 3
            word = frame[k]
            if not code:
                continue
            spec = _ONE.get(code) if encoding == STEIM1 or code == 1 else _TWO.get((code, word >> 30))
            if spec is None:
                raise ValueError("a damaged frame")
            differences += _fields(word, *spec)
    if len(words) >= 3:
        first, last = (int(np.int32(np.uint32(w))) for w in words[1:3])
    values = first + np.cumsum(np.array([0, *differences[1:count]], np.int64)) if count else np.zeros(0)
    if count and int(values[-1]) != last:
        raise ValueError("the last value doesn't agree")
    return values.astype(float)


def traces(data: bytes) -> list[tuple]:
    """Records of a channel that follow each other joined (half a sample of slack)."""
    out: list[list] = []
    for *codes, start, rate, samples in records(data):
        delta = 1 / rate if rate else 0.0
        for t in reversed(out):
            if t[:4] == codes:
                expected = t[4] + round(sum(map(len, t[6])) * delta * 1e9)
                if t[5] == delta and abs(start - expected) <= delta * 5e8:
                    t[6].append(samples)
                    break
                out.append([*codes, start, delta, [samples]])
                break
        else:
            out.append([*codes, start, delta, [samples]])
    return [(*t[:6], np.concatenate(t[6])) for t in out]


def open_traces(spark: SparkSession, paths: str | list[str], ignore_last_sample: bool = False) -> DataFrame:
    """Trace table of many files; each file is one task's work, corrupt files are skipped with a warning."""
    import warnings

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = traces(bytes(content))
                except (ValueError, struct.error, UnicodeDecodeError) as e:
                    warnings.warn(f"{path} is skipped: {e}", stacklevel=2)
                    continue
                rows += [(path, *t[:6], t[6][:-1] if ignore_last_sample else t[6]) for t in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACES.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, TRACES)


def _ratio(rate: float) -> tuple[int, int]:
    """Factor and multiplier of a sampling rate: factor / -multiplier samples a second."""
    f = Fraction(rate).limit_denominator(32767)
    if not 0 < f.numerator <= 32767:
        raise ValueError(f"a rate of {rate} can't be written")
    return f.numerator, -f.denominator if f.denominator > 1 else 1


def write_record(network: str, station: str, location: str, channel: str, start_ns: int, rate: float, samples: np.ndarray, power: int = 12) -> bytes:
    """One big-endian record of 32-bit integers or 64-bit floats; the start is kept to the microsecond."""
    code = 5 if samples.dtype.kind == "f" else 3
    raw = samples.astype(">" + PLAIN[code]).tobytes()
    if len(raw) > (1 << power) - 64:
        raise ValueError("too many samples for a record")
    t = datetime.fromtimestamp(start_ns // 1_000_000_000, timezone.utc)
    pad = lambda s, n: s.encode().ljust(n)
    factor, multiplier = _ratio(rate)
    tenths, micro = divmod(start_ns % 1_000_000_000 // 1000, 100)
    head = b"000001D " + pad(station, 5) + pad(location, 2) + pad(channel, 3) + pad(network, 2)
    head += struct.pack(">HHBBBBH", t.year, t.timetuple().tm_yday, t.hour, t.minute, t.second, 0, tenths)
    head += struct.pack(">HhhBBBBiHH", len(samples), factor, multiplier, 0, 0, 0, 2, 0, 64, 48)
    head += struct.pack(">HHBBBB", 1000, 56, code, 1, power, 0)
    head += struct.pack(">HHBbBB", 1001, 0, 0, micro, 0, 0)
    return (head.ljust(64, b"\0") + raw).ljust(1 << power, b"\0")


DAY_NS = 86_400_000_000_000


def day_files(traces: DataFrame, flat: bool = False) -> DataFrame:
    """Traces cut at midnight (UTC), with the file each piece belongs to.

    In the day archive: year/network/station/channel.D/network.station.location.channel.D.year.day;
    flat: the last name only.  Traces with a null start or step, or no samples, are left out.
    """
    step = "greatest(1L, cast(round(delta * 1e9) as bigint))"
    rows = traces.filter("start_ns IS NOT NULL AND delta > 0 AND size(samples) > 0").withColumn("step", F.expr(step))
    last = "start_ns + (size(samples) - 1) * step"
    day = f"({{0}} - pmod({{0}}, {DAY_NS})) div {DAY_NS}"
    rows = rows.withColumn("day", F.explode(F.expr(f"sequence({day.format('start_ns')}, {day.format('(' + last + ')')})")))
    lo = f"greatest(0L, (day * {DAY_NS} - start_ns + step - 1) div step)"
    hi = f"least(cast(size(samples) as bigint), ((day + 1) * {DAY_NS} - start_ns + step - 1) div step)"
    rows = rows.withColumn("lo", F.expr(lo)).withColumn("n", F.expr(f"{hi} - {lo}")).filter("n > 0")
    date = F.expr("date_add(DATE'1970-01-01', cast(day as int))")
    year, of_year = F.date_format(date, "yyyy"), F.date_format(date, "DDD")
    name = F.concat_ws(".", "network", "station", "location", "channel", F.lit("D"), year, of_year)
    file = name if flat else F.concat_ws("/", year, "network", "station", F.concat("channel", F.lit(".D")), name)
    return rows.select(
        file.alias("file"), "network", "station", "location", "channel", (F.col("start_ns") + F.col("lo") * F.col("step")).alias("start_ns"), "delta",
        F.expr("slice(samples, cast(lo + 1 as int), cast(n as int))").alias("samples"),
    )


def write_files(traces: DataFrame, folder: str, flat: bool = False, power: int = 12) -> DataFrame:
    """Write traces as miniSEED, a file a channel and day; returns file and records of what was written.

    A file is written by one task, whole, under its final name, so a repeated
    task writes the same again.  ``folder`` is a path or URI that all executors see.
    """
    from .opening import output_of

    room = ((1 << power) - 64) // 8

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, records_ = None, None, 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.file != name:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame({"file": [name], "records": [records_]})
                    out, name, records_ = output_of(f"{folder}/{r.file}"), r.file, 0
                samples = np.asarray(r.samples, float)
                for at in range(0, len(samples), room):
                    start = r.start_ns + round(at * r.delta * 1e9)
                    out.write(write_record(r.network, r.station, r.location, r.channel, start, 1 / r.delta, samples[at : at + room], power))
                    records_ += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "records": [records_]})

    pieces = day_files(traces, flat).repartition("file").sortWithinPartitions("file", "start_ns")
    return pieces.mapInPandas(run, "file string, records long").checkpoint()  # written once, now
