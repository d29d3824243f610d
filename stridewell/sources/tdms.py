"""Reader for TDMS files, from the published file layout.

A file is a row of segments.  Each has a lead-in (tag, contents mask, version,
lengths), metadata (objects with their raw-data index and properties) and raw
data: chunks that hold the values of each channel one after the other, or
interleaved sample by sample.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Type codes of the format and their NumPy types.
NUMBERS = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8"}
STRING, BOOLEAN, TIMESTAMP = 0x20, 0x21, 0x44
# Bits of the contents mask.
META, NEW_LIST, RAW, INTERLEAVED, BIG_ENDIAN = 1 << 1, 1 << 2, 1 << 3, 1 << 5, 1 << 6
_SECONDS_1904_TO_1970 = 2082844800


class TdmsError(ValueError):
    pass


@dataclass
class TdmsFile:
    properties: dict[str, dict] = field(default_factory=dict)
    channels: dict[str, list[np.ndarray]] = field(default_factory=dict)

    def root(self) -> dict:
        merged: dict = {}
        for path in sorted(self.properties, key=lambda p: p.count("/")):
            if path not in self.channels:
                merged.update(self.properties[path])
        return merged

    def array(self) -> np.ndarray:
        """(samples, channels) of all channels with data, in order."""
        columns = [np.concatenate(parts) for parts in self.channels.values() if parts]
        if len({len(c) for c in columns}) > 1:
            raise TdmsError("channels have different lengths")
        return np.stack(columns, axis=1) if columns else np.zeros((0, 0))


class _Cursor:
    def __init__(self, data: bytes, at: int, order: str):
        self.data, self.at, self.order = data, at, order

    def take(self, kind: str):
        found = struct.unpack_from(self.order + kind, self.data, self.at)
        self.at += struct.calcsize(self.order + kind)
        return found[0] if len(found) == 1 else found

    def text(self) -> str:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8")

    def value(self, code: int):
        if code in NUMBERS:
            dtype = np.dtype(self.order + NUMBERS[code])
            self.at += dtype.itemsize
            return np.frombuffer(self.data, dtype, 1, self.at - dtype.itemsize)[0].item()
        if code == STRING:
            return self.text()
        if code == BOOLEAN:
            return bool(self.take("B"))
        if code == TIMESTAMP:
            fraction, seconds = self.take("Qq") if self.order == "<" else reversed(self.take("qQ"))
            return (seconds - _SECONDS_1904_TO_1970) * 1_000_000_000 + (fraction * 1_000_000_000 >> 64)
        raise TdmsError(f"property type {code:#x} isn't supported")


def parse(data: bytes, headers_only: bool = False) -> TdmsFile:
    """All properties (times as ns since 1970) and, unless ``headers_only``, the data."""
    out, at = TdmsFile(), 0
    active: list[tuple[str, str, int]] = []
    known: dict[str, tuple[str, int]] = {}
    while at + 28 <= len(data):
        if data[at : at + 4] != b"TDSm":
            raise TdmsError("not a TDMS segment")
        mask, _version, next_at, raw_at = struct.unpack_from("<IIQQ", data, at + 4)
        order = ">" if mask & BIG_ENDIAN else "<"
        if order == ">":
            _version, next_at, raw_at = struct.unpack_from(">IQQ", data, at + 8)
        body = at + 28
        end = len(data) if next_at == 0xFFFFFFFFFFFFFFFF else min(len(data), body + next_at)
        if mask & META:
            cursor = _Cursor(data, body, order)
            if mask & NEW_LIST:
                active = []
            for _ in range(cursor.take("I")):
                path = cursor.text()
                index = cursor.take("I")
                if index == 0:
                    entry = known.get(path)
                elif index == 0xFFFFFFFF:
                    entry = None
                else:
                    code, dimension, count = cursor.take("IIQ")
                    if dimension != 1 or code not in NUMBERS:
                        raise TdmsError(f"data type {code:#x} isn't supported")
                    entry = known[path] = (order + NUMBERS[code], count)
                if entry is not None:
                    active = [a for a in active if a[0] != path] + [(path, *entry)]
                    out.channels.setdefault(path, [])
                properties = out.properties.setdefault(path, {})
                for _ in range(cursor.take("I")):
                    name = cursor.text()
                    properties[name] = cursor.value(cursor.take("I"))
        if mask & RAW and not headers_only and active:
            _read_chunks(data, body + raw_at, end, active, bool(mask & INTERLEAVED), out)
        at = end
        if next_at == 0xFFFFFFFFFFFFFFFF:
            break
    return out


def _read_chunks(data: bytes, at: int, end: int, active, interleaved: bool, out: TdmsFile) -> None:
    sizes = [np.dtype(kind).itemsize for _, kind, _ in active]
    while at < end:
        if interleaved:
            kinds = {kind for _, kind, _ in active}
            if len(kinds) > 1:
                raise TdmsError("interleaved channels have different types")
            rows = min(active[0][2], (end - at) // sum(sizes))
            if not rows:
                return
            block = np.frombuffer(data, active[0][1], rows * len(active), at).reshape(rows, len(active))
            for k, (path, _, _) in enumerate(active):
                out.channels[path].append(block[:, k].copy())
            at += rows * sum(sizes)
            continue
        whole = sum(s * n for s, (_, _, n) in zip(sizes, active))
        if not whole:
            return
        # a last, cut chunk holds the same share of each channel
        share = 1.0 if end - at >= whole else (end - at) / whole
        for s, (path, kind, n) in zip(sizes, active):
            count = n if share == 1.0 else int(n * share)
            out.channels[path].append(np.frombuffer(data, kind, count, at).copy())
            at += s * count
        if share < 1.0:
            return


def write(properties: dict, columns: np.ndarray, interleaved: bool = False) -> bytes:
    """A one-segment file of int16, float32 or float64 channels."""
    codes = {"int16": 2, "float32": 9, "float64": 10}
    code = codes[columns.dtype.name]

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<I", len(raw)) + raw

    def prop(name: str, v) -> bytes:
        if isinstance(v, str):
            return text(name) + struct.pack("<I", STRING) + text(v)
        if isinstance(v, float):
            return text(name) + struct.pack("<Id", 10, v)
        return text(name) + struct.pack("<Iq", 4, v)

    objects = [text("/") + struct.pack("<II", 0xFFFFFFFF, len(properties)) + b"".join(prop(k, v) for k, v in properties.items())]
    for c in range(columns.shape[1]):
        objects.append(text(f"/'Measurement'/'{c}'") + struct.pack("<IIIQI", 20, code, 1, len(columns), 0))
    meta = struct.pack("<I", len(objects)) + b"".join(objects)
    raw = (columns if interleaved else columns.T).copy().tobytes()
    mask = META | NEW_LIST | RAW | (INTERLEAVED if interleaved else 0)
    return b"TDSm" + struct.pack("<IIQQ", mask, 4713, len(meta) + len(raw), len(meta)) + meta + raw
