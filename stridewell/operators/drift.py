"""Schemas that drift from file to file.

The files of a device are read in order against the device's state: the
attributes present, with their last known type and value.  Each set of names and
types is a schema, known by its fingerprint; a file whose schema isn't that of the
file before begins a step from one to the other, whose changes are recorded.  A
device's fingerprints are numbered as versions, in the order in which they first came.  Whatever its version, a file's
attributes are then routed through the same chain of migration steps (renames,
casts, defaults) into one table.  Steps go by name; a name that no step knows
is taken as the one it was found to be renamed from.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import broadcast_checked, time_blocks
from .timestamps import whole_groups

# Migration steps, in order. Renames chain until no step applies.
RENAMES = {
    "blockRate": "BlockRate", "Block_Rate_mHz": "BlockRate", "FrequencyResolution": "FreqRes", "SamplingResolution": "SamplingRes",
    "FwVersion": "Firmware", "Gauge": "GaugeLength", "ChannelExtent": "Extent", "origin": "Origin", "PRF": "PulseRate", "AmpPower": "Amplifier",
}
CASTS = {
    "BlockRate": ("block_rate", "number"), "FreqRes": ("freq_res", "number"), "SamplingRes": ("sampling_res", "number"),
    "PulseRate": ("pulse_rate", "number"), "GaugeLength": ("gauge_length", "number"), "Origin": ("origin", "number"),
    "Spacing": ("spacing", "numbers"), "Extent": ("extent", "numbers"), "Firmware": ("firmware", "text"),
}
DEFAULTS = {"block_rate": "freq_res"}  # column to stand in where one is null: files without BlockRate have their block size from FreqRes

_INHERITED = "inherited"
_FIRST_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def _same(a, b) -> bool:
    """Equality of JSON values: 1 and 1.0 are the same number, 1 and true differ."""
    if json_type(a) != json_type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def advance(state: dict | None, attrs: dict, unknown: tuple = (None, None)) -> tuple[dict, list[tuple[str, str, str | None]]]:
    """The state after a file and its changes (attr, change, earlier name).

    A state has [type, value] by name; both are null while never known.  Without
    a state (a device's first file) there are no changes, and null attributes are
    ``unknown``.
    """
    after = carry(state, attrs, unknown)
    return after, [] if state is None or shape(state) == shape(after) else step(state, after)


def carry(state: dict | None, attrs: dict, unknown: tuple = (None, None)) -> dict:
    """The state after a file: its attributes, null ones with what was last known of them."""
    if state is None:
        return {name: list(unknown) if value is None else [json_type(value), value] for name, value in attrs.items()}
    return {name: state.get(name, [None, None]) if value is None else [json_type(value), value] for name, value in attrs.items()}


def shape(state: dict) -> frozenset:
    """The schema of a file, names with their types.  Files of one shape follow each other without a change."""
    return frozenset((name, kind) for name, (kind, _) in state.items())


def step(before: dict, after: dict) -> list[tuple[str, str, str | None]]:
    """The changes from a schema to the next one: (attr, change, earlier name)."""
    changes = []
    gone = sorted(before.keys() - after.keys())
    for name in sorted(after.keys() - before.keys()):
        kind, value = after[name]
        match = next((g for g in gone if kind is not None and before[g][0] == kind and _same(before[g][1], value)), None)
        if match is None:
            changes.append((name, "added", None))
        else:
            gone.remove(match)
            changes.append((name, "renamed", match))
    changes += [(name, "removed", None) for name in gone]
    for name in sorted(after.keys() & before.keys()):
        old, new = before[name][0], after[name][0]
        if old is not None and new is not None and old != new:
            changes.append((name, "retyped", None))
    return sorted(changes)


def follow(names: dict, state: dict, changes: list) -> dict:
    """The earlier names of a state's attributes after a file.

    By name, [1, name] is a name before the block, [0, name] one that stands for
    itself; names that never changed are absent or stand for themselves.
    """
    if not changes:
        return names
    after = {n: source for n, source in names.items() if n in state}
    for name, change, earlier in changes:
        if change == "renamed":
            after[name] = [0, earlier] if earlier in RENAMES or earlier in CASTS else names.get(earlier, [0, earlier])
    return after


def _known(names: dict, earlier: dict) -> dict:
    """Names by their earlier ones, through those ``earlier`` than the block."""
    return {n: earlier.get(source, source) if before else source for n, (before, source) in names.items()}


def fingerprint(state: dict) -> str:
    """Of a schema, whatever the order of its attributes."""
    return hashlib.blake2b(json.dumps(sorted(shape(state), key=lambda a: a[0])).encode(), digest_size=8).hexdigest()


def _parse(text: str | None) -> dict | None:
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _cast(value, kind: str):
    if value is None:
        return None
    if kind == "numbers":
        parts = value if isinstance(value, list) else _FIRST_NUMBER.findall(value) if isinstance(value, str) else [value]
        parts = [_cast(p, "number") for p in parts]
        return [p for p in parts if p is not None]
    if isinstance(value, list):  # see _whole
        value = value[0] if value else None
    if kind == "text":
        return None if value is None else value if isinstance(value, str) else json.dumps(value)
    if isinstance(value, str):
        found = _FIRST_NUMBER.search(value)
        return float(found[0]) if found else None
    return float(value) if isinstance(value, (int, float)) else None


def _whole(value, kind: str) -> bool:
    """Whether a cast keeps all of a value: a single place takes the first of an array only."""
    return kind == "numbers" or not isinstance(value, list) or len(value) < 2


def _unknown(earlier: dict) -> dict:
    """Those names that no step knows, of known ones."""
    return {n: e for n, e in earlier.items() if n not in RENAMES and n not in CASTS and (e in RENAMES or e in CASTS)}


def migrate(state: dict, earlier: dict | None = None) -> dict:
    """One row of the common table from the last known values of a file's attributes.

    ``earlier`` has names that no step knows, with the known ones they were found
    to be renamed from.
    An array in place of a single value gives its first item and stays whole in
    ``extras``.  Of several attributes with one target, the target itself goes first, then
    those of the fixed renames, then those found, by name; the first that has a value takes it.  Further ones with
    a value keep their own name, and ``collisions`` has them with that target.
    """
    row, extras, collisions, taken = {}, {}, {}, set()
    found = earlier or {}
    for own in sorted(state, key=lambda n: (n in found, n in RENAMES, n)):
        value = state[own][1]
        name, steps = found.get(own, own), 0
        while name in RENAMES and steps < len(RENAMES):
            name, steps = RENAMES[name], steps + 1
        if name in taken:
            if value is not None:
                extras[own], collisions[own] = json.dumps(value), name
            continue
        if value is not None:
            taken.add(name)
        if name in CASTS:
            column, kind = CASTS[name]
            row[column] = _cast(value, kind)
            if not _whole(value, kind):
                extras[own] = json.dumps(value)
        elif value is not None:
            extras[name] = json.dumps(value)
    for column, other in DEFAULTS.items():
        if row.get(column) is None:
            row[column] = row.get(other)
    row["extras"], row["collisions"] = list(extras.items()), list(collisions.items())
    return row


_KINDS = {"number": ("double", pa.float64()), "numbers": ("array<double>", pa.list_(pa.float64())), "text": ("string", pa.string())}
_COLUMNS = [("device_id", "long", pa.int64()), ("block", "int", pa.int32()), ("header_id", "long", pa.int64()), ("file_no", "long", pa.int64()),
            ("changes", "array<struct<attr:string,change:string,earlier:string>>",
             pa.list_(pa.struct([("attr", pa.string()), ("change", pa.string()), ("earlier", pa.string())]))),
            ("fingerprint", "string", pa.string()),
            *((column, *_KINDS[kind]) for column, kind in CASTS.values()),
            *((name, "map<string,string>", pa.map_(pa.string(), pa.string())) for name in ("extras", "collisions"))]


def _walk(group: pa.Table, init: dict | None, unknown: tuple = (None, None), named: bool = True):
    """States of a group's files in order: (header id, file number, state, changes, earlier names unless not asked for)."""
    names = {n: [1, n] for n in init or {}}
    state, last = init, None
    for header, file_no, text in zip(*(group.column(c).to_pylist() for c in ("header_id", "file_no", "attrs_json"))):
        if header == last:
            continue  # delivered again
        last = header
        attrs = _parse(text)
        if attrs is None:
            continue
        state, changes = advance(state, attrs, unknown)
        if named:
            names = follow(names, state, changes)
        yield header, file_no, state, changes, names


def drift(df: DataFrame, *, changes_only: bool = False, device: str = "device_id", file_no: str = "file_no", header: str = "header_id", attrs: str = "attrs_json", target: int = 20_000) -> DataFrame:
    """Changes, schema version and migrated attributes of every file.

    One row a header: device_id, header_id, file_no, changes (array of attr,
    change, earlier name) and fingerprint, version, the migrated columns,
    ``extras`` (other attributes as JSON) and ``collisions`` (attributes kept in
    ``extras`` under their own name, and the taken name they'd have been given).  Files are taken by file_no, equal
    ones by header id; headers delivered twice come out once.  Headers with a
    null device, number or id, or whose attributes aren't a JSON object, are left
    out and change no state.  A null attribute keeps its last known value.
    With ``changes_only`` there are device_id, header_id, file_no and changes of headers that have any.
    Devices with many files are cut into blocks, whose states are handed on.
    """
    rows = df.select(
        F.col(device).cast("long").alias("device_id"), F.col(file_no).cast("long").alias("file_no"),
        F.col(header).cast("long").alias("header_id"), F.col(attrs).cast("string").alias("attrs_json"),
    ).filter("device_id IS NOT NULL AND file_no IS NOT NULL AND header_id IS NOT NULL")
    rows = time_blocks(rows, "device_id", "file_no", target=target, ties="header_id", fine=16).drop("core")
    order = ["device_id", "block", "file_no", "header_id"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["device_id", "block"]):
            state = None
            for _, _, state, _, _ in _walk(group, None, (_INHERITED, None), False):
                pass
            if state is not None:
                yield pa.RecordBatch.from_pydict({"device_id": group["device_id"][:1].combine_chunks(), "block": group["block"][:1].combine_chunks(), "summary": [json.dumps(state)]})

    def hand_on(frame: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for row in frame.sort_values("block").itertuples(index=False):
            if now is not None:
                out.append((row.device_id, row.block, json.dumps(now)))
            before = now or {}
            now = {k: before.get(k, [None, None]) if v[0] == _INHERITED else v for k, v in json.loads(row.summary).items()}
        return pd.DataFrame(out, columns=["device_id", "block", "init"])

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["device_id", "block"]):
            init, names = group["init"][0].as_py(), None
            for *_, names in _walk(group, json.loads(init) if init else None):
                pass
            if names is not None:
                yield pa.RecordBatch.from_pydict({"device_id": group["device_id"][:1].combine_chunks(), "block": group["block"][:1].combine_chunks(), "names": [json.dumps(names)]})

    def hand_on_names(frame: pd.DataFrame) -> pd.DataFrame:
        out, earlier = [], {}
        for row in frame.sort_values("block").itertuples(index=False):
            out.append((row.device_id, row.block, json.dumps(earlier)))
            earlier = _known(json.loads(row.names), earlier)
        return pd.DataFrame(out, columns=["device_id", "block", "earlier"])

    cut = rows.filter("block > 0").select("device_id").distinct().checkpoint()
    if cut.isEmpty():
        rows = rows.withColumn("init", F.lit(None).cast("string"))
    else:
        sums = rows.join(broadcast_checked(cut), "device_id", "left_semi").repartition("device_id", "block").sortWithinPartitions(*order)
        sums = sums.mapInArrow(summarise, "device_id long, block int, summary string")
        inits = sums.groupBy("device_id").applyInPandas(hand_on, "device_id long, block int, init string").checkpoint()
        rows = rows.join(broadcast_checked(inits), ["device_id", "block"], "left")
    if cut.isEmpty() or changes_only:
        rows = rows.withColumn("earlier", F.lit(None).cast("string"))
    else:
        names = rows.join(broadcast_checked(cut), "device_id", "left_semi").repartition("device_id", "block").sortWithinPartitions(*order)
        names = names.mapInArrow(relate, "device_id long, block int, names string")
        earlier = names.groupBy("device_id").applyInPandas(hand_on_names, "device_id long, block int, earlier string").checkpoint()
        rows = rows.join(broadcast_checked(earlier), ["device_id", "block"], "left")

    columns = [c for c in _COLUMNS if not changes_only or c[0] in ("device_id", "block", "header_id", "file_no", "changes")]
    arrow = pa.schema([(n, t) for n, _, t in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for group in whole_groups(batches, ["device_id", "block"]):
            init, known = group["init"][0].as_py(), group["earlier"][0].as_py()
            known = json.loads(known) if known else {}
            device, block = group["device_id"][0].as_py(), group["block"][0].as_py()
            held, found = None, {}
            for header, file_no, state, changes, names in _walk(group, json.loads(init) if init else None, named=not changes_only):
                if changes_only and not changes:
                    continue
                named = [{"attr": a, "change": c, "earlier": e} for a, c, e in changes]
                made = {"device_id": device, "block": block, "header_id": header, "file_no": file_no, "changes": named}
                if not changes_only:
                    if names is not held:
                        held, found = names, _unknown(_known(names, known))
                    made |= {"fingerprint": fingerprint(state), **migrate(state, found)}
                out.append(made)
            if len(out) > 5000:
                yield from pa.Table.from_pylist(out, arrow).to_batches()
                out = []
        if out:
            yield from pa.Table.from_pylist(out, arrow).to_batches()

    placed = rows.repartition("device_id", "block").sortWithinPartitions(*order)
    found = placed.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in columns)).drop("block")
    if changes_only:
        return found
    found = found.checkpoint()
    versions = found.groupBy("device_id", "fingerprint").agg(F.min(F.struct("file_no", "header_id")).alias("first"))
    number = F.row_number().over(Window.partitionBy("device_id").orderBy("first"))  # one row a schema
    versions = versions.select("device_id", "fingerprint", number.alias("version")).checkpoint()
    return found.join(broadcast_checked(versions), ["device_id", "fingerprint"])
