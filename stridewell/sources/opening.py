"""One way in: native frames and trees, instrument files, templates and trace files.

Opening instrument files takes two steps.  Headers are read in tasks, one row a
file comes to the driver, and their coordinates are combined there.  The samples
stay in tasks: a frame's plan reads from each file the rows and channels that the
frame was asked for, whatever the number of files.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import coords as C
from ..frame import LabeledFrame, open_frame
from ..operators.blocks import BROADCAST_ROWS
from ..setops import combine_by_field
from ..tree import Tree
from . import engines, miniseed

_HEAD = "path string, engine string, name string, time string, distance string"
_PART = "path string, engine string, r0 long, r1 long, c0 long, c1 long, place long"


@dataclass
class Part:
    """A file's place in a frame, as its header says."""

    path: str
    engine: str | None
    name: str | None
    time: C.Coordinate
    distance: C.Coordinate


def located(path: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def file_of(path: str):
    """A file that can be read from any place, wherever it lies."""
    system, inner = located(path)
    return system.open_input_file(inner)


def output_of(path: str):
    """A new file, with the folders above it."""
    system, inner = located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def read_heads(spark: SparkSession, paths: str | list[str], engine: str | Callable | None = None, on_error: str = "warn", **options) -> list[Part]:
    """One part a file, in order of path.  Files that can't be read are left out with a warning (``on_error='raise'`` fails)."""
    files = spark.read.format("binaryFile").load(paths).select("path")  # contents aren't asked for

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    with file_of(path) as file:
                        name, head = engines.open_file(file, engine, last, head=True, **options)
                except Exception as e:
                    if on_error == "raise" or isinstance(e, ImportError):
                        raise
                    warnings.warn(f"{path} is skipped: {e}", stacklevel=2)
                    continue
                last = name or last
                rows.append((path, name, head.name, json.dumps(head.time.to_dict()), json.dumps(head.distance.to_dict())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HEAD.split(", ")])

    found = files.mapInPandas(run, _HEAD).orderBy("path").collect()
    coord = lambda text: C.from_dict(json.loads(text))
    return [Part(r.path, r.engine, r["name"], coord(r.time), coord(r.distance)) for r in found]


def _fits(a: Part, b: Part) -> bool:
    steps = [p.time.sampling_interval() for p in (a, b)]
    even = None in steps or bool(np.isclose(*steps))
    return even and type(a.time) is type(b.time) and a.name == b.name and a.distance.equals(b.distance)


def bags(parts: list[Part], tolerance=None) -> list[tuple[list[Part], C.Coordinate]]:
    """Runs of parts that fit together, by first label, each with its combined time axis."""
    runs: list[list[Part]] = []
    for p in sorted((p for p in parts if p.time.size), key=lambda p: p.time.start):
        if runs and _fits(runs[-1][-1], p):
            runs[-1].append(p)
        else:
            runs.append([p])
    out = []
    for run in runs:
        time = run[0].time
        for p in run[1:]:
            time = time.concat(p.time)
        out.append((run, time.simplify(tolerance) if hasattr(time, "simplify") and tolerance is not False else time))
    return out


def _frame(spark: SparkSession, parts: list[Part], time: C.Coordinate, engine, rows: slice, columns: slice, options: dict) -> LabeledFrame:
    """The frame of parts that follow each other, with only the rows and channels asked for read."""
    lo, hi, _ = rows.indices(time.size)
    c0, c1, _ = columns.indices(parts[0].distance.size)
    table, at = [], 0
    for p in parts:
        a, b = max(lo - at, 0), min(hi - at, p.time.size)
        if a < b and c0 < c1:
            table.append((p.path, p.engine, a, b, c0, c1, at + a - lo))
        at += p.time.size
    wanted = spark.createDataFrame(table, _PART).repartition(max(1, min(len(table), 10_000)), "path", "r0")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                with file_of(r.path) as file:
                    _, opened = engines.open_file(file, engine or r.engine, None, rows=slice(r.r0, r.r1), columns=slice(r.c0, r.c1), **options)
                data = np.asarray(opened.data, float)
                yield pd.DataFrame({"distance__i": np.arange(data.shape[1]), "place": r.place, "samples": list(np.ascontiguousarray(data.T))})

    blocks = wanted.mapInPandas(run, "distance__i long, place long, samples array<double>")
    cells = blocks.select("distance__i", "place", F.posexplode("samples").alias("p", "value"))
    df = cells.select((F.col("place") + F.col("p")).alias("time__i"), "distance__i", "value")
    distance = parts[0].distance.slice(slice(c0, c1))
    extents = {"time": max(0, hi - lo), "distance": max(0, c1 - c0)}
    return LabeledFrame(df, ("time", "distance"), {"time": time.slice(slice(lo, hi)), "distance": distance}, parts[0].name, extents=extents)


def _selected(spark, run: list[Part], time: C.Coordinate, engine, sel: dict, isel: dict, options: dict) -> LabeledFrame:
    ranges = {"time": slice(None), "distance": slice(None)} | isel
    for name, at in sel.items():
        axis = {"time": time, "distance": run[0].distance}[name]
        ranges[name] = axis.slice_indexer(at.start, at.stop)
    return _frame(spark, run, time, engine, ranges["time"], ranges["distance"], options)


def open_frames(spark: SparkSession, paths: str | list[str], engine: str | Callable | None = None, *, tolerance=None, squeeze: bool = True,
                sel: dict | None = None, isel: dict | None = None, on_error: str = "warn", **options) -> LabeledFrame | list[LabeledFrame]:
    """Many files as labeled frames of time and distance, one for each run of files that fit together.

    ``sel`` and ``isel`` (slices by name) reach the readers: rows and channels
    outside them aren't read, nor are files without any.  ``tolerance`` joins
    segments of the time axis (False: none are).  With ``squeeze``, a single frame comes by itself.
    """
    made = bags(read_heads(spark, paths, engine, on_error, **options), tolerance)
    frames = [_selected(spark, run, time, engine, sel or {}, isel or {}, options) for run, time in made]
    if not frames:
        raise ValueError("no file could be opened")
    return frames[0] if squeeze and len(frames) == 1 else frames


def open_tree_frames(spark: SparkSession, template: str, engine: str | Callable | None = None, *, tolerance=None, on_error: str = "warn", **options) -> Tree:
    """Files of a path template as a tree of frames: ``{field}`` is a level of keys, ``[field]`` one of places in path order.

    Files whose fields are all the same are combined along time; runs that don't fit together follow each other.
    """
    fields = re.findall(r"[{\[](\w+)[}\]]", template)
    sequences = set(re.findall(r"\[(\w+)\]", template))
    pattern = re.compile(engines.template_pattern(template) + "$")
    parts = read_heads(spark, re.sub(r"[{\[]\w+[}\]]", "*", template), engine, on_error, **options)
    leaves: dict[tuple, list[Part]] = {}
    for p in parts:
        found = pattern.search(p.path)
        if found:
            leaves.setdefault(tuple(found[name] for name in fields), []).append(p)

    def grow(depth: int, chosen: dict[tuple, list[Part]]):
        if depth == len(fields):
            made = bags([p for ps in chosen.values() for p in ps], tolerance)
            frames = [_selected(spark, run, time, engine, {}, {}, options) for run, time in made]
            return frames[0] if len(frames) == 1 else frames
        keys = sorted({k[depth] for k in chosen})
        below = {key: grow(depth + 1, {k: v for k, v in chosen.items() if k[depth] == key}) for key in keys}
        return Tree(list(below.values()) if fields[depth] in sequences else below, fields[depth])

    made = grow(0, leaves)
    return made if isinstance(made, Tree) else Tree(made if isinstance(made, list) else [made])


def open_trees(spark: SparkSession, folders: list[str], tolerance=None) -> Tree:
    """Stored trees of one shape, united key by key and place by place, their frames combined."""
    def plain(t):
        return {k: plain(v) for k, v in t.items()} if isinstance(t, Tree) and t.ismapping else [plain(v) for v in t.values()] if isinstance(t, Tree) else t

    trees = [Tree.open(spark, folder) for folder in folders]
    united = Tree(combine_by_field([plain(t) for t in trees], "first", tolerance), trees[0].name)

    def named(t: Tree, like: Tree) -> Tree:
        first = next((v for v in like.values() if isinstance(v, Tree)), None)
        for v in t.values():
            if isinstance(v, Tree) and first is not None:
                named(v, first)
        t.name = like.name
        return t

    return named(united, trees[0])


def open_any(spark: SparkSession, paths: str | list[str], engine=None, **options) -> LabeledFrame | list[LabeledFrame] | Tree | DataFrame:
    """Dispatch by what the path looks like.

    A path with ``{field}`` or ``[field]`` levels is a template and gives a tree;
    ``engine='native'`` opens a saved frame, 'tree' a saved tree (a list: several,
    united); 'miniseed' gives traces; other engines, a function or None (probe)
    give labeled frames.  Lists and patterns open many files at once.
    """
    if engine == "native":
        return open_frame(spark, paths)
    if engine == "tree":
        return open_trees(spark, [paths] if isinstance(paths, str) else paths, **options)
    if engine == "miniseed":
        return miniseed.open_traces(spark, paths, **options)
    if isinstance(paths, str) and ("{" in paths or "[" in paths):
        return open_tree_frames(spark, paths, engine, **options)
    return open_frames(spark, paths, engine, **options)
