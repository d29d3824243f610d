"""Nested collections of labeled frames: mappings by key and sequences by place."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession

from .frame import LabeledFrame, open_frame, save_frame


class Tree:
    """A mapping or sequence of frames or trees, with the name of its level.

    Selections are handed to every frame; frames that end up empty are left out.
    All of it is descriptors: nothing is computed until a frame is.
    """

    def __init__(self, data: dict | list, name: str | None = None):
        grow = lambda v: Tree(v) if isinstance(v, (dict, list)) else v
        self.data = {k: grow(v) for k, v in data.items()} if isinstance(data, dict) else [grow(v) for v in data]
        self.name = name

    @property
    def ismapping(self) -> bool:
        return isinstance(self.data, dict)

    @property
    def issequence(self) -> bool:
        return not self.ismapping

    @property
    def empty(self) -> bool:
        return not self.data

    def __len__(self) -> int:
        return len(self.data)

    def __iter__(self) -> Iterator:
        return iter(self.data)

    def __getitem__(self, key):
        return self.data[key]

    def items(self) -> list[tuple]:
        return list(self.data.items() if self.ismapping else enumerate(self.data))

    def values(self) -> list:
        return [v for _, v in self.items()]

    @property
    def fields(self) -> tuple[str | None, ...]:
        """Names of the levels, each once."""
        below = [n for v in self.values() if isinstance(v, Tree) for n in v.fields]
        return tuple(dict.fromkeys([self.name, *below]))

    def _build(self, items: list[tuple]) -> Tree:
        return Tree(dict(items) if self.ismapping else [v for _, v in items], self.name)

    def map(self, f: Callable[[LabeledFrame], LabeledFrame]) -> Tree:
        return self._build([(k, v.map(f) if isinstance(v, Tree) else f(v)) for k, v in self.items()])

    def _select(self, f: Callable[[LabeledFrame], LabeledFrame]) -> Tree:
        done = [(k, v._select(f) if isinstance(v, Tree) else f(v)) for k, v in self.items()]
        return self._build([(k, v) for k, v in done if isinstance(v, Tree) or all(v.shape)])

    def isel(self, indexers: dict | None = None, **more) -> Tree:
        return self._select(lambda f: f.isel(indexers, **more))

    def sel(self, indexers: dict | None = None, method: str | None = None, endpoint: bool = True, **more) -> Tree:
        return self._select(lambda f: f.sel(indexers, method, endpoint, **more))

    def query(self, indexers: dict | None = None, **more) -> Tree:
        """Keys by pattern on levels of a name, places by number (none, if there is no such) or slice; every named level is filtered."""
        wanted = (indexers or {}) | more
        items = [(k, v.query(wanted) if isinstance(v, Tree) else v) for k, v in self.items()]
        if self.name in wanted:
            w = wanted[self.name]
            if self.ismapping:
                items = [(k, v) for k, v in items if fnmatchcase(str(k), str(w))]
            else:
                items = items[w] if isinstance(w, slice) else [v for k, v in enumerate(items) if k in (w, w + len(items))]
        return self._build([(k, v) for k, v in items if not isinstance(v, Tree) or len(v)])

    def load(self) -> Tree:
        return self.map(LabeledFrame.load)

    def copy(self) -> Tree:
        return self.map(lambda f: f.copy())

    def equals(self, other) -> bool:
        if not isinstance(other, Tree) or (self.name, self.ismapping) != (other.name, other.ismapping) or [k for k, _ in self.items()] != [k for k, _ in other.items()]:
            return False
        return all(type(v) is type(w) and v.equals(w) for v, w in zip(self.values(), other.values()))

    def frames(self) -> list[tuple[tuple, LabeledFrame]]:
        """All frames with their paths."""
        return [((k, *p), f) for k, v in self.items() for p, f in (v.frames() if isinstance(v, Tree) else [((), v)])]

    # -- files ------------------------------------------------------------------------
    def _outline(self) -> dict:
        items = [[k, v._outline() if isinstance(v, Tree) else None] for k, v in self.items()]
        return {"name": self.name, "mapping": self.ismapping, "items": items}

    def save(self, folder: str) -> None:
        """Each frame in the native format, in a folder of its number, and the outline as JSON."""
        frames = self.frames()
        for n, (_, f) in enumerate(frames):
            save_frame(f, f"{folder}/{n}")
        if frames:
            spark = frames[0][1].df.sparkSession
            spark.createDataFrame([(json.dumps(self._outline()),)], "outline string").coalesce(1).write.mode("overwrite").json(f"{folder}/outline")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Tree:
        outline = json.loads(spark.read.schema("outline string").json(f"{folder}/outline").first()["outline"])
        count = iter(range(1 << 30))

        def grow(o: dict) -> Tree:
            items = [(k, open_frame(spark, f"{folder}/{next(count)}") if below is None else grow(below)) for k, below in o["items"]]
            return cls(dict(items) if o["mapping"] else [v for _, v in items], o["name"])

        return grow(outline)


def as_frame(x: LabeledFrame | Tree | list, dim: str = "first", tolerance=None) -> LabeledFrame:
    """One frame of a frame, or of a flat sequence of frames that fit together."""
    from .setops import combine_by_coords

    if isinstance(x, LabeledFrame):
        return x
    parts = x.values() if isinstance(x, Tree) else list(x)
    if any(isinstance(p, Tree) for p in parts):
        raise ValueError("only a flat collection can become one frame")
    made = combine_by_coords(parts, dim, tolerance, squeeze=True)
    if isinstance(made, list):
        raise ValueError(f"the parts don't fit together: {len(made)} are left")
    return made


def unique(items: list):
    """Each item once, in order; a single one by itself."""
    kept = list(dict.fromkeys(items))
    return kept[0] if len(kept) == 1 else kept
