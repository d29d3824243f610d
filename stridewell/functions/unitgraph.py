"""Units as a graph of affine conversions.

Nodes are units; an edge (a, b, scale, offset) says ``b = scale * a + offset``.
Conversions to the canonical unit of a dimension are shortest compositions of
edges.  Edges that aren't part of a shortest path close cycles; every cycle must
come back to the identity, or the graph is refused.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

# Conversions between neighbouring units (definitions of the units).
EDGES = [
    ("mm", "cm", 0.1, 0.0), ("cm", "m", 0.01, 0.0), ("mm", "m", 0.001, 0.0), ("m", "km", 0.001, 0.0), ("in", "cm", 2.54, 0.0),
    ("in", "ft", 1 / 12, 0.0), ("ft", "m", 0.3048, 0.0), ("ft", "yd", 1 / 3, 0.0), ("yd", "m", 0.9144, 0.0), ("mi", "km", 1.609344, 0.0),
    ("ns", "us", 0.001, 0.0), ("us", "ms", 0.001, 0.0), ("ms", "s", 0.001, 0.0), ("ns", "s", 1e-9, 0.0), ("s", "min", 1 / 60, 0.0),
    ("min", "h", 1 / 60, 0.0), ("h", "d", 1 / 24, 0.0),
    ("mHz", "Hz", 0.001, 0.0), ("kHz", "Hz", 1000.0, 0.0), ("MHz", "kHz", 1000.0, 0.0), ("MHz", "Hz", 1e6, 0.0), ("GHz", "MHz", 1000.0, 0.0),
    ("/min", "Hz", 1 / 60, 0.0), ("/h", "/min", 1 / 60, 0.0),
    ("degC", "K", 1.0, 273.15), ("degF", "degC", 5 / 9, -160 / 9), ("degF", "K", 5 / 9, 273.15 - 160 / 9),
]

# Canonical unit of each dimension.
CANONICAL = {"length": "m", "time": "s", "rate": "Hz", "temperature": "K"}

# Spellings of units, in lower case.
SPELLINGS = {
    "length": {
        "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters", "millimètres"],
        "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter", "centimètres"],
        "m": ["m", "mtr", "mtrs", "metre", "metres", "meter", "meters", "mètre", "mètres"],
        "km": ["km", "kilometre", "kilometres", "kilometer", "kilometers", "kilomètres"],
        "in": ["inch", "inches", '"', "zoll", "pouces"],
        "ft": ["ft", "foot", "feet", "'", "fuss", "fuß", "pied", "pieds"],
        "yd": ["yd", "yds", "yard", "yards"],
        "mi": ["mile", "miles"],
    },
    "time": {
        "ns": ["ns", "nsec", "nanosec", "nanosecond", "nanoseconds", "nanosekunden", "nanosecondes"],
        "us": ["us", "µs", "μs", "usec", "microsec", "microsecond", "microseconds", "mikrosekunden", "microsecondes"],
        "ms": ["ms", "msec", "millisec", "millisecond", "milliseconds", "millisekunden", "millisecondes"],
        "s": ["s", "sec", "secs", "second", "seconds", "sekunde", "sekunden", "seconde", "secondes"],
        "min": ["min", "mins", "minute", "minutes", "minuten"],
        "h": ["h", "hr", "hour", "hours", "stunden", "heures"],
    },
    "rate": {
        "Hz": ["hz", "hertz", "sps", "s/s", "/s", "1/s", "samples/s", "samples per second", "per second"],
        "kHz": ["khz", "kilohertz", "ksps", "ks/s", "kilosamples per second"],
        "MHz": ["megahertz", "msps", "megasamples per second"],
        "mHz": ["millihertz"],
        "GHz": ["ghz", "gigahertz"],
        "/min": ["/min", "per minute", "samples per minute"],
        "/h": ["/h", "per hour"],
    },
    "temperature": {"K": ["k", "kelvin"], "degC": ["c", "°c", "celsius"], "degF": ["f", "°f", "fahrenheit"]},
}

# Spellings in which the case of letters counts.
CASED = {"rate": {"MHz": ["MHz"], "mHz": ["mHz"]}}


@dataclass(frozen=True)
class Affine:
    scale: float = 1.0
    offset: float = 0.0

    def then(self, other: Affine) -> Affine:
        return Affine(other.scale * self.scale, other.scale * self.offset + other.offset)

    def inverse(self) -> Affine:
        return Affine(1 / self.scale, -self.offset / self.scale)

    def close_to(self, other: Affine, tolerance: float = 1e-9) -> bool:
        size = max(abs(self.scale), abs(other.scale))
        shift = max(abs(self.offset), abs(other.offset), 1.0)
        return abs(self.scale - other.scale) <= tolerance * size and abs(self.offset - other.offset) <= tolerance * shift


class InconsistentUnits(ValueError):
    """A cycle of conversions doesn't come back to the identity."""


def conversions(target: str, edges=EDGES) -> dict[str, Affine]:
    """Shortest composition from every unit that reaches ``target``."""
    steps: dict[str, list[tuple[str, Affine]]] = {}
    for a, b, scale, offset in edges:
        if scale == 0:
            raise InconsistentUnits(f"{a} to {b} can't be undone")
        edge = Affine(scale, offset)
        steps.setdefault(b, []).append((a, edge))
        steps.setdefault(a, []).append((b, edge.inverse()))
    to_target = {target: Affine()}
    waiting = deque([target])
    while waiting:
        unit = waiting.popleft()
        for other, into_unit in sorted(steps.get(unit, []), key=lambda x: x[0]):
            path = into_unit.then(to_target[unit])
            if other not in to_target:
                to_target[other] = path
                waiting.append(other)
            elif not path.close_to(to_target[other]):
                raise InconsistentUnits(f"two ways from {other} to {target} differ: {path} and {to_target[other]}")
    return to_target


def conversion_rows(canonical: dict[str, str] = CANONICAL, edges=EDGES) -> list[tuple[str, str, str, bool, float, float, str]]:
    """(dimension, spelling, unit, cased, scale, offset, canonical unit) of all known spellings."""
    rows = []
    for dimension, target in canonical.items():
        known = conversions(target, edges)
        for cased, table in ((False, SPELLINGS), (True, CASED)):
            for unit, spellings in table.get(dimension, {}).items():
                rows += [(dimension, s, unit, cased, known[unit].scale, known[unit].offset, target) for s in spellings]
    return rows
