"""SQL for the filter queries: sections run as recursions, spectra as plain sums.

Coefficients are derived here from the textbook formulas once more, apart from
the engine's own designs.
"""

from __future__ import annotations

import cmath
import math

from .views import EV

RECURSIVE = EV.replace("WITH ev", "WITH RECURSIVE ev", 1)
#: The grid's lanes as series x over j, from 0.
SERIES = ", src AS (SELECT lane__i, time__i AS j, value AS x FROM g), ext AS (SELECT max(j) + 1 AS n FROM src)"
RESULT = "{time} AS time__i, lane__i, round({value}, 4) + 0.0 AS value"

Section = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2


def _sections(poles: list[complex], zeros: tuple[float, float, float], at: complex, gain: float) -> list[Section]:
    """Sections of conjugate poles, whose product has the gain at a point of the circle."""
    made = [(*zeros, -2 * p.real, abs(p) ** 2) for p in poles if p.imag > 0]
    total = math.prod(abs((b0 + b1 / at + b2 / at**2) / (1 + a1 / at + a2 / at**2)) for b0, b1, b2, a1, a2 in made)
    b0, b1, b2, a1, a2 = made[0]
    return [(b0 * gain / total, b1 * gain / total, b2 * gain / total, a1, a2), *made[1:]]


def _prototype(order: int, ripple: float | None) -> list[complex]:
    angles = [math.pi * (2 * k + order + 1) / (2 * order) for k in range(order)]
    if ripple is None:
        return [cmath.exp(1j * t) for t in angles]
    mu = math.asinh(1 / math.sqrt(10 ** (ripple / 10) - 1)) / order
    return [complex(math.sinh(mu) * math.cos(t), math.cosh(mu) * math.sin(t)) for t in angles]


def lowpass(order: int, w: float, ripple: float | None = None) -> list[Section]:
    """``w`` as a part of half the sampling rate; with a ripple (dB), Chebyshev I."""
    s = [math.tan(math.pi * w / 2) * p for p in _prototype(order, ripple)]
    return _sections([(1 + p) / (1 - p) for p in s], (1.0, 2.0, 1.0), 1.0, 1.0 if ripple is None else 10 ** (-ripple / 20))


def bandpass(order: int, lo: float, hi: float) -> list[Section]:
    a, b = math.tan(math.pi * lo / 2), math.tan(math.pi * hi / 2)
    roots = [p * (b - a) / 2 + sign * cmath.sqrt((p * (b - a) / 2) ** 2 - a * b) for p in _prototype(order, None) for sign in (1, -1)]
    return _sections([(1 + s) / (1 - s) for s in roots], (1.0, 0.0, -1.0), cmath.exp(2j * math.atan(math.sqrt(a * b))), 1.0)


def _step(inner: str, sections: list[Section], states: str) -> str:
    """One sample through all sections; ``inner`` gives lane__i, j, x0 and the states named by ``states``."""
    for k, (b0, *_) in enumerate(sections):
        inner = f"SELECT *, {b0!r} * x{k} + {states}{k}_1 AS x{k + 1} FROM ({inner})"
    after = ", ".join(
        f"{b1!r} * x{k} - ({a1!r}) * x{k + 1} + {states}{k}_2 AS z{k}_1, {b2!r} * x{k} - ({a2!r}) * x{k + 1} AS z{k}_2" for k, (_, b1, b2, a1, a2) in enumerate(sections)
    )
    return f"SELECT lane__i, j, x{len(sections)} AS y, {after} FROM ({inner})"


def iir(name: str, source: str, sections: list[Section], steady: bool = False) -> str:
    """A CTE of the filtered series (lane__i, j, y), from rest or as if the first sample had always been there."""
    held, gain = [], 1.0
    for b0, b1, b2, a1, a2 in sections:
        y = gain * (b0 + b1 + b2) / (1 + a1 + a2)
        held.append((b1 * gain - a1 * y + b2 * gain - a2 * y, b2 * gain - a2 * y) if steady else (0.0, 0.0))
        gain = y
    start = ", ".join(f"{p!r} * x AS w{k}_1, {q!r} * x AS w{k}_2" for k, (p, q) in enumerate(held))
    base = _step(f"SELECT lane__i, j, x AS x0, {start} FROM {source} WHERE j = 0", sections, "w")
    states = ", ".join(f"r.z{k}_1 AS w{k}_1, r.z{k}_2 AS w{k}_2" for k in range(len(sections)))
    more = _step(f"SELECT s.lane__i, s.j, s.x AS x0, {states} FROM {name} r JOIN {source} s ON s.lane__i = r.lane__i AND s.j = r.j + 1", sections, "w")
    return f", {name} AS ({base} UNION ALL {more})"


def both_ways(sections: list[Section], pad: int) -> str:
    """CTEs up to ``done`` (lane__i, j, y): forward and backward over the series with its ends turned over."""
    return (
        f""", longer AS (
  SELECT lane__i, j + {pad} AS j, x FROM src
  UNION ALL SELECT s.lane__i, {pad} - s.j, 2 * e.x - s.x FROM src s JOIN src e ON e.lane__i = s.lane__i AND e.j = 0 WHERE s.j BETWEEN 1 AND {pad}
  UNION ALL SELECT s.lane__i, {pad} + 2 * (n - 1) - s.j, 2 * e.x - s.x FROM src s JOIN ext ON true JOIN src e ON e.lane__i = s.lane__i AND e.j = n - 1
            WHERE s.j BETWEEN n - 1 - {pad} AND n - 2)"""
        + iir("forth", "longer", sections, True)
        + f", turned AS (SELECT lane__i, n - 1 + {2 * pad} - j AS j, y AS x FROM forth, ext)"
        + iir("back", "turned", sections, True)
        + f", done AS (SELECT lane__i, n - 1 + {pad} - j AS j, y FROM back, ext WHERE j BETWEEN {pad} AND n - 1 + {pad})"
    )


def _result(body: str, source: str, time: str = "j", where: str = "") -> str:
    return RECURSIVE + SERIES + body + " SELECT " + RESULT.format(time=time, value="y") + f" FROM {source}{where}"


def _windowed(n: int, cut: float, weights: list[float]) -> list[float]:
    """A low-pass of n taps with unit sum."""
    mid = (n - 1) / 2
    sinc = [cut if k == mid else math.sin(math.pi * cut * (k - mid)) / (math.pi * (k - mid)) for k in range(n)]
    taps = [s * w for s, w in zip(sinc, weights)]
    return [t / math.fsum(taps) for t in taps]


def _bessel(x: float) -> float:
    return math.fsum((x / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(40))


def _values(name: str, weights: list[float]) -> str:
    return f", {name}(k, w) AS (VALUES {', '.join(f'({k}, {w!r}::DOUBLE)' for k, w in enumerate(weights))})"


_HAMMING = [0.54 - 0.46 * math.cos(2 * math.pi * k / 30) for k in range(31)]
_KAISER = [_bessel(5 * math.sqrt(max(0.0, 1 - (k / 30 - 1) ** 2))) / _bessel(5) for k in range(61)]
_ONE_POLE: list[Section] = [(0.2, 0.2, 0.0, -0.6, 0.0)]

#: Spectra of the lanes: re and im at f of n.
_SPECTRUM = """, z AS (SELECT lane__i, f, sum(x * cos(2 * pi() * ((j * f) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((j * f) % n) / n)) AS im
  FROM src, ext, LATERAL (SELECT unnest(range({top})) AS f) GROUP BY ALL)"""

FILTERS = {
    "filter_lowpass": _result(iir("done", "src", lowpass(4, 0.2)), "done"),
    "sosfilt": _result(iir("done", "src", lowpass(4, 0.2)), "done"),
    "sosfiltfilt": _result(both_ways(lowpass(4, 0.2), 15), "done"),
    "filter_bandpass_zerophase": _result(both_ways(bandpass(4, 0.1, 0.4), 27), "done"),
    "filter_per_segment": RECURSIVE + SERIES.replace("SELECT lane__i, time__i AS j, value AS x FROM g", "SELECT lane__i * 4 + s AS lane__i, time__i - a AS j, value AS x FROM g JOIN (VALUES (0, 0, 100), (1, 100, 350), (2, 350, 1000000000)) v(s, a, b) ON time__i >= a AND time__i < b")
    + iir("done", "src", lowpass(4, 0.2)) + " SELECT " + RESULT.format(time="j + [0, 100, 350][lane__i % 4 + 1]", value="y").replace(" lane__i,", " lane__i // 4 AS lane__i,") + " FROM done",
    "filtfilt": _result(both_ways(_ONE_POLE, 6), "done"),
    "decimate": _result(both_ways(lowpass(8, 0.2, 0.05), 27), "done", "j // 4", " WHERE j % 4 = 0"),
    "stream_filter_decimate": RECURSIVE + SERIES + _values("h", _windowed(31, 0.2, _HAMMING))
    + ", y AS (SELECT o.lane__i, o.j, sum(s.x * w) AS y FROM src o JOIN h ON true JOIN src s ON s.lane__i = o.lane__i AND s.j = o.j - k WHERE o.j % 4 = 0 GROUP BY ALL) SELECT "
    + RESULT.format(time="j // 4", value="y") + " FROM y",
    "resample_poly": RECURSIVE + SERIES + _values("h", [2 * w for w in _windowed(61, 1 / 3, _KAISER)])
    + ", m AS (SELECT unnest(range((2 * n + 2) // 3)) AS m FROM ext), y AS (SELECT lane__i, m, sum(x * w) AS y FROM m JOIN src ON 30 + 3 * m - 2 * j BETWEEN 0 AND 60 JOIN h ON k = 30 + 3 * m - 2 * j GROUP BY ALL) SELECT "
    + RESULT.format(time="m", value="y") + " FROM y",
    "resample": RECURSIVE + SERIES + _SPECTRUM.format(top="91")
    + """, y AS (SELECT lane__i, m, sum(CASE WHEN f = 0 THEN re WHEN f = 90 THEN 2 * re * (CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END)
        ELSE 2 * (re * cos(2 * pi() * ((f * m) % 180) / 180) - im * sin(2 * pi() * ((f * m) % 180) / 180)) END) / any_value(n) AS y
      FROM z, ext, LATERAL (SELECT unnest(range(180)) AS m) GROUP BY ALL) SELECT """ + RESULT.format(time="m", value="y") + " FROM y",
    "hilbert_envelope": RECURSIVE + SERIES + _SPECTRUM.format(top="n // 2 + 1")
    + """, y AS (SELECT lane__i, m, sum(w * (re * cos(p) - im * sin(p))) / any_value(n) AS a, sum(w * (re * sin(p) + im * cos(p))) / any_value(n) AS b
      FROM (SELECT *, CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END AS w, 2 * pi() * ((f * m) % n) / n AS p FROM z, ext, LATERAL (SELECT unnest(range(n)) AS m)) GROUP BY lane__i, m)
      SELECT """ + RESULT.format(time="m", value="sqrt(a * a + b * b)") + " FROM y",
    "sliding_mean_hann": RECURSIVE + SERIES + _values("h", [0.5 - 0.5 * math.cos(2 * math.pi * k / 24) for k in range(25)])
    + """, near AS (SELECT lane__i, j, w, CASE WHEN j + k - 12 < 0 THEN 12 - j - k WHEN j + k - 12 >= n THEN 2 * (n - 1) - (j + k - 12) ELSE j + k - 12 END AS i FROM src, h, ext),
      m AS (SELECT near.lane__i, near.j, sum(w * x) / sum(w) AS m FROM near JOIN src ON src.lane__i = near.lane__i AND src.j = near.i GROUP BY ALL)
      SELECT """ + RESULT.format(time="j", value="x - m").replace(", 4)", ", 6)") + " FROM src JOIN m USING (lane__i, j)",
}
