"""Timestamps in mixed notations and zones, brought to one UTC instant.

Every value is read in all ways that are valid: each gives a candidate
(notation, UTC microseconds, cost).  What is stated (a zone in the text, the
instrument's zone, its order of day and month) costs nothing; what is merely
possible costs.  Over a source's record order, Viterbi chooses the candidates
with the least sum of costs, of notation switches and of backward jumps.  A
reading that contradicts a statement costs more than any switches and jumps it
could save, so it is chosen only where no stated reading is valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import time_blocks

SWITCH_COST = 1.0
BACKWARD_COST = 0.5
GUESS_COST = 2.0
CONTRADICTION_COST = 1000.0

# Abbreviations of zones, in minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

# Month names.
MONTHS = {m: k + 1 for k, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}

_EPOCH = datetime(1970, 1, 1)
_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?P<zone>Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{2})?(?:\s*\[(?P<region>[A-Za-z0-9_+/-]+)\])?"
#: Dates, by notation; each with the time and the zone that may follow.
_SHAPES = [
    ("iso", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?:[T\s]\s*" + _TIME + _ZONE + ")?"),
    ("iso slash", r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})(?:[T\s]\s*" + _TIME + _ZONE + ")?"),
    ("ordinal", r"(?P<y>\d{4})-?(?P<j>\d{3})(?:[T\s]\s*" + _TIME + _ZONE + ")?"),
    ("basic", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d+))?" + _ZONE),
    ("digits", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d+))?" + _ZONE),
    ("dots", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})(?:[T\s,]\s*" + _TIME + _ZONE + ")?"),
    ("slash dmy", r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4})(?:[T\s,]\s*" + _TIME + _ZONE + ")?"),
    ("slash mdy", r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})(?:[T\s,]\s*" + _TIME + _ZONE + ")?"),
    ("named", r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[\s-](?P<b>[A-Za-z]{3,9})[\s-](?P<y>\d{4})(?:[T\s,]\s*" + _TIME + _ZONE + ")?"),
    ("named us", r"(?:[A-Za-z]{3,9},?\s+)?(?P<b>[A-Za-z]{3,9})\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4})(?:[T\s,]\s*" + _TIME + _ZONE + ")?"),
]
_PATTERNS = [(name, re.compile(pattern)) for name, pattern in _SHAPES]
_NUMBER = re.compile(r"[+-]?(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?")


_ZEROS = str.maketrans("123456789", "000000000")


@lru_cache(maxsize=20_000)
def _shapes_of(outline: str) -> tuple[int, ...]:
    """Shapes that fit a text, which its digits have no say in: found once for all texts of one outline."""
    return tuple(k for k, (_, pattern) in enumerate(_PATTERNS) if pattern.fullmatch(outline))


@lru_cache(maxsize=1024)
def _region(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ValueError, KeyError, OSError):
        return None


def _micros(t: datetime) -> int:
    d = t - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def local_to_utc(local: datetime, zone: ZoneInfo) -> int:
    """UTC microseconds of a local time: the first passing of a repeated hour;
    a time in a skipped hour is moved forward by the hour's length."""
    return _micros((local.replace(tzinfo=zone, fold=0)).astimezone(timezone.utc).replace(tzinfo=None))


def _number(text: str) -> list[tuple[str, int, float]]:
    """Seconds, milli-, micro- or nanoseconds since 1970, by the number's size."""
    found = _NUMBER.fullmatch(text)
    if not found or len(text) > 60:
        return []
    whole, fraction, power = found[1], found[2] or "", int(found[3] or 0)
    if abs(power) > 30:
        return []
    digits = int(whole + fraction)
    shift = power - len(fraction)
    size = digits * 10**shift if shift >= 0 else digits // 10**-shift
    sign = -1 if text.startswith("-") else 1
    readings = []
    for name, low, high, to_us in (("epoch s", 10**8, 10**11, 6), ("epoch ms", 10**11, 10**14, 3), ("epoch us", 10**14, 10**17, 0), ("epoch ns", 10**17, 10**20, -3)):
        if low <= size < high:
            p = shift + to_us
            value = digits * 10**p if p >= 0 else digits // 10**-p
            readings.append((name, sign * value, 0.0))
    return readings


def candidates(text: str | None, zone: str | None = None, date_order: str | None = None) -> list[tuple[str, int, float]]:
    """All valid readings of a text as (notation, UTC microseconds, cost).

    Further digits than microseconds are cut off.  Texts that can't be read
    (null, blank, no date, impossible dates such as 0000-00-00) give none.
    """
    text = (text or "").strip()
    if not text:
        return []
    readings: dict[tuple[str, int], float] = {}
    for k in _shapes_of(text.translate(_ZEROS)) if len(text) <= 120 else range(len(_PATTERNS)):
        name, pattern = _PATTERNS[k]
        found = pattern.fullmatch(text)
        if not found:
            continue
        part = found.groupdict()
        try:
            if part.get("j"):
                day = datetime(int(part["y"]), 1, 1) + timedelta(days=int(part["j"]) - 1)
                if day.year != int(part["y"]):
                    continue
            else:
                month = MONTHS.get(part["b"][:3].lower(), 0) if part.get("b") else int(part["m"])
                day = datetime(int(part["y"]), month, int(part["d"]))
            hour = int(part.get("H") or 0)
            if part.get("ap"):
                if not 1 <= hour <= 12:
                    continue
                hour = hour % 12 + (12 if part["ap"][0] in "pP" else 0)
            leap = int(part.get("S") or 0) == 60
            local = day.replace(hour=hour, minute=int(part.get("M") or 0), second=59 if leap else int(part.get("S") or 0))
            local += timedelta(seconds=leap, microseconds=int(((part.get("f") or "") + "000000")[:6]))
        except (ValueError, OverflowError):
            continue
        cost = 0.0
        if name in ("slash dmy", "slash mdy"):
            if date_order in ("dmy", "mdy"):
                cost = 0.0 if name.endswith(date_order) else CONTRADICTION_COST
            else:
                cost = GUESS_COST if name == "slash mdy" else 0.0
        for instant, more in _instants(local, part.get("zone"), part.get("region"), zone):
            key = (name, instant)
            readings[key] = min(readings.get(key, np.inf), cost + more)
    if not re.fullmatch(r"\d{14}(\.\d*)?", text):  # 14 digits are a date and time
        for name, instant, cost in _number(text):
            readings.setdefault((name, instant), cost)
    return [(name, instant, cost) for (name, instant), cost in readings.items()]


def _instants(local: datetime, stated: str | None, region: str | None, own: str | None) -> list[tuple[int, float]]:
    try:
        if stated:
            offset = ABBREVIATIONS.get(stated.upper())
            if offset is not None:
                return [(_micros(local) - offset * 60_000_000, 0.0)]
            signed = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?(?::?(\d{2}))?", stated)
            if signed is None:
                return []  # a word that is no zone
            seconds = int(signed[2]) * 3600 + int(signed[3] or 0) * 60 + int(signed[4] or 0)
            return [(_micros(local) - (seconds if signed[1] == "+" else -seconds) * 1_000_000, 0.0)]
        named = _region(region or own or "UTC")
        if named is None:
            return [(_micros(local), GUESS_COST)]
        first = local_to_utc(local, named)
        second = _micros(local.replace(tzinfo=named, fold=1).astimezone(timezone.utc).replace(tzinfo=None))
        # in a repeated hour, the second passing is possible but not what the rule says
        return [(first, 0.0)] + ([(second, CONTRADICTION_COST)] if second > first else [])
    except (ValueError, OverflowError):
        return []


def viterbi(readings: list[list[tuple[str, int, float]]]) -> list[int]:
    """Index of the chosen candidate for each record that has any (others: -1).

    A record with one candidate fixes the path there, so the sequence falls
    apart into stretches between such records.
    """
    chosen = [-1] * len(readings)
    back: list[tuple[int, list[int]]] = []
    score: list[float] = []
    previous: list[tuple[str, int, float]] = []

    def close(best: int) -> None:
        for at, links in reversed(back):
            chosen[at] = best
            best = links[best]
        back.clear()

    for i, here in enumerate(readings):
        if not here:
            continue
        if previous:
            links, now = [], []
            for name, instant, cost in here:
                ways = [
                    s + (SWITCH_COST if name != n else 0.0) + (BACKWARD_COST if instant < t else 0.0)
                    for s, (n, t, _) in zip(score, previous)
                ]
                k = int(np.argmin(ways))
                links.append(k)
                now.append(ways[k] + cost)
        else:
            links, now = [0] * len(here), [c for _, _, c in here]
        back.append((i, links))
        score, previous = now, here
        if len(here) == 1:
            close(0)
            score, back = [0.0], []
    if back:
        close(int(np.argmin(score)))
    return chosen


def normalise(df: DataFrame, id_col: str, source: str, text: str, order: str, *, zone: str = "tz", date_order: str = "date_order",
              target: int = 50_000, halo: int = 512) -> DataFrame:
    """One UTC instant for every record whose text can be read.

    Columns: id, notation, instant_us (long) and n_readings (size of the array
    of candidates).  ``order`` is a long column: the source's record order (ties by id, or by the hash
    of ids that aren't whole numbers; null times come first).  Records whose text can't be read have null notation and instant and
    n_readings 0.  A null source is a source of its own; null ``zone`` means UTC;
    with a null ``date_order`` both orders are candidates.  Rows with the same id
    and text come out once.  Long sources are cut into blocks; each begins
    ``halo`` records early, so that a record with one candidate fixes the path.
    """
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"),
        F.col(order).cast("long").alias("at"), F.col(zone).cast("string").alias("zone"), F.col(date_order).cast("string").alias("date_order"),
    )
    rows = rows.withColumn("source", F.coalesce("source", F.lit("")))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = rows.withColumn("tie", F.col("id").cast("long") if whole else F.xxhash64("id"))
    rows = time_blocks(rows, "source", "at", target=target, halo=halo, ties="tie")
    rows = rows.repartition("source", "block").sortWithinPartitions("source", "block", "at", "tie", "id").drop("tie")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["source", "block"]):
            table = group.to_pandas()
            known: dict[tuple, list] = {}
            keys = list(zip(table["text"], table["zone"], table["date_order"]))
            readings = [known[k] if k in known else known.setdefault(k, candidates(*k)) for k in keys]
            best = viterbi(readings)
            core = table["core"].to_numpy()
            out = [(r[b][0], r[b][1]) if b >= 0 else (None, None) for r, b in zip(readings, best)]
            made = pd.DataFrame({"id": table["id"], "notation": [n for n, _ in out], "n_readings": [len(r) for r in readings]})
            made = pa.Table.from_pandas(made[core], preserve_index=False)
            instants = pa.array([t for (_, t), c in zip(out, core) if c], pa.int64())
            made = made.append_column("instant_us", instants).select(["id", "notation", "instant_us", "n_readings"])
            yield from made.cast(schema).to_batches()

    schema = pa.schema([("id", pa.int64() if id_type == "bigint" else pa.string()), ("notation", pa.string()), ("instant_us", pa.int64()), ("n_readings", pa.int32())])
    if id_type != "bigint":
        rows = rows.withColumn("id", F.col("id").cast("string"))
    out = rows.mapInArrow(run, f"id {'bigint' if id_type == 'bigint' else 'string'}, notation string, instant_us long, n_readings int")
    return out.withColumnRenamed("id", id_col).distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one group each, from batches in which groups follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            coded = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= coded[1:] != coded[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            name = tuple(c[lo].as_py() for c in columns)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = name
    if held:
        yield pa.Table.from_batches(held)
