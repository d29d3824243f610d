"""SQL for start times in mixed notations, read by the stated rules alone."""

from __future__ import annotations

from ..operators.timestamps import ABBREVIATIONS

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{2})?(?:\s*\[([A-Za-z0-9_+/-]+)\])?"
_DAY = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower({})[:3])"


def _shape(pattern: str, names: str, day: str, rest: str = r"(?:[T\s,]\s*(.*))?") -> str:
    """Texts of one shape with their day and what follows it."""
    listed = ", ".join(f"'{n}'" for n in [*names.split(), "rest"])
    return f"SELECT acq_id, tz, TRY({day}) AS day, p.rest AS rest FROM (SELECT *, regexp_extract(t, '^{pattern}{rest}$', [{listed}]) AS p FROM h WHERE regexp_matches(t, '^{pattern}{rest}$'))"


def _date(y: str, m: str, d: str) -> str:
    return f"make_date({y}::INTEGER, {m}::INTEGER, {d}::INTEGER)"


_SHAPES = [
    _shape(r"(\d{4})-(\d{1,2})-(\d{1,2})", "y m d", _date("p.y", "p.m", "p.d"), r"(?:[T\s]\s*(.*))?"),
    _shape(r"(\d{4})/(\d{1,2})/(\d{1,2})", "y m d", _date("p.y", "p.m", "p.d"), r"(?:[T\s]\s*(.*))?"),
    _shape(r"(\d{4})-?(\d{3})", "y j", "CASE WHEN year(make_date(p.y::INTEGER, 1, 1) + (p.j::INTEGER - 1)) = p.y::INTEGER THEN make_date(p.y::INTEGER, 1, 1) + (p.j::INTEGER - 1) END", r"(?:[T\s]\s*(.*))?"),
    _shape(r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "d m y", _date("p.y", "p.m", "p.d")),
    _shape(r"(\d{1,2})/(\d{1,2})/(\d{4})", "a b y", f"CASE WHEN date_order = 'mdy' THEN {_date('p.y', 'p.a', 'p.b')} ELSE {_date('p.y', 'p.b', 'p.a')} END"),
    _shape(r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]([A-Za-z]{3,9})[\s-](\d{4})", "d b y", _date("p.y", _DAY.format("p.b"), "p.d")),
    _shape(r"(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})", "b d y", _date("p.y", _DAY.format("p.b"), "p.d")),
    # digits alone: the time is spelled like the others
    r"SELECT acq_id, tz, TRY(make_date(t[1:4]::INTEGER, t[5:6]::INTEGER, t[7:8]::INTEGER)) AS day, "
    r"regexp_replace(t, '^\d{8}T?(\d{2})(\d{2})(\d{2})', '\1:\2:\3') AS rest FROM h WHERE regexp_matches(t, '^\d{8}T?\d{6}(?:[.,]\d+)?" + _ZONE + "$')",
]

_ZONES = ", ".join(f"('{name}', {minutes})" for name, minutes in ABBREVIATIONS.items())

INSTANTS = f"""
WITH h AS (
  SELECT DISTINCT acq_id, trim(CASE WHEN trim(metadata_timestamp) <> '' THEN metadata_timestamp ELSE header_time END) AS t, coalesce(tz, 'UTC') AS tz, date_order
  FROM acq_headers LEFT JOIN instruments USING (instrument) WHERE acq_id IS NOT NULL),
zones(name, minutes) AS (VALUES {_ZONES}),
days AS ({" UNION ALL ".join(_SHAPES)}),
clocks AS (
  SELECT acq_id, tz, day, rest IS NULL OR rest = '' AS bare, regexp_extract(rest, '^{_TIME}{_ZONE}$', ['h', 'm', 's', 'f', 'ap', 'zone', 'region']) AS p FROM days
  WHERE day IS NOT NULL AND (rest IS NULL OR rest = '' OR regexp_matches(rest, '^{_TIME}{_ZONE}$'))),
local AS (
  SELECT acq_id, tz, CASE WHEN bare THEN '' ELSE p.zone END AS zone, CASE WHEN bare THEN '' ELSE p.region END AS region,
    CASE WHEN bare THEN 0 WHEN p.ap = '' THEN p.h::INTEGER WHEN p.h::INTEGER BETWEEN 1 AND 12 THEN p.h::INTEGER % 12 + CASE WHEN lower(p.ap[1:1]) = 'p' THEN 12 ELSE 0 END END AS hour,
    CASE WHEN bare THEN 0 ELSE p.m::INTEGER END AS minute, CASE WHEN bare OR p.s = '' THEN 0 ELSE p.s::INTEGER END AS second,
    CASE WHEN bare THEN 0 ELSE (p.f || '000000')[1:6]::INTEGER END AS micros, epoch(day)::BIGINT * 1000000 AS day_us
  FROM clocks),
wall AS (
  SELECT *, day_us + ((hour * 60 + minute) * 60 + second)::BIGINT * 1000000 + micros AS us FROM local WHERE hour < 24 AND minute < 60 AND second <= 60),
placed AS (
  SELECT acq_id, CASE
    WHEN minutes IS NOT NULL THEN us - minutes::BIGINT * 60000000
    WHEN zone <> '' AND NOT regexp_matches(zone, '[+-]') THEN NULL
    WHEN zone <> '' THEN us - (CASE WHEN contains(zone, '-') THEN -1 ELSE 1 END) * (
      SELECT sum(CASE i WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * x::INTEGER) FROM (SELECT unnest(regexp_extract_all(zone, '\\d\\d')) AS x, generate_subscripts(regexp_extract_all(zone, '\\d\\d'), 1) AS i)) * 1000000
    ELSE CASE  -- of two passings the first
      WHEN make_timestamp(us) = (make_timestamp(us) AT TIME ZONE coalesce(nullif(region, ''), tz) - INTERVAL 1 HOUR) AT TIME ZONE coalesce(nullif(region, ''), tz)
      THEN epoch_us(make_timestamp(us) AT TIME ZONE coalesce(nullif(region, ''), tz)) - 3600000000
      ELSE epoch_us(make_timestamp(us) AT TIME ZONE coalesce(nullif(region, ''), tz)) END END AS instant
  FROM wall LEFT JOIN zones ON zones.name = upper(wall.zone)),
numbers AS (
  SELECT acq_id, CASE WHEN regexp_matches(t, '[eE]') THEN round(t::DOUBLE)::BIGINT ELSE regexp_extract(t, '^(\\d+)', 1)::BIGINT END AS n, regexp_extract(t, '\\.(\\d*)$', 1) || '000000' AS f
  FROM h WHERE regexp_matches(t, '^\\d+(\\.\\d*)?([eE][+-]?\\d+)?$') AND length(t) < 40 AND NOT regexp_matches(t, '^\\d{{14}}(\\.\\d*)?$') AND NOT regexp_matches(t, '^\\d{{20}}')),
read AS (
  SELECT acq_id, instant FROM placed WHERE instant IS NOT NULL
  UNION SELECT acq_id, CASE WHEN n < 100000000000 THEN n * 1000000 + f[1:6]::BIGINT WHEN n < 100000000000000 THEN n * 1000 + f[1:3]::BIGINT WHEN n < 100000000000000000 THEN n ELSE n // 1000 END
  FROM numbers WHERE n >= 100000000)
"""

P4_FOUND = INSTANTS + "SELECT a.acq_id AS acq_id_a, b.acq_id AS acq_id_b FROM read a JOIN read b ON a.instant = b.instant AND a.acq_id < b.acq_id"

P4_UTC = INSTANTS + "SELECT acq_id, instant AS instant_us FROM read"

P4_CLASSES = INSTANTS + """
SELECT acq_id, representative, n - 1 AS links FROM (SELECT acq_id, min(acq_id) OVER (PARTITION BY instant) AS representative, count(*) OVER (PARTITION BY instant) AS n FROM read) WHERE n > 1
"""
