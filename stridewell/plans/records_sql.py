"""SQL for the record queries that SQL can express over whole tables."""

from .instants_sql import P4_CLASSES, P4_FOUND, P4_UTC

__all__ = ["P4_CLASSES", "P4_FOUND", "P4_UTC"]

_COVERAGE = """
WITH steps AS (SELECT series_id, max(sampling_interval) AS series_step FROM segments GROUP BY series_id),
covered AS (
  SELECT DISTINCT s.series_id, tie_values AS st, tie_lengths AS n, coalesce(sampling_interval, series_step) AS step, coalesce(i0, 0) AS i0
  FROM segments s JOIN steps USING (series_id)
  WHERE tie_values IS NOT NULL AND tie_lengths >= 1)
"""

P7_FOUND = _COVERAGE + """,
far AS (
  SELECT series_id, st, st + n * step AS en, step,
    max(st + n * step) OVER (PARTITION BY series_id ORDER BY st, st + n * step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM covered WHERE step IS NOT NULL),
isl AS (
  SELECT *, sum(CASE WHEN f IS NULL OR st > f + step THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS p
  FROM far),
periods AS (SELECT series_id, p, min(st) AS a, max(en) AS b FROM isl GROUP BY series_id, p)
SELECT series_id, 'period' AS kind, a AS start_ns, b AS end_ns FROM periods
UNION ALL
SELECT series_id, 'gap', b, nxt FROM (SELECT series_id, b, lead(a) OVER (PARTITION BY series_id ORDER BY p) AS nxt FROM periods) WHERE nxt IS NOT NULL
"""

_SLOTS = _COVERAGE + """,
samples AS (
  SELECT series_id, st + k * coalesce(step, 0) AS t, i0 + k AS v
  FROM covered, LATERAL (SELECT unnest(range(CASE WHEN step IS NULL THEN 1 ELSE n END)) AS k)),
seen AS (SELECT series_id, t // 60000000000 AS slot, min((t, v)) AS fst, max((t, v)) AS lst FROM samples GROUP BY ALL),
nb AS (SELECT *, lead(slot) OVER w AS nslot, lead(fst) OVER w AS nfst FROM seen WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
slots AS (
  SELECT series_id, slot, fst[1] AS ft, fst[2] AS fv, lst[1] AS lt, lst[2] AS lv, nfst[1] AS nt, nfst[2] AS nv,
    unnest(range(slot, coalesce(nslot, slot + 1))) AS g
  FROM nb)
"""

P3_FOUND = _SLOTS + "SELECT series_id, g * 60 AS slot FROM slots WHERE g <> slot"

P3_GRID = _SLOTS + """
SELECT series_id, g * 60 AS slot,
  CASE WHEN g = slot THEN 'observed' WHEN nt - lt <= 600000000000 THEN 'filled' ELSE 'missing' END AS status,
  CASE WHEN g = slot THEN fv::DOUBLE
       WHEN nt - lt <= 600000000000 THEN lv + (g * 60000000000 - lt)::DOUBLE / (nt - lt)::DOUBLE * (nv - lv) END AS value
FROM slots
"""

_KEPT = """
WITH recs AS (SELECT DISTINCT file_id, time__ns, distance__i, value FROM file_rows WHERE file_id IS NOT NULL),
sets AS (SELECT file_id, list((time__ns, distance__i, value) ORDER BY time__ns, distance__i, value) AS s FROM recs GROUP BY file_id),
kept AS (SELECT file_id, min(file_id) OVER (PARTITION BY s) AS kept_as, len(s) AS records FROM sets)
"""

P5_FOUND = _KEPT + """
SELECT a.file_id AS file_id_a, b.file_id AS file_id_b FROM kept a JOIN kept b ON a.kept_as = b.kept_as AND a.file_id < b.file_id
"""

_PLAN = _KEPT + """,
ordered AS (
  SELECT k.file_id, k.records, coalesce(min(epoch_us(l.mtime)), 0) AS arrived FROM kept k LEFT JOIN file_list l USING (file_id)
  WHERE k.kept_as = k.file_id GROUP BY ALL),
plan AS (
  SELECT file_id, records, (coalesce(sum(records * 24) OVER (ORDER BY arrived, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 134217728)::BIGINT AS out_file
  FROM ordered)
"""

P5_RECORDS = _PLAN + "SELECT out_file, r.file_id, time__ns, distance__i, value FROM recs r JOIN plan USING (file_id)"

P5_CLASSES = _KEPT + """
SELECT file_id, kept_as AS representative, n - 1 AS links FROM (SELECT *, count(*) OVER (PARTITION BY kept_as) AS n FROM kept) WHERE n > 1
"""

P5_PLAN = _PLAN + "SELECT file_id, out_file, records FROM plan"

P5_MANIFEST = _KEPT + r""",
listed AS (
  SELECT file_id, mtime, regexp_replace(regexp_replace(regexp_replace(path, '^[a-z][a-z0-9+]*://+', '/'), '/(\./)+', '/', 'g'), '/{2,}', '/', 'g') AS path, n_records
  FROM file_list WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY mtime NULLS FIRST, path NULLS FIRST, n_records NULLS FIRST) = 1)
SELECT file_id, mtime, path, n_records AS listed_records, coalesce(records, 0) AS records, kept_as, coalesce(records, 0) * 24 AS bytes
FROM listed FULL JOIN kept USING (file_id)
"""

P5_RECONCILE = _PLAN + """
SELECT out_file, count(*) AS files, sum(records)::BIGINT AS planned_records, sum(records)::BIGINT AS written_records,
  (sum(records) * 24)::BIGINT AS bytes,
  (SELECT count(*) FROM recs WHERE file_id IN (SELECT file_id FROM kept WHERE kept_as = file_id)) = (SELECT sum(records) FROM plan) AS agrees
FROM plan GROUP BY out_file
"""

_READINGS = """
WITH b AS (
  SELECT DISTINCT 'readings' AS tbl, reading_id AS row_id, 0 AS pos, lane_id, time__ns AS t, value, range_lo, range_hi
  FROM readings LEFT JOIN instruments USING (instrument) WHERE value IS NOT NULL AND NOT isnan(value)
  UNION ALL
  SELECT tbl, row_id, k - 1, lane_id, t + (k - 1) * step_ns, samples[k], range_lo, range_hi FROM (
    SELECT DISTINCT 'packed_blocks' AS tbl, block_id AS row_id, lane_id, start_ns AS t, step_ns, samples, range_lo, range_hi
    FROM packed_blocks LEFT JOIN instruments USING (instrument)), LATERAL (SELECT unnest(range(1, len(samples) + 1)) AS k)
  WHERE NOT isnan(samples[k])),
o AS (SELECT *, coalesce(value < range_lo OR value > range_hi, false) AS oor, lag(value) OVER (PARTITION BY tbl, lane_id ORDER BY t, row_id, pos) AS pv FROM b),
r AS (SELECT *, sum(CASE WHEN pv = value THEN 0 ELSE 1 END) OVER (PARTITION BY tbl, lane_id ORDER BY t, row_id, pos ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT *, count(*) OVER (PARTITION BY tbl, lane_id, run) >= 12 AS stuck FROM r),
l AS (SELECT *, median(value) OVER (PARTITION BY tbl, lane_id ORDER BY t, row_id, pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS lev
      FROM s WHERE NOT oor AND NOT stuck),
m AS (SELECT *, abs(value - lev) > 10 * 1.4826 * median(abs(value - lev))
        OVER (PARTITION BY tbl, lane_id ORDER BY t, row_id, pos ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS far FROM l),
n AS (SELECT *, CASE WHEN far = lag(far) OVER (PARTITION BY tbl, lane_id ORDER BY t, row_id, pos) THEN 0 ELSE 1 END AS c,
        row_number() OVER (PARTITION BY tbl, lane_id ORDER BY t DESC, row_id DESC, pos DESC) AS left_over FROM m),
g AS (SELECT *, sum(c) OVER (PARTITION BY tbl, lane_id ORDER BY t, row_id, pos ROWS UNBOUNDED PRECEDING) AS k FROM n),
z AS (SELECT *, count(*) OVER (PARTITION BY tbl, lane_id, k) AS size, min(left_over) OVER (PARTITION BY tbl, lane_id, k) AS rest FROM g),
flags AS (
  SELECT tbl, row_id, pos::INTEGER AS pos, CASE WHEN oor THEN 'out of range' ELSE 'stuck' END AS cause FROM s WHERE oor OR stuck
  UNION ALL SELECT tbl, row_id, pos::INTEGER, 'spike' FROM z WHERE far AND size <= 3 AND rest > 1)
"""

P2_FLAGS = _READINGS + "SELECT tbl, row_id, pos, cause FROM flags"

P2_FOUND = _READINGS + "SELECT tbl, row_id, pos FROM flags"


def _p1_found() -> str:
    """Fields whose stated unit isn't the common one, by the same tables of words."""
    from ..functions.unitgraph import CASED, SPELLINGS
    from ..operators.units import FIELD_WORDS

    def words(dimension: str) -> str:
        found = {s.lower() for t in (SPELLINGS, CASED) for v in t.get(dimension, {}).values() for s in v if s[0].isalpha()}
        return "|".join(sorted(found, key=lambda s: (-len(s), s)))

    def remark(field: str, dimension: str) -> str:
        stop = "" if field == "spacing" else ";,/"
        pattern = (rf"(?:^|[^\pL])(?:{'|'.join(FIELD_WORDS[field])})(?:[^\pL.{stop}][^.{stop}]{{0,40}}?)?[^\pL\d.{stop}]({words(dimension)})(?:$|[^\pL\d])")
        return f"nullif(regexp_extract(lower(remarks), '{pattern}', 1), '')"

    def common(dimension: str, unit: str) -> str:
        return ", ".join("'" + s.replace("'", "''") + "'" for s in SPELLINGS[dimension][unit])

    imperial = "CASE WHEN unit_system = 'imperial' THEN 'ft' END"
    number = r"^\s*(?:every\s+)?[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?\s*(.*?)\s*$"
    clean = lambda x: f"regexp_replace(lower(trim({x})), '(.)\\.$', '\\1')"
    return f"""
WITH h AS (SELECT DISTINCT acq_id, dx, dxunit, dt, dtunit, datarate, spacing, remarks, unit_system FROM acq_headers LEFT JOIN instruments USING (instrument)),
u AS (
  SELECT acq_id, dx, dt, datarate, spacing,
    coalesce(nullif({clean('dxunit')}, ''), {remark('dx', 'length')}, {imperial}, 'm') AS dx_u,
    coalesce(nullif({clean('dtunit')}, ''), {remark('dt', 'time')}, 's') AS dt_u,
    coalesce(nullif(lower(regexp_extract(datarate, '{number}', 1)), ''), {remark('datarate', 'rate')}, 'hz') AS rate_u,
    coalesce({remark('spacing', 'length')}, {imperial}, 'm') AS sp_u, coalesce({remark('spacing', 'time')}, 'ms') AS st_u
  FROM h)
SELECT DISTINCT acq_id, field FROM (
  SELECT acq_id, 'dx' AS field FROM u WHERE dx IS NOT NULL AND dx_u NOT IN ({common('length', 'm')})
  UNION ALL SELECT acq_id, 'dt' FROM u WHERE dt IS NOT NULL AND dt_u NOT IN ({common('time', 's')})
  UNION ALL SELECT acq_id, 'datarate' FROM u WHERE regexp_matches(datarate, '{number}') AND (datarate LIKE 'every%' OR rate_u NOT IN ({common('rate', 'Hz')}))
  UNION ALL SELECT acq_id, 'spacing' FROM u WHERE (spacing[1] IS NOT NULL AND sp_u NOT IN ({common('length', 'm')})) OR (spacing[2] IS NOT NULL AND st_u NOT IN ({common('time', 'ms')})))
"""


P1_FOUND = _p1_found()


def _p1_values() -> str:
    """Every number with its unit as spelled, and its value by the known conversions."""
    from ..functions.unitgraph import CASED, SPELLINGS, conversion_rows
    from ..operators.units import FIELD_WORDS

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(d)}, {quoted(s)}, {quoted(u)}, {scale!r}::DOUBLE, {quoted(t)})" for d, s, u, _, scale, _, t in conversion_rows() if d != "temperature")
    cased = ", ".join(quoted(s) for table in CASED.values() for spellings in table.values() for s in spellings)
    times, millis = (", ".join(map(quoted, spellings)) for spellings in ([s for v in SPELLINGS["time"].values() for s in v], SPELLINGS["time"]["ms"]))

    def remark(field: str, dimension: str) -> str:
        found = {s for t in (SPELLINGS, CASED) for v in t.get(dimension, {}).values() for s in v if s[0].isalpha()}
        stop = "" if field == "spacing" else ";,/"
        words = "|".join(sorted(found, key=lambda s: (-len(s), s)))
        pattern = rf"(?:^|[^\pL])(?:{'|'.join(FIELD_WORDS[field])})(?:[^\pL.{stop}][^.{stop}]{{0,40}}?)?[^\pL\d.{stop}]({words})(?:$|[^\pL\d])"
        return f"nullif(regexp_extract(remarks, '{pattern}', 1, 'i'), '')"

    number = r"^\s*((?:every|each|alle|toutes les)\s+)?([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(.*?)\s*$"
    imperial = "CASE WHEN unit_system = 'imperial' THEN 'ft' END"
    return f"""
WITH known(dim, spelling, u, scale, target) AS (VALUES {known}),
h AS (SELECT DISTINCT acq_id, dx, dxunit, dt, dtunit, spacing, remarks, unit_system, regexp_extract(datarate, '{number}', ['every', 'n', 'unit'], 'i') AS rate FROM acq_headers LEFT JOIN instruments USING (instrument)),
items AS (
  SELECT acq_id, 'dx' AS field, 0 AS part, 'length' AS dim, dx AS value, coalesce(CASE WHEN trim(dxunit) <> '' THEN dxunit END, {remark('dx', 'length')}, {imperial}) AS unit, false AS period FROM h
  UNION ALL SELECT acq_id, 'dt', 0, 'time', dt, coalesce(CASE WHEN trim(dtunit) <> '' THEN dtunit END, {remark('dt', 'time')}), false FROM h
  UNION ALL SELECT acq_id, 'datarate', 0, CASE WHEN p THEN 'time' ELSE 'rate' END, value, unit, p FROM (
    SELECT *, rate.every <> '' OR coalesce(lower(unit) IN ({times}), false) AS p FROM (
      SELECT acq_id, rate, TRY_CAST(replace(rate.n, ',', '.') AS DOUBLE) AS value, coalesce(nullif(rate.unit, ''), {remark('datarate', 'rate')}) AS unit FROM h))
  UNION ALL SELECT acq_id, 'spacing', 0, 'length', spacing[1], coalesce({remark('spacing', 'length')}, {imperial}), false FROM h
  UNION ALL SELECT acq_id, 'spacing', 1, 'time', spacing[2], coalesce({remark('spacing', 'time')}, 'ms'), false FROM h),
spelled AS (
  SELECT *, CASE WHEN c IN ({cased}) THEN c ELSE lower(c) END AS text
  FROM (SELECT *, regexp_replace(trim(unit), '(.)\\.$', '\\1') AS c FROM items WHERE value IS NOT NULL AND NOT isnan(value)))
SELECT DISTINCT acq_id, field, part, value, unit,
  CASE WHEN period THEN false WHEN field = 'spacing' AND part = 1 THEN lower(trim(unit)) IN ({millis}) ELSE coalesce(text, '') = '' OR coalesce(u = target, false) END AS is_common,
  CASE WHEN period THEN 'Hz' ELSE CASE spelled.dim WHEN 'length' THEN 'm' WHEN 'time' THEN 's' ELSE 'Hz' END END AS common_unit,
  CASE WHEN period THEN CASE WHEN value * scale <> 0 THEN 1 / (CASE WHEN coalesce(text, '') = '' THEN value ELSE value * scale END) END
       WHEN coalesce(text, '') = '' THEN value ELSE value * scale END AS common_value
FROM spelled LEFT JOIN known ON known.dim = spelled.dim AND spelling = text
"""


P1_VALUES = _p1_values()

P6_FOUND = r"""
WITH h AS (SELECT DISTINCT device_id, header_id, file_no, attrs_json FROM zone_headers WHERE device_id IS NOT NULL AND file_no IS NOT NULL AND header_id IS NOT NULL AND json_type(attrs_json) = 'OBJECT'),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY file_no, header_id) AS seq FROM h),
a AS (SELECT device_id, header_id, seq, name, json_extract(attrs_json, '$."' || name || '"') AS j FROM n, LATERAL (SELECT unnest(json_keys(attrs_json)) AS name)),
t AS (SELECT device_id, header_id, seq, name,
        CASE json_type(j) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type,
        regexp_replace(regexp_replace(j::VARCHAR, '\s', '', 'g'), '\.0+([],}]|$)', '\1', 'g') AS val FROM a),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY device_id, name ORDER BY seq) AS island FROM t),
s AS (SELECT device_id, header_id, seq, name,
        last_value(type IGNORE NULLS) OVER w AS type, last_value(CASE WHEN type IS NOT NULL THEN val END IGNORE NULLS) OVER w AS val
      FROM i WINDOW w AS (PARTITION BY device_id, name, island ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT s.device_id, s.name, s.type, s.val, n.header_id, s.seq + 1 AS seq FROM s JOIN n ON n.device_id = s.device_id AND n.seq = s.seq + 1),
added AS (SELECT s.*, row_number() OVER (PARTITION BY s.device_id, s.seq, s.type, s.val ORDER BY s.name) AS k FROM s ANTI JOIN b USING (device_id, seq, name) WHERE s.seq > 1),
gone AS (SELECT b.*, row_number() OVER (PARTITION BY b.device_id, b.seq, b.type, b.val ORDER BY b.name) AS k FROM b ANTI JOIN s USING (device_id, seq, name)),
pairs AS (SELECT added.device_id, added.header_id, added.seq, added.name AS new, gone.name AS old FROM added JOIN gone USING (device_id, seq, type, val, k))
SELECT device_id, header_id, new AS attr, 'renamed' AS change FROM pairs
UNION ALL SELECT device_id, header_id, name, 'added' FROM added ANTI JOIN (SELECT device_id, seq, new AS name FROM pairs) USING (device_id, seq, name)
UNION ALL SELECT device_id, header_id, name, 'removed' FROM gone ANTI JOIN (SELECT device_id, seq, old AS name FROM pairs) USING (device_id, seq, name)
UNION ALL SELECT s.device_id, s.header_id, s.name, 'retyped' FROM s JOIN b USING (device_id, seq, name) WHERE s.type <> b.type
"""
