"""The array queries, each beside its SQL."""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import axis, labels, picking, setops, signal
from .. import coords as C
from ..frame import Collection, LabeledFrame, binary, choose, divide, idx
from ..functions import elementwise as E
from ..tables import table
from .filters_sql import FILTERS
from .views import EMB, EV, HOUR_NS, LI, emb_mat, ev_counts, ev_grid, ev_raw, li_cube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


def tidy(x) -> F.Column:
    return F.round(x, 6) + F.lit(0.0)


def out(f: LabeledFrame, *extra: str) -> DataFrame:
    """Index columns and the value, rounded so that sums in another order compare equal."""
    kind = f.df.schema[f.value].dataType.simpleString()
    v = F.col(f.value)
    return f.df.select(*[idx(d) for d in f.dims], *extra, (tidy(v) if kind in ("double", "float") else v).alias("value"))


def out4(f: LabeledFrame) -> DataFrame:
    """The same to four decimals, for chains of many sums."""
    return f.df.select(*[idx(d) for d in f.dims], (F.round(f.value, 4) + F.lit(0.0)).alias("value"))


R = "round({}, 6) + 0.0"
GRID = "time__i, lane__i, round({}, 6) + 0.0 AS value"

# -- scans and selections ------------------------------------------------------------------
EVENTS = "SELECT event_id, event_type, value FROM events"
query("scan_events", EVENTS)(lambda s, d: table(s, d, "events").select("event_id", "event_type", "value"))

T0, T1 = "2024-01-05T06:00:00", "2024-01-09T18:00:00"
A0, A1 = T0.replace("T", " "), T1.replace("T", " ")


@query("sel_time_range", f"SELECT event_id, value FROM events WHERE ts BETWEEN '{A0}' AND '{A1}'")
def _(s, d):
    f = LabeledFrame(table(s, d, "events"), (), {"time": C.Column("ts")})  # the predicate reaches the scan
    return f.sel(time=slice(T0, T1)).df.select("event_id", "value")


@query("sel_time_endpoint_excl", EV + f"""SELECT h - epoch_us(TIMESTAMP '{A0}') // 3600000000 AS time__i, lane__i, round(value, 6) + 0.0 AS value
FROM g WHERE h >= epoch_us(TIMESTAMP '{A0}') // 3600000000 AND h < epoch_us(TIMESTAMP '{A1}') // 3600000000""")
def _(s, d):
    return out(ev_grid(s, d).sel(time=slice(T0, T1), endpoint=False))


_PROBE = "2024-01-07T12:34:56"
_P = "epoch_us(TIMESTAMP '2024-01-07 12:34:56')"
for _method, _cond in (("nearest", f"abs(epoch_us(ts) - {_P}) = (SELECT min(abs(epoch_us(ts) - {_P})) FROM events)"),
                       ("ffill", f"epoch_us(ts) = (SELECT max(epoch_us(ts)) FROM events WHERE epoch_us(ts) <= {_P})"),
                       ("bfill", f"epoch_us(ts) = (SELECT min(epoch_us(ts)) FROM events WHERE epoch_us(ts) >= {_P})")):
    query(f"sel_{_method}", f"SELECT event_id, value FROM events WHERE {_cond}")(
        lambda s, d, m=_method: ev_raw(s, d).sel(time=_PROBE, method=m).df.select("event_id", "value")
    )

query("isel_slice_step", EV + f"SELECT (time__i - 10) // 7 AS time__i, lane__i, {R.format('value')} AS value FROM g WHERE time__i >= 10 AND time__i < 200 AND (time__i - 10) % 7 = 0")(
    lambda s, d: out(ev_grid(s, d).isel(time=slice(10, 200, 7))))
query("isel_negative", EV + f"SELECT lane__i, {R.format('value')} AS value FROM g WHERE time__i = (SELECT max(time__i) FROM g) - 2")(
    lambda s, d: out(ev_grid(s, d).isel(time=-3)))
query("isel_array", EV + f", w AS (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 3), (3, 100)) w(i, o)) SELECT i::BIGINT AS time__i, lane__i, {R.format('value')} AS value FROM g JOIN w ON time__i = o")(
    lambda s, d: out(ev_grid(s, d).isel(time=[5, 3, 3, 100])))
query("sel_lane", EV + f"SELECT time__i, {R.format('value')} AS value FROM g WHERE lane = (SELECT min(lane) FROM g)")(
    lambda s, d: (lambda f: out(f.sel(lane=f.coords["lane"].data[0])))(ev_grid(s, d)))
query("getitem_position", EV + f"SELECT time__i, {R.format('value')} AS value FROM g WHERE time__i < 24 AND lane__i = 1")(
    lambda s, d: out(ev_grid(s, d)[:24, 1]))
query("loc_labels", EV + f"SELECT h - epoch_us(TIMESTAMP '{A0}') // 3600000000 AS time__i, lane__i, {R.format('value')} AS value FROM g WHERE h BETWEEN epoch_us(TIMESTAMP '{A0}') // 3600000000 AND epoch_us(TIMESTAMP '{A1}') // 3600000000")(
    lambda s, d: out(ev_grid(s, d).loc[T0:T1]))
query("setitem_region", EV + f"SELECT time__i, lane__i, CASE WHEN time__i >= 5 AND time__i < 9 AND lane__i = 0 THEN -1.0 ELSE {R.format('value')} END AS value FROM g")(
    lambda s, d: out(ev_grid(s, d).where_set({"time": slice(5, 9), "lane": 0}, -1.0)))


_ASOF = """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) * 1000 AS t, value FROM events),
r AS (SELECT event_type, t, {pick}(value) AS value FROM e WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT l.event_id, r.t AS match, r.value AS match_value FROM e l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.t {sign} r.t WHERE l.event_id % 2 = 0
"""
for _direction, _pick, _sign in (("ffill", "max", ">="), ("bfill", "min", "<=")):
    @query(f"asof_{_direction}", _ASOF.format(pick=_pick, sign=_sign))
    def _(s, d, direction=_direction):
        events = ev_raw(s, d).df
        left, right = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1").select("lane", "time_ns", "value")
        return picking.asof(left.select("lane", "time_ns", "event_id"), right, "time_ns", ["lane"], direction).select("event_id", "match", "match_value")


query("query_fnmatch", "SELECT event_type, count(*) AS n FROM events WHERE event_type GLOB '*c*' GROUP BY 1")(
    lambda s, d: Collection(table(s, d, "events"), ("event_type",)).query(event_type="*c*").df.groupBy("event_type").agg(F.count("*").alias("n")))
query("drop_dim", EV + f"SELECT time__i, {R.format('value')} AS value FROM g WHERE lane__i = 0")(
    lambda s, d: out(ev_grid(s, d).isel({"lane": 0}, drop=True)))
query("transpose", EV + f"SELECT {GRID.format('value')} FROM g")(lambda s, d: out(ev_grid(s, d).transpose("lane", "time")))
query("expand_dims", EV + f"SELECT 0::BIGINT AS site__i, {GRID.format('value')} FROM g")(lambda s, d: out(ev_grid(s, d).expand_dims("site")))
query("rename", EV + f"SELECT time__i, lane__i AS channel__i, {R.format('value')} AS value FROM g")(lambda s, d: out(ev_grid(s, d).rename(lane="channel")))
query("swap_dims", EV + f"SELECT time__i AS hour__i, lane__i, {R.format('value')} AS value FROM g")(
    lambda s, d: (lambda f: out(f.assign_coords(hour=("time", C.Default(f.size("time"), "time"))).swap_dims(time="hour")))(ev_grid(s, d)))
query("assign_coords", EV + "SELECT lane__i, CAST(lane__i * 10 AS DOUBLE) AS distance, count(*) AS n FROM g GROUP BY ALL")(
    lambda s, d: (lambda f: f.assign_coords(distance=("lane", np.arange(f.size("lane")) * 10.0)).frame().groupBy("lane__i", "distance").agg(F.count("*").alias("n")))(ev_grid(s, d)))
query("coord_value_sampled", EV + "SELECT DISTINCT time__i, h * 3600000000000 AS time FROM g")(lambda s, d: ev_grid(s, d).coord_frame("time"))
query("coord_value_interp", LI + "SELECT m - (SELECT min(m) FROM li) AS month__i, m::DOUBLE AS month FROM (SELECT unnest(range((SELECT min(m) FROM li), (SELECT max(m) FROM li) + 1)) AS m)")(
    lambda s, d: li_cube(s, d).coord_frame("month").withColumn("month", F.round("month", 9)))
query("to_dataarray", EV + "SELECT lane__i, lane FROM lanes")(lambda s, d: ev_grid(s, d).coord_frame("lane"))

# -- reductions ------------------------------------------------------------------------------
_AGG = {
    "sum": "coalesce(sum({x}), 0)", "mean": "avg({x})", "min": "min({x})", "max": "max({x})", "std": "stddev_pop({x})", "var": "var_pop({x})",
    "median": "median({x})", "percentile": "quantile_cont({x}, 0.9)", "quantile": "quantile_cont({x}, 0.25)", "count_nonzero": "count(*) FILTER (WHERE {x} IS NULL OR {x} <> 0)",
    "all": "bool_and({x} IS NULL OR {x} <> 0)", "any": "bool_or({x} IS NULL OR {x} <> 0)",
}
_OPTS = {"percentile": {"q": 90}, "quantile": {"q": 0.25}}
_SKIP = {"sum", "mean", "min", "max", "std", "var", "median", "percentile", "quantile"}


def _reduction(how: str, template: str) -> None:
    opts = _OPTS.get(how, {})
    plain = how in ("count_nonzero", "all", "any")
    body = template.format(x="x") if plain else R.format(f"coalesce({template.format(x='x')}, 'NaN'::DOUBLE)")
    query(f"red_{how}_dim", EV + f"SELECT lane__i, {body} AS value FROM gn GROUP BY lane__i")(lambda s, d: out(ev_grid(s, d, True).reduce(how, "time", **opts)))
    query(f"red_{how}_lane", EV + f"SELECT time__i, {body} AS value FROM gn GROUP BY time__i")(lambda s, d: out(ev_grid(s, d, True).reduce(how, "lane", **opts)))
    query(f"red_{how}_all", EV + f"SELECT {body} AS value FROM gn")(lambda s, d: out(ev_grid(s, d, True).reduce(how, **opts)))
    if how in _SKIP:
        strict = f"CASE WHEN bool_or(x IS NULL) THEN 'NaN'::DOUBLE ELSE {R.format(template.format(x='x'))} END"
        query(f"red_{how}_skipna_false", EV + f"SELECT time__i, {strict} AS value FROM gn GROUP BY time__i")(
            lambda s, d: out(ev_grid(s, d, True).reduce(how, "lane", skipna=False, **opts)))


for _how, _template in _AGG.items():
    _reduction(_how, _template)

query("red_prod_dim", LI + f"SELECT month__i, status__i, {R.format('product(value / 977)')} AS value FROM cube GROUP BY month__i, status__i")(
    lambda s, d: out(li_cube(s, d).apply(lambda x: x / 977).reduce("prod", "flag")))
query("red_ptp_dim", EV + f"SELECT lane__i, {R.format('max(value) - min(value)')} AS value FROM g GROUP BY lane__i")(lambda s, d: out(ev_grid(s, d).reduce("ptp", "time")))
query("red_average_dim", EV + f"SELECT lane__i, {R.format('sum(value * (time__i + 1)) / sum(time__i + 1)')} AS value FROM g GROUP BY lane__i")(
    lambda s, d: out(ev_grid(s, d).reduce("average", "time", weights=(F.col("time__i") + 1).cast("double"))))
query("red_std_ddof1", EV + f"SELECT lane__i, {R.format('stddev_samp(value)')} AS value FROM g GROUP BY lane__i")(lambda s, d: out(ev_grid(s, d).reduce("std", "time", ddof=1)))
for _how, _order in (("argmax", "DESC"), ("argmin", "ASC")):
    query(f"red_{_how}_dim", EV + f"SELECT lane__i, time__i AS value FROM gn WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lane__i ORDER BY x {_order}, time__i) = 1")(
        lambda s, d, h=_how: out(ev_grid(s, d, True).reduce(h, "time")))
    query(f"red_{_how}_all", EV + f"SELECT time__i * (SELECT count(*) FROM lanes) + lane__i AS value FROM gn WHERE x IS NOT NULL ORDER BY x {_order}, time__i, lane__i LIMIT 1")(
        lambda s, d, h=_how: out(ev_grid(s, d, True).reduce(h)))
query("red_cube_sum", LI + f"SELECT flag__i, {R.format('sum(value)')} AS value FROM cube GROUP BY flag__i")(
    lambda s, d: out(li_cube(s, d).reduce("sum", "month").reduce("sum", "status")))

# -- along an axis -----------------------------------------------------------------------------
_W = "OVER (PARTITION BY lane__i ORDER BY time__i)"
query("cumsum", EV + f"SELECT {GRID.format(f'sum(coalesce(x, 0)) {_W}')} FROM gn")(lambda s, d: out(axis.cumsum(ev_grid(s, d, True), "time")))
query("cumsum_blocks", EV + f"SELECT {GRID.format(f'sum(value) {_W}')} FROM g")(lambda s, d: out(axis.cumsum(ev_grid(s, d), "time", block=64)))
query("cumprod", LI + f"SELECT month__i, flag__i, status__i, {R.format('product(value / 5000) OVER (PARTITION BY month__i, status__i ORDER BY flag__i ROWS UNBOUNDED PRECEDING)')} AS value FROM cube")(
    lambda s, d: out(axis.cumprod(li_cube(s, d).apply(lambda x: x / 5000), "flag")))
query("diff_upper", EV + f"SELECT time__i - 1 AS time__i, lane__i, {R.format('v')} AS value FROM (SELECT *, value - lag(value) {_W} AS v FROM g) WHERE v IS NOT NULL")(
    lambda s, d: out(axis.diff(ev_grid(s, d), "time")))
query("diff_lower", EV + f"SELECT {GRID.format('v')} FROM (SELECT *, lead(value) {_W} - value AS v FROM g) WHERE v IS NOT NULL")(
    lambda s, d: out(axis.diff(ev_grid(s, d), "time", label="lower")))
query("diff_second", EV + f"SELECT time__i - 2 AS time__i, lane__i, {R.format('v')} AS value FROM (SELECT *, value - 2 * lag(value) {_W} + lag(value, 2) {_W} AS v FROM g) WHERE v IS NOT NULL")(
    lambda s, d: out(axis.diff(ev_grid(s, d), "time", n=2)))
query("integrate", EV + f"SELECT {GRID.format(f'sum(value) {_W} * 3600')} FROM g")(lambda s, d: out(axis.integrate(ev_grid(s, d), "time")))
query("differentiate", EV + f"SELECT {GRID.format('v / 3600')} FROM (SELECT *, lead(value) {_W} - value AS v FROM g) WHERE v IS NOT NULL")(
    lambda s, d: out(axis.differentiate(ev_grid(s, d), "time")))
query("trapezoid", EV + f"SELECT lane__i, {R.format('sum(v) * 3600')} AS value FROM (SELECT *, (value + lead(value) {_W}) / 2 AS v FROM g) GROUP BY lane__i")(
    lambda s, d: out(axis.trapezoid(ev_grid(s, d), "time")))
query("detrend_constant", EV + f"SELECT {GRID.format('value - avg(value) OVER (PARTITION BY lane__i)')} FROM g")(
    lambda s, d: out(axis.detrend(ev_grid(s, d), "constant", "time")))
query("detrend_linear", EV + ", r AS (SELECT lane__i, regr_slope(value, time__i) AS a, regr_intercept(value, time__i) AS b FROM g GROUP BY 1) "
      f"SELECT {GRID.format('value - a * time__i - b')} FROM g JOIN r USING (lane__i)")(lambda s, d: out(axis.detrend(ev_grid(s, d), "linear", "time")))
query("taper_hann", EV + f"SELECT {GRID.format('value * (0.5 - 0.5 * cos(2 * pi() * time__i / (hi - lo)))')} FROM g, b")(
    lambda s, d: out(axis.taper(ev_grid(s, d), "hann", dim="time")))
query("segment_mean_removal", EV + ", w AS (SELECT *, time__i // 100 AS seg, 0.5 - 0.5 * cos(2 * pi() * (time__i % 100) / 100) AS w FROM g) "
      f"SELECT {GRID.format('CASE WHEN time__i < 300 THEN value - sum(value * w) OVER p / sum(w) OVER p ELSE value END')} FROM w WINDOW p AS (PARTITION BY lane__i, seg)")(
    lambda s, d: out(axis.segment_mean_removal(ev_grid(s, d), [0, 100, 200, 300], "hann", "time")))
query("sliding_mean_boxcar", EV + ", k AS (SELECT unnest(range(-12, 13)) AS k), near AS (SELECT g.lane__i, g.time__i, CASE WHEN g.time__i + k < 0 THEN -(g.time__i + k) "
      "WHEN g.time__i + k > hi - lo THEN 2 * (hi - lo) - (g.time__i + k) ELSE g.time__i + k END AS j FROM g, k, b), "
      "m AS (SELECT n.lane__i, n.time__i, avg(g.value) AS m FROM near n JOIN g ON g.lane__i = n.lane__i AND g.time__i = n.j GROUP BY ALL) "
      f"SELECT {GRID.format('value - m')} FROM g JOIN m USING (lane__i, time__i)")(
    lambda s, d: out(axis.sliding_mean_removal(ev_grid(s, d), 24 * 3600, "boxcar", "time")))
query("sliding_mean_hann", FILTERS["sliding_mean_hann"])(lambda s, d: out(axis.sliding_mean_removal(ev_grid(s, d), 24 * 3600, "hann", "time")))
query("medfilt_k3", EV + f", n AS (SELECT *, coalesce(lag(value) {_W}, 0) AS a, coalesce(lead(value) {_W}, 0) AS c FROM g) "
      f"SELECT {GRID.format('a + value + c - greatest(a, value, c) - least(a, value, c)')} FROM n")(lambda s, d: out(axis.medfilt(ev_grid(s, d), {"time": 3})))
query("medfilt_2d", EV + ", k AS (SELECT dt, dl FROM (SELECT unnest(range(-1, 2)) AS dt), (SELECT unnest(range(-1, 2)) AS dl)), "
      "near AS (SELECT g.lane__i, g.time__i, coalesce(o.value, 0) AS v FROM g CROSS JOIN k LEFT JOIN g o ON o.lane__i = g.lane__i + dl AND o.time__i = g.time__i + dt) "
      f"SELECT {GRID.format('median(v)')} FROM near GROUP BY lane__i, time__i")(lambda s, d: out(axis.medfilt(ev_grid(s, d), {"time": 3, "lane": 3})))
query("fir_lfilter", EV + f"SELECT {GRID.format(f'0.5 * value + 0.3 * coalesce(lag(value) {_W}, 0) + 0.2 * coalesce(lag(value, 2) {_W}, 0)')} FROM g")(
    lambda s, d: out(axis.fir(ev_grid(s, d), [0.5, 0.3, 0.2], "time")))
query("downsample", EV + f"SELECT time__i // 4 AS time__i, lane__i, {R.format('value')} AS value FROM g WHERE time__i % 4 = 0")(lambda s, d: out(axis.downsample(ev_grid(s, d), 4, "time")))
query("upsample", EV + f"SELECT time__i * 3 + k AS time__i, lane__i, {R.format('CASE WHEN k = 0 THEN 3 * value ELSE 0 END')} AS value FROM g, (SELECT unnest(range(3)) AS k)")(
    lambda s, d: out(axis.upsample(ev_grid(s, d), 3, "time")))

# -- algebra -------------------------------------------------------------------------------------
query("common_mode_removal", EV + f"SELECT {GRID.format('value - avg(value) OVER (PARTITION BY time__i)')} FROM g")(
    lambda s, d: (lambda f: out(f - f.reduce("mean", "lane")))(ev_grid(s, d)))
query("align_add", EV + f"SELECT {GRID.format('value + 2 * value')} FROM g")(lambda s, d: (lambda f: out(f + f * 2.0))(ev_grid(s, d)))
query("broadcast_outer", EV + f", a AS (SELECT time__i, sum(value) AS u FROM g GROUP BY 1), c AS (SELECT lane__i, sum(value) AS v FROM g GROUP BY 1) SELECT {GRID.format('u * v / 314159.26535e0')} FROM a, c")(
    lambda s, d: (lambda f: out((f.reduce("sum", "lane") * f.reduce("sum", "time")) / 314159.26535))(ev_grid(s, d)))
query("subtract_total_mean", EV + f"SELECT {GRID.format('value - (SELECT avg(value) FROM g)')} FROM g")(lambda s, d: (lambda f: out(f - f.reduce("mean")))(ev_grid(s, d)))
query("divide_by_zero", EV + "SELECT time__i, lane__i, CASE WHEN value = 0 THEN 'Infinity'::DOUBLE ELSE round(1 / value, 6) + 0.0 END AS value FROM g")(
    lambda s, d: out(ev_grid(s, d).apply(lambda x: divide(F.lit(1.0), x))))
query("where_clip", EV + f"SELECT {GRID.format('CASE WHEN value > 20 THEN least(greatest(value, 50), 200) ELSE -1 END')} FROM g")(
    lambda s, d: out(choose(lambda x: x > 20, lambda x: E.clip(x, 50, 200), ev_grid(s, d), -1.0)))
query("round_half_even", EV + "SELECT time__i, lane__i, round_even(value / 2, 0) + 0.0 AS value FROM g")(lambda s, d: out(ev_grid(s, d).apply(lambda x: E.UNARY["round"](x / 2))))
query("floor_mod", EV + f"SELECT {GRID.format('value - 7 * floor(value / 7)')} FROM g")(lambda s, d: out(ev_grid(s, d) % 7.0))
query("fix_negative", EV + f"SELECT {GRID.format('trunc(-value / 3)')} FROM g")(lambda s, d: out(ev_grid(s, d).apply(lambda x: E.fix(-x / 3))))
query("nan_to_num", EV + f"SELECT {GRID.format('coalesce(x, 0)')} FROM gn")(lambda s, d: out(ev_grid(s, d, True).apply(E.nan_to_num)))
query("sinc", EV + f"SELECT {GRID.format('CASE WHEN value = 0 THEN 1 ELSE sin(pi() * value / 100) / (pi() * value / 100) END')} FROM g")(lambda s, d: out(ev_grid(s, d).apply(lambda x: E.sinc(x / 100))))
query("log_safe", EV + "SELECT time__i, lane__i, CASE WHEN value = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(value), 6) + 0.0 END AS value FROM g")(lambda s, d: out(ev_grid(s, d).apply(E.UNARY["log"])))
query("maximum", EV + f"SELECT {GRID.format('greatest(value, 100 - value)')} FROM g")(lambda s, d: (lambda f: out(binary(E.BINARY["maximum"], f, f.apply(lambda x: 100 - x))))(ev_grid(s, d)))
query("isnan", EV + "SELECT time__i, lane__i, x IS NULL AS value FROM gn")(lambda s, d: out(ev_grid(s, d, True).apply(F.isnan)))


_N = "CASE WHEN x IS NULL THEN 'NaN'::DOUBLE ELSE {} END"
for _name, _sql in (("floor", "floor(x / 3)"), ("ceil", "ceil(x / 3)"), ("trunc", "trunc(-x / 3)"), ("rint", "round_even(x / 3, 0)")):
    query(f"{_name}_nan", EV + f"SELECT time__i, lane__i, {_N.format(_sql)} + 0.0 AS value FROM gn")(
        lambda s, d, n=_name: out(ev_grid(s, d, True).apply(lambda x: E.UNARY[n]((-x if n == "trunc" else x) / 3))))
query("fix_nan", EV + f"SELECT time__i, lane__i, {_N.format('trunc(x / -3)')} + 0.0 AS value FROM gn")(lambda s, d: out(ev_grid(s, d, True).apply(lambda x: E.fix(x / -3))))
query("mod_nan", EV + f"SELECT time__i, lane__i, {_N.format(R.format('x - -7 * floor(x / -7)'))} AS value FROM gn")(lambda s, d: out(ev_grid(s, d, True) % -7.0))
query("mod_zero", EV + "SELECT time__i, lane__i, 'NaN'::DOUBLE AS value FROM gn")(lambda s, d: out(ev_grid(s, d, True) % 0.0))
query("floordiv_nan", EV + f"SELECT time__i, lane__i, {_N.format('floor(x / 9)')} + 0.0 AS value FROM gn")(lambda s, d: out(ev_grid(s, d, True) // 9.0))
query("floordiv_zero", EV + "SELECT time__i, lane__i, CASE WHEN x IS NULL OR x = 0 THEN 'NaN'::DOUBLE WHEN x > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS value FROM gn")(
    lambda s, d: out(ev_grid(s, d, True) // 0.0))
query("divide_into", EV + f"SELECT time__i, lane__i, {_N.format(R.format('500 / x'))} AS value FROM gn")(lambda s, d: out(500.0 / ev_grid(s, d, True)))
query("power_of_two", EV + f"SELECT time__i, lane__i, {_N.format(R.format('pow(2, x / 500)'))} AS value FROM gn")(lambda s, d: out(2.0 ** (ev_grid(s, d, True) / 500.0)))
query("conditions", EV + "SELECT time__i, lane__i, coalesce((x > 20 AND x <= 90) OR NOT (x < 150), true) AS value FROM gn")(
    lambda s, d: (lambda f: out(((f > 20) & (f <= 90)) | ~(f < 150)))(ev_grid(s, d, True)))
query("equal_not_equal", EV + "SELECT time__i, lane__i, coalesce(x = x, false) AS same, coalesce(x <> x, true) AS other FROM gn")(
    lambda s, d: (lambda f: (f == f).df.withColumnRenamed("value", "same").join((f != f).df.withColumnRenamed("value", "other"), ["time__i", "lane__i"]).select("time__i", "lane__i", "same", "other"))(ev_grid(s, d, True)))
query("bits", EV + "SELECT time__i, lane__i, xor((n & 6) | 1, 3) << 2 AS value FROM g")(
    lambda s, d: (lambda f: out((((f & 6) | 1) ^ 3) << 2))(ev_counts(s, d)))
query("ediff1d", EV + f", o AS (SELECT time__i * (SELECT count(*) FROM lanes) + lane__i AS k, value FROM g) SELECT k - 1 AS flat__i, {R.format('v')} AS value FROM (SELECT k, value - lag(value) OVER (ORDER BY k) AS v FROM o) WHERE v IS NOT NULL")(
    lambda s, d: out(axis.ediff1d(ev_grid(s, d))))


@query("divmod", EV + "SELECT time__i, lane__i, floor(value / 9) + 0.0 AS q, round(value - 9 * floor(value / 9), 6) + 0.0 AS r FROM g")
def _(s, d):
    q, r = E.divmod_(F.col("value"), F.lit(9.0))
    return ev_grid(s, d).df.select("time__i", "lane__i", tidy(q).alias("q"), tidy(r).alias("r"))


@query("modf", EV + "SELECT time__i, lane__i, round(value - trunc(value), 6) + 0.0 AS frac, trunc(value) + 0.0 AS whole FROM g")
def _(s, d):
    a, b = E.modf(F.col("value"))
    return ev_grid(s, d).df.select("time__i", "lane__i", tidy(a).alias("frac"), tidy(b).alias("whole"))


@query("complex_abs_angle", EV + "SELECT time__i, lane__i, round(sqrt(value * value + 9), 6) + 0.0 AS size, round(atan2(-3, value), 6) + 0.0 AS angle FROM g")
def _(s, d):
    z = E.conj(E.complex_of(F.col("value"), F.lit(3.0)))
    return ev_grid(s, d).df.select("time__i", "lane__i", tidy(E.absolute(z)).alias("size"), tidy(E.angle(z)).alias("angle"))


# -- coordinates and sets -----------------------------------------------------------------------
_ISL = """
WITH e AS (SELECT event_type AS lane, epoch_us(ts) * 1000 AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY lane ORDER BY t) AS p FROM e),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 1800000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
"""


_HALF_HOUR = 1800
query("availability", _ISL + "SELECT lane, min(t) AS start_value, max(t) AS end_value, max(t) - min(t) AS delta, 'data' AS type FROM i GROUP BY lane, k")(
    lambda s, d: labels.availabilities(ev_raw(s, d), "time", "lane", _HALF_HOUR))
query("discontinuities", _ISL + "SELECT lane, p AS start_value, t AS end_value, t - p AS delta, 'gap' AS type FROM i WHERE t - p > 1800000000000")(
    lambda s, d: labels.discontinuities(ev_raw(s, d), "time", "lane", _HALF_HOUR))
query("timeline", _ISL + "SELECT lane, min(t) AS start_value, max(t) AS end_value, 'data' AS type FROM i GROUP BY lane, k UNION ALL SELECT lane, p, t, 'gap' FROM i WHERE t - p > 1800000000000")(
    lambda s, d: labels.timeline(ev_raw(s, d), "time", "lane", _HALF_HOUR).drop("delta"))
query("sampling_interval", "SELECT event_type AS lane, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / (count(*) - 1), 6) + 0.0 AS value FROM events GROUP BY 1")(
    lambda s, d: labels.sampling_interval(ev_raw(s, d), "time", ["lane"]).withColumn("value", tidy(F.col("value"))))
query("monotonic", "WITH l AS (SELECT user_id % 50 AS k, ts > lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS up FROM events) SELECT k, coalesce(bool_and(up), true) AS value FROM l GROUP BY k")(
    lambda s, d: labels.monotonic(LabeledFrame(table(s, d, "events").withColumn("k", F.expr("user_id % 50")), (), {"time": C.Column("ts")}), "time", "event_id", ["k"]))

# axes with gaps: the hours in which the first type has events, as a coordinate of segments
_HOURS = EV + """, hrs AS (SELECT DISTINCT h FROM ev WHERE lane = (SELECT min(lane) FROM ev)),
seg AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, h - row_number() OVER (ORDER BY h) AS k FROM hrs),
av AS (SELECT min(i) AS start_index, max(i) AS end_index, min(h) * 3600000000000 AS start_value, max(h) * 3600000000000 AS end_value FROM seg GROUP BY k)
"""


def hours_axis(s, d) -> C.Sampled:
    events = ev_raw(s, d).df
    first = events.agg(F.min("lane")).first()[0]
    hours = np.array(sorted(r[0] for r in events.filter(F.col("lane") == first).select(F.expr(f"time_ns div {HOUR_NS}")).distinct().collect()), np.int64)  # labels of an axis
    return C.Sampled(hours * HOUR_NS, np.ones(len(hours), np.int64), HOUR_NS, "time", True).simplify(0)


_SPAN_COLUMNS = ["start_index", "end_index", "start_value", "end_value", "delta", "type"]
_SPAN_SCHEMA = "start_index long, end_index long, start_value long, end_value long, delta long, type string"


def _spans(s, found) -> DataFrame:
    return s.createDataFrame([tuple(r) for r in found[_SPAN_COLUMNS].astype(object).to_numpy().tolist()], _SPAN_SCHEMA)


query("coord_availabilities", _HOURS + "SELECT *, end_value - start_value AS delta, 'data' AS type FROM av")(lambda s, d: _spans(s, hours_axis(s, d).availabilities()))
query("coord_discontinuities", _HOURS + "SELECT end_index AS start_index, end_index + 1 AS end_index, end_value AS start_value, nxt AS end_value, nxt - end_value AS delta, 'gap' AS type FROM (SELECT *, lead(start_value) OVER (ORDER BY start_value) AS nxt FROM av) WHERE nxt IS NOT NULL")(
    lambda s, d: _spans(s, hours_axis(s, d).discontinuities()))

_PROBES = [f"2024-01-{day:02d}T{hour:02d}:20:00" for day in range(3, 27, 2) for hour in (3, 9, 15, 22)]
_PROBE_SQL = ", p AS (SELECT epoch_us(CAST(t AS TIMESTAMP)) * 1000 AS t FROM (VALUES " + ", ".join(f"('{t.replace('T', ' ')}')" for t in _PROBES) + ") v(t)), l AS (SELECT i, h * 3600000000000 AS v FROM seg) "
for _method, _best in (("nearest", "ORDER BY abs(v - t), v"), ("ffill", "AND v <= t ORDER BY v DESC"), ("bfill", "AND v >= t ORDER BY v")):
    query(f"sampled_{_method}", _HOURS + _PROBE_SQL + f"SELECT t AS label, (SELECT i FROM l WHERE true {_best} LIMIT 1)::BIGINT AS place FROM p")(
        lambda s, d, m=_method: (lambda c: s.createDataFrame([(C.parse_label(t, True), c.indexer(t, m)) for t in _PROBES], "label long, place long"))(hours_axis(s, d)))
    query(f"interp_{_method}", LI + ", m AS (SELECT unnest(range((SELECT min(m) FROM li), (SELECT max(m) FROM li) + 1)) AS v), p AS (SELECT (SELECT min(m) FROM li) + k * 1.37e0 + 0.21e0 AS t FROM (SELECT unnest(range(40)) AS k)) "
          f"SELECT round(t, 6) AS label, (SELECT v - (SELECT min(m) FROM li) FROM m WHERE true {_best} LIMIT 1)::BIGINT AS place FROM p")(
        lambda s, d, m=_method: (lambda c: s.createDataFrame([(round(c.start + k * 1.37 + 0.21, 6), c.indexer(c.start + k * 1.37 + 0.21, m)) for k in range(40)], "label double, place long"))(li_cube(s, d).coords["month"]))


def _parts_out(parts: list[LabeledFrame]) -> DataFrame:
    df = None
    for k, p in enumerate(parts):
        o = out(p).withColumn("part", F.lit(k).cast("long"))
        df = o if df is None else df.unionByName(o)
    return df


query("split_ntile", EV + f", p AS (SELECT *, ntile(7) OVER (PARTITION BY lane__i ORDER BY time__i) - 1 AS part FROM g) SELECT part, time__i - min(time__i) OVER (PARTITION BY part) AS time__i, lane__i, {R.format('value')} AS value FROM p")(
    lambda s, d: _parts_out(setops.split(ev_grid(s, d), 7, "time")))
query("split_concat", EV + f"SELECT {GRID.format('value')} FROM g")(lambda s, d: out(setops.concat(list(reversed(setops.split(ev_grid(s, d), [100, 101, 300], "time"))), "time")))


@query("split_gaps", EV + f"SELECT CASE WHEN time__i < 50 THEN 0 WHEN time__i < 70 THEN 1 ELSE 2 END::BIGINT AS part, CASE WHEN time__i < 50 THEN time__i WHEN time__i < 70 THEN time__i - 50 ELSE time__i - 90 END AS time__i, lane__i, {R.format('value')} AS value FROM g WHERE time__i < 70 OR time__i >= 90")
def _(s, d):
    f = ev_grid(s, d)
    a, b, c = f.isel(time=slice(0, 50)), f.isel(time=slice(50, 70)), f.isel(time=slice(90, None))
    b = b._with(b.df, coords=b.coords | {"time": b.coords["time"].shift(HOUR_NS)})  # an hour late: a gap
    return _parts_out(setops.split(setops.concat([a, b, c], "time"), "gaps", "time", tolerance=0))


query("concat_new_dim", EV + f"SELECT k::BIGINT AS copy__i, time__i, lane__i, {R.format('value * (k + 1)')} AS value FROM g, (SELECT unnest(range(2)) AS k)")(
    lambda s, d: (lambda f: out(setops.concat([f.assign_coords(copy=0), (f * 2.0).assign_coords(copy=1)], "copy")))(ev_grid(s, d)))


@query("combine_bags", "WITH f AS (SELECT file_id, min((mtime, engine, instrument)) AS m FROM file_list GROUP BY file_id), "
       "l AS (SELECT file_id, m[3] AS instrument, m[2] AS engine, m[1] AS mtime FROM f), "
       "c AS (SELECT *, CASE WHEN engine <> lag(engine) OVER w THEN 1 ELSE 0 END AS c FROM l WINDOW w AS (PARTITION BY file_id % 40 ORDER BY mtime, file_id)) "
       "SELECT file_id, sum(c) OVER (PARTITION BY file_id % 40 ORDER BY mtime, file_id ROWS UNBOUNDED PRECEDING)::BIGINT AS bag FROM c")
def _(s, d):
    files = table(s, d, "file_list").groupBy("file_id").agg(F.min(F.struct("mtime", "engine", "instrument")).alias("m"))
    files = files.select("file_id", "m.*", F.expr("file_id % 40").alias("station"), F.struct("m.mtime", "file_id").alias("start"))
    return setops.combine_bags(files, ["engine"], "start", ["station"]).select("file_id", "bag")


@query("combine_by_field", EV + f"SELECT CASE WHEN lane__i < 2 THEN 'a' ELSE 'b' END AS field, time__i, CASE WHEN lane__i < 2 THEN lane__i ELSE lane__i - 2 END AS lane__i, {R.format('value')} AS value FROM g")
def _(s, d):
    f = ev_grid(s, d)
    low, high = f.isel(lane=slice(0, 2)), f.isel(lane=slice(2, None))
    late, early = {"a": low.isel(time=slice(100, None)), "b": high.isel(time=slice(250, None))}, {"a": low.isel(time=slice(0, 100)), "b": high.isel(time=slice(0, 250))}
    found = setops.combine_by_field([late, early], "time")
    a, b = (out(found[k]).withColumn("field", F.lit(k)) for k in "ab")
    return a.unionByName(b)

# -- picks ------------------------------------------------------------------------------------------
_PICKS = EV + """, x AS (SELECT time__i, lane__i, h, lane, value - avg(value) OVER (PARTITION BY time__i) AS v FROM g),
m AS (SELECT *, CASE WHEN v > 100 THEN 1 WHEN v < 50 THEN 0 END AS m FROM x),
s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY lane__i ORDER BY time__i ROWS UNBOUNDED PRECEDING), 0) AS o FROM m),
e AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY lane__i ORDER BY time__i), 0) AS p FROM s),
n AS (SELECT *, sum(CASE WHEN o = 1 AND p = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lane__i ORDER BY time__i ROWS UNBOUNDED PRECEDING) AS k FROM e),
q AS (SELECT lane, lane__i, k, max(v) FILTER (WHERE o = 1) AS value, bool_or(o = 0 AND p = 1) AS done FROM n WHERE o = 1 OR p = 1 GROUP BY ALL)
SELECT n.time__i, q.lane__i, n.h * 3600000000000 AS time, q.lane, round(q.value, 6) + 0.0 AS value
FROM q JOIN n ON n.lane__i = q.lane__i AND n.k = q.k AND n.o = 1 AND n.v = q.value
WHERE q.done QUALIFY row_number() OVER (PARTITION BY q.lane__i, q.k ORDER BY n.time__i) = 1
"""


@query("find_picks", _PICKS)
def find_picks(s, d):
    f = ev_grid(s, d)
    picks = picking.find_picks(f - f.reduce("mean", "lane"), 100.0, "time")
    return picks.withColumn("value", tidy(F.col("value")))


@query("find_picks_kernel", _PICKS)
def _(s, d):
    from ..pack import pack

    f = ev_grid(s, d)
    f = f - f.reduce("mean", "lane")
    return picking._labelled(f, picking.trigger_lanes(pack(f, "time"), "time", 100.0)).withColumn("value", tidy(F.col("value")))


@query("tapered_selection", EV + ", x AS (SELECT lane__i, time__i - 10 * (lane__i + 1) AS k, value FROM g WHERE time__i >= 10 * (lane__i + 1) AND time__i <= 10 * (lane__i + 1) + 30), "
       f"z AS (SELECT lane__i, unnest(range(32)) AS k FROM lanes) SELECT k AS time__i, lane__i, {R.format('coalesce(value * (0.5 - 0.5 * cos(2 * pi() * k / 30)), 0)')} AS value FROM z LEFT JOIN x USING (lane__i, k)")
def _(s, d):
    f = ev_grid(s, d)
    start = f.coords["time"].start
    spans = s.range(f.size("lane")).select(F.col("id").alias("lane__i"), (F.lit(start) + (F.col("id") + 1) * 10 * HOUR_NS).alias("start"))
    spans = spans.withColumn("end", F.col("start") + 30 * HOUR_NS)
    return out(picking.tapered_selection(f, spans, "time", "hann", 32))


# -- spectra ---------------------------------------------------------------------------------------
_DFT = """, w AS (SELECT k, f, cos(2 * pi() * k * f / 64) AS c, -sin(2 * pi() * k * f / 64) AS s FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(64)) AS f)),
z AS (SELECT vec__i, f, sum(value * c) AS re, sum(value * s) AS im FROM emb JOIN w ON k__i = k GROUP BY ALL)
"""


@query("rfft", EMB + _DFT + "SELECT vec__i, f AS spectrum__i, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM z WHERE f <= 32")
def _(s, d):
    z = signal.rfft(emb_mat(s, d), dim={"k": "spectrum"})
    return z.df.select("vec__i", "spectrum__i", tidy(F.col("value.re")).alias("re"), tidy(F.col("value.im")).alias("im"))


@query("fft", EMB + _DFT + "SELECT vec__i, (f + 32) % 64 AS spectrum__i, round(sqrt(re * re + im * im), 6) + 0.0 AS size FROM z")
def _(s, d):
    z = signal.fft(emb_mat(s, d), dim={"k": "spectrum"})
    return z.df.select("vec__i", "spectrum__i", tidy(E.absolute(F.col("value"))).alias("size"))


@query("ifft_round_trip", EMB + f"SELECT vec__i, k__i, {R.format('value')} AS value FROM emb")
def _(s, d):
    z = signal.ifft(signal.fft(emb_mat(s, d), dim={"k": "f"}), dim={"f": "k"})
    return z.df.select("vec__i", "k__i", tidy(F.col("value.re")).alias("value"))


@query("irfft_round_trip", EMB + f"SELECT vec__i, k__i, {R.format('value')} AS value FROM emb")
def _(s, d):
    z = signal.irfft(signal.rfft(emb_mat(s, d), dim={"k": "f"}), dim={"f": "k"})
    return out(z)


@query("stft_frames", EMB + f", fr AS (SELECT unnest(range(7)) AS fr), k AS (SELECT unnest(range(16)) AS k) SELECT vec__i, fr AS frame__i, k AS k__i, {R.format('value')} AS value FROM emb JOIN (SELECT * FROM fr, k) ON k__i = fr * 8 + k")
def _(s, d):
    return out(signal.frames(emb_mat(s, d), 16, 8, "k"))


@query("stft_power", EMB + ", fr AS (SELECT unnest(range(7)) AS fr), w AS (SELECT vec__i, fr, sum(pow(value * (0.5 - 0.5 * cos(2 * pi() * (k__i - fr * 8) / 16)), 2)) AS e FROM emb JOIN fr ON k__i >= fr * 8 AND k__i < fr * 8 + 16 GROUP BY ALL) "
       f"SELECT vec__i, fr AS k__i, {R.format('e * 16 / 64')} AS value FROM w")
def _(s, d):
    z = signal.stft(emb_mat(s, d), nperseg=16, onesided=False, dim={"k": "spectrum"})
    p = z.df.groupBy("vec__i", "k__i").agg(F.sum(F.pow(F.col("value.re"), 2) + F.pow(F.col("value.im"), 2)).alias("p"))
    return p.select("vec__i", "k__i", tidy(F.col("p")).alias("value"))


# -- filters and resampling ------------------------------------------------------------------------
_HZ = 1 / 3600
query("filter_lowpass", FILTERS["filter_lowpass"])(lambda s, d: out4(signal.filter(ev_grid(s, d), 0.1 * _HZ, "lowpass", dim="time")))
query("filter_bandpass_zerophase", FILTERS["filter_bandpass_zerophase"])(lambda s, d: out4(signal.filter(ev_grid(s, d), [0.05 * _HZ, 0.2 * _HZ], "bandpass", zerophase=True, dim="time")))
query("sosfilt", FILTERS["sosfilt"])(lambda s, d: out4(signal.sosfilt(_sos(), ev_grid(s, d), "time")))
query("sosfiltfilt", FILTERS["sosfiltfilt"])(lambda s, d: out4(signal.sosfiltfilt(_sos(), ev_grid(s, d), "time")))
query("filtfilt", FILTERS["filtfilt"])(lambda s, d: out4(signal.filtfilt([0.2, 0.2], [1.0, -0.6], ev_grid(s, d), "time")))
query("lfilter_iir", EV.replace("WITH ev", "WITH RECURSIVE ev", 1) + ", y AS (SELECT lane__i, time__i, 0.5 * value AS v FROM g WHERE time__i = 0 UNION ALL "
      f"SELECT g.lane__i, g.time__i, 0.5 * g.value + 0.5 * y.v FROM y JOIN g ON g.lane__i = y.lane__i AND g.time__i = y.time__i + 1) SELECT {GRID.format('v')} FROM y")(
    lambda s, d: out(signal.lfilter([0.5], [1.0, -0.5], ev_grid(s, d), "time")))
@query("filter_per_segment", FILTERS["filter_per_segment"])
def _(s, d):
    f = ev_grid(s, d)
    a, b, c = f.isel(time=slice(0, 100)), f.isel(time=slice(100, 350)), f.isel(time=slice(350, None))
    late = lambda g, hours: g._with(g.df, coords=g.coords | {"time": g.coords["time"].shift(hours * HOUR_NS)})
    gapped = setops.concat([a, late(b, 3), late(c, 7)], "time")
    return out4(signal.per_segment(gapped, lambda g: signal.sosfilt(_sos(), g, "time"), "time"))


query("decimate", FILTERS["decimate"])(lambda s, d: out4(signal.decimate(ev_grid(s, d), 4, dim="time")))
query("resample", FILTERS["resample"])(lambda s, d: out4(signal.resample(ev_grid(s, d), 180, "time")))
query("resample_poly", FILTERS["resample_poly"])(lambda s, d: out4(signal.resample_poly(ev_grid(s, d), 2, 3, "time")))


@query("hilbert_envelope", FILTERS["hilbert_envelope"])
def _(s, d):
    z = signal.hilbert(ev_grid(s, d), dim="time")
    return z.df.select("time__i", "lane__i", (F.round(E.absolute(F.col("value")), 4) + F.lit(0.0)).alias("value"))


def _sos():
    from ..dsp.design import iir_sos

    return iir_sos(4, 0.2, "lowpass")


BAND_CODE = """
SELECT event_id, CASE WHEN value >= 1000 AND value < 5000 THEN 'F' WHEN value >= 250 AND value < 1000 THEN 'C' WHEN value >= 80 AND value < 250 THEN 'H'
  WHEN value >= 10 AND value < 80 THEN 'B' WHEN value >= 1 AND value < 10 THEN 'M' WHEN value >= 1e-1 AND value < 1 THEN 'L' WHEN value >= 1e-2 AND value < 1e-1 THEN 'V'
  WHEN value >= 1e-3 AND value < 1e-2 THEN 'U' WHEN value >= 1e-4 AND value < 1e-3 THEN 'R' WHEN value >= 1e-5 AND value < 1e-4 THEN 'P'
  WHEN value >= 1e-6 AND value < 1e-5 THEN 'T' ELSE 'X' END AS code
FROM events
"""


def register_sources() -> None:
    from ..sources.traces import band_code

    query("band_code_slow", BAND_CODE.replace("FROM events", "FROM (SELECT event_id, value / 10000 AS value FROM events)"))(
        lambda s, d: table(s, d, "events").select("event_id", band_code(F.col("value") / 10000).alias("code")))
    query("band_code", BAND_CODE)(lambda s, d: table(s, d, "events").select("event_id", band_code(F.col("value")).alias("code")))
    query("to_traces", EV + "SELECT lane AS channel, min(h) * 3600000000000 AS start_ns, 3600.0::DOUBLE AS delta, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM g GROUP BY lane")(_traces)


def _traces(s, d):
    from ..sources.traces import to_traces

    t = to_traces(ev_grid(s, d), "time", channel="lane")
    return t.select("channel", "start_ns", "delta", F.size("samples").cast("long").alias("n"),
                    (F.round(F.aggregate("samples", F.lit(0.0), lambda a, b: a + b), 4) + 0.0).alias("total"))


