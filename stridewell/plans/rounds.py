"""Array queries that go out to files and back, through descriptors, and through stages on whole lanes."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import coords as C
from .. import signal
from ..dsp.design import firwin
from ..frame import LabeledFrame, idx, open_frame, save_frame
from ..functions import elementwise as E
from ..pack import pack
from ..pipeline import DownSample, FIRFilter, IIRFilter, LFilter, Sequential, UpSample, WindowModel, atomized, pick_phases, run_batch
from ..session import ensure_checkpoint_dir
from ..sources import miniseed, tdms
from ..sources.opening import open_any, output_of
from ..sources.traces import from_traces, to_traces
from ..streaming.stateful import process
from ..tree import Tree, as_frame
from .arrays import _HOURS, _PICKS, GRID, R, find_picks, hours_axis, out, out4, query, tidy
from .filters_sql import FILTERS
from .views import EV, HOUR_NS, LI, ev_grid, li_cube

_W = "OVER (PARTITION BY lane__i ORDER BY time__i)"
_WHOLE = EV + f"SELECT {GRID.format('value')} FROM g"
_CUBE = LI + f"SELECT month__i, flag__i, status__i, {R.format('value')} AS value FROM cube"


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- files and back ------------------------------------------------------------------------------
@query("native_round_trip", _WHOLE)
def _(s, d):
    place = scratch(s, "frame")
    save_frame(ev_grid(s, d), place)
    return out(open_any(s, place, engine="native"))


@query("tree_round_trip", EV + f"SELECT CASE WHEN lane__i < 2 THEN 'a' ELSE 'b' END AS field, time__i, CASE WHEN lane__i < 2 THEN lane__i ELSE lane__i - 2 END AS lane__i, {R.format('value')} AS value FROM g WHERE time__i < 300")
def _(s, d):
    f, place = ev_grid(s, d), scratch(s, "tree")
    Tree({"a": f.isel(lane=slice(0, 2)), "b": f.isel(lane=slice(2, None))}, "field").save(place)
    found = Tree.open(s, place).isel(time=slice(0, 300))
    a, b = (out(found[k]).withColumn("field", F.lit(k)) for k in "ab")
    return a.unionByName(b)


@query("trees_united", _WHOLE)
def _(s, d):
    f, early, late = ev_grid(s, d), scratch(s, "tree"), scratch(s, "tree")
    Tree({"x": f.isel(time=slice(0, 200))}, "field").save(early)
    Tree({"x": f.isel(time=slice(200, None))}, "field").save(late)
    return out(open_any(s, [late, early], engine="tree")["x"])


query("sequence_as_frame", _WHOLE)(lambda s, d: (lambda f: out(as_frame(Tree([f.isel(time=slice(400, None)), f.isel(time=slice(0, 400))]), "time")))(ev_grid(s, d)))
query("dict_round_trip", _CUBE)(lambda s, d: out(LabeledFrame.from_dict(s, li_cube(s, d).to_dict())))
query("bytes_round_trip", _CUBE)(lambda s, d: out(LabeledFrame.from_bytes(s, li_cube(s, d).to_bytes())))
query("arrays_round_trip", _CUBE)(lambda s, d: (lambda f: out(LabeledFrame.from_numpy(s, np.asarray(f), dims=f.dims)).filter("NOT isnan(value)"))(li_cube(s, d)))
query("traces_round_trip", EV + f"SELECT time__i, lane__i AS channel__i, {R.format('value')} AS value FROM g")(
    lambda s, d: out(from_traces(to_traces(ev_grid(s, d), "time"), "time")))


@query("day_archive", EV + "SELECT lane__i::VARCHAR AS channel, h // 24 AS day, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM g GROUP BY ALL")
def _(s, d):
    place = scratch(s, "sds")
    miniseed.write_files(to_traces(ev_grid(s, d), "time", station="STA"), place)
    back = miniseed.open_traces(s, f"{place}/*/*/*/*/*")
    total = F.aggregate("samples", F.lit(0.0), lambda a, b: a + b)
    days = back.select("channel", F.expr("start_ns div 86400000000000").alias("day"), F.size("samples").alias("n"), total.alias("total"))
    return days.groupBy("channel", "day").agg(F.sum("n").alias("n"), (F.round(F.sum("total"), 4) + 0.0).alias("total"))


def _day_files(spark: SparkSession, folder: str) -> tuple[LabeledFrame, str]:
    """The grid in instrument files of a day each, written by tasks."""
    f, place = ev_grid(spark, folder), scratch(spark, "tdms")
    start, lanes = f.coords["time"].start, f.size("lane")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        day, first = int(frame["day"].iloc[0]), int(frame["time__i"].min())
        data = frame.pivot(index="time__i", columns="lane__i", values="value").to_numpy()
        props = {"GPSTimeStamp": pd.Timestamp(start + first * HOUR_NS).isoformat(), "SamplingFrequency[Hz]": 1 / 3600, "Start Distance (m)": 0.0, "Fibre Length Multiplier": 1.0, "SpatialResolution[m]": 10.0}
        with output_of(f"{place}/{day:06d}.tdms") as file:
            file.write(tdms.write(props, data.reshape(-1, lanes)))
        return pd.DataFrame({"day": [day]})

    f.df.withColumn("day", F.expr("time__i div 24")).groupBy("day").applyInPandas(write, "day long").count()
    return f, place


@query("open_files", EV + f"SELECT time__i, lane__i AS distance__i, {R.format('value')} AS value FROM g")
def _(s, d):
    return out(open_any(s, f"{_day_files(s, d)[1]}/*.tdms", "silixa"))


@query("open_files_selected", EV + f"SELECT time__i - 30 AS time__i, lane__i - 1 AS distance__i, {R.format('value')} AS value FROM g WHERE time__i >= 30 AND time__i < 500 AND lane__i BETWEEN 1 AND 2")
def _(s, d):
    f, place = _day_files(s, d)
    t0 = f.coords["time"].start
    ends = slice(t0 + 30 * HOUR_NS, t0 + 499 * HOUR_NS)
    return out(open_any(s, f"{place}/*.tdms", sel={"time": ends, "distance": slice(5.0, 20.0)}))


@query("open_files_tree", EV + f"SELECT time__i, lane__i AS distance__i, {R.format('value')} AS value FROM g WHERE time__i >= 24 AND time__i < 48")
def _(s, d):
    tree = open_any(s, f"{_day_files(s, d)[1]}/[day].tdms", "silixa")
    f = tree[1]
    return out(f._with(f.df.withColumn("time__i", F.col("time__i") + 24)))


@query("picks_csv", _PICKS)
def _(s, d):
    place = scratch(s, "picks")
    found = find_picks(s, d)
    found.write.option("header", True).csv(place)
    return s.read.option("header", True).schema(found.schema).csv(place)


@query("picks_csv_stream", _PICKS)
def _(s, d):
    place, found = scratch(s, "picks"), find_picks(s, d)
    found.write.parquet(f"{place}/in")
    process(s.readStream.schema(found.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint", "csv").awaitTermination()
    return s.read.option("header", True).schema(found.schema).csv(f"{place}/out")


# -- descriptors -----------------------------------------------------------------------------------
def _labels(s: SparkSession, c: C.Coordinate) -> DataFrame:
    return s.createDataFrame([(i, C.as_label(v)) for i, v in enumerate(c.values().tolist())], "place long, label long")


_SEG = _HOURS + "SELECT {place} AS place, {label} * 3600000000000 AS label FROM seg"
query("coord_slice", _SEG.format(place="(i - 7) // 3", label="h") + " WHERE i >= 7 AND i < 400 AND (i - 7) % 3 = 0")(lambda s, d: _labels(s, hours_axis(s, d).slice(slice(7, 400, 3))))
query("coord_decimate", _SEG.format(place="i // 4", label="h") + " WHERE i % 4 = 0")(lambda s, d: _labels(s, hours_axis(s, d).decimate(4)))
query("coord_shift", _SEG.format(place="i", label="(h + 5)"))(lambda s, d: _labels(s, hours_axis(s, d).shift(5 * HOUR_NS)))
query("coord_take", _SEG.format(place="9 - i", label="h") + " WHERE i < 10")(lambda s, d: _labels(s, hours_axis(s, d).take(list(range(9, -1, -1)))))
query("coord_concat", _SEG.format(place="i", label="h") + " UNION ALL SELECT (SELECT count(*) FROM seg) + i, (h + 5000) * 3600000000000 FROM seg")(
    lambda s, d: (lambda c: _labels(s, c.concat(c.shift(5000 * HOUR_NS))))(hours_axis(s, d)))
query("coord_simplify", _SEG.format(place="i", label="h"))(lambda s, d: (lambda c: _labels(s, C.Interp.from_array(c.values().astype("datetime64[ns]"), "time", 0)))(hours_axis(s, d)))
query("coord_div_points", _HOURS + "SELECT i AS place FROM (SELECT i, h - lag(h) OVER (ORDER BY i) AS step FROM seg) WHERE step > 1 OR i = 0 UNION ALL SELECT count(*) FROM seg")(
    lambda s, d: s.createDataFrame([(int(p),) for p in C.Dense(hours_axis(s, d).values() // HOUR_NS, "h").div_points(2)], "place long"))
query("coord_from_block", "SELECT k AS place, k * 1500000000 + 1704067200000000000 AS label FROM (SELECT unnest(range(50)) AS k)")(
    lambda s, d: _labels(s, C.Interp.from_block("2024-01-01", 50, 1.5, "time")))
query("coord_equality", "SELECT true AS same, true AS other_ties, false AS shifted, true AS rising, 1.0::DOUBLE AS step")(
    lambda s, d: (lambda c: s.createDataFrame([(c.equals(C.from_dict(c.to_dict())), C.Interp([0, 5, 10], [0.0, 5.0, 10.0], "x").equals(C.Interp([0, 10], [0.0, 10.0], "x")),
                                                c.equals(c.shift(1)), c.monotonic(), c.sampling_interval() / 3600)], "same boolean, other_ties boolean, shifted boolean, rising boolean, step double"))(hours_axis(s, d)))
query("frame_equality", "SELECT true AS same, false AS moved, false AS renamed")(
    lambda s, d: (lambda f: s.createDataFrame([(f.equals(f.copy()), f.equals(f + 1.0), f.equals(f.rename(flag="letter")))], "same boolean, moved boolean, renamed boolean"))(li_cube(s, d)))
query("tree_fields", "SELECT * FROM (VALUES (0, 'station'), (1, 'part')) v(level, field)")(
    lambda s, d: (lambda f: s.createDataFrame(list(enumerate(Tree({"a": Tree([f], "part"), "b": Tree([f], "part")}, "station").fields)), "level int, field string"))(li_cube(s, d)))

# -- stages on whole lanes ---------------------------------------------------------------------------
_HZ = 1 / 3600
query("batch_chain", FILTERS["stream_filter_decimate"])(lambda s, d: out4(run_batch(ev_grid(s, d), Sequential([LFilter(firwin(31, 0.2), [1.0]), DownSample(4)]), "time")))
query("batch_iir", FILTERS["filter_lowpass"])(lambda s, d: out4(run_batch(ev_grid(s, d), IIRFilter(4, 0.1 * _HZ, "lowpass"), "time")))
query("batch_fir", FILTERS["stream_filter_decimate"])(lambda s, d: out4(run_batch(ev_grid(s, d), Sequential([FIRFilter(31, 0.1 * _HZ, "lowpass"), DownSample(4)]), "time")))
query("batch_upsample", EV + f"SELECT time__i * 3 + k AS time__i, lane__i, {R.format('CASE WHEN k = 0 THEN 3 * value ELSE 0 END')} AS value FROM g, (SELECT unnest(range(3)) AS k)")(
    lambda s, d: out(run_batch(ev_grid(s, d), UpSample(3), "time")))
query("batch_atomized", EV + f"SELECT time__i // 5 AS time__i, lane__i, {R.format('2 * abs(value - 50)')} AS value FROM g WHERE time__i % 5 = 0")(
    lambda s, d: out(run_batch(ev_grid(s, d), atomized(lambda x, by: x * by)(Sequential([lambda x: np.abs(x - 50), DownSample(5)]), by=2), "time")))
query("sosfilt_states", FILTERS["sosfilt"])(lambda s, d: _in_two(s, d))


def _in_two(s: SparkSession, d: str) -> DataFrame:
    """The filter over the first part, and from its states over the rest."""
    from .arrays import _sos

    f = ev_grid(s, d)
    head, states = signal.sosfilt(_sos(), f.isel(time=slice(0, 250)), "time", ...)
    tail, _ = signal.sosfilt(_sos(), f.isel(time=slice(250, None)), "time", states)
    late = tail._with(tail.df.withColumn(idx("time"), F.col(idx("time")) + 250))
    return out4(head).unionByName(out4(late))


_MODEL = WindowModel(lambda w: np.stack([w - w.mean(axis=1, keepdims=True), w * 0 + 1], axis=1), 20, phases=["P", "N"])
query("window_model", EV + ", e AS (SELECT max(time__i) + 1 AS total FROM g), w AS (SELECT unnest(range((total - 20) // 10 + 1)) * 10 AS s FROM e), m AS (SELECT lane__i, s, avg(value) AS m FROM g JOIN w ON time__i >= s AND time__i < s + 20 GROUP BY ALL) "
      f"SELECT time__i, g.lane__i, p AS phase__i, {R.format('CASE WHEN p = 0 THEN avg(value - m) ELSE 1 END')} AS value "
      "FROM g JOIN m ON g.lane__i = m.lane__i AND time__i >= s AND time__i < s + 20, e, (SELECT unnest(range(2))::BIGINT AS p) WHERE time__i < ((total - 20) // 10 + 1) * 10 GROUP BY time__i, g.lane__i, p")(
    lambda s, d: out(pick_phases(ev_grid(s, d), _MODEL, "time")))

# -- more functions ------------------------------------------------------------------------------------
_SAME = ["sqrt", "exp", "sin", "cos", "tan", "sinh", "cosh", "tanh", "degrees", "radians", "cbrt", "log2", "log10", "sign"]
_SQL_OF = {"sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "sign": "sign(x - 1)", "log2": "log2(x + 1)", "log10": "log10(x + 1)"}


@query("functions", EV + "SELECT time__i, lane__i, " + ", ".join(f"round({_SQL_OF.get(n, n + '(x)')}::DOUBLE, 6) + 0.0 AS {n}" for n in _SAME) + " FROM (SELECT *, value / 500 AS x FROM g)")
def _(s, d):
    x = F.col("value") / 500
    shifted = {"sign": x - 1, "log2": x + 1, "log10": x + 1}
    return ev_grid(s, d).df.select("time__i", "lane__i", *[tidy(E.UNARY[n](shifted.get(n, x))).alias(n) for n in _SAME])


_PAIRS = {"fmod": "fmod(x, 7)", "hypot": "sqrt(x * x + 49)", "arctan2": "atan2(x, 7)", "minimum": "least(x, 7)", "fmax": "greatest(x, 7)", "power": "pow(x, 7)"}


@query("functions_of_two", EV + "SELECT time__i, lane__i, " + ", ".join(f"round({q}, 6) + 0.0 AS {n}" for n, q in _PAIRS.items()) + " FROM (SELECT *, value / 100 AS x FROM g)")
def _(s, d):
    return ev_grid(s, d).df.select("time__i", "lane__i", *[tidy(E.BINARY[n](F.col("value") / 100, F.lit(7.0))).alias(n) for n in _PAIRS])


query("packed_lanes", EV + "SELECT lane__i, count(*) AS n, round(sum(value * (time__i + 1)), 2) + 0.0 AS weighed FROM g GROUP BY lane__i")(
    lambda s, d: pack(ev_grid(s, d), "time").select("lane__i", F.size("samples").cast("long").alias("n"), (F.round(F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b), 2) + 0.0).alias("weighed")))
