import numpy as np
import pytest

from stridewell import coords as C
from stridewell.frame import LabeledFrame
from stridewell.pipeline import (DownSample, FIRFilter, IIRFilter, Partial, ResamplePoly, Sequential, SOSFilter, Trigger, UpSample, WindowModel, atomized, run_batch)
from stridewell.dsp import design
from stridewell.streaming.stateful import OrderedBlocks, blocks_of, filter_stream, pick_stream, process

ATOMS = [
    IIRFilter(4, 10.0, "lowpass"), IIRFilter(2, [5.0, 20.0], "bandpass", stype="ba"), FIRFilter(31, 10.0, "lowpass"), DownSample(4), UpSample(3), ResamplePoly(40.0), ResamplePoly(100.0),
    SOSFilter(design.iir_sos(4, 0.2)), Sequential([np.abs, DownSample(3), UpSample(2), FIRFilter(11, 10.0, "lowpass")]), WindowModel(lambda w: w * 2, 20),
]


@pytest.mark.parametrize("atom", ATOMS)
@pytest.mark.parametrize("cuts", [[100], [1, 2, 50], [33, 66, 99, 132], list(range(7, 300, 7))])
def test_chunks_equal_the_whole(atom, cuts):
    x = np.random.default_rng(0).normal(size=(2, 300))
    whole, _ = atom(x, None, 100.0)
    parts, state = [], None
    for chunk in np.split(x, cuts, axis=1):
        y, state = atom(chunk, state, 100.0)
        parts.append(y)
    assert np.allclose(np.concatenate(parts, axis=1), whole, atol=1e-12, equal_nan=True)


def test_triggers_in_chunks():
    x = np.random.default_rng(1).uniform(0, 1, 500)
    t = Trigger(0.8)
    whole, _ = t.call(x)
    for size in (1, 7, 100):
        found, state = [], None
        for k in range(0, 500, size):
            p, state = t.call(x[k : k + size], state)
            found += p
        assert found == whole


def test_composition():
    double = atomized(lambda x, k=2: x * k)
    assert isinstance(double(...), Partial) and double(np.ones(1))[0] == 2
    chain = double(DownSample(2))
    assert isinstance(chain, Sequential) and len(chain.atoms) == 2
    longer = double(chain, k=3)
    assert len(longer.atoms) == 3 and len(chain.atoms) == 2  # the input is left as it was
    assert longer(np.ones((1, 4)))[0].tolist() == [[6, 6]]


def test_window_model_averages():
    y, _ = WindowModel(lambda w: w, 10)(np.arange(40.0)[None])
    assert np.allclose(y[0], np.arange(y.shape[1]))


def test_batch_labels(spark):
    f = LabeledFrame.from_numpy(spark, np.random.default_rng(0).normal(size=(3, 100)), {"time": C.Sampled.from_block("2023-01-01", 100, 0.01, "time")}, ("lane", "time"))
    out = run_batch(f, Sequential([IIRFilter(4, 10.0, "lowpass"), DownSample(4)]))
    assert out.shape == (3, 25) and out.coords["time"].sampling_interval() == pytest.approx(0.04)
    assert np.allclose(out.to_numpy(), Sequential([IIRFilter(4, 10.0, "lowpass"), DownSample(4)])(f.to_numpy(), None, 100.0)[0])
    assert run_batch(f, FIRFilter(11, 10.0, "lowpass")).coords["time"].start == f.coords["time"].start - 50_000_000


def test_blocks_are_put_in_order():
    o = OrderedBlocks()
    x = np.arange(10.0)
    out = [y for i in (4, 0, 0, 2, 8, 3, 6) for y in o.push(i, x[i : i + 2])]
    assert np.concatenate(out).tolist() == x.tolist()
    with pytest.raises(RuntimeError):
        o = OrderedBlocks(most_pending=1)
        for k in (5, 7, 9):
            list(o.push(k, x[:1]))


def test_streams_equal_the_batch(spark, tmp_path):
    x = np.random.default_rng(2).uniform(0, 1, (3, 200))
    packed = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "lane long, samples array<double>")
    blocks = blocks_of(packed, 16)
    assert blocks.count() == 39
    source = str(tmp_path / "in")
    rows = blocks.collect()
    order = np.random.default_rng(3).permutation(len(rows))
    for n, part in enumerate(np.array_split(order, 4)):
        batch = [rows[k] for k in part] + [rows[0]]  # one block again and again
        spark.createDataFrame(batch, blocks.schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(source)
    atom = Sequential([IIRFilter(2, 10.0, "lowpass"), DownSample(3)])
    q = process(filter_stream(stream(), atom, 100.0), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    whole, _ = atom(x, None, 100.0)
    for lane in range(3):
        got = sorted(spark.read.parquet(str(tmp_path / "out")).filter(f"lane = {lane}").collect(), key=lambda r: r.i0)
        assert np.allclose(np.concatenate([r.samples for r in got]), whole[lane])
    q = process(pick_stream(stream(), 0.8), str(tmp_path / "picks"), str(tmp_path / "c2"), kind="csv")
    q.awaitTermination()
    got = {(int(r.lane), int(r.i)) for r in spark.read.option("header", True).csv(str(tmp_path / "picks")).collect()}
    assert got == {(k, i) for k in range(3) for i, _ in Trigger(0.8).call(x[k])[0]}


def test_a_lost_block_holds_its_lane_up_only_until_the_watermark(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    x = np.arange(40.0)
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    schema = "lane int, i0 long, samples array<double>, at timestamp"
    sent = [[(1, 0), (2, 0)], [(1, 20), (2, 10)], [(2, 20), (2, 30)], [(1, 30)], [(9, 0)], [(9, 10)]]  # lane 1 loses the block at 10
    stream = None
    for n, blocks in enumerate(sent):
        rows = [(lane, i0, x[i0 : i0 + 10].tolist(), at(10 * n + (100 if lane == 9 else 0))) for lane, i0 in blocks]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = filter_stream(stream, DownSample(5), when="at", patience="15 minutes")
        process(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("lane") < 9).collect():
        for k, v in enumerate(r.samples):
            got[r.lane, r.i0 + k] = v
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, k): 5.0 * k for k in range(8)}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, k): 5.0 * k for k in (0, 1, 4, 5, 6, 7)}
