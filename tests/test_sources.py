import numpy as np
import pytest

from stridewell import coords as C
from stridewell.frame import LabeledFrame
from stridewell.sources import engines, packets, tdms
from stridewell.sources.traces import from_traces, to_traces, write_sds

NS = C.NS


class Node(dict):
    """Looks like an open HDF5 group."""

    def __init__(self, items=(), **attrs):
        super().__init__(items)
        self.attrs = attrs


@pytest.mark.parametrize("interleaved", [False, True])
@pytest.mark.parametrize("kind", [np.int16, np.float32])
def test_tdms_round_trip(interleaved, kind):
    data = np.arange(60).reshape(20, 3).astype(kind)
    raw = tdms.write({"GPSTimeStamp": "2023-05-01T00:00:00", "n": 3, "x": 1.5}, data, interleaved)
    f = tdms.parse(raw)
    assert np.array_equal(f.array(), data) and f.root()["x"] == 1.5 and f.root()["n"] == 3
    assert np.array_equal(tdms.parse(raw + raw).array(), np.concatenate([data, data]))
    assert tdms.parse(raw, headers_only=True).root()["n"] == 3
    with pytest.raises(tdms.TdmsError):
        tdms.parse(b"nope" * 20)


def silixa(start="2023-05-01T00:00:00", n=20):
    props = {"GPSTimeStamp": start, "SamplingFrequency[Hz]": 1000.0, "Start Distance (m)": 5.0, "Fibre Length Multiplier": 1.0, "SpatialResolution[m]": 2.0}
    return tdms.write(props, np.arange(n * 3).reshape(n, 3).astype(np.int16))


def test_open_many_files(spark, tmp_path):
    for k in range(3):
        folder = tmp_path / f"DAS0{k % 2 + 1}"
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.tdms").write_bytes(silixa(f"2023-05-01T00:00:0{k}"))
    (tmp_path / "DAS01" / "bad.tdms").write_bytes(b"TDSm broken")
    rows = engines.open_files(spark, f"{tmp_path}/*/*.tdms").collect()
    assert len(rows) == 9 and {r.distance for r in rows} == {5.0, 7.0, 9.0} and all(r.step_ns == 1_000_000 and len(r.samples) == 20 for r in rows)
    with pytest.raises(Exception):
        engines.open_files(spark, f"{tmp_path}/*/bad.tdms", "silixa", on_error="raise").collect()
    tree = engines.open_tree(spark, f"{tmp_path}/{{station}}/[acquisition].tdms")
    assert {(r.station, r.acquisition) for r in tree.collect()} == {("DAS01", 0), ("DAS01", 1), ("DAS02", 0)}
    bags = engines.combine(engines.open_files(spark, f"{tmp_path}/*/*.tdms"))
    assert {r.bag for r in bags.collect()} == {0}
    own = engines.open_files(spark, f"{tmp_path}/*/*.tdms", lambda raw: engines.Opened(np.ones((2, 1)), C.Sampled(np.array([0]), [2], NS, "time", True), C.Dense(np.zeros(1), "distance")))
    assert own.count() == 4


def test_hdf5_layouts():
    blocks = np.arange(3 * 12 * 5).reshape(3, 12, 5).astype(float)
    zone = Node({"StrainRate": blocks}, BlockRate=[100_000.0], Spacing=[2.0, 1.0], Extent=[3, 7], Origin=[0.5])
    f = Node({"dev": Node({"Source1": Node({"time": np.array([10.0, 10.01, 10.02]), "Zone1": zone})})})
    with pytest.warns(UserWarning):
        o = engines.FebusEngine().decode_tree(f)
    assert o.name == "strain_rate" and o.data.shape == (30, 5) and o.time.size == 30 and len(o.time.tie_values) == 1 and o.distance.start == 6.5
    assert o.time.start == 10 * NS + (1 - 6) * 1_000_000
    o = engines.FebusEngine().decode_tree(f, overlaps=(2, 0), offset=0)
    assert np.array_equal(o.data[:10], blocks[0, 2:])
    p = Node({"Acquisition": Node({"Raw[0]": Node({"RawData": type("D", (np.ndarray,), {})})}, SpatialSamplingInterval=2.0, StartLocusIndex=10)})
    raw = np.zeros((4, 3)).view(type("D", (np.ndarray,), {}))
    raw.attrs = {"PartStartTime": b"2023-01-01T00:00:00+01:00", "PartEndTime": b"2023-01-01T00:00:03+01:00"}
    p["Acquisition"]["Raw[0]"]["RawData"] = raw
    o = engines.ProdmlEngine().decode_tree(p)
    assert o.time.sampling_interval() == 1.0 and o.distance.start == 20.0 and engines.Engine.registry["optasense"] is engines.ProdmlEngine
    t = Node({"data_product": Node({"gps_time": np.array([0.0, 1.0, 2.0]), "data": np.zeros((3, 2))})}, sensing_range_start=1.0, dx=0.5)
    assert engines.Terra15Engine().decode_tree(t).distance.values().tolist() == [1.0, 1.5]
    a = Node({"Metadata": Node({"Timestamp": np.array(b"2023-01-01T00:00:00Z")}), "ProcessingServer": Node({"DataRate": np.array([500.0]), "SpatialSampling": np.array([4.0])}),
              "DAQ": Node({"PositionStart": np.array([8.0])}), "DAS": np.zeros((5, 2))})
    assert engines.ApSensingEngine().decode_tree(a).time.sampling_interval() == 0.002
    s = Node({"header": Node({"time": 1.5, "dt": 0.01, "dx": 1.0}), "data": np.zeros((10, 6)), "cableSpec": Node({"sensorDistances": np.array([0.0, 2, 4, 10, 12, 14])}),
              "demodSpec": Node({"roiStart": np.array([0, 10]), "roiEnd": np.array([5, 14])})})
    o = engines.OptoEngine().decode_tree(s)
    assert o.distance.tie_indices.tolist() == [0, 2, 3, 5] and o.distance.values().tolist() == [0, 2, 4, 10, 12, 14]


def test_packets_in_batch_and_stream(spark, tmp_path):
    import json

    spark.dataSource.register(packets.PacketSource)
    data = np.arange(100 * 4).reshape(100, 4)
    for kind in ("float", "short"):
        h = packets.header_for(10, 4, kind, 1.0, "ms", 2.0)
        messages = [json.dumps(h).encode()] + [packets.encode_packet(k * 10_000_000, data[k * 10 : k * 10 + 10], kind) for k in range(10)]
        packets.write_log(str(tmp_path / f"{kind}.log"), messages)
    df = spark.read.format("packets").option("path", f"{tmp_path}/*.log").load()
    rows = df.collect()
    assert len(rows) == 80 and {r.distance for r in rows} == {0.0, 2.0, 4.0, 6.0} and {r.step_ns for r in rows} == {1_000_000}
    got = sorted((r.start_ns, r.lane, tuple(r.samples)) for r in rows)
    assert got[0][2] == tuple(data[:10, 0].astype(float))
    stream = spark.readStream.format("packets").option("path", f"{tmp_path}/*.log").load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_packets_that_come_late_under_an_earlier_name(spark, tmp_path):
    import json

    spark.dataSource.register(packets.PacketSource)
    h = json.dumps(packets.header_for(10, 4, "int", 1.0, "ms", 2.0)).encode()
    for n, name in enumerate("bac"):
        packets.write_log(str(tmp_path / f"{name}.log"), [h, packets.encode_packet(n, np.zeros((10, 4)), "int")])
        stream = spark.readStream.format("packets").option("path", f"{tmp_path}/*.log").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.start_ns for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(4 * [*range(n + 1)])


def test_headers_are_told_by_content():
    import json

    h = packets.header_for(2, 5, "short", 1.0, "ms", 2.0) | {"roiTable": [{"roiStart": 10, "roiEnd": 14, "roiDec": 2}, {"roiStart": 100, "roiEnd": 102, "roiDec": 2}]}
    d = packets.Decoder()
    with pytest.warns(UserWarning):
        assert list(d.feed(b"early")) == []
    text = json.dumps(h).encode()
    assert list(d.feed(text)) == []
    start = int.from_bytes(b'{"a": 1}', "little")  # a packet that begins like a header
    rows = list(d.feed(packets.encode_packet(start, np.arange(10).reshape(2, 5), "short")))
    assert [r[1] for r in rows] == [10.0, 12.0, 14.0, 100.0, 102.0] and rows[3][4] == [3.0, 8.0] and {r[2] for r in rows} == {start}
    with pytest.warns(UserWarning):
        assert list(d.feed(b"x" * 27)) == []
    same = json.dumps(packets.header_for(1, 1, "short", 1.0)).encode()
    d.layout = packets.Layout.from_header(packets.header_for((len(same) - 8) // 2, 1, "short", 1.0) if len(same) % 2 == 0 else packets.header_for(1, len(same) - 8, "short", 1.0))
    assert list(d.feed(same)) == [] and d.layout.distances.tolist() == [0.0]  # a header as long as a packet
    for bad in ({"bytesPerPackage": 3}, {"roiTable": h["roiTable"][:1] * 4}):
        with pytest.raises(ValueError):
            packets.Layout.from_header(h | bad)


def test_listing_of_patterns(tmp_path):
    for name in ("a/1.log", "a/2.txt", "b/3.log", "c/d/4.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    assert packets.listed(f"{tmp_path}/*/*.log") == [f"{tmp_path}/a/1.log", f"{tmp_path}/b/3.log"]
    assert packets.listed(f"file://{tmp_path}/a/*") == [f"file://{tmp_path}/a/1.log", f"file://{tmp_path}/a/2.txt"]
    assert packets.listed(f"{tmp_path}/a/1.log") == [f"{tmp_path}/a/1.log"] and packets.listed(f"{tmp_path}/none/*.log") == []


def test_traces(spark, tmp_path):
    time = C.Sampled(np.array([0, 60 * 10_000_000]), [50, 40], 10_000_000, "time", True)
    f = LabeledFrame.from_numpy(spark, np.arange(180.0).reshape(2, 90), {"channel": np.array(["HHZ", "HHN"], object), "time": time}, ("channel", "time"))
    traces = to_traces(f, "time", "channel", "FR", "STA")
    assert sorted((r.channel, r.start_ns, len(r.samples)) for r in traces.collect()) == [("HHN", 0, 50), ("HHN", 600_000_000, 40), ("HHZ", 0, 50), ("HHZ", 600_000_000, 40)]
    back = from_traces(traces.filter("start_ns = 0"))
    assert back.shape == (2, 50) and back.isel(channel=1).to_numpy()[3] == 3
    with pytest.raises(ValueError):
        from_traces(traces)
    write_sds(traces, str(tmp_path / "sds"))
    assert (tmp_path / "sds" / "year=1970" / "network=FR").exists()


def steim1(values):
    """One Steim-1 frame row of 32-bit differences (the simplest valid coding)."""
    import struct

    diffs = np.diff(np.concatenate([[0], values])).tolist()
    frames, k = b"", 0
    first = True
    while k < len(diffs) or first:
        codes, words = 0, []
        if first:
            words += [int(values[0]) & 0xFFFFFFFF, int(values[-1]) & 0xFFFFFFFF]
        while len(words) < 15 and k < len(diffs):
            codes |= 3 << (30 - 2 * (len(words) + 1))
            words.append(int(diffs[k]) & 0xFFFFFFFF)
            k += 1
        words += [0] * (15 - len(words))
        frames += struct.pack(">16I", codes, *words)
        first = False
    return frames


def test_miniseed(spark, tmp_path):
    from stridewell.sources import miniseed

    start = 1_680_000_000_123_400_000
    x = np.arange(100, dtype=np.int64)
    parts = [miniseed.write_record("FR", "STA", "00", "HHZ", start + k * 500_000_000, 100, x[k * 50 : k * 50 + 50]) for k in range(2)]
    late = miniseed.write_record("FR", "STA", "00", "HHZ", start + 2_000_000_000, 100, x[:40] * 0.5)
    (tmp_path / "a.mseed").write_bytes(b"".join(parts) + late)
    (tmp_path / "b.mseed").write_bytes(b"\0" * 500)
    rows = sorted(miniseed.open_traces(spark, f"{tmp_path}/*.mseed").collect(), key=lambda r: r.start_ns)
    assert [(r.network, r.station, r.channel, r.start_ns, r.delta, len(r.samples)) for r in rows] == [
        ("FR", "STA", "HHZ", start, 0.01, 100), ("FR", "STA", "HHZ", start + 2_000_000_000, 0.01, 40)]
    assert rows[0].samples == x.tolist() and rows[1].samples[3] == 1.5
    values = np.cumsum(np.random.default_rng(0).integers(-1000, 1000, 40))
    assert np.array_equal(miniseed._samples(steim1(values), miniseed.STEIM1, ">", 40), values)
    assert miniseed._fields(0b111111_000001_100000_011111_000000, 6, 5) == [-1, 1, -32, 31, 0]
    with pytest.raises(ValueError):
        miniseed._samples(b"", 99, ">", 1)


def test_open_any(spark, tmp_path):
    from stridewell.frame import save_frame
    from stridewell.sources.opening import open_any

    (tmp_path / "S1").mkdir()
    (tmp_path / "S1" / "0.tdms").write_bytes(silixa())
    assert open_any(spark, f"{tmp_path}/S1/*.tdms").shape == (20, 3) and open_any(spark, f"{tmp_path}/{{station}}/*.tdms").fields == ("station",)
    f = LabeledFrame.from_numpy(spark, np.arange(3.0), dims=("x",))
    save_frame(f, str(tmp_path / "native"))
    assert open_any(spark, str(tmp_path / "native"), engine="native").equals(f)


def test_files_become_frames(spark, tmp_path):
    from stridewell.sources.opening import open_frames, open_tree_frames

    starts = ["2023-05-01T00:00:00", "2023-05-01T00:00:00.020", "2023-05-01T00:00:05"]
    for k, start in enumerate(starts):
        folder = tmp_path / f"DAS0{k // 2 + 1}"
        folder.mkdir(exist_ok=True)
        (folder / f"{9 - k}.tdms").write_bytes(silixa(start))  # in another order by name
    (tmp_path / "DAS01" / "bad.tdms").write_bytes(b"TDSm broken")
    block = np.arange(60.0).reshape(20, 3)
    f = open_frames(spark, f"{tmp_path}/*/*.tdms")
    assert f.dims == ("time", "distance") and f.shape == (60, 3) and len(f.coords["time"].tie_values) == 2
    assert np.array_equal(f.to_numpy(), np.concatenate([block] * 3)) and f.coords["distance"].values().tolist() == [5.0, 7.0, 9.0]
    plan = f.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Union" not in plan  # one plan, whatever the number of files
    part = open_frames(spark, f"{tmp_path}/*/*.tdms", sel={"time": slice("2023-05-01T00:00:00.015", "2023-05-01T00:00:00.024"), "distance": slice(6.0, None)})
    assert part.shape == (10, 2) and np.array_equal(part.to_numpy(), np.concatenate([block] * 2)[15:25, 1:])
    assert part.coords["time"].start == f.coords["time"].start + 15_000_000
    assert np.array_equal(open_frames(spark, f"{tmp_path}/*/*.tdms", isel={"time": slice(55, None)}).to_numpy(), block[15:])
    tree = open_tree_frames(spark, f"{tmp_path}/{{station}}/[acquisition].tdms")
    assert tree.fields == ("station", "acquisition") and [(p, g.shape) for p, g in tree.frames()] == [(("DAS01", 0), (20, 3)), (("DAS01", 1), (20, 3)), (("DAS02", 0), (20, 3))]
    by_station = open_tree_frames(spark, f"{tmp_path}/{{station}}/*.tdms")
    assert [(p, g.shape) for p, g in by_station.frames()] == [(("DAS01",), (40, 3)), (("DAS02",), (20, 3))]
    with pytest.raises(Exception):
        open_frames(spark, f"{tmp_path}/*/*.tdms", "silixa", on_error="raise")

    def own(raw):
        n = len(raw) % 7 + 1
        return engines.Opened(np.full((n, 2), float(n)), C.Sampled(np.array([len(raw) * 10**9]), [n], NS, "time", True), C.Dense(np.arange(2.0), "distance"))

    (tmp_path / "x").mkdir()
    for n in (1, 20, 300):
        (tmp_path / "x" / f"{n}.bin").write_bytes(b"z" * n)
    made = open_frames(spark, f"{tmp_path}/x/*.bin", own)
    assert made.shape == (1 % 7 + 1 + 20 % 7 + 1 + 300 % 7 + 1, 2) and made.to_numpy()[0, 0] == 2


def test_frames_of_files_that_do_not_fit(spark, tmp_path):
    from stridewell.sources.opening import open_frames

    for k in range(4):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k]) * 4)

    def own(raw):
        k = raw[0]
        return engines.Opened(np.full((3, 2), float(k)), C.Sampled(np.array([k * 3 * NS]), [3], NS, "time", True), C.Dense(np.arange(2.0) + k // 2, "distance"))

    found = open_frames(spark, f"{tmp_path}/*.bin", own)
    assert [f.shape for f in found] == [(6, 2), (6, 2)] and found[1].to_numpy()[:, 0].tolist() == [2, 2, 2, 3, 3, 3]


def test_stored_trees_are_united(spark, tmp_path):
    from stridewell.sources.opening import open_any
    from stridewell.tree import Tree

    def part(start, k):
        return LabeledFrame.from_numpy(spark, np.full((4, 2), float(k)), {"time": C.Sampled.from_block(start, 4, 1.0, "time"), "x": C.Dense(np.arange(2.0), "x")}, ("time", "x"))

    Tree({"a": part("2023-01-01", 1)}, "station").save(str(tmp_path / "one"))
    Tree({"a": part("2023-01-01T00:00:04", 2), "b": part("2023-01-01", 3)}, "station").save(str(tmp_path / "two"))
    tree = open_any(spark, [str(tmp_path / "two"), str(tmp_path / "one")], engine="tree")
    assert tree.name == "station" and [(p, f.shape) for p, f in tree.frames()] == [(("a",), (8, 2)), (("b",), (4, 2))]
    assert tree["a"].to_numpy()[:, 0].tolist() == [1] * 4 + [2] * 4


def test_day_archive(spark, tmp_path):
    from stridewell.sources import miniseed

    midnight = 19_358 * miniseed.DAY_NS
    x = np.random.default_rng(0).normal(size=3000)
    rows = [("FR", "STA", "00", "HHZ", midnight - 10 * NS + 123_000, 0.02, x.tolist()), ("FR", "STA", "00", "HHN", midnight, 5.0, x[:7].tolist()), ("FR", "STA", "00", "HHE", None, 1.0, [1.0])]
    traces = spark.createDataFrame(rows, "network string, station string, location string, channel string, start_ns long, delta double, samples array<double>")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    written = {r.file: r.records for r in miniseed.write_files(traces, str(tmp_path / "sds")).collect()}
    assert set(written) == {"2022/FR/STA/HHZ.D/FR.STA.00.HHZ.D.2022.365", "2023/FR/STA/HHZ.D/FR.STA.00.HHZ.D.2023.001", "2023/FR/STA/HHN.D/FR.STA.00.HHN.D.2023.001"}
    back = sorted(miniseed.open_traces(spark, f"{tmp_path}/sds/*/*/*/*/*").collect(), key=lambda r: (r.channel, r.start_ns))
    north, vertical = [r for r in back if r.channel == "HHN"], [r for r in back if r.channel == "HHZ"]
    assert np.allclose(np.concatenate([r.samples for r in vertical]), x) and vertical[0].start_ns == midnight - 10 * NS + 123_000 and vertical[1].start_ns >= midnight
    assert north[0].delta == pytest.approx(5.0) and np.allclose(north[0].samples, x[:7])
    assert {r.file for r in miniseed.write_files(traces, str(tmp_path / "flat"), flat=True).collect()} == {n.split("/")[-1] for n in written}
