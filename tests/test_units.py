import pytest

from stridewell.functions.unitgraph import CANONICAL, EDGES, Affine, InconsistentUnits, conversions
from stridewell.operators.units import header_quantities, to_canonical

HEADERS = ("acq_id long, instrument string, dx double, dxunit string, dt double, dtunit string, datarate string, spacing array<double>, remarks string, "
           "unit_system string, value string, unit string")  # fmt: skip


def header(k, instrument="a", dx=None, dxunit=None, dt=None, dtunit=None, datarate=None, spacing=None, remarks=None):
    return (k, instrument, dx, dxunit, dt, dtunit, datarate, spacing, remarks, "clash", "clash", "clash")


def test_compositions_are_shortest_and_consistent():
    metres = conversions("m")
    assert metres["ft"].scale == pytest.approx(0.3048) and metres["yd"].scale == pytest.approx(0.9144)
    assert conversions("K")["degF"].then(Affine()).close_to(Affine(5 / 9, 273.15 - 160 / 9))
    for target in CANONICAL.values():
        conversions(target)


def test_a_wrong_cycle_is_refused():
    with pytest.raises(InconsistentUnits):
        conversions("m", [*EDGES, ("yd", "km", 0.001, 0.0)])
    with pytest.raises(InconsistentUnits):
        conversions("m", [("x", "m", 0.0, 0.0)])


def test_values_by_unit(spark):
    rows = [("length", 1.0, "ft."), ("length", 1.0, " KM "), ("length", 2.0, None), ("time", 3.0, "µs"), ("rate", 1.0, "mHz"), ("rate", 1.0, "MHz"),
            ("temperature", 32.0, "°F"), ("length", None, "ft"), ("length", 1.0, "parsec"), ("mood", 1.0, "m"), (None, 1.0, "m"), ("length", 1.0, "ft.")]
    df = spark.createDataFrame(rows, "dimension string, value double, unit string")
    got = [(r.common_value, r.is_common) for r in to_canonical(df).collect()]
    assert len(got) == len(rows)
    by = {(r.dimension, r.unit): r for r in to_canonical(df).collect() if r.value is not None}
    assert by["length", "ft."].common_value == pytest.approx(0.3048) and not by["length", "ft."].is_common
    assert by["length", " KM "].common_value == 1000
    assert by["length", None].common_value == 2.0 and by["length", None].is_common
    assert by["time", "µs"].common_value == pytest.approx(3e-6)
    assert by["rate", "mHz"].common_value == pytest.approx(1e-3) and by["rate", "MHz"].common_value == pytest.approx(1e6)
    assert by["temperature", "°F"].common_value == pytest.approx(273.15)
    assert by["length", "parsec"].common_value is None and not by["length", "parsec"].is_common
    assert by["mood", "m"].common_unit is None
    assert to_canonical(df.limit(0)).count() == 0


def test_what_a_header_says(spark):
    rows = [
        header(1, "imp", dx=10.0), header(2, "imp", dx=10.0, remarks="cable end 2 km north of hut, dx in metres as usual"), header(3, "a", dx=10.0, dxunit="Foot"),
        header(4, "a", dx=1.0, remarks="gauge rod 10 ft from mast"), header(5, "a", dx=1.0, remarks="Kanalabstand in cm angegeben / clock locked"),
        header(6, dt=1.0, dtunit="S"), header(7, dt=1.0, remarks="9 ms glitch after restart; pas de temps en µs"), header(8, datarate="every 0,5 ms"),
        header(9, datarate="1000"), header(10, datarate="0,1", remarks="rate given in kHz"), header(11, datarate="5 mHz"), header(12, datarate="50S/s"),
        header(13, "imp", spacing=[1.0, 2.0]), header(14, "imp", spacing=[1.0, 2.0], remarks="Spacing is [m, ms]"), header(15, spacing=[1.0, 0.1], remarks="Spacing = metres / seconds"),
        header(16, spacing=[1.0, 2.0], remarks="spacing stored as (cm, ms)"), header(17, None, dx=float("nan")), header(18, "a"), header(19, datarate="none"),
        header(20, "unheard of", dx=1.0), header(1, "imp", dx=10.0), header(None, dx=1.0, dxunit="km"), header(21, spacing=[]), header(22, datarate="9 /min"),
        header(23, "a", dx=1.0, dxunit=" "),
    ]
    h = spark.createDataFrame(rows, HEADERS)
    inst = spark.createDataFrame([("imp", "imperial", 1), ("a", None, 2)], "instrument string, unit_system string, dx int")
    found = header_quantities(h, inst)
    cases = {(r.acq_id, r.field) for r in found.filter("NOT is_common").collect()}
    assert cases == {(1, "dx"), (3, "dx"), (5, "dx"), (7, "dt"), (8, "datarate"), (10, "datarate"), (11, "datarate"), (13, "spacing"), (15, "spacing"), (16, "spacing"), (None, "dx"), (22, "datarate")}
    values = {(r.acq_id, r.field, r.part): r.common_value for r in found.collect()}
    assert values[8, "datarate", 0] == pytest.approx(2000) and values[10, "datarate", 0] == pytest.approx(100)
    assert values[15, "spacing", 1] == pytest.approx(0.1) and values[14, "spacing", 1] == pytest.approx(0.002)
    assert (17, "dx", 0) not in values and (18, "dx", 0) not in values and (19, "datarate", 0) not in values
    assert header_quantities(h.limit(0), inst).count() == 0
