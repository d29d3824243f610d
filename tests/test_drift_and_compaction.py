import json

import pytest
from pyspark.sql import functions as F

from stridewell.operators import compaction
from stridewell.operators.drift import advance, drift, migrate
from stridewell.operators.pairs import class_members, class_pairs

DRIFT = "device_id long, file_no long, header_id long, attrs_json string, block int, init string, version int"


def changes(*files):
    state, out = None, []
    for f in files:
        state, c = advance(state, f)
        out.append(c)
    return out


def test_each_kind_of_change():
    assert changes({"a": 1, "b": "x"}, {"a": 1, "c": "x"}) == [[], [("c", "renamed", "b")]]
    assert changes({"a": 1}, {"a": 1, "b": 2}) == [[], [("b", "added", None)]]
    assert changes({"a": 1, "b": 2}, {"a": 1}) == [[], [("b", "removed", None)]]
    assert changes({"a": 1}, {"a": "1"}) == [[], [("a", "retyped", None)]]
    assert changes({"a": 1}, {"A": "1"}) == [[], [("A", "added", None), ("a", "removed", None)]]
    assert changes({"a": True}, {"a": 1}) == [[], [("a", "retyped", None)]]
    assert changes({"a": 100}, {"b": 100.0}) == [[], [("b", "renamed", "a")]]
    assert changes({"a": [1, 2]}, {"b": [1, 3]}) == [[], [("a", "removed", None), ("b", "added", None)]]


def test_null_keeps_the_last_known_value_and_type():
    assert changes({"a": 5}, {"a": None}, {"b": 5}) == [[], [], [("b", "renamed", "a")]]
    assert changes({"a": 5}, {"a": None}, {"a": "5"}) == [[], [], [("a", "retyped", None)]]
    assert changes({"a": None}, {"a": 1}, {"a": "1"}) == [[], [], [("a", "retyped", None)]]
    assert changes({"a": 5, "c": 1}, {"b": None, "c": 1}) == [[], [("a", "removed", None), ("b", "added", None)]]


def test_equal_values_pair_up_by_name():
    assert changes({"a": 1, "b": 1}, {"c": 1}) == [[], [("b", "removed", None), ("c", "renamed", "a")]]


def test_migration_steps_chain():
    state, _ = advance({}, {"Block_Rate_mHz": "250.5 mHz", "origin": [1.5], "ChannelExtent": "3,9", "FwVersion": 7, "Odd": {"x": 1}, "Gauge": None, "PRF": True})
    row = migrate(state)
    assert row["block_rate"] == 250.5 and row["origin"] == 1.5 and row["extent"] == [3.0, 9.0] and row["firmware"] == "7" and row["gauge_length"] is None
    assert row["extras"] == [("Odd", '{"x": 1}')]
    row = migrate(advance({}, {"origin": [1.5, 2], "FwVersion": ["a", "b"]})[0])
    assert row["origin"] == 1.5 and row["firmware"] == "a" and dict(row["extras"]) == {"origin": "[1.5, 2]", "FwVersion": '["a", "b"]'}


def test_attributes_with_one_target_are_all_kept():
    row = migrate(advance({}, {"AmpPower": 3, "Amplifier": 7, "BlockRate": None, "blockRate": 5, "Block_Rate_mHz": 6, "FwVersion": None, "Firmware": "a"})[0])
    assert dict(row["extras"]) == {"Amplifier": "7", "AmpPower": "3", "blockRate": "5"}
    assert dict(row["collisions"]) == {"AmpPower": "Amplifier", "blockRate": "BlockRate"}
    assert row["block_rate"] == 6.0 and row["firmware"] == "a"
    row = migrate(advance({}, {"GaugeLength": 2, "Gauge": None, "Origin": 4, "origin": None})[0])
    assert row["gauge_length"] == 2.0 and row["origin"] == 4.0 and not row["extras"] and not row["collisions"]


def test_found_renames_and_defaults_reach_their_columns(spark):
    files = [{"Gauge": 2.5, "a": 0}, {"g1": 2.5, "a": 1}, {"g1": None, "a": 2}, {"g2": 2.5, "a": 3, "FreqRes": 9}, {"g2": 4, "a": 4, "BlockRate": 8}]
    files += [{"g2": 4, "a": k} for k in range(5, 40)] + [{"g2": 4, "Gauge": 3, "a": 40}, {"a": 41}, {"g2": 7, "a": 42}]
    df = spark.createDataFrame([(1, n, n, json.dumps(f), 0, "x", 0) for n, f in enumerate(files)], DRIFT)
    for target in (20_000, 1, 2, 7):
        rows = {r.header_id: r for r in drift(df, target=target).collect()}
        assert [rows[n].gauge_length for n in range(len(files))] == [2.5] * 4 + [4.0] * 36 + [3.0, None, None]
        assert rows[3].block_rate == rows[3].freq_res == 9 and rows[4].block_rate == 8 and rows[5].block_rate is None
        assert rows[39].extras == {"a": "39"} and rows[40].collisions == {"g2": "GaugeLength"} and rows[42].extras == {"g2": "7", "a": "42"}


def test_versions_are_those_of_fingerprints(spark):
    files = [{"a": 1}, {"a": 2}, {"a": 1, "b": 1}, {"a": "x", "b": 1}, {"a": 1, "b": 2}, {"a": 1}]
    df = spark.createDataFrame([(d, n, 10 * d + n, json.dumps(f), 0, "x", 0) for d in (1, 2) for n, f in enumerate(files)], DRIFT)
    for target in (20_000, 2):
        rows = {r.header_id: r for r in drift(df, target=target).collect()}
        assert [rows[10 + n].version for n in range(6)] == [1, 1, 2, 3, 2, 1] == [rows[20 + n].version for n in range(6)]
        assert rows[10].fingerprint == rows[15].fingerprint != rows[12].fingerprint
        only = {r.header_id: r.changes for r in drift(df, target=target, changes_only=True).collect()}
        assert only == {h: r.changes for h, r in rows.items() if r.changes}


def test_devices_in_blocks(spark):
    rows, k = [], 0
    for device in range(4):
        for n in range(200 if device == 1 else 12):
            attrs = {"a": n // 5, "b" if n % 7 else "c": "x", "d": [None, 1, "1"][n % 3]}
            rows.append((device, n, k, json.dumps(attrs, separators=(",", ":") if n % 2 else None), 9, "x", 9))
            k += 1
    rows += rows[3:9] + [(None, 1, 1, "{}", 9, "x", 9), (1, None, 2, "{}", 9, "x", 9), (1, 3, None, "{}", 9, "x", 9)]
    rows += [(9, 1, 9001, None, 9, "x", 9), (9, 2, 9002, "[1]", 9, "x", 9), (9, 3, 9003, "{bad", 9, "x", 9), (9, 4, 9004, "{}", 9, "x", 9)]
    df = spark.createDataFrame(rows, DRIFT)
    whole = sorted(map(str, drift(df).collect()))
    assert len(whole) == 200 + 36 + 1
    assert sorted(map(str, drift(df, target=13).collect())) == whole
    assert drift(df.limit(0)).count() == 0


ROWS = "file_id long, row_no int, time__ns long, distance__i long, value double, records long, kept_as long"
LIST = "file_id long, path string, n_records int, size_bytes long, mtime timestamp_ntz, at long, block int"


def file_rows(file, records):
    return [(file, k, *r, 1, 1) for k, r in enumerate(records)]


@pytest.fixture
def tables(spark):
    a = [(1, 2, 0.5), (2, 2, None), (3, 2, float("nan"))]
    rows = file_rows(1, a) + file_rows(2, a[::-1] + a[:1]) + file_rows(3, a[:2]) + file_rows(4, [(1, 2, -0.0)]) + file_rows(5, [(1, 2, 0.0)])
    rows += file_rows(6, [(None, 2, 1.0)]) + file_rows(7, [(2, None, 1.0)]) + file_rows(None, a) + file_rows(9, a)
    listed = [(k, f"file:///x//./y/{k}.h5", None if k == 3 else 99, -1, None, 1, 1) for k in range(1, 9)] + [(1, "/x/y/1.h5", 3, 5, None, 1, 1), (None, None, None, None, None, 1, 1)]
    return spark.createDataFrame(listed, LIST), spark.createDataFrame(rows, ROWS)


def test_same_sets_of_records(spark, tables):
    listed, rows = tables
    m = {r.file_id: r for r in compaction.manifest(listed, rows).collect()}
    assert {k: r.kept_as for k, r in m.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: None, 9: 1}
    assert m[2].records == 3 and m[8].records == 0 and m[2].path == "/x/y/2.h5"


def test_nothing_is_lost_or_doubled(spark, tables):
    listed, rows = tables
    frozen = compaction.manifest(listed, rows)
    for block_rows in (50_000, 2):
        planned = compaction.plan(frozen, target_bytes=72, block_rows=block_rows)
        written = compaction.rewrite(rows, planned)
        assert written.count() == 3 + 2 + 1 + 1 + 1
        assert all(r.agrees for r in compaction.reconcile(planned, written).collect())
        for bad in (written.filter("file_id <> 3"), written.unionByName(written.filter("file_id = 6")), written.withColumn("value", F.expr("value + 1")),
                    written.withColumn("file_id", F.expr("CASE WHEN file_id = 7 THEN 6 ELSE file_id END"))):
            assert not all(r.agrees for r in compaction.reconcile(planned, bad).collect())
        assert planned.select("out_file").distinct().count() > 1
    empty = compaction.manifest(listed.limit(0), rows.limit(0))
    assert empty.count() == 0 and compaction.plan(empty).count() == 0


def test_written_files(spark, tables, tmp_path):
    listed, rows = tables
    planned = compaction.plan(compaction.manifest(listed, rows), target_bytes=72)
    compaction.write(rows, planned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 8
    assert all(r.agrees for r in compaction.reconcile(planned, back).collect())
    assert len(list((tmp_path / "out").glob("*/*.parquet"))) == planned.select("out_file").distinct().count()


def test_pairs_of_large_and_small_classes(spark):
    rows = [(k % 3 if k < 60 else 5, k) for k in range(120)] + [(None, 1), (1, None), (9, 500)] + [(0, 3)] * 2
    df = spark.createDataFrame(rows, "c long, id long").selectExpr("*", "1 AS x", "'y' AS cls")
    of = {}
    for c, i in set(rows):
        if c is not None and i is not None:
            of.setdefault(c, set()).add(i)
    want = {(a, b) for s in of.values() for a in s for b in s if a < b}
    for size in (1000, 7):
        got = class_pairs(df, "c", "id", rows=size).collect()
        assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == want
    members = {(r.id, r.representative, r.links) for r in class_members(df, ["c"], "id").collect()}
    assert members == {(i, min(s), len(s) - 1) for s in of.values() if len(s) > 1 for i in s}
    assert class_pairs(df.limit(0), "c", "id").count() == class_members(df.limit(0), ["c"], "id").count() == 0
