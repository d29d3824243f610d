from datetime import datetime, timezone

import pytest

from stridewell.operators.timestamps import candidates, normalise, viterbi


def us(*t, micro=0):
    return int(datetime(*t, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


def best(text, zone=None, order="dmy"):
    found = sorted(candidates(text, zone, order), key=lambda c: c[2])
    return found[0][1] if found and found[0][2] < 1000 else None


@pytest.mark.parametrize(
    "text, zone, order, want",
    [
        ("2023-01-01T00:17:14.585Z", "Asia/Tokyo", "dmy", us(2023, 1, 1, 0, 17, 14, micro=585000)),
        ("2023-01-02T09:27:52,811Z", None, "dmy", us(2023, 1, 2, 9, 27, 52, micro=811000)),
        ("01.02.2023 13:09:52", "Europe/Oslo", "mdy", us(2023, 2, 1, 12, 9, 52)),
        ("03/04/2023 01:02:03", "UTC", "mdy", us(2023, 3, 4, 1, 2, 3)),
        ("03/04/2023 01:02:03", None, "dmy", us(2023, 4, 3, 1, 2, 3)),
        ("16/02/2023 06:51:24 PM", "UTC", "dmy", us(2023, 2, 16, 18, 51, 24)),
        ("16/02/2023 12:00:00 AM", "UTC", "dmy", us(2023, 2, 16)),
        ("20230106T012907.286Z", None, "dmy", us(2023, 1, 6, 1, 29, 7, micro=286000)),
        ("20230216153808.000", None, "dmy", us(2023, 2, 16, 15, 38, 8)),
        ("2023-047T09:09:30.000Z", None, "dmy", us(2023, 2, 16, 9, 9, 30)),
        ("2023-01-08T15:27:09+11:00[Australia/Sydney]", None, "dmy", us(2023, 1, 8, 4, 27, 9)),
        ("2023-02-16T19:06:13.086424-0330", None, "dmy", us(2023, 2, 16, 22, 36, 13, micro=86424)),
        ("2023-01-07 21:27:09 MST", "Asia/Tokyo", "dmy", us(2023, 1, 8, 4, 27, 9)),
        ("01-Nov-2023 06:07:43.464", "UTC", "dmy", us(2023, 11, 1, 6, 7, 43, micro=464000)),
        ("Thu, 02 Nov 2023 00:38:32 +0530", None, "dmy", us(2023, 11, 1, 19, 8, 32)),
        ("1672833625.241000", "Asia/Tokyo", "dmy", us(2023, 1, 4, 12, 0, 25, micro=241000)),
        ("1.673152029E9", None, "dmy", 1673152029_000000),
        ("1676532577000", None, "dmy", 1676532577_000000),
        ("1673021942000000", None, "dmy", 1673021942_000000),
        ("1676550175622554999", None, "dmy", 1676550175_622554),
        ("2023-02-19T05:51:33.758129999Z", None, "dmy", us(2023, 2, 19, 5, 51, 33, micro=758129)),
        ("2023-10-29 02:30:00", "Europe/Oslo", "dmy", us(2023, 10, 29, 0, 30)),  # first passing of a repeated hour
        ("2023-03-26 02:30:00", "Europe/Oslo", "dmy", us(2023, 3, 26, 1, 30)),  # a skipped hour moves forward
        ("  2023-02-16T09:38:14 ", "UTC", "dmy", us(2023, 2, 16, 9, 38, 14)),
    ],
)
def test_notations(text, zone, order, want):
    assert best(text, zone, order) == want


@pytest.mark.parametrize("text", [None, "", "  ", "N/A", "TBD", "not set", "????-??-??", "0000-00-00 00:00:00", "2023-02-30 10:00:00", "2023-366T00:00:00Z", "x" * 100_000, "1" * 5000, "2023-01-01 25:00:00", "1e999999"])
def test_what_cannot_be_read(text):
    assert best(text) is None


def test_viterbi_keeps_the_order_of_a_source():
    a = candidates("05/03/2023 00:00:00", "UTC", None)
    fixed = candidates("25/03/2023 00:00:00", "UTC", None)
    later = candidates("06/04/2023 00:00:00", "UTC", None)
    chosen = viterbi([a, [], fixed, later])
    assert chosen[1] == -1
    picked = [(c[k][1]) for c, k in zip([a, fixed, later], [chosen[0], chosen[2], chosen[3]])]
    assert picked == [us(2023, 3, 5), us(2023, 3, 25), us(2023, 4, 6)]


def test_viterbi_equals_trying_all_paths():
    import itertools
    import random

    rng = random.Random(0)
    for _ in range(30):
        rows = [[(rng.choice("ab"), rng.randint(0, 50), rng.choice([0.0, 1.0])) for _ in range(rng.randint(0, 3))] for _ in range(6)]
        full = [r for r in rows if r]

        def cost(path):
            total, last = 0.0, None
            for r, k in zip(full, path):
                total += r[k][2] + (0 if last is None else (r[k][0] != last[0]) * 1.0 + (r[k][1] < last[1]) * 0.5)
                last = r[k]
            return total

        chosen = [k for k in viterbi(rows) if k >= 0]
        if full:
            assert cost(chosen) == min(map(cost, itertools.product(*[range(len(r)) for r in full])))


def test_frames(spark):
    schema = "id long, source string, text string, arrival long, tz string, date_order string, block int, core int, notation string"
    rows = [(k, "hot", f"{k % 28 + 1:02d}/03/2023 00:00:{k % 60:02d}", k, "UTC", "dmy", 9, 9, "clash") for k in range(500)]
    rows += [(1000, None, "2023-01-01T00:00:00Z", 1, None, None, 9, 9, None), (1001, "x", None, None, None, None, 9, 9, None), (1002, "x", "junk", 1, "Mars/Base", "ymd", 9, 9, None)]
    rows += rows[:5] + [(1003, "x", "2023-01-01 00:00:00", 1, "Mars/Base", "ymd", 9, 9, None)]
    df = spark.createDataFrame(rows, schema)
    plain = {(r.id, r.instant_us) for r in normalise(df, "id", "source", "text", "arrival").collect()}
    assert len(plain) == 504
    assert (1000, us(2023, 1, 1)) in plain and (1001, None) in plain and (1002, None) in plain and (1003, us(2023, 1, 1)) in plain
    assert {(r.id, r.instant_us) for r in normalise(df, "id", "source", "text", "arrival", target=50, halo=20).collect()} == plain
    assert normalise(df.limit(0), "id", "source", "text", "arrival").count() == 0


def test_the_path_decides_where_nothing_is_stated(spark):
    texts = ["01/25/2023 00:00:00", "02/03/2023 00:00:00", "02/25/2023 00:00:00"]
    readings = [candidates(t, None, None) for t in texts]
    chosen = [r[k][1] for r, k in zip(readings, viterbi(readings))]
    alone = [min(r, key=lambda c: c[2])[1] for r in readings]
    assert chosen[1] == us(2023, 2, 3) and alone[1] == us(2023, 3, 2)
    rows = [(k, "s", t, k, None, None) for k, t in enumerate(texts)] + [(9, "t", texts[1], 0, None, None)]
    df = spark.createDataFrame(rows, "id long, source string, text string, at long, tz string, date_order string")
    got = {r.id: (r.notation, r.instant_us) for r in normalise(df, "id", "source", "text", "at", zone="tz").collect()}
    assert got[1] == ("slash mdy", us(2023, 2, 3)) and got[9] == ("slash dmy", us(2023, 3, 2))


def test_viterbi_is_the_cheapest_of_all_paths():
    import itertools
    import random

    from stridewell.operators.timestamps import BACKWARD_COST, SWITCH_COST

    rng = random.Random(3)
    for _ in range(60):
        readings = [[(rng.choice("ab"), rng.randrange(9), rng.choice([0.0, 0.5, 1.0, 2.0])) for _ in range(rng.choice([0, 1, 2, 3]))] for _ in range(6)]
        held = [r for r in readings if r]

        def cost(path):
            steps = sum((a[0] != b[0]) * SWITCH_COST + (b[1] < a[1]) * BACKWARD_COST for a, b in zip(path, path[1:]))
            return steps + sum(c for _, _, c in path)

        got = [r[k] for r, k in zip(readings, viterbi(readings)) if k >= 0]
        assert len(got) == len(held)
        assert not held or abs(cost(got) - min(map(cost, itertools.product(*held)))) < 1e-9
