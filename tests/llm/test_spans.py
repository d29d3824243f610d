import random

import pytest

import numpy as np

from stridewell.llm.spans import Chunk, WindowHashes, shared_report, shared_spans

SCHEMA = "doc_id long, text string, h long, multi boolean, s int, slice string"


def brute(rows, length):
    texts = {d: t for d, t in rows if d is not None and t is not None}
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in texts.items():
        start = end = None
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                if start is not None and i <= end:
                    end = i + length
                else:
                    if start is not None:
                        out.add((d, start, end))
                    start, end = i, i + length
        if start is not None:
            out.add((d, start, end))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, True, 2, "clash") for d, t in rows], SCHEMA)
    return [tuple(r) for r in shared_spans(df, **options).collect()]


def corpus(seed, alphabet="abcdefghij \n"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [word(rng.randint(20, 200)) for _ in range(6)]
    rows = [(d, "".join(rng.choice([word(rng.randint(0, 40)), rng.choice(common), rng.choice(common)[: rng.randint(1, 60)]]) for _ in range(rng.randint(0, 8)))) for d in range(60)]
    return rows + rows[:4]


@pytest.mark.parametrize("options", [{}, {"seed": 5}, {"hot_share": 0.02}, {"group_rows": 2}, {"block_chars": 500, "chunk_chars": 100}, {"hot_share": 0.01, "group_rows": 1, "block_chars": 300}])
def test_equals_brute_force(spark, options):
    rows = corpus(1)
    got = run(spark, rows, length=40, **({"seed": 10} | options))
    assert len(got) == len(set(got)) and set(got) == brute(rows, 40)


def test_periodic_texts(spark):
    rows = [(1, "ab" * 200), (2, "x" + "ab" * 90 + "y" + "ab" * 21), (3, "a" * 300), (4, "a" * 39), (5, "b" + "a" * 41), (6, "c" * 500), (7, "aab" * 50)]
    assert set(run(spark, rows, length=40, seed=10)) == brute(rows, 40)


def test_odd_texts(spark):
    long = "".join(random.Random(5).choice("abc défg😀\r\n") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " " * 250), (4, " " * 260), (None, long), (5, long), (6, long[:15_000] + "!" + long[15_000:]), (7, "é" * 199), (8, "é" * 199), (9, long[100:299]), (10, long[100:300])]
    assert set(run(spark, rows)) == brute(rows, 200)
    assert run(spark, [], ) == [] and run(spark, [(1, None)]) == []


def test_a_hot_text_in_a_third_of_the_documents(spark):
    rng = random.Random(2)
    notice = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [(d, "".join(rng.choice("abcdefgh") for _ in range(120)) + (notice if d % 3 == 0 else "") + str(d) * 3) for d in range(240)]
    for options in ({"hot_share": 0.01, "block_chars": 4000}, {"group_rows": 5, "block_chars": 4000}):
        assert set(run(spark, rows, **options)) == brute(rows, 200)


def test_report(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, s, e in brute(rows, 40):
        n, c = want.get(d, (0, 0))
        want[d] = (n + 1, c + e - s)
    assert {r.doc_id: (r.n_spans, r.shared_chars) for r in shared_report(df, length=40, seed=10).collect()} == want


def levels_of(texts, length, seed):
    """Of each level, the followed windows: {(text, long window): (key, start)}."""
    chunk = Chunk(WindowHashes(), texts, length)
    runs, h = chunk.seeds(seed)
    size, out = seed, []
    while True:
        rows = zip(runs.number.tolist(), runs.a.tolist(), runs.n.tolist(), runs.at.tolist(), h.tolist())
        out.append({(k, w): (key, at) for k, a, n, at, key in rows for w in range(a, a + n)})
        if 2 * size >= length:
            return out
        runs, h = chunk.double(runs, size)
        size *= 2


def test_every_long_window_follows_one_short_window_at_every_level():
    texts = [t for _, t in corpus(4) if len(t) >= 40]
    levels = levels_of(texts, 40, 5)
    assert len(levels) == 3
    for size, level in zip((5, 10, 20), levels):
        assert set(level) == {(k, w) for k, t in enumerate(texts) for w in range(len(t) - 39)}
        content = {}
        for (k, w), (key, at) in level.items():
            assert w <= at and at + size <= w + 40
            content.setdefault(texts[k][w : w + 40], set()).add((key, at - w))
        assert all(len(found) == 1 for found in content.values())  # equal long windows follow equal short ones at equal places


def test_candidates_get_fewer_from_level_to_level():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = {n: word(n) for n in (60, 120, 260)}
    texts = [word(300) + common[60] + word(300) + common[120] + word(300) + common[260] + word(300) for _ in range(4)]
    left, sizes = None, []
    for level in levels_of(texts, 200, 50):
        seen = {}
        for (k, _), (key, _) in level.items():
            seen.setdefault(key, set()).add(k)
        kept = {w for w, (key, _) in level.items() if len(seen[key]) > 1}
        assert left is None or kept <= left
        left = kept
        sizes.append(len(kept))
    shared = {(k, w) for k, t in enumerate(texts) for w in range(len(t) - 199) if sum(t[w : w + 200] in u for u in texts) > 1}
    assert len(texts[0]) > sizes[0] / 4 > sizes[1] / 4 and shared <= left and len(shared) >= 4 * 61
    assert np.all(np.diff(sizes) < 0)


def test_levels_must_double(spark):
    for options in ({"seed": 30}, {"seed": 100}, {"length": 70_000}):
        with pytest.raises(ValueError):
            run(spark, [(1, "x")], **options)
