from collections import Counter

import numpy as np
import pytest

from stridewell.llm.mixing import MOST_BLOCKS, block_size, mix_shares, mix_sources, plan_quotas, split_counts


def test_the_tree_deals_every_block_once():
    counts = np.array([1000, 37, 0, 5])
    for shards in (1, 2, 7, 16):
        taken = [Counter() for _ in counts]
        sizes = []
        for s in range(shards):
            start, n = split_counts(counts, shards, s, 3)
            sizes.append(n.sum())
            for k in range(len(counts)):
                taken[k].update(range(start[k], start[k] + n[k]))
        assert all(sorted(t.elements()) == list(range(c)) for t, c in zip(taken, counts))
        assert max(sizes) - min(sizes) <= np.log2(shards) + 1


def test_shards_are_mixed_like_the_whole():
    counts = np.array([8000, 2000])
    first = [split_counts(counts, 8, s, 1)[1][1] for s in range(8)]
    assert all(150 < n < 350 for n in first) and len(set(first)) > 1


def test_quotas():
    q = {x.source: x for x in plan_quotas([("a", 0.5, 1), ("b", 0.5, 4), ("c", 0.0, 1), (None, 0.1, 1), ("d", 0.2, 1), ("e", 0.1, 0)], {"a": 1000, "b": 300}, 100)}
    assert set(q) == {"a", "b"} and q["a"].full_passes == 1 and q["a"].rest == 0 and (q["b"].full_passes, q["b"].rest) == (3, 100)
    assert plan_quotas([], {}, 10) == []


def documents(spark, n=400):
    rows = [(k, f"text number {k} " * (k % 5 + 1), "big" if k % 8 else "small", "x", 1) for k in range(n)]
    rows += rows[:9] + [(9001, None, "small", None, 1), (9002, "", "big", None, 1), (9003, "other", None, None, 1), (9004, "other", "unknown", None, 1), (None, "y", "big", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string, room long"), {r[0]: r[1] for r in rows}


def test_shares_caps_and_uses(spark):
    docs, texts = documents(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("empty", 0.0, 2)], "source string, target_share double, max_repeats int")
    rows = mix_sources(docs, targets, block_tokens=200, shard_tokens=600).collect()
    assert len({(r.shard, r.pos) for r in rows}) == len(rows) and len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    assert {r.shard for r in rows} == set(range(max(r.shard for r in rows) + 1)) and max(r.shard for r in rows) > 2
    assert all(r.text == texts[r.doc_id] for r in rows)
    uses = Counter(r.doc_id for r in rows)
    source = {r.doc_id: r.source for r in rows}
    assert max(n for d, n in uses.items() if source[d] == "big") == 1 and max(n for d, n in uses.items() if source[d] == "small") == 3
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
    assert tokens["big"] / sum(tokens.values()) == pytest.approx(0.6, abs=0.01)
    again = mix_sources(docs, targets, block_tokens=200, shard_tokens=600, with_text=False).collect()
    assert {(r.shard, r.pos, r.doc_id) for r in again} == {(r.shard, r.pos, r.doc_id) for r in rows}
    shares = {r.source: r for r in mix_shares(docs, targets, block_tokens=200, shard_tokens=600).collect()}
    assert shares["empty"].tokens == 0 and shares["big"].actual_share == pytest.approx(tokens["big"] / sum(tokens.values())) and shares["small"].most_uses == 3


def test_empty_tables(spark):
    docs, _ = documents(spark, 10)
    targets = spark.createDataFrame([("big", 1.0, None)], "source string, target_share double, max_repeats int")
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0
    assert mix_sources(docs, targets).count() > 0
    assert mix_sources(docs.limit(0), targets).columns == mix_sources(docs, targets).columns
    assert dict(mix_sources(docs.limit(0), targets).dtypes) == dict(mix_sources(docs, targets).dtypes)
    assert {r.tokens for r in mix_shares(docs.limit(0), targets).collect()} == {0}


def test_blocks_grow_with_the_corpus():
    assert block_size(10**6, 20_000) == 20_000
    total = 10**15
    size = block_size(total, 20_000)
    counts = np.array([total // size // 3, total // size - total // size // 3])
    assert counts.sum() <= MOST_BLOCKS
    start, n = split_counts(counts, 1000, 999, 5)
    assert (start + n == counts).all() and abs(int(n.sum()) - counts.sum() // 1000) < 20


def test_running_sums_in_ranges_are_those_of_the_whole_order(spark):
    from pyspark.sql import functions as F

    from stridewell.llm.mixing import _before

    rows = [("a" if k % 3 else "b", k, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "source string, block long, size long")
    got = _before(df, F.expr("CASE WHEN block % 5 = 0 THEN block * 1000 - 5 ELSE xxhash64(block) END"), ["block"], F.col("size"), "so_far")
    held = {(r.source, r.block): r for r in got.withColumn("h", F.expr("CASE WHEN block % 5 = 0 THEN block * 1000 - 5 ELSE xxhash64(block) END")).collect()}
    for source in "ab":
        total = 0
        for r in sorted((r for (s, _), r in held.items() if s == source), key=lambda r: (r.h, r.block)):
            assert r.so_far == total
            total += r["size"]
