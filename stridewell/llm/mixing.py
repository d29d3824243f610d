"""Mixing sources to target shares of tokens.

The largest mix that holds every target share is built: its size is the
smallest of ``max_repeats * tokens / share`` over the sources.  A source's
quota is some full passes over its records and one partial pass.  Records lie
in blocks by hash; a partial pass takes blocks in hashed order and cuts only
the last one, record by record.

Block copies are dealt to output shards by a splitting tree.  Each node holds
how many block copies of each source fall to its shards and splits these counts
between its halves by a multivariate hypergeometric draw, seeded by the node.
So the counts of a shard follow from the path to it alone: every shard computes
its own, totals stay exact, and no shard needs to know another.  The block
copies of a source are numbered in hashed order; a shard takes the numbers its
path assigns to it, joined by equality.  Records are then shuffled in the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .bpe import DEFAULT_TOKENIZER, encode


#: Blocks of all uses together.  The draws take fewer than 10**9 of them (each
#: source adds one block and one partial pass), and tasks hold their share.
MOST_BLOCKS = 100_000_000
#: Parts of a source's hashed order whose running sums are taken apart.
RANGES = 256


@dataclass(frozen=True)
class Quota:
    source: str
    share: float
    available: int
    full_passes: int
    rest: int
    blocks: int


def plan_quotas(targets: list[tuple], tokens: dict[str, int], block_tokens: int) -> list[Quota]:
    """Quotas of the largest mix with exact shares.

    Sources with no tokens, no share or no allowed use can't be drawn from;
    the others keep their shares relative to one another.
    """
    usable = []
    for source, share, repeats in targets:
        repeats = 1 if repeats is None else repeats
        if source is not None and share and share > 0 and repeats >= 1 and tokens.get(source, 0) > 0:
            usable.append((source, share, repeats, tokens[source]))
    if not usable:
        return []
    total = min(repeats * n / share for _, share, repeats, n in usable)
    quotas = []
    for source, share, repeats, n in usable:
        wanted = min(int(round(share * total)), repeats * n)
        quotas.append(Quota(source, share, n, wanted // n, wanted % n, max(1, -(-n // block_tokens))))
    return quotas


def block_size(total: int, least: int) -> int:
    """Tokens of a block: ``least``, or so many that the blocks of all uses can be counted in a draw."""
    return max(least, -(-total // MOST_BLOCKS))


def split_counts(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First number and number of block copies of each source for one shard."""
    node, lo, hi = 1, 0, shards
    have, start = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(have.sum())
        rng = np.random.default_rng([seed, node & 0xFFFFFFFF, node >> 32])
        draw = (total * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, draw) if total else have
        if shard < mid:
            node, hi, have = 2 * node, mid, left
        else:
            node, lo, start, have = 2 * node + 1, mid, start + left, have - left
    return start, have


def _before(rows: DataFrame, order, ties: list[str], amount, name: str) -> DataFrame:
    """Add the sum of ``amount`` over the rows of the source that come before in hashed order.

    Ranges of the hash are summed first, so that no task sees a whole source.
    """
    ranged = rows.withColumn("__o", order).withColumn("__r", F.expr(f"cast(shiftright(__o, 32) div {2**32 // RANGES} as int)"))
    ranged = ranged.withColumn("__r", F.expr("CASE WHEN __o < 0 THEN __r - 1 ELSE __r END")).withColumn("__amount", amount)
    sums = ranged.groupBy("source", "__r").agg(F.sum("__amount").alias("__s"))
    ahead = Window.partitionBy("source").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows a source
    sums = sums.select("source", "__r", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("source", "__r").orderBy("__o", *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum("__amount").over(within), F.lit(0)))
    return summed.join(sums, ["source", "__r"]).withColumn(name, F.col(name) + F.col("__ahead")).drop("__o", "__r", "__amount", "__ahead")


def token_sizes(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens; one row for each id, however often delivered."""
    ids = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    counted = encode(ids, ids="n_tokens", counts_only=True, tokenizer=tokenizer)
    return counted.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").cast("long").alias("n_tokens"))


def mix_sources(documents: DataFrame, targets: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 17,
                block_tokens: int = 20_000, shard_tokens: int = 2_000_000, with_text: bool = True) -> DataFrame:
    """Records of all sources combined to the target shares.

    Columns shard, pos (place in the shard), doc_id, source, repeat_no (0 for a
    record's first use), n_tokens and, with ``with_text``, text.  Records of a
    source that has no target, or whose source is null, aren't used; nor are
    records without id.  Repeated rows of an id are one record.  Empty tables
    give no rows.  ``targets`` is a small table (one row a source, held by the
    driver); everything else stays distributed.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    wanted = [tuple(r) for r in targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).collect()]
    names = [s for s, _, _ in wanted if s is not None]
    sized = token_sizes(documents.filter(F.col("source").isin(names)), tokenizer).checkpoint()
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    uses = sum((r if r is not None else 1) * totals.get(s, 0) for s, _, r in wanted if s is not None)
    quotas = plan_quotas(wanted, totals, block_size(uses, block_tokens))
    if not quotas:
        empty = "shard long, pos int, doc_id long, source string, repeat_no int, n_tokens long" + (", text string" if with_text else "")
        return spark.createDataFrame([], empty)

    plan = spark.createDataFrame(
        [(q.source, q.full_passes, q.rest, q.blocks) for q in quotas], "source string, full_passes long, rest long, blocks long"
    )
    placed = sized.join(F.broadcast(plan), "source").withColumn(
        "block", F.expr(f"pmod(xxhash64({seed}, doc_id), blocks)")
    )  # plan: one row a source
    sizes = placed.groupBy("source", "block", "full_passes", "rest").agg(F.sum("n_tokens").alias("size"))
    sizes = _before(sizes, F.expr(f"xxhash64({seed + 1}, source, block)"), ["block"], F.col("size"), "so_far")
    # copies of a block: its full passes, and the partial one with what is left of the quota
    copies = sizes.select(
        "source", "block",
        F.explode(F.expr("""
            concat(transform(sequence(0, full_passes), k -> named_struct('repeat_no', k,
                'room', CASE WHEN k < full_passes THEN cast(null AS bigint) ELSE rest - so_far END)))
        """)).alias("c"),
    ).select("source", "block", "c.*").filter("room IS NULL OR room > 0")
    copies = _before(copies, F.expr(f"xxhash64({seed + 2}, source, block, repeat_no)"), ["block", "repeat_no"], F.lit(1), "number").checkpoint()

    found = {r["source"]: r["count"] for r in copies.groupBy("source").count().collect()}
    names = sorted(found)
    counts = np.array([found[s] for s in names], np.int64)
    used = sum(q.full_passes * q.available + q.rest for q in quotas)
    shards = max(1, -(-used // shard_tokens))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                start, n = split_counts(counts, shards, int(shard), seed)
                yield pd.DataFrame({"shard": int(shard), "source": pd.Series(names, dtype=object), "start": start, "n": n})

    leaves = spark.range(shards).mapInPandas(deal, "shard long, source string, start long, n long")
    dealt = leaves.filter("n > 0").select("shard", "source", F.explode(F.expr("sequence(start, start + n - 1)")).alias("number"))
    where = copies.join(dealt, ["source", "number"]).select("source", "block", "repeat_no", "room", "shard")

    rows = placed.select("doc_id", "source", "n_tokens", "block").join(where, ["source", "block"])
    in_block = Window.partitionBy("source", "block", "repeat_no").orderBy(F.expr(f"xxhash64({seed + 3}, doc_id)"), "doc_id")
    # only the last block of a partial pass is cut, at the record nearest to its quota
    rows = rows.withColumn("until", F.sum("n_tokens").over(in_block))
    rows = rows.filter("room IS NULL OR until <= room OR until - room < least(n_tokens, room - until + n_tokens)")
    shuffled = Window.partitionBy("shard").orderBy(F.expr(f"xxhash64({seed + 4}, doc_id, repeat_no)"), "doc_id", "repeat_no")
    rows = rows.withColumn("pos", F.row_number().over(shuffled) - 1)
    rows = rows.select("shard", "pos", "doc_id", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens")
    if with_text:
        texts = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
        wanted_ids = rows.select("doc_id").distinct()
        texts = texts.join(wanted_ids.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        rows = rows.join(texts, "doc_id").select("shard", "pos", "doc_id", "source", "repeat_no", "n_tokens", "text")
    return rows


def mix_shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Shares reached: source, target_share, tokens, records, uses of the most used record, actual_share."""
    rows = mix_sources(documents, targets, with_text=False, **options)
    got = rows.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), (F.max("repeat_no") + 1).alias("most_uses")
    )
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # one row a source
    got = got.withColumn("actual_share", F.col("tokens") / all_tokens)
    return targets.dropDuplicates(["source"]).select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(
        {"tokens": 0, "records": 0, "most_uses": 0, "actual_share": 0.0}
    )
