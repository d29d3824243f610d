"""Splitting long ordered groups into blocks of bounded size.

A key (lane, series, instrument, device) may hold any share of all rows, so a
key's rows are never brought into one task.  Its time line is cut into cells,
cells are counted, and neighbouring cells are joined until they hold about
``target`` rows.  Cells that bursts or outlying times fill are cut again, by
the times they hold and then by a column that orders rows of one time, until
all are small.  Only cells of long keys are counted, so the layout is far
smaller than the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a layout up to which it is broadcast; above, Catalyst joins it by key.
BROADCAST_ROWS = 200_000
#: Cells whose counts one task adds up.
CELL_GROUP = 4096
_LEAST = "cast('-9223372036854775808' AS bigint)"  # the time and tie of rows without one: they come first


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a (checkpointed) side for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def time_blocks(df: DataFrame, key: str, at: str, *, target: int = 50_000, halo: int = 0, fine: int = 64, ties: str | None = None, ends: bool = False) -> DataFrame:
    """Add ``block`` and ``core`` columns.

    Blocks of a key follow each other along ``at`` (long; nulls come first), and
    hold at most ``target`` rows of their own and one cell, which is
    ``4 * target / fine`` rows at most unless more than that share ``at`` (and
    ``ties``, if given).  With a ``halo``, at
    least that many rows before and after a block's own (or all there are) are
    repeated in it with ``core`` false, however unevenly the rows lie in time
    (the block after the last may hold only such rows); every row
    has ``core`` true in exactly one block.  Keys of at
    most ``target`` rows are one block.  Rows with a null key are in
    block 0.  Rows of one time are cut along ``ties`` (long) if
    they are many, and ``ends`` (with a halo) adds a column of that name: bit 1 in rows about
    the key's first, bit 2 about its last, so that a block knows what it holds.
    """
    return cut_blocks(df, key, at, target=target, halo=halo, fine=fine, ties=ties, ends=ends)[0]


def cut_blocks(df: DataFrame, key: str, at: str, *, target: int = 50_000, halo: int = 0, fine: int = 64, ties: str | None = None,
               ends: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """As :func:`time_blocks`, with the keys that were cut (None if there are none)."""
    ensure_checkpoint_dir(df.sparkSession)
    at = f"coalesce(`{at}`, {_LEAST})"
    ties = f"coalesce(`{ties}`, {_LEAST})" if ties else None
    spread = [F.min(F.expr(x)).alias(n) for x, n in ((at, "__lo"), (ties or at, "__lot"))] + [F.max(F.expr(x)).alias(n) for x, n in ((at, "__hi"), (ties or at, "__hit"))]
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"), *spread)
    long_keys = sizes.filter((F.col("__n") > target) & F.col(key).isNotNull() & F.expr("__hi > __lo OR __hit > __lot"))
    # doubles order longs as they are, if not strictly, and can't overflow
    long_keys = long_keys.select(
        key, F.col("__lo").cast("double").alias("__lo"), F.expr(f"greatest(1D, (cast(__hi AS double) - cast(__lo AS double)) / (ceil(__n / {target}) * {fine}))").alias("__width"),
        F.col("__n").alias("__total"),
    ).checkpoint()
    if long_keys.isEmpty():
        whole = df.withColumn("block", F.lit(0)).withColumn("core", F.lit(True))
        return (whole.withColumn("ends", F.lit(3)) if ends else whole), None
    celled = df.join(broadcast_checked(long_keys.drop("__total")), key, "left").withColumn("__wide", F.expr(f"cast(floor((cast({at} AS double) - __lo) / __width) AS bigint)"))
    celled = celled.withColumn("__group", F.expr(f"__wide div {CELL_GROUP}")).drop("__lo", "__width")
    celled, cells, place = _even_cells(celled, key, at, max(1, target // fine), ties)
    # running sum of the cells, in two steps so that no task sums all cells of a key
    before = Window.partitionBy(key).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = cells.groupBy(key, "__group").agg(F.sum("__n").alias("__ahead"))
    groups = groups.select(key, "__group", F.coalesce(F.sum("__ahead").over(before), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(key, "__group").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    layout = cells.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(groups, [key, "__group"])
    layout = layout.withColumn("__before", F.col("__before") + F.col("__ahead"))
    core = f"cast(__before div {target} as int)"
    if not halo:
        layout = layout.select(key, *place, F.expr(core).alias("__core")).checkpoint()
        placed = celled.join(broadcast_checked(layout), [key, *place], "left")
        return placed.withColumn("block", F.coalesce("__core", F.lit(0))).withColumn("core", F.lit(True)).drop("__group", *place, "__core"), long_keys.select(key)
    # a block's own rows may begin and end late by up to its key's largest cell
    margins = cells.groupBy(key).agg((F.max("__n") + halo).alias("__margin")).join(long_keys.select(key, "__total"), key)
    layout = layout.join(broadcast_checked(margins.checkpoint()), key)
    layout = layout.select(
        key, *place, F.expr(core).alias("__core"), F.expr(f"greatest(0, least({core}, cast((__before - __margin) div {target} as int)))").alias("__from"),
        F.expr(f"greatest({core}, cast((__before + __n - 1 + __margin) div {target} as int))").alias("__to"),
        F.expr("CASE WHEN __before = 0 THEN 1 ELSE 0 END + CASE WHEN __before + __n = __total THEN 2 ELSE 0 END").alias("ends"),
    )
    layout = (layout if ends else layout.drop("ends")).checkpoint()
    placed = celled.join(broadcast_checked(layout), [key, *place], "left")
    placed = placed.withColumn("block", F.explode(F.expr("coalesce(sequence(__from, __to), array(0))")))
    placed = placed.withColumn("core", F.col("__core").isNull() | (F.col("__core") == F.col("block"))).drop("__group", *place, "__core", "__from", "__to")
    return (placed.withColumn("ends", F.coalesce("ends", F.lit(3))) if ends else placed), long_keys.select(key)


def _even_cells(celled: DataFrame, key: str, at: str, mean: int, ties: str | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut cells of over four times ``mean`` rows again, by the times they hold, then by ``ties``.

    ``__wide`` numbers the first, equally wide cells; ``__cell`` is the beginning
    of a cell's time once it was cut, ``__tie`` that of its ties.
    Returns the rows with their cells, the counted cells, and a cell's columns in
    order.  Each turn cuts what is left at least eightfold, and counts once more.
    """
    place = ["__wide", "__cell", "__tie"]
    for c in place[1:]:
        celled = celled.withColumn(c, F.when(F.col("__wide").isNotNull(), F.lit(0).cast("long")))
    extent = [f(F.expr(x)).alias(n) for f, x, n in ((F.min, at, "__a"), (F.max, at, "__b"), (F.min, ties or at, "__c"), (F.max, ties or at, "__d"))]
    while True:
        cells = celled.filter("__wide IS NOT NULL").groupBy(key, "__group", *place).agg(F.count("*").alias("__n"), *extent).checkpoint()
        heavy = cells.filter((F.col("__n") > 4 * mean) & ((F.col("__b") > F.col("__a")) | ((F.col("__d") > F.col("__c")) & F.lit(bool(ties)))))
        heavy = heavy.withColumn("__by", F.expr("__b > __a")).selectExpr(
            key, *place, "__by", "CASE WHEN __by THEN __a ELSE __c END AS __first",
            f"(CASE WHEN __by THEN cast(__b AS decimal(20, 0)) - __a ELSE cast(__d AS decimal(20, 0)) - __c END) div greatest(8, __n div {mean}) + 1 AS __width",
        ).checkpoint()
        if heavy.isEmpty():
            return celled, cells.drop("__a", "__b", "__c", "__d"), place
        celled = celled.join(broadcast_checked(heavy), [key, *place], "left")
        begin = "cast(__first + ((cast({0} AS decimal(20, 0)) - __first) div __width) * cast(__width AS decimal(20, 0)) AS bigint)"
        cell = F.expr(f"CASE WHEN __by THEN {begin.format(at)} ELSE __cell END")
        tie = F.expr(f"CASE WHEN __by THEN __tie WHEN NOT __by THEN {begin.format(ties or at)} ELSE __tie END")
        celled = celled.withColumns({"__cell": cell, "__tie": tie}).drop("__by", "__first", "__width")
