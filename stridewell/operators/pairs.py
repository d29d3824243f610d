"""Pairs of rows of one class, and classes with their representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a class that meet in one task.
CLASS_ROWS = 1000


def class_pairs(df: DataFrame, cls: str, item: str, *, rows: int = CLASS_ROWS) -> DataFrame:
    """Each two items of one class, the smaller first: ``<item>_a``, ``<item>_b``.

    The result is as large as its statement says: n (n - 1) / 2 rows of a class
    of n.  A large class is dealt into parts of about ``rows`` items, and each two
    parts are a key of their own, so that no task pairs a whole class.  Rows
    with a null class or item, and repeated rows, are left out; an empty table gives none.
    """
    items = df.select(F.col(f"`{cls}`").alias("cls"), F.col(f"`{item}`").alias("item")).filter("cls IS NOT NULL AND item IS NOT NULL").distinct()
    ensure_checkpoint_dir(df.sparkSession)
    items = items.checkpoint()
    sizes = items.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.expr(f"cast(ceil(n / {rows}) as int)"))
    # the join key of a large class is salted, so that none of its tasks reads all its rows
    salt = F.expr("cast(pmod(xxhash64(item), 64) as int)")
    salted = sizes.withColumn("salt", F.explode(F.expr("CASE WHEN parts > 1 THEN sequence(0, 63) ELSE array(-1) END")))
    small = sizes.filter("parts = 1").select("cls")
    large = salted.filter("parts > 1").select("cls", "salt", "parts")
    plain = items.join(small, "cls").select("cls", F.lit(0).alias("x"), F.lit(0).alias("y"), "item", F.lit(True).alias("first"), F.lit(True).alias("second"))
    dealt = items.withColumn("salt", salt).join(large, ["cls", "salt"]).withColumn("part", F.expr("cast(pmod(xxhash64(item, 7), parts) as int)"))
    each = F.explode(F.expr("""transform(sequence(0, parts - 1), o -> named_struct('x', least(part, o), 'y', greatest(part, o),
        'first', part <= o, 'second', part >= o))"""))  # fmt: skip
    dealt = dealt.select("cls", "item", each.alias("p")).select("cls", "p.x", "p.y", "item", "p.first", "p.second")
    met = plain.unionByName(dealt)
    a = met.filter("first").select("cls", "x", "y", F.col("item").alias("a"))
    b = met.filter("second").select("cls", "x", "y", F.col("item").alias("b"))
    # within one part a < b picks one order; between two parts each pair meets once
    pairs = a.join(b, ["cls", "x", "y"]).filter("x < y OR a < b")
    return pairs.select(F.least("a", "b").alias(f"{item}_a"), F.greatest("a", "b").alias(f"{item}_b"))


def class_members(df: DataFrame, cls: list[str], item: str) -> DataFrame:
    """Each item of a class of two or more: ``item``, ``representative`` (its smallest) and ``links`` (how many others)."""
    items = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cls)], F.col(f"`{item}`").alias("item")).dropna().distinct()
    ensure_checkpoint_dir(df.sparkSession)
    items = items.checkpoint()
    names = [f"c{k}" for k in range(len(cls))]
    salt = F.expr("cast(pmod(xxhash64(item), 32) as int)")
    # by salt first: a class may hold any share of the items
    part = items.withColumn("salt", salt).groupBy(*names, "salt").agg(F.min("item").alias("m"), F.count("*").alias("n"))
    whole = Window.partitionBy(*names)  # at most 32 rows
    known = part.select(*names, "salt", F.min("m").over(whole).alias("representative"), F.sum("n").over(whole).alias("n")).filter("n > 1")
    found = items.withColumn("salt", salt).join(known, [*names, "salt"])
    return found.select(F.col("item").alias(item), "representative", (F.col("n") - 1).alias("links"))
