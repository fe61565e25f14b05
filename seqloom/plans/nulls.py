"""Deterministic null draws: permutations ordered by hash, shifts, and top-k draws.

Nothing depends on partitioning or on ``rand()``, so an independent SQL engine can repeat every draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int, *parts) -> Column:
    """A hex digest that orders a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def repeated(df: DataFrame, permutations: int) -> DataFrame:
    """``df`` once per perm_id 0 .. permutations-1; the copies are made by an explode, not by a join."""
    return df.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))


def listed(df: DataFrame, value: str, group=("book",), order: str = "pos") -> DataFrame:
    """group and ``_rows``, the group's (o, v) pairs of ``order`` and ``value`` in order: a group is one array in one task."""
    return df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_rows"))


def drawn(seed: int, group=("book",)) -> Column:
    """The pairs of ``listed`` (beside a perm_id) in the order of their draw."""
    keyed = F.transform("_rows", lambda r: F.struct(draw_key(seed, "perm_id", *group, r["o"]).alias("key"), r["o"].alias("o"), r["v"].alias("v")))
    return F.sort_array(keyed)


def shuffled(df: DataFrame, value: str, permutations: int, seed: int, group=("book",), order: str = "pos") -> DataFrame:
    """perm_id, group, order and ``value`` dealt anew within each group and permutation.

    The copies are made and dealt inside the row of their group, so neither a shuffle nor a broadcast grows with their number.
    """
    many = repeated(listed(df, value, group, order), permutations)
    pairs = F.zip_with("_rows", drawn(seed, group), lambda r, x: F.struct(r["o"].alias(order), x["v"].alias(value)))
    return many.select("perm_id", *group, F.inline(pairs))


def cyclic(df: DataFrame, value: str, permutations: int, seed: int, group=("book",), order: str = "pos") -> DataFrame:
    """Like ``shuffled``, but each permutation turns the values of a group by one offset, 1 .. n-1."""
    many = repeated(listed(df, value, group, order), permutations).withColumn("_n", F.size("_rows"))
    digits = F.conv(F.substring(draw_key(seed, "perm_id", *group), 1, 8), 16, 10).cast("long")
    many = many.withColumn("_shift", F.when(F.col("_n") > 1, 1 + digits % (F.col("_n") - 1)).otherwise(0).cast("int"))
    pairs = F.transform("_rows", lambda r, k: F.struct(r["o"].alias(order), F.get("_rows", (k - F.col("_shift") + F.col("_n")) % F.col("_n"))["v"].alias(value)))
    return many.select("perm_id", *group, F.inline(pairs))


def eligible_shifts(active: DataFrame) -> DataFrame:
    """(book, shift): cuts of a stream (book, pos dense from 0, value) that part no run of values above 0."""
    by, whole = Window.partitionBy("book").orderBy("pos"), Window.partitionBy("book")
    on = active.select("book", "pos", (F.col("value") > 0).alias("on"))
    on = on.withColumn("before", F.lag("on").over(by)).withColumn("n", F.count("*").over(whole))
    ends = F.max(F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1), F.col("on").cast("int")).otherwise(0)).over(whole)
    both = F.sum(F.when(((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)) & F.col("on"), 1).otherwise(0)).over(whole)
    cut = on.withColumn("both", both).withColumn("any_end", ends).where((F.col("pos") > 0) & ~(F.col("on") & F.col("before")))
    return cut.where("both < 2").select("book", (F.col("n") - F.col("pos")).alias("shift"))


def chosen(df: DataFrame, k: int, seed: int, group: tuple[str, ...], item: str) -> DataFrame:
    """``k`` rows of each group by draw order."""
    by = Window.partitionBy(*group).orderBy(draw_key(seed, *group, item), item)
    return df.withColumn("draw", F.row_number().over(by)).where(F.col("draw") <= k)
