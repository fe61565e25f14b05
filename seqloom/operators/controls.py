"""Null distributions for bursts and profiles: shuffled values, values shuffled inside segments, and active positions dealt anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import nulls as N


def _clustering(rows: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys, "book").orderBy("i")
    on = F.col("value") > 0
    marked = rows.withColumn("_next", F.lead("value").over(by)).withColumn("_before", F.lag("value").over(by))
    got = marked.groupBy(*keys).agg(F.count_if(on & (F.col("_next") > 0)).alias("adjacent_active"), F.count_if(on & ~F.coalesce(F.col("_before") > 0, F.lit(False))).alias("runs"))
    return got.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("adjacent_active", "runs")))).alias("m")).select(*keys, "m.metric", "m.value")


def clustering_null(rows: DataFrame, permutations: int, seed: int = 1) -> DataFrame:
    """Runs and active neighbours of all books against each book's values in shuffled order (population SD)."""
    rows = rows.select("book", "i", "value")
    seen = _clustering(rows.withColumn("_all", F.lit(0)), ["_all"]).select("metric", F.col("value").alias("observed"))
    null = _clustering(N.shuffled(rows, "value", permutations, seed, ("book",), "i"), ["perm_id"])
    return S.null_summary(null, seen, ["metric"], sd="population")


def within_segment_null(pos: DataFrame, bins: int, permutations: int, seed: int = 1) -> DataFrame:
    """Mean of the last bin minus that of the first against values shuffled inside their segments."""
    contrast = lambda df, keys: df.groupBy(*keys).agg((F.avg(F.when(F.col("bin") == bins - 1, F.col("v"))) - F.avg(F.when(F.col("bin") == 0, F.col("v")))).alias("value"))
    seen = contrast(pos.withColumn("metric", F.lit("terminal_contrast")), ["metric"]).withColumnRenamed("value", "observed")
    dealt = N.shuffled(pos, "v", permutations, seed, ("book", "segment"), "i").join(pos.select("book", "segment", "i", "bin"), ["book", "segment", "i"])
    null = contrast(dealt.withColumn("metric", F.lit("terminal_contrast")), ["perm_id", "metric"])
    return S.null_summary(null, seen, ["metric"], sd="population")


def allocation_draws(rows: DataFrame, level: str, permutations: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Share of a book's segments with an active position: (perm_id, book, value, segments) with as many positions dealt over the
    book at random, and (book, observed, segments)."""
    segment = F.col(f"{level}_id")
    base = rows.select("book", "i", F.struct(segment.alias("segment"), (F.col("value") > 0).alias("on")).alias("value"))
    hits = lambda pairs: F.size(F.array_distinct(F.transform(pairs, lambda x: x["v"]["segment"]))).cast("long")
    on = lambda pairs: F.filter(pairs, lambda x: x["v"]["on"])
    books = N.listed(base, "value", ("book",), "i").select("book", "_rows", hits(F.col("_rows")).alias("segments"), F.size(on(F.col("_rows"))).alias("active"))
    seen = books.select("book", (hits(on(F.col("_rows"))).cast("double") / F.col("segments")).alias("observed"), "segments")
    taken = F.slice(N.drawn(seed), F.lit(1), F.col("active"))
    dealt = N.repeated(books, permutations).select("perm_id", "book", (hits(taken).cast("double") / F.col("segments")).alias("value"), "segments")
    return dealt, seen


def allocation_null(rows: DataFrame, level: str, permutations: int, seed: int = 1) -> DataFrame:
    """Each book's share of segments with an active position against the same share of positions dealt anew."""
    dealt, seen = allocation_draws(rows, level, permutations, seed)
    return S.null_summary(dealt.drop("segments"), seen.drop("segments"), ["book"])
