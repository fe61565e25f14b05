"""Positional profiles: how a value runs from the start to the end of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def inventory(rows: DataFrame, level: str, least: int = 3, most: int = 40) -> DataFrame:
    """(book, segment): length and why it is left out, if it is.

    A segment is cut where the word before its first, or after its last position here belongs to it too.
    """
    seg = rows.groupBy("book", F.col(f"{level}_id").alias("segment")).agg(F.count("*").alias("length"), F.min("i").alias("first"), F.max("i").alias("last"), F.min_by(f"{level}_before", "i").alias("before"), F.max_by(f"{level}_after", "i").alias("after"))
    cut = lambda c: F.coalesce(F.col(c) == F.col("segment"), F.lit(False))
    reason = F.when(cut("before"), "truncated_by_left_window_edge").when(cut("after"), "truncated_by_corpus_edge").when(F.col("length") < least, "below_minimum_length").when(F.col("length") > most, "above_maximum_length").otherwise("eligible")
    return seg.select("book", "segment", "length", "first", "last", reason.alias("reason"))


def positions(rows: DataFrame, level: str, bins: int, coordinate: str = "normalized", share: bool = False, least: int = 3, most: int = 40) -> DataFrame:
    """(book, segment, bin, v) of eligible segments; v is the value, or its share of the segment's sum."""
    seg = inventory(rows, level, least, most).where("reason = 'eligible'")
    r = rows.withColumn("segment", F.col(f"{level}_id")).join(seg.select("book", "segment", "length", "first"), ["book", "segment"])
    inside = Window.partitionBy("book", "segment")
    r = r.withColumn("rank", F.row_number().over(inside.orderBy("i")) - 1)
    if coordinate == "normalized":
        place = F.least(F.lit(bins - 1), F.floor((F.col("rank") + 0.5) / F.col("length") * bins))
    else:
        place = F.lit(bins - 1) - (F.col("length") - 1 - F.col("rank"))
    value = S.ratio("value", F.sum("value").over(inside)) if share else F.col("value").cast("double")
    return r.select("book", "segment", "i", place.cast("long").alias("bin"), value.alias("v"), (F.col("value") > 0).alias("active")).where("bin >= 0")


def profile(pos: DataFrame, pooled: bool = False) -> DataFrame:
    """Mean value and active rate by bin: of all positions, or of segments' means."""
    if pooled:
        return pos.groupBy("bin").agg(F.count("*").alias("n"), S.rounded(F.avg("v")).alias("mean"), S.rounded(F.avg(F.col("active").cast("double"))).alias("active_rate"))
    one = pos.groupBy("book", "segment", "bin").agg(F.avg("v").alias("v"), F.avg(F.col("active").cast("double")).alias("a"))
    return one.groupBy("bin").agg(F.count("v").alias("n"), S.rounded(F.avg("v")).alias("mean"), S.rounded(F.avg("a")).alias("active_rate"))


def metrics(prof: DataFrame) -> DataFrame:
    """Terminal contrast, slope over (i + 0.5) / n, last bin over the mean of the others, energy relative to the squared mean, amplitude.

    ``prof`` has one row per bin; bins without a mean do not count. Null where fewer than two bins have one.
    """
    rows = F.sort_array(F.collect_list(F.when(F.col("mean").isNotNull(), F.struct("bin", "mean"))))
    v = prof.agg(F.transform(rows, lambda x: x["mean"]).alias("v")).withColumn("n", F.size("v")).withColumn("sum", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    v = v.withColumn("avg", F.col("sum") / F.nullif(F.col("n"), F.lit(0))).withColumn("last", F.get("v", F.col("n") - 1))
    place = lambda i: (i + 0.5) / F.col("n") - 0.5
    cross = F.aggregate(F.transform("v", lambda x, i: place(i) * (x - F.col("avg"))), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(F.transform("v", lambda x, i: place(i) * place(i)), F.lit(0.0), lambda a, x: a + x)
    energy = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("avg")) * (x - F.col("avg"))) / F.col("n")
    energy = F.when(F.abs("avg") > 1e-15, energy / (F.col("avg") * F.col("avg"))).otherwise(energy)
    two = lambda x: S.rounded(F.when(F.col("n") >= 2, x), 6)
    return v.select(
        F.col("n").cast("long").alias("bins"), two(F.col("last") - F.get("v", F.lit(0))).alias("terminal_contrast"), two(cross / spread).alias("linear_slope"),
        two(F.col("last") - (F.col("sum") - F.col("last")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("cadence_peak"), two(energy).alias("profile_energy"), two(F.array_max("v") - F.array_min("v")).alias("profile_amplitude"),
    )
