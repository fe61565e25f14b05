"""Column expressions and small aggregations that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 8) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), digits)


def ratio(a, b) -> Column:
    """a / b as a double, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def entropy(counts: DataFrame, by: list[str], n: str = "n", base: float | None = 2) -> DataFrame:
    """entropy (bits, or in ``base`` e where None) and normalised entropy of the counts of each group."""
    total = F.sum(n).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    p = F.col(n).cast("double") / total
    log = F.log2(p) if base == 2 else F.log(p)
    terms = counts.withColumn("_term", -p * log)
    out = terms.groupBy(*by).agg(F.sum("_term").alias("entropy"), F.count("*").alias("kinds"))
    top = F.log2("kinds") if base == 2 else F.log("kinds")
    return out.withColumn("normalized_entropy", F.when(F.col("kinds") > 1, F.col("entropy") / top).otherwise(0.0))


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def null_summary(null: DataFrame, observed: DataFrame, keys: list[str], sd: str = "sample", counts: bool = False, undefined_z: float | None = None) -> DataFrame:
    """Observed values against their null draws (columns keys, perm_id, value / keys, observed).

    ``sd``: "sample" or "population". ``counts`` asks for an SD of 0.5 and three values before a Z is given. ``undefined_z`` is
    given where the SD is 0. p_two_sided is twice the smaller tail, p_distance counts draws as far from their mean. Null draws that are not finite count in ``permutations`` but in nothing else.
    """
    return summarised(null.join(observed, keys), keys, sd, counts, undefined_z)


def summarised(joined: DataFrame, keys: list[str], sd: str = "sample", counts: bool = False, undefined_z: float | None = None) -> DataFrame:
    """``null_summary`` of draws that have ``observed`` beside them already."""
    fine = F.col("value").isNotNull() & ~F.isnan("value")
    spread = F.stddev_samp if sd == "sample" else F.stddev_pop
    value = F.when(fine, F.col("value").cast("double"))
    joined = joined.withColumn("value", F.col("value").cast("double"))
    joined = joined.withColumn("_mid", F.avg(value).over(Window.partitionBy(*keys)))
    far = F.abs(value - F.col("_mid")) >= F.abs(F.col("observed") - F.col("_mid")) - 1e-9
    got = joined.groupBy(*keys).agg(
        F.first("observed").alias("observed"), F.count("*").alias("permutations"), F.avg(value).alias("null_mean"), F.coalesce(spread(value), F.lit(0.0)).alias("null_sd"),
        F.countDistinct(F.round(value, 9)).alias("unique_values"), F.sum((value >= F.col("observed") - 1e-12).cast("int")).alias("at_least"), F.sum((value <= F.col("observed") + 1e-12).cast("int")).alias("at_most"), F.count(value).alias("finite"), F.sum(far.cast("int")).alias("as_far"),
    )
    return presented(got, keys, counts, undefined_z)


def presented(got: DataFrame, keys: list[str], counts: bool = False, undefined_z: float | None = None) -> DataFrame:
    """Z and p values of aggregated draws, rounded."""
    gate = (F.col("null_sd") >= 0.5) & (F.col("unique_values") >= 3) if counts else F.col("null_sd") > 1e-12
    upper, lower = (F.col("at_least") + 1) / (F.col("finite") + 1), (F.col("at_most") + 1) / (F.col("finite") + 1)
    z = F.when(gate, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    if undefined_z is not None:
        z = F.coalesce(z, F.lit(undefined_z))
    return got.select(
        *keys, (rounded("observed") + 0.0).alias("observed"), "permutations", (rounded("null_mean") + 0.0).alias("null_mean"), rounded("null_sd", 6).alias("null_sd"),
        (rounded(z, 6) + 0.0).alias("z"), rounded(upper).alias("p_upper"), rounded(lower).alias("p_lower"), rounded(F.least(F.lit(1.0), 2 * F.least(upper, lower))).alias("p_two_sided"),
        rounded((F.col("as_far") + 1) / (F.col("finite") + 1)).alias("p_distance"),
    )


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; 0 where a side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(spread > 0, F.covar_pop(a, b) / spread).otherwise(0.0)
