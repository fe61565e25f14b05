"""First-order prediction of symbols: conditional entropy, next-symbol accuracy in and out of sample, transition nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import nulls as N
from . import grammar as G


def conditional_entropy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """H(next | previous) in bits of (keys, a, b) rows."""
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    counts = counts.withColumn("n_a", F.sum("n").over(Window.partitionBy(*keys, "a"))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return counts.groupBy(*keys).agg(F.sum(-F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("n_a"))).alias("value"))


def accuracy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pairs whose next symbol is the commonest after the previous one."""
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys, "a").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.groupBy(*keys).agg((F.sum("best").cast("double") / F.sum("n")).alias("value"))


def split_accuracy(stream: DataFrame, share: float = 0.8, kind: str = "chronological", seed: int = 1) -> DataFrame:
    """Accuracy on held-out pairs of the commonest next symbol in the others; symbols never seen get the commonest of all.

    Ties go to the symbol that the training pairs hold first. At least one pair is learnt from; a lone pair is its own test.
    """
    pairs = G.bigrams(stream)
    order = [F.col("pos")] if kind == "chronological" else [N.draw_key(seed, "book", "pos"), F.col("pos")]
    by = Window.partitionBy("book")
    pairs = pairs.withColumn("place", F.row_number().over(by.orderBy(*order))).withColumn("n", F.count("*").over(by))
    last = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    train, test = pairs.where(F.col("place") <= last), pairs.where((F.col("place") > last) | (F.col("n") == 1))
    seen = (F.count("*").alias("n"), F.min("place").alias("first"))
    model = S.ranked(train.groupBy("book", "a", "b").agg(*seen), ["book", "a"], F.desc("n"), F.col("first")).where("rank = 1").select("book", "a", F.col("b").alias("guess"))
    common = S.ranked(train.groupBy("book", "b").agg(*seen), ["book"], F.desc("n"), F.col("first")).where("rank = 1").select("book", F.col("b").alias("default"))
    scored = test.join(model, ["book", "a"], "left").join(common, "book", "left")
    hit = F.coalesce(F.coalesce("guess", "default") == F.col("b"), F.lit(False))
    return scored.groupBy("book").agg(F.count("*").alias("tested"), F.count_if(hit).alias("hits"), S.rounded(F.avg(hit.cast("double"))).alias("accuracy"))


def transition_test(stream: DataFrame, permutations: int, seed: int = 1) -> DataFrame:
    """Conditional entropy, its reduction of the symbols' own entropy, and in-sample accuracy against shuffled streams."""
    syms = stream.groupBy("book", "sym").agg(F.count("*").alias("n"))
    own = S.entropy(syms, ["book"]).select("book", F.col("entropy").alias("own"))
    counts = G.dealt_pairs(stream, permutations, seed).groupBy("perm_id", "book", "a", "b").agg(F.count("*").alias("n"))
    keys = ["perm_id", "book"]
    counts = counts.withColumn("n_a", F.sum("n").over(Window.partitionBy(*keys, "a"))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    term = -F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("n_a"))
    by_a = counts.groupBy(*keys, "a").agg(F.sum(term).alias("term"), F.max("n").alias("best"), F.sum("n").alias("n"))
    got = by_a.groupBy(*keys).agg(F.sum("term").alias("left"), (F.sum("best").cast("double") / F.sum("n")).alias("accuracy"))
    got = got.join(own.hint("shuffle_merge"), "book")
    parts = {"conditional_entropy": F.col("left"), "entropy_reduction": F.col("own") - F.col("left"), "accuracy": F.col("accuracy")}
    long = got.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in parts.items()))).alias("m")).select(*keys, "m.*")
    return S.summarised(G.observed_beside(long, ["book", "metric"]), ["book", "metric"])
