"""Boundary reconstruction: naive-Bayes ranking of hidden boundaries from geometry and neighbouring symbols, cross-validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import nulls as N

FEATURE_SETS = ("structure", "adjacent_only", "structure_local")


class Reconstruction:
    """One task: ``stream`` (book, pos, sym), symbols that close a unit, and the symbols to find inside units."""

    def __init__(self, stream: DataFrame, major: tuple[str, ...], hidden: tuple[str, ...], folds: int = 5, seed: int = 1, smoothing: float = 1.0):
        self.stream, self.major, self.hidden, self.k, self.seed, self.alpha = stream, major, hidden, folds, seed, smoothing

    def candidates(self) -> DataFrame:
        """Places that may be hidden boundaries: not major, and not at a unit's edge."""
        by = Window.partitionBy("book").orderBy("pos")
        closes = F.col("sym").isin(*self.major)
        rows = self.stream.withColumn("unit", F.coalesce(F.sum(closes.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        unit = Window.partitionBy("book", "unit")
        rows = rows.withColumn("off", (F.row_number().over(unit.orderBy("pos")) - 1).cast("long")).withColumn("len", F.count("*").over(unit))
        rows = rows.withColumn("prev", F.coalesce(F.lag("sym").over(by), F.lit("START"))).withColumn("nxt", F.coalesce(F.lead("sym").over(by), F.lit("END")))
        rows = rows.where(~closes & (F.col("off") > 0) & (F.col("off") < F.col("len") - 1))
        return rows.select("book", "unit", "pos", "prev", "nxt", "off", "len", F.col("sym").isin(*self.hidden).alias("gold"))

    def features(self) -> DataFrame:
        """One row per candidate and feature set."""
        capped = lambda name, x, most: F.concat(F.lit(f"{name}="), F.least(x, F.lit(most)).cast("string"))
        off, size = F.col("off"), F.col("len")
        structure = F.array(capped("pos", off, 8), capped("left", size - 1 - off, 8), capped("len", size, 12), F.concat(F.lit("half="), F.when(off * 2 < size, "first").otherwise("second")))
        adjacent = F.array(F.concat(F.lit("prev="), "prev"), F.concat(F.lit("next="), "nxt"), F.concat(F.lit("pair="), "prev", F.lit(">"), "nxt"))
        sets = F.array(*(F.struct(F.lit(name).alias("fset"), x.alias("features")) for name, x in zip(FEATURE_SETS, (structure, adjacent, F.concat(structure, adjacent)))))
        return self.candidates().select("book", "unit", "pos", "gold", F.explode(sets).alias("s")).select("book", "unit", "pos", "gold", "s.fset", "s.features")

    def folds(self) -> DataFrame:
        """(book, unit, fold): units dealt round in draw order. One row per unit, so one sort of small rows."""
        units = self.candidates().select("book", "unit").distinct()
        place = F.row_number().over(Window.orderBy(N.draw_key(self.seed, "book", "unit"), "book", "unit"))
        return units.select("book", "unit", ((place - 1) % self.k).cast("long").alias("fold"))

    def _rows(self) -> DataFrame:
        return self.features().join(self.folds(), ["book", "unit"])

    def _counts(self, rows: DataFrame) -> DataFrame:
        flat = rows.select("fset", "fold", "gold", F.explode("features").alias("feature"))
        return flat.groupBy("fset", "fold", "feature").agg(F.count_if("gold").alias("p"), F.count_if(~F.col("gold")).alias("q"))

    def scores(self) -> DataFrame:
        """Log odds of each candidate under a model of the other folds; a fold's own counts are subtracted from all."""
        rows, a = self._rows(), self.alpha
        counts = self._counts(rows)
        whole = counts.groupBy("fset", "feature").agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
        folds = rows.groupBy("fset", "fold").agg(F.count_if("gold").alias("own_p"), F.count_if(~F.col("gold")).alias("own_q"))
        every = Window.partitionBy("fset")
        prior = folds.select("fset", "fold", (F.sum("own_p").over(every) - F.col("own_p")).alias("np"), (F.sum("own_q").over(every) - F.col("own_q")).alias("nq"))
        grid = whole.join(F.broadcast(prior.select("fset", "fold")), "fset").join(counts, ["fset", "fold", "feature"], "left")
        train = grid.select("fset", "fold", "feature", (F.col("all_p") - F.coalesce("p", F.lit(0))).alias("p"), (F.col("all_q") - F.coalesce("q", F.lit(0))).alias("q"))
        total = train.groupBy("fset", "fold").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.count_if(F.col("p") + F.col("q") > 0).alias("vocab"))
        flat = rows.select("fset", "fold", "book", "pos", "gold", F.explode("features").alias("feature"))
        flat = flat.join(train, ["fset", "fold", "feature"], "left").join(F.broadcast(total), ["fset", "fold"]).join(F.broadcast(prior), ["fset", "fold"])
        term = F.log((F.coalesce("p", F.lit(0)) + a) / (F.col("sp") + a * F.greatest(F.lit(1), "vocab"))) - F.log((F.coalesce("q", F.lit(0)) + a) / (F.col("sq") + a * F.greatest(F.lit(1), "vocab")))
        n = F.col("np") + F.col("nq") + 2 * a
        odds = F.log((F.col("np") + a) / n) - F.log((F.col("nq") + a) / n)
        return flat.groupBy("fset", "fold", "book", "pos", "gold").agg(F.round(F.first(odds) + F.sum(term), 6).alias("score"))

    def predictions(self) -> DataFrame:
        """As many candidates of a fold are predicted as it has boundaries."""
        by = Window.partitionBy("fset", "fold")
        rank = F.row_number().over(by.orderBy(F.desc("score"), "book", "pos"))
        return self.scores().withColumn("rk", rank).withColumn("k", F.sum(F.col("gold").cast("int")).over(by)).withColumn("predicted", F.col("rk") <= F.col("k"))

    def summary(self) -> DataFrame:
        hit = F.count_if(F.col("predicted") & F.col("gold"))
        return self.predictions().groupBy("fset").agg(F.count_if("gold").alias("gold_n"), F.count_if("predicted").alias("predicted"), hit.alias("hits"), S.rounded(S.ratio(hit, F.count_if("gold"))).alias("f1"))

    def wide(self) -> DataFrame:
        rows = self.predictions().groupBy("book", "pos", "gold").pivot("fset", list(FEATURE_SETS)).agg(F.max("score").alias("score"), F.max(F.col("predicted").cast("int")).alias("predicted"))
        return rows.select("book", "pos", "gold", *(F.col(f"{x}_{c}").alias(f"{c}_{x}") for x in FEATURE_SETS for c in ("score", "predicted")))

    def weights(self, most: int) -> DataFrame:
        """Features that speak most for and against a boundary; one that does both counts as for."""
        a, by = self.alpha, Window.partitionBy("fset")
        whole = self._counts(self._rows()).groupBy("fset", "feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        share = lambda c: F.log((F.col(c) + a) / (F.sum(c).over(by) + a * F.count("*").over(by)))
        w = whole.withColumn("weight", F.round(share("p") - share("q"), 6))
        w = w.withColumn("up", F.row_number().over(by.orderBy(F.desc("weight"), "feature"))).withColumn("down", F.row_number().over(by.orderBy("weight", "feature")))
        return w.where((F.col("up") <= most) | (F.col("down") <= most)).select("fset", "feature", "p", "q", "weight", F.when(F.col("up") <= most, "positive").otherwise("negative").alias("side"))

    def random_null(self, permutations: int) -> DataFrame:
        """Hits of the fullest feature set against random picks of as many candidates in each fold."""
        made = self.predictions()
        seen = made.where("fset = 'structure_local'").groupBy("fset").agg(F.count_if(F.col("predicted") & F.col("gold")).alias("observed"))
        many = N.repeated(made.where("fset = 'structure_local'").select("fset", "fold", "book", "pos", "gold", "k"), permutations)
        rank = F.row_number().over(Window.partitionBy("perm_id", "fold").orderBy(N.draw_key(self.seed, "perm_id", "fold", "book", "pos"), "book", "pos"))
        null = many.withColumn("rk", rank).groupBy("fset", "perm_id").agg(F.count_if((F.col("rk") <= F.col("k")) & F.col("gold")).alias("value"))
        return S.null_summary(null, seen, ["fset"], undefined_z=0.0)

    def signflip(self, one: str, two: str, permutations: int) -> DataFrame:
        """Difference in hits of two feature sets, against random signs of each unit's difference."""
        units = self.candidates().select("book", "pos", "unit")
        hits = self.predictions().where(F.col("gold") & F.col("predicted") & F.col("fset").isin(one, two)).join(units, ["book", "pos"])
        diff = hits.groupBy("book", "unit").agg(F.sum(F.when(F.col("fset") == one, 1).otherwise(-1)).alias("d"))
        seen = diff.groupBy(F.lit("difference").alias("metric")).agg(F.sum("d").alias("observed"))
        many = N.repeated(diff, permutations)
        even = F.substring(N.draw_key(self.seed, "perm_id", "book", "unit"), 1, 1).isin(*"02468ace")
        null = many.groupBy(F.lit("difference").alias("metric"), "perm_id").agg(F.sum(F.when(even, F.col("d")).otherwise(-F.col("d"))).alias("value"))
        return S.null_summary(null, seen, ["metric"], undefined_z=0.0)
