"""Segments at nested levels, what they hold, and how children fill their parents. Rows are words with level ids and pulses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S

LEVELS = ("verse", "major", "minor")
RELATIONS = (("verse", "major"), ("major", "minor"), ("verse", "minor"))


def segments(rows: DataFrame) -> DataFrame:
    """(book, level, segment): words, pulses, accents, first and last position, and whether its end is marked."""
    long = rows.select("book", "pos", "pulses", F.col("accent").isNotNull().alias("accented"), F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(f"{x}_id").alias("segment"), F.col(f"ends_{x}").alias("ends")) for x in LEVELS))).alias("l"))
    return long.groupBy("book", "l.level", "l.segment").agg(
        F.count("*").alias("words"), F.sum("pulses").alias("pulses"), F.count_if("accented").alias("accents"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("l.ends").alias("complete")
    )


def complete(seg: DataFrame) -> DataFrame:
    """Segments whose end is marked; a trailing rest of a book is none of them, and no statistic counts it."""
    return seg.where("complete")


def relations(rows: DataFrame) -> DataFrame:
    """(book, relation, parent): number of children and their sizes in order. The parent of a child is that of its words.

    Parents and children whose end is not marked are left out.
    """
    child = _related(rows).groupBy("book", "relation", "parent", "child").agg(F.sum("n").alias("words"), F.max("whole").alias("whole"), F.max("ends").alias("ends"))
    child = child.withColumn("closed", F.max("ends").over(Window.partitionBy("book", "relation", "parent"))).where("whole and closed")
    return child.groupBy("book", "relation", "parent").agg(
        F.count("*").alias("children"), F.sum("words").alias("words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("child", "words"))), lambda x: x["words"].cast("string")), "-").alias("sizes")
    )


def _related(rows: DataFrame) -> DataFrame:
    """(book, relation, parent, child, n, pulses, whole, ends): words that share all three segments, once for each relation, with
    whether the child's and the parent's end is marked at one of them. All relations come from one reading of the words."""
    ids = [f"{x}_id" for x in LEVELS]
    pulses = F.sum("pulses") if "pulses" in rows.columns else F.lit(None).cast("long")
    cells = rows.groupBy("book", *ids).agg(F.count("*").alias("n"), pulses.alias("pulses"), *(F.max(f"ends_{x}").alias(f"ends_{x}") for x in LEVELS))
    each = F.array(*(F.struct(F.lit(f"{u}>{d}").alias("relation"), F.col(f"{u}_id").alias("parent"), F.col(f"{d}_id").alias("child"), F.col(f"ends_{d}").alias("whole"), F.col(f"ends_{u}").alias("ends")) for u, d in RELATIONS))
    return cells.select("book", "n", "pulses", F.explode(each).alias("r")).select("book", "r.relation", "r.parent", "r.child", "n", "pulses", "r.whole", "r.ends")


def validation(rows: DataFrame) -> DataFrame:
    """Whether each parent's words and pulses are those of its children."""
    kids = _related(rows).groupBy("book", "relation", "parent", "child").agg(F.sum("n").alias("n"), F.sum("pulses").alias("pulses"), F.max("whole").alias("whole"), F.max("ends").alias("ends"))
    child = Window.partitionBy("book", "relation", "child")
    kids = kids.withColumns({"w": F.sum("n").over(child), "p": F.sum("pulses").over(child), "all": F.max("whole").over(child)})
    own = kids.groupBy("book", "relation", "parent").agg(F.sum("n").alias("words"), F.sum("pulses").alias("pulses"), F.max("ends").alias("ends"), F.sum(F.when(F.col("all"), F.col("w"))).alias("w"), F.sum(F.when(F.col("all"), F.col("p"))).alias("p"))
    fine = F.coalesce((F.col("w") == F.col("words")) & (F.col("p") == F.col("pulses")), F.lit(False))
    return own.where("ends").groupBy("relation").agg(F.count("*").alias("parents"), F.count_if(fine).alias("exact"))


def level_summary(seg: DataFrame) -> DataFrame:
    long = complete(seg).select("level", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("x")) for f in ("words", "pulses", "accents")))).alias("v")).select("level", "v.*")
    return long.groupBy("level", "field").agg(
        F.count("*").alias("n"), F.countDistinct("x").alias("kinds"), S.rounded(F.avg("x")).alias("mean"), S.rounded(F.stddev_samp("x"), 6).alias("sd"), S.rounded(F.percentile("x", F.lit(0.5))).alias("median"), F.min("x").alias("least"), F.max("x").alias("most")
    )


def relation_summary(rel: DataFrame) -> DataFrame:
    share = lambda c: S.rounded(S.ratio(F.count_if(c), F.count("*")))
    k = F.col("children")
    return rel.groupBy("relation").agg(F.count("*").alias("parents"), S.rounded(F.avg(k)).alias("mean_children"), share(k == 1).alias("share_1"), share(k == 2).alias("share_2"), share(k == 3).alias("share_3"), F.countDistinct("sizes").alias("shapes"))


def frequency(values: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """Counts of values, those above ``most`` together, with shares and cumulative shares in order of value."""
    bucket = F.least(F.col(value), F.lit(most + 1)).cast("long")
    n = values.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("bucket") > most, f">{most}").otherwise(F.col("bucket").cast("string"))
    return n.select(*by, label.alias("label"), "n", S.rounded(S.ratio("n", F.sum("n").over(whole))).alias("share"), S.rounded(S.ratio(F.sum("n").over(running), F.sum("n").over(whole))).alias("cumulative"))


def bucket(name: str, x, most: int):
    """Label of a count, those from ``most`` on together."""
    return F.when(x >= most, f"{name}{most}+").otherwise(F.concat(F.lit(name), x.cast("string")))


def shapes(seg: DataFrame) -> DataFrame:
    """Shape strings of complete segments by level with count, rank (ties: first seen) and cumulative share."""
    named = complete(seg).select("level", "book", "segment", F.concat_ws(" ", bucket("W", F.col("words"), 9), bucket("P", F.col("pulses"), 17), bucket("A", F.col("accents"), 4)).alias("shape"))
    n = named.groupBy("level", "shape").agg(F.count("*").alias("n"), F.min(F.struct("book", "segment")).alias("first"))
    whole = Window.partitionBy("level")
    order = whole.orderBy(F.desc("n"), "first")
    out = n.withColumn("rank", F.row_number().over(order).cast("long"))
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.select("level", "shape", "n", "rank", S.rounded(S.ratio("n", F.sum("n").over(whole))).alias("share"), S.rounded(S.ratio(running, F.sum("n").over(whole))).alias("cumulative"))


def shape_summary(seg: DataFrame) -> DataFrame:
    """Entropy of the shapes of a level (normalised by the log of their number) and shares of the commonest."""
    freq = shapes(seg)
    ent = S.entropy(freq, ["level"], base=None).select("level", "kinds", S.rounded("normalized_entropy", 6).alias("normalized_entropy"))
    tops = freq.groupBy("level").agg(*(S.rounded(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{k}") for k in (1, 3, 5, 10, 20)))
    return ent.join(tops, "level")


def size_ngrams(seg: DataFrame, k: int, most: int) -> DataFrame:
    """Commonest runs of ``k`` sizes of complete segments inside books; ties go to the run seen first."""
    by = Window.partitionBy("book", "level").orderBy("segment")
    grams = complete(seg).select("level", "book", "segment", *(F.lead("words", i).over(by).alias(f"g{i}") for i in range(k))).where(F.col(f"g{k - 1}").isNotNull())
    n = grams.groupBy("level", F.concat_ws("-", *(F.col(f"g{i}").cast("string") for i in range(k))).alias("gram")).agg(F.count("*").alias("n"), F.min(F.struct("book", "segment")).alias("first"))
    return S.ranked(n, ["level"], F.desc("n"), F.col("first")).where(F.col("rank") <= most).drop("first")
