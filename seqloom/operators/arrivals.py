"""Arrivals of sound patterns in a sliding window, bursts of them, and where bursts end in the segment hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import nulls as N


LEVELS = ("verse", "major", "minor")


def _by(keys: tuple[str, ...] = ("book",)):
    return Window.partitionBy(*keys).orderBy("i")


def arrivals(stream: DataFrame, window: int = 20, exclude_exact: bool = False, match: str = "all", exclude_extended: bool = False, keys: tuple[str, ...] = ("book",), others: bool = False) -> DataFrame:
    """``stream`` (keys, i, pk, bk, exact, extended) from position ``window`` on, with full, bridge, same_word, value and, where
    asked for, other: full and bridge links of words that are not the same.

    Each row also has its neighbours' segment ids in the whole stream (verse_before, verse_after and so on).
    """
    before = F.collect_list(F.struct("pk", "bk", "exact", "extended")).over(_by(keys).rowsBetween(-window, -1))
    edges = {f"{x}_{side}": f(f"{x}_id").over(_by(keys)) for x in LEVELS if f"{x}_id" in stream.columns for side, f in (("before", F.lag), ("after", F.lead))}
    rows = stream.withColumns({"_before": before, **edges}).where(F.col("i") >= window)
    allowed = lambda x: (~F.lit(exclude_exact) | (x["exact"] != F.col("exact"))) & (~F.lit(exclude_extended) | ~(x["extended"] | F.col("extended")))
    same = lambda x: x["pk"] == F.col("pk")
    crossed = lambda x: F.coalesce(x["pk"] == F.col("bk"), F.lit(False)) | F.coalesce(x["bk"] == F.col("pk"), F.lit(False))
    full = F.size(F.filter("_before", lambda x: allowed(x) & same(x))).cast("long")
    bridge = F.size(F.filter("_before", lambda x: allowed(x) & ~same(x) & crossed(x))).cast("long")
    exact = F.size(F.filter("_before", lambda x: x["exact"] == F.col("exact"))).cast("long")
    more = {"other": F.size(F.filter("_before", lambda x: (x["exact"] != F.col("exact")) & (same(x) | crossed(x)))).cast("long")} if others else {}
    rows = rows.withColumns({"full": full, "bridge": bridge, "same_word": exact, **more}).drop("_before")
    return rows.withColumn("value", {"all": F.col("full") + F.col("bridge"), "full": F.col("full"), "bridge": F.col("bridge")}[match])


def thresholded(rows: DataFrame, least: int) -> DataFrame:
    return rows.withColumn("value", F.when(F.col("value") >= least, F.col("value")).otherwise(0))


def runs(rows: DataFrame) -> DataFrame:
    """Maximal stretches of positive values: book, run_id, start, end, length, intensity."""
    on = F.col("value") > 0
    begins = on & ~F.coalesce(F.lag(on).over(_by()), F.lit(False))
    numbered = rows.select("book", "i", "value", F.sum(begins.cast("long")).over(_by()).alias("run_id")).where("value > 0")
    return numbered.groupBy("book", "run_id").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("length"), F.sum("value").alias("intensity"))


def temporal_metrics(rows: DataFrame) -> DataFrame:
    """Mean, population variance, active rate, lag-1 correlation and run statistics of each book's stream."""
    lagged = rows.withColumn("next", F.lead("value").over(_by()))
    both = (F.col("value") > 0) & (F.col("next") > 0)
    base = lagged.groupBy("book").agg(
        F.count("*").alias("positions"), S.rounded(F.avg("value")).alias("mean"), S.rounded(F.var_pop("value")).alias("variance"), S.rounded(F.avg((F.col("value") > 0).cast("double"))).alias("active_rate"),
        S.rounded(S.pearson("value", "next")).alias("lag1"), F.count_if(both).alias("adjacent_active"),
    )
    r = runs(rows).groupBy("book").agg(F.count("*").alias("runs"), F.max("length").alias("longest"), S.rounded(F.avg("length")).alias("mean_length"), F.max("intensity").alias("strongest"))
    return base.join(r, "book", "left").na.fill(0, ["runs", "longest", "strongest", "mean_length"])


def fano(rows: DataFrame, width: int) -> DataFrame:
    """Variance over mean of the sums of whole windows that do not overlap."""
    first = F.min("i").over(Window.partitionBy("book"))
    sums = rows.withColumn("w", F.floor((F.col("i") - first) / width)).groupBy("book", "w").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where(F.col("n") == width)
    return sums.groupBy("book").agg(F.count("*").alias("windows"), S.rounded(S.ratio(F.var_pop("total"), F.avg("total"))).alias("fano"))


def boundary_metrics(rows: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """For each book and level the shares of runs that lie in one segment, end at its end, or start after another's end.

    Neighbours are those of the whole stream, also before its first eligible position. A book without runs has shares of 0.
    """
    on = F.col("value") > 0
    begins = on & ~F.coalesce(F.lag(on).over(_by()), F.lit(False))
    r = rows.withColumn("run_id", F.sum(begins.cast("long")).over(_by()))
    edges = [x for l in levels for x in (F.min_by(f"{l}_id", "i").alias(f"{l}_a"), F.max_by(f"{l}_id", "i").alias(f"{l}_z"), F.min_by(f"{l}_before", "i").alias(f"{l}_b"), F.max_by(f"{l}_after", "i").alias(f"{l}_n"))]
    # run 0 takes a book's other positions, so that a book without runs is seen too
    r = r.groupBy("book", F.when(on, F.col("run_id")).otherwise(0).alias("run_id")).agg(*edges)
    parts = [F.struct(F.lit(l).alias("level"), (F.col(f"{l}_a") == F.col(f"{l}_z")).alias("inside"), (F.col(f"{l}_n") != F.col(f"{l}_z")).alias("ends"), (F.col(f"{l}_b") != F.col(f"{l}_a")).alias("starts")) for l in levels]
    run = F.col("run_id") > 0
    long = r.select("book", "run_id", F.explode(F.array(*parts)).alias("p")).select("book", "run_id", "p.*")
    share = lambda c: F.avg(F.when(run, F.coalesce(F.col(c), F.lit(False)).cast("double"))).alias(c)
    got = long.groupBy("book", "level").agg(F.count_if(run).alias("runs"), share("inside"), share("ends"), share("starts"))
    return got.select("book", "level", "runs", *(S.rounded(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("inside", "ends", "starts")))


def edge_censored(rows: DataFrame) -> DataFrame:
    """Values of a run that touches the stream's first or last position become 0; one pass over each book, no join."""
    on, whole = F.col("value") > 0, Window.partitionBy("book").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = on & ~F.coalesce(F.lag(on).over(_by()), F.lit(False))
    runs_of = rows.withColumns({"_run": F.sum(begins.cast("long")).over(_by()), "_first": F.first(on).over(whole), "_last": F.last(on).over(whole)})
    runs_of = runs_of.withColumn("_runs", F.max("_run").over(whole))
    edge = on & ((F.col("_first") & (F.col("_run") == 1)) | (F.col("_last") & (F.col("_run") == F.col("_runs"))))
    return runs_of.withColumn("value", F.when(edge, F.lit(0)).otherwise(F.col("value"))).drop("_run", "_first", "_last", "_runs")


def blocks(rows: DataFrame, size: int, least: float = 0.5) -> DataFrame:
    """Fixed blocks of each book's positions; the last counts if it is at least ``least`` full."""
    first = F.min("i").over(Window.partitionBy("book"))
    b = rows.withColumn("block", F.floor((F.col("i") - first) / size) + 1)
    got = b.groupBy("book", "block").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("length"), F.sum("value").alias("arrivals"), F.count_if(F.col("value") > 0).alias("active"))
    return got.withColumn("included", F.col("length") >= F.ceil(F.lit(size * least)))


def lexical_classes(rows: DataFrame, different: DataFrame, least: int = 1) -> DataFrame:
    """Positions and links by what a position holds ``least`` times: nothing, the same word, other words, both, or both only
    taken together. ``different`` are the same positions without links of equal words; more of those than of all is an error.
    """
    return lexical_kinds(rows.select("book", "i", "value").join(different.select("book", "i", F.col("value").alias("other")), ["book", "i"]), least)


def lexical_kinds(two: DataFrame, least: int = 1) -> DataFrame:
    """``lexical_classes`` of positions that have ``other`` beside their value."""
    same = F.when(F.col("value") < F.col("other"), F.raise_error(F.lit("more links of other words than of all"))).otherwise(F.col("value") - F.col("other"))
    two = two.withColumn("same", same.cast("long"))
    kind = F.when(F.col("value") < least, "inactive").when((F.col("same") >= least) & (F.col("other") >= least), "mixed").when(F.col("same") >= least, "exact_only").when(F.col("other") >= least, "different_word_only")
    return two.groupBy(kind.otherwise("combined_only_at_threshold").alias("kind")).agg(F.count("*").alias("positions"), F.sum("value").alias("links"), F.sum("same").alias("exact_links"), F.sum("other").alias("different_links"))


def enrichment_null(stream: DataFrame, window: int, permutations: int, seed: int = 1) -> DataFrame:
    """Mean arrivals and active rate of each book against its stressed words in shuffled order (population SD)."""

    def means(rows, keys):
        got = rows.groupBy(*keys).agg(F.avg("value").alias("mean_arrivals"), F.avg((F.col("value") > 0).cast("double")).alias("active_rate"))
        return got.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean_arrivals", "active_rate")))).alias("m")).select(*keys, "m.*")

    words = stream.select("book", "i", F.struct("pk", "bk", "exact", "extended").alias("word"))
    seen = means(arrivals(words.select("book", "i", "word.*"), window), ["book"]).withColumnRenamed("value", "observed")
    dealt = N.shuffled(words, "word", permutations, seed, ("book",), "i").select("perm_id", "book", "i", "word.*")
    null = means(arrivals(dealt, window, keys=("perm_id", "book")), ["perm_id", "book"])
    return S.null_summary(null, seen, ["book", "metric"], sd="population")


def coverage(rows: DataFrame, level: str = "verse") -> DataFrame:
    """For each book active positions, burst ends, and the share of its segments that hold an active position."""
    on, segment = F.col("value") > 0, F.col(f"{level}_id")
    ends = on & ~F.coalesce(F.lead(on).over(_by()), F.lit(False))
    got = rows.withColumn("_ends", ends).groupBy("book").agg(
        F.count("*").alias("positions"), F.count_if(on).alias("active"), F.count_if("_ends").alias("burst_ends"), F.countDistinct(segment).alias(f"{level}s"), F.countDistinct(F.when(on, segment)).alias(f"active_{level}s")
    )
    return got.select("book", "positions", "active", S.rounded(S.ratio("active", "positions")).alias("active_rate"), "burst_ends", f"{level}s", f"active_{level}s", S.rounded(S.ratio(f"active_{level}s", f"{level}s")).alias(f"{level}_coverage"))


def block_alignment(rows: DataFrame, size: int) -> DataFrame:
    """For each fixed block of a book its burst ends and the shares of them that end a segment; 0 where a block has none."""
    on = F.col("value") > 0
    first = F.min("i").over(Window.partitionBy("book"))
    ends = on & ~F.coalesce(F.lead(on).over(_by()), F.lit(False))
    b = rows.withColumn("block", F.floor((F.col("i") - first) / size) + 1).withColumn("_ends", ends)
    hit = lambda x: F.count_if(F.col("_ends") & (F.col(f"{x}_id") != F.col(f"{x}_after")))
    got = b.groupBy("book", "block").agg(F.count_if("_ends").alias("burst_ends"), *(hit(x).alias(x) for x in ("verse", "major", "minor")))
    return got.select("book", "block", "burst_ends", *(S.rounded(F.coalesce(S.ratio(x, "burst_ends"), F.lit(0.0))).alias(f"{x}_rate") for x in ("verse", "major", "minor")))


def block_left_out(blocks: DataFrame) -> DataFrame:
    """For each block the burst ends of the book's other blocks and the shares of them that end a segment."""
    book = Window.partitionBy("book")
    others = F.sum("burst_ends").over(book) - F.col("burst_ends")
    hits = lambda x: F.round(F.col(f"{x}_rate") * F.col("burst_ends"))
    rate = lambda x: S.rounded(F.coalesce(S.ratio(F.sum(hits(x)).over(book) - hits(x), others), F.lit(0.0)))
    return blocks.select("book", "block", others.alias("burst_ends"), *(rate(x).alias(f"{x}_rate") for x in ("verse", "major", "minor")))
