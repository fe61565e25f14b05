"""Where bursts end against the same bursts turned round their book: by book, by block, without dense blocks; audits and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import nulls as N
from .arrivals import LEVELS, blocks


def run_ends(rows: DataFrame, size: int) -> DataFrame:
    """For each position of a book: pos (from 0), n (the book's positions), block, whether a run of positive values ends there
    (last) or goes on from the position before (joined), whether runs touch both ends of the book (turned), and for each level
    whether a segment ends there."""
    by = Window.partitionBy("book").orderBy("i")
    on = F.col("value") > 0
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = on & ~F.coalesce(F.lead(on).over(by), F.lit(False))
    flags = [F.coalesce(F.col(f"{x}_id") != F.col(f"{x}_after"), F.lit(False)).alias(x) for x in LEVELS]
    placed = rows.select("book", (F.row_number().over(by) - 1).cast("long").alias("pos"), F.count("*").over(whole).alias("n"), last.alias("last"), (on & F.coalesce(F.lag(on).over(by), F.lit(False))).alias("joined"), (F.first(on).over(whole) & F.last(on).over(whole)).alias("turned"), *flags)
    return placed.withColumn("block", F.floor(F.col("pos") / size) + 1)


def alignment_records(rows: DataFrame, size: int, permutations: int, seed: int = 1) -> DataFrame:
    """(perm_id, book, block, verse, major, minor) of the run ends as they are (perm_id 0) and after each drawn turn of the book.

    Turns part no run, so a run's end only moves: what is dealt anew are run ends, not positions. A book takes all its turns
    where it has no more than ``permutations``.
    """
    cut = (F.col("pos") > 0) & ~F.col("joined") & ~F.col("turned")
    flags = F.transform(F.sort_array(F.collect_list(F.struct("pos", *LEVELS))), lambda x: F.struct(*(x[l].alias(l) for l in LEVELS)))
    books = run_ends(rows, size).groupBy("book").agg(
        F.count("*").alias("n"), flags.alias("flags"), F.collect_list(F.when(F.col("last"), F.col("pos"))).alias("ends"), F.collect_list(F.when(cut, F.col("n") - F.col("pos"))).alias("cuts")
    )
    # turned inside the row of the book: its run ends are looked up by place, and neither turns nor flags are joined
    order = F.slice(F.sort_array(F.transform("cuts", lambda s: F.struct(N.draw_key(seed, "book", s).alias("key"), s.alias("shift")))), 1, permutations)
    turns = F.concat(F.array(F.lit(0).cast("long")), F.transform(order, lambda x: x["shift"]))
    turned = books.where(F.size("ends") > 0).select("book", "n", "flags", "ends", F.posexplode(turns).alias("perm_id", "shift"))
    place = lambda e: ((e + F.col("shift")) % F.col("n"))
    moved = F.transform(F.transform("ends", place), lambda p: F.struct((F.floor(p / size) + 1).alias("block"), F.get("flags", p.cast("int")).alias("f")))
    return turned.select("perm_id", "book", F.explode(moved).alias("e")).select("perm_id", "book", "e.block", "e.f.*")


def _rates(records: DataFrame, keys: list[str]) -> DataFrame:
    """(perm_id, keys, level, hits, ends, value) of alignment records."""
    return _leveled(_counts(records, keys), keys)


def _counts(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy("perm_id", *keys).agg(F.count("*").alias("ends"), *(F.count_if(x).alias(x) for x in LEVELS))


def _leveled(got: DataFrame, keys: list[str]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(x).alias("level"), F.col(x).alias("hits")) for x in LEVELS))
    got = got.select("perm_id", *keys, "ends", F.explode(parts).alias("l")).select("perm_id", *keys, "l.*", "ends")
    return got.withColumn("value", S.ratio("hits", "ends"))


def _against(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Null summary of rows with perm_id 0 as observed against the others."""
    seen = F.max(F.when(F.col("perm_id") == 0, F.col("value"))).over(Window.partitionBy(*keys))
    return S.summarised(rates.select("perm_id", *keys, "value", seen.alias("observed")).where("perm_id > 0 and observed is not null"), keys, sd="population")


def metric_role(family: str, metric: Column) -> Column:
    """Which part a metric plays in its family; an unknown family is an error."""
    if family == "local_rhyme_enrichment":
        return F.when(metric == "mean_arrivals", "primary").otherwise("secondary")
    if family == "burst_clustering":
        return F.when(metric.isin("active_lag1_corr", "fano_w10"), "primary").when(metric == "max_run_length", "descriptive").otherwise("secondary")
    if family == "boundary_alignment":
        return F.when(metric.startswith("run_ends_"), "primary").otherwise("secondary")
    raise ValueError(f"unknown metric family: {family}")


def statistics_rows(summary: DataFrame, family: str, null: str) -> DataFrame:
    """A null summary with a column metric as rows of a long table: family, metric_role and null beside it."""
    return summary.withColumns({"family": F.lit(family), "metric_role": metric_role(family, F.col("metric")), "null": F.lit(null)})


def book_alignment(records: DataFrame) -> DataFrame:
    """For each book and level the share of run ends that end a segment, against the turned book."""
    return _against(_rates(records, ["book"]), ["book", "level"])


def block_support(records: DataFrame, least: int) -> DataFrame:
    """For each book and level, over its blocks with ``least`` run ends or more: the share of blocks above their null mean and the
    median difference, both against the same of each turn. Turns that leave a block without a run end do not count for it."""
    counts, block = _counts(records, ["book", "block"]), Window.partitionBy("book", "block")
    share = lambda x: F.col(x).cast("double") / F.col("ends")
    means = {f"{x}_mean": F.avg(F.when(F.col("perm_id") > 0, share(x))).over(block) for x in LEVELS}
    fit = counts.withColumns({"_own": F.max(F.when(F.col("perm_id") == 0, F.col("ends"))).over(block), **means}).where((F.col("_own") >= least) & F.col(f"{LEVELS[0]}_mean").isNotNull())
    levels = F.array(*(F.struct(F.lit(x).alias("level"), (share(x) - F.col(f"{x}_mean")).alias("apart")) for x in LEVELS))
    apart = fit.select("perm_id", "book", F.explode(levels).alias("l")).select("perm_id", "book", "l.*")
    got = apart.groupBy("perm_id", "book", "level").agg(F.avg((F.col("apart") > 1e-12).cast("double")).alias("positive_share"), F.percentile("apart", F.lit(0.5)).alias("median_difference"))
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("positive_share", "median_difference")))
    return _against(got.select("perm_id", "book", "level", F.explode(parts).alias("m")).select("perm_id", "book", "level", "m.*"), ["book", "level", "metric"])


def direction_audit(alignment: DataFrame) -> DataFrame:
    """For each level how many books lie above their null mean; a difference of 0 is not positive."""
    apart = F.col("observed") - F.col("null_mean")
    got = alignment.groupBy("level").agg(F.count("*").alias("books"), F.count_if(apart > 0).alias("books_positive"), S.rounded(F.percentile(apart, F.lit(0.5)), 6).alias("median_difference"))
    return got.withColumn("positive_share", S.rounded(S.ratio("books_positive", "books")))


def densest(rows: DataFrame, size: int, fractions: tuple[float, ...]) -> DataFrame:
    """(fraction, book, block): the blocks of highest arrival density, ceil(n * fraction) of them, ties by book and block.

    A block's rank is the number of blocks of higher densities, from a table with one row per density, and its place in its own.
    """
    b = blocks(rows, size).where("included").select("book", "block", S.rounded(S.ratio("arrivals", "length"), 9).alias("density"))
    steps = b.groupBy("density").agg(F.count("*").alias("same"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("density")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("density", F.coalesce(F.sum("same").over(above), F.lit(0)).alias("above"), F.sum("same").over(Window.partitionBy(F.lit(1))).alias("n"))
    inside = Window.partitionBy("density").orderBy("book", "block")
    ranked = b.join(steps, "density").withColumn("rank", F.col("above") + F.row_number().over(inside))
    cut = F.explode(F.array(*map(F.lit, fractions))).alias("fraction")
    return ranked.select(cut, "book", "block", "rank", "n").where(F.col("rank") <= F.ceil(F.round(F.col("n") * F.col("fraction"), 9))).select("fraction", "book", "block")


def trimmed(rows: DataFrame, records: DataFrame, size: int, fractions: tuple[float, ...] = (0.0, 0.01, 0.05, 0.1)) -> DataFrame:
    """Pooled shares of run ends that end a segment, without those in the densest blocks, against the turned books."""
    gone = densest(rows, size, tuple(f for f in fractions if f > 0)).groupBy("book", "block").agg(F.collect_set("fraction").alias("gone"))
    counts = _counts(records, ["book", "block"]).join(gone.hint("shuffle_merge"), ["book", "block"], "left")
    left = F.filter(F.array(*map(F.lit, fractions)), lambda f: ~F.coalesce(F.array_contains("gone", f), F.lit(False)))
    got = counts.withColumn("fraction", F.explode(left)).groupBy("perm_id", "fraction").agg(*(F.sum(x).alias(x) for x in ("ends", *LEVELS)))
    return _against(_leveled(got, ["fraction"]), ["fraction", "level"])


def parse_audit(signed: DataFrame) -> DataFrame:
    """For each language: words, those without a signature, markers, segment ends of each level, and those after such words."""
    no = F.col("pk").isNull()
    ends = [x for l in LEVELS for x in (F.count_if(F.col(f"ends_{l}")).alias(f"{l}_ends"), F.count_if(F.col(f"ends_{l}") & no).alias(f"{l}_ends_after_missing"), F.countDistinct(F.when(~no, F.struct("book", f"{l}_id"))).alias(f"{l}_in_stream"))]
    return signed.groupBy("lang").agg(F.count("*").alias("words"), F.count_if(no).alias("missing"), F.sum(F.size("external")).alias("markers"), *ends)


def group_display(members: DataFrame) -> DataFrame:
    """For each key of ``members`` (key, word, n): its most frequent word (of equals the first) and all as "word ×n"."""
    got = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("l"))
    shown = F.transform("l", lambda x: F.when(x["less"] == -1, x["word"]).otherwise(F.concat(x["word"], F.lit(" ×"), (-x["less"]).cast("string"))))
    return got.select("key", F.col("l")[0]["word"].alias("mode"), F.array_join(shown, ", ").alias("display"))


def located(stream: DataFrame, first: int, last: int) -> DataFrame:
    """(book, key, word, n, locations) of the words in verses ``first`` to ``last``, places written v12:w7, both from 1."""
    verse = F.col("verse_id") + 1
    place = F.row_number().over(Window.partitionBy("book", "verse_id").orderBy("pos"))
    rows = stream.withColumn("place", place).where(verse.between(first, last))
    got = rows.groupBy("book", F.col("pk").alias("key"), F.col("exact").alias("word")).agg(F.sort_array(F.collect_list(F.struct(verse.alias("v"), F.col("place").alias("w")))).alias("l"))
    text = F.transform("l", lambda x: F.concat(F.lit("v"), x["v"].cast("string"), F.lit(":w"), x["w"].cast("string")))
    return got.select("book", "key", "word", F.size("l").cast("long").alias("n"), F.array_join(text, ", ").alias("locations"))


def quantiles(null: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Observed values against their draws: difference, sample SD and the 2.5 and 97.5 percent points."""
    got = null.groupBy(*keys).agg(F.count("*").alias("permutations"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    got = got.join(seen, keys)
    out = {"observed": F.col("observed"), "null_mean": F.col("mean"), "difference": F.col("observed") - F.col("mean"), "null_q025": F.col("q")[0], "null_q975": F.col("q")[1]}
    return got.select(*keys, "permutations", *((S.rounded(c) + 0.0).alias(n) for n, c in out.items()), S.rounded("sd", 6).alias("null_sd"))
