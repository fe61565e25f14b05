"""Symbol-sequence grammar: transitions, n-grams, core projection, and permutation nulls for them.

Streams are (book, pos, sym) with pos dense from 0 in each book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import nulls as N


def _by():
    return Window.partitionBy("book").orderBy("pos")


def bigrams(stream: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """(keys, pos, a, b) for each pair of neighbours."""
    by = Window.partitionBy(*keys).orderBy("pos")
    return stream.select(*keys, "pos", F.col("sym").alias("a"), F.lead("sym").over(by).alias("b")).where("b is not null")


def transition_counts(stream: DataFrame) -> DataFrame:
    return bigrams(stream).groupBy("book", "a", "b").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def edges(counts: DataFrame, least: int = 1, least_probability: float = 0.0) -> DataFrame:
    """Each transition with its probability, share of arrivals, reverse count, asymmetry, expected count and lift."""
    out_of, into, book = (Window.partitionBy("book", *x) for x in (("a",), ("b",), ()))
    e = counts.select("book", "a", "b", "n", F.sum("n").over(out_of).alias("n_a"), F.sum("n").over(into).alias("n_b"), F.sum("n").over(book).alias("total"))
    back = counts.select("book", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("reverse_n"))
    e = e.join(back, ["book", "a", "b"], "left").withColumn("reverse_n", F.coalesce("reverse_n", F.lit(0)))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("total")
    e = e.select(
        "book", "a", "b", "n", S.rounded(S.ratio("n", "n_a")).alias("p_next"), S.rounded(S.ratio("n", "n_b")).alias("share_of_b"), "reverse_n",
        (F.col("n") - F.col("reverse_n")).alias("asymmetry"), S.rounded(S.ratio("n", "reverse_n")).alias("asymmetry_ratio"), S.rounded(expected).alias("expected"), S.rounded(F.col("n") / expected).alias("lift"),
    )
    return e.where((F.col("n") >= least) | (F.col("p_next") >= least_probability)) if least > 1 or least_probability else e


def nodes(stream: DataFrame) -> DataFrame:
    """Count, share, degrees, entropies of both neighbours and the likeliest next symbol of each symbol (first seen wins ties)."""
    counts = transition_counts(stream)
    own = stream.groupBy("book", "sym").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("book")))
    sides = []
    for key, other, tag in (("a", "b", "successor"), ("b", "a", "predecessor")):
        side = S.entropy(counts, ["book", key]).select("book", F.col(key).alias("sym"), F.col("kinds").alias(f"{tag}s"), S.rounded("entropy").alias(f"{tag}_entropy"))
        sides.append(side)
    top = S.ranked(counts, ["book", "a"], F.desc("n"), "first_pos").withColumn("out", F.sum("n").over(Window.partitionBy("book", "a"))).where("rank = 1")
    top = top.select("book", F.col("a").alias("sym"), F.col("b").alias("top_next"), S.rounded(S.ratio("n", "out")).alias("top_p"))
    out = own
    for side in (*sides, top):
        out = out.join(side, ["book", "sym"], "left")
    return out.select(
        "book", "sym", "n", S.rounded(S.ratio("n", "total")).alias("share"), F.coalesce("successors", F.lit(0)).alias("successors"), F.coalesce("predecessors", F.lit(0)).alias("predecessors"),
        F.coalesce("successor_entropy", F.lit(0.0)).alias("successor_entropy"), F.coalesce("predecessor_entropy", F.lit(0.0)).alias("predecessor_entropy"), "top_next", "top_p",
    )


def top_neighbours(counts: DataFrame, side: str = "a", k: int = 3) -> DataFrame:
    """The ``k`` commonest successors (side a) or predecessors (side b) of each symbol."""
    return S.ranked(counts, ["book", side], F.desc("n"), "first_pos").where(F.col("rank") <= k).select("book", "a", "b", "n", "rank")


def funnels(counts: DataFrame, cadence: tuple[str, ...], least: int = 1) -> DataFrame:
    """Predecessors of cadence symbols; ranks are given before rare ones are left out."""
    return top_neighbours(counts.where(F.col("b").isin(*cadence)), "b", 1 << 30).where(F.col("n") >= least)


def ngrams(stream: DataFrame, k: int, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """(keys, pos, gram): runs of ``k`` symbols, joined by spaces."""
    by = Window.partitionBy(*keys).orderBy("pos")
    parts = [F.col("sym"), *(F.lead("sym", i).over(by) for i in range(1, k))]
    return stream.select(*keys, "pos", *(p.alias(f"g{i}") for i, p in enumerate(parts))).where(F.col(f"g{k - 1}").isNotNull()).select(*keys, "pos", F.concat_ws(" ", *(f"g{i}" for i in range(k))).alias("gram"))


def ngram_entropy(stream: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """kinds, entropy and normalised entropy of each book's runs of each size; the stream is read once for all sizes."""
    by = Window.partitionBy("book").orderBy("pos")
    ahead = stream.select("book", "sym", *(F.lead("sym", i).over(by).alias(f"g{i}") for i in range(1, max(sizes)))).withColumnRenamed("sym", "g0")
    grams = [F.when(F.col(f"g{k - 1}").isNotNull(), F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *(f"g{i}" for i in range(k))).alias("gram"))) for k in sizes]
    counts = ahead.select("book", F.explode(F.array(*grams)).alias("x")).where("x is not null").groupBy("book", "x.k", "x.gram").agg(F.count("*").alias("n"))
    return S.entropy(counts, ["book", "k"]).select("book", "k", "kinds", S.rounded("entropy").alias("entropy"), S.rounded("normalized_entropy").alias("normalized_entropy"))


def ngram_top(stream: DataFrame, k: int, most: int) -> DataFrame:
    counts = ngrams(stream, k).groupBy("book", "gram").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return S.ranked(counts, ["book"], F.desc("n"), "first_pos").where(F.col("rank") <= most).select("book", "gram", "n", "rank")


def projected(stream: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """The stream of core symbols only, numbered anew, so that what stood apart becomes adjacent."""
    return stream.where(F.col("sym").isin(*core)).select("book", (F.row_number().over(_by()) - 1).cast("long").alias("pos"), "sym")


def adjacent_core(stream: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """Transitions between core symbols that are neighbours in the whole stream."""
    return transition_counts(stream).where(F.col("a").isin(*core) & F.col("b").isin(*core))


def core_coverage(stream: DataFrame, core: tuple[str, ...]) -> DataFrame:
    inside = F.col("sym").isin(*core)
    return stream.groupBy("book").agg(F.count("*").alias("n"), F.count_if(inside).alias("core_n"), S.rounded(S.ratio(F.count_if(inside), F.count("*"))).alias("coverage"))


def _dealt(stream: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(perm_id, book, syms): each book's symbols in order as perm_id -1, and dealt anew."""
    many = N.listed(stream, "sym").withColumn("perm_id", F.explode(F.sequence(F.lit(-1), F.lit(permutations - 1))))
    mixed = F.when(F.col("perm_id") < 0, F.transform("_rows", lambda r: r["v"])).otherwise(F.transform(N.drawn(seed), lambda r: r["v"]))
    return many.select("perm_id", "book", mixed.alias("syms"))


def _dealt_grams(stream: DataFrame, k: int, permutations: int, seed: int) -> DataFrame:
    """(perm_id, book, place, g0, g1, ...) for each run of ``k`` symbols of ``_dealt`` whose last is not null."""
    run = lambda i: F.struct(*(F.get("syms", i + j).alias(f"g{j}") for j in range(k)))
    runs = F.when(F.size("syms") >= k, F.transform(F.sequence(F.lit(0), F.size("syms") - k), run))
    return _dealt(stream, permutations, seed).select("perm_id", "book", F.posexplode(runs).alias("place", "g")).select("perm_id", "book", "place", "g.*").where(f"g{k - 1} is not null")


def dealt_pairs(stream: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(perm_id, book, pos, a, b): neighbours in each book's stream (perm_id -1) and in its shuffled copies."""
    return _dealt_grams(stream, 2, permutations, seed).toDF("perm_id", "book", "pos", "a", "b")


def _against(counts: DataFrame, keys: list[str], kept, permutations: int, as_counts: bool) -> DataFrame:
    """Null summary of (perm_id, keys, n, first): what ``kept`` leaves of the rows with perm_id -1, against the other draws; 0 where a
    draw has none. The draws of one key meet in one row, so nothing is joined."""
    own = F.col("perm_id") < 0
    met = counts.groupBy(*keys).agg(F.max(F.when(own, F.col("n"))).alias("observed"), F.max(F.when(own, F.col("first"))).alias("first"), F.map_from_entries(F.collect_list(F.when(~own, F.struct("perm_id", "n")))).alias("_drawn"))
    many = N.repeated(kept(met.where("observed is not null")), permutations)
    return S.summarised(many.select("perm_id", *keys, "observed", F.coalesce(F.try_element_at("_drawn", F.col("perm_id")), F.lit(0)).alias("value")), keys, counts=as_counts)


def transition_null(stream: DataFrame, least: int, permutations: int, seed: int = 1) -> DataFrame:
    """Counts of transitions with at least ``least`` cases against shuffled streams."""
    return _counted_null(stream, lambda met: met.where(F.col("observed") >= least), permutations, seed, counts=True)


def top_transition_null(stream: DataFrame, most: int, permutations: int, seed: int = 1) -> DataFrame:
    """Counts of each book's ``most`` commonest transitions (ties: first seen) against shuffled streams."""
    return _counted_null(stream, lambda met: S.ranked(met, ["book"], F.desc("observed"), F.col("first")).where(F.col("rank") <= most), permutations, seed, counts=False)


def _counted_null(stream: DataFrame, kept, permutations: int, seed: int, counts: bool) -> DataFrame:
    n = dealt_pairs(stream, permutations, seed).groupBy("perm_id", "book", "a", "b").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return _against(n, ["book", "a", "b"], kept, permutations, counts)


def entropy_null(stream: DataFrame, k: int, permutations: int, seed: int = 1) -> DataFrame:
    counts = _dealt_grams(stream, k, permutations, seed).groupBy("perm_id", "book", F.concat_ws(" ", *(f"g{i}" for i in range(k))).alias("gram")).agg(F.count("*").alias("n"))
    values = S.entropy(counts, ["perm_id", "book"]).select("perm_id", "book", F.col("entropy").alias("value"))
    return S.summarised(observed_beside(values, ["book"]), ["book"])


def observed_beside(values: DataFrame, keys: list[str]) -> DataFrame:
    """(perm_id, keys, value) of the draws, with the value of perm_id -1 beside them as ``observed``."""
    own = F.max(F.when(F.col("perm_id") < 0, F.col("value"))).over(Window.partitionBy(*keys))
    return values.withColumn("observed", own).where("perm_id >= 0 and observed is not null")


def formula_null(stream: DataFrame, k: int, least: int, candidates: int, permutations: int, most: int, seed: int = 1) -> DataFrame:
    """Frequent n-grams against shuffled streams, ranked by p, then Z, count and text."""
    gram = F.concat_ws(" ", *(f"g{i}" for i in range(k))).alias("gram")
    n = _dealt_grams(stream, k, permutations, seed).groupBy("perm_id", "book", gram).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    kept = lambda met: S.ranked(met.where(F.col("observed") >= least), ["book"], F.desc("observed"), "gram").where(F.col("rank") <= candidates)
    found = _against(n, ["book", "gram"], kept, permutations, True).withColumn("enrichment", S.rounded(S.ratio("observed", "null_mean"), 6))
    order = [F.asc("p_upper"), F.asc(F.col("z").isNull().cast("int")), F.desc(F.coalesce("z", F.lit(0.0))), F.desc("observed"), F.asc("gram")]
    return S.ranked(found, ["book"], *order).where(F.col("rank") <= most)
