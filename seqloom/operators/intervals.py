"""Distances between accents, by whether they cross a boundary, and nulls for them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import draws as D


def intervals(rows: DataFrame, models: tuple[str, ...] = ("verse", "major", "minor")) -> DataFrame:
    """(book, model, i, interval, relation) from words with accent_pulse: all accents in a row, and within or across segments.

    Distances that are not positive are left out, but take a number.
    """
    by = Window.partitionBy("book").orderBy("pos")
    accents = rows.where("accent_pulse is not null").select("book", "pos", "accent_pulse", *(f"{m}_id" for m in models))
    step = accents.withColumn("interval", F.col("accent_pulse") - F.lag("accent_pulse").over(by)).withColumn("i", F.row_number().over(by).cast("long") - 1)
    kinds = [F.struct(F.lit("continuous").alias("model"), F.lit("continuous").alias("relation"))]
    for m in models:
        kinds.append(F.struct(F.lit(m).alias("model"), F.when(F.col(f"{m}_id") == F.lag(f"{m}_id").over(by), "within").otherwise("cross_reset").alias("relation")))
    step = step.withColumn("kinds", F.array(*kinds)).where("i > 0 and interval > 0")
    return step.select("book", "i", "interval", F.explode("kinds").alias("k")).select("book", "i", "interval", "k.model", "k.relation")


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, kinds, mean, median, normalised entropy and top shares of the intervals of each group."""
    n = rows.groupBy(*by, "interval").agg(F.count("*").alias("n"))
    top = S.ranked(n, by, F.desc("n"), "interval")
    shares = top.groupBy(*by).agg(*(S.rounded(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{k}_share") for k in (1, 3, 5)))
    ent = S.entropy(n, by, base=None).select(*by, "kinds", S.rounded("normalized_entropy", 6).alias("normalized_entropy"))
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), S.rounded(F.avg("interval")).alias("mean"), S.rounded(F.percentile("interval", F.lit(0.5))).alias("median"))
    return base.join(ent, by).join(shares, by)


def top3(rows: DataFrame, by: list[str]) -> DataFrame:
    n = rows.groupBy(*by, "interval").agg(F.count("*").alias("n"))
    return S.ranked(n, by, F.desc("n"), "interval").groupBy(*by).agg((F.sum(F.when(F.col("rank") <= 3, F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("value"))


def _normal_entropy(rows: DataFrame, by: list[str]) -> DataFrame:
    return S.entropy(rows.groupBy(*by, "interval").agg(F.count("*").alias("n")), by, base=None).select(*by, F.col("normalized_entropy").alias("value"))


def contrast_null(rows: DataFrame, permutations: int, seed: int = 1, kind: str = "shuffle") -> DataFrame:
    """Within-segment minus cross-segment share of the three commonest intervals, and the same of normalised entropy.

    Each book and model is tested against its own intervals dealt anew; p_upper is meant for the share, p_lower for the entropy.
    A book without intervals on both sides has no row.
    """
    return _dealt(rows, permutations, seed, kind, contrast=True)


def interval_null(rows: DataFrame, permutations: int, seed: int = 1, kind: str = "shuffle") -> DataFrame:
    """Share of the three commonest intervals and normalised entropy of each book, model and relation against dealt intervals."""
    return _dealt(rows, permutations, seed, kind, contrast=False)


def _shares(counts: np.ndarray) -> np.ndarray:
    """(2, rows): share of the three commonest and normalised entropy of each row of counts by interval."""
    n, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
    top = np.sort(counts, axis=1)[:, -3:].sum(axis=1) / n
    p = counts / n[:, None]
    entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1)
    return np.stack([top, np.where(kinds > 1, entropy / np.log(np.maximum(kinds, 2)), 0.0)])


def _measured(codes: np.ndarray, sides: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each relation the shares of each row of ``codes``; ``sides`` are the places of the relation."""
    kinds, rows = int(codes.max()) + 1, np.arange(len(codes))[:, None]
    return {r: _shares(np.bincount((rows * kinds + codes[:, at]).ravel(), minlength=len(codes) * kinds).reshape(len(codes), kinds)) for r, at in sides.items()}


def _summary(seen: float, draws: np.ndarray) -> dict:
    """What ``functions.stats.presented`` needs of the draws of one value."""
    mid = draws.mean()
    return {
        "observed": seen, "permutations": len(draws), "null_mean": mid, "null_sd": draws.std(ddof=1) if len(draws) > 1 else 0.0, "unique_values": len(np.unique(draws.round(9))),
        "at_least": int((draws >= seen - 1e-12).sum()), "at_most": int((draws <= seen + 1e-12).sum()), "finite": len(draws), "as_far": int((np.abs(draws - mid) >= abs(seen - mid) - 1e-9).sum()),
    }


def _dealt(rows: DataFrame, permutations: int, seed: int, kind: str, contrast: bool) -> DataFrame:
    """Null summary of each book, model and metric (and relation, if not ``contrast``). A book's intervals are dealt and counted
    in one place, so that only summaries leave it, however many the permutations."""
    keys = ["book", "model"] if contrast else ["book", "model", "relation"]
    books = rows.groupBy("book", "model").agg(F.sort_array(F.collect_list(F.struct("i", "interval", "relation"))).alias("l"))
    books = books.select("book", F.col("book").cast("string").alias("name"), "model", *(F.col(f"l.{c}").alias(c) for c in ("i", "interval", "relation")))
    stats = "observed double, permutations long, null_mean double, null_sd double, unique_values long, at_least long, at_most long, finite long, as_far long"
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys)
    perms, step = np.arange(permutations), 1 << 18

    def run(frames):
        for frame in frames:
            out = []
            for book, name, model, i, interval, relation in zip(*(frame[c] for c in ("book", "name", "model", "i", "interval", "relation"))):
                relation, codes = np.asarray(relation, dtype=object), np.unique(interval, return_inverse=True)[1]
                sides = {r: np.flatnonzero(relation == r) for r in (("within", "cross_reset") if contrast else sorted(set(relation)))}
                if not all(len(x) for x in sides.values()):
                    continue
                seen, parts, n = _measured(codes[None], sides), [], len(codes)
                for at in range(0, permutations, max(1, step // n)):
                    some, group = perms[at : at + max(1, step // n)], f"{name}|{model}"
                    places = D.order(seed, some, group, np.asarray(i)) if kind == "shuffle" else D.turns(seed, some, group, n)
                    parts.append(_measured(codes[places], sides))
                drawn = {r: np.concatenate([x[r] for x in parts], axis=1) for r in sides}
                if contrast:
                    seen, drawn = ({(): x["within"] - x["cross_reset"]} for x in (seen, drawn))
                for r in drawn:
                    for m, metric in enumerate(("top3_share", "entropy_norm")):
                        own = {"book": book, "model": model, "metric": metric} | ({} if contrast else {"relation": r})
                        out.append(own | _summary(seen[r][m, 0], drawn[r][m]))
            if out:
                yield pd.DataFrame(out)[[*keys, "metric", *(x.split()[0] for x in stats.split(", "))]]

    got = books.mapInPandas(run, f"{kinds}, metric string, {stats}")
    return S.presented(got, [*keys, "metric"])


def ngrams(rows: DataFrame, k: int, most: int) -> DataFrame:
    """Commonest runs of ``k`` intervals of each book, model and relation, with their share; ties go to the run seen first."""
    keys = ["book", "model", "relation"]
    by = Window.partitionBy(*keys).orderBy("i")
    grams = rows.select(*keys, "i", *(F.lead("interval", j).over(by).alias(f"g{j}") for j in range(k))).where(F.col(f"g{k - 1}").isNotNull())
    n = grams.groupBy(*keys, F.concat_ws("-", *(F.col(f"g{j}").cast("string") for j in range(k))).alias("pattern")).agg(F.count("*").alias("n"), F.min("i").alias("first"))
    n = n.withColumn("share", S.rounded(S.ratio("n", F.sum("n").over(Window.partitionBy(*keys)))))
    return S.ranked(n, keys, F.desc("n"), F.col("first")).where(F.col("rank") <= most).drop("first")
