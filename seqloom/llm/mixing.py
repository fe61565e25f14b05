"""Mixing sources to target weights in fixed-length blocks of words.

Each source's documents, in an order set by hashes of their ids, form one run of words that is cut into blocks. A plan says how
many block slots each source fills in each output shard: multinomial draws from what is still owed, so that the totals come out
exactly. A slot's number goes through the source's pseudorandom permutation of block indices, one for each pass over the source,
and blocks are joined by index. Only one row per source reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common as C

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
BLOCK, SHARD, MOST_SHARDS, SEED = 64, 4_096, 2_048, 20240229
#: Parts of a source whose documents are numbered apart.
BUCKETS = 1_024


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Words owed to each source: all sizes shared by repeating weights; what exceeds ``most`` times a size is shared again."""
    share, weight, left = [0.0] * len(sizes), [weights[i % len(weights)] for i in range(len(sizes))], float(sum(sizes))
    free = {i for i, n in enumerate(sizes) if n > 0}
    while free:
        total = sum(weight[i] for i in free)
        full = {i for i in free if left * weight[i] / total > most * sizes[i]}
        if not full:
            for i in free:
                share[i] = left * weight[i] / total
            break
        for i in full:
            share[i] = float(most * sizes[i])
            left -= share[i]
        free -= full
    return share


def shard_counts(slots: list[int], seed: int = SEED) -> np.ndarray:
    """Slots of each source (columns) in each output shard (rows)."""
    left, random = np.array(slots, np.int64), np.random.Generator(np.random.PCG64(seed))
    total = int(left.sum())
    size = max(SHARD, math.ceil(total / MOST_SHARDS))
    rows = []
    while left.sum() > 0:
        want, drawn = min(size, int(left.sum())), np.zeros_like(left)
        while want:
            rest = left - drawn
            more = np.minimum(random.multinomial(want, rest / rest.sum()), rest)
            drawn += more
            want -= int(more.sum())
        rows.append(drawn)
        left -= drawn
    return np.array(rows, np.int64).reshape(-1, len(slots))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(n) takes each index: a Feistel network, walked until the value is in range."""
    half = max(1, math.ceil(math.ceil(math.log2(max(2, n))) / 2))
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            salt = np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            left, right = right, left ^ (C.mixed(right + salt) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = out >= n
    return out.astype(np.int64)


def _slots(blocks: list[int]):
    def run(batches):
        for batch in batches:
            for source, shard, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                for a in range(first, first + count, 1 << 16):
                    slot = np.arange(a, min(a + (1 << 16), first + count))
                    n, block = blocks[source], np.empty(len(slot), np.int64)
                    turn = slot // n
                    for t in np.unique(turn).tolist():
                        block[turn == t] = permuted(slot[turn == t] % n, n, (SEED + source) * 64 + t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), source)), pa.array(block), pa.array(np.full(len(slot), shard)), pa.array(slot)], names=["src", "block", "shard", "slot"])

    return run


def _marked(docs: DataFrame) -> dict:
    """What tells rows apart: id (and whether there is none), source and two hashes of the text. Rows equal in all are alike."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return {"no_id": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)), "name": named, "one": F.xxhash64(text), "two": F.xxhash64(F.lit(SEED), text)}


KEY = ["no_id", "id", "name", "one", "two"]


class Mix:
    """The mix of a documents table: ``slots`` (src, block, shard, slot) and ``documents`` with what each gives."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS):
        spark = docs.sparkSession
        size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(C.WORD)), F.lit(0)).cast("long")
        marks = _marked(docs)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), *(marks[k].alias(k) for k in ("name", "one", "two")))
        place = F.xxhash64(F.coalesce("doc_id", "one"))
        rows = C.kept(rows.withColumn("bucket", F.pmod(place, F.lit(BUCKETS))), "sizes")
        parts = rows.groupBy("name", "bucket").agg(F.sum("size").alias("words"))
        owned = {r["name"]: r["words"] for r in parts.groupBy("name").agg(F.sum("words").alias("words")).toLocalIterator()}
        names = sorted(owned, key=lambda x: (x == "n", x))
        sizes = [owned[x] for x in names]
        self.targets = targets(sizes, weights)
        self.blocks = [max(1, -(-n // BLOCK)) for n in sizes]
        slots = [min(MOST_PASSES * b, round(t * b / n)) if n else 0 for t, b, n in zip(self.targets, self.blocks, sizes)]
        counts = shard_counts(slots) if sum(slots) else np.zeros((0, len(slots)), np.int64)
        first = np.cumsum(counts, axis=0) - counts
        plan = [(s, k, int(first[k, s]), int(counts[k, s])) for k in range(len(counts)) for s in range(len(slots)) if counts[k, s]]
        plan = C.small(spark, plan, "src long, shard long, first long, count long").repartition(C.partitions(spark))
        self.slots = plan.mapInArrow(_slots(self.blocks), "src long, block long, shard long, slot long")

        known = C.small(spark, [(x, i, sizes[i], self.targets[i]) for i, x in enumerate(names)], "name string, src long, source_size long, target double")
        before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        within = Window.partitionBy("name", "bucket").orderBy(place, "doc_id", "size", "one", "two")
        start = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = rows.withColumn("start", start).withColumn("row", F.row_number().over(within))
        placed = placed.join(parts.select("name", "bucket", "before"), ["name", "bucket"]).withColumn("start", F.col("start") + F.col("before")).join(known, "name")

        cut = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)))
        spread = placed.select("doc_id", "name", "one", "two", "src", "bucket", "row", "size", "start", "source_size", "target", F.explode_outer(cut).alias("block"))
        times = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        met = spread.join(times, ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
        over = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("start"), F.col("block") * BLOCK)
        piece = F.struct((F.greatest(F.col("start"), F.col("block") * BLOCK) - F.col("start")).alias("at"), over.alias("n"), "times")
        self.documents = met.groupBy("src", "bucket", "row", "doc_id", "name", "one", "two", "size", "start", "source_size", "target").agg(
            F.coalesce(F.sum(over * F.col("times")), F.lit(0)).alias("taken"), F.sort_array(F.collect_list(F.when(F.col("size") > 0, piece))).alias("pieces")
        )


def counted(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    A null text has no words, a null source is a source of its own, a null doc_id is a document like others. Rows that repeat
    are documents of their own. Only doc_id, text and source are read, so other columns may have any names. An empty table
    gives an empty result.
    """
    return Mix(docs).documents.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _rebuilt(batches):
    for part in C.chunks(batches):
        out = []
        for text, pieces in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            raw = (text or "").encode()
            if all(p["times"] == 1 for p in pieces):
                out.append(text)
                continue
            starts, ends, _ = C.word_bounds(*C.text_bytes(pa.array([text or ""])))
            passes = []
            for turn in range(1, max(p["times"] for p in pieces) + 1):
                runs: list[list[int]] = []
                for p in pieces:
                    if p["times"] >= turn:
                        if runs and runs[-1][1] == p["at"]:
                            runs[-1][1] += p["n"]
                        else:
                            runs.append([p["at"], p["at"] + p["n"]])
                passes += [raw[starts[a] : ends[b - 1]].decode() for a, b in runs]
            out.append("\n".join(passes))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["rest", "text"])
    C.trim()


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, all columns as they are but text, which holds the taken words in order.

    Words of later passes follow on lines of their own; a document taken once and whole keeps its text. n_chars, where there
    is one, is counted anew. Documents without a taken word go. A null doc_id is an id like others, and each row has the pieces
    of its own: rows are met by id, source and text, and rows alike in all three by number, each with the pieces of one.
    """
    alike = Window.partitionBy(*KEY).orderBy("one")
    taken = Mix(docs).documents.where("taken > 0").withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    taken = taken.select(*KEY, "pieces", F.row_number().over(Window.partitionBy(*KEY).orderBy("bucket", "row")).alias("nth"))
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*(F.col(f"`{c}`").alias(c) for c in others)).alias("rest")
    rows = docs.select(rest, F.col("text").cast("string").alias("text"), *(x.alias(k) for k, x in _marked(docs).items()))
    rows = rows.withColumn("nth", F.row_number().over(alike)).join(taken, [*KEY, "nth"]).select("rest", "text", "pieces")
    kinds = StructType([StructField("rest", rows.schema["rest"].dataType), StructField("text", StringType())])
    rows = rows.mapInArrow(_rebuilt, kinds)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*((changed[c] if c in changed else F.col("rest")[c]).alias(c) for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return counted(C.table(spark, sf_dir, "documents"))
