"""Removal of long word passages that an earlier document also has.

Every window of ``WINDOW`` words is judged by its 64-bit fingerprints. Only windows that can repeat are shuffled: a window's
anchor is the smallest hash of its eight-word runs, equal windows have equal anchors, and an anchor that only one text has
rules out all its windows. Maximal spans of repeated windows are then cut out of the text.

Automata of reference shards, broadcast, would send every document of a corpus through every shard when the corpus is its own
reference; so this module works on fingerprints instead (README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .filters import BitFilter

WINDOW, RUN = 50, 8
#: Bits of the anchor filter: 16 for each repeated anchor, within these bounds (log2). 2**27 bits are 16 MB.
LEAST_BITS, MOST_BITS, DOC_BITS = 20, 27, 23


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def _parsed(column: pa.Array):
    data, bounds = C.text_bytes(column)
    starts, ends, counts = C.word_bounds(data, bounds)
    return data, starts, ends, counts, C.hash_words(data, starts, ends)


def _anchored(words: np.ndarray, counts: np.ndarray, window: int):
    """For each text with a whole window its index, the anchors and the hashes of its windows."""
    runs, _, n_runs = C.windows(words, counts, RUN)
    whole, _, n = C.windows(words, counts, window)
    at_runs, at = C.offsets(n_runs), C.offsets(n)
    for i in np.flatnonzero(n).tolist():
        yield i, _sliding_min(runs[at_runs[i] : at_runs[i + 1]], window - RUN + 1), whole[at[i] : at[i + 1]]


def _distinct(x: np.ndarray) -> np.ndarray:
    return np.unique(x[np.concatenate([[True], x[1:] != x[:-1]])])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(window: int):
    def run(batches):
        for part in C.chunks(batches):
            _, _, _, counts, words = _parsed(part.column(1))
            first = C.offsets(counts)
            one = C.hash_spans(words, first[:-1], first[1:])
            two = C.hash_spans(C.mixed(words + np.uint64(0x5851F42D4C957F2D)), first[:-1], first[1:])
            anchors, n = [np.zeros(0, np.uint64)], np.zeros(len(counts), np.int64)
            for i, anchor, _ in _anchored(words, counts, window):
                anchors.append(_distinct(anchor))
                n[i] = len(anchors[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), _signed(one), _signed(two), C.list_column(np.concatenate(anchors).view(np.int64), n, pa.int64())], names=["doc_id", "n_words", "one", "two", "anchors"])

    return run


def _emit(window: int, keep: BitFilter):
    """Rows (window, doc, pos) of the windows whose anchor may repeat; a text that the task has seen sends none again."""

    def run(batches):
        seen: dict[tuple, int] = {}
        for part in C.chunks(batches):
            ids = part.column(0).to_pylist()
            _, _, _, counts, words = _parsed(part.column(1))
            first = C.offsets(counts)
            whole = C.hash_spans(words, first[:-1], first[1:])
            out = []
            for i, anchor, hashes in _anchored(words, counts, window):
                same = (int(counts[i]), int(whole[i]))
                if ids[i] is None or seen.get(same, ids[i] + 1) < ids[i]:
                    continue
                seen[same] = ids[i]
                at = np.flatnonzero(keep.hit_hashes(anchor))
                out.append((hashes[at].view(np.int64), np.full(len(at), ids[i], np.int64), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["win", "doc", "pos"])

    return run


def _cut(window: int):
    """Texts without the words that the windows at ``pos`` cover."""

    def run(batches):
        for part in C.chunks(batches):
            data, starts, ends, counts, _ = _parsed(part.column(1))
            first, at = C.offsets(counts), part.column(2)
            raw, rows = data.tobytes(), []
            whole = part.column(3).to_pylist()
            for i, n in enumerate(counts.tolist()):
                drop = np.zeros(n + 1, np.int32)
                if whole[i] and n >= window:
                    drop[0] = 1
                elif at[i].is_valid and len(at[i].values):
                    pos = at[i].values.to_numpy(zero_copy_only=False)
                    drop[pos] += 1
                    np.subtract.at(drop, pos + window, 1)
                stay = np.flatnonzero(np.cumsum(drop)[:n] == 0) + first[i]
                text = b" ".join(raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist()))
                rows.append((n, n - len(stay), text))
            n, gone, text = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in text], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller doc_id; all windows
    are judged on the input. A null or blank text has no words. A row with a null doc_id neither removes nor loses words; rows
    that repeat a doc_id are one document for this purpose. Only doc_id and text are read, so other columns may have any
    names. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = C.kept(docs.mapInArrow(_describe(window), "doc_id long, n_words long, one long, two long, anchors array<long>"), "anchors")
    real = told.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    copies = real.groupBy("n_words", "one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = real.join(copies, ["n_words", "one", "two"]).where("doc_id > first").select("doc_id").distinct()
    shared = real.select(F.explode("anchors").alias("anchor"), "doc_id").groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = C.kept(shared, "shared")
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(16 * max(1, shared.count()))))))
    keep = BitFilter(shared, bits, hashed=True)

    wins = docs.mapInArrow(_emit(window, keep), "win long, doc long, pos int")
    wins = C.kept(wins, "windows")
    lowest = wins.groupBy("win").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("win", "low")
    pos = wins.join(lowest, "win").where("doc > low").select("doc", "pos")
    pos = C.kept(pos.groupBy("doc").agg(F.collect_set("pos").alias("pos")), "spans")

    gone = pos.select("doc", "pos", F.lit(False).alias("whole")).join(copies.withColumnRenamed("doc_id", "doc"), "doc", "left_anti")
    gone = C.kept(gone.unionByName(copies.select(F.col("doc_id").alias("doc"), F.expr("cast(null as array<int>)").alias("pos"), F.lit(True).alias("whole"))), "gone")
    some = BitFilter(gone.select("doc"), DOC_BITS)

    def part(hit: bool):
        def run(batches):
            for b in batches:
                got = some.hit_rows(b.column(2))
                yield pa.RecordBatch.from_arrays([x.filter(got if hit else pa.compute.invert(got)) for x in b.columns[:2]], names=["doc_id", "text"])

        return docs.select("doc_id", "text", some.slot("doc_id")).mapInArrow(run, "doc_id long, text string")

    hit = part(True).join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "pos", F.coalesce("whole", F.lit(False)).alias("whole"))
    rest = part(False).select("doc_id", "text", F.expr("cast(null as array<int>)").alias("pos"), F.lit(False).alias("whole"))
    out = "doc_id long, n_words long, n_removed long, kept string"
    return hit.mapInArrow(_cut(window), out).unionByName(rest.mapInArrow(_cut(window), out))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
