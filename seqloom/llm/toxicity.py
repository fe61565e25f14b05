"""Toxicity by compression distance: windows of a text under a toxic and an ordinary zstandard dictionary.

Two zstandard dictionaries are trained: one on windows of ordinary labelled texts, one on the fragments of toxic labelled texts
that are characteristic of them (words with byte runs that toxic text has far more often). Windows are compressed once after the
ordinary dictionary alone and once with the toxic one behind it; a window that gets shorter tells of toxic words. Each window
follows a primer that both end with, so that even a short one is stored compressed. What the windows say is calibrated to a
probability on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import learning as L

#: Most labelled rows that are learnt from, and their longest text in bytes (what reaches the driver is bounded by both; longer
#: labelled texts are not learnt from). Scores are made from whole texts.
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 2000, 4000, 16_384
WINDOW_WORDS, PART_WORDS, GRAM = 16, 4, 5
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 98_304
#: A byte run counts as toxic by this log-likelihood ratio and log odds.
LEAST_RATIO, LEAST_ODDS = 28.0, 2.5
#: Bytes saved by the toxic dictionary from which a window counts.
SAVED = (2, 4, 6)
PRIMER = bytes(range(33, 99))
PREDICT_FROM = 0.3


def _words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def _toxic_grams(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    seen = []
    for texts in (toxic, ordinary):
        count: Counter = Counter()
        for words in texts:
            count.update(set().union(*map(_grams, set(words))) if words else ())
        seen.append(count)
    a, b = len(toxic), len(ordinary)
    out = set()
    for gram, c in seen[0].items():
        d = seen[1][gram]
        odds = np.log((c + 0.5) / (a + 1)) - np.log((d + 0.5) / (b + 1))
        if odds > LEAST_ODDS:
            mean = (c + d) / (a + b)
            if 2 * (c * np.log(c / (a * mean)) + (d * np.log(d / (b * mean)) if d else 0)) > LEAST_RATIO:
                out.add(gram)
    return out


def _pieces(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + PART_WORDS]) for i in range(0, len(words), PART_WORDS)]


def _trained(samples: list[bytes], most: int, segment: int) -> bytes:
    """A zstandard dictionary of up to ``most`` bytes. Samples that are too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(most, samples, d=6, k=segment).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:most]


class Compressors:
    """The two dictionaries, ready to measure windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        settings = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False, write_dict_id=False,
            window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        )
        self.pair = []
        # the filler keeps ordinary words equally far away in both, so that they cost the same
        for content in (ordinary + b"\0" * len(toxic) + PRIMER, ordinary + toxic + PRIMER):
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=settings)
            self.pair.append(zstandard.ZstdCompressor(dict_data=trained, compression_params=settings).compress)

    def saved(self, words: list[bytes], step: int) -> list[int]:
        """Bytes that the toxic dictionary saves in each window of ``step`` words."""
        ordinary, toxic = self.pair
        windows = [PRIMER + b" " + b" ".join(words[i : i + step]) for i in range(0, len(words), step)]
        return [len(ordinary(x)) - len(toxic(x)) for x in windows]

    def features(self, text: str) -> list[float]:
        words = _words(text)
        saved = np.array(self.saved(words, WINDOW_WORDS))
        if not len(saved):
            return [0.0] * (5 + 2 * len(SAVED))
        # where a window saves bytes, its parts tell whether a single place does
        parts = [max(self.saved(words[i * WINDOW_WORDS : (i + 1) * WINDOW_WORDS], PART_WORDS)) for i in np.flatnonzero(saved >= SAVED[0]).tolist()]
        over = [int((saved >= k).sum()) for k in SAVED]
        part = np.array(parts or [0])
        return [float(np.clip(saved, -2, 8).mean()), float(min(saved.max(), 12)), float(np.log1p(len(saved))), float(min(part.max(), 12)), float(np.log1p((part >= SAVED[0]).sum())), *(np.log1p(x) for x in over), *(x / len(saved) for x in over)]


class ToxicityModel:
    """Fitted on (text, label) rows; without rows of both labels every score is 0."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.weights, texts = None, {1: [], 0: []}
        for text, label in sorted(set(rows)):
            texts[label].append(text)
        # every third text calibrates
        learn, check = ({k: [x for i, x in enumerate(v) if (i % 3 == 2) == late] for k, v in texts.items()} for late in (False, True))
        words = {k: [_words(x) for x in v] for k, v in learn.items()}
        toxic_grams = _toxic_grams(words[1], words[0]) if words[1] and words[0] else set()
        self.toxic = _trained([p for x in words[1] for p in _pieces([w for w in x if _grams(w) & toxic_grams])], TOXIC_BYTES, 16)
        self.ordinary = _trained([p for x in words[0] for p in _pieces(x)], ORDINARY_BYTES, 24)
        if check[1] and check[0]:
            made = Compressors(self.toxic, self.ordinary)
            x = np.array([made.features(t) for k in (1, 0) for t in check[k]])
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
            self.weights = L.logistic((x - self.mean) / self.scale, np.repeat([1.0, 0.0], [len(check[1]), len(check[0])]), decay=2e-3)

    def score(self, compressors: Compressors, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = (np.array([compressors.features(t) for t in texts]) - self.mean) / self.scale
        return L.sigmoid(x @ self.weights[:-1] + self.weights[-1])


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from labelled rows that are not held out; bounds are the constants above."""
    rows: list[tuple[str, int]] = []
    for label, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        texts = L.rows_of(docs.where(F.octet_length("text") <= MOST_BYTES), L.sample_ids(labels.where(F.col("toxic") == label), most))
        rows += [(r["text"], label) for r in texts.select("text").toLocalIterator()]
    return ToxicityModel(rows)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. A null text is an empty one, a null doc_id is kept and not held out.

    Equal texts get equal scores. Only doc_id and text are read, so other columns may have any names. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        compressors = Compressors(shared.value.toxic, shared.value.ordinary)
        for part in C.chunks(batches):
            scores = shared.value.score(compressors, [x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, C.table(spark, sf_dir, "labels")))
