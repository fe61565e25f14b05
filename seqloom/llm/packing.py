"""Packing of tokenised documents into near-full sequences by Karmarkar-Karp multiway differencing.

Whole multiples of the sequence length leave a document as sequences of their own. What remains is cut into pieces of at most
``PIECE`` tokens; ``GROUP`` documents at a time, their pieces are dealt to windows: every piece starts as a partial partition,
and the two partitions with the widest imbalance merge, largest window with smallest, until one is left. The number of windows
starts at the least possible and rises while a window exceeds the sequence length. One narrow pass, nothing is shuffled.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .merges import BLOCK, LONGEST, Merges

LENGTH, PIECE, GROUP = 1024, 128, 192
#: Characters, and 40 for each word, that a worker remembers at most of the words that it has encoded; about 4 bytes for each.
MEMO = 40_000_000
#: Text bytes that a worker encodes in one step.
STEP = C.CHUNK_BYTES // 4
END = b"\0\0\0\0"
#: White space that a cut before a single space would part: such texts are encoded whole. The space comes first, as it is sought fastest.
_BOUND = re.compile(r" (?<=\s )(?:\s|\Z)")


class Encoder:
    """Token ids as little-endian 32-bit bytes; each word with the space before it is encoded and remembered.

    Words are remembered in two halves, ``memo`` and ``old``. Once ``memo`` is full it becomes ``old``; words that come again move
    back, the others are forgotten when ``memo`` is full again.
    """

    def __init__(self, path: str, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held, self.most = 0, most
        self.merges = Merges.read(path)

    def _single(self, units: list[str]) -> list[bytes]:
        return [np.array(got.ids, "<u4").tobytes() for got in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words after a space: short plain ones from ``Merges``, the others from the tokenizer."""
        if self.merges:
            short = [x for x in words if len(x) <= LONGEST]
            for i in range(0, len(short), BLOCK):
                self.memo.update(zip(*self.merges.encode(short[i : i + BLOCK])))
        rest = [x for x in words if x not in self.memo]
        self.memo.update(zip(rest, self._single([" " + x for x in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A word's key in the memo lacks the space before it; what starts a text is encoded by itself."""
        if self.held > self.most // 2:
            self.old, self.memo, self.held = self.memo, {}, 0
        parts = [[text] if _BOUND.search(text) else text.split(" ") for text in texts]
        heads = [units.pop(0) for units in parts]
        first = list(dict.fromkeys(heads))
        first = dict(zip(first, self._single(first)))
        todo = set().union(*parts).difference(self.memo)
        self.held += sum(map(len, todo)) + 40 * len(todo)
        again = list(filter(self.old.__contains__, todo))
        self.memo.update(zip(again, map(self.old.pop, again)))
        self._learn(sorted(todo.difference(again)))
        find = self.memo.__getitem__
        return [first[head] + b"".join(map(find, units)) for head, units in zip(heads, parts)]


def encoder(path: str, most: int = MEMO) -> Encoder:
    """The worker's encoder for a file: later tasks go on with what earlier ones have remembered, until another operator's begin."""
    return C.remembered((path, most), lambda: Encoder(path, most))


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in each of ``windows`` near-equal windows (Karmarkar-Karp).

    A partition lists its windows, smallest first, as (size above the smallest, indices); those without an index are left out.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for tick in range(len(sizes), 2 * len(sizes) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= windows:
            both = b[::-1] + a
        else:
            a, b = ([(0, [])] * (windows - len(x)) + x for x in (a, b))
            both = [(m + n, p + q) for (m, p), (n, q) in zip(a, reversed(b))]
        both.sort(key=itemgetter(0))
        if len(both) == windows and both[0][0]:
            least = both[0][0]
            both = [(m - least, p) for m, p in both]
        heapq.heappush(heap, (-both[-1][0], tick, both))
    return [p for _, p in heap[0][2]] if heap else []


def deal(sizes: list[int], length: int) -> list[list[int]]:
    """``difference`` with the least window count, from the mean upwards, that keeps each window within ``length``."""
    windows = max(1, -(-sum(sizes) // length))
    while True:
        found = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= length for w in found):
            return found
        windows += 1


FIELDS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(path: str, length: int, memo: int = MEMO):
    def run(batches) -> Iterator[pa.RecordBatch]:
        words, rows, held = encoder(path, memo), [], []
        sequence = TaskContext.get().partitionId() << 40

        def flush():
            nonlocal sequence
            pieces = []
            for doc, at, total, ids in held:
                parts = -(-len(ids) // (4 * PIECE))
                cuts = [4 * (len(ids) // 4 * k // parts) for k in range(parts + 1)]
                pieces += [(doc, at + a // 4, total, ids[a:b]) for a, b in zip(cuts, cuts[1:])]
            held.clear()
            for window in deal([len(p[3]) // 4 for p in pieces], length):
                offset = 0
                for i in sorted(window):
                    doc, at, total, ids = pieces[i]
                    rows.append((doc, at, len(ids) // 4, total, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*rows))[:6]] + [pa.array([r[6] for r in rows], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            return batch

        for part in C.chunks(batches, limit=STEP, remember=True):
            for doc, ids in zip(part.column(0).to_pylist(), words.encode([x or "" for x in part.column(1).to_pylist()])):
                ids += END
                total = len(ids) // 4
                whole = total // length * length
                for at in range(0, whole, length):
                    rows.append((doc, at, length, total, sequence, 0, ids[4 * at : 4 * (at + length)]))
                    sequence += 1
                if whole < total:
                    held.append((doc, whole, total, ids[4 * whole :]))
                    if len(held) == GROUP:
                        flush()
                if len(rows) >= 2048:
                    yield out()
        if held:
            flush()
        if rows:
            yield out()
        C.trim()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, memo: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian).

    A document is its token ids and one id 0, so a null or empty text is that id alone; a null doc_id is kept. Each row is a
    document of its own, also where rows repeat. Only doc_id and text are read, so other columns may have any names. An empty
    table gives an empty result. ``tokenizer`` is the path of a tokenizers file, by default the public byte_bpe_50k.json.
    ``memo`` bounds what a worker remembers, as MEMO does: less takes more time, the result is the same.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(str(tokenizer), length, memo), FIELDS)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(C.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
