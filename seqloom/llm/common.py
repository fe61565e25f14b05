"""Shared pieces of the training-data operators: tables, shared-folder checkpoints, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that the Python workers hold in one step.
CHUNK_BYTES = 1 << 20
#: What tasks of one operator leave in a worker for its next ones; see ``chunks`` and ``remembered``.
_LEFT: dict = {}

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts are long, so Arrow batches to Python workers are bounded in bytes where nobody set a bound."""
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one and a cluster an error."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def kept(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back. ``dictionary``: False for columns of hashes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that no model may learn from. Null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows of the driver's. It goes by Arrow: other rows pass through Python workers of a second kind, which live on."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows) if rows else [[] for _ in kinds]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip(columns, kinds)], schema=kinds))


def remembered(key, make):
    """What ``make`` gave to an earlier task of this worker under ``key``, or gives now. The worker keeps one such thing."""
    if key not in _LEFT:
        _LEFT.clear()
        _LEFT[key] = make()
    return _LEFT[key]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, remember: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` text bytes each; one longer text makes a slice of its own.

    Unless ``remember``, the worker first forgets what tasks of another operator have left in it.
    """
    if _LEFT and not remember:
        _LEFT.clear()
        trim()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
        step = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all the column's texts, and each text's bounds in them. A null is an empty text."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each text has."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine: idle workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        cache[int(base)] = have
    return have[:n]


def hash_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for many spans at once, from one running polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _powers(_BASE, len(codes)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _powers(_BASE_INVERSE, len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of each word, block by block, so that memory stays bounded in very long texts."""
    codes = _BYTE_CODES
    if fold_case:
        codes = codes.copy()
        codes[65:91] = codes[97:123]
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES)))
        lo = starts[a]
        out[a:b] = hash_spans(codes[data[lo : ends[b - 1]]], starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text; the run's first word; how many runs each text has."""
    runs = np.maximum(counts - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(np.int64), runs) + np.arange(int(runs.sum()))
    return hash_spans(hashes, at, at + width), at, runs


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int64()).cast(pa.int32()), pa.array(values, kind))
