"""Nearest neighbours by score-aware (anisotropic) product quantisation and exact reranking.

The squared distance to a query is |x|^2 - 2 <q, x> + |q|^2, so the inner product <q, x> is what has to be known well. Vectors
are cut into short stretches, each coded in four bits; codes and codewords are chosen so that the error parallel to the vector,
which changes large inner products most, weighs more than the error across it. A query makes a table of its products with all
codewords, a scan of the codes sums table entries, and the best of each block are ranked again by the original vectors.
Blocks of queries meet blocks of vectors, so that no task holds more than one block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

QUERY_EVERY, NEIGHBOURS = 100, 10
#: Rows of the sample that the codewords are fitted on; every row is indexed.
SAMPLE = 8_192
STRETCH, CODES, ROUNDS = 2, 16, 4
#: Share of a vector's length from which an inner product counts as large.
LARGE = 0.2
QUERY_BLOCK, VECTOR_BLOCK = 1_024, 8_192
#: Candidates of a block, for each query, that are ranked by the original vectors.
RERANKED = 100
#: Standard errors of a table's product by which a candidate may look too far and still be ranked.
DOUBT = 2.0


class Quantiser:
    """Codewords (stretches x 16 x ``STRETCH``), fitted for inner products."""

    def __init__(self, sample: np.ndarray):
        n, dim = sample.shape
        self.dim, self.stretches = dim, -(-dim // STRETCH)
        self.stretches += self.stretches % 2  # codes go in pairs into a byte
        eta = (dim - 1) * LARGE**2 / (1 - LARGE**2)
        self.weight = max(1.0, eta)  # of the parallel error; the error across weighs 1
        x = self.cut(sample)
        random = np.random.Generator(np.random.PCG64(11))
        first = random.choice(n, CODES, replace=n < CODES)
        self.words = x[first].transpose(1, 0, 2).copy()
        for _ in range(ROUNDS):
            self._means(x, self._nearest(x))
        for _ in range(ROUNDS):
            self._refit(x, self._codes(x))
        codes = self._codes(x)
        gaps = sum(((x[:, s] - self.words[s][codes[:, s]]) ** 2).sum() for s in range(self.stretches))
        self.error = float(np.sqrt(gaps / len(x) / dim))  # of a product with a unit vector

    def cut(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.stretches * STRETCH))
        out[:, : self.dim] = rows
        return out.reshape(len(rows), self.stretches, STRETCH)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[:, s, None] - self.words[s]) ** 2).sum(axis=2).argmin(axis=1) for s in range(self.stretches)], axis=1)

    def _means(self, x: np.ndarray, codes: np.ndarray) -> None:
        for s in range(self.stretches):
            n = np.bincount(codes[:, s], minlength=CODES)
            sums = np.stack([np.bincount(codes[:, s], x[:, s, k], minlength=CODES) for k in range(STRETCH)], axis=1)
            self.words[s] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.words[s])

    def _parallel(self, x: np.ndarray) -> np.ndarray:
        return (self.weight - 1) / np.maximum((x**2).sum(axis=(1, 2)), 1e-300)

    def _codes(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Stretch by stretch, the code with the least loss given the other stretches' errors."""
        codes, g, rows = self._nearest(x), self._parallel(x), np.arange(len(x))
        errors = np.stack([((x[:, s] - self.words[s][codes[:, s]]) * x[:, s]).sum(axis=1) for s in range(self.stretches)], axis=1)
        total = errors.sum(axis=1)
        for _ in range(passes):
            for s in range(self.stretches):
                gap = x[:, s, None] - self.words[s]
                along = (gap * x[:, s, None]).sum(axis=2)
                other = total - errors[:, s]
                codes[:, s] = ((gap**2).sum(axis=2) + g[:, None] * (other[:, None] + along) ** 2).argmin(axis=1)
                errors[:, s] = along[rows, codes[:, s]]
                total = other + errors[:, s]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword minimises the loss of its rows, a small linear system."""
        g, eye = self._parallel(x), np.eye(STRETCH)
        errors = np.stack([((x[:, s] - self.words[s][codes[:, s]]) * x[:, s]).sum(axis=1) for s in range(self.stretches)], axis=1)
        total = errors.sum(axis=1)
        for s in range(self.stretches):
            xs, other = x[:, s], total - errors[:, s]
            for c in range(CODES):
                at = codes[:, s] == c
                if at.any():
                    rows, k = xs[at], g[at]
                    left = at.sum() * eye + (rows * k[:, None]).T @ rows
                    right = rows.sum(axis=0) + (k * (other[at] + (rows**2).sum(axis=1))) @ rows
                    self.words[s, c] = np.linalg.solve(left, right)
            errors[:, s] = ((xs - self.words[s][codes[:, s]]) * xs).sum(axis=1)
            total = other + errors[:, s]

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Two codes in each byte."""
        codes = self._codes(self.cut(rows)).astype(np.uint8)
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte, the product with each of the 256 pairs of codewords."""
        products = np.einsum("qsk,sck->qsc", self.cut(queries), self.words)
        return (products[:, 0::2, :, None] + products[:, 1::2, None, :]).reshape(len(queries), -1, CODES * CODES).astype(np.float32)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _few_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows in id order, of equal vectors no more than ``most``: more of them cannot be among the nearest."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order]).view(f"V{vectors.shape[1] * 8}").ravel()
    _, group = np.unique(rows, return_inverse=True)
    by = np.argsort(group, kind="stable")
    start = np.searchsorted(group[by], np.arange(group.max(initial=-1) + 1))
    rank = np.empty(len(ids), np.int64)
    rank[by] = np.arange(len(ids)) - start[group[by]]
    return order[rank < most]


def search_block(model: Quantiser, query_ids, queries, ids, vectors, codes, k: int):
    """(query, vector, distance) of the ``k`` nearest of a block for each query, but the query's own row."""
    keep = _few_copies(ids, vectors, k + 1)
    ids, vectors, codes = ids[keep], vectors[keep], codes[keep]
    norms, out = (vectors**2).sum(axis=1).astype(np.float32), []
    best, nth = min(len(ids), max(RERANKED, 4 * k)), min(k, len(ids)) - 1
    for a in range(0, len(queries), 64):
        part, names = queries[a : a + 64], query_ids[a : a + 64]
        tables = model.tables(part)
        near = np.zeros((len(part), len(ids)), np.float32)
        for byte in range(codes.shape[1]):
            near += tables[:, byte][:, codes[:, byte]]
        near = norms - 2 * near
        near[names[:, None] == ids] = np.inf
        found = np.argpartition(near, best - 1, axis=1)[:, :best] if best < len(ids) else np.broadcast_to(np.arange(len(ids)), near.shape)
        exact = ((part[:, None] - vectors[found]) ** 2).sum(axis=2)
        size = (part**2).sum(axis=1)
        # all that the table's error may hide behind the k-th are ranked too, so that dense places lose none
        bound = np.partition(exact, nth, axis=1)[:, nth] - size + DOUBT * 2 * model.error * np.sqrt(size)
        for i, name in enumerate(names):
            at = np.union1d(found[i], np.flatnonzero(near[i] <= bound[i]))
            at = at[ids[at] != name]
            apart = np.sqrt(((part[i] - vectors[at]) ** 2).sum(axis=1))
            out += [(name, ids[at[j]], apart[j]) for j in np.lexsort((ids[at], apart))[:k]]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: not null, of finite components, not zero, of the most frequent length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def neighbours(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the ``k`` nearest other rows, ties to smaller ids.

    Rows that ``usable`` leaves out are neither queries nor found. Rows that repeat a vec_id count once. Only vec_id and
    embedding are read, so other columns may have any names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).dropDuplicates(["vec_id"])
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    model = spark.sparkContext.broadcast(Quantiser(np.unique(sample, axis=0)))  # copies count once
    n = rows.count()
    blocks, query_blocks = math.ceil(n / VECTOR_BLOCK), math.ceil(n / every / QUERY_BLOCK)

    def encode(batches):
        for b in batches:
            if b.num_rows:
                code = model.value.encode(_matrix(b.column(1), model.value.dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in code], pa.binary())], names=["vec_id", "v", "code"])

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and found.num_rows:
            dim = model.value.dim
            codes = np.frombuffer(b"".join(found["code"].to_pylist()), np.uint8).reshape(found.num_rows, -1)
            out = search_block(model.value, queries["vec_id"].to_numpy(), _matrix(queries["v"], dim), found["vec_id"].to_numpy(), _matrix(found["v"], dim), codes, k)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    index = rows.mapInArrow(encode, "vec_id long, v array<double>, code binary")
    index = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("query_block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["query_block", "block"]
    found = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(search, schema)
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(C.table(spark, sf_dir, "embeddings"))
