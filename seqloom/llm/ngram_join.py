"""N-gram Jaccard join by parity sketches, and the groups of near-duplicate documents that it links.

A document's set holds its distinct word shingles. The hash of a set's shingles is XOR-ed into blocks of a bit sketch:
two sets then differ in at most |A xor B| blocks, and Jaccard >= t bounds |A xor B| by (|A| + |B|)(1 - t)/(1 + t). So of the
first D + 1 non-empty blocks of the shorter prefix at least one is equal (pigeonhole), and equal blocks are an equi-join.
Blocks are counted per size band, and a set near the lower edge of its band is also a guest in the band below.

Shingles that many sets hold would link strangers, so blocks are made of the others, as long as those blocks still outnumber D
(space 0). A set with too few others is poor. It sends blocks of all its shingles (space 1), and so does each set that could be
similar to a poor one; strangers meet there only if one of them is poor.

Within the documents that share a block every one is compared with a first one (a star). Where a star leaves several
components, members of different components are compared too. Unequal bits of two parity sketches bound the difference of their
sets from below: a short sketch, then a wide one that grows with the set, turn pairs away before their texts are moved.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .filters import BitFilter
from .graphs import components

WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Bits of the short sketch that is compared first, in 64-bit words.
SKETCH_WORDS = 8
#: Kinds of rows, added to the number of the set's shingles that are not frequent: poor sets 0, guests among them, space 0.
GUEST, OPEN = 1 << 40, 1 << 41
#: Share of a set that has to be left without frequent shingles, or the set is poor: above the differing share, 1/4.
LEFT = 0.28
#: Blocks of a sketch for each shingle of the largest set of a band: most blocks get one shingle or none.
BLOCKS = 4
#: Sets, counted in blocks of TOKENS shingles, from which on a shingle is frequent.
FREQUENT, TOKENS, MOST_BITS = 12, 1 << 22, 27
#: Documents of a task that counts shingles: in few of them a frequent one would not show.
COUNTED = 20_000
#: log2 of the bits in the filter that spares unneeded texts; a fuller filter lets more texts pass, nothing else.
FILTER_BITS = 23


def shingle_sets(column: pa.Array, width: int = WIDTH):
    """For each text its word count and its sorted distinct shingle hashes; fewer words than ``width`` make one shingle."""
    data, bounds = C.text_bytes(column)
    starts, ends, counts = C.word_bounds(data, bounds)
    words = C.hash_words(data, starts, ends, fold_case=True)
    runs, _, n = C.windows(words, counts, width)
    first, at = C.offsets(counts), C.offsets(n)
    for i, count in enumerate(counts.tolist()):
        if count >= width:
            found = np.sort(runs[at[i] : at[i + 1]])
            fresh = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            yield count, found[fresh]
        elif count:
            yield count, C.hash_spans(words, first[i : i + 1], first[i + 1 : i + 2])
        else:
            yield 0, np.zeros(0, np.uint64)


class Blocks:
    """The blocks of a set's sketch that the join compares, for one similarity."""

    def __init__(self, similarity: Fraction = SIMILARITY):
        self.t = float(similarity)
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] / self.t**3)))
        self.low = np.array(self.low)

    def differing(self, n: int) -> int:
        """Most shingles in which a set of ``n`` differs from any set that is similar to it."""
        return int(n * (1 / self.t + 1) * (1 - self.t) / (1 + self.t) + 1e-9)

    def wanted(self, n: int) -> int:
        return self.differing(n) + 1

    def bands(self, n: int) -> list[int]:
        """The band of a set's size, and the one below if a set of that band can be similar to it."""
        own = int(np.searchsorted(self.low, n, "right")) - 1
        return [own, own - 1] if own and np.ceil(n * self.t - 1e-9) < self.low[own] else [own]

    def keys(self, tokens: np.ndarray, n: int, space: int) -> np.ndarray:
        """Keys of ``tokens``, which are all or some of a set of ``n``."""
        return np.concatenate([self._in_band(tokens, n, band, space) for band in self.bands(n)])

    def _in_band(self, tokens: np.ndarray, n: int, band: int, space: int) -> np.ndarray:
        wanted, above = self.wanted(n), int(self.low[band + 1])
        salt = np.uint64((2 * band + space + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if above <= 64 or not len(tokens):  # each token is a block of its own
            return C.mixed(tokens[:wanted] ^ salt)
        block = (tokens >> np.uint64(32)) * np.uint64(BLOCKS * above) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity, at = np.bitwise_xor.reduceat(tokens, start)[:wanted], block[start][:wanted]
        return C.mixed(parity ^ C.mixed(at + salt))


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _sketch(tokens: np.ndarray, bits: int = 64 * SKETCH_WORDS) -> np.ndarray:
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(tokens: np.ndarray) -> bytes | None:
    """A sketch with a bit for each shingle at least, where the short one has fewer; its length is a power of two."""
    bits = 1 << max(0, len(tokens) - 1).bit_length()
    return _sketch(tokens, bits).tobytes() if bits > 64 * SKETCH_WORDS else None


def _apart(p: bytes, q: bytes) -> int:
    """In how many bits two wide sketches differ, the longer one folded to the length of the other: never more than the sets do."""
    p, q = sorted((np.frombuffer(x, np.uint64) for x in (p, q)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _describe(batches):
    for part in C.chunks(batches):
        ids, rows = part.column(0), []
        for count, s in shingle_sets(part.column(1)):
            total = int(s.sum(dtype=np.uint64)) if len(s) else 0
            rows.append((count, len(s), total, int(np.bitwise_xor.reduce(C.mixed(s))) if len(s) else 0, _sketch(s), _wide(s)))
        count, n, one, two, sketch, wide = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(_signed(one)), pa.array(_signed(two)), *(pa.array(x) for x in np.stack(sketch, axis=1).copy()), pa.array(wide, pa.binary())],
            names=["doc_id", "n_words", "n_shingles", "one", "two", *(f"s{i}" for i in range(SKETCH_WORDS)), "wide"],
        )
    C.trim()


def _fresh_sets(batches):
    """(doc, set) of the sets that the task has not seen; equal sets are joined by their hash elsewhere."""
    seen = set()
    for part in C.chunks(batches):
        for doc, (_, s) in zip(part.column(0).to_pylist(), shingle_sets(part.column(1))):
            same = (len(s), int(s.sum(dtype=np.uint64)), int(s[0])) if len(s) else None
            if same is not None and doc is not None and same not in seen:
                seen.add(same)
                yield doc, s


def _repeated(batches):
    """(token, n): shingles that several sets of a block hold.

    A block fills one array, is sorted there, and only runs of equal shingles are copied out of it. A set that reaches beyond a
    block goes on in the next one.
    """
    held, size = np.empty(TOKENS, np.uint64), 0

    def count(tokens):
        tokens.sort()
        edge = np.diff((tokens[1:] == tokens[:-1]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(_signed(tokens[start])), pa.array(end - start + 1)], names=["token", "n"])

    for _, s in _fresh_sets(batches):
        while len(s):
            part = s[: TOKENS - size]
            held[size : size + len(part)] = part
            size, s = size + len(part), s[len(part) :]
            if size == TOKENS:
                yield count(held)
                size = 0
    if size:
        yield count(held[:size])
    del held
    C.trim()


def _emit(frequent: BitFilter):
    """Rows (key, doc, rank); rank tells the kind of the row and, in space 1, how many of the set's shingles are not frequent."""

    def run(batches):
        blocks, out, size = Blocks(), [], 0
        for doc, s in _fresh_sets(batches):
            n = len(s)
            if not blocks.differing(n):
                continue
            rare = s[~frequent.hit_hashes(s)]
            poor = len(rare) <= LEFT * n + 2
            # a set similar to a poor one has at most the poor one's others and D more
            guest = len(rare) <= (LEFT + 0.25) * 1.25 * n + 4
            todo = ([] if poor else [(rare, 0, OPEN)]) + ([(s, 1, len(rare) + (0 if poor else GUEST))] if guest else [])
            for tokens, space, rank in todo:
                keys = blocks.keys(tokens, n, space)
                out.append((keys, np.full(len(keys), doc, np.int64), np.full(len(keys), rank, np.int64)))
                size += len(keys)
            if size > 1 << 16:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)
        C.trim()

    return run


def _rows(parts):
    key, doc, rank = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(doc), pa.array(rank)], names=["key", "doc", "rank"])


def _stars(batches):
    """All rows of a partition, grouped by key: those with a partner, each with the group's first document and its size.

    Poor sets come first. A group of guests only is left out: its members meet in space 0.
    """
    got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return
    key, doc, rank = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.lexsort((doc, rank, key))
    key, doc, rank = key[order], doc[order], rank[order]
    del order
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    keep = np.repeat((size > 1) & ((rank[start] < GUEST) | (rank[start] == OPEN)), size)
    leader, size = np.repeat(doc[start], size), np.repeat(size, size)
    for a in range(0, len(key), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[part][keep[part]]) for x in (key, doc, leader, size, rank)], names=["key", "doc", "leader", "size", "rank"])
    del key, doc, rank, leader, size, keep
    C.trim()


def _near_enough(batches):
    """The (a, b) of those rows (a, b, n_a, wide_a, n_b, wide_b) whose wide sketches allow the similarity, or lack."""
    t, u = SIMILARITY.numerator, SIMILARITY.denominator
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
        keep = pa.array([p is None or q is None or _apart(p, q) * (t + u) <= (m + n) * (u - t) for m, p, n, q in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _similar(batches):
    """The (a, b) of those rows (a, b, text_a, text_b) whose texts' sets are similar."""
    t, u = SIMILARITY.numerator, SIMILARITY.denominator
    for batch in batches:
        for part in C.chunks([batch], "text_a"):
            keep = []
            for (_, p), (_, q) in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3))):
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * u >= (len(p) + len(q) - both) * t)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])


def _near(side: DataFrame, tag: str) -> DataFrame:
    return side.select(*(F.col(c).alias(f"{c}_{tag}") for c in side.columns))


def _sizes():
    """The sizes of x and y allow the similarity."""
    a, b = F.col("n_shingles_x"), F.col("n_shingles_y")
    return SIMILARITY.denominator * F.least(a, b) >= SIMILARITY.numerator * F.greatest(a, b)


def _sketches():
    """The sketches of x and y differ in no more bits than the similarity allows."""
    apart = sum((F.bit_count(F.col(f"s{i}_x").bitwiseXOR(F.col(f"s{i}_y"))) for i in range(SKETCH_WORDS)), F.lit(0))
    t, u = SIMILARITY.numerator, SIMILARITY.denominator
    return apart * (t + u) <= (F.col("n_shingles_x") + F.col("n_shingles_y")) * (u - t)


def _ranks():
    """One of x and y is poor, or both are in space 0; and their frequent and other shingles differ in number by little enough."""
    r = {k: F.when(F.col(f"rank_{k}") >= OPEN, 0).otherwise(F.col(f"rank_{k}") % GUEST) for k in "xy"}
    n = {k: F.col(f"n_shingles_{k}") for k in "xy"}
    t, u = SIMILARITY.numerator, SIMILARITY.denominator
    apart = F.abs(r["x"] - r["y"]) + F.abs(n["x"] - r["x"] - n["y"] + r["y"])
    least = F.least("rank_x", "rank_y")
    return ((least < GUEST) | (least >= OPEN)) & (apart * (t + u) <= (n["x"] + n["y"]) * (u - t))


def _sketched(pairs: DataFrame, lead: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and sketches allow the similarity: unequal bits bound the difference from below."""
    both = pairs.join(_near(lead, "x").withColumnRenamed("first_x", "a"), "a").join(_near(lead, "y").withColumnRenamed("first_y", "b"), "b")
    return both.where(_sizes() & _sketches()).select("a", "b")


def _needed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...) that ``pairs`` (a, b) need, and a few more; the others stay where they are."""
    need = BitFilter(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), FILTER_BITS)

    def wanted(batches):
        for b in batches:
            got = need.hit_rows(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([c.filter(got) for c in b.columns[:-1]], names=b.schema.names[:-1])

    return rows.where("doc_id is not null").withColumn("slot", need.slot("doc_id")).mapInArrow(wanted, rows.schema)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets are similar.

    The short sketch tells nothing of sets with many more shingles than it has bits. Wide sketches turn those strangers away, so
    that only the texts of likely pairs are moved.
    """
    pairs = C.kept(pairs, "pairs")
    wide = _needed(sets.select("doc_id", "n_shingles", "wide"), pairs)
    x, y = (wide.toDF(k, f"n_{k}", f"wide_{k}") for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
    pairs = C.kept(both.mapInArrow(_near_enough, "a long, b long").distinct(), "near")
    texts = _needed(docs, pairs)
    x, y = (texts.toDF(k, f"text_{k}") for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_similar, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_shingles, component_id.

    Two documents link when their sets of five-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more; the
    component is the smallest doc_id that links reach. A null or blank text has no shingles and stays alone. A row with a null
    doc_id links with nothing and has a null component. Rows that repeat a doc_id with equal text give equal rows. Only doc_id
    and text are read, so other columns may have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, n_words long, n_shingles long, one long, two long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)) + ", wide binary"
    sets = C.kept(docs.mapInArrow(_describe, fields), "sets")
    same = sets.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("first"))
    members = C.kept(sets.join(same, ["n_shingles", "one", "two"], "left").select("doc_id", "n_words", "n_shingles", "first", *(f"s{i}" for i in range(SKETCH_WORDS))), "members")
    lead = members.where("doc_id = first").drop("doc_id", "n_words").dropDuplicates(["first"])
    first_of = members.where("first is not null").select("doc_id", "first").distinct()

    often = C.kept(docs.coalesce(max(1, docs.count() // COUNTED)).mapInArrow(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("token"), "often")
    frequent = BitFilter(often, min(MOST_BITS, max(20, 4 + often.count().bit_length())), hashed=True)
    blocks = docs.mapInArrow(_emit(frequent), "key long, doc long, rank long").repartition(C.partitions(spark), "key")
    stars = C.kept(blocks.mapInArrow(_stars, "key long, doc long, leader long, size long, rank long"), "stars")
    pairs = stars.where("doc <> leader").select("doc", "leader").distinct()
    pairs = pairs.join(first_of.toDF("doc", "x"), "doc").join(first_of.toDF("leader", "y"), "leader").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = C.kept(_verified(_sketched(pairs, lead), sets, docs), "links")
    root = C.kept(components(links), "roots")

    # What the stars leave: blocks whose documents are still in several components.
    owner = first_of.join(root.toDF("first", "root"), "first", "left").select("doc_id", "first", F.coalesce("root", "first").alias("root"))
    rows = stars.where("size > 2").join(owner.withColumnRenamed("doc_id", "doc"), "doc").select("key", "first", "root", "rank").distinct()
    open_keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    # the sketches go with the rows, so that the join itself turns strangers away and only likely pairs leave it
    rows = C.kept(rows.join(open_keys, "key", "left_semi").join(lead, "first"), "open")
    x, y = _near(rows, "x").withColumnRenamed("key_x", "key"), _near(rows, "y").withColumnRenamed("key_y", "key")
    rest = x.join(y, "key").where((F.col("first_x") < F.col("first_y")) & (F.col("root_x") != F.col("root_y")) & _ranks() & _sizes() & _sketches())
    more = _verified(rest.select(F.col("first_x").alias("a"), F.col("first_y").alias("b")).distinct(), sets, docs)
    root = components(C.kept(links.unionByName(more), "links"))

    return members.join(root.toDF("first", "root"), "first", "left").select("doc_id", "n_words", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "first", "doc_id")).alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_words")
