"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet to the
shared folder and read again. All but the last return the columns of documents. SQL can express neither the classifier nor the
tokens, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds run(), stage by stage, against a plain restatement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common, line_dedup, mixing, ngram_join, packing, quality
from seqloom.llm.filters import BitFilter

#: What a packing worker remembers: less than by default, as it shares the executor with the heap that the stages before have grown.
MEMO = 16_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    A null text is judged as an empty one; rows with a null id are judged, but not learnt from; equal texts stay or go together,
    also under one id. Without labels of good quality all stay. An empty table gives an empty result.
    """
    return quality.accepted(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later near-duplicate lines out of the texts. No document goes, also where no line is left.

    Rows without an id or a text are left as they are; rows that repeat an id are one document. Columns may have any names
    but lines and lines_removed. An empty table gives an empty result.
    """
    return line_dedup.deduplicated(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group; documents without an id or without words all stay.

    Rows that repeat an id stay or go together. Columns may have any names. An empty table gives an empty result.
    """
    groups = ngram_join.near_duplicates(docs)
    gone = common.kept(groups.where("component_id < doc_id").select("doc_id").distinct(), "dropped")
    some = BitFilter(gone, ngram_join.FILTER_BITS)

    @F.pandas_udf("boolean")
    def may_go(slot):
        import pandas as pd

        return pd.Series(some.hit(slot.to_numpy("int64")))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    hit = F.coalesce(may_go(some.slot("doc_id")), F.lit(False))
    return rows.where(~hit).unionByName(rows.where(hit).join(gone, "doc_id", "left_anti")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out words so that the sources come near their target shares.

    A null source is a source of its own, a null id is an id like others, rows that repeat are documents of their own. Rows
    without words, and those the mix takes nothing of, go. An empty table gives an empty result.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack: one row per piece, with its token ids and its place in a sequence.

    A null or empty text is one closing id; a null id is kept; each row is a document of its own, also where rows repeat. An
    empty table gives an empty result.
    """
    return packing.pack(docs, memo=MEMO)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
