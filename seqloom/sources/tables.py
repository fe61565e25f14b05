"""Readers: ordered symbol and word streams out of tables and annotated text, with integrity checks; writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENS = "book string, tok_pos long, token string"


def mark_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as symbol streams: (book, pos, sym), one book per user in time order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("book"), "ts", "event_id", F.col("event_type").alias("sym"))
    by = Window.partitionBy("book").orderBy("ts", "event_id")
    return by_book(rows).select("book", (F.row_number().over(by) - 1).cast("long").alias("pos"), "sym")


#: Input bytes that one task takes at most, as the reader reckons them.
TASK_BYTES = 2 << 20


def by_book(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by book to as many tasks as the session has shuffle partitions, or more where the input is large.

    Given by number, because rows that compress well would else be put together by their compressed size into a few large tasks.
    What groups by book and more needs no further shuffle.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(own, min(size // TASK_BYTES, 10_000)), "book")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as token streams (book, tok_pos, token): a line end is the marker {nl}."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    tokens = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" {nl} ")), " +"), lambda x: x != "")
    rows = rows.select(F.col("doc_id").alias("book"), "lang", F.posexplode(tokens).alias("tok_pos", "token"))
    return rows.withColumn("tok_pos", F.col("tok_pos").cast("long"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (book, lang, text), dealt by book: all that is done by book afterwards needs no shuffle of words."""
    return by_book(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("book"), "lang", "text"))


def annotated_text(spark: SparkSession, path: str) -> DataFrame:
    """Annotated text files as (book, tok_pos, token); a byte-order mark is dropped, the book is the file's name."""
    rows = spark.read.text(path, wholetext=True)
    clean = F.trim(F.regexp_replace("value", "﻿", ""))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_taamim_annotated)?\.txt$", 1)
    tokens = F.filter(F.split(clean, r"\s+"), lambda x: x != "")
    return rows.select(name.alias("book"), F.posexplode(tokens).alias("tok_pos", "token")).withColumn("tok_pos", F.col("tok_pos").cast("long"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, sidecars: str, field: str = "output_sha256") -> DataFrame:
    """file_hashes joined with the hash that each file's JSON sidecar (<file>.meta.json) states: path, sha256, stated, ok."""
    stated = spark.read.json(sidecars, multiLine=True).select(F.regexp_replace(F.input_file_name(), r"\.meta\.json$", "").alias("key"), F.lower(field).alias("stated"))
    found = file_hashes(spark, path).withColumn("key", F.regexp_replace("path", "^file:/+", "/"))
    stated = stated.withColumn("key", F.regexp_replace("key", "^file:/+", "/"))
    fine = F.coalesce(F.col("stated").rlike("^[0-9a-f]{64}$") & (F.col("stated") == F.col("sha256")), F.lit(False))
    return found.join(stated, "key", "left").select("path", "sha256", "stated", fine.alias("ok"))


def verse_spans(spark: SparkSession, path: str) -> DataFrame:
    """Canonical spans from nested JSON {he: [[verse text]]}: book, ordinal, chapter, verse, first_word, end_word, words."""
    rows = spark.read.schema("book string, he array<array<string>>").json(path, multiLine=True)
    verses = rows.select("book", F.posexplode("he").alias("chapter", "verses")).select("book", "chapter", F.posexplode("verses").alias("verse", "text"))
    words = verses.withColumn("words", F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")).cast("long"))
    by = Window.partitionBy("book").orderBy("chapter", "verse")
    end = F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return words.select("book", F.row_number().over(by).cast("long").alias("ordinal"), F.col("chapter") + 1, F.col("verse") + 1, (end - F.col("words")).alias("first_word"), end.alias("end_word"), "words").toDF("book", "ordinal", "chapter", "verse", "first_word", "end_word", "words")


def span_faults(spans: DataFrame) -> DataFrame:
    """Rows of verse spans that are empty, out of order, or do not begin where the one before ends."""
    by = Window.partitionBy("book").orderBy("ordinal")
    before = F.coalesce(F.lag("end_word").over(by), F.lit(0))
    rank = F.row_number().over(by)
    return spans.withColumn("_bad", (F.col("first_word") != before) | (F.col("end_word") <= F.col("first_word")) | (F.col("ordinal") != rank)).where("_bad").drop("_bad")


def same_version(requested, returned):
    """Whether two version titles agree when case and punctuation are left out."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return fold(requested) == fold(returned)


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that JSON cannot hold become null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(~bad(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, tab: bool = False) -> None:
    """CSV (or TSV) with a header; an earlier result under the path goes first."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tab else ",").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def canonical_hash(value) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
