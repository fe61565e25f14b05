"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_extract import op6_html_extraction
from .line_dedup import op1_line_dedup
from .media import op3_media_columns
from .mixing import op4_mixing
from .nearest import op7_nearest_neighbours
from .ngram_join import op10_ngram_join
from .packing import op9_packing
from .quality import op2_quality_classifier
from .substring_dedup import op8_substring_dedup
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_media_columns, op4_mixing, op5_toxicity, op6_html_extraction, op7_nearest_neighbours, op8_substring_dedup, op9_packing, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {}
