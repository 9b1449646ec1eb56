"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .language_id import op6_language_id
from .licenses import OP5_SQL, op5_license_scan
from .media import op7_media
from .mixing import op1_mixing
from .ngram_join import op3_ngram_join
from .token_counts import op2_token_counts
from .topk import OP9_SQL, op9_topk
from .toxicity import op8_toxicity
from .warc import OP10_SQL, op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_token_counts": op2_token_counts,
        "op3_ngram_join": op3_ngram_join,
        "op4_bpe": op4_bpe,
        "op5_license_scan": op5_license_scan,
        "op6_language_id": op6_language_id,
        "op7_media": op7_media,
        "op8_toxicity": op8_toxicity,
        "op9_topk": op9_topk,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": OP5_SQL, "op9_topk": OP9_SQL, "op10_warc": OP10_SQL}
