"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import near_dedup, suffix_dedup
from .bpe import op2_bpe
from .decontaminate import op3_decontaminate
from .fingerprints import op7_fingerprints
from .near_dedup import op5_near_dedup
from .quality import op1_quality
from .sharding import op8_sharding
from .suffix_dedup import op10_suffix_dedup
from .token_files import op6_token_files
from .toxicity import op9_toxicity
from .url_filter import op4_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_bpe": op2_bpe,
        "op3_decontaminate": op3_decontaminate,
        "op4_url_filter": op4_url_filter,
        "op5_near_dedup": op5_near_dedup,
        "op6_token_files": op6_token_files,
        "op7_fingerprints": op7_fingerprints,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_suffix_dedup": op10_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": near_dedup.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE}
