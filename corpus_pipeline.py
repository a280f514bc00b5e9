"""The corpus pipeline: five stages from raw documents to verified token ids.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread
as the next one's ``docs``. All but the last return the columns of ``documents``, further
ones of any name with them.

Defined edge cases, for every stage: a null text counts as empty and stays null; null and
repeated doc_ids are kept and told apart by their texts; no stage caps or samples rows; an
empty table gives an empty one. Empty texts are neither toxic nor copies nor contaminated and
have no tokens. Rows that repeat in id and text are copies of one another: one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm._common import cut
from pagewright.llm.bpe import bpe_round_trip
from pagewright.llm.decontaminate import drop_contaminated
from pagewright.llm.near_dedup import keep_one
from pagewright.llm.suffix_dedup import remove_repeats
from pagewright.llm.toxicity import reject_toxic

#: Bytes of a repeated passage: about 50 words of running text take more.
REPEAT_BYTES = 240


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; without confirmed examples all stay."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id (null
    first); texts without words all stay."""
    return keep_one(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, all occurrences; texts shorter than a passage stay as
    they are, and a text of passages only becomes empty."""
    return remove_repeats(docs, REPEAT_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item's question and answer go; without items all stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each remaining text, encoded and decoded."""
    return bpe_round_trip(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL can't express learned scores, signatures or token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
