"""From raw documents to token ids, in five stages that each work on what the last one kept.

Every stage is written whole to the shared folder and read again, so a lost executor costs a
stage at most. Defined results: documents whose text is null, empty or without letters have
no language and go in the first stage; those under 50 words go in the second; of rows that
repeat a doc_id or a text one stays after the third, rows without a doc_id all stay; an
empty table gives an empty result; very long texts go through whole; extra columns are
carried up to the last stage, whatever their names, and ties are settled by the stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gablestone.llm.bpe import encode_documents
from gablestone.llm.common import Scratch, read
from gablestone.llm.decontaminate import remove_contaminated
from gablestone.llm.language_id import keep_identified
from gablestone.llm.near_dups import keep_one_of_each
from gablestone.llm.quality_rules import filter_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("quality_rules", filter_documents),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", remove_contaminated),
    ("bpe", encode_documents),
]

#: Learned models and iteration are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
