"""From raw documents to packed training sequences, a written table between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm.common import checkpointed, read_table
from attestry.llm.exactdedup import keep_first_copy
from attestry.llm.langid import keep_known_language
from attestry.llm.packing import pack_stage
from attestry.llm.simhash import keep_one_of_each_group
from attestry.llm.suffixdedup import cut_repeats

#: Name and function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", keep_first_copy),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack_stage),
]

#: SQL has neither the classifier nor the tokenizer; tests hold the first four stages against plain Python and the packing against the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, in order.

    Defined results are those of the stages: null and empty texts, repeated rows and
    null or shared identifiers are treated as each says; an empty table gives none.
    """
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
