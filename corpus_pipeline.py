"""From documents to token ids in five stages; each is written and read again before the next.

toxicity -> exact copies -> near copies -> benchmark passages -> encoding.  Each stage
works on the rows that the one before kept.  All but the last return the columns of
`documents`; the last adds the token ids and the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linklens.llm import common as C
from linklens.llm import op1_template_join as templates
from linklens.llm import op2_bpe_chunks as bpe
from linklens.llm import op3_toxic_spans as toxic
from linklens.llm import op5_hamming_join as near
from linklens.llm import op6_exact_dedup as exact


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go."""
    return toxic.drop_toxic(docs, C.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space one stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return templates.drop_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of what is left."""
    return bpe.encoded(docs).drop("row")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result is a table in the folder of spark.checkpoint.dir."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Neither the model of the first stage nor the similarity of the third can be put in SQL.
ORACLE_SQL = None
