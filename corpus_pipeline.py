"""A training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

Stages take (spark, docs, sf_dir).  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import bpe
from corpuslake.llm.common import spool, table
from corpuslake.llm.line_dedup import line_dedup
from corpuslake.llm.mixing import mix
from corpuslake.llm.queries import TOKENIZER
from corpuslake.llm.simhash import near_dedup
from corpuslake.llm.toxicity import reject_toxic

#: The toxicity model and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources' words meet their targets."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    out = bpe.encode(docs.select("doc_id", "text"), path, with_decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("mixing", mixture),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
