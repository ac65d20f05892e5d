"""From raw documents to packed training sequences, in five stored stages.

Each stage works on all that its predecessor kept and returns the columns of its input (the last one packed pieces).  A null or
empty text has no language and goes in the first stage; a null id is a row like any other; repeated rows and near copies leave
one document a group, of equal ids any one; a very long text is worked on whole by one task; extra columns pass through all stages but the last; an empty table passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, packing, secrets, simhash
from millrace.llm.common import release, staged, table, texts
from millrace.llm.queries import fold


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; null and empty texts, those without letters and those of no clear language go.

    Repeated rows and null ids are judged each by its text; a text is read whole; an empty table stays empty, extra columns stay."""
    model = langid.train(docs.filter(fold(4) != 2).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group (nulls last; of repeated rows any one).

    Null and empty texts are one group; texts are compared whole; an empty table stays empty, extra columns stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text.

    Null and empty texts stay, as do all without an item of words; repeated rows go or stay together; extra columns stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and blanks their secrets, base findings and the network's.

    Null and empty texts stay as they are; repeated rows stay; n_chars, if there, follows the text; other columns stay."""
    return secrets.redact(docs, secrets.train(texts(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; null and empty texts are the closing token, a long text many pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: Trained models and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
