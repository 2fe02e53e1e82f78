"""A training corpus from `documents`: rules, classifier, line dedup, near copies, packing. Counts as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns the columns of documents; the last one packs.
Null texts count as empty, so rules reject them; rows with a null doc_id are never near copies; of repeated rows all stay or go; names that
clash by case do no harm; a stage of no rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, packing, quality_model, quality_rules, simhash
from quern.llm.common import numbered, place
from quern.llm.queries import QUALITY_THRESHOLD, quality_machine, table, vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learnt from all labelled documents' sample, scores high enough."""
    machine = quality_machine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.keep(docs, machine, threshold=QUALITY_THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that many documents hold; n_chars follows the text. Other columns stay as they are."""
    flat, text = numbered(docs), place(docs, "text")
    kept = numbered(line_dedup.dedup(flat, id_col=f"_c{place(docs, 'doc_id')}", text_col=f"_c{text}"))
    chars = [i for i, c in enumerate(docs.columns) if c == "n_chars"]
    out = [(F.length(f"_c{text}").cast("long") if i in chars else F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(docs.columns))]
    return kept.select(*out).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8), that of the least id."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("packing", pack)]

#: The machine, the classes and the tokens can't be expressed in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
