"""Corpus pipeline: the stages in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and any table with the columns of documents; further columns
pass through all stages but the last. Nulls: a document without text, or with a text without letters,
goes in the first stage; null ids, labels and sources are kept as they are (ids come last where one
of a group is chosen; a null source is a source of its own). Repeated rows are copies of each other.
Texts are read whole, whatever their length. Empty tables give empty tables.

Stages set the session's bound of Arrow batches where it has none of its own; ``run`` puts it back
and removes what was written on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, langid, mixing, secrets, shingles
from marlstone.session import batches_as_before, bounded_batches, free_name, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing label is filled in, and labels that are there stay.

    Null and empty texts and texts without a letter have none. With no labelled document to learn from, all go.
    """
    bounded_batches(spark)
    out = free_name(docs, "found")
    found = langid.identify(docs, out=out).where(F.col(f"{out}.lang") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", f"{out}.lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays.

    It is that of the smallest id, null ids last; of repeated rows any one. Texts without words are one group.
    """
    bounded_batches(spark)
    return shingles.one_of_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and ``n_chars`` counted anew; all documents stay. A null text stays null (n_chars null)."""
    bounded_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes, a row each, ``n_chars`` counted anew.

    A document taken whole keeps its text. Documents without words have nothing to take and go.
    """
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to; a null text counts as empty and has no tokens."""
    bounded_batches(spark)
    out = free_name(docs, "coded")
    coded = docs.withColumn(out, bpe.coded("text", bpe.default_path(), spark))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size(f"{out}.ids").cast("long").alias("n_tokens"), F.col(f"{out}.ids").alias("ids"), F.col(f"{out}.decoded").alias("decoded"))


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mix", source_mix),
    ("BPE coding", bpe_coding),
]

ORACLE_SQL = None  # fingerprints, automata and token ids have no SQL form; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder. A stage's table goes when the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    with batches_as_before(spark), scratch(spark) as whole:
        for name, stage in STAGES:
            before = docs
            with scratch(spark) as own:
                docs = own.keep(written(stage(spark, before, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
            whole.drop(before)
        whole.keep(docs)
    return docs
