"""From raw documents to a training mix: five stages, each over all that the one before it kept.

    toxicity     documents that the toxicity operator rejects go
    line_dedup   lines on many sources go, all but their first occurrence; every document stays
    simhash      of each group of near duplicates one document stays, that with the smallest id; near are documents whose sets
                 of five-word shingles have a Jaccard similarity of 0.8 or more, found by wide SimHash fingerprints in the
                 Gray-order index (op3's own query has a contract of its own: three words, 3 of 64 bits)
    decontaminate  benchmark passages go; documents that consist of them nearly throughout go whole
    mixing       documents of the mix, with the words (spans, by slot) that the mix takes of each

Stages but the last return the columns of documents, n_chars for the text as it has become.

Rows are told apart by themselves, never by doc_id: rows with a null or a repeated doc_id, equal rows among them, each go
through every stage as a row. A null text is clean, has no lines, words or passages, is a near duplicate of every other
text without words, and has nothing for the mix to take. Null sources are one source, null lang and n_chars pass through.
An empty table gives an empty result at every stage; columns beside those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm import decontaminate, line_dedup, mixing, near_texts, toxicity
from stratadoc.session import saved, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


CARRY = ("lang", "source")


def _as_documents(changed: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=("text", *CARRY, "n_chars"))
    return found.filter("predicted = 0").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _as_documents(line_dedup.line_dedup(docs, carry=CARRY))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_texts.first_of_each(docs.select(*COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _as_documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=CARRY))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixture(docs, carry=tuple(COLUMNS)).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: The first stage is a learned model, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
