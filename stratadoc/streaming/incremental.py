"""Incremental indexing: an index follows a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratadoc.operators import segments
from stratadoc.operators.index import LexicalIndex


def index_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """docs: a stream of doc_id, source, text, and deleted where it has it. The index under out takes each batch.

    A document that comes again as it was changes nothing, so a batch that is run again doesn't either; one that comes
    with another text takes the old one's place. Of one id in a batch that comes with several texts all are taken.
    """
    changes = docs if "deleted" in docs.columns else docs.withColumn("deleted", F.lit(False))

    def append(batch: DataFrame, _: int) -> None:
        segments.apply_changes(batch.sparkSession, out, batch)

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("doc_id long, source string, text string").json(path)


def postings_of(spark: SparkSession, out: str) -> LexicalIndex:
    """The lexical index over what has come so far."""
    return segments.load(spark, out)[1]
