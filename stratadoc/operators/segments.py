"""A lexical index that follows its documents: additions are segments, deletions are left out on reading.

A segment holds the blocks and postings of the documents that one update brought, each document under a number of its
own. The table of live documents says which of them count; a document that changed or went is no longer in it, and its
postings stay behind until segments are merged. Block ids are given on reading, in order of the live documents, so an
index that was kept up to date equals one that is built anew. Documents that share an id stand in order of source and text
(of texts that begin alike, by digest), not of the segments that they came with. Each update is published as a whole
(sources.store).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions.text import tokenize
from stratadoc.operators.chunk import fixed_chunks
from stratadoc.operators.index import LexicalIndex, statistics
from stratadoc.session import saved
from stratadoc.sources import store
from stratadoc.sources.corpus import running_sum

LIVE = "doc_id long, source string, digest string, segment string, row long, n_blocks long, head string"
#: Segments above which an update merges them into one.
SEGMENTS = 8
BLOCK = 500
#: Characters of a text that the live documents hold; an index from before they did has none.
HEAD = 64


def digest_of(docs: DataFrame) -> Column:
    """What a document is, beside its id."""
    return F.sha2(F.to_json(F.struct(docs["source"], docs["text"]), {"ignoreNullFields": "false"}), 256)


def live(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """The live documents, and the segments they are in."""
    version = store.published(spark, folder)
    if version is None:
        return spark.createDataFrame([], LIVE), []
    found = spark.read.schema(LIVE).parquet(f"{version}/live")
    return found, sorted(r[0] for r in found.select("segment").distinct().collect())  # SEGMENTS + 1 at most


def _write_segment(docs: DataFrame, folder: str) -> DataFrame:
    """Writes docs (doc_id, source, text, digest) as a segment -> its live rows."""
    name = uuid.uuid4().hex
    path = f"{folder}/segments/{name}"
    docs.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/documents")
    own = docs.sparkSession.read.parquet(f"{path}/documents")
    fixed_chunks(own, BLOCK).select("row", "ord", "text").write.parquet(f"{path}/blocks")
    _write_postings(docs.sparkSession, path)
    n = F.when(F.col("text") == "", 0).otherwise(F.coalesce(F.ceil(F.length("text") / BLOCK), F.lit(0))).cast("long")
    return own.select("doc_id", "source", "digest", F.lit(name).alias("segment"), "row", n.alias("n_blocks"), F.substring("text", 1, HEAD).alias("head"))


def _write_postings(spark: SparkSession, path: str) -> None:
    blocks = spark.read.parquet(f"{path}/blocks")
    terms = blocks.select("row", "ord", F.explode(tokenize(F.col("text"))).alias("term"))
    terms.groupBy("term", "row", "ord").agg(F.count("*").alias("tf")).write.parquet(f"{path}/postings")


def _publish(spark: SparkSession, folder: str, now: DataFrame) -> None:
    version = store.new_version(folder)
    now.select(*(c.split()[0] for c in LIVE.split(", "))).write.parquet(f"{version}/live")
    store.publish(spark, folder, version, {"block": BLOCK})


def _of_segments(spark: SparkSession, folder: str, names: list[str], table: str, schema: str) -> DataFrame:
    parts = [spark.read.schema(schema).parquet(f"{folder}/segments/{s}/{table}").withColumn("segment", F.lit(s)) for s in names]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, segment string")


def _nth(rows: DataFrame, by: str, out: str) -> DataFrame:
    """Numbers the rows of one doc_id and digest from 0, in order of `by`; any number of them."""
    keyed = rows.withColumn("_key", F.to_json(F.struct("doc_id", "digest")))
    return running_sum(keyed, "_key", by, F.lit(1), out)


def update(spark: SparkSession, folder: str, docs: DataFrame) -> dict[str, int]:
    """Makes the index that of docs (doc_id, source, text), all of them: only what is new or changed is cut and indexed.

    Documents are told apart by id, source and text; of repeated ones as many are kept as there are. Null ids are ids.
    Returns how many documents were added and taken away.
    """
    before, _ = live(spark, folder)
    now = _nth(docs.select("doc_id", "source", "text").withColumn("digest", digest_of(docs)).withColumn("_at", F.monotonically_increasing_id()), "_at", "nth").drop("_at")
    now = saved(now, "snapshot")
    then = saved(_nth(before.withColumn("_at", F.xxhash64("segment", "row")), "_at", "nth").drop("_at"), "live-before")
    same = ["_key", "nth"]
    added = now.join(then.select(*same), same, "left_anti")
    kept = then.join(now.select(*same), same, "left_semi")
    return _merge(spark, folder, then, kept, added)


def apply_changes(spark: SparkSession, folder: str, changes: DataFrame) -> dict[str, int]:
    """changes (doc_id, source, text, deleted): a document takes the place of all that have its id, or takes them away.

    The same changes again change nothing. Rows without an id are left out, as they name no document.
    """
    before, _ = live(spark, folder)
    rows = saved(changes.filter("doc_id is not null").withColumn("digest", digest_of(changes)), "changes")
    then = saved(before, "live-before")
    upserts = rows.filter("not deleted").select("doc_id", "source", "text", "digest").dropDuplicates(["doc_id", "digest"])
    known = then.select("doc_id", "digest").distinct()
    touched = rows.select("doc_id").distinct()
    standing = upserts.select("doc_id", "digest")
    kept = then.join(touched, "doc_id", "left_anti").unionByName(then.join(standing, ["doc_id", "digest"], "left_semi"))
    return _merge(spark, folder, then, kept, upserts.join(known, ["doc_id", "digest"], "left_anti"))


def _merge(spark: SparkSession, folder: str, then: DataFrame, kept: DataFrame, added: DataFrame) -> dict[str, int]:
    added = saved(added.select("doc_id", "source", "text", "digest"), "added")
    kept = saved(kept, "kept")
    counts = {"added": added.count(), "removed": then.count() - kept.count()}
    if not any(counts.values()):
        return counts
    columns = [c.split()[0] for c in LIVE.split(", ")]
    now = kept.select(*columns)
    if counts["added"]:
        now = now.unionByName(_write_segment(added, folder).select(*columns))
    if now.select("segment").distinct().count() > SEGMENTS:
        now = _compacted(spark, folder, now)
    _publish(spark, folder, now)
    return counts


def _compacted(spark: SparkSession, folder: str, now: DataFrame) -> DataFrame:
    """The live documents as one segment."""
    now = saved(now, "live-merged")
    names = [r[0] for r in now.select("segment").distinct().collect()]
    texts = _of_segments(spark, folder, names, "documents", "row long, text string")
    return _write_segment(now.join(texts, ["segment", "row"]).select("doc_id", "source", "text", "digest"), folder)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, LexicalIndex]:
    """blocks (i, doc_id, source, content) and the lexical index of the live documents."""
    now, names = live(spark, folder)
    based = running_sum(now.withColumn("_all", F.lit(0)).withColumn("_order", F.struct("doc_id", "source", "head", "digest", "segment", "row")), "_all", "_order", F.col("n_blocks"), "base")
    based = saved(based.select("segment", "row", "doc_id", "source", "base"), "bases")
    own = ["segment", "row"]
    i = (F.col("base") + F.col("ord")).cast("long").alias("i")
    blocks = _of_segments(spark, folder, names, "blocks", "row long, ord int, text string").join(based, own).select(i, "doc_id", "source", F.col("text").alias("content"))
    # Segments hold Han text as overlapping pairs: words would change with every update.
    postings = _of_segments(spark, folder, names, "postings", "term string, row long, ord int, tf long").join(based, own).select("term", i, "tf")
    return blocks, statistics(blocks.select("i"), saved(postings, "postings"))
