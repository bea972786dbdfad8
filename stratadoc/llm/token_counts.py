"""Token counts through a digest cache.

A count is stored under the digest of the content and the digest of the tokenizer (its file and the library's
version). A run joins its documents' digests to the stored counts, encodes each distinct missing content once, and
appends what it found to the cache. No content is encoded twice, in this run or a later one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.session import new_path, saved

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"
#: Bytes of text that one call to the tokenizer gets at most (a single longer text goes alone).
CALL_BYTES = 1 << 20
#: Missing digests up to which they are broadcast, so that cached texts aren't shuffled.
MISSES_SENT = 100_000


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer: its file's bytes, the library and the library's version."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__}|{library.__version__}".encode()).hexdigest()


def _counter(path: str):
    """A function from texts to token counts, by the library that the file is for."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            n, texts, held = [], [], 0
            for text in batch.column("content"):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= CALL_BYTES:
                    n += count(texts)
                    texts, held = [], 0
            n += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encode


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    cache_path is a folder of Parquet files that outlives the run (made when missing); None takes a new one in the
    shared folder. The tokenizer's file must be readable on the executors. Null text counts as empty (0 bytes, 0
    tokens). Repeated rows and repeated doc_ids give a row each. Columns other than doc_id and text are not looked at.
    An empty table gives an empty result. Counts are those of the whole text, special strings in it as the library
    handles them by default, without added begin, end or special tokens.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_path(spark, "token-cache")
    name = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", content.alias("content")).withColumn("digest", F.sha2("content", 256))

    # An append of no rows: makes the folder when it is missing and leaves it as it is otherwise.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == name)
    # The cache is asked with digests alone; texts move only where they are missing.
    missing = saved(rows.select("digest").distinct().join(cached.select("digest"), "digest", "left_anti"), "missing-digests")
    if missing.count() <= MISSES_SENT:
        misses = rows.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    else:
        # Copies meet within a task before they are shuffled, so a text with a third of all rows is no hot key.
        misses = rows.groupBy("digest").agg(F.first("content").alias("content")).join(missing, "digest", "left_semi")
    found = misses.mapInArrow(_encoder(tokenizer_path), "digest string, n_tokens long")
    found.select(F.lit(name).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    # Two runs that append at once may both store a content: one row of each digest is taken. As a table of its own, so
    # that the join below can be split where a third of all rows have one digest.
    known = saved(
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == name)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")),
        "known-counts",
    )
    return (
        rows.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
        .join(known, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
