"""Answer runs: prompts go to a model that is plugged in, and what its replies cost is summed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.session import saved

#: Where replies carry their token counts; the cache's hits are looked for in both places, the later one first.
INPUT, OUTPUT = "$.usage_metadata.input_tokens", "$.usage_metadata.output_tokens"
HITS = ("$.response_metadata.prompt_cache_hit_tokens", "$.usage_metadata.input_token_details.cache_read")
MISSES = "$.response_metadata.prompt_cache_miss_tokens"
#: Fixed value: inputs of one arm that differ by more than this weren't the same material.
INPUT_MARGIN = 2000


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str]], keep: list[str]) -> DataFrame:
    """keep's columns and answer, for prompts (prompt); model answers a batch of prompts in a task. A null prompt is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = model([p or "" for p in batch.column("prompt").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(replies, pa.string())], [*keep, "answer"])

    kinds = [f"{c} {prompts.schema[c].dataType.simpleString()}" for c in keep]
    return prompts.select(*keep, "prompt").mapInArrow(run, ", ".join([*kinds, "answer string"]))


CACHE = "digest string, answer string"


def remembered(prompts: DataFrame, model: Callable[[list[str]], list[str]], keep: list[str], folder: str) -> DataFrame:
    """keep's columns, digest and answer, as answered() has them, but no prompt is asked twice: replies stay in folder
    under the digest of their prompt, in this run and for later ones. A run that broke off goes on where it ended."""
    spark = prompts.sparkSession
    rows = saved(prompts.select(*keep, F.coalesce(F.col("prompt"), F.lit("")).alias("prompt")).withColumn("digest", F.sha2("prompt", 256)), "prompts")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(folder)
    known = spark.read.schema(CACHE).parquet(folder).select("digest").distinct()
    new = rows.join(known, "digest", "left_anti").groupBy("digest").agg(F.first("prompt").alias("prompt"))
    answered(new, model, ["digest"]).write.mode("append").parquet(folder)
    # Two runs at once may both ask; one reply of each is taken.
    replies = spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.min("answer").alias("answer"))
    return rows.drop("prompt").join(replies, "digest").select(*keep, "digest", "answer")


def usage_of(reply: Column) -> dict[str, Column]:
    """input_tokens, output_tokens, cache_hit and cache_miss of a reply's JSON; null where it doesn't say, never made up."""
    read = lambda path: F.get_json_object(reply, path).cast("long")
    return {"input_tokens": read(INPUT), "output_tokens": read(OUTPUT), "cache_hit": F.coalesce(*map(read, HITS)), "cache_miss": read(MISSES)}


def usage_totals(rows: DataFrame) -> DataFrame:
    """Sums of each arm's usage (missing: 0), the share of its input that the cache held, and whether its inputs differ."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_hit", "cache_miss")]
    varies = F.coalesce(F.max("input_tokens") - F.min("input_tokens") > INPUT_MARGIN, F.lit(False)).alias("input_varies")
    found = rows.groupBy("arm").agg(*sums, F.count("*").alias("n"), varies)
    return found.withColumn("hit_share", F.col("cache_hit") / F.nullif(F.col("input_tokens"), F.lit(0)))
