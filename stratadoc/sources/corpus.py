"""Sources and sinks: corpora of text files, JSON lines, indexes kept as Parquet tables with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratadoc.session import saved

#: Fixed value: the line that names a file at the head of its text.
HEADER = "# 文件："


def headed(source: Column, text: Column) -> Column:
    return F.concat(F.lit(HEADER), source, F.lit("\n\n"), text)


def read_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """corpus_ord, source, text: whole files in the order given. Spark raises an error for a missing one."""
    order = spark.createDataFrame(list(enumerate(p.rsplit("/", 1)[-1] for p in paths)), "corpus_ord int, source string")
    text = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), "[^/]*$", 0).alias("source"), F.col("value").alias("text"))
    return text.join(F.broadcast(order), "source").select("corpus_ord", "source", headed(F.col("source"), F.col("text")).alias("text"))


def corpus_text(corpus: DataFrame, group: str) -> DataFrame:
    """The texts of each group laid end to end in corpus order, an empty line between them, as pieces: group, corpus_ord,
    offset (of the piece in the whole, in characters) and text. The whole is never in one row, as it has no bound. A text
    is a piece of its own whatever its number is, also without one; a null text takes up no more than the empty line."""
    return running_sum(corpus.select(group, "corpus_ord", "text"), group, "corpus_ord", F.coalesce(F.length("text"), F.lit(0)) + 2, "offset")


def in_ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows in order of `by`, written down as ranges of it, with place: the range's number and the place in it.

    The ranges come from a sample, so they hold about as many rows whatever the values are; rows that are equal in all
    of `by` are told apart by where they were read, so that many of them are dealt to several ranges.
    """
    keyed = rows.withColumn("_read", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in (*by, "_read")]
    return saved(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_read").withColumn("_place", F.monotonically_increasing_id()), "ranges")


#: How monotonically_increasing_id() numbers rows: the partition, and in the lower bits the place in it.
PART, AT = "int(shiftright(_place, 33))", f"_place & {(1 << 33) - 1}L"


def _ahead(parts: DataFrame) -> DataFrame:
    """part, n -> part, ahead: the sum over the ranges before. One row for each range."""
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))


def ranked(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds out: 0, 1, ... over all rows in order of `by`, nulls first. Rows equal in all of it stand in any order."""
    placed = in_ranges(rows, by).withColumns({"part": F.expr(PART), "at": F.expr(AT)})
    ahead = _ahead(placed.groupBy("part").agg(F.count("*").alias("n")))
    return placed.join(F.broadcast(ahead), "part").withColumn(out, (F.col("at") + F.col("ahead")).cast("long")).drop("part", "at", "ahead", "_place")


def running_sum(rows: DataFrame, group: str, by: str, amount: Column, out: str) -> DataFrame:
    """Adds out: the sum of amount over the group's rows before this one in order of `by`, nulls first.

    Rows keep who they are: repeated and null values of group and by give a row each, and rows equal in both stand in
    any order. The sums are over ranges of rows of about one size, whatever the groups and values are.
    """
    kept = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "summed-rows")
    sizes = in_ranges(kept.select(F.col(group).alias("g"), F.col(by).alias("at_"), "_row", F.coalesce(amount, F.lit(0)).cast("long").alias("n")), ["g", "at_", "_row"])
    sizes = sizes.withColumn("part", F.expr(PART))
    inside = Window.partitionBy("part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = _ahead(sizes.groupBy("part").agg(F.sum("n").alias("n")))
    sums = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ahead), "part")
    sums = saved(sums.select("g", "_row", (F.col("inside") + F.col("ahead")).alias("before")), "running-sums")
    first = sums.groupBy(F.col("g").alias("g_")).agg(F.min("before").alias("first"))
    own = sums.join(first, F.col("g").eqNullSafe(F.col("g_"))).select("_row", (F.col("before") - F.col("first")).cast("long").alias(out))
    return kept.join(own, "_row").drop("_row")


def manifest(corpus: DataFrame, blocks: DataFrame) -> DataFrame:
    """source, chars, sha256 and block_count of each text of a corpus."""
    counts = blocks.groupBy("corpus_ord").agg(F.count("*").alias("block_count"))
    own = corpus.select("corpus_ord", "source", F.length("text").cast("long").alias("chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return own.join(counts, "corpus_ord", "left").withColumn("block_count", F.coalesce("block_count", F.lit(0)).cast("long"))


def save_index(blocks: DataFrame, corpus: DataFrame, path: str, chunker: str, chunk_size: int = 500, overlap: int = 0) -> None:
    """Blocks, partitioned by chunker so that readers of one prune the others, and the manifest beside them,
    with the settings they were made by and when."""
    blocks.withColumn("chunker", F.lit(chunker)).write.mode("overwrite").partitionBy("chunker").parquet(f"{path}/blocks")
    made = {"chunker": F.lit(chunker), "chunk_size": F.lit(chunk_size), "overlap": F.lit(overlap), "created_at": F.current_timestamp()}
    # Counted from what was written, so that the blocks aren't made again.
    stored = corpus.sparkSession.read.parquet(f"{path}/blocks").filter(F.col("chunker") == chunker)
    manifest(corpus, stored).withColumns(made).write.mode("overwrite").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, chunker: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/blocks").filter(F.col("chunker") == chunker), spark.read.parquet(f"{path}/manifest")


def describe(stored: DataFrame) -> DataFrame:
    """line_no, line: what a manifest that save_index wrote says of its index, a line for the settings of each making and one
    for each source after it. An index without texts says so; a null source is written as "-"."""
    settings = ["chunker", "chunk_size", "overlap", "created_at"]
    made = stored.groupBy(*settings).agg(F.sum("block_count").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("texts"))
    head = F.format_string("chunker=%s size=%d overlap=%d, %d blocks of %d texts (%d characters), made %s", "chunker", "chunk_size", "overlap", "n", "texts", F.coalesce("chars", F.lit(0)), F.col("created_at").cast("string"))
    of_source = stored.groupBy(*settings, "source").agg(F.sum("block_count").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    line = F.format_string("  %s: %d characters, %d blocks", F.coalesce("source", F.lit("-")), "chars", "n")
    lines = made.select("created_at", F.lit(0).alias("part"), F.lit(None).cast("string").alias("source"), head.alias("line"))
    lines = lines.unionByName(of_source.select("created_at", F.lit(1).alias("part"), "source", line.alias("line")))
    if lines.isEmpty():
        return lines.sparkSession.createDataFrame([(0, "no texts: nothing tells what this index was made of")], "line_no long, line string")
    return ranked(lines, ["created_at", "part", "source"], "line_no").select("line_no", "line")


def source_check(blocks: DataFrame, part: str, least: int = 2) -> DataFrame:
    """One row: n_sources of the blocks, n_named with part in their name, and complete: least sources, one of them so named."""
    names = blocks.select("source").distinct()
    found = names.agg(F.count("source").alias("n_sources"), F.count_if(F.contains("source", F.lit(part))).alias("n_named"))
    return found.withColumn("complete", (F.col("n_sources") >= least) & (F.col("n_named") > 0))


def require_sources(blocks: DataFrame, part: str, least: int = 2) -> None:
    """An error where the index lacks sources, so that arms aren't compared over different corpora."""
    found = source_check(blocks, part, least).first()
    if not found.complete:
        raise ValueError(f"the index has {found.n_sources} sources, {found.n_named} with {part!r} in their name; build it anew")


def stale_sources(stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts that are new, gone or changed since the index was built."""
    now = corpus.select("corpus_ord", F.sha2(F.encode("text", "UTF-8"), 256).alias("now"))
    both = stored.select("corpus_ord", F.col("sha256").alias("then")).join(now, "corpus_ord", "full")
    return both.filter(~F.col("then").eqNullSafe(F.col("now")))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).na.drop("all")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """The path that was changed last among those of a glob; file contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).agg(F.max_by("path", "modificationTime").alias("path"))


def file_list(listing: DataFrame, skip_suffix: str) -> DataFrame:
    """path, size of the files in JSON listings (column body), without those that end in skip_suffix."""
    schema = "struct<Data:struct<Files:array<struct<Path:string,Size:long,Type:string>>>>"
    rows = listing.select(F.explode(F.from_json("body", schema)["Data"]["Files"]).alias("f"))
    return rows.filter((F.col("f.Type") == "blob") & ~F.col("f.Path").endswith(skip_suffix)).select(F.col("f.Path").alias("path"), F.col("f.Size").alias("size"))


def marked_sections(docs: DataFrame, marker: str, detail: str, most: int, missing: str) -> DataFrame:
    """no, title, detail of each part that begins with marker (a line's start): its first line, and what follows detail."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", f"(?m)^{marker}", -1)).alias("no", "part")).filter("no > 0")
    found = F.regexp_extract("part", rf"(?s){detail}\s*(.{{0,{most}}})", 1)
    return parts.select("doc_id", F.col("no").cast("long").alias("no"), F.substring_index("part", "\n", 1).alias("title"), F.coalesce(F.nullif(found, F.lit("")), F.lit(missing)).alias("detail"))


def with_global_ids(pieces: DataFrame, by: str = "doc_id", ord_col: str = "ord", row: str = "row") -> DataFrame:
    """Adds i: 0, 1, ... over all pieces in order of `by` (nulls first), then of row where pieces have it, then of ord_col.

    row tells documents apart that share an id: without it the pieces of such documents alternate. Ids are unique and
    contiguous whatever the documents' are.
    """
    own = [row] if row in pieces.columns else []
    return ranked(pieces, [by, *own, ord_col], "i").drop(*own)
