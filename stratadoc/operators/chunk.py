"""Chunking: documents to blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.functions import markdown

PIECE_SCHEMA = "ord int, text string, offset int, path map<int,string>, cross_section boolean"


def fixed_chunks(docs: DataFrame, size: int = 500) -> DataFrame:
    """doc_id, source, ord, text, and row where docs has it: slices of size characters that cover each document; none of
    an empty one."""
    last, own = F.ceil(F.length("text") / size).cast("int") - 1, [c for c in ("doc_id", "source", "row") if c in docs.columns]
    return docs.filter("text != ''").select(*own, "text", F.explode(F.sequence(F.lit(0), last)).alias("ord")).select(
        *own, "ord", F.substring("text", F.col("ord") * size + 1, F.lit(size)).alias("text")
    )


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with row, a number by which documents of one id are told apart as long as they are cut in the same step."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def _cut(cut: Callable[[str], list[markdown.Piece]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text")):
                for n, p in enumerate(cut(text.as_py() or "")):
                    at.append(i)
                    rows.append((n, p.text, p.offset, list(p.path.items()), markdown.crosses_sections(p)))
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.map_(pa.int32(), pa.string()), pa.bool_())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] or [pa.array([], t) for t in kinds]
            own = batch.schema.names[:-1]
            ids = [batch.column(c).take(pa.array(at, pa.int32())) for c in own]
            yield pa.RecordBatch.from_arrays([*ids, *columns], [*own, "ord", "text", "offset", "path", "cross_section"])

    return run


#: Chunkers by name: text -> pieces. In a table one piece without a place doesn't fail the job: its offset is null.
CHUNKERS: dict[str, Callable[[str], list[markdown.Piece]]] = {
    "md": lambda text: markdown.chunk_markdown(text, strict=False),
    "md_plain": lambda text: markdown.chunk_markdown(text, structure=False, strict=False),
    "flat": lambda text: markdown.chunk_flat(text, strict=False),
}


def pieces(docs: DataFrame, chunker: str = "md") -> DataFrame:
    """doc_id, source, row where docs has it, ord, text, offset, path, cross_section. A document is cut by one task;
    documents spread freely."""
    own = [c for c in ("doc_id", "source", "row") if c in docs.columns]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*own, "text").mapInArrow(_cut(CHUNKERS[chunker]), f"{schema}, {PIECE_SCHEMA}")


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, n, body, list(path.items())) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for n, (body, path) in enumerate(markdown.sections(text or ""))]
        kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.map_(pa.int32(), pa.string()))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] or [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "body", "path"])


def sections(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_sections, f"doc_id {kind}, section int, body string, path map<int,string>")


def _atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, n, kind, "\n".join(lines)) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for n, (kind, lines) in enumerate(markdown.atoms((text or "").split("\n")))]
        kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.string())
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] or [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "atom", "kind", "text"])


def atoms(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_atoms, f"doc_id {kind}, atom int, kind string, text string")


def table_parts(rows: DataFrame, size: int = 500) -> DataFrame:
    """Tables given by their rows (table_id, head, rule, row_no, row) -> part_no and text of parts that all have head and rule.

    A part takes rows as long as it stays within size; a longer row is a part of its own. A table is a piece of one
    document, so its rows are folded in order as one array.
    """
    listed = rows.groupBy("table_id").agg(
        F.first("head").alias("head"), F.first("rule").alias("rule"), F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda x: x["row"]).alias("r")
    )
    budget = F.greatest(F.lit(size) - F.length("head") - F.length("rule") - 2, F.lit(1))

    def step(state, i):
        n = F.length(F.get("r", i)) + 1
        begins = (i == 0) | (state["used"] + n > budget)
        starts = F.when(begins, F.concat(state["starts"], F.array(i))).otherwise(state["starts"])
        return F.struct(F.when(begins, n).otherwise(state["used"] + n).alias("used"), starts.alias("starts"))

    first = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size("r") - 1), first, step)["starts"]
    parts = listed.withColumn("starts", starts).select("*", F.posexplode("starts").alias("part_no", "begin"))
    stop = F.coalesce(F.get("starts", F.col("part_no") + 1), F.size("r"))
    body = F.array_join(F.slice("r", F.col("begin") + 1, stop - F.col("begin")), "\n")
    return parts.select("table_id", F.col("part_no").cast("long").alias("part_no"), F.concat_ws("\n", "head", "rule", body).alias("text"))
