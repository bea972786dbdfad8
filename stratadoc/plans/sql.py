"""Chunkers from SQL: SELECT d.doc_id, c.* FROM docs d, LATERAL chunk(d.text, 'md') c."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from stratadoc.functions import markdown
from stratadoc.operators.chunk import CHUNKERS
from stratadoc.session import ship

NAME = "chunk"
#: A piece's columns, as operators.chunk.PIECE_SCHEMA has them; built without a session, as analyze() has none.
PIECE = StructType().add("ord", IntegerType()).add("text", StringType()).add("offset", IntegerType()).add("path", MapType(IntegerType(), StringType())).add("cross_section", BooleanType())


class Chunk:
    """chunk(text, kind): a row for each piece. kind is a constant: fixed, or a chunker's name. Null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in ("fixed", *CHUNKERS):
            raise ValueError(f"kind is one of {', '.join(('fixed', *CHUNKERS))}, as a constant")
        if text.dataType.typeName() != "string":
            raise ValueError("text is a string")
        return AnalyzeResult(PIECE)

    def eval(self, text: str, kind: str) -> Iterator[tuple]:
        if kind == "fixed":
            for n, at in enumerate(range(0, len(text or ""), 500)):
                yield n, text[at : at + 500], at, {}, False
            return
        for n, p in enumerate(CHUNKERS[kind](text or "")):
            yield n, p.text, p.offset, dict(p.path), markdown.crosses_sections(p)


def register(spark: SparkSession) -> None:
    """Makes chunk() known to the session."""
    ship(spark)
    spark.udtf.register(NAME, udtf(Chunk))
