import random

import pytest

#: Columns beside the documents' own, named like the operators' inner ones.
CLASHING = ["key", "digest", "hash", "term", "i", "size", "words", "text_key", "route", "content", "start", "n", "fp", "total", "gone", "_gone", "_key", "place", "shard", "doc", "sid", "row_id", "most", "spans", "carried"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Small texts with shared passages, copies, near copies, ties, nulls, empties and one very long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeioubcdé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(45))
    texts = []
    for i in range(60):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(1, f"{r.choice(vocabulary)} {passage} {r.choice(vocabulary)}")
        if i % 3 == 0:
            lines.append("Common  Line at the end.")
        if i % 7 == 0:
            lines.append("Licensed under the Apache License, Version 2.0.")
        texts.append("\n".join(lines))
    texts[40] = texts[8]
    texts[41] = texts[8].replace(" ", "  ", 3)
    texts[42] = texts[8] + " extra"
    texts[43] = "same " * 90
    texts[44] = "  \t\n "
    rows = [(i, t, "en", f"site{i % 6}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "site1", 0), (None, texts[3], "en", "site2", 1), (102, " ".join(r.choice(vocabulary) for _ in range(30_000)), "en", None, 1)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "text")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark, rows):
    words = rows[4][1].split()
    items = [(0, " ".join(words[2:30])), (1, "Common line"), (2, rows[9][1]), (3, None), (4, "..."), (0, " ".join(words[5:20])), (5, "x y z not there at all in any of these documents ever")]
    return spark.createDataFrame(items, "item_id long, text string")
