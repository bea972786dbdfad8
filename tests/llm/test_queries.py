"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratadoc.llm import decontaminate, mixing, near_texts, queries, toxicity
from tests.llm.test_operators import hits_by_hand, lines_by_hand, order, result, similar_by_hand
from stratadoc.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == sorted(df.columns)
    expected = sorted(repr([r[at[c]] for c in sorted(at)]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(at)]) for r in df.collect()) == expected


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.select("doc_id").distinct().count() == kept.count() > 0
        if n + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == columns
            assert kept.filter(F.col("n_chars") != F.length("text")).count() == 0
        if name == "line_dedup":
            assert kept.count() == before.count()
        if name == "simhash":
            assert near_texts.near_texts(kept).filter("doc_id <> component_id").count() == 0
        if name == "decontaminate":
            hits = decontaminate.benchmark_hits(kept, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert hits.filter("n_hit > 0").count() == 0
            clean = decontaminate.benchmark_hits(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("n_hit = 0")
            assert clean.join(kept, "doc_id", "left_anti").count() == 0
        if name == "mixing":
            assert kept.filter("taken < 1 or taken > 2 * size").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, docs, rows, tmp_path):
    """Every stage against brute force on the rows it is given: null ids and texts, equal rows, equal texts of one id."""
    more = [*rows, rows[7], (7, rows[9][1], None, None, None), (None, rows[9][1], None, None, None), (None, None, None, None, None)]
    columns = corpus_pipeline.COLUMNS
    docs = spark.createDataFrame(more, docs.select(columns).schema).withColumn("_gone", F.lit("clash"))
    labels = [(i, int(i % 5 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, " ".join(rows[20][1].split()[3:40]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: [tuple(r) for r in df.select(columns).collect()]

    found = plain(stages["toxicity"](spark, docs, str(tmp_path)))
    judged = toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), carry=tuple(c for c in columns if c != "doc_id"))
    assert sorted(found, key=order) == result(judged.filter("predicted = 0"), *columns)

    found = plain(stages["line_dedup"](spark, docs, str(tmp_path)))
    assert sorted([r[:2] for r in found], key=order) == [r[:2] for r in lines_by_hand(more, 5)]
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in found)

    found = stages["simhash"](spark, docs, str(tmp_path))
    by_row = similar_by_hand([(n, *r[1:]) for n, r in enumerate(more)])
    assert found.columns == columns and found.count() == len({c for _, c in by_row})
    assert set(plain(found)) <= set(more)

    found = plain(stages["decontaminate"](spark, docs, str(tmp_path)))
    clean = [r for r, (_, _, n_hit, *_) in zip(sorted(more, key=order), hits_by_hand(sorted(more, key=order), items)) if not n_hit]
    left = sorted(r[:2] for r in found if r[1] is not None and r[0] is not None)
    assert all(left.count(r[:2]) >= clean.count(r) for r in clean if None not in r[:2])

    mixed = stages["mixing"](spark, docs, str(tmp_path))
    spoken = [r for r in more if (r[1] or "").split()]
    whole = mixing.mixture(docs, carry=tuple(columns))
    assert sorted(plain(whole), key=order) == sorted(more, key=order)
    assert len(plain(mixed)) == whole.filter("taken > 0").count() <= len(spoken)
    for r in mixed.collect():
        assert r["taken"] == sum(s["n_words"] for s in r["spans"]) <= 2 * r["size"] and r["first_slot"] == r["spans"][0]["slot"]
