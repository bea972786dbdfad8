"""What larger tables and odd values showed, in small."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from stratadoc import session
from stratadoc.operators import grams, index, judge, retrieve
from stratadoc.plans import queries
from stratadoc.plans.oracles import ORACLES
from stratadoc.plans.queries import QUERIES
from stratadoc.session import saved
from stratadoc.sources import corpus


def test_a_small_negative_component_rounds_to_negative_zero(spark, tmp_path):
    rows = [(0, [1.0, -1e-7, 1e-7, 0.0, -0.0], 1), (1, [-3.0, 4.0, 0.0, 0.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = [(i, list(map(repr, v))) for i, v in con.execute(f"SELECT vec_id, v FROM ({ORACLES['l2_normalize']}) ORDER BY vec_id").fetchall()]
    assert expected[0][1] == ["1.0", "-0.0", "0.0", "0.0", "-0.0"]
    assert [(r["vec_id"], list(map(repr, r["v"]))) for r in QUERIES["l2_normalize"](spark, str(tmp_path)).orderBy("vec_id").collect()] == expected


def test_places_are_found_across_the_lots_of_bytes(monkeypatch):
    monkeypatch.setattr(grams, "LOT", 16)
    texts = ["", "abcdefghij" * 5, None, "é中🙂xyz" * 4, "ab", ""]
    keys = np.random.default_rng(5).integers(1 << 62, size=6).astype(np.uint64)
    array = pa.array(["left out", *texts]).slice(1)
    for size in (1, 3, 8):
        for own in (None, keys):
            found = [x for p in grams._places(array, own, [size], np.ones(64, bool)) for x in zip(*(a.tolist() for a in p))]
            raw = [(t or "").encode() for t in texts]
            ahead = np.cumsum([0, *map(len, raw)]).tolist()
            assert [(r, p - ahead[r]) for r, p, _ in found] == [(r, p) for r, b in enumerate(raw) for p in range(len(b) - size + 1)]
            by = {}
            for r, p, h in found:
                by.setdefault((r if own is not None else 0, raw[r][p - ahead[r] :][:size]), set()).add(h)
            assert all(len(hs) == 1 for hs in by.values()) and len(set.union(*by.values())) == len(by)


def test_only_places_of_rarest_grams_are_written(spark, monkeypatch):
    written = []

    def counted(df, label, **options):
        found = saved(df, label, **options)
        written.append(found.count())
        return found

    monkeypatch.setattr(grams, "saved", counted)
    texts = spark.createDataFrame([(i, "a line that stands in all texts " * 20 + f"number {i:05d}") for i in range(200)], "i long, text string")
    needles = spark.createDataFrame([("in all texts number 00007",), ("stands in all texts number 00150",)], "needle string")
    assert sorted((r["needle"], r["i"]) for r in grams.occurrences(needles, texts).collect()) == [("in all texts number 00007", 7), ("stands in all texts number 00150", 150)]
    assert sum(written) < 200


def test_an_index_takes_less_than_three_and_a_half_times_its_texts(spark, tmp_path, monkeypatch):
    """With the scratch tables that are left of its making."""
    data = "/root/testdata/sf0.01"
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(queries, "shared_dir", lambda _: f"file://{tmp_path}")
    queries.index(spark, data)
    taken = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet") if p.is_file())
    assert taken < 3.5 * Path(f"{data}/documents.parquet").stat().st_size


def test_a_span_is_scored_as_by_hand(monkeypatch):
    monkeypatch.setattr(retrieve, "PAIRS", 7)
    r = random.Random(3)
    asked = [(q, t, r.randint(1, 3), idf) for t, idf in (("a", 0.5), ("b", 2.0), ("c", -0.25), ("d", 1.0)) for q in range(6) if r.random() < 0.7]
    block = retrieve.Asked(pa.table(dict(zip(("query_id", "term", "times", "idf"), map(list, zip(*asked))))), 5.0, 3)
    terms = block.terms.to_pylist()
    postings = [(t, 2048 + i, r.randint(1, 2), 6) for t in terms for i in range(40) if r.random() < 0.5]
    rows = pa.table({"no": [terms.index(p[0]) for p in postings], "i": [p[1] for p in postings], "tf": [p[2] for p in postings], "dl": [p[3] for p in postings]})
    found = {}
    for x in block.score(rows, pa.table({"query_id": [5, 1, 2, 1, 77]})).to_pylist():
        found.setdefault(x["query_id"], []).append((-round(x["score"], 9), x["i"]))
    expected = {}
    for q in (1, 2, 5):
        sums = {}
        for _, t, times, idf in (x for x in asked if x[0] == q):
            for _, i, tf, dl in (p for p in postings if p[0] == t):
                sums[i] = sums.get(i, 0) + times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 5.0))
        expected[q] = sorted((-round(s, 9), i) for i, s in sums.items())[:3]
    assert {q: sorted(x)[:3] for q, x in found.items()} == expected
    assert block.score(rows.slice(0, 0), pa.table({"query_id": [1]})).num_rows == 0


def test_shuffles_of_a_written_table_go_with_it(spark):
    before = spark.conf.get(session.CLEANUP, None)
    with session.passing(spark):
        assert spark.conf.get(session.CLEANUP) == "true"
        path = saved(spark.range(10), "passing").inputFiles()[0]
        assert Path(path.removeprefix("file:")).exists() or Path(path.removeprefix("file://")).exists()
    assert spark.conf.get(session.CLEANUP, None) == before
    assert not Path(path.removeprefix("file://")).exists()


def test_nearest_vectors_equal_the_plain_product(spark, monkeypatch):
    """Ties, copies, odd vectors, blocks of queries and lots of vectors."""
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 5)
    r = random.Random(4)
    rows = [(i, [float(r.choice([-1, 0, 1, 0.5])) for _ in range(4)]) for i in range(60)] + [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(60, 80)]
    rows += [(80, None), (81, [1.0]), (82, [1.0, None, 1.0, 1.0]), (83, [float("nan")] * 4), (84, [float("inf"), 0.0, 0.0, 0.0]), (85, [])]
    found = spark.createDataFrame(rows, "i long, v array<double>").repartition(3)
    asked = found.filter("i % 7 = 0 or i > 79").withColumnsRenamed({"i": "query_id", "v": "qv"})
    scored = found.crossJoin(asked).select("query_id", "i", retrieve.dot(F.col("v"), F.col("qv")).alias("score"))
    expected = sorted((x["query_id"], x["rank"], x["i"], repr(x["score"])) for x in retrieve.top(scored, 6).collect())
    assert sorted((x["query_id"], x["rank"], x["i"], repr(x["score"])) for x in retrieve.dense_topk(found, asked, 6).collect()) == expected
    plan = retrieve.dense_topk(found.filter("i < 80"), asked.filter("query_id < 80"), 6)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan


def test_only_blocks_that_may_be_hits_move(spark):
    blocks = spark.range(100_000).select(F.col("id").alias("i"), F.lit("x").alias("content"))
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 99_999), (2, 1, 500_000)], "query_id int, rank int, i int")
    plan = retrieve.lookup(hits, blocks)
    assert sorted((r["rank"], r["i"]) for r in plan.collect()) == [(1, 7), (2, 99_999)]
    assert "_bits" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_texts_beyond_a_budget_arent_written(spark, monkeypatch):
    written = []
    plain = corpus.saved
    monkeypatch.setattr(corpus, "saved", lambda df, label, **options: written.append((found := plain(df, label, **options)).count()) or found)
    texts = spark.createDataFrame([(None, "first"), (3, "abc"), (1, ""), (2, None), (2, "xy")] + [(n, "word " * 50) for n in range(4, 500)], "corpus_ord long, text string")
    context = retrieve.within_budget(texts, 300).first()["context"]
    assert context in ("first\n\n\n\n\n\nxy\n\nabc\n\n" + "word " * 50, "first\n\n\n\nxy\n\n\n\nabc\n\n" + "word " * 50)
    assert max(written) < 10


def test_variants_scored_together_score_as_alone(spark):
    r = random.Random(6)
    blocks = [(v, (n << 40) + i, " ".join(r.choice("abcdefg") * 2 for _ in range(r.randint(0, 6)))) for n, v in enumerate(("x", "y")) for i in range(40 + 10 * n)]
    found = spark.createDataFrame(blocks, "variant string, i long, content string")
    asked = spark.createDataFrame([(1, "aa bb bb"), (2, "cc gg zz")], "query_id long, q string")
    postings, idf = index.keyed_index(found, "variant")
    own = F.concat_ws("|", "variant", "term").alias("term")
    terms = retrieve.asked_terms(asked).join(idf, "term").select("query_id", own, "times", "idf")
    scored = retrieve.span_scores(postings.select(own, F.shiftright("i", 10).alias("span"), "i", "tf", "dl"), terms, 1.0, 3, "scores")
    together = retrieve.top(scored.withColumn("variant", F.shiftright("i", 40)), 3, ["variant", "query_id"]).filter("score > 0")
    alone = [retrieve.bm25_topk(index.lexical_index(found.filter(F.col("variant") == v).select("i", "content")), asked, 3) for v in ("x", "y")]
    state = lambda df: sorted((x["query_id"], x["i"], x["rank"], round(x["score"], 7)) for x in df.collect())
    assert state(together) == state(alone[0].unionByName(alone[1].select(*alone[0].columns)))


def test_answers_and_anchors_are_normalised_before_they_meet(spark):
    answers = spark.createDataFrame([(1, 1, "ab cd"), (2, 2, "")], "answer_id long, case_id long, answer string")
    anchors = spark.createDataFrame([(2, 0, "abc")], "case_id long, group_no long, anchor string")
    floors = judge.gram_floor(answers, anchors, spark.createDataFrame([(1, 2), (2, 1)], "case_id long, other_id long"))
    assert [tuple(r) for r in floors.collect()] == [(1, 1.0)]
    plan = floors._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[: plan.index("Join")]
