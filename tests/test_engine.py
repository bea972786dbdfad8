"""Operators against literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from stratadoc.functions import markdown
from stratadoc.operators import chunk, evaluate, inspect, judge, retrieve, segments
from stratadoc.operators.index import lexical_index
from stratadoc.sources import corpus
from stratadoc.streaming.incremental import index_stream, postings_of, stream_of


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fixed_chunks_and_global_ids(spark):
    docs = spark.createDataFrame([(7, "a", "x" * 1001), (3, "b", "y" * 500), (9, "c", "")], "doc_id long, source string, text string")
    found = corpus.with_global_ids(chunk.fixed_chunks(docs))
    assert rows(found, "i", "doc_id", F.length("text")) == [(0, 3, 500), (1, 7, 500), (2, 7, 500), (3, 7, 1)]


def test_pieces_equal_the_core(spark):
    text = "# A\n" + "word " * 300 + "\n```\n# x\n```\n"
    docs = spark.createDataFrame([(1, "s", text), (2, "s", None)], "doc_id long, source string, text string")
    assert [r["text"] for r in chunk.pieces(docs).orderBy("ord").collect()] == [p.text for p in markdown.chunk_markdown(text)]


def test_bm25_replaces_negative_idf(spark):
    blocks = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "a d")], "i long, content string")
    index = lexical_index(blocks)
    idf = {r["term"]: r["idf"] for r in index.idf.collect()}
    assert idf["a"] != min(idf.values()) or idf["a"] < 0
    queries = spark.createDataFrame([(1, "b")], "query_id long, q string")
    assert rows(retrieve.bm25_topk(index, queries, 4), "i", "rank") == [(0, 1)]


def test_dense_ties_go_by_id(spark):
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0])], "i long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qv array<double>")
    assert rows(retrieve.dense_topk(vectors, queries, 2), "rank", "i") == [(1, 2), (2, 5)]


def test_rrf_weights_and_disjoint_arms(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, 11), (1, "b", 1, 12), (1, "c", 1, 13)], "query_id long, arm string, rank long, i long")
    scores = {r["i"]: r["score"] for r in retrieve.rrf_fuse(ranked, {"a": 1.0, "b": 3.0}, rrf_k=5).collect()}
    assert scores == pytest.approx({10: 1 / 6, 11: 1 / 7, 12: 3 / 6})


ANCHORS = "case_id long, mode string, group_no long, anchor_no long, anchor string"


def cases(spark):
    return spark.createDataFrame(
        [(1, "any", 0, 0, "first green bottle"), (1, "any", 1, 0, "second blue bottle"), (2, "all", 0, 0, "first green bottle"), (2, "all", 1, 0, "third red bottle here"), (3, "all", 0, 0, "no such thing at all")], ANCHORS
    )


def held(spark):
    blocks = spark.createDataFrame([(0, "a first green bottle and"), (1, "the second blue bottle, a third red bottle here"), (2, "`x` first green bottle `y`")], "i long, content string")
    return evaluate.containing_blocks(cases(spark), blocks)


def test_containment_finds_every_block(spark):
    assert rows(held(spark), "anchor", "i") == [("first green bottle", 0), ("first green bottle", 2), ("second blue bottle", 1), ("third red bottle here", 1)]


def test_coverage_of_any_and_all(spark):
    hits = spark.createDataFrame([("r", 1, 0), ("r", 2, 0), ("s", 2, 0), ("s", 2, 1)], "arm string, case_id long, i long")
    found = evaluate.coverage(cases(spark), hits, held(spark), ["arm"])
    assert rows(found, "arm", "case_id", "ok", "mark") == [("r", 1, True, "full"), ("r", 2, False, "partial"), ("r", 3, False, "none"), ("s", 1, False, "none"), ("s", 2, True, "full"), ("s", 3, False, "none")]


def test_min_cover_prefers_fewer_then_smaller(spark):
    wanted = spark.createDataFrame([(1, "all", 0, 0, "a"), (1, "all", 0, 1, "b"), (2, "any", 0, 0, "a"), (3, "any", 0, 0, "none")], ANCHORS)
    holding = spark.createDataFrame([("a", 5), ("b", 7), ("a", 2), ("b", 9)], "anchor string, i long")
    covers = evaluate.min_covers(wanted, holding)
    assert rows(covers, "case_id", "cover") == [(1, [2, 7]), (2, [2]), (3, [])]
    assert rows(evaluate.case_needs(wanted, covers), "case_id", "need") == [(1, 2), (2, 1), (3, None)]
    assert rows(evaluate.case_needs(wanted, covers), "case_id", "n_unsatisfiable") == [(1, 0), (2, 0), (3, 1)]
    both = holding.unionByName(spark.createDataFrame([("a", 8), ("b", 8)], "anchor string, i long"))
    assert (1, [8]) in rows(evaluate.min_covers(wanted, both), "case_id", "cover")


def test_min_covers_of_large_groups_equal_all_subsets(spark):
    """Groups of up to six anchors, some of them held by no block, against all subsets of blocks."""
    import random
    from itertools import combinations

    r = random.Random(11)
    wanted, held, expected = [], set(), []
    for case in range(12):
        names = [f"c{case}a{n}" for n in range(r.randint(1, 6))]
        wanted += [(case, "all", 0, n, a) for n, a in enumerate(names)]
        own = {b: {a for a in names if r.random() < 0.4} for b in range(case * 10, case * 10 + 7)}
        held |= {(a, b) for b, found in own.items() for a in found}
        some = sorted(b for b, found in own.items() if found)
        best = next((list(c) for n in range(1, 7) for c in combinations(some, n) if set.union(*(own[b] for b in c)) == set(names)), None)
        expected.append((case, best if best else some, best is not None))
    covers = evaluate.min_covers(spark.createDataFrame(wanted, ANCHORS), spark.createDataFrame(sorted(held), "anchor string, i long"))
    assert rows(covers, "case_id", "cover", "complete") == expected


def test_audit_tells_typos_from_split_anchors(spark):
    texts = spark.createDataFrame([("first green bottle",), ("third red bottle here",)], "anchor string")
    holding = spark.createDataFrame([("first green bottle", 0)], "anchor string, i long")
    found = evaluate.audit(cases(spark), holding, texts)
    assert rows(found.filter("case_id > 1"), "case_id", "group_no", "state") == [(2, 0, "found"), (2, 1, "split"), (3, 0, "typo")]


def test_judge_poisons_null_idents(spark):
    wanted = spark.createDataFrame([(1, "any", 0, 0, "价格 user_id"), (1, "any", 1, 0, "全中文的锚点")], ANCHORS)
    answers = spark.createDataFrame([(1, 1, "价格 user_id 如此")], "answer_id long, case_id long, answer string")
    groups = judge.judge_groups(answers, wanted)
    assert rows(groups, "group_no", "strict", "ident") == [(0, 1.0, 1.0), (1, 0.0, None)]
    case = judge.judge_cases(groups).first()
    assert (case["strict"], case["ident"]) == (1.0, None)


def test_across_goes_half_way(spark):
    found = judge.across(spark.range(5).withColumnRenamed("id", "case_id"))
    assert rows(found, "case_id", "other_id") == [(0, 2), (1, 3), (2, 4), (3, 0), (4, 1)]


def test_verdict_margin(spark):
    data = [(1, "x", "y", "long", 0.5), (1, "x", "y", "bm25", 0.61), (2, "x", "y", "long", 0.5), (2, "x", "y", "bm25", 0.6), (3, "z", "y", "long", 0.5), (3, "z", "y", "bm25", 0.3)]
    found = judge.verdicts(spark.createDataFrame(data, "case_id long, bank string, type string, arm string, delta double"))
    assert rows(found, "bank", "type", "wins", "losses", "ties") == [("total", "total", 1, 1, 1), ("x", "y", 1, 0, 1), ("z", "y", 0, 1, 0)]


def test_copy_ratio_counts_repeats(spark):
    grams = spark.createDataFrame([("aaa",)], "gram string")
    answers = spark.createDataFrame([(1, "aaaab"), (2, "")], "answer_id long, answer string")
    assert rows(judge.copy_ratios(answers, grams), "answer_id", "copy") == [(1, pytest.approx(2 / 3)), (2, 0.0)]


MD = "# A\n| h |\n|---|\n| 1 |\n```\n# no\n~~~\n```\n### C\nx\n## B\ny\n~~~\nopen"


def test_ranges_and_headings(spark):
    docs = spark.createDataFrame([(1, MD)], "doc_id long, text string")
    assert rows(inspect.fence_ranges(docs), "start", "end") == [(MD.index("```"), MD.index("\n### C")), (MD.rindex("~~~"), len(MD))]
    assert rows(inspect.table_ranges(docs), "start", "end") == [(4, MD.index("\n```"))]
    assert rows(inspect.headings(docs), "offset", "level", "title") == [(0, 1, "A"), (MD.index("### C"), 3, "C"), (MD.index("## B"), 2, "B")]


def test_path_at_is_inclusive_and_drops_deeper(spark):
    docs = spark.createDataFrame([(1, MD)], "doc_id long, text string")
    points = spark.createDataFrame([(1, 0), (1, MD.index("### C")), (1, MD.index("## B") + 1)], "doc_id long, offset long")
    assert [p for _, p in rows(inspect.path_at(points, inspect.headings(docs)), "offset", "path")] == ["A", "A > C", "A > B"]


def test_cut_quality_counts(spark):
    docs = spark.createDataFrame([(1, "s", "line one\n  two\n```\ncode\n```")], "doc_id long, source string, text string")
    pieces = spark.createDataFrame([(1, 0, "line one", 0), (1, 1, "two\n```\nco", 11), (1, 2, "de\n```", 21)], "doc_id long, ord int, text string, offset int")
    found = inspect.cut_quality(pieces, docs).first().asDict()
    assert found == {"doc_id": 1, "n_blocks": 3, "torn": 2, "headerless": 0, "over_size": 0, "clean": 1, "cut_line": 1, "cut_fence": 1, "cut_table": 0, "cut_prose": 0}


def test_corpus_files_and_manifest(spark, tmp_path):
    for name, text in (("b.md", "β\nsecond"), ("a.md", "first")):
        (tmp_path / name).write_text(text, encoding="utf8")
    found = corpus.read_corpus(spark, [str(tmp_path / "b.md"), str(tmp_path / "a.md")])
    assert rows(found, "corpus_ord", "source", "text") == [(0, "b.md", "# 文件：b.md\n\nβ\nsecond"), (1, "a.md", "# 文件：a.md\n\nfirst")]
    with pytest.raises(Exception):
        corpus.read_corpus(spark, [str(tmp_path / "gone.md")]).collect()


def test_stale_sources(spark):
    then = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "corpus_ord long, source string, text string")
    blocks = spark.createDataFrame([(0,)], "corpus_ord long")
    now = spark.createDataFrame([(0, "a", "x"), (1, "b", "changed"), (2, "c", "new")], "corpus_ord long, source string, text string")
    assert rows(corpus.stale_sources(corpus.manifest(then, blocks), now), "corpus_ord") == [(1,), (2,)]


def test_json_lines_and_newest(spark, tmp_path):
    import os

    corpus.write_json_lines(spark.createDataFrame([("中", 1)], "q string, n long"), str(tmp_path / "d"))
    assert rows(corpus.read_json_lines(spark, str(tmp_path / "d"), "q string, n long"), "q", "n") == [("中", 1)]
    for i, name in enumerate("xyz"):
        (tmp_path / f"{name}.jsonl").write_text("{}")
        os.utime(tmp_path / f"{name}.jsonl", (1000 + (i % 2), 1000 + (i % 2)))
    assert corpus.newest(spark, str(tmp_path / "*.jsonl")).first()["path"].endswith("y.jsonl")


def test_file_list(spark):
    body = json.dumps({"Data": {"Files": [{"Path": "a.bin", "Size": 3, "Type": "blob"}, {"Path": "d", "Size": 0, "Type": "tree"}, {"Path": "a.md", "Size": 1, "Type": "blob"}]}})
    assert rows(corpus.file_list(spark.createDataFrame([(body,)], "body string"), ".md"), "path", "size") == [("a.bin", 3)]


def test_index_follows_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    for n, docs in enumerate(([(0, "x" * 600), (1, "y")], [(10, "y"), (11, "z"), (1, "changed")], [(11, "z")])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"doc_id": i, "source": "s", "text": t}) for i, t in docs))
        index_stream(stream_of(spark, str(source)), out, str(tmp_path / "cp")).awaitTermination()
    blocks, index = segments.load(spark, out)
    assert rows(blocks, "i", "doc_id", F.substring("content", 1, 7)) == [(0, 0, "x" * 7), (1, 0, "x" * 7), (2, 1, "changed"), (3, 10, "y"), (4, 11, "z")]
    assert index.stats.first()["n"] == 5 and rows(index.idf, "term", "df") == [("changed", 1), ("x" * 100, 1), ("x" * 500, 1), ("y", 1), ("z", 1)]
    assert postings_of(spark, out).stats.first()["n"] == 5


def test_table_parts_equal_the_chunker(spark):
    tables = {t: ["| key | name |", "|---|---|", *(f"| {i} | {'x' * (i * t % 90)} |" for i in range(n))] for t, n in ((1, 40), (2, 1), (7, 120), (11, 3))}
    tables[5] = ["| key | name |", "|---|---|", "| a |", "| " + "y" * 700 + " |", "| b |"]
    rows = [(t, x[0], x[1], n, row) for t, x in tables.items() for n, row in enumerate(x[2:])]
    found = chunk.table_parts(spark.createDataFrame(rows, "table_id long, head string, rule string, row_no long, row string")).collect()
    for t, lines in tables.items():
        assert [r.text for r in sorted(found, key=lambda r: r.part_no) if r.table_id == t] == [text for text, _ in markdown.split_table(lines, 500)]


def test_segmenter_and_strict_code(spark):
    from stratadoc.functions import text as T

    df = spark.createDataFrame([("数据库 `a.b` x",), ("```sql\nselect one\n```\nthen `c.d()` two",)], "text string")
    halves = lambda w: F.when(w.rlike(r"^\p{IsHan}"), F.array(F.substring(w, 1, 2), F.substring(w, 3, 1))).otherwise(F.array(w))
    plain, own, strict = (df.select(c.alias("t")).collect() for c in (T.tokenize(F.col("text")), T.tokenize(F.col("text"), halves), T.tokenize(F.col("text"), strict_code=True)))
    assert plain[0].t == ["数据", "据库", "a", "b", "x"]
    assert own[0].t == ["数据", "库", "a", "b", "x"]
    assert strict[1].t == ["select", "one", "then", "c", "d", "two"]


def test_stored_index_is_read_until_the_documents_change(spark, tmp_path):
    from stratadoc.plans import queries

    def write(texts):
        spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    def state():
        held, lexical = queries.index(spark, str(tmp_path))
        return {r.content for r in held.collect()}, {r.term: r.df for r in lexical.idf.collect()}, lexical.stats.first().n

    write(["one two", "two three"])
    fresh = state()
    spark.conf.set("spark.stratadoc.index", f"file://{tmp_path}/index")
    try:
        assert state() == fresh
        made = sorted(p.name for p in (tmp_path / "index").rglob("part-*"))
        assert state() == fresh and sorted(p.name for p in (tmp_path / "index").rglob("part-*")) == made
        write(["one two", "two four"])
        assert state() == ({"one two", "two four"}, {"one": 1, "two": 2, "four": 1}, 2)
    finally:
        spark.conf.unset("spark.stratadoc.index")


def test_cut_deltas_and_sources(spark):
    totals = spark.createDataFrame([("a", 10, 0), ("b", 5, 3)], "chunker string, n_blocks long, torn long")
    found = {r.measure: (r.before, r.after, r["diff"], r.percent) for r in inspect.cut_deltas(totals, ["n_blocks", "torn"], "a", "b").collect()}
    assert found == {"n_blocks": (10, 5, -5, -50.0), "torn": (0, 3, 3, None)}
    blocks = spark.createDataFrame([("design",), ("design",)], "source string")
    with pytest.raises(ValueError):
        corpus.require_sources(blocks, "bug")
    corpus.require_sources(blocks.union(spark.createDataFrame([("bugs",)], "source string")), "bug")


def test_answers_of_a_plugged_in_model(spark):
    from stratadoc.operators import answers

    prompts = spark.createDataFrame([(1, "a", "q"), (2, "b", None)], "case_id long, arm string, prompt string")
    found = answers.answered(prompts, lambda texts: [t.upper() for t in texts], ["case_id", "arm"]).collect()
    assert sorted(map(tuple, found)) == [(1, "a", "Q"), (2, "b", "")]
    assert answers.usage_totals(spark.createDataFrame([("x", None, None, None, None)], "arm string, input_tokens long, output_tokens long, cache_hit long, cache_miss long")).first().hit_share is None
