"""Numbering, gram postings, covers, stored indexes and pruned search against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.functions import markdown
from stratadoc.operators import chunk, covers, evaluate, grams, inspect, judge, retrieve, segment, segments, selection
from stratadoc.operators.index import lexical_index, load_lexical, store_lexical
from stratadoc.sources import corpus, store

DOCS = "doc_id long, source string, text string"
ODD = [(5, "a", "x" * 1001), (5, "a", "y" * 600), (5, "a", "y" * 600), (None, "b", "z" * 501), (None, None, "q"), (10**15, "b", "w"), (7, None, None), (-3, "a", ""), *[(k, "c", f"t{k}") for k in range(20, 40)]]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_ids_are_unique_and_contiguous_for_any_documents(spark):
    docs = spark.createDataFrame(ODD, DOCS).repartition(3)
    found = corpus.with_global_ids(chunk.fixed_chunks(chunk.told_apart(docs))).collect()
    whole = sorted(found, key=lambda r: r["i"])
    assert [r["i"] for r in whole] == list(range(sum(-(-len(t or "") // 500) for *_, t in ODD)))
    assert [r["doc_id"] is None for r in whole[:3]] == [True] * 3
    assert [r["doc_id"] for r in whole[3:]] == sorted(r["doc_id"] for r in whole[3:])
    # A document's pieces follow each other, also where two documents share an id.
    assert sorted("".join(r["text"][0] for r in whole if r["doc_id"] == 5).replace("yy", "Y")) == sorted("xxxYY")
    assert [r["ord"] for r in whole if r["text"][0] in "xy"].count(0) == 3


def test_uneven_ids_spread_over_ranges(spark):
    rows_ = spark.range(20_000).select(F.when(F.col("id") == 7, F.lit(10**12)).when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        placed = corpus.in_ranges(rows_, ["k"]).groupBy(F.expr(corpus.PART)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) > 1 and max(r["count"] for r in placed) < 0.5 * 20_000
    found = corpus.ranked(rows_, ["k"], "i").agg(F.count_distinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(found) == (20_000, 0, 19_999)


def test_running_sums_keep_rows_apart(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumnRenamed("doc_id", "corpus_ord").repartition(4)
    found = corpus.corpus_text(docs, "source").collect()
    assert sorted((r["source"] or "", len(r["text"] or "")) for r in found) == sorted((s or "", len(t or "")) for _, s, t in ODD)
    for source in {s for _, s, _ in ODD}:
        own = sorted((r for r in found if r["source"] == source), key=lambda r: (r["offset"]))
        at = 0
        for r in own:
            assert r["offset"] == at
            at += len(r["text"] or "") + 2
        known = [r["corpus_ord"] for r in own if r["corpus_ord"] is not None]
        assert known == sorted(known) and all(r["corpus_ord"] is None for r in own[: len(own) - len(known)])


def texts_and_needles(seed=3):
    r = random.Random(seed)
    signs = "abcab 中文🙂\n"
    texts = ["".join(r.choice(signs) for _ in range(r.choice([0, 1, 3, 40, 700, 1500]))) for _ in range(30)] + [None, "a" * 1200]
    needles = {"", "a", "ab", "中文🙂", "aaaaaaaa"}
    for t in texts:
        for n in (1, 3, 5, 6, 7, 12, 30):
            if t and len(t) >= n:
                at = r.randrange(len(t) - n + 1)
                needles.add(t[at : at + n])
    for t in texts:  # across the windows' borders
        if t and len(t) > 520:
            needles |= {t[505:520], t[510:516], t[511:513]}
    return texts, sorted(needles) + ["not there at all", "zz"]


def test_occurrences_equal_a_scan(spark):
    texts, needles = texts_and_needles()
    found = grams.occurrences(spark.createDataFrame([(n,) for n in needles] + [(None,), (needles[3],)], "needle string"), spark.createDataFrame(list(enumerate(texts)), "i long, text string"))
    expected = [(n, i, p + 1) for n in needles if n for i, t in enumerate(texts) if t for p in range(len(t)) if t.startswith(n, p)]
    assert rows(found, "needle", "i", "pos") == sorted(expected)
    none = spark.createDataFrame([], "needle string")
    assert grams.occurrences(none, spark.createDataFrame(list(enumerate(texts)), "i long, text string")).count() == 0


@pytest.mark.parametrize("mode", ["compat", "edit1"])
def test_near_occurrences_equal_the_column_function(spark, mode):
    r = random.Random(7)
    texts = ["".join(r.choice("abc") for _ in range(r.choice([0, 7, 9, 20, 60]))) for _ in range(30)]
    needles = set()
    for t in texts:
        for n in (3, 7, 8, 9, 14):
            if len(t) >= n:
                at = r.randrange(len(t) - n + 1)
                own = list(t[at : at + n])
                for _ in range(r.choice([0, 1, 1, 2])):
                    k = r.randrange(len(own))
                    own[k : k + 1] = r.choice([[], ["c"], [own[k], "b"]])
                needles.add("".join(own))
    needles = spark.createDataFrame([(k % 2, n) for k, n in enumerate(sorted(needles))], "g long, needle string")
    df = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "g long, i long, text string")
    expected = needles.filter("needle <> ''").join(df, "g").filter(T.fuzzy_in(F.col("needle"), F.col("text"), mode))
    assert rows(grams.near_occurrences(needles, df, on=("g",), mode=mode), "g", "needle", "i") == rows(expected, "g", "needle", "i")
    plan = grams.near_occurrences(needles, df, on=("g",), mode=mode)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment_has_no_nested_loop(spark):
    blocks = spark.createDataFrame([(0, "`x` first green"), (1, "green")], "i long, content string")
    found = evaluate.containing_blocks(spark.createDataFrame([("green",), ("`x`",), ("`",), ("n",)], "anchor string"), blocks)
    assert rows(found, "anchor", "i") == [("`", 0), ("`x`", 0), ("green", 0), ("green", 1), ("n", 0), ("n", 1)]


def first_cover(kinds, need):
    for n in range(len(kinds) + 1):
        fits = [sorted(i for _, i in c) for c in combinations(kinds, n) if not need & ~sum_bits(c)]
        if fits:
            return min(fits)
    return None


def sum_bits(kinds):
    found = 0
    for m, _ in kinds:
        found |= m
    return found


def test_smallest_covers_equal_all_subsets():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 9)
        kinds = [(r.getrandbits(n) & r.getrandbits(n) | 1 << r.randrange(n), i) for i in r.sample(range(100), r.randint(1, 9))]
        kinds.sort(key=lambda k: k[1])
        assert covers.smallest_cover(kinds, sum_bits(kinds)) == first_cover(kinds, sum_bits(kinds))


def test_covers_of_a_hundred_anchors(spark):
    """Stretches of a long text in overlapping blocks, and copies of the blocks under larger ids."""
    wanted = [(1, "all", 0, n, f"a{n:03}") for n in range(100)] + [(2, "any", 0, n, f"b{n:03}") for n in range(70)]
    held = [(f"a{n:03}", i + copy) for copy in (0, 1000) for i in range(33) for n in range(i * 3, min(100, i * 3 + 5))] + [(f"a{n:03}", 5000) for n in range(97, 100)]
    held += [(f"b{n:03}", 7) for n in range(69)]
    found = evaluate.min_covers(spark.createDataFrame(wanted, "case_id long, mode string, group_no long, anchor_no long, anchor string"), spark.createDataFrame(held, "anchor string, i long"))
    one, two = sorted(found.collect(), key=lambda r: r["case_id"])
    assert one["complete"] and not two["complete"] and two["cover"] == [7]
    assert one["cover"] == list(range(33))


def test_covers_of_many_overlapping_blocks():
    """Blocks that hold runs of anchors: the fewest are those that always reach farthest."""
    r = random.Random(6)
    for _ in range(20):
        runs = [(a, min(100, a + r.randint(1, 9))) for a in [*range(100), *(r.randrange(100) for _ in range(60))]]
        kinds = sorted({sum(1 << n for n in range(a, b)): i for i, (a, b) in enumerate(r.sample(runs, len(runs)))}.items(), key=lambda k: k[1])
        at, fewest = 0, 0
        while at < 100:
            at, fewest = max(b for a, b in runs if a <= at), fewest + 1
        cover = covers.smallest_cover(kinds, (1 << 100) - 1)
        assert len(cover) == fewest and sum_bits([k for k in kinds if k[1] in cover]) == (1 << 100) - 1


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    assert store.published(spark, folder) is None
    first = store.new_version(folder)
    spark.range(3).write.parquet(f"{first}/t")
    assert store.published(spark, folder) is None  # broken off before it was published
    store.publish(spark, folder, first, {"size": 500})
    assert store.published(spark, folder, {"size": 500}) == first and store.published(spark, folder, {"size": 400}) is None
    half = store.new_version(folder)
    spark.range(5).write.parquet(f"{half}/t")
    assert store.published(spark, folder) == first
    for n in range(3):
        later = store.new_version(folder)
        spark.range(n).write.parquet(f"{later}/t")
        store.publish(spark, folder, later, {"n": n})
    assert store.published(spark, folder) == later and spark.read.parquet(f"{later}/t").count() == 2
    assert len(list((tmp_path / "x").glob("version-*.json"))) == store.KEPT and not (tmp_path / "x" / first.rsplit("/", 1)[-1]).exists()


def test_listed_digest_follows_the_files(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    before = store.listed_digest(spark, f"file://{tmp_path}/t")
    assert store.listed_digest(spark, f"file://{tmp_path}/t") == before
    spark.range(1).write.mode("append").parquet(f"file://{tmp_path}/t")
    assert store.listed_digest(spark, f"file://{tmp_path}/t") != before


def test_pruned_search_gives_the_same_and_reads_less(spark, tmp_path):
    """Topics stand together, as in a corpus of files; questions are of one topic and some common words."""
    r = random.Random(2)
    blocks = []
    for i in range(12 * 1024):
        topic = i // 1024
        words = [f"t{topic}w{r.randint(0, 30)}" for _ in range(r.randint(2, 6))] + [r.choice(["the", "of", "and", "in"]) for _ in range(4)]
        blocks.append((i, " ".join(words)))
    queries = spark.createDataFrame([(q, f"the t{q}w1 of t{q}w2 t{q}w2 t{q}w3 t{(q + 1) % 12}w4") for q in range(12)] + [(90, "none such"), (91, "the of"), (92, "")], "query_id long, q string")
    plain = lexical_index(spark.createDataFrame(blocks, "i long, content string"))
    store_lexical(plain, f"file://{tmp_path}/lex")
    stored = load_lexical(spark, f"file://{tmp_path}/lex")
    for k in (1, 5, 40):
        expected = rows(retrieve.bm25_topk(plain, queries, k), "query_id", "rank", "i", F.round("score", 7))
        assert rows(retrieve.bm25_topk(stored, queries, k), "query_id", "rank", "i", F.round("score", 7)) == expected
    read = retrieve.pruned_scores(stored, queries.filter("query_id < 90"), 5)[1].agg(F.sum("n")).first()[0]
    whole = retrieve.asked_terms(queries.filter("query_id < 90")).join(plain.postings, "term").count()
    assert read < 0.4 * whole


def index_state(blocks, index):
    return rows(blocks, "i", "doc_id", "source", "content"), rows(index.postings, "term", "i", "tf"), rows(index.idf, "term", "df", F.round("idf", 9)), rows(index.stats, "n", F.round("avgdl", 9)), rows(index.lengths, "i", "dl")


def built_anew(spark, docs):
    blocks = corpus.with_global_ids(chunk.fixed_chunks(chunk.told_apart(spark.createDataFrame(docs, DOCS)))).withColumnRenamed("text", "content")
    return index_state(blocks, lexical_index(blocks))


def test_an_index_kept_up_to_date_equals_one_built_anew(spark, tmp_path, monkeypatch):
    """Documents come, change, go and come back; segments are merged on the way."""
    monkeypatch.setattr(segments, "SEGMENTS", 2)
    r, folder = random.Random(1), f"file://{tmp_path}/ix"
    text = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.choice([0, 3, 300])))
    docs = {k: (k, "s", text()) for k in range(8)}
    for step in range(4):
        found = segments.update(spark, folder, spark.createDataFrame(list(docs.values()), DOCS))
        assert found["added"] == (8 if not step else 3) and found["removed"] == (0 if not step else 2)
        assert index_state(*segments.load(spark, folder)) == built_anew(spark, list(docs.values()))
        docs[step] = (step, "s", f"changed {step}")
        del docs[7 - step]
        docs |= {k: (k, "s", text()) for k in (100 + 2 * step, 101 + 2 * step)}
    assert segments.update(spark, folder, spark.createDataFrame([], DOCS))["removed"] == 11
    assert segments.load(spark, folder)[0].count() == 0


def test_segments_keep_repeated_and_null_ids_apart(spark, tmp_path):
    folder = f"file://{tmp_path}/ix"
    docs = [(1, "s", "a b"), (1, "s", "a b"), (1, "s", "c"), (None, "s", "a b"), (None, "s", "a b"), (None, None, None), (2, "s", "")]
    assert segments.update(spark, folder, spark.createDataFrame(docs, DOCS)) == {"added": 7, "removed": 0}
    assert segments.update(spark, folder, spark.createDataFrame(docs, DOCS)) == {"added": 0, "removed": 0}
    assert segments.update(spark, folder, spark.createDataFrame(docs[1:], DOCS)) == {"added": 0, "removed": 1}
    assert rows(segments.load(spark, folder)[0], "i", "doc_id", "content") == rows(spark.createDataFrame([(0, None, "a b"), (1, None, "a b"), (2, 1, "a b"), (3, 1, "c")], "i long, doc_id long, content string"), "i", "doc_id", "content")
    changes = spark.createDataFrame([(1, "s", "new", False), (2, "s", "", True), (None, "s", "lost", False)], "doc_id long, source string, text string, deleted boolean")
    assert segments.apply_changes(spark, folder, changes) == {"added": 1, "removed": 3}
    assert segments.apply_changes(spark, folder, changes) == {"added": 0, "removed": 0}


def test_documents_of_one_id_stand_in_order_of_their_texts(spark, tmp_path):
    """Whatever order and however many updates they came with."""
    r, alike = random.Random(2), "x" * 80
    docs = [(k % 2 or None, r.choice("st"), f"{r.random()} of {k}") for k in range(24)] + [(1, "s", alike + c) for c in "ab"] + [(1, "s", None), (1, "s", ""), (1, "s", alike + "a")]
    r.shuffle(docs)
    states = []
    for name, steps in (("one", [docs]), ("two", [docs[:11], docs[::-1]])):
        for step in steps:
            segments.update(spark, f"file://{tmp_path}/{name}", spark.createDataFrame(step, DOCS))
        states.append(index_state(*segments.load(spark, f"file://{tmp_path}/{name}")))
    assert states[0] == states[1]
    blocks = segments.load(spark, f"file://{tmp_path}/one")[0].orderBy("i").collect()
    key = lambda d: (d[0] is not None, d[0] or 0, d[1], d[2][:64])
    assert [key((b["doc_id"], b["source"], b["content"])) for b in blocks] == sorted(key(d) for d in docs if d[2])


def test_grams_cross_from_text_to_text(spark):
    """Short and empty texts carry over, whatever ranges the texts are dealt to."""
    r = random.Random(4)
    texts = ["".join(r.choice("abc ，") for _ in range(r.choice([0, 1, 1, 2, 3, 9]))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None)], "k long, text string").repartition(5)
    whole = "".join(c for t in texts for c in t if c not in " ，")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {x["gram"] for x in judge.corpus_grams(df, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {whole[p : p + 3] for p in range(len(whole) - 2)}
    texts = [f"{a}{b}" for a in "xyz" for b in "pqrstuvw"]  # every join has grams of its own
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    whole = "".join(texts)
    assert {x["gram"] for x in judge.corpus_grams(df, ["k"]).collect()} == {whole[p : p + 3] for p in range(len(whole) - 2)}
    assert judge.corpus_grams(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("ordered", [1, 4, 4096])
def test_medians_of_groups_of_any_size(spark, ordered):
    import statistics

    r = random.Random(3)
    groups = {("a", 1): [r.gauss(0, 1) for _ in range(801)], ("a", None): [r.choice([1.0, 2.0, 2.5]) for _ in range(400)], (None, 2): [5.0] * 50, ("b", 3): [10.0**k for k in range(-40, 40)], ("c", 1): [1.0, 2.0], ("d", 1): [-7.0]}
    data = [(*k, v) for k, vs in groups.items() for v in vs] + [("a", 1, None), ("a", 1, float("nan")), ("none", 0, None)]
    found = selection.medians(spark.createDataFrame(data, "g string, h long, v double"), ["g", "h"], "v", ordered).collect()
    assert {(x["g"], x["h"]): (x["n"], x["lower"], x["upper"]) for x in found} == {k: (len(v), statistics.median_low(v), statistics.median_high(v)) for k, v in groups.items()}


def test_replies_are_remembered(spark, tmp_path):
    from stratadoc.operators import answers

    asked = tmp_path / "asked"
    asked.mkdir()

    def model(prompts):
        import uuid

        (asked / uuid.uuid4().hex).write_text("\n".join(prompts))
        return [p.upper() for p in prompts]

    def run(prompts):
        df = spark.createDataFrame(prompts, "k long, arm string, prompt string")
        return rows(answers.remembered(df, model, ["k", "arm"], f"file://{tmp_path}/replies"), "k", "arm", "answer")

    seen = lambda: sorted(p for f in asked.iterdir() for p in f.read_text().split("\n"))
    assert run([(1, "a", "x"), (2, "a", "x"), (1, "b", "y")]) == [(1, "a", "X"), (1, "b", "Y"), (2, "a", "X")]
    assert seen() == ["x", "y"]
    assert run([(1, "a", "x"), (3, "c", "z"), (4, "c", None)]) == [(1, "a", "X"), (3, "c", "Z"), (4, "c", "")]
    assert seen() == ["", "x", "y", "z"]


def test_material_within_a_budget(spark):
    df = spark.createDataFrame([(3, "c" * 5), (1, "a" * 4), (2, "b" * 3), (4, None)], "corpus_ord long, text string")
    assert [retrieve.within_budget(df, n).first()[0] for n in (0, 3, 4, 9, 13, 14, 16, 99)] == ["", "", "aaaa", "aaaa\n\nbbb", "aaaa\n\nbbb", "aaaa\n\nbbb", "aaaa\n\nbbb\n\nccccc", "aaaa\n\nbbb\n\nccccc\n\n"]


ODD_MARKDOWN = [
    "", "\n\n", "plain", "# A\n\n\n## B\n#### D\ntext\n## C", "before\n# A\n```\n# no\n```\nafter\n    # indented\n", "~~~\nopen\n# never", "```a\n~~~\n```b\n# closed by any mark\n```\nx", "| a |\n|---|\n  | b |\ntext\n```\nf\n```\n```\ng\n```\n\n| c |",
    "#no\n####### seven\n#  two  spaces \t\n　# wide\n#\tt", "# A\n   \n# B\n　\nx", "a\r\n# b\r\nc # d", "### deep\n# top\n### again\n## mid\n#### low",
]


def test_sections_and_atoms_equal_the_core_without_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_MARKDOWN)] + [(99, None)], "doc_id long, text string")
    found = inspect.sections(docs)
    expected = [(i, n, body, sorted(path.items())) for i, t in enumerate(ODD_MARKDOWN) for n, (body, path) in enumerate(markdown.sections(t))]
    assert sorted((x["doc_id"], x["section"], x["body"], sorted(x["path"].items())) for x in found.collect()) == expected
    pieces = inspect.atoms(docs)
    expected = [(i, n, kind, "\n".join(lines)) for i, t in enumerate(ODD_MARKDOWN) for n, (kind, lines) in enumerate(markdown.atoms(t.split("\n")))]
    assert rows(pieces, "doc_id", "atom", "kind", "text") == expected
    for df in (found, pieces):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("kind", ["md", "md_plain", "flat"])
def test_chunk_as_a_table_function(spark, kind):
    from stratadoc.plans import sql

    sql.register(spark)
    docs = spark.createDataFrame([(i, "s", t + "\n" + "long text " * 80) for i, t in enumerate(ODD_MARKDOWN)] + [(99, "s", None)], DOCS)
    found = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL chunk(d.text, '{kind}') c", docs=docs)
    listed = lambda df: sorted((x["doc_id"], x["ord"], x["text"], x["offset"], sorted(x["path"].items()), x["cross_section"]) for x in df.collect())
    assert listed(found) == listed(chunk.pieces(docs, kind))
    with pytest.raises(Exception, match="kind is one of"):
        spark.sql("SELECT * FROM chunk('a', 'other')").collect()


def test_spans_count_shared_blocks_once(spark):
    wanted = spark.createDataFrame([(1, "all", 0, 0, "a"), (1, "all", 1, 0, "b"), (2, "any", 0, 0, "a"), (2, "any", 1, 0, "none"), (3, "all", 0, 0, "none")], "case_id long, mode string, group_no long, anchor_no long, anchor string")
    held = spark.createDataFrame([("a", 4), ("b", 4), ("b", 9)], "anchor string, i long")
    assert rows(evaluate.case_spans(wanted, evaluate.min_covers(wanted, held)), "case_id", "need", "span") == [(1, 2, [4]), (2, 1, [4]), (3, None, [])]


def test_words_are_counted_from_the_corpus(spark):
    texts = ["数据库很快", "数据库很大", "大数据库", "很快的数据库", "数据库，数据库", "的很", "快", "plain `a` text", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = {x["word"]: x["score"] for x in segment.lexicon(df, least=3, cohesion=2.0).collect()}
    assert {w for w in words if len(w) > 1} == {"数据", "据库", "数据库"}
    chars = [c for t in texts if t for c in t if "一" <= c <= "龥"]
    assert words["数"] == pytest.approx(__import__("math").log(chars.count("数") / len(chars)))
    assert segment.lexicon_of(df.filter("text like 'plain%'")) is None


def test_best_path_equals_all_paths(spark):
    """Of all ways to cut a run that with the largest sum of scores."""
    r = random.Random(2)
    texts = ["".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    lexicon = segment.lexicon(df, least=4, cohesion=1.0)
    words = {x["word"]: x["score"] for x in lexicon.collect()}
    assert any(len(w) > 2 for w in words)

    def ways(run):
        return [[]] if not run else [[run[:n], *rest] for n in range(1, min(segment.LONGEST, len(run)) + 1) if n == 1 or run[:n] in words for rest in ways(run[n:])]

    found = {x["run"]: x["path"] for x in segment.segmented(spark.createDataFrame([(t,) for t in [*texts, "甲戊乙"]], "run string"), lexicon).collect()}
    for run, path in found.items():
        score = lambda p: sum(words.get(w, segment.UNKNOWN) for w in p)
        assert "".join(path) == run and score(path) == pytest.approx(max(map(score, ways(run))))


def test_index_and_questions_share_their_words(spark, tmp_path):
    others = ["".join(chr(0x5000 + 40 * k + j) for j in range(40)) for k in range(6)]
    blocks = spark.createDataFrame([(i, t) for i, t in enumerate(["数据库很快", "数据库很大", "据库", "大数据库", "很快的数据库", "数据库 plain", "库数", *others])], "i long, content string")
    index = lexical_index(blocks)
    found = {x["term"] for x in index.idf.filter("length(term) > 1").collect()}
    assert {"数据库", "plain"} <= found <= {"数据库", "据库", "plain"}
    queries = spark.createDataFrame([(1, "哪个数据库")], "query_id long, q string")
    plain = rows(retrieve.bm25_topk(index, queries, 9), "i", "rank")
    store_lexical(index, f"file://{tmp_path}/lex")
    assert rows(retrieve.bm25_topk(load_lexical(spark, f"file://{tmp_path}/lex"), queries, 9), "i", "rank") == plain


def test_piece_without_a_place_is_an_error_or_has_no_offset():
    made = lambda: [markdown.Piece(t, {}, t) for t in ("ab", "no such", "cd", "ab")]
    with pytest.raises(ValueError):
        markdown.locate("ab cd ab", made())
    assert [p.offset for p in markdown.locate("ab cd ab", made(), strict=False)] == [0, None, 3, 6]


def test_document_with_a_piece_without_a_place_does_not_fail_the_table(spark, monkeypatch):
    cut = lambda text: markdown.locate(text, [markdown.Piece(t, {}, t) for t in ("ab", "cd")], strict=False)
    monkeypatch.setitem(chunk.CHUNKERS, "flat", cut)
    docs = spark.createDataFrame([(1, "a", "ab cd"), (2, "a", "cd"), (3, None, None)], DOCS)
    assert rows(chunk.pieces(docs, "flat"), "doc_id", "ord", "offset") == [(1, 0, 0), (1, 1, 3), (2, 0, None), (2, 1, 0), (3, 0, None), (3, 1, None)]


def test_preview_is_one_line_and_ends_in_an_ellipsis(spark):
    df = spark.createDataFrame([("a\nb\n",), ("x" * 60,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.preview(F.col("t"))).collect()] == ["a⏎b⏎…", "x" * 56 + "…", "…", None]


def test_index_describes_itself(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", "x" * 1001), (1, None, "y"), (2, "b", None), (3, "a", "")], "corpus_ord int, source string, text string")
    blocks = chunk.fixed_chunks(docs.withColumnRenamed("corpus_ord", "doc_id")).withColumnRenamed("doc_id", "corpus_ord")
    corpus.save_index(blocks, docs, str(tmp_path), "fixed")
    stored = corpus.load_index(spark, str(tmp_path), "fixed")[1]
    lines = [r["line"] for r in corpus.describe(stored).orderBy("line_no").collect()]
    assert lines[0].startswith("chunker=fixed size=500 overlap=0, 4 blocks of 4 texts (1002 characters), made 2")
    assert lines[1:] == ["  -: 1 characters, 1 blocks", "  a: 1001 characters, 3 blocks", "  b: 0 characters, 0 blocks"]
    assert [tuple(r) for r in corpus.describe(stored.limit(0)).collect()] == [(0, "no texts: nothing tells what this index was made of")]
