"""The registered queries: each applies an operator to whole tables and returns its full result.

How the given tables stand in for a retrieval system's: documents are the corpus, in order of doc_id, and blocks are its
500-character slices; benchmark items are the questions, and stretches of 30 characters of their texts the anchors;
embedding n is the vector of block n and of question n; assistant turns are answers, dealt to questions and arms by
their numbers. Markdown is written from the customers of each nation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.operators import answers as replies
from stratadoc.operators import chunk, evaluate, inspect, judge, retrieve, segment, selection
from stratadoc.operators.grams import near_occurrences
from stratadoc.operators.index import EPSILON, K1, SPAN_BITS, TABLES, B, LexicalIndex, build_lexical, keyed_index, lexical_index, load_lexical
from stratadoc.plans import sql
from stratadoc.session import passing, saved, shared_dir, spread, table
from stratadoc.sources import corpus as sources
from stratadoc.sources import store

K = 4
ARM_NAMES = ("dense", "bm25", "hybrid", "long")
SWEEP_K = (1, 2, 4, 8, 16)
SWEEP_DEPTH = 50
WEIGHTS = ((0.0, 1.0), (1.0, 1.0), (1.0, 3.0), (1.0, 10.0), (1.0, 0.0))
SWEEP_RRF = (1, 5, 20, 60)
CUSTOMERS = 500
#: Settings of the chunker screen: name, chunker, whether headings are put before the text.
SCREENED = (("fixed", None, False), ("flat", "flat", False), ("md", "md", False), ("md_inject", "md", True), ("md_plain", "md_plain", False), ("md_plain_inject", "md_plain", True))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _r(c: str | Column, digits: int = 6) -> Column:
    """Rounded as SQL has it: what is negative stays so, if it comes to zero as well."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.abs(F.round(c, digits))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("corpus_ord"), "source", sources.headed(F.col("source"), F.col("text")).alias("text"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return sources.with_global_ids(chunk.fixed_chunks(chunk.told_apart(documents(spark, d)))).select("i", "doc_id", "source", F.col("text").alias("content"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id")
    return table(spark, d, "benchmark").select(
        n.alias("case_id"), F.when(n % 2 == 0, "any").otherwise("all").alias("mode"),
        F.when(n % 4 < 2, "design").otherwise("bug").alias("bank"), F.when(n % 2 == 0, "focused").otherwise("scattered").alias("type"), F.col("text").alias("q"),
    )


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """An item's whole text in stretches of 30 characters, four to a group."""
    rows = cases(spark, d).filter("q <> ''").select("case_id", "mode", "q", F.explode(F.sequence(F.lit(0), F.ceil(F.length("q") / 30).cast("int") - 1)).alias("n"))
    return rows.select("case_id", "mode", F.floor(F.col("n") / 4).alias("group_no"), (F.col("n") % 4).cast("long").alias("anchor_no"), F.substring("q", F.col("n") * 30 + 1, F.lit(30)).alias("anchor"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), retrieve.normalize(F.col("embedding")).alias("v"))


def index(spark: SparkSession, d: str) -> tuple[DataFrame, LexicalIndex]:
    """Blocks and their lexical index: the stored one where it was made of the documents' files as they are and in the
    same way, else a new one, which is stored. It lies in the folder of spark.stratadoc.index, or in the shared one."""
    folder = spark.conf.get("spark.stratadoc.index", None) or f"{shared_dir(spark)}/indexes"
    folder = f"{folder.rstrip('/')}/{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    settings = {"chunker": "fixed", "size": 500, "terms": hashlib.sha256(repr((T.WORD, T.PLAIN_WORD, T.NOT_PLAIN, T.CODE_SEGMENT, T.CODE_SPLIT)).encode()).hexdigest(), "scores": [K1, B, EPSILON], "words": [segment.LONGEST, segment.LEAST, segment.COHESION], "tables": [*TABLES, SPAN_BITS], "files": store.listed_digest(spark, f"{d}/documents.parquet")}
    version = store.published(spark, folder, settings)
    if version is None:
        version = store.new_version(folder)
        own = documents(spark, d).withColumnRenamed("doc_id", "corpus_ord")
        with passing(spark):
            sources.save_index(blocks(spark, d).withColumnRenamed("doc_id", "corpus_ord"), own, version, "fixed")
        build_lexical(sources.load_index(spark, version, "fixed")[0].select("i", "content"), version)
        store.publish(spark, folder, version, settings)
    stored, _ = sources.load_index(spark, version, "fixed")
    return stored.withColumnRenamed("corpus_ord", "doc_id").drop("chunker"), load_lexical(spark, version)


def rankings(spark: SparkSession, d: str, most: int) -> tuple[DataFrame, LexicalIndex, DataFrame, DataFrame]:
    """Blocks, their index, and both arms' rankings of the questions to depth `most`."""
    found, lexical = index(spark, d)
    asked = questions(spark, d)
    own = asked.join(vectors(spark, d).withColumnsRenamed({"i": "query_id", "v": "qv"}), "query_id").select("query_id", "qv")
    # Each is read several times by what compares them.
    dense = saved(retrieve.dense_topk(vectors(spark, d), own, most), "dense-ranking")
    return found, lexical, dense, saved(retrieve.bm25_topk(lexical, asked, most), "lexical-ranking")


def hits_at(dense: DataFrame, bm25: DataFrame, k: int) -> DataFrame:
    """query_id, arm, rank, i of the three arms at k."""
    cols = ["query_id", "arm", "rank", "i"]
    hybrid = retrieve.hybrid_topk(dense, bm25, k).withColumn("arm", F.lit("hybrid"))
    pure = [x.filter(F.col("rank") <= k).withColumn("arm", F.lit(n)) for n, x in (("dense", dense), ("bm25", bm25))]
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in (*pure, hybrid)])


def evaluated(spark: SparkSession, d: str, ks: tuple[int, ...] = (K,)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Results by k, arm and case, with the blocks, the anchors, and which blocks hold them."""
    found, _, dense, bm25 = rankings(spark, d, max(map(retrieve.depth, ks)))
    hits = reduce(DataFrame.unionByName, [hits_at(dense, bm25, k).withColumn("k", F.lit(k).cast("long")) for k in ks])
    wanted = anchors(spark, d)
    holding = evaluate.containing_blocks(wanted, found)
    return evaluate.coverage(wanted, hits.withColumnRenamed("query_id", "case_id"), holding, ["k", "arm"]), found, wanted, holding


def answers(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "conversations")).filter("role = 'assistant'")
    n = table(spark, d, "benchmark").agg(F.count("*").alias("n_cases"))
    arm = F.element_at(F.array(*map(F.lit, ARM_NAMES)), (F.floor(F.col("turn") / 2) % 4 + 1).cast("int"))
    rows = turns.crossJoin(F.broadcast(n)).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.pmod("conv_id", "n_cases").alias("case_id"), arm.alias("arm"), F.col("text").alias("answer")
    )
    return rows.join(cases(spark, d).drop("q", "mode"), "case_id")


def judged(spark: SparkSession, d: str) -> DataFrame:
    found = answers(spark, d)
    groups = judge.judge_groups(found.select("answer_id", "case_id", "answer"), anchors(spark, d))
    return found.join(judge.judge_cases(groups), ["answer_id", "case_id"])


def case_deltas(spark: SparkSession, d: str) -> DataFrame:
    found = answers(spark, d)
    floors = judge.gram_floor(found.select("answer_id", "case_id", "answer"), anchors(spark, d), judge.across(cases(spark, d)))
    return judge.deltas(judged(spark, d), floors)


def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, text: the customers of a nation, CUSTOMERS consecutive keys at a time, as Markdown."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("part", F.floor(F.col("c_custkey") / CUSTOMERS))
    listed = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")))
    docs = rows.groupBy("n_nationkey", "n_name", "r_name", "part").agg(listed.alias("c"))
    row = lambda c: F.concat_ws("", F.lit("| "), c["c_custkey"], F.lit(" | "), c["c_name"], F.lit(" | "), c["c_mktsegment"], F.lit(" |"))
    body = F.concat_ws(
        "", F.lit("# "), "r_name", F.lit("\n\nCustomers of "), "n_name", F.lit(".\n\n## "), "n_name", F.lit(" "), "part", F.lit("\n\n| key | name | segment |\n|---|---|---|\n"),
        F.array_join(F.transform("c", row), "\n"), F.lit("\n\n### Notes\n\n```text\n# "), "n_name", F.lit("\n"), F.array_join(F.transform("c", lambda c: c["c_name"]), "\n"),
        F.lit("\n```\nAfter the fence: "), F.size("c"), F.lit(" customers.\n"),
    )
    return docs.select((F.col("n_nationkey").cast("long") * 1_000_000 + F.col("part")).alias("doc_id"), F.col("n_name").alias("source"), body.alias("text"))


# ------------------------------------------------------------------------------- texts


@query
def corpus_scan(spark, d):
    return corpus(spark, d).select("corpus_ord", "source", _long(F.length("text")).alias("chars"), F.sha2("text", 256).alias("sha256"))


@query
def corpus_concat(spark, d):
    """Each source's concatenation as the pieces it is made of, with their places in it."""
    return sources.corpus_text(corpus(spark, d), "source").select("source", "corpus_ord", "offset", _long(F.length("text")).alias("chars"), F.sha2("text", 256).alias("sha256"))


@query
def normalize(spark, d):
    n = T.norm(F.col("text"))
    return documents(spark, d).select("doc_id", _long(F.length(n)).alias("chars"), F.sha2(n, 256).alias("sha256"))


@query
def char_ngrams(spark, d):
    grams = T.char_ngrams(F.col("text"))
    return documents(spark, d).select("doc_id", _long(F.size(grams)).alias("n_grams"), _long(F.size(F.array_distinct(grams))).alias("n_distinct"))


@query
def identifiers(spark, d):
    found = documents(spark, d).select("doc_id", T.identifiers(F.col("text")).alias("ids"))
    return found.select("doc_id", _long(F.size("ids")).alias("n_ids"), F.sha2(F.array_join("ids", "|"), 256).alias("ids_sha256"))


@query
def tokenize(spark, d):
    found = documents(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return found.select("doc_id", _long(F.size("t")).alias("n_terms"), F.sha2(F.array_join("t", " "), 256).alias("terms_sha256"))


def _han_docs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text: what each order is, written in Han characters from the order's own values."""
    digits = lambda c: F.translate(F.col(c).cast("string"), "0123456789", "零一二三四五六七八九")
    state = F.when(F.col("o_orderstatus") == "F", "已经完成").when(F.col("o_orderstatus") == "O", "正在处理").otherwise("部分完成")
    level = F.concat(F.lit("优先级"), F.translate(F.substring("o_orderpriority", 1, 1), "12345", "一二三四五"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("客户"), digits("o_custkey"), F.lit("的订单"), state, F.lit("，"), level, F.lit(" `"), "o_orderkey", F.lit("`")).alias("text"))


@query
def han_terms(spark, d):
    """Orders described in Han characters, cut into the words that the descriptions themselves show."""
    docs = saved(_han_docs(spark, d), "han-texts")
    found = segment.terms(docs, ["doc_id"], "text", segment.lexicon_of(docs))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sha2(F.array_join(F.array_sort(F.collect_list("term")), " "), 256).alias("terms_sha256"))


@query
def block_anchors(spark, d):
    return chunk.fixed_chunks(documents(spark, d)).select("doc_id", _long("ord").alias("ord"), T.anchor_of(F.col("text")).alias("anchor"))


@query
def refusal(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query
def fuzzy_contains(spark, d):
    """Each answer against its case's anchors, the last character of every other anchor changed."""
    a = F.when(F.col("anchor_no") == 1, F.concat(F.expr("left(anchor, length(anchor) - 1)"), F.lit("#"))).otherwise(F.col("anchor"))
    wanted = anchors(spark, d).select("case_id", "group_no", "anchor_no", T.norm(a).alias("a"))
    texts = saved(answers(spark, d).select("case_id", "answer_id", T.norm(F.col("answer")).alias("text")), "answer-texts")
    near = near_occurrences(wanted.select("case_id", F.col("a").alias("needle")), texts, "answer_id", ("case_id",))
    near = near.groupBy("case_id", F.col("needle").alias("a")).agg(F.count("*").alias("n_near"))
    rows = wanted.join(texts.groupBy("case_id").agg(F.count("*").alias("n")), "case_id").join(near, ["case_id", "a"], "left")
    # An empty needle is in every text.
    return rows.select("case_id", "group_no", "anchor_no", F.when(F.col("a") == "", F.col("n")).otherwise(F.coalesce("n_near", F.lit(0))).alias("n_near"), "n")


# ------------------------------------------------------------------------------- index


@query
def fixed_chunks(spark, d):
    return chunk.fixed_chunks(documents(spark, d)).select("doc_id", _long("ord").alias("ord"), _long(F.length("text")).alias("chars"), F.sha2("text", 256).alias("sha256"))


@query
def block_ids(spark, d):
    return blocks(spark, d).select("i", "doc_id", F.sha2("content", 256).alias("sha256"))


@query
def blocks_per_source(spark, d):
    return blocks(spark, d).groupBy("source").agg(F.count("*").alias("n_blocks"))


@query
def index_manifest(spark, d):
    own = documents(spark, d).withColumnRenamed("doc_id", "corpus_ord")
    return sources.manifest(own, blocks(spark, d).withColumnRenamed("doc_id", "corpus_ord")).select("corpus_ord", "source", "chars", "sha256", "block_count")


@query
def index_build(spark, d):
    """Writes the index and reads it back."""
    from stratadoc.session import new_path

    path = new_path(spark, "index")
    own = documents(spark, d).withColumnRenamed("doc_id", "corpus_ord")
    sources.save_index(blocks(spark, d).withColumnRenamed("doc_id", "corpus_ord"), own, path, "fixed")
    stored, manifest = sources.load_index(spark, path, "fixed")
    stale = sources.stale_sources(manifest, own).agg(F.count("*").alias("n_stale"))
    return stored.groupBy("chunker").agg(F.count("*").alias("n_blocks"), F.count_distinct("corpus_ord").alias("n_texts")).crossJoin(F.broadcast(stale))


@query
def bm25_postings(spark, d):
    return lexical_index(blocks(spark, d)).postings.groupBy("term").agg(F.count("*").alias("n_blocks"), F.sum("tf").alias("n"))


@query
def bm25_idf(spark, d):
    return lexical_index(blocks(spark, d)).idf.select("term", "df", _r("idf").alias("idf"))


@query
def chunk_length_stats(spark, d):
    rows = saved(chunk.fixed_chunks(documents(spark, d)).select("doc_id", F.length("text").alias("n")), "block-lengths")
    sums = rows.groupBy("doc_id").agg(_long(F.min("n")).alias("shortest"), _long(F.max("n")).alias("longest"), _r(F.avg("n")).alias("mean"))
    return sums.join(selection.medians(rows, ["doc_id"], "n").select("doc_id", _long("upper").alias("median")), "doc_id")


# ------------------------------------------------------------------------------- retrieval


@query
def l2_normalize(spark, d):
    return vectors(spark, d).select(F.col("i").alias("vec_id"), F.transform("v", lambda x: _r(x)).alias("v"))


@query
def dense_topk(spark, d):
    found = vectors(spark, d)
    asked = found.filter("i % 50 = 0").withColumnsRenamed({"i": "query_id", "v": "qv"})
    return retrieve.dense_topk(found, asked, K).select("query_id", "rank", "i", _r("score").alias("score"))


#: What stands before a question when it is encoded.
QUERY_PREFIX = "query: "


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model that embeds: how often each letter occurs."""
    return [[float(low.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for low in map(str.lower, texts)]


@query
def encoded_topk(spark, d):
    """Blocks and questions encoded, the questions with their prefix, and the nearest blocks of each."""
    held, _ = index(spark, d)
    stored = saved(retrieve.encoded(held.select("i", F.col("content").alias("text")), _letters), "block-vectors")
    asked = retrieve.encoded(questions(spark, d).select(F.col("query_id").alias("i"), F.col("q").alias("text")), _letters, QUERY_PREFIX)
    found = retrieve.dense_topk(stored, asked.withColumnsRenamed({"i": "query_id", "v": "qv"}), K)
    return found.select("query_id", "rank", "i", _r("score").alias("score"))


@query
def bm25_topk(spark, d):
    _, lexical = index(spark, d)
    return retrieve.bm25_topk(lexical, questions(spark, d), 20).select("query_id", "rank", "i", _r("score").alias("score"))


@query
def hybrid_arms(spark, d):
    _, _, dense, bm25 = rankings(spark, d, retrieve.depth(K))
    return retrieve.arms(dense, bm25, K)


@query
def rrf_fuse(spark, d):
    _, _, dense, bm25 = rankings(spark, d, retrieve.depth(K))
    return retrieve.rrf_fuse(retrieve.arms(dense, bm25, K)).select("query_id", "i", _r("score", 9).alias("score"))


@query
def hybrid_topk(spark, d):
    _, _, dense, bm25 = rankings(spark, d, retrieve.depth(K))
    return retrieve.hybrid_topk(dense, bm25, K).select("query_id", "rank", "i", _r("score", 9).alias("score"))


def _lexical_hits(spark, d):
    found, lexical = index(spark, d)
    hits = saved(retrieve.bm25_topk(lexical, questions(spark, d), K).select("query_id", "rank", "i"), "lexical-hits")
    return saved(retrieve.lookup(hits, found), "hit-blocks")


@query
def hits_lookup(spark, d):
    return _lexical_hits(spark, d).select("query_id", "rank", "i", "source", F.sha2("content", 256).alias("sha256"))


@query
def hits_preview(spark, d):
    """What was found, as a listing shows it: length, and the beginning on one line."""
    return _lexical_hits(spark, d).select("query_id", "rank", "i", F.length("content").cast("long").alias("chars"), T.preview(F.col("content")).alias("preview"))


@query
def distractors(spark, d):
    """Of each question's blocks, those from sources with a 1 in their name."""
    return _lexical_hits(spark, d).groupBy("query_id").agg(F.count_if(F.contains("source", F.lit("1"))).alias("n_distractors"), F.count("*").alias("n_hits"))


@query
def format_context(spark, d):
    return retrieve.context(_lexical_hits(spark, d))


@query
def prompt_messages(spark, d):
    rows = retrieve.context(_lexical_hits(spark, d)).join(questions(spark, d), "query_id")
    found = rows.select("query_id", F.posexplode(retrieve.messages(F.col("context"), F.col("q"))).alias("n", "m"))
    return found.select("query_id", _long("n").alias("n"), "m.role", F.sha2("m.content", 256).alias("sha256"))


# ------------------------------------------------------------------------------- retrieval evaluation


@query
def retrieval_ok(spark, d):
    return evaluated(spark, d)[0].select("arm", "case_id", "ok", "mark")


@query
def k_sweep(spark, d):
    return evaluated(spark, d, SWEEP_K)[0].groupBy("k", "arm").agg(F.count_if("ok").alias("n_ok"), F.count_if(F.col("mark") == "partial").alias("n_partial"), F.count("*").alias("n"))


@query
def hit_rate_pivot(spark, d):
    results, _, wanted, holding = evaluated(spark, d)
    needs = evaluate.case_needs(wanted, evaluate.min_covers(wanted, holding))
    rows = results.join(cases(spark, d).select("case_id", "bank", "type"), "case_id").join(needs, "case_id")
    rates = rows.groupBy("bank", "type").pivot("arm", ["dense", "bm25", "hybrid"]).agg(_r(F.avg(F.col("ok").cast("int"))))
    return rates.join(rows.groupBy("bank", "type").agg(_r(F.avg("need")).alias("mean_need")), ["bank", "type"])


@query
def disagreements(spark, d):
    return evaluate.disagreements(evaluated(spark, d)[0])


@query
def attribution(spark, d):
    results, _, wanted, holding = evaluated(spark, d)
    return evaluate.attribution(results.filter("arm = 'hybrid'"), evaluate.case_needs(wanted, evaluate.min_covers(wanted, holding)), K)


def _held(spark, d):
    found, _ = index(spark, d)
    wanted = anchors(spark, d)
    return found, wanted, evaluate.containing_blocks(wanted, found)


@query
def min_cover(spark, d):
    _, wanted, holding = _held(spark, d)
    return evaluate.min_covers(wanted, holding)


@query
def anchor_audit(spark, d):
    _, wanted, holding = _held(spark, d)
    # What no block holds may stand across their borders; what one holds is in the corpus.
    missing = wanted.join(holding.select("anchor"), "anchor", "left_anti")
    texts = chunk.told_apart(documents(spark, d)).select(F.col("row").alias("i"), F.col("text").alias("content"))
    across = evaluate.containing_blocks(missing, saved(texts, "texts"))
    return evaluate.audit(wanted, holding, holding.select("anchor").unionByName(across.select("anchor")))


@query
def arm_overlap(spark, d):
    _, _, dense, bm25 = rankings(spark, d, retrieve.depth(K))
    sets = hits_at(dense, bm25, K).groupBy("query_id").pivot("arm", ["dense", "bm25", "hybrid"]).agg(F.collect_set("i"))
    shared = lambda a, b: _long(F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)))
    return sets.select("query_id", shared("dense", "bm25").alias("dense_bm25"), shared("dense", "hybrid").alias("dense_hybrid"), shared("bm25", "hybrid").alias("bm25_hybrid"))


@query
def case_spans(spark, d):
    """What a case needs, and how many blocks its groups' covers have together: one that covers share counts once."""
    _, wanted, holding = _held(spark, d)
    return evaluate.case_spans(wanted, evaluate.min_covers(wanted, holding)).select("case_id", "need", _long(F.size("span")).alias("n_span"))


GRID = ["w_dense", "w_bm25", "rrf_k"]


def _swept(spark, d):
    """For each case and each weighting and constant of the fusion at one depth: ok, n_hit. An arm alone is fused once."""
    found, _, dense, bm25 = rankings(spark, d, SWEEP_DEPTH)
    grid = [(a, b, k) for a, b in WEIGHTS for k in (SWEEP_RRF if a and b else SWEEP_RRF[:1])]
    rows = spark.createDataFrame(grid, "w_dense double, w_bm25 double, rrf_k int")
    both = dense.withColumn("arm", F.lit("dense")).select("query_id", "arm", "rank", "i").unionByName(bm25.withColumn("arm", F.lit("bm25")).select("query_id", "arm", "rank", "i"))
    weight = F.when(F.col("arm") == "dense", F.col("w_dense")).otherwise(F.col("w_bm25"))
    scores = both.crossJoin(F.broadcast(rows)).withColumn("w", weight).filter("w > 0").groupBy(*GRID, "query_id", "i").agg(F.sum(F.col("w") / (F.col("rrf_k") + F.col("rank"))).alias("score"))
    hits = retrieve.top(scores, K, [*GRID, "query_id"]).withColumnRenamed("query_id", "case_id")
    wanted = anchors(spark, d)
    holding = evaluate.containing_blocks(wanted, found)
    return evaluate.coverage(wanted, hits, holding, GRID).withColumn("rrf_k", _long("rrf_k"))


@query
def fuse_sweep(spark, d):
    """Every weighting and constant of the fusion, over all cases."""
    return _swept(spark, d).groupBy(*GRID).agg(F.count_if("ok").alias("n_ok"), F.sum("n_hit").alias("n_hit"))


@query
def fuse_sweep_by_bank(spark, d):
    """The sweep for each bank of cases and for all, and how a setting stands to the best one of its bank."""
    each = _swept(spark, d).join(cases(spark, d).select("case_id", "bank"), "case_id").select(*GRID, "ok", F.explode(F.array("bank", F.lit("total"))).alias("bank"))
    counts = each.groupBy(*GRID, "bank").agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n"))
    best = counts.groupBy("bank").agg(F.max("n_ok").alias("most"))
    return counts.join(F.broadcast(best), "bank").select(*GRID, "bank", "n_ok", "n", (F.col("most") - F.col("n_ok")).alias("behind"))


@query
def chunker_screen(spark, d):
    """Chunkers compared by lexical retrieval alone, before any vector is made; those of Markdown with and without
    structure, and with and without the headings put before what is indexed."""
    screened = []
    for n, (name, cut, inject) in enumerate(SCREENED):
        docs = chunk.told_apart(documents(spark, d))
        parts = chunk.fixed_chunks(docs) if cut is None else chunk.pieces(docs, cut)
        content = T.render(F.col("text"), F.col("path")) if inject else F.col("text")
        # A block's number tells its variant as well, so that all variants are one table of blocks.
        i = (F.col("i") + F.lit(n << 40)).alias("i")
        screened.append(sources.with_global_ids(parts).select(F.lit(name).alias("variant"), i, content.alias("content")))
    found = saved(reduce(DataFrame.unionByName, screened), "screened-blocks")
    postings, idf = keyed_index(found, "variant")
    # A term of a variant is a term of its own; a span holds blocks of one variant.
    own = F.concat_ws("|", "variant", "term").alias("term")
    asked = saved(retrieve.asked_terms(questions(spark, d)).join(idf, "term").select("query_id", own, "times", "idf"), "asked-terms")
    rows = postings.select(own, F.shiftright("i", SPAN_BITS).alias("span"), "i", "tf", "dl")
    variant = F.element_at(F.array(*(F.lit(s[0]) for s in SCREENED)), (F.shiftright("i", 40) + 1).cast("int"))
    scored = retrieve.span_scores(rows, asked, 1.0, 8, "screened-scores").withColumn("variant", variant)
    hits = retrieve.top(scored, 8, ["variant", "query_id"]).filter("score > 0").withColumnRenamed("query_id", "case_id")
    hits = saved(reduce(DataFrame.unionByName, [hits.filter(F.col("rank") <= k).withColumn("k", F.lit(k).cast("long")) for k in (4, 8)]), "screened-hits")
    wanted = anchors(spark, d)
    results = evaluate.coverage(wanted, hits, evaluate.containing_blocks(wanted, found), ["variant", "k"])
    return results.groupBy("variant", "k").agg(F.count_if("ok").alias("n_ok"), F.sum("n_hit").alias("n_hit"))


# ------------------------------------------------------------------------------- answers


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


@query
def judge_group(spark, d):
    groups = judge.judge_groups(answers(spark, d).select("answer_id", "case_id", "answer"), anchors(spark, d))
    return _rounded(groups.drop("mode"), *judge.METRICS)


@query
def judge_case(spark, d):
    return _rounded(judged(spark, d).select("answer_id", "case_id", *judge.METRICS), *judge.METRICS)


@query
def corpus_ngrams(spark, d):
    return judge.corpus_grams(documents(spark, d).select("doc_id", "text"), ["doc_id"])


@query
def copy_ratio(spark, d):
    grams = judge.corpus_grams(documents(spark, d).select("doc_id", "text"), ["doc_id"])
    return _rounded(judge.copy_ratios(answers(spark, d), grams), "copy")


@query
def gram_null(spark, d):
    floors = judge.gram_floor(answers(spark, d).select("answer_id", "case_id", "answer"), anchors(spark, d), judge.across(cases(spark, d)))
    return _rounded(floors, "gram_null")


@query
def deltas(spark, d):
    return _rounded(case_deltas(spark, d).select("answer_id", "case_id", "arm", "gram", "gram_null", "delta"), "gram", "gram_null", "delta")


@query
def verdict(spark, d):
    rows = case_deltas(spark, d).groupBy("case_id", "bank", "type", "arm").agg(F.avg("delta").alias("delta"))
    return judge.verdicts(rows)


@query
def raw_verdict(spark, d):
    """The verdict over gram scores without a floor."""
    rows = judge.raw_deltas(judged(spark, d)).groupBy("case_id", "bank", "type", "arm").agg(F.avg("delta").alias("delta"))
    return judge.verdicts(rows)


@query
def stored_floor_deltas(spark, d):
    """Deltas over floors that were stored with the scores, in a run's dump of JSON lines."""
    from stratadoc.session import new_path

    floors = judge.gram_floor(answers(spark, d).select("answer_id", "case_id", "answer"), anchors(spark, d), judge.across(cases(spark, d)))
    path = new_path(spark, "dump")
    sources.write_json_lines(judged(spark, d).join(floors, "answer_id").select("answer_id", "case_id", "arm", "gram", "gram_null"), path)
    stored = sources.read_json_lines(spark, path, "answer_id long, case_id long, arm string, gram double, gram_null double")
    return _rounded(judge.deltas(stored).select("answer_id", "case_id", "arm", "delta"), "delta")


@query
def arm_delta_medians(spark, d):
    """For each two arms the median difference of their deltas over the cases that both have."""
    rows = saved(case_deltas(spark, d).groupBy("case_id", "arm").agg(F.avg("delta").alias("delta")), "case-deltas")
    other = rows.select("case_id", F.col("arm").alias("arm_b"), F.col("delta").alias("other"))
    pairs = rows.withColumnRenamed("arm", "arm_a").join(other, "case_id").filter("arm_a < arm_b").withColumn("apart", F.round(F.abs(F.col("delta") - F.col("other")), 9))
    found = selection.medians(pairs, ["arm_a", "arm_b"], "apart")
    return found.select("arm_a", "arm_b", "n", _r((F.col("lower") + F.col("upper")) / 2).alias("median"))


@query
def mean_delta(spark, d):
    rows = case_deltas(spark, d).groupBy("case_id", "arm").agg(F.avg("delta").alias("delta"))
    return _rounded(judge.mean_deltas(rows), "mean_delta")


@query
def score_summary(spark, d):
    copied = judge.copy_ratios(answers(spark, d), judge.corpus_grams(documents(spark, d).select("doc_id", "text"), ["doc_id"]))
    return _rounded(judge.score_summary(judged(spark, d).join(copied, "answer_id")), *judge.METRICS, "copy", "chars")


@query
def metric_conflicts(spark, d):
    return _rounded(judge.conflicts(judged(spark, d)).select("answer_id", "strict_fuzzy", "gram"), "strict_fuzzy", "gram")


@query
def usage_extract(spark, d):
    hit = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", F.floor("value").cast("long").alias("input_tokens"), F.coalesce(hit, F.lit(0)).cast("long").alias("cache_hit"))


@query
def usage_by_arm(spark, d):
    rows = usage_extract(spark, d).join(table(spark, d, "events").select("event_id", F.col("event_type").alias("arm")), "event_id")
    total, hit = F.sum("input_tokens"), F.sum("cache_hit")
    return rows.groupBy("arm").agg(total.alias("input_tokens"), hit.alias("cache_hit"), _r(hit / F.nullif(total, F.lit(0))).alias("hit_share"), ((F.max("input_tokens") - F.min("input_tokens")) > 2000).alias("input_varies"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Events as a model's replies: the cache's hits in the one layout, the other, or neither; some without an output count."""
    v, k, n = F.floor("value").cast("long"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)), F.col("event_id")
    usage = F.struct(v.alias("input_tokens"), F.when(n % 7 != 0, k).alias("output_tokens"), F.when(n % 3 == 0, F.struct(k.alias("cache_read"))).alias("input_token_details"))
    response = F.when(n % 3 == 1, F.struct((k + 1).alias("prompt_cache_hit_tokens"), (v - k).alias("prompt_cache_miss_tokens")))
    reply = F.to_json(F.struct(usage.alias("usage_metadata"), response.alias("response_metadata")))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("arm"), reply.alias("reply"))


@query
def usage_layouts(spark, d):
    return _replies(spark, d).select("event_id", *(c.alias(n) for n, c in replies.usage_of(F.col("reply")).items()))


@query
def usage_totals(spark, d):
    rows = _replies(spark, d).select("arm", *(c.alias(n) for n, c in replies.usage_of(F.col("reply")).items()))
    return _rounded(replies.usage_totals(rows), "hit_share")


@query
def source_check(spark, d):
    return sources.source_check(blocks(spark, d), "1")


def _first_words(prompts: list[str]) -> list[str]:
    """A stand-in for a model that answers: the beginning of the material."""
    return [p[p.find("资料：\n") + 4 :][:100] for p in prompts]


@query
def answer_run(spark, d):
    """The cited prompt of each question over its lexical hits, answered by a stand-in model."""
    rows = retrieve.context(_lexical_hits(spark, d)).join(questions(spark, d), "query_id")
    prompts = rows.select("query_id", retrieve.cited_prompt(F.col("context"), F.col("q")).alias("prompt"))
    return replies.answered(prompts.withColumn("sha256", F.sha2("prompt", 256)), _first_words, ["query_id", "sha256"])


#: Characters of material that the long arm gets: as much as a model's window has room for.
LONG_BUDGET = 20_000


def _arm_prompts(spark: SparkSession, d: str) -> DataFrame:
    """query_id, arm, prompt (roles and contents): each question with each arm's material."""
    found, _, dense, bm25 = rankings(spark, d, retrieve.depth(K))
    hits = retrieve.lookup(saved(hits_at(dense, bm25, K), "hits"), found.select("i", "content"))
    contexts = retrieve.context(hits, ("query_id", "arm"))
    asked = questions(spark, d)
    material = retrieve.within_budget(corpus(spark, d), LONG_BUDGET)  # one row of that size at most
    long = asked.select("query_id").crossJoin(F.broadcast(material)).select("query_id", F.lit("long").alias("arm"), "context")
    rows = contexts.select("query_id", "arm", "context").unionByName(long).join(asked, "query_id")
    parts = F.transform(retrieve.messages(F.col("context"), F.col("q")), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return rows.select("query_id", "arm", F.array_join(parts, "\n").alias("prompt"))


def _arm_replies(spark: SparkSession, d: str) -> DataFrame:
    from stratadoc.session import new_path

    # The setting names a folder that outlives the run; without it the replies are this run's own.
    folder = spark.conf.get("spark.stratadoc.replies", None) or new_path(spark, "replies")
    prompts = _arm_prompts(spark, d).withColumn("n_prompt", F.length("prompt"))
    return replies.remembered(prompts, _first_words, ["query_id", "arm", "n_prompt"], folder)


@query
def answer_arms(spark, d):
    """Every question by every arm, the long one over the corpus's first texts; no prompt is asked twice."""
    return _arm_replies(spark, d).select("query_id", "arm", "digest", "answer")


@query
def answer_usage(spark, d):
    """What the arms' prompts and replies come to, in characters, and whether an arm's prompts differ in size."""
    rows = _arm_replies(spark, d).select("arm", _long("n_prompt").alias("input_tokens"), _long(F.length("answer")).alias("output_tokens"), F.lit(None).cast("long").alias("cache_hit"), F.lit(None).cast("long").alias("cache_miss"))
    return replies.usage_totals(rows).select("arm", F.col("input_tokens").alias("n_input"), F.col("output_tokens").alias("n_output"), "n", "input_varies")


@query
def chunk_lateral(spark, d):
    """The slicing chunker as a table function of SQL."""
    sql.register(spark)
    found = spark.sql("SELECT d.doc_id, c.ord, c.offset, c.text FROM {docs} d, LATERAL chunk(d.text, 'fixed') c", docs=documents(spark, d))
    return found.select("doc_id", _long("ord").alias("ord"), _long("offset").alias("offset"), F.sha2("text", 256).alias("sha256"))


# ------------------------------------------------------------------------------- Markdown


@query
def md_chunks_lateral(spark, d):
    """The Markdown chunker as a table function of SQL."""
    sql.register(spark)
    found = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk(d.text, 'md') c", docs=markdown_docs(spark, d))
    return found.select("doc_id", _long("ord").alias("ord"), _long("offset").alias("offset"), T.heading_path(F.col("path")).alias("heading"), "text", "cross_section")


@query
def md_sections(spark, d):
    found = inspect.sections(markdown_docs(spark, d))
    return found.select("doc_id", _long("section").alias("section"), T.heading_path(F.col("path")).alias("heading"), "body")


@query
def heading_path(spark, d):
    """Blocks as they are indexed: the headings of their sections before them."""
    found = inspect.sections(markdown_docs(spark, d))
    return found.select("doc_id", _long("section").alias("section"), F.sha2(T.render(F.col("body"), F.col("path")), 256).alias("sha256"))


@query
def md_atoms(spark, d):
    return inspect.atoms(markdown_docs(spark, d)).select("doc_id", _long("atom").alias("atom"), "kind", F.sha2("text", 256).alias("sha256"))


@query
def md_chunks(spark, d):
    """The structure-aware chunker's blocks, with global ids."""
    found = sources.with_global_ids(chunk.pieces(chunk.told_apart(markdown_docs(spark, d)), "md"))
    return found.select("i", "doc_id", _long("offset").alias("offset"), T.heading_path(F.col("path")).alias("heading"), "text", "cross_section")


@query
def table_split(spark, d):
    rows = table(spark, d, "customer").select(
        (_long("c_nationkey") * 1_000_000 + F.floor(F.col("c_custkey") / CUSTOMERS)).alias("table_id"), F.lit("| key | name |").alias("head"), F.lit("|---|---|").alias("rule"), F.col("c_custkey").alias("row_no"),
        F.concat_ws("", F.lit("| "), "c_custkey", F.lit(" | "), "c_name", F.lit(" |")).alias("row"),
    )
    return chunk.table_parts(rows).select("table_id", "part_no", F.sha2("text", 256).alias("sha256"))


@query
def lone_fences(spark, d):
    parts = chunk.fixed_chunks(markdown_docs(spark, d))
    return parts.select("doc_id", _long("ord").alias("ord"), T.lone_fences(F.col("text")).alias("n_fences"))


@query
def headerless_tables(spark, d):
    parts = chunk.fixed_chunks(markdown_docs(spark, d))
    return parts.groupBy("doc_id").agg(F.count_if(inspect.headerless(F.col("text"))).alias("headerless"))


@query
def fence_ranges(spark, d):
    return inspect.fence_ranges(markdown_docs(spark, d))


@query
def table_ranges(spark, d):
    return inspect.table_ranges(markdown_docs(spark, d))


@query
def headings_at(spark, d):
    return inspect.headings(markdown_docs(spark, d))


def _fixed_with_offsets(docs: DataFrame) -> DataFrame:
    return chunk.fixed_chunks(docs).withColumn("offset", F.col("ord") * 500)


@query
def in_ranges(spark, d):
    """Borders of 500-character slices that fall inside a fence."""
    docs = markdown_docs(spark, d)
    starts = _fixed_with_offsets(docs).filter("ord > 0").select("doc_id", _long("offset").alias("offset"))
    ranges = inspect.fence_ranges(docs).withColumnRenamed("doc_id", "of")
    inside = (F.col("of") == F.col("doc_id")) & (F.col("start") < F.col("offset")) & (F.col("offset") < F.col("end"))
    return starts.join(ranges, inside, "left_semi")


@query
def path_asof(spark, d):
    docs = markdown_docs(spark, d)
    return inspect.path_at(_fixed_with_offsets(docs).select("doc_id", _long("offset").alias("offset")), inspect.headings(docs))


@query
def cut_quality(spark, d):
    docs = markdown_docs(spark, d)
    return inspect.cut_quality(_fixed_with_offsets(docs), docs)


CUT_MEASURES = ["n_blocks", "torn", "headerless", "over_size", "clean", "cut_line", "cut_fence", "cut_table", "cut_prose"]


@query
def cut_compare(spark, d):
    """The chunkers' totals side by side, and how many blocks cross sections or lie elsewhere than they say."""
    docs = saved(markdown_docs(spark, d), "markdown")
    rows = []
    for name in ("flat", "md"):
        parts = saved(chunk.pieces(docs, name), "pieces")
        sums = inspect.cut_quality(parts, docs).agg(*(F.sum(c).alias(c) for c in CUT_MEASURES))
        there = inspect.path_at(parts.select("doc_id", _long("offset").alias("offset")), inspect.headings(docs)).withColumnRenamed("path", "there").distinct()
        own = parts.withColumn("here", T.heading_path(F.col("path"))).filter("here != ''").withColumn("offset", _long("offset")).join(there, ["doc_id", "offset"])
        more = own.agg(F.count_if("cross_section").alias("cross_section"), F.count_if(F.col("here") != F.col("there")).alias("bad_offset"))
        rows.append(sums.crossJoin(F.broadcast(more)).withColumn("chunker", F.lit(name)))
    return rows[0].unionByName(rows[1])


@query
def cut_deltas(spark, d):
    """What the Markdown chunker changes against the plain one, measure by measure."""
    return _rounded(inspect.cut_deltas(cut_compare(spark, d), [*CUT_MEASURES, "cross_section", "bad_offset"], "flat", "md"), "percent")


@query
def section_extract(spark, d):
    return sources.marked_sections(markdown_docs(spark, d), "## ", "### Notes", 90, "(none)")
