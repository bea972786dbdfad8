"""Tokenizer alignment, Jaccard join and hard negatives against brute force over odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratadoc import session
from stratadoc.llm import alignment, hard_negatives, jaccard_join, signature_tree
from stratadoc.llm.simhash import shingle_hashes
from tests.llm.test_operators import order, result

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -------------------------------------------------------------------------------- 11


def alignment_by_hand(rows):
    """Whole texts through both libraries, tokens walked byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    entries = {i: e for e, i in a.get_vocab().items()}
    # GPT-2 style byte characters, as the library's own decoder has them.
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    byte_of, n = {}, 0
    for x in range(256):
        byte_of[chr(x) if x in printable else chr(256 + n)] = x
        n += x not in printable
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    solved, counts = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [bytes(byte_of[c] for c in entries[t]) for t in ids_a], [piece(t) for t in ids_b]
        raw = f" {text}".encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            solved.append((i, [], [], [], []))
            continue
        own_a, own_b = ([k for k, x in enumerate(xs) for _ in x] for xs in (bytes_a, bytes_b))
        links = list(dict.fromkeys(zip(own_a, own_b)))
        ends_a, ends_b = set(np.cumsum([len(x) for x in bytes_a]).tolist()), set(np.cumsum([len(x) for x in bytes_b]).tolist())
        groups, begin = [], 0
        for end in sorted(ends_a & ends_b):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(own[begin:end])) for ids, own in ((ids_a, own_a), (ids_b, own_b))))
            begin = end
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        counts.update(pairs)
        solved.append((i, ids_a, ids_b, groups, pairs))
    best = defaultdict(int)
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    return sorted(
        (
            (i, len(x), len(y), len(g), len(p), sum(counts[q] == best[q[1]] for q in p), sum(counts[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
            for i, x, y, g, p in solved
        ),
        key=order,
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    " ", "  two  spaces ", "a\n b\tc\r\n\r\nd", "x▁y", "<s> </s> <|endoftext|> <0x41> ▁", "don't we'll I'M", "naïve café ﬁ ① 中文分词 emoji 🙂🙂  nbsp em",
    "á combining", "\x00nul \x1f us", "tail ", "1234567890 12 3", "word " * 50, "ünïcödé" * 40, "　wide", "a ​ b", ".. ... ....  --  ---",
]


@pytest.mark.parametrize("lot", [1 << 23, 300])
def test_alignment(docs, rows, spark, monkeypatch, lot):
    monkeypatch.setattr(alignment, "LOT_CHARS", lot)
    monkeypatch.setattr(alignment, "REMEMBERED", alignment.REMEMBERED if lot > 300 else 20)
    kept = [r[:2] for r in rows if r[0] != 102 or lot > 300] + list(enumerate(ODD_TEXTS, 200)) + [(None, ODD_TEXTS[6]), (200, ODD_TEXTS[6])]
    df = spark.createDataFrame(kept, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("lot", "kind", "pairs", "n", "best", "pair")})
    assert result(alignment.aligned_counts(df, A_PATH, B_PATH), *ALIGNED) == alignment_by_hand(kept)


def test_cuts_leave_tokens_as_they_are(spark):
    """Texts of random characters, spaces of all kinds among them: whole encoding equals that by stretches."""
    r = random.Random(3)
    signs = [*"ab'.,1é中 \n\t", " ", " ", " ", " ", " ", "\x85", "\x1c", "'s", "the", "🙂", "ı"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(400)]
    rows = list(enumerate(texts))
    assert result(alignment.aligned_counts(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH), *ALIGNED) == alignment_by_hand(rows)


def test_alignment_of_nothing(empty):
    assert alignment.aligned_counts(empty, A_PATH, B_PATH).count() == 0


# -------------------------------------------------------------------------------- 12


def jaccard_by_hand(rows, percent, width=4):
    sets = [frozenset(shingle_hashes((t or "").encode(), width).tolist()) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return sorted(((rows[k][0], len(s), min(ids[find(k)], default=None) if s else rows[k][0]) for k, s in enumerate(sets)), key=order)


def edited(r, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        words[at : at + r.randint(0, 1)] = [r.choice(vocabulary)]
    return " ".join(words)


def families(r, sizes, length=160):
    """Copies with a few edits each, so that similarities lie on both sides of the limit; all share a common passage."""
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in sizes:
        base = [r.choice(vocabulary) for _ in range(r.randint(length // 2, length))] + passage
        texts += [edited(r, base, r.randint(0, 6), vocabulary) for _ in range(n)]
        texts += [" ".join(passage[: r.randint(1, 60)])]
    return texts


@pytest.mark.parametrize("percent", [85, 50, 100])
def test_jaccard_join(docs, rows, percent):
    found = jaccard_join.jaccard_components(docs, percent=percent)
    assert result(found, "doc_id", "n_shingles", "component_id") == jaccard_by_hand([r[:2] for r in rows], percent)


def test_jaccard_join_of_families(spark):
    texts = families(random.Random(9), [2, 2, 3, 5, 9, 30, 60])
    rows = [*enumerate(texts), (None, texts[4]), (3, texts[40]), (900, "one"), (901, "ONE"), (902, "one two three"), (903, "one two three four"), (904, None), (905, " ")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    expected = jaccard_by_hand(rows, 85)
    assert result(found, "doc_id", "n_shingles", "component_id") == expected
    assert 10 < len({c for *_, c in expected}) < len(rows) - 50


@pytest.mark.parametrize("part", [1 << 20, 2000, 500])
def test_clusters_of_any_size_lose_no_link(spark, part):
    """One cluster of all sets, in one part or in many."""
    texts = families(random.Random(1), [40, 20, 10, 3, 3])
    rows = list(enumerate(texts))
    sets = [np.unique(shingle_hashes(t.encode(), 4)) for t in texts]
    members = spark.createDataFrame([(7, k, len(s)) for k, s in enumerate(sets)], "cluster long, sid long, size long")
    hashes = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in enumerate(sets)], "sid long, hashes array<long>")
    edges = [(r["a"], r["b"]) for r in signature_tree.cluster_edges(members, hashes, 85, part).collect()]
    root = list(range(len(rows)))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if c in (x, y) else c for c in root]
    assert sorted((i, len(sets[i]), root[i]) for i, _ in rows) == jaccard_by_hand(rows, 85)


def test_tree_prunes_what_cannot_be_similar():
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [" ".join(f"d{k}x{i}" for i in range(100)) + " " + passage for k in range(300)] + [" ".join(f"s{r.random()}" for _ in range(n)) for n in range(10, 400, 5)]
    sets = [np.unique(shingle_hashes(t.encode(), 4)) for t in texts]
    made = signature_tree.Sets(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    solver = signature_tree.Solver(made, 85, np.arange(len(sets)), np.ones(len(sets), bool))
    assert solver.solve() == []
    assert solver.compared < 0.1 * len(sets) ** 2 / 2


def test_prefixes_meet():
    for size in range(1, 300):
        least = next(n for n in range(size + 1) if 100 * n >= 85 * size)
        assert jaccard_join.prefix_length(size, 85) == size - least + 1


@pytest.mark.parametrize("token_bytes", [1, 2])
def test_jaccard_join_with_tokens_that_shingles_share(spark, token_bytes):
    """256 tokens for thousands of shingles: more sets meet, the links are the same."""
    texts = families(random.Random(3), [1, 1, 2, 3, 9, 30])
    rows = [*enumerate(texts), (900, texts[5]), (901, "one"), (902, "ONE"), (903, None)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), token_bytes=token_bytes)
    assert result(found, "doc_id", "n_shingles", "component_id") == jaccard_by_hand(rows, 85)


def test_tokens_are_packed_in_order():
    hashes = np.array([0, 1 << 24, (1 << 40) + 5, 1 << 63, (1 << 64) - 1], np.uint64)
    assert jaccard_join.unpacked(jaccard_join.packed(hashes, 5), 5).tolist() == [h >> 24 for h in hashes.tolist()]
    assert jaccard_join.unpacked(jaccard_join.packed(hashes, 1), 1).tolist() == [0, 0, 0, 128, 255]
    assert len(jaccard_join.packed(hashes, 5)) == 25


def test_jaccard_join_writes_few_bytes(spark, tmp_path):
    """The lists of shingles are written once, in five bytes each: 600 texts have about 57,000 in their lists."""
    r = random.Random(6)
    rows = [(k, " ".join(f"w{r.random()}" for _ in range(480))) for k in range(600)]
    before, spark_dir = set(session._SCRATCH.get(spark.sparkContext.applicationId, [])), lambda p: p.removeprefix("file:").replace("//", "/")
    assert jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == len(rows)
    made = [Path(spark_dir(p)) for p in session._SCRATCH[spark.sparkContext.applicationId] if p not in before]
    listed = sum(len(np.unique(h)) for h in (x[x < np.uint64(int(0.2 * 2**64))] for x in (shingle_hashes(t.encode(), 4) for _, t in rows)))
    written = sum(f.stat().st_size for p in made for f in p.rglob("*.parquet"))
    assert 50_000 < listed < 65_000 and 5 * listed < written < 9 * listed


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.jaccard_components(empty.unionByName(empty.sparkSession.createDataFrame([(1, None, None, None, None)], empty.schema))).count() == 1


# -------------------------------------------------------------------------------- 13


def negatives_by_hand(rows, every=100):
    kept = [(k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
            for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, v in kept:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, same == label) for m, j, same, w in kept if m != k]
        scored.sort(key=lambda x: (-x[0], *x[1:4]))
        for score, none, j, _, _ in [x for x in scored if x[4]][:5]:
            fits = [x for x in scored if not x[4] and 80 * score <= 100 * x[0] <= 100 * score][:5]
            out += [(i, None if none else j, n, None if x[1] else x[2], score, x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out, key=order)


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=2, n=420, width=8, clusters=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, width))
    rows = [(int(i), (centres[i % clusters] + r.normal(scale=0.4, size=width)).astype(np.float32).tolist(), int(r.integers(10))) for i in range(n)]
    same = rows[11][1]
    rows += [(k, same, k % 10) for k in range(500, 560)]  # ties
    rows += [rows[100], rows[200], rows[5], (None, rows[7][1], 3), (None, rows[100][1], rows[100][2]), (700, [], 4), (701, [1.0, 2.0], 4), (702, [0.0] * width, 4), (800, [0.0] * width, 5)]
    rows += [(900, None, 1), (1000, rows[3][1], None), (1100, [1.0, None], 2), (1200, [float("nan")] * width, 2), (1300, [float("inf")] * width, 2), (1400, [-float("inf")], 2)]
    return rows


@pytest.mark.parametrize(("references", "block"), [(16, 4096), (1, 2), (3, 3)])
def test_hard_negatives(spark, references, block):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({c: F.lit("clash") for c in ("rid", "v", "norm", "cell", "score", "rank", "w")})
    assert result(hard_negatives.hard_negatives(df, references=references, anchor_block=block), *MINED) == negatives_by_hand(rows)


def test_more_anchors_of_negative_scores(spark):
    rows = [(int(i), (-np.abs(np.random.default_rng(i).normal(size=4)) * (1 if i % 2 else -1)).astype(np.float32).tolist(), i % 3) for i in range(60)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), every=5)
    assert result(found, *MINED) == negatives_by_hand(rows, every=5)


def test_bounds_hold_and_leave_rows_out():
    """Every score lies in its interval, and clustered rows are left out before they are scored."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 32)) * 40
    v = np.floor(np.repeat(centres, 100, axis=0) + r.normal(size=(1200, 32)) * 6)
    refs = hard_negatives.fit_references(v[::7])
    norm, theta = hard_negatives.angles_to(refs, v)
    low, high = hard_negatives.score_bounds(norm[:40], theta[:40], norm, norm, theta, theta)
    scores = v[:40] @ v.T
    assert (low <= scores).all() and (scores <= high).all()
    cell = theta.argmin(axis=1)
    at = np.lexsort((theta[np.arange(len(v)), cell], cell))
    block = hard_negatives.Anchors(np.arange(0, 1200, 100), np.zeros(12, np.int64), v[::100], norm[::100], theta[::100], True, 5)
    block.take(at, at, np.zeros(1200, bool), np.zeros(1200, np.int64), v[at], norm[at], theta[at])
    block.scored = block.seen = 0
    block.take(at, at, np.zeros(1200, bool), np.zeros(1200, np.int64), v[at], norm[at], theta[at])
    assert block.scored < 0.5 * block.seen


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(None, None, None)], VECTORS)).count() == 0
