"""Each operator against a brute-force version, over nulls, empties, long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stratadoc.llm import chains, components, decontaminate, hmm_lm, licenses, line_dedup, media, mixing, near_texts, simhash, substring_dedup, token_counts, toxicity
from stratadoc.llm.automaton import SuffixAutomaton

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(x):
    return tuple((v is not None, v) for v in x)


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=order)


# -------------------------------------------------------------------------------- 1


def lines_by_hand(rows, min_sites):
    key = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.translate(LOWER)).strip(" ")
    sites, first = defaultdict(set), {}
    for i, t, _, source, _ in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            if key(line):
                sites[key(line)].add(source)
                place = (i is not None, i or 0, n)
                first[key(line)] = min(first.get(key(line), place), place)
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = [line for n, line in enumerate(t.split("\n")) if not key(line) or len(sites[key(line)]) < min_sites or first[key(line)] == (i is not None, i or 0, n)]
        out.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return sorted(out, key=order)


@pytest.mark.parametrize("min_sites", [2, 3, 5])
def test_line_dedup(docs, rows, min_sites):
    found = line_dedup.line_dedup(docs, min_sites, carry=("lang", "_gone", "_key")).drop("_gone", "_key")
    assert result(found, "doc_id", "text", "n_lines", "n_removed") == lines_by_hand(rows, min_sites)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.line_dedup(empty).count() == 0


# -------------------------------------------------------------------------------- 2


def test_media_round_trip(docs, rows):
    found = result(media.media_columns(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "width", "height", "bit_depth")
    expected = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        n = max(1, math.ceil(len(raw) / 576))
        payload = raw + b"\xff" * (n * 576 - len(raw))
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), 576, n, 8))
    assert found == sorted(expected, key=order)


def test_media_equal_texts_have_one_place(docs):
    by_payload = media.media_columns(docs).groupBy("payload_sha256").agg(F.count_distinct("shard", "offset", "media_sha256", "media_bytes", "feature").alias("n"))
    assert by_payload.filter("n <> 1").count() == 0


def test_media_feature_and_stored_form_by_hand(docs, rows, spark, tmp_path):
    """feature is 64 bits of which part of the payload is lighter than the whole; what is stored is what the digests say."""
    found = media.media_columns(docs, f"file://{tmp_path}").collect()
    by_digest = {}
    for _, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        n = len(payload) // 64
        sums = [sum(payload[k * n : (k + 1) * n]) for k in range(64)]
        by_digest[hashlib.sha256(payload).hexdigest()] = payload, "".join("1" if s * 64 > sum(payload) else "0" for s in sums)
    assert len(found) == len(rows)
    for r in found:
        payload, bits = by_digest[r["payload_sha256"]]
        assert f"{int(r['feature'], 16):064b}" == bits
        stored = (tmp_path / r["shard"]).read_bytes()[r["offset"] : r["offset"] + r["media_bytes"]]
        assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and media.decode_png(stored) == payload


def test_media_shards_are_tar_files(docs, spark, tmp_path):
    import tarfile

    _, places = media.store_media(docs, f"file://{tmp_path}")
    index = places.collect()
    heads = {r["digest"]: r for r in media.header_columns(places, f"file://{tmp_path}").collect()}
    assert {r["digest"] for r in index} == set(heads) and {r["width"] for r in heads.values()} == {576}
    for r in index[:20]:
        with tarfile.open(tmp_path / r["shard"]) as tar:
            member = tar.getmember(f"{r['digest']}.png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
            assert hashlib.sha256(media.decode_png(tar.extractfile(member).read())).hexdigest() == r["digest"]


def test_media_of_nothing(empty):
    assert media.media_columns(empty).count() == 0


# -------------------------------------------------------------------------------- 3


def fingerprint_by_hand(text):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, limit=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_near_duplicates(docs, rows):
    fp = [fingerprint_by_hand(t) for _, t, *_ in rows]
    root = components_by_hand(set(fp))
    least = {}
    for (i, *_), f in zip(rows, fp):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    expected = [(i, f"{f:016x}", least.get(root[f])) for (i, *_), f in zip(rows, fp)]
    found = simhash.near_duplicate_rows(simhash.near_duplicates(docs))
    assert result(found, "doc_id", "fingerprint", "component_id") == sorted(expected, key=order)


@pytest.mark.parametrize("group", [2, 16, 4096])
def test_hot_groups_are_dealt_again_without_loss(spark, group):
    r = np.random.default_rng(3)
    near = [int(x) for x in (np.uint64(0x0123456789ABCDEF) ^ sum((np.uint64(1) << r.integers(0, 64, 120, dtype=np.uint64)) for _ in range(3)))]
    fps = {x & (2**64 - 1) for x in near} | {int(x) for x in r.integers(0, 2**64, 80, dtype=np.uint64)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.near_edges(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), group=group)
    found = {x["node"]: x["root"] for x in components.components(edges).collect()}
    expected = components_by_hand(fps)
    together = defaultdict(set)
    for f in fps:
        together[expected[f]].add(found.get(signed(f), signed(f)))
    assert all(len(x) == 1 for x in together.values()) and len({next(iter(x)) for x in together.values()}) == len(together)


def test_gray_search_equals_all_pairs():
    r = np.random.default_rng(1)
    fp = np.unique(r.integers(0, 2**64, 300, dtype=np.uint64) & np.uint64(0xFF00FF))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    found = {(int(a), int(b)) for i, j in simhash.search(fp, np.array([len(fp)])) for a, b in zip(i, j)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 3}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def shingle_sets(texts, width=5):
    words = [tuple((t or "").translate(LOWER).split()) for t in texts]
    return [frozenset(w[i : i + width] for i in range(max(1, len(w) - width + 1)) if w) for w in words]


def similar_by_hand(rows, similarity=0.8):
    sets = shingle_sets([t for _, t, *_ in rows])
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= similarity:
                root[up(i)] = up(j)
    ids = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        ids[up(i)].append(doc_id)
    return sorted(((d, min((x for x in ids[up(i)] if x is not None), default=None)) for i, (d, *_) in enumerate(rows)), key=order)


def test_near_texts(docs, rows):
    assert result(near_texts.near_texts(docs), "doc_id", "component_id") == similar_by_hand(rows)
    kept = near_texts.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in similar_by_hand(rows)})


def edited_copies(n=150):
    """Copies with some words changed: many in one cluster, some similar and some not; far beyond three bits of 64."""
    r = np.random.default_rng(3)
    base = [f"w{x}" for x in r.integers(0, 500, 150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in r.integers(0, 150, r.integers(0, 8)):
            words[at] = f"x{r.integers(0, 500)}"
        texts.append(" ".join(words[r.integers(0, 30) :]))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def test_near_texts_of_edited_copies(spark):
    rows = edited_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by_hand = similar_by_hand(rows)
    assert 1 < len({c for _, c in by_hand}) < len(rows)
    # The index may miss a link; every other way from one end to the other being missed too is a matter of chance.
    assert result(near_texts.near_texts(df, reach=1 - 1e-9), "doc_id", "component_id") == by_hand
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert result(kept, "doc_id") == sorted({(c,) for _, c in by_hand})


def test_over_full_groups_lose_no_link(spark, monkeypatch):
    """Groups that no task takes as a whole are candidate clusters, and what is similar in them is found all the same."""
    rows = edited_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(near_texts, "candidate_clusters", lambda sets, n, s, reach, found=near_texts.candidate_clusters: found(sets, n, s, reach, group=3))
    assert result(near_texts.near_texts(df), "doc_id", "component_id") == similar_by_hand(rows)


def test_rows_of_one_id_and_of_none(spark):
    """Equal rows of one id, other texts of the same id, and rows without an id: one row of each group is kept."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (None, b), (None, c), (None, c), (None, None), (None, ""), (7, "  "), (None, "lone words"), (8, "lone words"), (None, "lone")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert result(kept, "doc_id", "text") == sorted([(5, a), (5, b), (None, c), (7, "  "), (8, "lone words"), (None, "lone")], key=order)


def test_index_reach(spark):
    """Of the pairs at the limit, more or less, nine in ten meet, whatever the number of sets the keys are made for."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(300):
        own = r.integers(0, 1 << 62, 200)
        other = np.concatenate((own[: 200 - 22], r.integers(0, 1 << 62, 22)))  # similarity 0.80
        rows += [(2 * i, *near_texts.wide_fingerprint(own.astype(np.uint64))), (2 * i + 1, *near_texts.wide_fingerprint(other.astype(np.uint64)))]
    sets = spark.createDataFrame(rows, "sid long, w0 long, w1 long, w2 long, w3 long")
    for n_sets in (600, 1 << 24):
        found = {x["sid"]: x["cluster"] for x in near_texts.candidate_clusters(sets, n_sets).collect()}
        assert sum(2 * i in found and found[2 * i] == found.get(2 * i + 1) for i in range(300)) >= 270


def test_stars_equal_all_pairs():
    r = np.random.default_rng(4)
    fp = np.concatenate([r.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(3)])
    fp[5:30] = fp[5] ^ (np.uint64(1) << r.integers(0, 60, 25).astype(np.uint64))
    sizes = np.array([40, 1, 60, 19])
    fp = np.concatenate([g[np.argsort(simhash.gray_rank(g))] for g in np.split(fp, np.cumsum(sizes)[:-1])])
    name = np.arange(len(fp)) + 7
    root = {int(n): int(n) for n in name}
    for k, g in enumerate(np.split(np.arange(len(fp)), np.cumsum(sizes)[:-1])):
        for i in g:
            for j in g:
                if int(fp[i] ^ fp[j]).bit_count() <= 24:
                    low, high = sorted((root[int(name[i])], root[int(name[j])]))
                    root = {n: low if x == high else x for n, x in root.items()}
    a, b = simhash.spanning_stars(fp, sizes, 24, name)
    assert {n: x for n, x in root.items() if n != x} == dict(zip(a.tolist(), b.tolist()))


def test_near_texts_of_nothing(empty):
    assert near_texts.near_texts(empty).count() == near_texts.first_of_each(empty).count() == 0


# -------------------------------------------------------------------------------- 4


def hits_by_hand(rows, items, window=10):
    out = []
    for i, t, *_ in rows:
        words = ALNUM.findall((t or "").translate(LOWER))
        places, hit, names = defaultdict(list), set(), set()
        for at, w in enumerate(words):
            places[w].append(at)
        for item, text in items:
            own = ALNUM.findall((text or "").translate(LOWER))
            n = min(window, len(own))
            for k in range(len(own) - n + 1) if own else []:
                for at in places.get(own[k], []):
                    if words[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        names.add(str(item))
        out.append((i, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(out, key=order)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontamination(docs, rows, benchmark, block_words):
    found = decontaminate.hit_rows(decontaminate.benchmark_hits(docs, benchmark, block_words=block_words))
    assert result(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == hits_by_hand(rows, [tuple(r) for r in benchmark.collect()])


def test_decontaminate_takes_spans_out(docs, benchmark):
    left = decontaminate.decontaminate(docs, benchmark, max_coverage=0.8, carry=("lang",))
    assert decontaminate.benchmark_hits(left, benchmark).filter("n_hit > 0").count() == 0
    assert "site" not in str(left.columns) and left.columns == ["doc_id", "text", "lang"]
    # A benchmark of several automata gives the same.
    assert result(left, "doc_id", "text") == result(decontaminate.decontaminate(docs, benchmark, block_words=20, carry=("lang",)), "doc_id", "text")


def test_decontamination_without_items_or_documents(docs, empty, benchmark):
    assert decontaminate.benchmark_hits(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(empty, benchmark).count() == 0


def test_automaton_matching_statistics():
    automaton = SuffixAutomaton()
    sequences = ["abcbc", "abba", "cabab", "bc"]
    for s in sequences:
        automaton.add(s)
    text = "xabcabbabcbcx"
    runs = {s[i:j] for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    expected = {n: max((k for k in range(1, n + 1) if text[n - k : n] in runs), default=0) for n in range(1, len(text) + 1)}
    found = {n: matched for n, _, matched in automaton.stream(text)}
    assert found == {n: k for n, k in expected.items() if k}


# -------------------------------------------------------------------------------- 5


def substrings_by_hand(rows, window):
    split = [(i, t, SPACED.findall(t or "")) for i, t, *_ in rows]
    place = lambda i, t, s: (i is not None, i or 0, t or "", s)
    first = {}
    for i, t, words in split:
        for s in range(len(words) - window + 1):
            run = tuple(words[s : s + window])
            first[run] = min(first.get(run, place(i, t, s)), place(i, t, s))
    out = []
    for i, t, words in split:
        gone = {p for s in range(len(words) - window + 1) if first[tuple(words[s : s + window])] != place(i, t, s) for p in range(s, s + window)}
        out.append((i, len(words), len(gone), sha(" ".join(w for p, w in enumerate(words) if p not in gone))))
    return sorted(out, key=order)


@pytest.mark.parametrize(("window", "gram", "most"), [(20, 6, 1024), (20, 6, 1), (8, 3, 2)])
def test_substring_dedup(docs, rows, window, gram, most):
    found = substring_dedup.substring_rows(substring_dedup.substring_dedup(docs, window, gram, most))
    assert result(found, "doc_id", "n_words", "n_removed", "kept_sha256") == substrings_by_hand(rows, window)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


# -------------------------------------------------------------------------------- 6


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        more = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not more:
            return target
        capped |= more


def test_mixing(docs, rows):
    found = mixing.mixture(docs, block_words=16).collect()
    size = lambda t: len(SPACED.findall(t or ""))
    sizes = Counter()
    for _, t, _, source, _ in rows:
        sizes[source] += size(t)
    target, taken = targets_by_hand(sizes), Counter()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in found if r["doc_id"] is not None) == sorted((i is None, i, size(t)) for i, t, *_ in rows if i is not None)
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, n in target.items():
        assert taken[source] == math.floor(n + 1e-6)


def test_mixing_agrees_with_itself(docs):
    columns = ["doc_id", "size", "taken", "target"]
    assert result(mixing.mixture(docs), *columns) == result(mixing.mixture(docs.repartition(5)), *columns)


def test_mix_spreads_sources(docs):
    slots = mixing.mixed_spans(docs, block_words=16).select("slot", "source").distinct().orderBy("slot").collect()
    half = len(slots) // 2
    first, all_ = Counter(r["source"] for r in slots[:half]), Counter(r["source"] for r in slots)
    assert all(abs(first[s] - n / 2) <= 0.1 * n + 4 for s, n in all_.items())


def test_mixing_of_nothing(empty, spark):
    assert mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert result(mixing.mixture(blank), "doc_id", "size", "taken", "target") == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


# -------------------------------------------------------------------------------- 7


def test_language_model_base_score(docs, rows):
    found = {r["doc_id"]: r for r in hmm_lm.language_model_scores(docs, rounds=2).collect()}
    tokens = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, *_ in rows if i is not None and not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
        assert r["held_out"] == (i is not None and held(i))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_forward_and_backward_equal_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    start, trans, emit = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(4), 3)
    sequences = [[0, 1, 2, 3], [2], [1, 1, 0]]
    lengths, codes = np.array([len(s) for s in sequences]), np.array([c for s in sequences for c in s])
    pack = chains.Packed(lengths)
    packed = np.empty((len(codes), 3))
    packed[pack.place] = emit.T[codes]
    alpha, scale = pack.forward(start, trans, packed)
    beta, near = pack.backward(trans, packed, scale, alpha)
    likelihood = np.exp(np.bincount(pack.sequence, weights=np.log(scale)[pack.place]))
    pairs = np.zeros((3, 3))
    for s, total in zip(sequences, likelihood):
        weight = {}
        for path in product(range(3), repeat=len(s)):
            p = start[path[0]] * np.prod([emit[z, c] for z, c in zip(path, s)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
            weight[path] = p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p / total
        assert total == pytest.approx(sum(weight.values()))
    assert near == pytest.approx(pairs)
    assert (alpha * beta).sum(axis=1) == pytest.approx(np.ones(len(codes)))


def test_expected_counts_of_whole_texts(monkeypatch):
    """Baum-Welch counts of texts of mixed lengths, in several lots, by a plain recursion over each whole text."""
    import pyarrow as pa

    monkeypatch.setattr(hmm_lm, "BATCH_TOKENS", 40)
    monkeypatch.setattr(hmm_lm, "HELD_TOKENS", 150)
    r = np.random.default_rng(6)
    model = hmm_lm.first_model(r.integers(1, 9, 12).astype(float), states=3)
    texts = [r.integers(0, 12, n) for n in (1, 30, 2, 700, 5, 5, 41, 1, 90, 3)]
    found = hmm_lm._expected(model)(iter([pa.RecordBatch.from_arrays([pa.array([t.astype("<u2").tobytes() for t in texts])], ["codes"])]))
    starts, pairs, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 12))
    for t in texts:
        alpha, beta = [model.start * model.emit[:, t[0]]], [np.ones(3)]
        for x in t[1:]:
            alpha[-1] = alpha[-1] / alpha[-1].sum()
            alpha.append(alpha[-1] @ model.trans * model.emit[:, x])
        for x in t[:0:-1]:
            b = model.trans @ (model.emit[:, x] * beta[0])
            beta.insert(0, b / b.sum())
        for k, x in enumerate(t):
            both = alpha[k] * beta[k]
            emits[:, x] += both / both.sum()
            if k == 0:
                starts += both / both.sum()
            else:
                step = alpha[k - 1][:, None] * model.trans * (model.emit[:, x] * beta[k])[None, :]
                pairs += step / step.sum()
    assert np.allclose(found, np.concatenate((starts, pairs.ravel(), emits.ravel())), rtol=1e-3, atol=1e-3)


def test_class_likelihood_by_a_plain_forward_pass():
    """The recursion over classes, packed and in lots, against one text at a time."""
    r = np.random.default_rng(1)
    model = hmm_lm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(20), 3))

    class Shared:
        value = (model.start, model.trans, model.emit)

    import pyarrow as pa

    texts = [r.integers(0, 20, n) for n in (4, 900, 1, 33)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([t.astype("<u2").tobytes() for t in texts])], ["row_id", "codes"])
    (found,) = hmm_lm._likelihood(Shared)(iter([batch]))
    for t, score in zip(texts, found.column("classes").to_pylist()):
        alpha, total = model.start * model.emit[:, t[0]], 0.0
        for x in t[1:]:
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum() @ model.trans * model.emit[:, x]
        assert score == pytest.approx(total + math.log10(alpha.sum()), rel=1e-5)


def test_language_model_scores_of_texts_by_hand(docs, rows, monkeypatch):
    """score of every row from its text: classes, shares of classes and the recursion written out; the model is the one trained."""
    trained = []
    fit = hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda *a, **k: trained.append(fit(*a, **k)) or trained[0])
    monkeypatch.setattr(hmm_lm, "OWN_CLASSES", 50)  # so that shared classes carry most words
    found = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in hmm_lm.language_model_scores(docs).collect()), key=order)
    (model,) = trained
    split = lambda t: (t or "").translate(LOWER).encode().split()
    learned = [split(t) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for words in learned for w in words)
    own = {w: n for n, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50], 1)}
    shared = lambda w: zlib.crc32(w[-3:]) % 512
    in_class = defaultdict(list)
    for w in counts:
        if w not in own:
            in_class[shared(w)].append(w)
    expected = []
    for i, t, *_ in rows:
        codes, total = [], 0.0
        for w in split(t):
            if w in own:
                codes.append(own[w])
                continue
            members = in_class[shared(w)]
            codes.append(51 + shared(w))
            total += math.log10((counts[w] + 0.5) / (sum(counts[m] for m in members) + 0.5 * (len(members) + 1)))
        state = model.start
        for n, code in enumerate([*codes, 0]):
            state = (state @ model.trans if n else state) * model.emit[:, code]
            total += math.log10(state.sum())
            state = state / state.sum()
        expected.append((i, len(codes) + 1, total))
    by_hand = sorted(expected, key=order)
    assert [x[:2] for x in found] == [x[:2] for x in by_hand]
    for (_, _, a), (_, _, b) in zip(found, by_hand):
        assert a == pytest.approx(b, rel=1e-4)


def test_class_shares_make_a_probability(docs):
    """Over all known words and one unknown word of each class, a class's words have probability one."""
    rows = docs.select("doc_id", F.lit(True).alias("train"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    counts = hmm_lm.word_counts(rows)
    vocabulary = hmm_lm._vocabulary(counts, rows.count())
    own = sorted(((-r["c"], bytes(r["word"]), r["shared"]) for r in counts.collect()))[hmm_lm.OWN_CLASSES :]
    by_class = defaultdict(float)
    for c, _, shared in own:
        by_class[shared] += (-c + 0.5) / 10 ** vocabulary.shared_total[shared]
    for k in by_class:
        assert by_class[k] + 0.5 / 10 ** vocabulary.shared_total[k] == pytest.approx(1.0)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = hmm_lm.language_model_scores(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.95 * found[1]


def test_language_model_without_training_rows(empty, spark):
    assert hmm_lm.language_model_scores(empty).count() == 0
    row = hmm_lm.language_model_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


# -------------------------------------------------------------------------------- 8


def test_toxicity_gradient_equals_enumeration(spark):
    """The slope of the log-likelihood, by going through all labellings of a line."""
    import itertools

    import pyarrow as pa

    r = np.random.default_rng(2)
    lines = [(4, [0, 2], [1, 0], 1), (1, [], [], 0), (3, [0, 0, 1], [0, 2, 1], 0), (5, [4, 1], [2, 2], 1)]
    weights = r.normal(size=4 + 3)

    def likelihood(w):
        total = 0.0
        for n, at, feature, toxic in lines:
            scores, label = np.full(n, w[0]), np.zeros(n, int)
            for i, f in zip(at, feature):
                scores[i] += w[4 + f]
                label[i] = toxic
            trans = np.array([[0.0, w[1]], [w[2], w[3]]])
            value = lambda y: sum(scores[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
            total += value(label) - math.log(sum(math.exp(value(y)) for y in itertools.product((0, 1), repeat=n)))
        return total

    kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines), kinds)], ["n", "at", "feature", "toxic"])
    slope = toxicity._gradient(weights, 3)(iter([batch]))
    for k in range(len(weights)):
        step = np.eye(len(weights))[k] * 1e-5
        assert slope[k] == pytest.approx((likelihood(weights + step) - likelihood(weights - step)) / 2e-5, abs=1e-6)


def test_toxicity_is_the_same_in_any_partitioning(spark):
    """Equal texts with different labels among them."""
    from tests.llm.test_queries import DATA

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    again = docs.join(labels, "doc_id").select((F.col("doc_id") + 100_000).alias("doc_id"), "text")
    docs = docs.unionByName(again)
    labels = labels.select("doc_id", "toxic").unionByName(labels.select((F.col("doc_id") + 100_000).alias("doc_id"), (1 - F.col("toxic")).alias("toxic")))
    each = [result(toxicity.toxicity(docs.repartition(n, F.xxhash64("doc_id", F.lit(n))), labels, carry=("text",)), "doc_id", "text", "score", "predicted") for n in (1, 3, 7)]
    assert each[0] == each[1] == each[2] and len({x[2] for x in each[0]}) > 1


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.85 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.01 * counts[0, 0]


def test_toxicity_of_odd_rows(docs, rows, spark, empty):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(0, None), (None, 1), (999, 1), (4, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels, carry=("text", "lang"))
    assert found.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted", "spans"]
    assert result(found, "doc_id", "text") == sorted(((i, t) for i, t, *_ in rows), key=order)
    assert found.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).filter("score <> 0").count() == 0


def test_toxic_spans_are_words_of_the_text(spark):
    rows = [(i, ("you vilest thing " if i % 3 == 0 else "a kind word ") + "of common talk", int(i % 3 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))  # equal texts count once
    for r in toxicity.toxicity(docs, labels, carry=("text",)).collect():
        assert r["predicted"] == int(r["doc_id"] % 3 == 0)
        assert {r["text"][s["start"] : s["end"]] for s in r["spans"]} <= {"you", "vilest", "thing"}


# -------------------------------------------------------------------------------- 9


def test_wrapped_notices_and_licence_files(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    lgpl = licenses.TEMPLATES[[i for i, (name, t) in enumerate(licenses.TEMPLATES) if name == "LGPL-3.0" and t.startswith("This library is free")][-1]][1]
    wrapped = "\n".join(" ".join(lgpl.split()[k : k + 8]) for k in range(0, len(lgpl.split()), 8))
    body = "\n".join(f"some words of code {i} that say nothing at all" for i in range(60))
    files = [("a/x.c", f"{mpl}\n{body}"), ("b/y.c", f"{wrapped}\n\n{body}"), ("c/LICENSE", wrapped), ("c/d/z.c", body), (None, None), ("e/w.c", ""), ("e/w.c", ""), ("a/x.c", f"{mpl}\n{body}")]
    found = licenses.license_scan(spark.createDataFrame(files, "path string, text string"))
    assert result(found, "path", "license", "origin") == sorted(
        [("a/x.c", "MPL-2.0", "own"), ("b/y.c", "LGPL-3.0", "own"), ("c/LICENSE", "LGPL-3.0", "own"), ("c/d/z.c", "LGPL-3.0", "inherited"), (None, None, "none"), ("e/w.c", None, "none")], key=order
    )


def wrapped_at(text, width, before=""):
    import textwrap

    return "\n".join(before + line for line in textwrap.wrap(text, width))


def test_licences_by_their_names(spark):
    """Headers in code, whole files, and identifiers: each licence by its own name, relatives and versions told apart."""
    notice = {"AGPL-3.0": 0, "GPL-2.0": 0, "GPL-3.0": -1, "LGPL-2.1": -1, "LGPL-3.0": -1, "Apache-2.0": 2, "MPL-2.0": -1}
    stated = [t for t in licenses.TEMPLATES if t not in licenses.TITLES + licenses.WHOLE and not t[1].startswith("SPDX")]
    code = "\n".join(f"int value_{i} = compute(previous, {i}); // step {i} of the whole computation" for i in range(60))
    files, expected = [], {}

    def add(path, text, name):
        files.append((path, text))
        expected[path] = name

    for name, which in notice.items():
        text = [t for n, t in stated if n == name][which]
        add(f"headers/{name}.c", wrapped_at(text, 74, " * ") + "\n\n" + code, name)
    for name, text in licenses.WHOLE:
        add(f"bare/{name}/x.c", wrapped_at(f"Copyright (c) 2020 Some Person. {text}", 74, "# ") + "\n" + code, name)
        add(f"{name}/LICENSE", f"Copyright 2020, Some Body\n\n{wrapped_at(text, 70)}\n", name)
    for name, title in licenses.TITLES:
        add(f"titles-{name}/COPYING", f"{wrapped_at(title, 40, '      ')}\n\n Everyone may copy this document.\n\n{code}", name)
    for name in (*licenses.IDENTIFIED, *licenses.GNU):
        add(f"spdx/{name}/x.py", f"# SPDX-License-Identifier: {name}\n{code}", name)
    add("spdx/later.py", f"# SPDX-License-Identifier: GPL-2.0-or-later\n{code}", "GPL-2.0")
    add("spdx/other.py", f"# SPDX-License-Identifier: Zlib\n{code}", None)
    add("plain.py", code, None)
    found = {r["path"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: n for p, n in found.items() if n != expected[p]} == {}


def test_whole_licence_files_of_the_system(spark):
    from pathlib import Path

    known = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    files = [(f"{n}/COPYING", p.read_text(errors="replace")) for n in known if (p := Path("/usr/share/common-licenses") / n).exists()]
    if not files:
        pytest.skip("this system has no licence files")
    found = {r["path"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: n for p, n in found.items() if n != known[p.split("/")[0]]} == {}


def test_license_query_of_odd_rows(spark, docs, rows, tmp_path):
    """A row for each row of documents, without ids and repeated among them."""
    from stratadoc.llm import queries

    docs.select("doc_id", "text", "lang", "source", "n_chars", "key", "gone").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op9_license_scan(spark, str(tmp_path))
    assert result(found, "doc_id") == sorted([(r[0],) for r in rows], key=order)
    notice = {r[0] for r in rows if r[1] and "Apache License" in r[1]}
    assert {r["doc_id"] for r in found.filter("origin = 'own'").collect()} == notice


def test_license_inheritance(spark, empty):
    files = [
        ("a/LICENSE", "The licence of this folder.\nReleased under the MIT License."),
        ("a/b/x.txt", "nothing here"),
        ("a/b/NOTICE.md", "words and more words in a long line that isn't a notice at all, again and again\nLicensed under the Apache License, Version 2.0."),
        ("a/b/c/y.txt", None), ("a/z.txt", "This work is licensed under the GNU General Public License, version 3.\n" + "text " * 100),
        ("d/w.txt", ""), (None, "Released under the MIT License."), ("a/b/x.txt", "nothing here"),
    ]
    found = licenses.license_scan(spark.createDataFrame(files, "path string, text string"))
    assert result(found, "path", "license", "origin", "licensed_dir") == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/b/x.txt", "Apache-2.0", "inherited", "a/b"), ("a/b/NOTICE.md", "Apache-2.0", "own", None),
        ("a/b/c/y.txt", "Apache-2.0", "inherited", "a/b"), ("a/z.txt", "GPL-3.0", "own", None), ("d/w.txt", None, "none", None), (None, None, "none", None),
    ], key=order)
    assert licenses.license_scan(empty.select(F.col("source").alias("path"), "text")).count() == 0


# -------------------------------------------------------------------------------- 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(docs, rows, spark, tmp_path, name):
    import public_tokenizers

    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    found = result(token_counts.token_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit")
    # The library itself, text by text.
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.EncodeAsIds(t))
    expected = [(i, len((t or "").encode()), count(t or "")) for i, t, *_ in rows]
    assert found == sorted(((*x, x[2] > 1024) for x in expected), key=order)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in rows})
    assert result(token_counts.token_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == found
    assert spark.read.parquet(cache).count() == stored.count()


def test_special_strings_count_as_the_library_has_it(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert token_counts.token_counts(docs, path).first()["n_tokens"] == len(Tokenizer.from_file(path).encode("a <|endoftext|> b", add_special_tokens=False).ids)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_few_misses_and_many_give_equal_counts(docs, spark, tmp_path, monkeypatch, sent):
    """A second run asks for what the first hasn't seen, whichever way the misses are fetched; none are encoded twice."""
    import public_tokenizers

    monkeypatch.setattr(token_counts, "MISSES_SENT", sent)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    token_counts.token_counts(docs.filter("doc_id < 30"), path, cache).count()
    found = token_counts.token_counts(docs, path, cache)
    assert result(found, "doc_id", "n_bytes", "n_tokens") == result(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens")
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()


def test_token_counts_of_nothing(empty):
    import public_tokenizers

    assert token_counts.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
