"""SQL counterparts of the registered queries, for DuckDB over the same tables.

They state the same results in set terms and share no code with the operators. Queries without an entry depend on the
sequential chunker, which tests compare with literal cases.
"""

from __future__ import annotations

NL = "chr(10)"
PUNCT = r"[\s\p{Z}|*`（）()，。、：；「」【】\[\]{}<>~]+"


def _norm(x: str) -> str:
    return f"regexp_replace({x}, '{PUNCT}', '', 'g')"


def _grams(x: str) -> str:
    n = _norm(x)
    return f"(CASE WHEN length({n}) = 0 THEN [] WHEN length({n}) < 3 THEN [{n}] ELSE list_transform(range(1, length({n}) - 1), lambda p: substr({n}, p, 3)) END)"


def _terms(x: str) -> str:
    found = rf"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*(?::[A-Za-z0-9_]+)+|[\p{{L}}\p{{N}}_]+')"
    return rf"list_filter(list_transform({found}, lambda t: lower(t)), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"


def _ids(x: str) -> str:
    found = rf"list_transform(regexp_extract_all({x}, '`[^`]+`|[A-Za-z_][A-Za-z0-9_]+|\p{{Nd}}+'), lambda t: trim(regexp_replace(t, '^`|`$', '', 'g')))"
    kept = rf"list_filter({found}, lambda t: length(t) >= 2 AND NOT (regexp_matches(t, '^\p{{Nd}}+$') AND length(t) > 6))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


#: Events as replies with their token counts.
REPLIES = """(SELECT event_id, event_type AS arm, v AS input_tokens, CASE WHEN event_id % 7 <> 0 THEN k END AS output_tokens,
  CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN k + 1 END AS cache_hit, CASE WHEN event_id % 3 = 1 THEN v - k END AS cache_miss
  FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))"""

#: The prompt before its material.
CITED = f" || {NL} || ".join(
    f"'{line}'" for line in (
        "你是一个只根据给定资料回答问题的助手。", "", "规则：", "1. 只使用下面「资料」里的内容回答，不要用你自己的知识补充。", "2. 资料里没有的，直接回答「资料里没有提到」，不要猜。",
        "3. 回答完在最后一行写上「来源：第 X 块」，X 是你实际用到的那一块的编号。", "", "资料：", "",
    )
)

#: Common tables by name, each with those it needs.
PARTS: dict[str, tuple[list[str], str]] = {
    "blocks": ([], f"""
  SELECT row_number() OVER (ORDER BY doc_id, j) - 1 AS i, doc_id, source, j AS ord, substr(text, 500 * j + 1, 500) AS content
  FROM (SELECT doc_id, source, text, unnest(range(0, (length(text) + 499) // 500)) AS j FROM documents WHERE text <> '')"""),
    "tok": (["blocks"], f"SELECT i, {_terms('content')} AS ts FROM blocks"),
    "lengths": (["tok"], "SELECT i, len(ts) AS dl FROM tok"),
    "postings": (["tok"], "SELECT term, i, count(*) AS tf FROM (SELECT i, unnest(ts) AS term FROM tok) GROUP BY term, i"),
    "raw_idf": (["postings", "lengths"], """
  SELECT term, count(*) AS df, ln((SELECT count(*) FROM lengths) - count(*) + CAST(0.5 AS DOUBLE)) - ln(count(*) + CAST(0.5 AS DOUBLE)) AS r FROM postings GROUP BY term"""),
    "idf": (["raw_idf"], "SELECT term, df, CASE WHEN r < 0 THEN (SELECT avg(r) FROM raw_idf) * CAST(0.25 AS DOUBLE) ELSE r END AS idf FROM raw_idf"),
    "asked": ([], f"SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL"),
    "bm25_scores": (["asked", "idf", "postings", "lengths"], """
  SELECT query_id, p.i, sum(times * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / (SELECT avg(dl) FROM lengths)))) AS score
  FROM asked JOIN idf USING (term) JOIN postings p USING (term) JOIN lengths l ON l.i = p.i GROUP BY query_id, p.i"""),
    "bm25": (["bm25_scores"], "SELECT query_id, i, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, i) AS rank FROM bm25_scores QUALIFY score > 0"),
    "vectors": ([], """
  SELECT vec_id AS i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""),
    "dense": (["vectors"], """
  SELECT item_id AS query_id, b.i, list_dot_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.i) AS rank
  FROM benchmark JOIN vectors a ON a.i = item_id, vectors b"""),
    "arms": (["dense", "bm25"], "SELECT query_id, 'dense' AS arm, rank, i FROM dense UNION ALL SELECT query_id, 'bm25', rank, i FROM bm25"),
    "cases": ([], """
  SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN 'any' ELSE 'all' END AS mode, CASE WHEN item_id % 4 < 2 THEN 'design' ELSE 'bug' END AS bank,
         CASE WHEN item_id % 2 = 0 THEN 'focused' ELSE 'scattered' END AS type, text AS q FROM benchmark"""),
    "anchors": (["cases"], """
  SELECT case_id, mode, n // 4 AS group_no, n % 4 AS anchor_no, substr(q, n * 30 + 1, 30) AS anchor FROM (SELECT case_id, mode, q, unnest(range(0, (length(q) + 29) // 30)) AS n FROM cases WHERE q <> '')"""),
    "holding": (["anchors", "blocks"], "SELECT anchor, i FROM (SELECT DISTINCT anchor FROM anchors) JOIN blocks ON contains(content, anchor)"),
    "sweep": ([], "SELECT k FROM (VALUES (CAST(1 AS BIGINT)), (2), (4), (8), (16)) t(k)"),
    "fused": (["arms", "sweep"], """
  SELECT k, query_id, i, row_number() OVER (PARTITION BY k, query_id ORDER BY round(sum(1 / CAST(5 + rank AS DOUBLE)), 9) DESC, i) AS rank
  FROM arms, sweep WHERE rank <= greatest(4 * k, 20) GROUP BY k, query_id, i"""),
    "hits": (["arms", "sweep", "fused"], """
  SELECT k, arm, query_id AS case_id, rank, i FROM arms, sweep WHERE rank <= k UNION ALL SELECT k, 'hybrid', query_id, rank, i FROM fused WHERE rank <= k"""),
    "found": (["hits", "holding"], "SELECT DISTINCT k, arm, case_id, anchor FROM hits JOIN holding USING (i)"),
    "group_hits": (["anchors", "found", "sweep"], """
  SELECT k, arm, case_id, mode, group_no, count(f.anchor) AS n_hit, count(*) AS n_all
  FROM anchors a CROSS JOIN sweep CROSS JOIN (VALUES ('dense'), ('bm25'), ('hybrid')) r(arm) LEFT JOIN found f USING (k, arm, case_id, anchor) GROUP BY k, arm, case_id, mode, group_no"""),
    "results": (["group_hits"], """
  SELECT k, arm, case_id, CAST(sum(n_hit) AS BIGINT) AS n_hit, CASE WHEN mode = 'any' THEN bool_or(n_hit = n_all) ELSE bool_and(n_hit = n_all) END AS ok
  FROM group_hits GROUP BY k, arm, case_id, mode"""),
    "group_sizes": (["anchors"], "SELECT case_id, group_no, mode, count(*) AS n FROM anchors GROUP BY ALL"),
    "own_anchors": (["anchors"], "SELECT case_id, group_no, mode, anchor, dense_rank() OVER (PARTITION BY case_id, group_no ORDER BY anchor) - 1 AS bit FROM anchors"),
    "masks": (["own_anchors", "holding"], "SELECT case_id, group_no, i, bit_or(1 << bit) AS m FROM own_anchors JOIN holding USING (anchor) GROUP BY ALL"),
    "goals": (["own_anchors", "masks"], """
  SELECT case_id, group_no, mode, goal, coalesce(goal = can, false) AS complete FROM (SELECT case_id, group_no, any_value(mode) AS mode, bit_or(1 << bit) AS goal FROM own_anchors GROUP BY case_id, group_no)
  LEFT JOIN (SELECT case_id, group_no, bit_or(m) AS can FROM masks GROUP BY ALL) USING (case_id, group_no)"""),
    "least_of": (["masks"], "SELECT case_id, group_no, m, min(i) AS i FROM masks GROUP BY ALL"),
    "chosen": (["least_of"], """
  SELECT case_id, group_no, m, [i] AS cover FROM least_of
  UNION SELECT c.case_id, c.group_no, c.m | l.m, list_sort(list_append(cover, l.i)) FROM chosen c JOIN least_of l ON l.case_id = c.case_id AND l.group_no = c.group_no WHERE (l.m & ~c.m) <> 0"""),
    "covers": (["goals", "chosen", "masks"], """
  SELECT case_id, group_no, mode, complete, coalesce(
           CASE WHEN complete THEN (SELECT min({'n': len(cover), 'c': cover}).c FROM chosen c WHERE c.case_id = g.case_id AND c.group_no = g.group_no AND c.m = goal)
                ELSE (SELECT list_sort(list(i)) FROM masks h WHERE h.case_id = g.case_id AND h.group_no = g.group_no) END, CAST([] AS BIGINT[])) AS cover
  FROM goals g"""),
    "needs": (["covers"], """
  SELECT case_id, CAST(CASE WHEN any_value(mode) = 'any' THEN min(len(cover)) FILTER (complete) WHEN bool_and(complete) THEN sum(len(cover)) END AS BIGINT) AS need FROM covers GROUP BY case_id"""),
    "answers": (["cases"], """
  SELECT conv_id * 100 + turn AS answer_id, conv_id % (SELECT count(*) FROM benchmark) AS case_id, ['dense', 'bm25', 'hybrid', 'long'][(turn // 2) % 4 + 1] AS arm, text AS answer, bank, type, mode
  FROM conversations JOIN cases ON case_id = conv_id % (SELECT count(*) FROM benchmark) WHERE role = 'assistant'"""),
    "scored": (["answers", "anchors"], f"""
  SELECT answer_id, w.case_id, w.mode, group_no, answer, anchor, {_norm('answer')} AS na, {_norm('anchor')} AS nn, {_ids('anchor')} AS ids, {_grams('anchor')} AS gs
  FROM answers w JOIN anchors a ON a.case_id = w.case_id"""),
    "marked": (["scored"], """
  SELECT answer_id, case_id, mode, group_no, contains(answer, anchor) AS st, contains(na, nn) AS sn,
         CASE WHEN contains(na, nn) THEN true
           WHEN length(nn) >= 8 AND (contains(na, substr(nn, 1, length(nn) // 2)) OR contains(na, substr(nn, length(nn) // 2 + 1))) THEN
             len(list_filter(range(1, length(nn) + 1), lambda p: contains(na, substr(nn, 1, p - 1) || substr(nn, p + 1)))) > 0
             OR len(list_filter(range(1, length(na) - length(nn) + 2), lambda s: len(list_filter(range(0, length(nn)), lambda p: substr(na, s + p, 1) <> substr(nn, p + 1, 1))) <= 1)) > 0
           ELSE false END AS sf,
         len(ids) AS i_all, len(list_filter(ids, lambda t: contains(answer, t) OR contains(na, t))) AS i_hit,
         len(gs) AS g_all, len(list_filter(gs, lambda g: contains(na, g))) AS g_hit
  FROM scored"""),
    "groups": (["marked"], """
  SELECT answer_id, case_id, mode, group_no, avg(CAST(st AS INT)) AS strict, avg(CAST(sn AS INT)) AS strict_norm, avg(CAST(sf AS INT)) AS strict_fuzzy,
         CASE WHEN sum(i_all) > 0 THEN sum(i_hit) / sum(i_all) END AS ident, CASE WHEN sum(g_all) > 0 THEN sum(g_hit) / sum(g_all) ELSE CAST(0 AS DOUBLE) END AS gram
  FROM marked GROUP BY answer_id, case_id, mode, group_no"""),
    "judged": (["groups", "answers"], "SELECT * FROM answers JOIN (SELECT answer_id, " + ", ".join(
        f"CASE WHEN count({m}) = count(*) THEN CASE WHEN mode = 'any' THEN max({m}) ELSE min({m}) END END AS {m}" for m in ("strict", "strict_norm", "strict_fuzzy", "ident", "gram")
    ) + " FROM groups GROUP BY answer_id, mode) USING (answer_id)"),
    "doc_grams": ([], f"""
  SELECT doc_id, CASE WHEN len(c) < 3 THEN array_to_string(c, '') ELSE c[p] || c[p + 1] || c[p + 2] END AS gram, len(c) AS n
  FROM (SELECT doc_id, c, unnest(range(1, greatest(len(c) - 2, 1) + 1)) AS p FROM (SELECT doc_id, string_split({_norm('text')}, '') AS c FROM documents WHERE {_norm('text')} <> ''))"""),
    "corpus_grams": ([], f"""
  SELECT DISTINCT gram FROM (SELECT c || lead(c, 1) OVER w || lead(c, 2) OVER w AS gram FROM (
    SELECT doc_id, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split({_norm('text')}, '') AS l FROM documents WHERE {_norm('text')} <> ''))
    WINDOW w AS (ORDER BY doc_id, p)) WHERE gram IS NOT NULL"""),
    "spans": (["covers"], """
  SELECT case_id, any_value(mode) AS mode, bool_and(complete) AS whole, min({'n': len(cover), 'g': group_no, 'c': cover}) FILTER (complete) AS shortest, list_distinct(flatten(list(cover))) AS every FROM covers GROUP BY case_id"""),
    "by_case": (["diffs"], "SELECT case_id, arm, avg(delta) AS delta FROM diffs GROUP BY case_id, arm"),
    "arm_prompts": (["hits", "blocks", "cases"], f"""
  SELECT case_id AS query_id, arm, context, q FROM (
    SELECT case_id, arm, string_agg('【第 ' || i || ' 块】' || {NL} || content, {NL} || {NL} ORDER BY rank) AS context FROM hits JOIN blocks USING (i) WHERE k = 4 GROUP BY case_id, arm
    UNION ALL SELECT case_id, 'long', (SELECT coalesce(string_agg(t, {NL} || {NL} ORDER BY doc_id), '') FROM (
      SELECT doc_id, t, sum(length(t) + 2) OVER (ORDER BY doc_id) - 2 AS upto FROM (SELECT doc_id, '# 文件：' || source || {NL} || {NL} || text AS t FROM documents)) WHERE upto <= 20000) FROM cases
  ) JOIN cases USING (case_id)"""),
    "arm_answers": (["arm_prompts"], f"""
  SELECT query_id, arm, prompt, substr(prompt, strpos(prompt, '资料：' || {NL}) + 4, 100) AS answer
  FROM (SELECT query_id, arm, 'system: 根据资料回答问题，资料里没有的内容请说「资料里没有提到」。' || {NL} || {NL} || '资料：' || {NL} || context || {NL} || 'user: ' || q AS prompt FROM arm_prompts)"""),
    "copied": (["answers", "corpus_grams"], f"""
  SELECT answer_id, coalesce(avg(CAST(gram IN (SELECT gram FROM corpus_grams) AS INT)), CAST(0 AS DOUBLE)) AS copy
  FROM answers LEFT JOIN (SELECT answer_id, unnest({_grams('answer')}) AS gram FROM answers) g USING (answer_id) GROUP BY answer_id"""),
    "others": (["cases"], """
  SELECT a.case_id, b.case_id AS other_id FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS p, count(*) OVER () AS n FROM cases) a
  JOIN (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS p FROM cases) b ON b.p = (a.p + a.n // 2) % a.n"""),
    "floors": (["answers", "anchors", "others"], f"""
  SELECT answer_id, avg(gram) AS gram_null FROM (
    SELECT answer_id, group_no, CASE WHEN sum(len(gs)) > 0 THEN sum(len(list_filter(gs, lambda g: contains(na, g)))) / sum(len(gs)) ELSE CAST(0 AS DOUBLE) END AS gram
    FROM (SELECT answer_id, group_no, {_norm('answer')} AS na, {_grams('anchor')} AS gs FROM answers w JOIN others o ON o.case_id = w.case_id JOIN anchors a ON a.case_id = o.other_id)
    GROUP BY answer_id, group_no) GROUP BY answer_id"""),
    "diffs": (["judged", "floors"], "SELECT *, gram - gram_null AS delta FROM judged JOIN floors USING (answer_id) WHERE gram - gram_null IS NOT NULL"),
    "lexical_hits": (["bm25", "blocks"], "SELECT query_id, rank, b.i, source, content FROM bm25 h JOIN blocks b ON b.i = h.i WHERE rank <= 4"),
    "contexts": (["lexical_hits"], f"SELECT query_id, string_agg('【第 ' || i || ' 块】' || {NL} || content, {NL} || {NL} ORDER BY rank) AS context FROM lexical_hits GROUP BY query_id"),
    "md": ([], f"""
  SELECT CAST(n_nationkey AS BIGINT) * 1000000 + part AS doc_id, n_name AS source,
         '# ' || r_name || {NL} || {NL} || 'Customers of ' || n_name || '.' || {NL} || {NL} || '## ' || n_name || ' ' || part || {NL} || {NL} || '| key | name | segment |' || {NL} || '|---|---|---|' || {NL}
         || string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', {NL} ORDER BY c_custkey) || {NL} || {NL} || '### Notes' || {NL} || {NL} || '```text' || {NL} || '# ' || n_name || {NL}
         || string_agg(c_name, {NL} ORDER BY c_custkey) || {NL} || '```' || {NL} || 'After the fence: ' || count(*) || ' customers.' || {NL} AS text
  FROM (SELECT *, c_custkey // 500 AS part FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY n_nationkey, n_name, r_name, part"""),
    "ln": (["md"], f"""
  SELECT doc_id, n, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         starts_with(line, '```') AS mark, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS marks, starts_with(line, '|') AS bar
  FROM (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM md))"""),
    "hd": (["ln"], r"""
  SELECT doc_id, n, start AS "offset", CAST(length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS BIGINT) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS title
  FROM ln WHERE NOT (mark OR marks % 2 = 1) AND regexp_matches(line, '^(#{1,6})\s+(.+)$')"""),
    "paths": (["hd"], """
  SELECT h.doc_id, h."offset", string_agg(x.title, ' > ' ORDER BY x.level) AS path FROM hd h JOIN hd x ON x.doc_id = h.doc_id AND x."offset" <= h."offset"
  WHERE NOT EXISTS (SELECT 1 FROM hd y WHERE y.doc_id = h.doc_id AND y."offset" > x."offset" AND y."offset" <= h."offset" AND y.level <= x.level) GROUP BY h.doc_id, h."offset" """),
    "secs": (["ln", "hd", "paths"], f"""
  SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY s) - 1 AS section, coalesce(path, '') AS heading, body FROM (
    SELECT l.doc_id, s, trim(string_agg(line, {NL} ORDER BY l.n), {NL}) AS body, max(o) AS o FROM (
      SELECT l.doc_id, l.n, line, count(h.n) OVER (PARTITION BY l.doc_id ORDER BY l.n) AS s, h."offset" AS o FROM ln l LEFT JOIN hd h ON h.doc_id = l.doc_id AND h.n = l.n) l GROUP BY l.doc_id, s) b
  LEFT JOIN paths p ON p.doc_id = b.doc_id AND p."offset" = b.o WHERE trim(body) <> ''"""),
    "atom_lines": (["ln"], """
  SELECT *, CASE WHEN mark OR marks % 2 = 1 THEN 'fence' WHEN bar THEN 'table' ELSE 'text' END AS kind, mark AND marks % 2 = 1 AS opens FROM ln"""),
    "atom_runs": (["atom_lines"], """
  SELECT *, sum(CASE WHEN kind = before AND NOT opens THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS atom
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM atom_lines)"""),
    "fences": (["ln"], 'SELECT doc_id, min(start) AS start, max(start + length(line)) AS "end" FROM ln WHERE mark OR marks % 2 = 1 GROUP BY doc_id, (marks - CAST(mark AND marks % 2 = 0 AS INT))'),
    "parts": (["md"], "SELECT doc_id, j AS ord, 500 * j AS \"offset\", substr(text, 500 * j + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS j FROM md)"),
    "piece_lines": (["parts"], f"SELECT doc_id, ord, text, string_split(text, {NL}) AS ls FROM parts"),
    "heads_off": (["piece_lines"], r"SELECT *, len(ls) >= 2 AND starts_with(ltrim(ls[1]), '|') AND NOT regexp_matches(ls[2], '^\s*\|[\s:|-]+\|\s*$') AS headless, len(list_filter(ls, lambda l: starts_with(ltrim(l), '```') OR starts_with(ltrim(l), '~~~'))) AS n_fences FROM piece_lines"),
    "cut": (["parts", "ln"], """
  SELECT p.doc_id, p."offset", CASE WHEN trim(substr(line, 1, CAST(p."offset" - start AS BIGINT))) = '' THEN 'line' WHEN mark OR marks % 2 = 1 THEN 'fence' WHEN bar THEN 'table' ELSE 'prose' END AS place
  FROM parts p JOIN ln ON ln.doc_id = p.doc_id AND start <= p."offset" AND p."offset" <= start + length(line) WHERE ord > 0"""),
}


def _with(names: list[str], last: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" if order else "") + last


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


#: The sweep of the fusion, down to by_case.
SWEPT = """, grid AS (
  SELECT w_dense, w_bm25, rrf_k FROM (VALUES (CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)), (1, 1), (1, 3), (1, 10), (1, 0)) w(w_dense, w_bm25), (VALUES (CAST(1 AS BIGINT)), (5), (20), (60)) c(rrf_k)
  WHERE (w_dense > 0 AND w_bm25 > 0) OR rrf_k = 1
), fused4 AS (
  SELECT w_dense, w_bm25, rrf_k, query_id AS case_id, i, row_number() OVER (PARTITION BY w_dense, w_bm25, rrf_k, query_id ORDER BY round(sum(w / (rrf_k + rank)), 9) DESC, i) AS rank
  FROM (SELECT *, CASE WHEN arm = 'dense' THEN w_dense ELSE w_bm25 END AS w FROM arms, grid WHERE rank <= 50) WHERE w > 0 GROUP BY w_dense, w_bm25, rrf_k, query_id, i
), seen AS (SELECT DISTINCT w_dense, w_bm25, rrf_k, case_id, anchor FROM fused4 JOIN holding USING (i) WHERE rank <= 4),
by_group AS (
  SELECT w_dense, w_bm25, rrf_k, case_id, mode, group_no, count(s.anchor) AS n_hit, count(*) AS n_all FROM anchors CROSS JOIN grid LEFT JOIN seen s USING (w_dense, w_bm25, rrf_k, case_id, anchor)
  GROUP BY w_dense, w_bm25, rrf_k, case_id, mode, group_no
), by_case AS (
  SELECT w_dense, w_bm25, rrf_k, case_id, sum(n_hit) AS n_hit, CASE WHEN mode = 'any' THEN bool_or(n_hit = n_all) ELSE bool_and(n_hit = n_all) END AS ok FROM by_group GROUP BY w_dense, w_bm25, rrf_k, case_id, mode
)
"""


METRICS = ("strict", "strict_norm", "strict_fuzzy", "ident", "gram")
HEADED = f"'# 文件：' || source || {NL} || {NL} || text"

ORACLES: dict[str, str] = {
    "corpus_scan": f"SELECT doc_id AS corpus_ord, source, length({HEADED}) AS chars, sha256({HEADED}) AS sha256 FROM documents",
    "corpus_concat": f"""SELECT source, doc_id AS corpus_ord, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length(t) AS chars, sha256(t) AS sha256 FROM (SELECT source, doc_id, {HEADED} AS t FROM documents)""",
    "normalize": f"SELECT doc_id, length({_norm('text')}) AS chars, sha256({_norm('text')}) AS sha256 FROM documents",
    "char_ngrams": _with(["doc_grams"], "SELECT d.doc_id, count(gram) AS n_grams, count(DISTINCT gram) AS n_distinct FROM documents d LEFT JOIN doc_grams g USING (doc_id) GROUP BY d.doc_id"),
    "identifiers": rf"""WITH found AS (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '`[^`]+`|[A-Za-z_][A-Za-z0-9_]+|\p{{Nd}}+') AS l FROM documents)),
firsts AS (SELECT doc_id, trim(regexp_replace(t, '^`|`$', '', 'g')) AS t, min(i) AS i FROM found GROUP BY ALL),
kept AS (SELECT * FROM firsts WHERE length(t) >= 2 AND NOT (regexp_matches(t, '^\p{{Nd}}+$') AND length(t) > 6))
SELECT d.doc_id, count(t) AS n_ids, sha256(coalesce(string_agg(t, '|' ORDER BY i), '')) AS ids_sha256 FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""",
    "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)",
    "block_anchors": _with(["blocks"], r"SELECT doc_id, ord, substr(regexp_replace(content, '^[\s\p{Z}]+', ''), 1, 60) AS anchor FROM blocks"),
    "refusal": f"SELECT conv_id, turn, regexp_matches(text, '资料里没有提到|资料中没有提到|资料里没有|未提到|没有相关') AND length({_norm('text')}) <= 40 AS refusal FROM conversations",
    "fuzzy_contains": _with(["answers", "anchors"], f""", pairs AS (
  SELECT w.case_id, group_no, anchor_no, {_norm('answer')} AS na, CASE WHEN anchor_no = 1 THEN {_norm("(left(anchor, length(anchor) - 1) || '#')")} ELSE {_norm('anchor')} END AS nn
  FROM answers w JOIN anchors a ON a.case_id = w.case_id
), tested AS (
  SELECT case_id, group_no, anchor_no, CASE WHEN contains(na, nn) THEN true
           WHEN length(nn) >= 8 AND (contains(na, substr(nn, 1, length(nn) // 2)) OR contains(na, substr(nn, length(nn) // 2 + 1))) THEN
             len(list_filter(range(1, length(nn) + 1), lambda p: contains(na, substr(nn, 1, p - 1) || substr(nn, p + 1)))) > 0
             OR len(list_filter(range(1, length(na) - length(nn) + 2), lambda s: len(list_filter(range(0, length(nn)), lambda p: substr(na, s + p, 1) <> substr(nn, p + 1, 1))) <= 1)) > 0
           ELSE false END AS near FROM pairs
)
SELECT case_id, group_no, anchor_no, count(*) FILTER (near) AS n_near, count(*) AS n FROM tested GROUP BY ALL"""),
    "fixed_chunks": _with(["blocks"], "SELECT doc_id, ord, length(content) AS chars, sha256(content) AS sha256 FROM blocks"),
    "block_ids": _with(["blocks"], "SELECT i, doc_id, sha256(content) AS sha256 FROM blocks"),
    "blocks_per_source": _with(["blocks"], "SELECT source, count(*) AS n_blocks FROM blocks GROUP BY source"),
    "index_manifest": _with(["blocks"], "SELECT doc_id AS corpus_ord, d.source, length(text) AS chars, sha256(text) AS sha256, (SELECT count(*) FROM blocks b WHERE b.doc_id = d.doc_id) AS block_count FROM documents d"),
    "index_build": _with(["blocks"], "SELECT 'fixed' AS chunker, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS n_stale FROM blocks"),
    "bm25_postings": _with(["postings"], "SELECT term, count(*) AS n_blocks, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY term"),
    "bm25_idf": _with(["idf"], "SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "chunk_length_stats": _with(["blocks"], "SELECT doc_id, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS median FROM (SELECT doc_id, length(content) AS n FROM blocks) GROUP BY doc_id"),
    "l2_normalize": _with(["vectors"], "SELECT i AS vec_id, list_transform(v, lambda x: round(x, 6)) AS v FROM vectors"),
    "dense_topk": _with(["vectors"], """SELECT query_id, rank, i, round(score, 6) AS score FROM (
  SELECT a.i AS query_id, b.i AS i, list_dot_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.i ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.i) AS rank
  FROM vectors a, vectors b WHERE a.i % 50 = 0) WHERE rank <= 4"""),
    "encoded_topk": _with(["blocks"], """, coded AS (
  SELECT kind, i, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE)) AS v
  FROM (SELECT 'b' AS kind, i, lower(content) AS t FROM blocks UNION ALL SELECT 'q', item_id, 'query: ' || lower(text) FROM benchmark)
), unit AS (SELECT kind, i, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM coded)
SELECT query_id, rank, i, round(score, 6) AS score FROM (
  SELECT q.i AS query_id, b.i, list_dot_product(q.v, b.v) AS score, row_number() OVER (PARTITION BY q.i ORDER BY round(list_dot_product(q.v, b.v), 9) DESC, b.i) AS rank
  FROM unit q JOIN unit b ON q.kind = 'q' AND b.kind = 'b') WHERE rank <= 4"""),
    "bm25_topk": _with(["bm25"], "SELECT query_id, rank, i, round(score, 6) AS score FROM bm25 WHERE rank <= 20"),
    "hybrid_arms": _with(["arms"], "SELECT query_id, arm, rank, i FROM arms WHERE rank <= 20"),
    "rrf_fuse": _with(["arms"], "SELECT query_id, i, round(sum(1 / CAST(60 + rank AS DOUBLE)), 9) AS score FROM arms WHERE rank <= 20 GROUP BY query_id, i"),
    "hybrid_topk": _with(["arms"], """SELECT query_id, rank, i, score FROM (
  SELECT query_id, i, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS rank
  FROM (SELECT query_id, i, round(sum(1 / CAST(5 + rank AS DOUBLE)), 9) AS score FROM arms WHERE rank <= 20 GROUP BY query_id, i)) WHERE rank <= 4"""),
    "hits_lookup": _with(["lexical_hits"], "SELECT query_id, rank, i, source, sha256(content) AS sha256 FROM lexical_hits"),
    "hits_preview": _with(["lexical_hits"], f"SELECT query_id, rank, i, CAST(length(content) AS BIGINT) AS chars, replace(substr(content, 1, 56), {NL}, '⏎') || '…' AS preview FROM lexical_hits"),
    "distractors": _with(["lexical_hits"], "SELECT query_id, count(*) FILTER (contains(source, '1')) AS n_distractors, count(*) AS n_hits FROM lexical_hits GROUP BY query_id"),
    "format_context": _with(["contexts"], "SELECT * FROM contexts"),
    "prompt_messages": _with(["contexts"], f"""SELECT query_id, CAST(0 AS BIGINT) AS n, 'system' AS role, sha256('根据资料回答问题，资料里没有的内容请说「资料里没有提到」。' || {NL} || {NL} || '资料：' || {NL} || context) AS sha256 FROM contexts
UNION ALL SELECT query_id, 1, 'user', sha256(text) FROM contexts JOIN benchmark ON item_id = query_id"""),
    "retrieval_ok": _with(["results"], "SELECT arm, case_id, ok, CASE WHEN ok THEN 'full' WHEN n_hit > 0 THEN 'partial' ELSE 'none' END AS mark FROM results WHERE k = 4"),
    "k_sweep": _with(["results"], "SELECT k, arm, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok AND n_hit > 0) AS n_partial, count(*) AS n FROM results GROUP BY k, arm"),
    "hit_rate_pivot": _with(["results", "needs"], """SELECT bank, type, round(avg(CAST(ok AS INT)) FILTER (arm = 'dense'), 6) AS dense, round(avg(CAST(ok AS INT)) FILTER (arm = 'bm25'), 6) AS bm25,
  round(avg(CAST(ok AS INT)) FILTER (arm = 'hybrid'), 6) AS hybrid, round(avg(need), 6) AS mean_need FROM results JOIN needs USING (case_id) JOIN cases USING (case_id) WHERE k = 4 GROUP BY bank, type"""),
    "disagreements": _with(["results"], "SELECT case_id, string_agg(arm, ',' ORDER BY arm) FILTER (ok) AS winners FROM results WHERE k = 4 GROUP BY case_id HAVING bool_or(ok) AND NOT bool_and(ok)"),
    "attribution": _with(["results", "needs"], "SELECT case_id, CASE WHEN need IS NULL THEN 'unsatisfiable' WHEN need > 4 THEN 'structural' WHEN n_hit > 0 THEN 'partial' ELSE 'none' END AS reason, need, n_hit FROM results JOIN needs USING (case_id) WHERE k = 4 AND arm = 'hybrid' AND NOT ok"),
    "min_cover": _with(["covers"], "SELECT case_id, group_no, cover, complete FROM covers"),
    "anchor_audit": _with(["anchors", "holding"], """SELECT case_id, group_no, anchor_no, CASE WHEN n > 0 THEN 'found' WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, anchor)) THEN 'split' ELSE 'typo' END AS state, n AS n_blocks
FROM (SELECT a.*, (SELECT count(*) FROM holding h WHERE h.anchor = a.anchor) AS n FROM anchors a)"""),
    "arm_overlap": _with(["hits"], """SELECT query_id, count(*) FILTER (d AND b) AS dense_bm25, count(*) FILTER (d AND h) AS dense_hybrid, count(*) FILTER (b AND h) AS bm25_hybrid FROM (
  SELECT case_id AS query_id, i, bool_or(arm = 'dense') AS d, bool_or(arm = 'bm25') AS b, bool_or(arm = 'hybrid') AS h FROM hits WHERE k = 4 GROUP BY case_id, i) GROUP BY query_id"""),
    "fuse_sweep": _with(["arms", "anchors", "holding"], SWEPT + "SELECT w_dense, w_bm25, rrf_k, count(*) FILTER (ok) AS n_ok, CAST(sum(n_hit) AS BIGINT) AS n_hit FROM by_case GROUP BY w_dense, w_bm25, rrf_k"),
    "fuse_sweep_by_bank": _with(["arms", "anchors", "holding", "cases"], SWEPT + """, per AS (
  SELECT w_dense, w_bm25, rrf_k, CASE WHEN grouping(bank) = 1 THEN 'total' ELSE bank END AS bank, count(*) FILTER (ok) AS n_ok, count(*) AS n
  FROM by_case JOIN cases USING (case_id) GROUP BY GROUPING SETS ((w_dense, w_bm25, rrf_k, bank), (w_dense, w_bm25, rrf_k))
) SELECT *, max(n_ok) OVER (PARTITION BY bank) - n_ok AS behind FROM per"""),
    "judge_group": _with(["groups"], f"SELECT answer_id, case_id, group_no, {_rounded(*METRICS)} FROM groups"),
    "judge_case": _with(["judged"], f"SELECT answer_id, case_id, {_rounded(*METRICS)} FROM judged"),
    "corpus_ngrams": _with(["corpus_grams"], "SELECT gram FROM corpus_grams"),
    "copy_ratio": _with(["copied"], "SELECT answer_id, round(copy, 6) AS copy FROM copied"),
    "gram_null": _with(["floors"], "SELECT answer_id, round(gram_null, 6) AS gram_null FROM floors"),
    "deltas": _with(["diffs"], f"SELECT answer_id, case_id, arm, {_rounded('gram', 'gram_null', 'delta')} FROM diffs"),
    "verdict": _with(["diffs"], """, by_case AS (SELECT case_id, bank, type, arm, avg(delta) AS delta FROM diffs GROUP BY case_id, bank, type, arm),
pairs AS (SELECT a.arm, a.bank, a.type, round(a.delta - b.delta, 9) AS diff FROM by_case a JOIN by_case b ON b.case_id = a.case_id AND b.arm = 'long' WHERE a.arm <> 'long')
SELECT arm, CASE WHEN grouping(bank) = 1 THEN 'total' ELSE bank END AS bank, CASE WHEN grouping(type) = 1 THEN 'total' ELSE type END AS type,
       count(*) FILTER (diff > 0.1) AS wins, count(*) FILTER (diff < -0.1) AS losses, count(*) FILTER (abs(diff) <= 0.1) AS ties FROM pairs GROUP BY GROUPING SETS ((arm, bank, type), (arm))"""),
    "score_summary": _with(["judged", "copied"], f"""SELECT bank, type, arm, {', '.join(f'round(avg({m}), 6) AS {m}' for m in (*METRICS, 'copy'))}, round(avg(length(answer)), 6) AS chars,
  count(*) FILTER (regexp_matches(answer, '资料里没有提到|资料中没有提到|资料里没有|未提到|没有相关') AND length({_norm('answer')}) <= 40) AS refusals, count(ident) AS n_ident, count(*) AS n
FROM judged JOIN copied USING (answer_id) GROUP BY bank, type, arm"""),
    "metric_conflicts": _with(["judged"], f"SELECT answer_id, {_rounded('strict_fuzzy', 'gram')} FROM judged WHERE greatest(strict_fuzzy, gram) >= 0.5 AND least(strict_fuzzy, gram) <= 0.2"),
    "usage_extract": "SELECT event_id, CAST(floor(value) AS BIGINT) AS input_tokens, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS cache_hit FROM events",
    "usage_by_arm": """SELECT event_type AS arm, CAST(sum(v) AS BIGINT) AS input_tokens, CAST(sum(h) AS BIGINT) AS cache_hit, round(sum(h) / nullif(sum(v), 0), 6) AS hit_share, max(v) - min(v) > 2000 AS input_varies
FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS h FROM events) GROUP BY event_type""",
    "usage_layouts": f"SELECT event_id, input_tokens, output_tokens, cache_hit, cache_miss FROM {REPLIES}",
    "usage_totals": f"""SELECT *, round(cache_hit / nullif(input_tokens, 0), 6) AS hit_share FROM (
  SELECT arm, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_hit), 0) AS BIGINT) AS cache_hit,
    CAST(coalesce(sum(cache_miss), 0) AS BIGINT) AS cache_miss, count(*) AS n, coalesce(max(input_tokens) - min(input_tokens) > 2000, false) AS input_varies FROM {REPLIES} GROUP BY arm)""",
    "source_check": "SELECT *, n_sources >= 2 AND n_named > 0 AS complete FROM (SELECT count(source) AS n_sources, count(*) FILTER (contains(source, '1')) AS n_named FROM (SELECT DISTINCT source FROM documents WHERE text <> ''))",
    "answer_run": _with(["contexts"], f"SELECT query_id, sha256({CITED} || context || {NL} || {NL} || '问题：' || text || {NL}) AS sha256, substr(context || {NL} || {NL} || '问题：' || text || {NL}, 1, 100) AS answer FROM contexts JOIN benchmark ON item_id = query_id"),
    "raw_verdict": _with(["judged"], """, by_case AS (SELECT case_id, bank, type, arm, avg(gram) AS delta FROM judged GROUP BY case_id, bank, type, arm),
pairs AS (SELECT a.arm, a.bank, a.type, round(a.delta - b.delta, 9) AS diff FROM by_case a JOIN by_case b ON b.case_id = a.case_id AND b.arm = 'long' WHERE a.arm <> 'long')
SELECT arm, CASE WHEN grouping(bank) = 1 THEN 'total' ELSE bank END AS bank, CASE WHEN grouping(type) = 1 THEN 'total' ELSE type END AS type,
       count(*) FILTER (diff > 0.1) AS wins, count(*) FILTER (diff < -0.1) AS losses, count(*) FILTER (abs(diff) <= 0.1) AS ties FROM pairs GROUP BY GROUPING SETS ((arm, bank, type), (arm))"""),
    "stored_floor_deltas": _with(["diffs"], "SELECT answer_id, case_id, arm, round(delta, 6) AS delta FROM diffs"),
    "arm_delta_medians": _with(["by_case"], """SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, round(median(round(abs(a.delta - b.delta), 9)), 6) AS median
FROM by_case a JOIN by_case b ON b.case_id = a.case_id AND a.arm < b.arm GROUP BY a.arm, b.arm"""),
    "case_spans": _with(["spans", "needs"], """SELECT case_id, need, CAST(CASE WHEN mode = 'any' THEN coalesce(len(shortest.c), 0) WHEN whole THEN len(every) ELSE 0 END AS BIGINT) AS n_span FROM spans JOIN needs USING (case_id)"""),
    "answer_arms": _with(["arm_answers"], "SELECT query_id, arm, sha256(prompt) AS digest, answer FROM arm_answers"),
    "answer_usage": _with(["arm_answers"], """SELECT arm, CAST(sum(length(prompt)) AS BIGINT) AS n_input, CAST(sum(length(answer)) AS BIGINT) AS n_output, count(*) AS n, max(length(prompt)) - min(length(prompt)) > 2000 AS input_varies FROM arm_answers GROUP BY arm"""),
    "chunk_lateral": _with(["blocks"], 'SELECT doc_id, ord, 500 * ord AS "offset", sha256(content) AS sha256 FROM blocks'),
    "mean_delta": _with(["diffs"], "SELECT arm, round(avg(delta), 6) AS mean_delta, count(delta) AS n FROM (SELECT case_id, arm, avg(delta) AS delta FROM diffs GROUP BY case_id, arm) GROUP BY arm"),
    "md_sections": _with(["secs"], "SELECT doc_id, section, heading, body FROM secs"),
    "heading_path": _with(["secs"], f"SELECT doc_id, section, sha256(CASE WHEN heading <> '' THEN '[章节] ' || heading || {NL} || body ELSE body END) AS sha256 FROM secs"),
    "md_atoms": _with(["atom_runs"], f"SELECT doc_id, CAST(atom AS BIGINT) AS atom, kind, sha256(string_agg(line, {NL} ORDER BY n)) AS sha256 FROM atom_runs GROUP BY doc_id, atom, kind"),
    "table_split": f"""WITH RECURSIVE r AS (
  SELECT table_id, row, CAST(length(row) + 1 AS BIGINT) AS w, row_number() OVER (PARTITION BY table_id ORDER BY row_no) AS n
  FROM (SELECT CAST(c_nationkey AS BIGINT) * 1000000 + c_custkey // 500 AS table_id, c_custkey AS row_no, '| ' || c_custkey || ' | ' || c_name || ' |' AS row FROM customer)),
f AS (SELECT table_id, n, row, CAST(0 AS BIGINT) AS part_no, w AS used FROM r WHERE n = 1
  UNION ALL SELECT r.table_id, r.n, r.row, CASE WHEN f.used + w > 500 - 14 - 9 - 2 THEN f.part_no + 1 ELSE f.part_no END, CASE WHEN f.used + w > 500 - 14 - 9 - 2 THEN w ELSE f.used + w END
  FROM f JOIN r ON r.table_id = f.table_id AND r.n = f.n + 1)
SELECT table_id, part_no, sha256('| key | name |' || {NL} || '|---|---|' || {NL} || string_agg(row, {NL} ORDER BY n)) AS sha256 FROM f GROUP BY table_id, part_no""",
    "lone_fences": _with(["heads_off"], "SELECT doc_id, ord, CAST(n_fences AS BIGINT) AS n_fences FROM heads_off"),
    "headerless_tables": _with(["heads_off"], "SELECT doc_id, count(*) FILTER (headless) AS headerless FROM heads_off GROUP BY doc_id"),
    "fence_ranges": _with(["fences"], "SELECT * FROM fences"),
    "table_ranges": _with(["ln"], """SELECT doc_id, min(start) AS start, max(start + length(line)) AS "end" FROM (
  SELECT *, sum(CAST(NOT bar AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM ln) WHERE bar GROUP BY doc_id, island"""),
    "headings_at": _with(["hd"], 'SELECT doc_id, "offset", level, title FROM hd'),
    "in_ranges": _with(["parts", "fences"], 'SELECT doc_id, "offset" FROM parts p WHERE ord > 0 AND EXISTS (SELECT 1 FROM fences f WHERE f.doc_id = p.doc_id AND f.start < p."offset" AND p."offset" < f."end")'),
    "path_asof": _with(["parts", "paths"], """SELECT p.doc_id, p."offset", coalesce((SELECT max_by(path, h."offset") FROM paths h WHERE h.doc_id = p.doc_id AND h."offset" <= p."offset"), '') AS path FROM parts p"""),
    "cut_quality": _with(["heads_off", "cut"], """SELECT doc_id, n_blocks, torn, headerless, over_size, clean, coalesce(l, 0) AS cut_line, coalesce(f, 0) AS cut_fence, coalesce(t, 0) AS cut_table, coalesce(p, 0) AS cut_prose FROM (
  SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (n_fences % 2 = 1) AS torn, count(*) FILTER (headless) AS headerless, count(*) FILTER (length(text) > 500) AS over_size,
         count(*) FILTER (n_fences % 2 = 0 AND length(text) <= 500) AS clean FROM heads_off GROUP BY doc_id) LEFT JOIN (
  SELECT doc_id, count(*) FILTER (place = 'line') AS l, count(*) FILTER (place = 'fence') AS f, count(*) FILTER (place = 'table') AS t, count(*) FILTER (place = 'prose') AS p FROM cut GROUP BY doc_id) USING (doc_id)"""),
    "section_extract": _with(["md"], rf"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS no, string_split(ps[i], {NL})[1] AS title, coalesce(nullif(regexp_extract(ps[i], '(?s)### Notes\s*(.{{0,90}})', 1), ''), '(none)') AS detail
FROM (SELECT doc_id, ps, unnest(range(2, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split({NL} || text, {NL} || '## ') AS ps FROM md))"""),
}
