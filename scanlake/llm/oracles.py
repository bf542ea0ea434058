"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import secrets


def secrets_sql() -> str:
    """All rules by plain regular expressions over every text: no index, no candidates. Runs of 24 hex digits are the
    maximal runs of at least 24."""
    lists, cols = [], []
    for i, r in enumerate(secrets.RULES):
        p = ("[0-9a-f]{24,}" if r.kind == "hex" else r.pattern).replace("'", "''")
        lists.append(f"regexp_extract_all(t, '{p}', 0) AS m{i}, regexp_extract_all(t, '{p}', {r.group}) AS g{i}, regexp_split_to_array(t, '{p}') AS b{i}")
        cols.append(
            f"""list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: length(g{i}[k]) >= {r.least}),
              lambda k: {{'start': CAST(coalesce(list_sum(list_transform(b{i}[1:k], lambda x: length(x))), 0)
                                 + coalesce(list_sum(list_transform(m{i}[1:k - 1], lambda x: length(x))), 0) AS BIGINT),
                         'ord': {i}, 'size': CAST(length(m{i}[k]) AS BIGINT), 'kind': '{r.kind}'}})"""
        )
    joined = lambda e: f"array_to_string(list_transform({e}, lambda z: concat(z.kind, ':', z.start, ':', z.start + z.size)), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      l AS (SELECT doc_id, {', '.join(lists)} FROM d),
      f AS (SELECT doc_id, list_sort(flatten([{', '.join(cols)}])) AS sp FROM l)
      SELECT doc_id, CAST(len(list_filter(sp, lambda x: x.ord = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(sp, lambda x: x.ord = 1)) AS BIGINT) AS n_access,
        CAST(len(list_filter(sp, lambda x: x.ord = 2)) AS BIGINT) AS n_hex, sha256({joined('list_filter(sp, lambda x: x.ord < 3)')}) AS base_sha256, {joined('sp')} AS spans FROM f"""


TOPK = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
      SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, and the closure of their links.
NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
      n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
      u AS (SELECT s.doc_id, n.n, unnest(s) AS x FROM s JOIN n USING (doc_id)),
      e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 90 * a.n <= 100 * b.n AND 90 * b.n <= 100 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
      r(d, x) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.d, e.b FROM r JOIN e ON r.x = e.a)
      SELECT n.doc_id, n.n AS n_shingles, min(r.x) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n"""


def _leaf(text: str) -> str:
    each = [f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(CAST(encode(CAST({c} AS VARCHAR)) AS BLOB)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(each)})"


#: Levels as lists of digests, one list a tree; the bit by bit checksum decides which rows are altered.
MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS other,
        list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
          lambda s, c: list_reduce([xor(s, c)] || list_transform(range(8), lambda i: CAST(0 AS BIGINT)), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS c FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source IS NOT NULL, source) - 1 AS t FROM d),
      up(t, k, x) AS (SELECT t, 0, list(leaf ORDER BY i) FROM o GROUP BY t
        UNION ALL SELECT t, k + 1, list_transform(range(0, len(x), 3), lambda p: sha256(array_to_string(x[p + 1:p + 3], ''))) FROM up WHERE len(x) > 1),
      s AS (SELECT t, x[1] AS subroot FROM up WHERE len(x) = 1),
      top(k, x) AS (SELECT 0, list(subroot ORDER BY t) FROM s
        UNION ALL SELECT k + 1, list_transform(range(0, len(x), 3), lambda p: sha256(array_to_string(x[p + 1:p + 3], ''))) FROM top WHERE len(x) > 1),
      lv AS (SELECT t, k, x FROM up WHERE len(x) > 1 UNION ALL SELECT s.t, k + m, x FROM top, s JOIN (SELECT t, max(k) AS m FROM up GROUP BY t) USING (t) WHERE len(x) > 1),
      ix AS (SELECT t, max(k) AS m FROM up GROUP BY t),
      go(t, i, k, j, h, sib) AS (SELECT t, i, CAST(0 AS BIGINT), CASE WHEN m = 0 THEN t ELSE i END, CASE WHEN c % 2 = 1 THEN other ELSE leaf END, '' FROM o JOIN ix USING (t)
        UNION ALL SELECT go.t, go.i, go.k + 1, CASE WHEN go.k + 1 = ix.m THEN go.t ELSE go.j // 3 END,
          sha256(array_to_string(lv.x[go.j // 3 * 3 + 1:go.j], '') || go.h || array_to_string(lv.x[go.j + 2:go.j // 3 * 3 + 3], '')),
          go.sib || array_to_string(lv.x[go.j // 3 * 3 + 1:go.j], '') || array_to_string(lv.x[go.j + 2:go.j // 3 * 3 + 3], '')
          FROM go JOIN lv ON lv.t = go.t AND lv.k = go.k JOIN ix ON ix.t = go.t),
      e AS (SELECT t, i, arg_max(h, k) AS folded_root, arg_max(sib, k) AS sib FROM go GROUP BY t, i)
      SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, folded_root, folded_root = root AS verified
      FROM o JOIN s USING (t) JOIN e USING (t, i), (SELECT x[1] AS root FROM top WHERE len(x) = 1)"""


NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS anchor_id, q.r, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
      p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5)
      SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
      QUALIFY row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, vec_id) <= 10"""


#: Rows that repeat page_id and html are told apart by their order.
WARC = """WITH d AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
      w AS (SELECT page_id, h, octet_length(encode(h)) AS n, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r) AS i, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r) AS f FROM d)
      SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND i > 1 THEN f END AS refers_to FROM w"""
