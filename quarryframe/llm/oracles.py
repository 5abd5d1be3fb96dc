"""DuckDB SQL of the operators that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from quarryframe.llm import centroid_clusters, line_dedup, quality, source_audit, warc_archive


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup_sql() -> str:
    cfg = line_dedup.LineConfig()
    return f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {SPACES}), '{UPPER}', '{LOWER}') AS key FROM
  (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= {cfg.min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {cfg.min_docs}),
m AS (SELECT l.*, k.keep IS NOT NULL AND k.keep <> doc_id AS gone FROM l LEFT JOIN k ON l.key = k.key AND length(l.key) >= {cfg.min_chars})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def quality_sql() -> str:
    cfg = quality.QualityConfig()
    vocab = ", ".join(f"'{w}'" for w in quality.vocabulary())
    classes = {"upper": r"[\p{Lu}\p{Lt}]", "lower": r"[\p{Ll}\p{Lm}\p{Lo}]", "digit": r"\p{Nd}", "space": r"[\x20\x09-\x0D]", "symbol": r"[#*$%&|<>]"}
    counts = ", ".join(f"length(regexp_replace(t, '[^' || '{p[1:-1] if p[0] == '[' else p}' || ']', '', 'g')) AS {k}" for k, p in classes.items())
    names = list(quality.CLASSES)
    # one row per document and histogram cell; cells of characters have kind 0, of words kind 1
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, {counts} FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM
  (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n >= 2) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) - "space" AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  [{', '.join('length(t) - ("upper" + "lower" + digit + "space" + symbol)' if k == 'other' else f'"{k}"' for k in names)}] AS ch, ws FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {cfg.min_words} OR 100 * n_repeat_words > {cfg.max_repeat_percent} * n_words AS base_failed FROM f),
cw AS (SELECT doc_id, x AS cell, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS x FROM b) WHERE x IN ({vocab}) GROUP BY 1, 2),
cells AS (SELECT doc_id, 1 AS kind, cell, n FROM cw
  UNION ALL SELECT b.doc_id, 1, '', n_words - coalesce(k, 0) FROM b LEFT JOIN (SELECT doc_id, sum(n) AS k FROM cw GROUP BY 1) USING (doc_id)
  UNION ALL SELECT doc_id, 0, CAST(i AS VARCHAR), ch[i] FROM b, range(1, {len(names) + 1}) s(i)),
ref AS (SELECT lang, kind, cell, sum(n) AS n FROM cells JOIN b USING (doc_id) WHERE lang IS NOT NULL AND NOT base_failed GROUP BY ALL),
tot AS (SELECT lang, kind, sum(n) AS n FROM ref GROUP BY ALL),
langs AS (SELECT lang FROM tot WHERE kind = 1 AND n >= {quality.MIN_LANGUAGE_SHARE} * (SELECT sum(n) FROM tot WHERE kind = 1)),
q AS (SELECT lang, kind, cell, ref.n / tot.n AS q FROM ref JOIN tot USING (lang, kind) JOIN langs USING (lang) WHERE ref.n > 0),
dt AS (SELECT doc_id, kind, sum(n) AS n FROM cells GROUP BY ALL),
p AS (SELECT doc_id, kind, cell, cells.n / dt.n AS p FROM cells JOIN dt USING (doc_id, kind) WHERE cells.n > 0),
pq AS (SELECT p.doc_id, q.lang, p.kind, p, q, (p + q) / 2 AS m FROM p JOIN q ON p.kind = q.kind AND p.cell = q.cell),
-- cells that only one side has add p/2 or q/2 to the divergence
js AS (SELECT doc_id, lang, kind, sqrt(greatest(0, (sum(p * log2(p / m)) + sum(q * log2(q / m)) + (1 - sum(p)) + (1 - sum(q))) / 2)) AS dist FROM pq GROUP BY ALL),
near AS (SELECT doc_id, min(dist) FILTER (kind = 0) AS cd, min(dist) FILTER (kind = 1) AS wd FROM js GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= {cfg.min_histogram_chars} AND cd > {cfg.max_char_distance}, false)
  AND NOT coalesce(n_words >= {cfg.min_histogram_words} AND wd > {cfg.max_word_distance}, false) AS kept
FROM b LEFT JOIN near USING (doc_id)"""


def near_dedup_sql(k: int, percent: int) -> str:
    """Exact links through shared shingles, and components by reachability."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {k} THEN ws ELSE ws[i:i + {k - 1}] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {k - 2}))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, w.doc_id = r.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) r USING (doc_id)"""


def cluster_sql() -> str:
    """Every round spelled out: all distances, then exact floored means."""
    cfg = centroid_clusters.ClusterConfig()
    rounds = []
    for r in range(cfg.rounds + 1):
        rounds.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, [d, c]) AS c, min(d) AS d FROM
  (SELECT v.vec_id, v.x, k.c, list_sum(list_transform(list_zip(v.x, k.y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} k) GROUP BY 1, 2)""")
        if r < cfg.rounds:
            rounds.append(f"""s{r} AS (SELECT c, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, range(1, {cfg.dims + 1}) t(j) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.y, k.y) AS y FROM c{r} k LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS y FROM s{r} GROUP BY 1) m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({cfg.scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {cfg.dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {cfg.dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT sha256('{cfg.seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {cfg.k})),
{", ".join(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.y, ',')) AS centroid_sha256 FROM a{cfg.rounds} a JOIN c{cfg.rounds} k USING (c)"""


def warc_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc_archive.MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def source_audit_sql() -> str:
    """Every kept term of every pair, without grouping of terms."""
    cfg = source_audit.AuditConfig()
    p = lambda n, size: f"1 + (CAST({cfg.unit} AS HUGEINT) * ({n} + {cfg.smoothing})) // ({size} + {cfg.smoothing} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(df) >= {cfg.min_docs}),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, total, coalesce(c.n, 0) AS n, v, lang_size, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, {p("n", "size")} AS p, {p("total", "lang_size")} AS q FROM x),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allp AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
u AS (SELECT * FROM allp UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= {cfg.top_terms}"""
