"""SQL for DuckDB that gives the rows of the registered queries, where SQL can."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS k FROM d, unnest(range(1, len(words) - 6)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 8)) AS v(j) GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered c USING (rid)),
f AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_chars FROM m),
g AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines, mean_chars < 2 OR mean_chars > 15 AS word_length FROM f),
rule AS (SELECT source, r, count(*) AS docs, sum(failed::INT) AS bad FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'word_length']) AS r, unnest([short, repeats, symbols, lines, word_length]) AS failed FROM g WHERE source IS NOT NULL) GROUP BY ALL),
t AS (SELECT r, sum(bad) / sum(docs) AS mean, avg(1 / docs) AS alone FROM rule GROUP BY r),
v AS (SELECT r, any_value(mean) AS mean, any_value(alone) AS alone, avg((bad / docs - mean) * (bad / docs - mean)) AS square FROM rule JOIN t USING (r) GROUP BY r),
p AS (SELECT r, mean, CASE WHEN mean * (1 - mean) > 0 AND alone < 1 THEN least(greatest((square / (mean * (1 - mean)) - alone) / (1 - alone), 0.0), 1.0) ELSE 0.0 END AS shared FROM v),
q AS (SELECT source, mean, docs, shared, (shared * bad + mean * (1 - shared)) / (shared * docs + 1 - shared) AS rate FROM rule JOIN p USING (r)),
h AS (SELECT source, max(rate - 1.645 * sqrt(rate * (1 - rate) * shared / (shared * docs + 1)) > mean + 0.25) AS bad FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND NOT coalesce(h.bad, false) AS kept FROM g LEFT JOIN h USING (source)"""

OP4 = """WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE len(v) = (SELECT len(v) AS l FROM e GROUP BY l ORDER BY count(*) DESC, l LIMIT 1)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, greatest(-1.0, least(1.0, list_dot_product(q.v, c.v) / (q.n * c.n))) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) DESC, vec_id) AS r FROM p) WHERE r <= 5"""

OP6 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 2), ' ') AS k FROM d, unnest(range(1, greatest(len(words) - 1, 2))) AS u(i) WHERE len(words) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, coalesce(least(d.doc_id, min(r.other)), d.doc_id) AS component_id FROM d LEFT JOIN c USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id"""

OP7 = rf"""WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS k FROM d, unnest(range(1, len(words) - 18)) AS u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, unnest(range(0, 20)) AS v(j)),
w AS (SELECT doc_id, i, words[i] AS word FROM d, unnest(range(1, len(words) + 1)) AS u(i)),
s AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

OP9 = """SELECT page_id, bytes AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS bytes, min(page_id) OVER (PARTITION BY html) AS first FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""

SQL = {"op2_quality_rules": OP2, "op4_approximate_neighbours": OP4, "op6_ngram_jaccard_join": OP6, "op7_substring_dedup": OP7, "op9_warc": OP9}
