"""Operators that are one relational text in both dialects; the survey's identifiers stand before each."""

_PROFILE = """SELECT count(*) AS docs, sum($n_words(text)) AS words, avg($n_words(text)) AS avg_words, sum(length(text)) AS chars FROM {documents}"""

#: Passages of 1500 characters by where a name starts; a piece has the character before it and the rest of its last word. Names of two mentions and more.
_IN_PASSAGES = r"""(SELECT DISTINCT doc_id, k, name FROM (SELECT doc_id, k, explode(regexp_extract_all(piece, ' ([A-ZÀ-Þ][a-zà-ÿ][a-zà-ÿ]+)', 1)) AS name FROM (SELECT doc_id, k,
        concat(CASE WHEN k = 0 THEN substring(text, 1, 1500) ELSE substring(text, 1500 * k, 1501) END, regexp_extract(substring(text, 1500 * (k + 1) + 1, 1500), '^[a-zà-ÿ]+', 0)) AS piece
        FROM (SELECT doc_id, text, explode(sequence(0, cast(floor((length(text) - 1) / 1500) AS int))) AS k FROM {documents} WHERE length(text) > 0) w) p) x
        WHERE name IN (SELECT name FROM {mentions} f GROUP BY name HAVING count(*) >= 2))"""
_COOCCUR = "(SELECT a.name AS a, b.name AS b, count(*) AS passages FROM " + _IN_PASSAGES + " a JOIN " + _IN_PASSAGES + " b ON a.doc_id = b.doc_id AND a.k = b.k AND a.name < b.name GROUP BY a.name, b.name)"

TEXTS = {
    # Lines that are blank, table-of-contents leaders or page numbers are noise
    "noise_lines": """SELECT doc_id, count(*) AS lines, sum(CASE WHEN trim(line) = '' OR regexp_like(line, '[.][.][.][.]+ *[0-9]+ *$') OR regexp_like(line, '^ *[0-9]+ *$') THEN 1 ELSE 0 END) AS noise
        FROM (SELECT doc_id, explode(split(text, '\n')) AS line FROM {documents}) l GROUP BY doc_id""",
    # SC7, SC8: lines of tables
    "table_lines": "SELECT doc_id, count(*) AS table_rows, max(length(line)) AS widest FROM (SELECT doc_id, explode(split(text, '\n')) AS line FROM {documents}) l WHERE line LIKE '%|%' AND length(line) > 40 GROUP BY doc_id",
    # rows of a model checked field by field
    "json_validate": """SELECT event_type, CASE WHEN k IS NULL THEN 'unreadable' WHEN k < 10 THEN 'out of list' ELSE 'valid' END AS anomaly, count(*) AS n FROM (
        SELECT event_type, $json(props, '$.k') AS k FROM {events}) e GROUP BY event_type, CASE WHEN k IS NULL THEN 'unreadable' WHEN k < 10 THEN 'out of list' ELSE 'valid' END""",
    # F1, F2 on names with their first letters lowered
    "entity_canonical": """SELECT canon, count(*) AS mentions FROM (SELECT lower(trim(name)) AS canon FROM {mentions} m) c WHERE length(canon) >= 4 AND canon NOT IN ('that', 'this', 'with', 'from', 'the') GROUP BY canon""",
    # aliases, then families, then the rest for review
    "status_normalise": """SELECT raw, CASE WHEN raw = 'F' THEN 'finished' WHEN raw = 'O' THEN 'open' ELSE 'review' END AS status, n FROM (SELECT o_orderstatus AS raw, count(*) AS n FROM {orders} GROUP BY o_orderstatus) o""",
    # F15, F16
    "keyword_groups": "SELECT item_id, (text LIKE '%the%' OR text LIKE '%that%') AND (text LIKE '%ing%' OR text LIKE '%tion%') AS met FROM {benchmark}",
    "keyword_edges": "SELECT user_id, event_type, count(*) AS n FROM {events} WHERE event_type LIKE '%err%' OR event_type LIKE '%click%' GROUP BY user_id, event_type",
    # A4
    "label_histogram": "SELECT label, count(*) AS n, round(count(*) / cast(sum(count(*)) OVER () AS double), 6) AS share FROM {embeddings} GROUP BY label",
    # Pairs of lines' words would be too many on whole texts; types of a user's events pair up
    "entity_pairs": """SELECT a, b, count(*) AS passages FROM (SELECT DISTINCT x.event_type AS a, y.event_type AS b, x.user_id FROM (SELECT DISTINCT user_id, event_type FROM {events}) x JOIN (SELECT DISTINCT user_id, event_type FROM {events}) y ON x.user_id = y.user_id AND x.event_type < y.event_type) p GROUP BY a, b""",
    # A6, J11 on kept names within passages of documents
    "entity_cooccurrence": "SELECT a, b, passages FROM " + _COOCCUR + " c",
    "entity_degree": "SELECT entities, pairs, round(2 * pairs / cast(nullif(entities, 0) AS double), 2) AS avg_degree FROM (SELECT count(*) AS pairs FROM " + _COOCCUR + " c) p CROSS JOIN (SELECT count(*) AS entities FROM (SELECT name FROM {mentions} m GROUP BY name HAVING count(*) >= 2) g) e",
    # Reuse of predicates
    "probe_metrics": """SELECT count(*) AS predicates, round(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / cast(sum(n) AS double), 6) AS reuse, round(avg(CASE WHEN docs >= 2 THEN $one ELSE $zero END), 6) AS crossed FROM (SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS docs FROM {part} GROUP BY p_type) g""",
    # A22
    "rerank_gain": """SELECT cut, round(avg(without_hit), 6) AS recall_without, round(avg(with_hit), 6) AS recall_with, round(avg(with_hit) - avg(without_hit), 6) AS gain FROM (
        SELECT cut, CASE WHEN a <= cut THEN $one ELSE $zero END AS without_hit, CASE WHEN b <= cut THEN $one ELSE $zero END AS with_hit FROM (SELECT o_orderkey % 20 + 1 AS a, o_custkey % 20 + 1 AS b FROM {orders}) r CROSS JOIN (SELECT 3 AS cut UNION ALL SELECT 5 UNION ALL SELECT 10) c) h GROUP BY cut""",
    # A21, X12
    "recall_at_k": """SELECT k, recall, round(lead(recall) OVER (ORDER BY k) - recall, 6) AS next_gain FROM (SELECT k, round(avg(CASE WHEN r <= k THEN $one ELSE $zero END), 6) AS recall FROM (SELECT l_partkey % 30 + 1 AS r FROM {lineitem}) x
        CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20) ks GROUP BY k) g""",
    # Carry a section forward
    "section_carry": """SELECT conv_id, section, count(*) AS turns FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM {conversations}) s GROUP BY conv_id, section""",
    # SC11
    "concat_sources": "SELECT conv_id, sha1($join(text, turn)) AS sha FROM {conversations} WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id",
    # X5, X15
    "tight_decisions": "SELECT source, round(100 * cast(bad AS double) / n, 4) AS margin, abs(100 * cast(bad AS double) / n - 15) <= 8 AS tight FROM (SELECT source, count(*) AS n, sum(CASE WHEN length(text) < 300 THEN 1 ELSE 0 END) AS bad FROM {documents} GROUP BY source) g",
    # X7
    "rag_versions": """SELECT version, size_chars, cast(ceil(chars / (size_chars * 0.85)) AS bigint) AS chunks, CASE WHEN chars / (size_chars * 0.85) > 50000 THEN 'HNSW' ELSE 'FLAT' END AS index_kind FROM (SELECT cast(sum(length(text)) AS double) AS chars FROM {documents}) d
        CROSS JOIN (SELECT 'fast' AS version, 2990 AS size_chars UNION ALL SELECT 'balanced', 2990 UNION ALL SELECT 'precise', 1380) v""",
    # A2
    "corpus_profile": "SELECT docs, words, cast(floor(words * 1.3) AS bigint) AS tokens, round(avg_words, 4) AS avg_words, chars FROM (" + _PROFILE + ") p",
    # A1
    "language_mix": """SELECT lang, n, round(n / total, 4) AS share, n / total >= 0.15 AS major FROM (
        SELECT lang, count(*) AS n, cast(sum(count(*)) OVER () AS double) AS total FROM {documents} GROUP BY lang) g""",
    "multilingual": """SELECT count(*) AS languages, sum(CASE WHEN share >= 0.15 THEN 1 ELSE 0 END) >= 2 AS is_multilingual FROM (
        SELECT count(*) / cast(sum(count(*)) OVER () AS double) AS share FROM {documents} GROUP BY lang) g""",
    # A8
    "homogeneity": """SELECT round(lang_part, 6) AS lang_part, round(size_part, 6) AS size_part, round(table_part, 6) AS table_part, round((lang_part + size_part + table_part) / 3, 6) AS homogeneity,
        CASE WHEN lang_part <= size_part AND lang_part <= table_part THEN 'language' WHEN size_part <= table_part THEN 'size' ELSE 'tables' END AS weakest FROM (
        SELECT max(share) AS lang_part, 1 - least(max(sd / mean), 1.0) AS size_part, max(2 * abs(tables - 0.5)) AS table_part FROM (
        SELECT count(*) / cast(sum(count(*)) OVER () AS double) AS share FROM {documents} GROUP BY lang) l
        CROSS JOIN (SELECT stddev_pop(length(text)) AS sd, avg(length(text)) AS mean, avg(CASE WHEN text LIKE '%|%' THEN $one ELSE $zero END) AS tables FROM {documents}) s) t""",
    # A9 / A12
    "length_statistics": """SELECT source, count(*) AS docs, min(n) AS shortest, $upper_median(n) AS upper_median, max(n) AS longest, round(avg(n), 4) AS mean,
        round(avg(CASE WHEN n < 300 THEN $one ELSE $zero END), 6) AS tiny_share FROM (SELECT source, length(text) AS n FROM {documents}) d GROUP BY source""",
    # A10
    "ner_coverage": "SELECT round(sum(least(length(text), 24000)) / cast(sum(length(text)) AS double), 6) AS coverage FROM {documents}",
    # C16
    "spread_windows": """SELECT doc_id, k, CASE WHEN n <= 24000 THEN text WHEN k = 0 THEN substring(text, 1, 8000) WHEN k = 1 THEN substring(text, cast(floor(n / 2) AS int) - 3999, 8000) ELSE substring(text, n - 7999, 8000) END AS piece
        FROM (SELECT doc_id, text, cast(length(text) AS int) AS n FROM {documents}) d JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) w ON w.k = 0 OR d.n > 24000""",
    # F6
    "usable_texts": "SELECT doc_id, length(trim(text)) AS n FROM {documents} WHERE length(trim(text)) > 200",
    # F7, parameters of a page of 3000 characters
    "sparse_pages": "SELECT doc_id, pages, $n_words(text) AS words FROM (SELECT doc_id, text, 1 + cast(floor(length(text) / 3000) AS int) AS pages FROM {documents}) d WHERE pages >= 3 AND $n_words(text) < 60 * pages",
    # A25, M7
    "judge_precision": """SELECT source, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS supported, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS distorted,
        sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS unjudged,
        round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) / cast(nullif(count(quality), 0) AS double), 6) AS precision_judged
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source""",
    # A23, A30
    "category_counts": """SELECT coalesce(event_type, '*') AS category, coalesce(status, '*') AS status, count(*) AS n FROM (
        SELECT event_type, CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'middle' ELSE 'low' END AS status FROM {events}) e GROUP BY GROUPING SETS ((event_type), (status), ())""",
    "matrix_recap": """SELECT coalesce(role, '*') AS role, count(*) AS rows_n, sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS blank FROM {conversations} GROUP BY ROLLUP (role)""",
    # SK3, U7
    "triple_upsert": """SELECT s, p, o, count(*) AS occurrences, count(DISTINCT src) AS sources FROM (
        SELECT concat('user ', cast(user_id AS $str)) AS s, event_type AS p, concat('day ', cast(extract(day FROM ts) AS $str)) AS o, event_id % 7 AS src FROM {events}) t GROUP BY s, p, o""",
    # SC14
    "graph_counts": """SELECT p, count(*) AS edges, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM (
        SELECT DISTINCT user_id AS s, event_type AS p, extract(day FROM ts) AS o FROM {events}) t GROUP BY p""",
    "graph_degree": "SELECT degree, count(*) AS nodes FROM (SELECT user_id, count(DISTINCT event_type) AS degree FROM {events} GROUP BY user_id) g GROUP BY degree",
    # U10
    "triple_rewrite": """SELECT DISTINCT a.n_name AS s, 'trades with' AS p, b.n_name AS o FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_name <> b.n_name""",
    # J5
    "child_parent": "SELECT r_name, count(*) AS children, min(n_name) AS first_child FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r_name",
    # J6
    "hit_dedupe": """SELECT o_custkey, max(o_totalprice) AS best, min(o_orderkey) AS first_order, count(*) AS hits FROM {orders} GROUP BY o_custkey""",
    # J7
    "first_seen_parent": """SELECT category, parent, first_order FROM (SELECT o_orderpriority AS category, o_custkey AS parent, o_orderkey AS first_order,
        row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS k FROM {orders}) t WHERE k = 1""",
    # J9
    "cache_misses": "SELECT d.doc_id, sha FROM (SELECT doc_id, sha1(text) AS sha FROM {documents}) d LEFT JOIN (SELECT DISTINCT sha1(text) AS done FROM {benchmark}) c ON d.sha = c.done WHERE c.done IS NULL",
    # J10
    "measure_override": """SELECT coalesce(m.k, b.k) AS name, coalesce(m.v, b.v) AS setting, m.k IS NOT NULL AS measured FROM (SELECT lang AS k, count(*) AS v FROM {documents} GROUP BY lang) b
        FULL OUTER JOIN (SELECT d.lang AS k, count(*) AS v FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 0 GROUP BY d.lang) m ON b.k = m.k""",
    # A24
    "coverage": """SELECT count(*) AS parents, count(o.c) AS reached, count(*) - count(o.c) AS missed, round(count(o.c) / cast(count(*) AS double), 6) AS share FROM {customer}
        LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM {orders}) o ON c_custkey = o.c""",
    "missed_parents": "SELECT c_custkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_custkey IS NULL",
    # U5
    "exact_dedupe": "SELECT sha, min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, sha1(lower(trim(text))) AS sha FROM {documents}) d GROUP BY sha",
    # A28, U11
    "run_summary": """SELECT event_type, count(*) AS runs, round(avg(m), 6) AS mean, round(min(m), 6) AS low, round(max(m), 6) AS high, round(max(m) - min(m), 6) AS spread, max(m) - min(m) <= 0.10 AS conclusive
        FROM (SELECT event_type, extract(day FROM ts) AS run, avg(CASE WHEN value >= 50 THEN $one ELSE $zero END) AS m FROM {events} GROUP BY event_type, extract(day FROM ts)) r GROUP BY event_type""",
    "always_missed": """SELECT user_id FROM {events} GROUP BY user_id HAVING max(value) < 200""",
    # F18
    "duration_outliers": "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id) AS low, count(*) OVER (PARTITION BY user_id) AS n FROM {events}) e WHERE n < 2 OR value <= 5 * low",
    # SA1
    "even_sample": """SELECT i, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM {documents}) d JOIN (SELECT DISTINCT item_id AS i, count(*) OVER () AS m FROM {benchmark}) s ON r = cast(floor(i * n / m) AS bigint) WHERE i < m""",
    # SA3
    "seeded_order": "SELECT doc_id, md5(concat('12345', cast(doc_id AS $str))) AS draw FROM {documents}",
    # C15
    "linear_windows": """SELECT doc_id, count(*) AS windows, sum(least(1400, n - 1200 * k)) AS chars FROM (SELECT doc_id, length(text) AS n, explode(sequence(0, cast(floor((length(text) - 1) / 1200) AS int))) AS k FROM {documents} WHERE length(text) > 0) w GROUP BY doc_id""",
    # C17: how many excerpts a document gives, and their characters
    "question_excerpts": """SELECT doc_id, stride, count(*) AS excerpts, sum(length(substring(text, start_at + 1, 1800))) AS chars FROM (SELECT doc_id, text, greatest(1800, cast(floor(length(text) / 6) AS int)) AS stride, explode(sequence(0, cast(length(text) AS int) - 1801, greatest(1800, cast(floor(length(text) / 6) AS int)))) AS start_at
        FROM {documents} WHERE length(text) > 1800) e GROUP BY doc_id, stride""",
    # C17 in full: an excerpt at every stride
    "question_excerpts_all": """SELECT doc_id, start_at, substring(text, start_at + 1, 1800) AS excerpt FROM (SELECT doc_id, text, explode(sequence(0, cast(length(text) AS int) - 1801, greatest(1800, cast(floor(length(text) / 6) AS int)))) AS start_at FROM {documents} WHERE length(text) > 1800) e""",
    # C19
    "triple_groups": """SELECT concat('G', cast(1 + cast(floor((k - 1) / 25) AS int) AS $str)) AS label, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM {events}) e GROUP BY cast(floor((k - 1) / 25) AS int)""",
    # S2
    "answer_forms": "SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS form FROM {benchmark}",
    # J3, F14
    "answer_documents": "SELECT item_id, doc_id FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)",
    # X1, X2, X4 with the corpus as its own probe
    "router_decision": """SELECT words, words < 15000 AS gated, round(kag, 6) AS kag_score, round(100 - kag, 6) AS rag_score, CASE WHEN words < 15000 OR kag < 50 THEN 'RAG' ELSE 'KAG' END AS choice_frozen, CASE WHEN words < 15000 OR kag < 80 THEN 'RAG' ELSE 'KAG' END AS choice_live
        FROM (SELECT words, 100 * (0.45 * rel / (rel + 8) + 0.35 * crossed / (crossed + 0.25) + 0.20 * reuse / (reuse + 0.30)) * (0.4 + 0.6 * least(words / 100000.0, 1.0)) AS kag FROM (
        SELECT words, 1000 * dots / (words * 1.3) AS rel, copies / cast(docs AS double) AS crossed, tables / cast(docs AS double) AS reuse FROM (
        SELECT count(*) AS docs, cast(sum($n_words(text)) AS double) AS words, cast(sum(length(text) - length(replace(text, '.', ''))) AS double) AS dots, count(*) - count(DISTINCT text) AS copies, sum(CASE WHEN text LIKE '%|%' THEN 1 ELSE 0 END) AS tables FROM {documents}) a) b) c""",
    # X6
    "chunk_candidates": """SELECT strategy, size_chars FROM (SELECT CASE WHEN m >= 400 THEN least(greatest(m, 600), 2400) ELSE 1400 END AS base FROM (SELECT $upper_median(n) AS m FROM (SELECT length(text) AS n FROM {documents}) d) e) b
        JOIN (SELECT 'fixed' AS strategy, 1 AS f UNION ALL SELECT 'structural', 1 UNION ALL SELECT 'semantic', 1) s ON true CROSS JOIN (SELECT 0 AS z) z CROSS JOIN LATERAL (SELECT base AS size_chars) l""",
    # X18
    "cost_estimate": "SELECT chunks, chunks * 79 AS kag_seconds, CASE WHEN chunks * 79 < 60 THEN 's' WHEN chunks * 79 < 3600 THEN 'min' ELSE 'h' END AS unit FROM (SELECT cast(ceil(sum(length(text)) / 3679.0) AS bigint) AS chunks FROM {documents}) d",
    # X9, X10
    "measured_choice": """SELECT lang, score, CASE WHEN best - score <= 0.03 THEN 'near best' ELSE 'behind' END AS standing, row_number() OVER (ORDER BY score DESC, lang) AS place FROM (
        SELECT lang, score, max(score) OVER () AS best FROM (SELECT lang, round(avg(CASE WHEN length(text) BETWEEN 700 AND 2100 THEN $one ELSE $zero END), 6) AS score FROM {documents} GROUP BY lang) g) h""",
    # A14, A15 on whole texts
    "integrity_score": "SELECT lang, round(avg(CASE WHEN text LIKE '%.' OR text LIKE '%!' OR text LIKE '%?' OR text LIKE '%|%' THEN $one ELSE $zero END), 6) AS integrity, round(avg(CASE WHEN regexp_like(lower(text), '^(it|this|they|that|il|elle|ce|er|sie|es) ') THEN $zero ELSE $one END), 6) AS self_contained FROM {documents} GROUP BY lang",
    # A13
    "size_score": "SELECT round(avg(CASE WHEN length(text) >= 0.5 * 1400 AND length(text) <= 1.5 * 1400 THEN $one ELSE $zero END), 6) AS size_score FROM {documents}",
    # A3, A5, A7 on capitalised-word mentions (M4 stand-in), F5
    "top_entities": """SELECT name, mentions, docs FROM (SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM {mentions} m GROUP BY name) g WHERE mentions >= 2 ORDER BY mentions DESC, name LIMIT 25""",
    "connectivity": """SELECT count(*) AS entities, sum(CASE WHEN docs >= 2 THEN 1 ELSE 0 END) AS in_two, round(avg(CASE WHEN docs >= 2 THEN $one ELSE $zero END), 6) AS share FROM (SELECT name, count(DISTINCT doc_id) AS docs, count(*) AS n FROM {mentions} m GROUP BY name) g WHERE n >= 2""",
    "filter_statistics": """SELECT count(*) AS raw_names, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS singletons, round(avg(CASE WHEN n = 1 THEN $one ELSE $zero END), 6) AS rejected FROM (SELECT name, count(*) AS n FROM {mentions} m GROUP BY name) g""",
}

#: Columns that are 64-bit integers in both dialects.
WIDE = {
    "corpus_profile": ["words", "chars"], "length_statistics": ["shortest", "upper_median", "longest"], "usable_texts": ["n"], "sparse_pages": ["words"],
    "judge_precision": ["supported", "distorted", "missing", "unjudged"], "matrix_recap": ["blank"], "linear_windows": ["chars"], "chunk_candidates": ["size_chars"],
    "measured_choice": ["place"], "connectivity": ["in_two"], "filter_statistics": ["kept", "singletons"], "noise_lines": ["noise"], "table_lines": ["widest"], "section_carry": ["section"],
}
