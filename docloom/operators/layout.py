"""Page layout, name resolution and evidence operators, each one relational text in both dialects. Order lines stand in for the words of
pages: the order is the page, the line its height, the part the place in the line, the quantity the font size."""

_WORDS = """SELECT l_orderkey AS page, cast(l_linenumber * 2 AS double) AS top, l_partkey * 100 + l_linenumber * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS x0, concat(l_linestatus, cast(l_partkey AS $str)) AS word, cast(l_quantity AS double) AS size, l_returnflag AS flag FROM {lineitem}"""
_GAINS = "SELECT cut, avg(CASE WHEN b <= cut THEN $one ELSE $zero END) - avg(CASE WHEN a <= cut THEN $one ELSE $zero END) AS gain FROM (SELECT o_orderkey % 20 + 1 AS a, o_custkey % 20 + 1 AS b FROM {orders}) r CROSS JOIN (SELECT 3 AS cut UNION ALL SELECT 5 UNION ALL SELECT 10) c GROUP BY cut"

TEXTS = {
    # SC5: words of one height, rounded to a third, make a line
    "page_lines": f"SELECT page, line_no, $join(word, x0) AS line, max(size) AS size FROM (SELECT page, cast(floor(top / 3 + 0.5) AS int) AS line_no, word, x0, size FROM ({_WORDS}) w) v GROUP BY page, line_no",
    # SC6: the font size, to half points, of most characters
    "body_font": f"""SELECT page, size FROM (SELECT page, size, row_number() OVER (PARTITION BY page ORDER BY chars DESC, size) AS k FROM (
        SELECT page, size, sum(length(word)) AS chars FROM (SELECT page, floor(size * 2 + 0.5) / cast(2 AS double) AS size, word FROM ({_WORDS}) w) v GROUP BY page, size) s) r WHERE k = 1""",
    # SC7: larger, short lines without a full stop are titles and open a section
    "page_sections": f"""SELECT page, section, count(*) AS lines FROM (SELECT page, line_no, sum(title) OVER (PARTITION BY page ORDER BY line_no) AS section FROM (
        SELECT page, line_no, CASE WHEN size >= 1.12 * avg(size) OVER (PARTITION BY page) AND length(line) <= 120 AND line NOT LIKE '%.' THEN 1 ELSE 0 END AS title FROM (
        SELECT page, cast(floor(top / 3 + 0.5) AS int) AS line_no, $join(word, x0) AS line, max(size) AS size FROM ({_WORDS}) w GROUP BY page, cast(floor(top / 3 + 0.5) AS int)) l) t) s GROUP BY page, section""",
    # SC9: cells of a row joined, line breaks as spaces, blank rows dropped
    "table_texts": "SELECT c_custkey, row_text FROM (SELECT c_custkey, concat_ws(' | ', replace(c_name, '\n', ' '), replace(c_mktsegment, '\n', ' ')) AS row_text FROM {customer}) c WHERE trim(replace(row_text, '|', '')) <> ''",
    # SC10, J12: words inside a table's box, two points wider, are dropped
    "outside_boxes": f"""SELECT w.page, count(*) AS words, max(w.top) AS lowest FROM ({_WORDS}) w LEFT JOIN (SELECT page AS box_page, min(top) AS top0, max(top) AS top1, min(x0) AS left0, max(x0) AS left1 FROM ({_WORDS}) t WHERE flag = 'R' GROUP BY page) b
        ON w.page = b.box_page AND w.top >= b.top0 - 2 AND w.top <= b.top1 + 2 AND w.x0 >= b.left0 - 2 AND w.x0 <= b.left1 + 2 WHERE b.box_page IS NULL GROUP BY w.page""",
    # Mentions under the representative of their aliases
    "alias_mentions": """SELECT rep, count(*) AS mentions FROM (SELECT lower(name) AS canon FROM {mentions} m) c JOIN (
        SELECT canon, min(canon) OVER (PARTITION BY substring(canon, 1, 5)) AS rep FROM (SELECT DISTINCT lower(name) AS canon FROM {mentions} n) d) a ON c.canon = a.canon GROUP BY rep""",
    # Entities and the documents with them as whole words, by equality of words
    "entity_documents": """SELECT e.name, count(*) AS docs FROM (SELECT name FROM {mentions} m GROUP BY name HAVING count(*) >= 2) e JOIN (SELECT DISTINCT doc_id, word FROM {words} w) d ON e.name = d.word GROUP BY e.name""",
    # Score without a probe, of degree and connectivity
    "fallback_router": """SELECT round(100 * (0.5 * degree / (degree + 3) + 0.5 * joined / (joined + 0.30)), 6) AS score FROM (SELECT avg(cast(types AS double)) AS degree, avg(CASE WHEN types >= 2 THEN $one ELSE $zero END) AS joined FROM (
        SELECT user_id, count(DISTINCT event_type) AS types FROM {events} GROUP BY user_id) g) s""",
    # X11: evidence by level
    "evidence_levels": """SELECT level, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'assumed' WHEN toxic = 1 THEN 'refuted' WHEN n_chars >= 2000 THEN 'measured' WHEN n_chars >= 300 THEN 'calculated' ELSE 'observed' END AS level
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) e GROUP BY level""",
    # The cut of the best gain, and whether the gain is worth it
    "reranker_choice": f"SELECT cut, round(gain, 6) AS gain, gain >= 0.03 AS useful FROM (SELECT cut, gain, row_number() OVER (ORDER BY gain DESC, cut) AS k FROM ({_GAINS}) g) r WHERE k = 1",
    # A measurement holds while the count of chunks stays near
    "measure_freshness": """SELECT lang, measured, chunks, abs(chunks - measured) <= greatest(5, measured * cast(0.1 AS double)) AS fresh FROM (SELECT lang, sum(CASE WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END) AS measured, count(*) AS chunks FROM {documents} GROUP BY lang) m""",
    # A list of evidence as one row of settings
    "settings_row": "SELECT max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'de' THEN n END) AS de, max(CASE WHEN lang = 'fr' THEN n END) AS fr, max(CASE WHEN lang = 'es' THEN n END) AS es FROM (SELECT lang, count(*) AS n FROM {documents} GROUP BY lang) l",
    # Predicates constrain the extraction only if there are ten; the fifteen commonest are listed
    "ontology_gate": "SELECT p_type, n, total >= 10 AS constrained FROM (SELECT p_type, n, count(*) OVER () AS total, row_number() OVER (ORDER BY n DESC, p_type) AS k FROM (SELECT p_type, count(*) AS n FROM {part} GROUP BY p_type) g) r WHERE k <= 15",
    # Whether a whole source fits the context window
    "context_gate": """SELECT source, tokens, tokens <= 21299 AS fits, tokens > 14909 AND tokens <= 21299 AS tight FROM (SELECT source, cast(floor(sum($n_words(text)) * cast(1.3 AS double)) AS bigint) AS tokens FROM {documents} GROUP BY source) s""",
    # SK7: the counts of a compliance sheet
    "compliance_summary": """SELECT event_type, status, n, round(100 * n / cast(sum(n) OVER (PARTITION BY event_type) AS double), 4) AS percent_of FROM (
        SELECT event_type, CASE WHEN value >= 100 THEN 'yes' WHEN value >= 10 THEN 'partly' ELSE 'no' END AS status, count(*) AS n FROM {events} GROUP BY event_type, CASE WHEN value >= 100 THEN 'yes' WHEN value >= 10 THEN 'partly' ELSE 'no' END) e""",
}

#: Columns that are 64-bit integers in both dialects.
WIDE = {"page_sections": ["section"], "measure_freshness": ["measured"]}
