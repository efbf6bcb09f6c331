"""The queries of this subpackage over the whole tables of a folder."""

from __future__ import annotations

import public_tokenizers

from docloom.llm import decontam, langid, language, licenses, negatives, packing, pages, quality, repeats, simhash, surrogates, tries, vectors


def _table(spark, at, name):
    return spark.read.parquet(f"{at}/{name}.parquet")


def op1_repeats(spark, at):
    return repeats.removed(_table(spark, at, "documents")).drop("kept")


def op2_packing(spark, at):
    return packing.pack(_table(spark, at, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_quality(spark, at):
    return quality.scores(_table(spark, at, "documents"), _table(spark, at, "labels"))


def op4_simhash(spark, at):
    return simhash.near_duplicates(_table(spark, at, "documents")).drop("text_hash", "part")


def op5_decontamination(spark, at):
    return decontam.contamination(_table(spark, at, "documents"), _table(spark, at, "benchmark")).drop("longest", "spans")


def op6_surrogates(spark, at):
    return surrogates.protected(_table(spark, at, "documents"), surrogates.session_key(spark))


def op7_vectors(spark, at):
    return vectors.near_duplicates(_table(spark, at, "embeddings"))


def op8_pages(spark, at):
    return pages.main_text(_table(spark, at, "pages"))


def op9_language(spark, at):
    return language.scores(_table(spark, at, "documents"))


def op10_licenses(spark, at):
    return licenses.scans(_table(spark, at, "documents"))


def op11_language_id(spark, at):
    return langid.predictions(_table(spark, at, "documents"))


def op12_hard_negatives(spark, at):
    return negatives.mined(_table(spark, at, "embeddings"), shift=(7, 10))


def op13_prefix_trie(spark, at):
    return tries.prefix_trie(*tries.placed(_table(spark, at, "conversations"), graft=20))


def pipeline(spark, at):
    import corpus_pipeline

    return corpus_pipeline.run(spark, at)


def queries():
    return {"pipeline": pipeline} | {k: v for k, v in globals().items() if k.startswith("op")}


#: The operators whose whole contract SQL can say; the others are tested against plain Python.
_REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) x),
    low AS (SELECT k, min(doc_id) AS least_id FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
    gone AS (SELECT DISTINCT win.doc_id, win.i + r.o AS p FROM win JOIN low ON low.k = win.k AND low.least_id < win.doc_id, range(13) AS r(o)),
    word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d)
    SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(s.gone, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN
    (SELECT word.doc_id, count(gone.p) AS gone, string_agg(CASE WHEN gone.p IS NULL THEN t END, ' ' ORDER BY word.p) AS kept FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id) s ON s.doc_id = d.doc_id"""
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), b AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT item, w, least(8, len(w)) AS k, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) x),
    own AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) ks) x),
    hit AS (SELECT own.doc_id, own.i, own.k, win.item FROM own JOIN win ON win.t = own.t AND win.k = own.k),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit) h) q GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) h GROUP BY doc_id)
    SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(m.n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""
_VECTORS = """WITH RECURSIVE link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[])) BETWEEN 0.93 AND 1.1),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
    SELECT e.vec_id, coalesce(l.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = e.vec_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id"""

_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * v.q[i])) AS bigint) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) x WHERE k <= 5),
    n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, cast(rank AS int) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
#: crc32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_concat([cast(4294967295 AS bigint)], list_transform(regexp_extract_all(cast(c AS varchar), '.'), lambda s: cast(ascii(s) AS bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], cast(range(8) AS bigint[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, cast(3988292384 AS bigint)) ELSE x // 2 END)), cast(4294967295 AS bigint))"
_TRIE = rf"""WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT c, s, {_CRC} % 4 AS h FROM own), new AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
    part AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM new), node AS (SELECT d, s[1:d] AS k, min(c) AS id, count(*) AS n, coalesce(string_agg(cast(c AS varchar), ',' ORDER BY c) FILTER (WHERE len(s) = d), '') AS ends FROM part GROUP BY ALL),
    kid AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
    full_node AS (SELECT node.*, coalesce(kid.n, 0) AS kids, CASE WHEN node.d > 0 THEN (node.n - 1) * len(regexp_extract_all(node.k[node.d].t, '[^ 	-]+')) ELSE 0 END AS saved FROM node LEFT JOIN kid ON kid.d = node.d AND kid.k = node.k),
    up AS (SELECT e AS d, k[1:e] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_node) x GROUP BY ALL)
    SELECT f.id AS conv_id, cast(f.d AS bigint) AS depth, p.id AS parent_conv_id, f.n AS n_convs, cast(f.kids AS bigint) AS n_children, cast(up.leaves AS bigint) AS n_leaves, cast(up.saved AS bigint) AS saved_tokens, sha256(f.ends) AS ends_sha256
    FROM full_node f JOIN up ON up.d = f.d AND up.k = f.k LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]"""


def oracle_sql():
    return {"op1_repeats": _REPEATS, "op5_decontamination": _LEAKS, "op7_vectors": _VECTORS, "op12_hard_negatives": _NEGATIVES, "op13_prefix_trie": _TRIE}
