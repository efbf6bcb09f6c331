import collections
import html
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import decontam, language, licenses, packing, pages, quality, repeats, simhash, surrogates, vectors

NAN = float("nan")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_language_base_score(spark):
    rows = [(i, None if i == 3 else " ".join("The a b,c é the".split()[: 1 + i % 6]) + f" w{i % 7} rare{i}") for i in range(40)] + [(40, "")]
    got = {r.doc_id: r for r in language.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    count = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), "</s>"])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        toks = [*words(t), "</s>"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(x in count for x in toks), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks))
        assert r.score < 0


def test_language_rare_tokens_through_buckets(spark, monkeypatch):
    monkeypatch.setattr(language, "TOP", 2)
    test_language_base_score(spark)


def test_language_commonest_tokens_are_cut_in_one_level():
    n = np.array([1, 5, (1 << 20) - 1, 1 << 20, 1 << 21, 1 << 40])
    at = language.level(n)
    assert (np.diff(at) > 0).all() and language.level(np.array([1 << 60]))[0] < (1 << 20) + 50_000
    assert language.cut([(9, 2), (7, 3), (1, 10)], 5) == (7, 1, 0)
    least, tied, below = language.cut([(1 << 21, 1000), (1, 5)], 400)
    assert least > tied == 1 << 21 and below == int((1 << 64) * 0.4)
    h = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert abs((language.W.mix(h) < np.uint64(below)).mean() - 0.4) < 0.01


def test_language_keeps_a_model_where_all_counts_tie(spark, monkeypatch):
    monkeypatch.setattr(language, "TOP", 50)
    rows = [(i, " ".join(f"a{(i * 7 + k) % 100} b{(i * 7 + k) % 100}" for k in range(100))) for i in range(300)]
    got = [r for r in language.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 30 and sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.05


def test_language_rows_of_one_id(spark):
    rows = [(1, "a b", 1.0), (1, "c", 2.0), (None, "a", 3.0), (None, None, 4.0)]
    got = language.scores(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.train_tokens) for r in got) == [("1", 2, 8), ("1", 3, 8), ("None", 1, 8), ("None", 2, 8)]


def test_simhash_against_all_pairs(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base.replace("w7 ", f"x{i} ") if i % 3 else base) for i in range(30)] + [(30 + i, f"other text {i} " * 9) for i in range(10)] + [(50, None), (51, ""), (52, "A b"), (53, "a\tB")]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {}
    for i, t in rows:
        w = words(t)
        grams = [" ".join(w)] * bool(w) if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    low = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    low[i] = min(low[i], low[j])
    assert got == {i: (prints[i], low[i]) for i in prints}


@pytest.mark.parametrize("most,shared,lead,words,short", [(3, 5, 2, 1, 64), (3, 5, 2, 1, 4), (5, 3, 1, 1, 4), (5, 3, 1, 3, 4), (5, 3, 2, 2, 64)])
def test_simhash_index_misses_no_pair(monkeypatch, most, shared, lead, words, short):
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, (40, words)).astype(np.uint64).repeat(8, 0)
    for i in range(len(f)):
        for _ in range(i % 8):
            f[i, rng.integers(words)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    f = np.unique(f, axis=0)
    choices, rows = simhash._choices(shared, lead), []
    b = f.astype(">u8").view(np.uint8).reshape(len(f), -1)
    for n, (w, c) in enumerate((w, c) for w in range(words) for c in choices):
        rows += [((n, *b[i, [8 * w + p for p in c]].tolist()), i) for i in range(len(f))]
    number = {k: i for i, k in enumerate(sorted({k for k, _ in rows}))}
    at = np.array([i for _, i in rows])
    x, y = simhash._refined(np.array([k[0] for k, _ in rows]), np.array([number[k] for k, _ in rows]), f[at], shared, lead, most)
    a, r = simhash.forest(at[x], at[y], len(f))
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= most
    near &= ((b[:, None] == b[None]).reshape(len(f), len(f), words, 8).sum(3) >= shared).any(2)
    want = simhash.forest(*np.nonzero(np.triu(near, 1)), len(f))
    assert dict(zip(a.tolist(), r.tolist())) == dict(zip(*(z.tolist() for z in want))) and len(a) > 100
    if (most, shared) == (3, 5):
        assert (near == (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= most)).all()


def test_simhash_of_five_words_finds_jaccard_of_eight_tenths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(150):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((2 * k, " ".join(w)))
        for x in rng.choice(200, 3, replace=False):
            w[x] = f"other{x}"
        rows.append((2 * k + 1, " ".join(w)))
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=4, most=48, shared=3, lead=1).collect()
    low = {r.doc_id: r.component_id for r in out}
    assert sum(low[2 * k + 1] == 2 * k for k in range(150)) >= 135 and all(low[2 * k] == 2 * k for k in range(150))


def test_decontamination_against_windows():
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(12)}"
    items = [(str(i), " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 7, 8, 9, 20, 20, 30])] + [("x", None), ("dup", "w1 w2 w3")]
    auto = decontam.Automaton([(i, decontam.item_words(t)) for i, t in items])
    texts = [None, "", "...", *(" ".join(word() for _ in range(40)) + "! " + (items[rng.integers(9)][1] or "").upper() for _ in range(40))]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for t, (n, hit, found, *_) in zip(texts, decontam.scan_texts(auto, texts)):
        w, cover, ids = low(t), set(), set()
        for i, x in items:
            x = low(x)
            k = min(8, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        cover |= set(range(b, b + k))
                        ids.add(i)
        assert (n, hit, found) == (len(w), len(cover), ids)


def test_decontamination_over_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(9)}"
    items = [(i // 2, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 8, 9, 20, 20, 30, 12, 2])] + [(None, "no id at all"), (7, None)]
    docs = [(i, " ".join(word() for _ in range(60)) if i % 3 else "plain text, no id at all " * (i % 5), 5, 1, "s") for i in range(40)] + [(None, None, 0, 1, None), (3, "", 0, 1, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, n_hit int, spans string"), spark.createDataFrame(items, "item_id long, text string")
    one = [sorted(map(repr, x.collect())) for x in (decontam.contamination(d, i), decontam.decontaminate(d, i))]
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 10)
    monkeypatch.setattr(decontam, "PASS_WORDS", 25)
    many = [sorted(map(repr, x.collect())) for x in (decontam.contamination(d, i), decontam.decontaminate(d, i))]
    assert one == many and len(list(decontam.loads(i, "item_id", "text", 8))) > 2
    assert all(r.n_hit and not r.n_items for r in decontam.contamination(d, i).collect() if r.doc_id and r.doc_id % 15 == 3 and r.n_words > 5)


def test_packing_round_trip(spark):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(i, "word né " * (i * 7 % 900)) for i in range(60)] + [(60, None), (61, ""), (62, "<|endoftext|>")]
    bins = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), ranks).collect():
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= 1024
    for i, t in rows:
        ids = packing.encode(t, ranks)
        ps = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(p.length for p in ps) == len(ids) and (len(ps) == 1 or len(ids) > 1024)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in ps)


def test_packing_fills_bins_and_deals_equal_rows(spark, monkeypatch):
    import public_tokenizers

    sizes = np.random.default_rng(3).integers(1, 700, 4000)
    where, offset = packing.place(sizes)
    load = np.bincount(where, sizes)
    assert load.max() <= packing.CAPACITY and len(load) <= 1.01 * -(-sizes.sum() // packing.CAPACITY)
    best = []
    for s in sorted(sizes[:300].tolist(), reverse=True):  # the same rule, by trying each open bin
        gaps = collections.Counter(g for g in best if g)
        cost = {g: sum(n * n for n in (gaps - collections.Counter([g]) + collections.Counter([g - s] if g > s else [])).values()) for g in gaps if g >= s}
        g = min(cost, key=lambda g: (cost[g], g)) if cost else packing.CAPACITY
        best.remove(g) if cost else None
        best.append(g - s)
    assert sorted(best) == sorted((packing.CAPACITY - np.bincount(packing.place(sizes[:300])[0], sizes[:300])).astype(int).tolist())
    monkeypatch.setattr(packing, "GROUP", 50)
    out = packing.pack(spark.createDataFrame([(None, None, 1, 2)] * 1000, "doc_id long, text string, g int, again int"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(out) == 1000 and max(collections.Counter(r.sequence_id >> 40 for r in out).values()) < 300


def test_quality_machine_against_all_pairs():
    rng = np.random.default_rng(2)
    x, m = rng.normal(size=(5, 9)), {"w0": np.array([0.3]), "w": rng.normal(size=9), "v": rng.normal(size=(9, 4))}
    for row, got in zip(x, quality.machine(x, m)):
        z = 0.3 + sum(row * m["w"]) + sum(m["v"][i] @ m["v"][j] * row[i] * row[j] for i in range(9) for j in range(i))
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_collects_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} of many", 1) for i in range(400)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i in range(4) for q in (0, 1)], "doc_id long, quality int, toxic int")
    assert quality.scores(docs, labels).count() == 400


def test_quality_learns_and_handles_nulls(spark):
    docs = [(i, ("BUY!! NOW!! " if i % 4 == 0 else "plain words of a text ") * (3 + i % 5)) for i in range(200)] + [(200, None), (201, "")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)]
    out = quality.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.predicted == (r.doc_id % 4 != 0) for r in out if r.held_out and r.doc_id < 200)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16) * (0.12 if i % 2 else 0.8)], i % 2) for i in range(300)]
    rows += [(300 + i, rows[1][1], 1) for i in range(4)]
    bad = [(400, None, 1), (401, [0.0] * 16, 1), (402, [NAN] * 16, 1), (403, rows[1][1], None), (404, [], 1), (405, [None] * 16, 1)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()}
    x = vectors.unit([r[1] for r in rows])
    ok = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    want = ok.sum(1) - 1
    have = np.array([got[r[0]].n_links for r in rows])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum() and len(got) == len(rows) + len(bad)
    assert all((got[b[0]].n_links, got[b[0]].component_id, got[b[0]].kept) == (0, b[0], True) for b in bad)


def test_vectors_without_id_and_with_repeated_ids(spark):
    a, b, lone = [1.0, 0.0, 0.1], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a, 1, 5, "x"), (7, b, 1, 5, "x"), (7, None, 1, 5, "x"), (9, lone, 1, 5, "x"), (9, a, 1, 5, "x"), (9, a, 1, 5, "x"), (None, lone, 2, 5, "x"), (None, None, 2, 5, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id int, kept string")
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, 7, False), (7, 3, 7, True), (7, 0, 7, True), (9, 0, 9, True), (9, 3, 7, False), (9, 3, 7, False), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_vector_passes_grow_and_windows_cross_partitions(spark, monkeypatch):
    assert vectors.passes(1000, 0.93) == vectors.LEAST_PASSES < vectors.passes(10**6, 0.93) < vectors.passes(10**8, 0.93)
    monkeypatch.setattr(vectors, "LEAST_PASSES", 1)
    monkeypatch.setattr(vectors, "passes", lambda *_: 1)
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=(40, 6)) * 0.04, axis=0) + 1
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = {r.vec_id: r.component_id for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    u = vectors.unit(x)
    a, b = simhash.forest(*np.nonzero(np.triu(u @ u.T >= 0.93, 1)), len(x))
    want = np.arange(len(x))
    want[a] = b
    r = np.random.default_rng(1000).normal(size=(6, vectors.BITS))
    assert got == dict(enumerate(want.tolist())) and len({tuple(k) for k in (u @ r > 0).tolist()}) > 2


@pytest.fixture(scope="module")
def labeller():
    return pages.train()


def test_pages(labeller):
    page = '<!DOCTYPE html><head><title>t</title></head><body><nav><ul><li>Home<li>About</ul></nav><div class="cookie">We use cookies</div><main><article><h1>A &amp; B</h1><p>First  line<br>of the text with words<p>Second <b>bold</b> text that is longer than the first<script>x="</p>"</script></article></main><section class="comments"><p>Nice post I like it</p></section><form><input><p>Subscribe</p></form><aside>Related</aside><footer>&copy; me</footer></body>'
    text, *empty = pages.extract_all(labeller, [page, None, "", "<p"])
    assert text.split("\n") == ["A & B", "First line", "of the text with words", "Second bold text that is longer than the first"]
    assert empty[:2] == ["", ""]
    assert html.unescape("&eacute;") == "é"


def test_pages_without_telling_names(labeller):
    one = "<body><div>We use cookies to improve your experience. Accept</div><div><h1>A walk in the hills</h1><p>The path climbed slowly from the village and we met nobody on the way up, which suited us.</p><p>At noon the fog lifted. We ate bread and cheese.</p></div><div><p>Anna: Great post, thanks for sharing!</p><p>Tom: I agree, love this</p></div><div class=rail><h3>More stories</h3><a href=x>You may also like this one</a></div><footer>(c) 2020</footer></body>"
    two = "<div id=top><a href=/>Home</a> <a href=/a>About us</a></div><div class=post><h2>Title of the story</h2>Text of it stands here without a paragraph, and it goes on for a while until it ends.<br>Second line of it.</div><div><a href=1>Share</a> <a href=2>Tweet</a></div><div>Subscribe to our newsletter. Enter your email</div>"
    a, b = pages.extract_all(labeller, [one, two])
    assert a.split("\n") == ["A walk in the hills", "The path climbed slowly from the village and we met nobody on the way up, which suited us.", "At noon the fog lifted. We ate bread and cheese."]
    assert b.split("\n") == ["Title of the story", "Text of it stands here without a paragraph, and it goes on for a while until it ends.", "Second line of it."]


def test_pages_read_all_words_of_a_block():
    long = " ".join(f"w{i}" for i in range(5000))
    x = pages.vectors([((("p",),), long, 0.0), ((("p",),), long + " cookies", 0.0)])
    assert (x[0] != x[1]).any() and (x[:, pages.PLACES :] > 0).sum(1).min() > 100


def test_pages_against_the_articles_of_the_table(spark, labeller):
    got = {r.page_id: r for r in pages.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), labeller).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.split(r"<(?:/?p|/?h1|br)[^>]*>", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")])
        lines = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in body]
        want = "\n".join(x for x in lines if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_table_with_nulls_repeats_and_long_pages(spark, labeller):
    art = "<body><nav>Home</nav><article>" + "<p>Some words of a text that goes on, and on.</p>" * 3 + "</article></body>"
    long = "<body><article>" + "<p>Some words of a text that goes on, and on.</p>" * 20_000 + "</article></body>"
    big = (1 << 62) + 1
    rows = [(big, "u", art, "a", 7), (None, "v", art, "b", 7), (None, None, None, None, None), (3, "", "", "c", 7), (3, "w", long, "d", 7), (big, "u", art, "a", 7)]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), labeller).collect()
    line = "Some words of a text that goes on, and on."
    want = [(big, "u", 3), (None, "v", 3), (None, None, 0), (3, "", 0), (3, "w", 20_000), (big, "u", 3)]
    assert sorted(((r.page_id, r.url, r.text) for r in out), key=str) == sorted(((i, u, "\n".join([line] * n)) for i, u, n in want), key=str)
    assert all(r.n_chars == len(r.text) for r in out)


def test_licenses():
    assert licenses.scan("x y.\nReleased under the MIT License.")[0] == ["MIT"]
    assert licenses.scan("Licensed under the Apache License, Version 2.0.")[0] == ["Apache-2.0"]
    assert licenses.scan("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.")[0] == ["GPL-3.0", "CC-BY-NC-4.0"]
    assert licenses.scan("SPDX-License-Identifier: MPL-2.0")[0] == ["MPL-2.0"]
    assert licenses.scan("driving licence") == ([], []) and licenses.scan(None) == ([], []) and licenses.scan("") == ([], [])


def test_surrogates():
    text = 'Mail bo@mail.example.com or Frau Anna Meyer, +1 (212) 555-1234, card 4111 1111 1111 1111, 10.0.0.7, bo@mail.example.com; token = "' + "ab12" * 10 + '"'
    new, places = surrogates.replace(text, b"k")
    assert [k for k, *_ in places] == ["email", "name", "phone", "card", "ip", "email", "secret"]
    assert places[0][2] == places[5][2] and all(e != s and e not in new and len(s) >= 7 for _, e, s in places)
    assert places[1][2].split(" ")[:1] == ["Frau"] and places[1][2].split(" ")[1] in surrogates.FEMALE
    assert surrogates._luhn(re.sub(r"\D", "", places[3][2])) == 0
    assert surrogates.replace(None, b"k") == (None, []) and surrogates.replace("", b"k") == ("", [])
    assert {surrogates.permute(i, [5, 21], b"k", "t") for i in range(105)} == set(range(105))
    assert all(surrogates.permute(surrogates.permute(i, [5, 21], b"k", "t"), [5, 21], b"k", "t", True) == i for i in range(105))
    assert {surrogates.onward(i, [5, 21], b"k", "t") for i in range(105)} == set(range(105)) and all(surrogates.onward(i, [5, 21], b"k", "t") != i for i in range(105))
    a, b = surrogates.replace("a 4111111111111111 b", b"k"), surrogates.replace("a 4111111111111111 b", b"other")
    assert a != b and surrogates.replace("a 4111111111111112 b", b"k")[1] == []


def test_surrogates_of_one_entity_and_of_alike_ones():
    one = lambda t: [s for *_, s in surrogates.replace(t, b"k")[1]]
    a, b = one("host 10.0.0.1 and 10.0.0.01")
    assert a == b
    a, b = one("+1 555 123 4567 and +15551234567")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and a.startswith("+1 ") and b.startswith("+1")
    a, b = one("Mr John Smith and Mr Secna Smith")
    assert a != b and a.split()[1] in surrogates.MALE and b.split()[1] not in surrogates._POOL and a.split()[2] == b.split()[2] != "Smith"
    a, b, c = one("John Smith wrote to Mary Jones. Smith left.")
    assert a.split()[0] in surrogates.MALE and b.split()[0] in surrogates.FEMALE and c == a.split()[1]
    a, b, c = one("born on 12 March 1987; DOB: 1987-03-12; born 03/25/2001; on 1 May 1990")
    assert a.split()[2] == b[:4] and re.fullmatch(r"\d\d/\d\d/\d{4}", c)
    assert [k for k, *_ in surrogates.replace("He lives at 12 Oak Hill Road, Hauptstraße 12, 5 rue de la Paix, Calle Mayor 7.", b"k")[1]] == ["address"] * 4
    (iban,) = one("DE89 3704 0044 0532 0130 00")
    assert surrogates._iban_check("DE", iban.replace(" ", "")[4:]) == int(iban[2:4]) and one("DE88 3704 0044 0532 0130 00") == []
    assert re.fullmatch("[А-Я][а-я]+ [А-Я][а-я]+", one("Иван Петров пришёл")[0])
    assert surrogates.replace("DOB: 31.02.1999", b"k")[1][0][0] == "birth"
    words = [x for p in surrogates.POOLS.values() for x in p] + [f"{a}{b}{c}" for a in "BCDF" for b in "aeiou" for c in "lmnr"] + ["Al", "Xi", "Bo"]
    assert len({surrogates.word(w, b"k") for w in words}) == len(words) and all(surrogates.word(w, b"k") != w for w in words)


def test_surrogates_stay_distinct_over_a_table(spark):
    rng = np.random.default_rng(3)
    what = []
    for i in range(300):
        d = "".join(map(str, rng.integers(0, 10, 15)))
        card = d + str(-surrogates._luhn(d + "0") % 10)
        what += [("email", f"u{i % 7}{'abc'[i % 3]}@h{i}.example.com"), ("ip", f"10.{i % 4}.0.{i % 250}"), ("card", card), ("ssn", f"{100 + i}-12-3456"), ("phone", f"+1 212 555 {1000 + i}"), ("name", f"Mr {surrogates.MALE[i % 30]} {'BCDFGHJKLM'[i % 10]}{'aeiou'[i % 5]}{'lmnr'[i % 4]}t")]
    rows = [(i, f"x {e} y", 1) for i, (_, e) in enumerate(what)]
    got = sorted((r.doc_id, r.kinds, r.text[2:-2]) for r in surrogates.protected(spark.createDataFrame(rows, "doc_id long, text string, kinds int"), b"k").collect())
    assert all(k == what[i][0] and s != what[i][1] for i, k, s in got)
    pairs = {(k, surrogates.canonical(k, what[i][1]), surrogates.canonical(k, s)) for i, k, s in got}
    assert len({p[:2] for p in pairs}) == len({(k, s) for k, _, s in pairs}) == len(pairs)


def test_surrogates_move_on_where_two_would_meet(monkeypatch):
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, entity, key: "5.5.5.5" if key == b"k" else f"6.6.6.{key[0]}")
    new, places = surrogates.replace("1.1.1.1 2.2.2.2 1.1.1.1", b"k")
    assert places[0][2] == places[2][2] == "5.5.5.5" != places[1][2]


def test_names_are_replaced_wherever_they_stand():
    text = "Frau Anna Meyer came. Meyer and Anna left; Meyerson stayed. Herr Rose saw a rose, and Rose again."
    new, places = surrogates.replace(text, b"k")
    (_, _, full), (_, _, last), (_, _, first), *_ = places
    assert [e for _, e, _ in places] == ["Frau Anna Meyer", "Meyer", "Anna", "Herr Rose"]
    assert full == f"Frau {first} {last}" and "Meyerson" in new and "and Rose again" in new


@pytest.mark.parametrize("name", ["language", "simhash", "packing", "quality", "accepted", "licenses", "surrogates", "protected", "decontam", "decontaminate", "repeats", "vectors", "pages"])
def test_empty_tables(spark, name):
    import public_tokenizers

    docs, items = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "item_id long, text string")
    runs = {
        "language": lambda: language.scores(docs), "simhash": lambda: simhash.near_duplicates(docs), "packing": lambda: packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")),
        "quality": lambda: quality.scores(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "licenses": lambda: licenses.scans(docs), "surrogates": lambda: surrogates.replaced(docs, b"k"),
        "accepted": lambda: quality.accepted(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "protected": lambda: surrogates.protected(docs, b"k"),
        "decontam": lambda: decontam.contamination(docs, items), "decontaminate": lambda: decontam.decontaminate(docs.withColumn("n_chars", F.lit(0).cast("long")), items), "repeats": lambda: repeats.removed(docs),
        "vectors": lambda: vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")), "pages": lambda: pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    }
    assert runs[name]().count() == 0


def test_null_ids_and_repeated_rows(spark):
    import public_tokenizers

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 9), (1, text, 9), (2, text, 8), (None, text, 7)], "doc_id long, text string, g long")
    assert sorted(((r.doc_id, r.n_removed) for r in repeats.removed(docs).collect()), key=str) == [(1, 0), (1, 0), (2, 30), (None, 0)]
    assert sorted((r.doc_id for r in language.scores(docs).collect()), key=str) == [1, 1, 2, None]
    assert simhash.near_duplicates(docs).count() == 4 and licenses.scans(docs).count() == 4 and surrogates.protected(docs, b"k").count() == 4
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 4
    items = spark.createDataFrame([(7, text), (8, None), (None, text)], "item_id long, text string")
    assert {(r.n_items, r.n_hit) for r in decontam.contamination(docs, items).collect()} == {(1, 30)}


def test_ids_beyond_doubles_and_very_long_texts(spark):
    import public_tokenizers

    big, long = (1 << 62) + 1, "word " * 200_000
    docs = spark.createDataFrame([(big, long, 1, "x"), (None, "a b", None, None)], "doc_id long, text string, score long, held_out string")
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "q r s")], "item_id long, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for out in (quality.scores(docs, labels), simhash.near_duplicates(docs), packing.pack(docs, ranks), decontam.contamination(docs, items), surrogates.protected(docs, b"k"), licenses.scans(docs)):
        assert {r.doc_id for r in out.select("doc_id").collect()} == {big, None}
    assert {r.doc_id for r in repeats.removed(docs).collect()} == {r.doc_id for r in language.scores(docs).collect()} == {big, None}
    assert sorted(map(tuple, surrogates.replaced(docs, b"k").collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert sorted(map(tuple, quality.accepted(docs, labels, 0.0).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
