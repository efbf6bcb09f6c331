"""HTML main text with a numpy bidirectional LSTM over leaf blocks.

A tokenizer cuts a page into blocks of text, each with the tags, classes and ids it stands in. A block's vector holds hashed
features of its path, of its length, links and marks, and of all its words, however many; the LSTM reads the page's blocks both
ways and labels each. The network is trained here, with a fixed seed, on generated pages whose content is known: half of their
notices, comments and adverts stand in containers without a telling name, and are known by their words and place.

Null and empty pages give "". <br> and block tags end a block. Scripts, styles, comments and the head have no blocks. Nothing is
cut. Every row comes back once, also without an id or repeated, with its id and url as they were.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docloom.llm import words as W

PLACES, WORDS, HIDDEN = 1024, 512, 12
FEATURES = PLACES + WORDS
#: HTML element kinds.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_RAW = frozenset("script style noscript template textarea select option button svg iframe title head".split())
_CLOSES_P = frozenset("p div ul ol li table section article aside nav header footer form h1 h2 h3 h4 h5 h6 blockquote pre main figure dl hr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of it within links) of each block in page order; path holds a tuple of names for each open element."""
    out, stack, text, at, low, linked = [], [], [], 0, None, 0

    def end():
        nonlocal linked
        raw = "".join(text)
        t = " ".join(html.unescape(raw).split())
        text.clear()
        if t:
            out.append((tuple(s for s in stack if s[0] not in _INLINE or len(s) > 1), t, min(1.0, linked / max(len(raw.strip()), 1))))
        linked = 0

    while m := _TOKEN.search(page, at):
        text.append(page[at : m.start()])
        if stack and stack[-1][0] in _INLINE and any(s[0] == "a" for s in reversed(stack)):
            linked += m.start() - at
        at = m.end()
        tag = (m[1] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:-3]))
            continue
        if m[0][1] == "/":
            if tag not in _INLINE:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if tag not in _INLINE:
            end()
        if tag in _RAW:
            low = low or page.lower()
            stop = low.find(f"</{tag}", at)
            if stop < 0 and tag in ("head", "button", "option", "select"):
                continue
            at = len(page) if stop < 0 else (page.find(">", stop) + 1 or len(page))
            continue
        if tag in _VOID or m[0].endswith("/>"):
            continue
        if tag in _CLOSES_P or tag in ("li", "tr", "td", "th", "dt", "dd"):
            same = {"p"} if tag in _CLOSES_P else set()
            same |= {"li", "p"} if tag == "li" else {"td", "th"} if tag in ("td", "th") else {"tr", "td", "th"} if tag == "tr" else {"dt", "dd"} if tag in ("dt", "dd") else set()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same:
                    del stack[k:]
                    break
                if stack[k][0] not in _INLINE:
                    break
        names = [x for n in _NAME.findall(m[2] or "") for x in _PARTS.findall("".join(n).lower())]
        stack.append((tag, *names))
    text.append(page[at:])
    end()
    return out


#: Names that pages give to what is not their article, the words found there, and names given to what is.
BAD = {
    "nav/menu/navigation/navbar header/top/masthead/banner div/menu/breadcrumb/breadcrumbs/links": "home about contact us products services news blog login register search menu start startseite kontakt über uns accueil inicio contacto",
    "footer/bottom/copyright div/footer/legal": "copyright all rights reserved privacy policy terms of use imprint impressum sitemap contact powered by 2020 2021 2022 2023 2024 inc ltd",
    "aside/sidebar/related/widget div/rail/recommended/trending/more": "related posts read more you may also like popular recommended stories from trending next previous latest top see all",
    "div/ad/ads/advert/advertisement/sponsor/promo": "advertisement sponsored ad buy now sale offer discount free shipping shop today limited deal click here save best price anzeige publicidad",
    "div/cookie/cookies/notice/consent/alert/popup/gdpr/banner": "we use cookies to improve your experience accept all cookies privacy settings consent by continuing you agree our use of this site cookie reject manage preferences akzeptieren",
    "section/comments/comment/replies/disqus/discussion div/comments/comment/replies ol/commentlist": "reply said says comment comments posted by great nice post thanks thank you for sharing love like this i agree ago hours days anonymous user lol report wow",
    "form/search/newsletter/subscribe/login div/newsletter/subscribe/signup": "subscribe newsletter email sign up enter your address get updates inbox weekly password log in forgot join submit",
    "div/share/social/pagination/tags": "share tweet facebook twitter pinterest linkedin whatsapp print email follow us copy link tags page",
}
GOOD = "article main div/content/article/post/entry/story section/body/text div/main".split()
_PROSE = "the of and a in to is was that for it with as on at by from this are be were which der die das und ist von zu mit den ein le la les des est que dans une el los las y en por con".split()


@lru_cache(1)
def _telling() -> np.ndarray:
    """Hashes of the words above, in order."""
    data, bounds = W.joined([w.encode() for w in {*_PROSE, *" ".join(BAD.values()).split()}])
    return np.unique(W.hashes(data, bounds[:-1], bounds[1:]))


def _word_slots(h: np.ndarray) -> np.ndarray:
    """Telling words have places of their own; all others share the rest by their hashes."""
    known = _telling()
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known) + (h % np.uint64(WORDS - len(known))).astype(np.int64))


def _slot(s: str) -> int:
    return zlib.crc32(s.encode()) % PLACES


@lru_cache(4096)
def _path(path: tuple) -> tuple:
    out = {_slot(f"t:{x}") for el in path for x in el}
    if path:
        out |= {_slot("leaf:" + path[-1][0]), *(_slot(f"in:{x}/{path[-1][0]}") for x in (path[-2] if len(path) > 1 else ()))}
    return tuple(out)


@lru_cache(4096)
def _shape(bits: int, linked: int, marks: int, end: str) -> tuple:
    return _slot(f"n:{bits}"), _slot(f"a:{linked}"), _slot(f"m:{marks}"), _slot(f"e:{end}"), _slot(f"n:{bits}/a:{linked > 1}")


def vectors(bs: list) -> np.ndarray:
    """A row for each block: its path and shape, and the counts of its hashed words over the root of their number."""
    x = np.zeros((len(bs), FEATURES), np.float32)
    rows, cols = [], []
    for i, (path, text, linked) in enumerate(bs):
        n = text.count(" ") + 1
        marks = text.count(". ") + text.count(", ") + text.count("! ") + text.count("? ")
        own = *_path(path), *_shape(min(n.bit_length(), 8), round(linked * 4), min(marks.bit_length(), 4), text[-1] if text[-1] in ".!?:,;|" else "")
        rows += [i] * len(own)
        cols += own
    x[rows, cols] = 1
    data, bounds = W.joined([t.lower().encode() for _, t, _ in bs])
    s, e, t = W.spans(data, bounds, W.ALNUM)
    slot = _word_slots(W.hashes(data, s, e))
    n = np.bincount(t * WORDS + slot, minlength=len(bs) * WORDS).reshape(len(bs), WORDS)
    x[:, PLACES:] = 2 * n / np.sqrt(np.maximum(n.sum(1, keepdims=True), 1))
    return x


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x, mask, w, u, b, pre=None):
    """Hidden states (pages, steps, HIDDEN) of an LSTM and what backward needs."""
    n, t = mask.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    pre = x @ w + b if pre is None else pre
    hs, keep = np.zeros((n, t, HIDDEN), np.float32), []
    for k in range(t):
        z = pre[:, k] + h @ u
        i, f, o, g = _sig(z[:, :HIDDEN]), _sig(z[:, HIDDEN : 2 * HIDDEN] + 1), _sig(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, k : k + 1]
        keep.append((h, c, i, f, o, g, m))
        c = m * (f * c + i * g)
        h = o * np.tanh(c)
        hs[:, k] = h
    return hs, keep


def _back(x, dh_all, keep, u):
    n, t, d = x.shape
    dz_all, dh, dc = np.zeros((n, t, 4 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    du = np.zeros_like(u)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, g, m = keep[k]
        new = m * (f * c + i * g)
        th = np.tanh(new)
        dh = dh + dh_all[:, k]
        dc = (dc + dh * o * (1 - th * th)) * m
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[:, k] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return x.reshape(-1, d).T @ dz_all.reshape(-1, 4 * HIDDEN), du, dz_all.sum((0, 1))


def _padded(pages: list[np.ndarray]):
    t = max(map(len, pages), default=0)
    x, mask = np.zeros((len(pages), t, FEATURES), np.float32), np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def label(m: dict, x, mask):
    a, ka = _run(x, mask, *m["fwd"])
    rev = x[:, ::-1]
    b, kb = _run(rev, mask[:, ::-1], *m["bwd"])
    return _sig(np.concatenate([a, b[:, ::-1]], 2) @ m["out"] + x @ m["own"] + m["bias"]), a, b, ka, kb


def generated(rng, n: int):
    """Pages as (vectors, labels)."""
    kinds = [(k.split(), v.split()) for k, v in BAD.items()]
    every = [w for _, v in kinds for w in v]

    def text(lo, hi, share, told=()):
        """Words of which `share` are those told, the rest prose or unknown."""
        out, prose = [], rng.choice([0.05, 0.3, 0.5])
        for _ in range(rng.randrange(lo, hi)):
            r = rng.random()
            out.append(told[rng.randrange(len(told))] if len(told) and r < share else _PROSE[rng.randrange(len(_PROSE))] if r < share + (1 - share) * prose else f"w{rng.randrange(10**6)}")
            if hi > 8 and rng.random() < 0.12:
                out[-1] += (rng.choice([",", ".", ".", ",", "!", " |"]))
        return " ".join(out) + ((rng.choice([".", ".", ".", " |", "!", ":"])) if rng.random() < (0.8 if hi > 20 else 0.3) else "")

    def part(kind, path, named):
        tag, *names = kind.split("/")
        if names and rng.random() < named:
            return (*path, (tag, rng.choice(names)))
        return (*path, (tag,))

    for _ in range(n):
        body, out = (("html",), ("body",)), []

        def noise(path, after, out=out):
            names, told = kinds[rng.randrange(5 if not after else len(kinds))]
            kind = rng.choice(names)
            plain = rng.random() < 0.45
            tag = kind.split("/")[0]
            if plain:
                inner = (*path, (rng.choice(["div", "div", "section", "ul"]),))
                share = 0.75
            else:
                inner = part(kind, path, 0.6 if tag in ("nav", "header", "footer", "aside", "form") else 1)
                share = rng.choice([0.0, 0.0, 0.5, 0.8])
            if rng.random() < 0.4:
                inner = (*inner, ("ul",), ("li",)) if rng.random() < 0.6 else (*inner, ("div",))
            links = rng.random() < 0.45
            for _ in range(rng.randrange(1, 7)):
                leaf = inner if rng.random() < 0.6 else (*inner, ("p",))
                out.append((leaf, text(1, 6 if rng.random() < 0.6 else 40, share, told), 1.0 if links else 0.0, 0))

        for _ in range(rng.randrange(0, 4)):
            noise(body, False)
        named = rng.random() < 0.75
        path = part(rng.choice(GOOD), body, 1) if named else (*body, ("div",))
        if rng.random() < 0.4:
            path = part(rng.choice(GOOD), path, 0.5)
        if rng.random() < 0.8:
            out.append(((*path, (rng.choice(["h1", "h1", "h1", "h2"]),)), text(2, 12, 0.03, every), 0.0, 1))
        for _ in range(rng.randrange(1, 12) if rng.random() < 0.8 else rng.randrange(12, 40)):
            leaf = rng.choice(["p", "p", "p", "h2", "h3", "li", "blockquote", "td", "pre", ""])
            where = (*path, ("ul",), ("li",)) if leaf == "li" else (*path, ("table",), ("tr",), ("td",)) if leaf == "td" else (*path, (leaf,)) if leaf else path
            told = named and leaf == "p" and rng.random() < 0.06  # an article may quote a legal line
            out.append((where, text(2, 8, 0.9, kinds[1][1]) if told else text(1, 8 if rng.random() < 0.3 else 80, 0.05, every), float(rng.choice([0, 0, 0, 0.2, 1]) if leaf == "li" else rng.choice([0, 0, 0, 0.1])), 1))
            if named and leaf == "p" and rng.random() < 0.05:
                out += out[-1:] * rng.randrange(2, 30)
            if rng.random() < 0.12:
                noise(path, True)
        for _ in range(rng.randrange(0, 4)):
            noise(body, True)
        yield vectors([x[:3] for x in out]), [x[3] for x in out]


def train(pages: int = 3000, epochs: int = 6, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
    m = {k: (init(FEATURES, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)) for k in ("fwd", "bwd")} | {"out": init(2 * HIDDEN), "own": np.zeros(FEATURES, np.float32), "bias": np.zeros(1, np.float32)}
    data = sorted(generated(random.Random(seed), pages), key=lambda s: len(s[0]))
    adam: dict = {}
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(max(1, len(data) // 32)):
            part = data[b * 32 : b * 32 + 32]
            x, mask = _padded([s for s, _ in part])
            y = np.zeros_like(mask)
            for i, (_, v) in enumerate(part):
                y[i, : len(v)] = v
            p, a, bh, ka, kb = label(m, x, mask)
            dz = ((p - y) * mask / mask.sum()).astype(np.float32)
            both = np.concatenate([a, bh[:, ::-1]], 2)
            dh = dz[..., None] * m["out"]
            g = {"out": dz.ravel() @ both.reshape(-1, 2 * HIDDEN), "own": dz.ravel() @ x.reshape(-1, FEATURES), "bias": dz.sum(keepdims=True).reshape(1), "fwd": _back(x, dh[..., :HIDDEN], ka, m["fwd"][1]), "bwd": _back(x[:, ::-1], dh[..., HIDDEN:][:, ::-1], kb, m["bwd"][1])}
            step += 1

            def update(key, w, d, step=step, rate=0.012 * (1 - epoch / epochs) ** 1.2 + 0.0005):
                s, v = adam.get(key, (0.0, 0.0))
                s, v = adam[key] = (0.9 * s + 0.1 * d, 0.999 * v + 0.001 * d * d)
                return (w - rate * (s / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

            m = {k: tuple(update((k, j), w, d) for j, (w, d) in enumerate(zip(m[k], g[k]))) if isinstance(m[k], tuple) else update(k, m[k], g[k]) for k in m}
    return m


def _probabilities(m: dict, pages: list[list]) -> list[np.ndarray]:
    """label() of pages of blocks; pages of like length run together, and vectors are made for a part of them at a time."""
    out: list = [None] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    both = np.concatenate([m["fwd"][0], m["bwd"][0], m["own"][:, None]], 1)
    at = 0
    while at < len(order):
        size = max(1, min(128, 40_000 // len(pages[order[min(at + 127, len(order) - 1)]])))
        some = order[at : at + size]
        at += size
        t = max(len(pages[k]) for k in some)
        flat = [b for k in some for b in pages[k]]
        z = np.concatenate([vectors(flat[a : a + 2048]) @ both for a in range(0, len(flat), 2048)])
        pre, mask, done = np.zeros((len(some), t, 8 * HIDDEN + 1), np.float32), np.zeros((len(some), t), np.float32), 0
        for i, k in enumerate(some):
            n = len(pages[k])
            pre[i, :n], mask[i, :n] = z[done : done + n], 1
            done += n
        hs = []
        for name, step, part in (("fwd", 1, pre[..., : 4 * HIDDEN]), ("bwd", -1, pre[..., 4 * HIDDEN : -1])):
            _, u, b = m[name]
            h, _ = _run(None, mask[:, ::step], None, u, b, part[:, ::step] + b)
            hs.append(h[:, ::step])
        p = _sig(np.concatenate(hs, 2) @ m["out"] + pre[..., -1] + m["bias"])
        for i, k in enumerate(some):
            out[k] = p[i, : len(pages[k])]
    return out


def extract_all(m: dict, pages: list) -> list[str]:
    found = [blocks(p or "") for p in pages]
    return ["\n".join(t for (_, t, _), q in zip(bs, p) if q >= 0.5) if bs else "" for bs, p in zip(found, _probabilities(m, found))]


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            done = [t for k in range(0, len(texts), 500) for t in extract_all(shipped.value, texts[k : k + 500])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], names=["page_id", "url", "text"])

    kind = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType())])
    return pages.select("page_id", "url", "html").mapInArrow(run, kind).withColumn("n_chars", F.length("text").cast("long"))
