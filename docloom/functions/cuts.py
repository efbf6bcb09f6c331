"""Cuts of one text as loops over its parts: what the columns of chunks.py apply to each row. White space is that of ASCII.

A run of neighbouring parts is [at, n, size]: its first part, how many there are, and their length joined by spaces.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from docloom.functions import texts

SPACE = " \t\n\r\f\v"
#: Abbreviations after which a point ends no sentence.
ABBREVIATIONS = "m mm mme dr pr st ste art cf ex etc no n fig tel av bd ch vs mr mrs ms inc ltd co jan feb mar apr jun jul aug sep oct nov dec".split()
_BLANKS, _END, _QUESTION_END = re.compile("[ \t]+"), re.compile(f"[.!?…][{SPACE}]+"), re.compile(f"[.!?][{SPACE}]+")
_LAST, _TITLE = re.compile(rf"[^{SPACE}(]*\Z"), re.compile("[ \t]*#+")
_SECTION = re.compile(r"\n(?=[ \t]*#)")
_HELD = {*ABBREVIATIONS, *"abcdefghijklmnopqrstuvwxyz"}
_REACH = max(map(len, _HELD)) + 2  #: of the end of a part, which shows whether its last word is one of them
#: Of the bytes of Latin-1: accents folded, a-z and 0-9 kept, all else a space. Signs beyond it, which "?" replaces, are in no word.
_FOLDED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in (ord(dict(zip(texts._ACCENTED, texts._PLAIN)).get(chr(k), chr(k))) for k in range(256)))
_UNTELLING = frozenset(w.encode() for w in [*texts.UNTELLING, *"abcdefghijklmnopqrstuvwxyz0123456789"])


def parts(text: str, end: re.Pattern = _END) -> list[str]:
    """A text cut after signs that end a sentence and white space, without empty parts."""
    text, at, out = text.strip(SPACE), 0, []
    for m in end.finditer(text):
        out.append(text[at : m.start() + 1])
        at = m.end()
    return out + [text[at:]] if at < len(text) else out


def sentences(text: str) -> list[str]:
    """Parts; one joins the one before it after an abbreviation, an initial, or a short start."""
    if "\t" in text or "  " in text:
        text = _BLANKS.sub(" ", text)
    out, run, size, on = [], [], 0, False
    for p in parts(text):
        if on:
            run.append(p)
            size += 1 + len(p)
        else:
            if run:
                out.append(" ".join(run))
            run, size = [p], len(p)
        on = size < 25 and p[-1] not in ":?!" or _LAST.search(p.rstrip(".")[-_REACH:])[0].lower() in _HELD
    return out + [" ".join(run)] if run else out


def packed(sizes: list[int], target: int) -> list[list[int]]:
    """Runs of whole parts up to the target; a longer part stands alone, whatever its length."""
    out = []
    for i, size in enumerate(sizes):
        if out and out[-1][2] + size + 2 <= target:
            out[-1][1] += 1
            out[-1][2] += 1 + size
        else:
            out.append([i, 1, size])
    return out


def merged(runs: list[list[int]], least: int) -> list[list[int]]:
    """A run under the least size joins the one before; a first one the second."""
    out = []
    for at, n, size in runs:
        if out and size < least:
            out[-1][1] += n
            out[-1][2] += 1 + size
        else:
            out.append([at, n, size])
    if len(out) > 1 and out[0][2] < least:
        (at, n, size), (_, m, more) = out[:2]
        out[:2] = [[at, n + m, size + 1 + more]]
    return out


def chunked(s: list[str], runs: list[list[int]], overlap: int = -1) -> list[tuple[str, int]]:
    """C4: (body, n) of runs of sentences; each but the first starts with the sentence before it, where that is not over the overlap."""
    led = [at > 0 and len(s[at - 1]) <= overlap for at, _, _ in runs]
    return [(" ".join(s[at - k : at + n]), n + k) for (at, n, _), k in zip(runs, led)]


def counted(text: str) -> Counter[str]:
    """The words a-z, 0-9 of a folded text and how often they stand in it."""
    return Counter(text.lower().encode("latin-1", "replace").translate(_FOLDED).decode("ascii").split())


def tokens(text: str) -> set[bytes]:
    """The set of telling words."""
    return set(text.lower().encode("latin-1", "replace").translate(_FOLDED).split()) - _UNTELLING


def likeness(s: list[str]) -> list[float]:
    """Likeness of each sentence to the next: the cosine of their sets of telling words, 0 where either has none."""
    w = [tokens(x) for x in s]
    return [len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0 for a, b in zip(w, w[1:])]


def semantic(s: list[str], target: int, factor: float) -> list[list[int]]:
    """Runs cut where neighbours are among the least alike quarter and half the target is reached, and beyond factor times the target."""
    if len(s) < 3:
        return [[0, len(s), sum(map(len, s)) + len(s) - 1]] if s else []
    sims, most, out = likeness(s), int(target * factor), [[0, 1, len(s[0])]]
    limit = sorted(sims)[max(0, len(sims) // 4 - 1)]
    for i, sim in enumerate(sims, 1):
        at, _, size = out[-1]
        size += at > 0
        if sim <= limit and size >= target * 0.5 or size + len(s[i]) + 1 > most:
            out.append([i, 1, len(s[i])])
        else:
            out[-1][1] += 1
            out[-1][2] += 1 + len(s[i])
    return out


def sections(text: str) -> list[tuple[str | None, str]]:
    """SC8: (title, body) of Markdown; a line that starts with # opens a section."""
    out = []
    for s in _SECTION.split(text) if "#" in text else [text]:
        title, _, rest = s.partition("\n") if _TITLE.match(s) else (None, "", s)
        out.append((None if title is None else _TITLE.sub("", title, count=1).strip(SPACE), rest.strip(SPACE)))
    return out


def pieces(text: str, size: int, overlap: int) -> list[str]:
    """Windows of at most `size` characters that end after the last paragraph, line, sentence or word break of their final
    quarter; the next begins `overlap` before that end."""
    text, zone, at, out = text.strip(SPACE), max(1, size // 4), 0, []
    while at < len(text):
        end = at + size
        if end < len(text):
            breaks = ((text.rfind(sep, end - zone, end), len(sep)) for sep in ("\n\n", "\n", ". ", " "))
            end = next((k + n for k, n in breaks if k >= 0), end)
        piece = text[at:end].strip(SPACE)
        if piece:
            out.append(piece)
        at = len(text) if end >= len(text) else max(at + 1, end - overlap)
    return out


def middle(text: str) -> str | None:
    """Of the sentences of eight words and more the one in the middle."""
    long = [p for p in parts(text, _QUESTION_END) if words(p) >= 8]
    return long[len(long) // 2] if long else None


def words(text: str) -> int:
    return len(text.encode().split())  # bytes are split at the white space of ASCII only


def cohesion(text: str, most: int) -> float | None:
    """Mean likeness of neighbours among the first sentences; null where there are less than two."""
    near = likeness(sentences(text)[:most])
    return sum(near) / len(near) if near else None
