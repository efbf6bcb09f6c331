"""PII surrogates.

Detected e-mail addresses, phone numbers, IPv4 addresses, payment cards, IBANs, social security numbers, secrets, dates of birth,
street addresses and names get keyed replacements of the same type and format: every letter stays a letter of its script, case and
vowel class, every digit a digit, all else stays. A replacement is a keyed cyclic order on all values of a format (an unbalanced
Feistel network on mixed radices, moved on by one), so no value stays what it was, one entity has one surrogate however it is
written, and distinct entities of a type stay distinct across the corpus without a table. Cards, IBANs and IPs keep their validity.

Words of names have one order for all: listed first names move within their gender's list, all other words among unlisted ones.
Names are found after titles and where a listed first name stands before a capitalised word; their words are then replaced alike
wherever else they stand in the same text, unless the text also has them in lower case. Dates count after words of birth only,
cards and IBANs where their check digits are right.
A check in each text moves a surrogate on where another entity of the text already has it. Nulls stay null, empty texts stay
empty; rows without an id and repeated rows come back each. The caller gives the key.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import with_texts

#: Letters by class.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_CLASS = {c: a for a in ALPHABETS for c in a}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
#: Titles and common first names by gender and script.
FEMALE = "Mary Anna Emma Julia Sarah Laura Marie Claire Sophie Camille Ingrid Petra Heike Sabine Carmen Lucía Elena Sofía Marta Pilar Linda Susan Karen Nancy Helen Alice Clara Eva Ida Nora Olga Irina Jane Maria Jennifer Elizabeth".split()
MALE = "John James Robert Michael David Peter Paul Mark Pierre Jean Luc Hugo Hans Jürgen Klaus Stefan Carlos José Luis Miguel Pablo Diego Thomas Daniel Adam Oscar Henry Frank Karl Erik Ivan Boris William Richard Charles George".split()
POOLS = {"f": FEMALE, "m": MALE, "fc": "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана".split(), "mc": "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Борис".split()}
_POOL = {x: g for g, names in POOLS.items() for x in names}
_BIRTH = r"(?:[Bb]orn(?: on)?|DOB|[Dd]ate of [Bb]irth|[Bb]irthday|[Gg]eboren(?: am)?|[Nn]ée? le|[Nn]acid[oa] el)[:\s]{1,3}"
_MONTHS = "January February March April May June July August September October November December".split()
_WAYS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Way|Place|Square|Terrace"
_CAP = r"[A-ZÀ-Þ][\wÀ-ÿ'-]+"
#: Calling codes of two digits; 1 and 7 have one, all others three.
_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PATTERNS = [
    ("email", "@", re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("secret", "", re.compile(r"(?i)(?<=[\"'])[0-9a-f]{32,}(?=[\"'])|\b(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,}\b|\b[0-9a-f]{40}\b")),
    ("iban", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", "", re.compile(r"(?<![\d.])(?:\d{4}[ -]?){3}\d{4}(?![\d])")),
    ("ip", ".", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("birth", "", re.compile(_BIRTH + r"(\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2} (?:" + "|".join(_MONTHS) + r") \d{4}|(?:" + "|".join(_MONTHS) + r") \d{1,2}, \d{4})\b")),
    ("phone", "", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
    ("address", "", re.compile(rf"\b\d{{1,5}} (?:{_CAP} ){{1,3}}(?:{_WAYS})\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}[a-z]?\b|\b\d{{1,4}},? (?:rue|avenue|boulevard|place|chemin|impasse) (?:de la |du |des |de |d')?{_CAP}(?: {_CAP})*|\b(?:Calle|Avenida|Plaza|Paseo) (?:de la |del |de )?{_CAP}(?: {_CAP})*,? \d{{1,4}}\b")),
    ("name", "", re.compile(r"\b(?:(?:Mr|Mrs|Ms|Sra?|Mme|M)\.?|Miss|Sir|Madame|Monsieur|Frau|Herr|Señora?|Dr\.?)(?: " + _CAP + "){1,3}")),
]
_TWO = re.compile(r"\b(?=([A-ZÀ-ÞА-Я][\w'-]+)((?: [A-Z]\.)?(?: (?:[A-ZÀ-Þ][\wÀ-ÿ'-]+|[А-ЯЁ][а-яё-]+)){1,2}))")
_HAS = re.compile(r"\d|@|\b(?:Mr|Mrs|Ms|Miss|Sir|Mme|Madame|Monsieur|Frau|Herr|Sra?|Señora?|Dr|M)\.? [A-ZÀ-Þ]|\b(?:" + "|".join(_POOL) + r")\b")
_KEPT = re.compile(rf"\b(?:{_WAYS}|rue|avenue|boulevard|place|chemin|impasse|de la|du|des|de|del|d'|Calle|Avenida|Plaza|Paseo)\b|straße|strasse|weg|platz|allee|gasse")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 60_000


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "little")


def permute(x: int, sizes: list[int], key: bytes, tag: str, back: bool = False) -> int:
    """A keyed bijection of 0..product(sizes)-1, or its inverse."""
    a = b = 1
    for k, s in enumerate(sizes):
        if k < (len(sizes) + 1) // 2:
            a *= s
        else:
            b *= s
    left, right = x % a, x // a
    for r in reversed(range(4)) if back else range(4):
        if back:
            right = (right - _number(key, tag, a, b, r, 1, left)) % b
            left = (left - _number(key, tag, a, b, r, 0, right)) % a
        else:
            left = (left + _number(key, tag, a, b, r, 0, right)) % a
            right = (right + _number(key, tag, a, b, r, 1, left)) % b
    return left + right * a


def onward(x: int, sizes: list[int], key: bytes, tag: str) -> int:
    """The next value in a keyed cyclic order: a bijection that leaves no value as it is, if there are two."""
    n = 1
    for s in sizes:
        n *= s
    return permute((permute(x, sizes, key, tag, True) + 1) % n, sizes, key, tag)


def reformat(text: str, key: bytes, tag: str, alphabets: dict | None = None) -> str:
    """Each character another of its class, as a bijection on texts of this shape."""
    of = alphabets or _CLASS
    at = [i for i, c in enumerate(text) if c in of]
    sizes = [len(of[text[i]]) for i in at]
    x, unit = 0, 1
    for i, s in zip(at, sizes):
        x += of[text[i]].index(text[i]) * unit
        unit *= s
    y = onward(x, sizes, key, f"{tag}/{len(text)}")
    out = list(text)
    for i, s in zip(at, sizes):
        out[i] = of[text[i]][y % s]
        y //= s
    return "".join(out)


def _fill(form: str, new: str) -> str:
    """The letters and digits of form replaced by those of new."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def word(w: str, key: bytes) -> str:
    """A word of a name: a bijection on all words, listed first names among those of their list."""
    pool = POOLS.get(_POOL.get(w, ""))
    if pool:
        order = sorted(pool, key=lambda x: _number(key, "order", x))
        return order[(order.index(w) + 1) % len(order)]
    new = reformat(w, key, "word")
    while new in _POOL:
        new = reformat(new, key, "word")
    return new


def _calling(digits: str) -> str:
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in _CODES else digits[:3]


def _date(text: str):
    """The date and how to write another like it; None where there is no such day."""
    n = [int(x) for x in re.findall(r"\d+", text)]
    month = next((k + 1 for k, m in enumerate(_MONTHS) if m in text), None)
    try:
        if month:
            day, year, first = n[0], n[1], text[0].isdigit()
            return datetime.date(year, month, day), lambda d: f"{d.day} {_MONTHS[d.month - 1]} {d.year}" if first else f"{_MONTHS[d.month - 1]} {d.day}, {d.year}"
        if "-" in text:
            return datetime.date(*n), datetime.date.isoformat
        sign, wide = re.search(r"[./]", text)[0], len(re.match(r"\d+", text)[0]) == 2
        flip = n[1] > 12
        form = lambda d: sign.join(f"{x:02d}" if wide else str(x) for x in ((d.month, d.day) if flip else (d.day, d.month))) + sign + str(d.year)
        return datetime.date(n[2], n[0] if flip else n[1], n[1] if flip else n[0]), form
    except ValueError:
        return None, None


def canonical(kind: str, entity: str) -> str:
    """What all ways to write one entity have in common."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", entity)
    if kind == "phone":
        return ("+" if "+" in entity else "") + re.sub(r"\D", "", entity)
    if kind == "ip":
        return ".".join(str(int(x)) for x in entity.split("."))
    if kind == "iban":
        return entity.replace(" ", "")
    if kind == "birth":
        return str(_date(entity)[0] or entity)
    return entity.lower() if kind == "email" else entity


def surrogate(kind: str, entity: str, key: bytes) -> str:
    same = canonical(kind, entity)
    if kind == "email":
        local, _, domain = same.partition("@")
        name, _, top = domain.rpartition(".")
        return f"{reformat(local + '@' + name, key, kind)}.{top}"
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, same.split("."))), "big")
        return ".".join(map(str, onward(x, [256] * 4, key, kind).to_bytes(4, "big")))
    if kind == "card":
        new = same[0] + reformat(same[1:-1], key, kind + same[0])
        return _fill(entity, new + str((int(same[-1]) + _luhn(same[:-1] + "0") - _luhn(new + "0")) % 10))
    if kind == "ssn":
        return _fill(entity, reformat(same, key, kind))
    if kind == "secret":
        head = re.match(r"(?i)(?:(?:sk|pk|ghp|AKIA)[-_]?)?", entity)[0]
        body = entity[len(head) :]
        return head + reformat(body, key, kind + head, _HEX if not head and re.fullmatch("[0-9a-f]+", body) else None)
    if kind == "iban":
        land, body = same[:2], same[4:]
        new = reformat(body, key, kind + land)
        check = (int(same[2:4]) - _iban_check(land, body) + _iban_check(land, new)) % 100
        return _fill(entity, f"{land}{check:02d}{new}")
    if kind == "phone":
        code = _calling(same[1:]) if same[0] == "+" else ""
        return _fill(entity, code + reformat(same.lstrip("+")[len(code) :], key, f"{kind}{same[0] == '+'}{code}"))
    if kind == "birth":
        day, form = _date(entity)
        if day is None or not 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
            return reformat(entity, key, kind, {c: "0123456789" for c in "0123456789"})
        return form(datetime.date.fromordinal(_FIRST_DAY + onward(day.toordinal() - _FIRST_DAY, [200, 300], key, kind)))
    if kind == "name":
        head = re.match(r"(?:(?:Mr|Mrs|Ms|Sra?|Mme|M|Dr)\.? |(?:Miss|Sir|Madame|Monsieur|Frau|Herr|Señora?) )?", entity)[0]
        return head + " ".join(x if x.endswith(".") else word(x, key) for x in entity[len(head) :].split(" "))
    if kind == "address":
        shape = _KEPT.sub(lambda m: "\0" * len(m[0]), entity)
        new = reformat(shape, key, kind + "/".join(_KEPT.findall(entity)))
        return "".join(c if s == "\0" else b for c, s, b in zip(entity, shape, new))
    return reformat(entity, key, kind)


def _holds(kind: str, entity: str) -> bool:
    """Whether the check digits of a card or an IBAN are right; other numbers of their form are no personal data."""
    if kind == "card":
        return not _luhn(canonical(kind, entity))
    return kind != "iban" or _iban_check(entity[:2], canonical(kind, entity)[4:]) == int(entity[2:4])


def _places(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []

    def add(a, b, kind):
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    for kind, need, pattern in _PATTERNS:
        if need in text:
            for m in pattern.finditer(text):
                if _holds(kind, m[0]):
                    add(*m.span(pattern.groups), kind)
    for m in _TWO.finditer(text):
        if m[1] in _POOL:
            add(m.start(), m.start() + len(m[1]) + len(m[2]), "name")
    return found


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each place in order."""
    if not text or not _HAS.search(text):
        return text, []
    found = _places(text)
    owner: dict[tuple[str, str], str] = {}
    chosen: dict[tuple[str, str], str] = {}

    def choose(kind, entity):
        """The surrogate; another key's where a different entity of the text has it."""
        if (kind, entity) not in chosen:
            for n in range(1000):
                s = surrogate(kind, entity, key if not n else hashlib.blake2b(key, salt=n.to_bytes(16, "little"), digest_size=32).digest())
                if owner.setdefault((kind, canonical(kind, s)), canonical(kind, entity)) == canonical(kind, entity):
                    break
            chosen[kind, entity] = s
        return chosen[kind, entity]

    named = {}
    for a, b, kind in found:
        if kind == "name":
            named |= {w: s for w, s in zip(text[a:b].split(" "), choose(kind, text[a:b]).split(" ")) if len(w) > 2 and w != s}
    if named:
        common = set(re.findall(r"\b[^\W\d_]+\b", text))
        again = [re.escape(w) for w in sorted(named, key=len, reverse=True) if w.lower() not in common]
        taken = sorted(found)
        for m in re.finditer(rf"(?<![\w'-])(?:{'|'.join(again)})(?![\w'-])", text) if again else ():
            if all(m.end() <= a or m.start() >= b for a, b, _ in taken):
                found.append((m.start(), m.end(), "named"))
    out, last, places = [], 0, []
    for a, b, kind in sorted(found):
        s = named[text[a:b]] if kind == "named" else choose(kind, text[a:b])
        places.append(("name" if kind == "named" else kind, text[a:b], s))
        out += [text[last:a], s]
        last = b
    return "".join([*out, text[last:]]), places


def session_key(spark: SparkSession) -> bytes:
    """spark.docloom.surrogates.key; where it is unset, a random key is drawn and set for the session."""
    name = "spark.docloom.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(16))
    return hashlib.blake2b(spark.conf.get(name).encode(), digest_size=32).digest()


def protected(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_found, kinds (comma-joined, in order), text (with surrogates) for every row."""

    def run(batches):
        for pdf in batches:
            done = [replace(t, key) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["i"], "n_found": [len(p) for _, p in done], "kinds": [",".join(k for k, *_ in p) for _, p in done], "text": [t for t, _ in done]})

    out = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id string, n_found long, kinds string, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def replaced(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with surrogates in their texts; all other columns as they were."""
    return with_texts(docs, lambda texts: ([replace(t, key)[0] for t in texts], None), text_col)
