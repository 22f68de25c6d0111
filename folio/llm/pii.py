"""Personal data, disguised too, with offsets into the source text.

The plain grammars are matched on the text as it is. Where there are
homoglyphs, spelled digits or 'at' and 'dot' in disguise, transducers rewrite
the text, the same grammars are matched on the result, and the spans are
mapped back to the characters they came from.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import small_batches
from folio.llm.words import byte_blocks, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Found from each @ outwards, which takes time in proportion to the text whatever it holds."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1  # what stands left of this @ belongs to no later one
        at = text.find("@", max(at + 1, floor))
    return found


def addresses(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups())]


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


_FIND = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the plain grammars, non-overlapping, from the left."""
    return {kind: find(text) for kind, find in _FIND.items()}


# Letters that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_GLYPHS = _LOOKALIKES | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms follow ASCII
for _zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other scripts' digits, and mathematical ones
    _GLYPHS |= {chr(_zero + d): str(d) for d in range(10)}
_UNSEEN = "​‌‍⁠﻿­"

# Digits spelled in English, German, French and Spanish, and how often the next one counts.
_NUMBER = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "ein": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ARTICLES = ("un", "uno", "ein")
_TIMES = {"double": 2, "triple": 3, "doble": 2}
# Mail services, words that stand before "at" without being a name, top domains, and what announces an address.
_SERVICES = "gmail|googlemail|hotmail|outlook|icloud|gmx|protonmail|laposte|wanadoo|yahoo|aol"
_NO_NAMES = frozenset("a an the in on up out us me it him her them is are was were here there account accounts online page site website address email mail mails inbox login users people server servers".split())
_TOP = "com|org|net|edu|gov|info|io|eu|uk|de|ch|fr|es|mx|nl"
_ANNOUNCED = re.compile(r"(?i)(?:mail|mailto|contact|correo|courriel|address|adresse|write to|reach)(?:\s?(?:is|:))?\s$")

_SURE = "|".join(sorted(set(_NUMBER) - set(_ARTICLES), key=len, reverse=True))
_WORDS = "|".join(sorted(_NUMBER, key=len, reverse=True))  # the longer of two that begin alike is tried first
_ARTICLES_OR = "|".join(sorted(_ARTICLES, key=len, reverse=True))
_MANY = rf"(?:{'|'.join(_TIMES)})[\s-]{{1,2}}"
_ONE = f"(?:{_WORDS}|[0-9])"
_ITEM = f"(?:{_MANY})?{_ONE}"
#: Two digits in a row or more, one of them spelled; "plus" before them is a sign.
_SPELLED = re.compile(rf"(?i)(?:\bplus[\s,]+)?(?<![^\W\d_]){_ITEM}(?:[\s,-]{{0,2}}{_ITEM}){{1,}}(?![^\W\d_])")
_SPELLED_PART = re.compile(rf"(?i)plus[\s,]+|({_MANY})?({_ONE})")
_LABEL = "[a-z0-9-]+"
_OTHER_DOT = "punto|point|punkt"
_AT = re.compile(
    r"(?i)\s?[\[({<]\s?(?:at|arroba|arobase)\s?[\])}>]\s?|\s?[\[({<]\s?@\s?[\])}>]\s?|\s(?:at)\s(?=[\w-]+(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s))"
    rf"|(?<=[a-z0-9])_at_(?={_LABEL}(?:_dot_|\.){_LABEL})|\s(?:arroba|arobase)\s(?={_LABEL}(?:\.|\s\.\s|\s(?:dot|{_OTHER_DOT})\s){_LABEL})"
)
#: A spelled "at", or a mark amid spaces, before a plain domain: prose has that too, so that ``_meant`` decides.
_MAYBE_AT = re.compile(rf"(?i)(?<=[a-z0-9])\s(?:at|@)\s(?=({_LABEL}(?:(?:\.|\s\.\s){_LABEL})+))")
_DOT = re.compile(rf"(?i)(?<=\w)(?:\s?[\[({{<]\s?(?:dot|\.|{_OTHER_DOT})\s?[\])}}>]\s?|\sdot\s)(?=\w)|(?<=[a-z0-9])_dot_(?=[a-z0-9])")
#: From a mark to the first top domain, over dots amid spaces and those spelled in other languages.
_DOMAIN_AFTER = re.compile(rf"(?i)@{_LABEL}(?:(?:\.|\s\.\s|\s(?:{_OTHER_DOT})\s){_LABEL})*?(?:\.|\s\.\s|\s(?:{_OTHER_DOT})\s)(?:{_TOP})(?![\w-])")
_WIDE_DOT = re.compile(rf"(?i)\s(?:\.|{_OTHER_DOT})\s")
_ENTITY = re.compile(r"&(?:#0*([0-9]{2,3})|#[xX]0*([0-9a-fA-F]{2})|(commat|period|plus|lowbar|nbsp));")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "nbsp": " "}
# without case only in its words: a dotless i in the set would stand for every i
_TRIGGER = re.compile(
    "(?i)(?-i:[" + re.escape("".join(_GLYPHS) + _UNSEEN) + r"])|(?:\b|_)dot(?:\b|_)|[\[({<]\s?(?:at|@|\.|arroba|arobase)\s?[\])}>]|&(?:#|commat|period|plus|lowbar|nbsp)"
    rf"|[\[({{<]\s?(?:{_OTHER_DOT})\s?[\])}}>]|\s(?:arroba|arobase)\s|[a-z0-9]_at_|\s(?:at|@)\s{_LABEL}(?:\.|\s\.\s)[a-z0-9-]|@[a-z0-9.-]+\s(?:\.|{_OTHER_DOT})\s"
    rf"|(?<![^\W\d_])(?:{_SURE})(?=[\s,-]{{0,2}}{_ITEM})|(?<![^\W\d_])(?:{_ARTICLES_OR})(?=[\s,-]{{0,2}}(?:{_MANY}|{_SURE}))|[0-9](?=[\s,-]{{0,2}}(?:{_MANY}|{_SURE}))"
    rf"|[0-9](?=[\s,-]{{0,2}}(?:{_ARTICLES_OR})[\s,-]{{0,2}}{_ITEM})|(?<![^\W\d_]){_MANY}{_ONE}|\bplus(?=[\s,]+(?:[0-9]|{_ARTICLES_OR}))"
)
_GLYPH = re.compile("[" + re.escape("".join(_GLYPHS) + _UNSEEN) + "]")


class Rewritten:
    """A text that was rewritten, with what each of its characters stands for in the source.

    Each step is held as pieces that begin at some character of its result:
    (where, the same place before the step, and for a character that was put in
    the end of what it replaces). Other characters stand for themselves, so
    that memory grows with the rewritten places and not with the text.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self._steps: list[tuple[list[int], list[int], list[int]]] = []

    def apply(self, edits: Iterable[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replaces [a, b) by characters, each standing for [x, y) of the text as it is, for every edit in order."""
        out, length, at = [], 0, 0
        where, before, ends = [0], [0], [-1]
        for a, b, put in edits:
            out.append(self.text[at:a])
            length += a - at
            for char, x, y in put:
                where.append(length)
                before.append(x)
                ends.append(y)
                out.append(char)
                length += 1
            where.append(length)
            before.append(b)
            ends.append(-1)
            at = b
        if at or out:
            self.text = "".join([*out, self.text[at:]])
            self._steps.append((where, before, ends))

    def source(self, span: Span) -> Span:
        """The place in the source of a place in the text."""
        a, z = span[0], span[1] - 1  # the first and the last character
        last = z + 1
        for where, before, ends in reversed(self._steps):
            i, j = bisect_right(where, a) - 1, bisect_right(where, z) - 1
            a = before[i] if ends[i] >= 0 else before[i] + a - where[i]
            last = ends[j] if ends[j] >= 0 else before[j] + z - where[j] + 1
            z = last - 1
        return a, last


def _spelled_edit(m: re.Match) -> tuple[int, int, list[tuple[str, int, int]]] | None:
    parts = list(_SPELLED_PART.finditer(m.group()))
    # an article at the edge of digits is a digit only if others are spelled
    if all(p[0].isdigit() or p[0].lower() in _ARTICLES or p[2] is None for p in parts):
        while parts and parts[-1][0].lower() in _ARTICLES:
            parts.pop()
        while parts and parts[0][0].lower() in _ARTICLES:
            parts.pop(0)
    if all(p[0].isdigit() for p in parts):
        return None
    out = []
    for p in parts:
        many, word = (p[1] or "").rstrip(" \t\n-").lower(), (p[2] or "+").lower()
        out += [(_NUMBER.get(word, word), m.start() + p.start(), m.start() + p.end())] * _TIMES.get(many, 1)
    return m.start() + parts[0].start(), m.start() + parts[-1].end(), out


def _meant(text: str, m: re.Match) -> bool:
    """Whether "name at domain" is an address: by its mail service, a name that no word of prose is like, or what announces it."""
    start = m.start()
    while start and text[start - 1] in _LOCAL:
        start -= 1
    name, domain = text[start : m.start()], m[1].lower()
    if name.lower() in _NO_NAMES or not re.search("[A-Za-z]", name):
        return False
    if "@" in m[0] and re.search(rf"\s\.\s(?:{_TOP})(?![\w-])", domain):
        return True
    like_name = re.search(r"[A-Za-z0-9][._+]+[A-Za-z0-9]|[0-9]", name) and re.search(rf"\.(?:{_TOP})(?![\w-])", domain)
    return bool(like_name or re.match(rf"(?:{_SERVICES})\b", domain) or _ANNOUNCED.search(text, max(0, start - 16), start))


def _character(m: re.Match) -> str | None:
    """The printable ASCII character that an entity stands for."""
    code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord(_NAMED[m[3]])
    return chr(code) if 0x20 <= code < 0x7F else None


def _dots_of(text: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    for m in _DOMAIN_AFTER.finditer(text):
        for d in _WIDE_DOT.finditer(text, m.start(), m.end()):
            yield d.start(), d.end(), [(".", d.start(), d.end())]


def rewrite(text: str) -> Rewritten:
    """The text without its disguises."""
    r = Rewritten(text)
    r.apply((m.start(), m.end(), [(_GLYPHS[m[0]], m.start(), m.end())] if m[0] in _GLYPHS else []) for m in _GLYPH.finditer(r.text))
    r.apply([(m.start(), m.end(), [(c, m.start(), m.end())]) for m in _ENTITY.finditer(r.text) if (c := _character(m))])
    r.apply([e for m in _SPELLED.finditer(r.text) if (e := _spelled_edit(m))])
    for pattern, char, meant in ((_AT, "@", None), (_MAYBE_AT, "@", _meant), (_DOT, ".", None)):
        r.apply([(m.start(), m.end(), [(char, m.start(), m.end())]) for m in pattern.finditer(r.text) if meant is None or meant(r.text, m)])
    r.apply(list(_dots_of(r.text)))
    return r


def all_spans(text: str, disguised: bool = True) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, all spans) of each kind; those that are added lie in no plain span, but may hold one.

    The whole text is rewritten, so an identifier is found whole however long
    it is. ``disguised=False`` is for a text that is known to hold no disguise.
    """
    base = plain_spans(text)
    every = {k: list(v) for k, v in base.items()}
    r = rewrite(text) if disguised else None
    if r is not None and r.text != text:
        for kind, find in _FIND.items():
            for span in find(r.text):
                x, y = r.source(span)
                i = bisect_right(base[kind], (x, len(text) + 1))  # plain spans do not overlap: the last from x or before
                if text[x:y] != r.text[span[0] : span[1]] and not (i and y <= base[kind][i - 1][1]):
                    every[kind].append((x, y))
    return base, {k: sorted(set(v)) for k, v in every.items()}


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), 64]] = True


def _loosely() -> str:
    """A pattern in Arrow's dialect, which knows no lookaround: it matches wherever ``_TRIGGER`` does, and elsewhere too."""
    space = r"\s\x0b\x1c-\x1f\x{85}\pZ"
    folded = lambda words: words.replace("i", "[iıİ]").replace("s", "[sſ]")  # noqa: E731 - as Python folds case
    word, sure, article, many, dot = (folded(w) for w in (_WORDS, _SURE, _ARTICLES_OR, "|".join(_TIMES), _OTHER_DOT))
    many = f"(?:{many})[{space}-]"
    gap = rf"[{space},-]{{0,2}}"
    glyphs = "".join(rf"\x{{{ord(c):x}}}" for c in (*_GLYPHS, *_UNSEEN))
    mark = rf"[\[({{<][{space}]?(?:at|@|\.|arroba|aroba[s\x{{17f}}]e|{dot})[{space}]?[\])}}>]|[{space}](?:arroba|aroba[s\x{{17f}}]e)[{space}]|_at_|&(?:#|commat|per|plu|lowbar|nb)"
    plain = rf"[{space}](?:at|@)[{space}][^\s.]+(?:\.|[{space}]\.[{space}])[^\s.]|@\S+[{space}](?:\.|{dot})[{space}]"
    # what is no letter or digit here is none for Python either
    begin, edge = r"(?:^|[^\pL])", r"[^\pL\pN]"
    pairs = rf"{begin}(?:(?:{sure}){gap}(?:{word}|[0-9]|{many})|(?:{article}){gap}(?:{sure}|{many})|{many}[{space}-]?(?:{word}|[0-9]))"
    digits = rf"{pairs}|[0-9]{gap}(?:{sure}|{many}|(?:{article}){gap}(?:{word}|[0-9]|{many}))|plu[s\x{{17f}}][{space},]+(?:[0-9]|{article})"
    return rf"(?i){digits}|(?:^|{edge})dot(?:$|{edge})|{mark}|{plain}|(?-i:[{glyphs}])"


_LOOSE = _loosely()


def cues(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per document, whether it has a digit or an @, and whether it has what any disguise has; block by block.

    Few texts match the loose pattern, which Arrow looks for much faster; only
    these are searched for the trigger itself.
    """
    column = texts_of(column)
    for first, data, bounds in byte_blocks(column):
        n = len(bounds) - 1
        plain = np.zeros(n, bool)
        plain[np.searchsorted(bounds, np.flatnonzero(_PLAIN[data]), "right") - 1] = True
        texts = column.slice(first, n)
        hidden = np.asarray(pc.match_substring_regex(texts, _LOOSE))
        hidden[hidden] = [_TRIGGER.search(t.as_py()) is not None for t in texts.filter(pa.array(hidden))]
        yield plain, hidden


def joined(spans: dict[str, list[Span]]) -> str:
    """kind:start:end of every span, by kind, then start."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The counts and the digest are of the plain spans, ``spans`` has all.
    Offsets are code points, ends exclusive. Null texts are empty, and empty
    ones have no spans; very long ones are read whole. Null ids and repeated
    rows are returned as given, an empty table gives an empty result, and other
    columns are ignored.
    """

    nothing = {k: [] for k in KINDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], texts_of(batch["text"])
            flags = [np.concatenate(x) for x in zip(*cues(texts), strict=True)] if batch.num_rows else ((), ())
            for text, plain, hidden in zip(texts, *flags, strict=True):
                base, every = all_spans(text.as_py(), hidden) if plain or hidden else (nothing, nothing)
                found = joined(base)
                n = [len(base[k]) for k in KINDS]
                rows.append((*n, hashlib.sha256(found.encode()).hexdigest(), joined(every), sum(map(len, every.values())) - sum(n)))
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one, by the kind of the first, then the longest."""
    _, every = all_spans(text)
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, v in every.items() for a, b in v), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
