"""Personal data in text, also where it is disguised.

Plain identifiers are found by their grammar.  A transducer then rewrites the
text: look-alike letters and digits of other scripts to ASCII, spelled digits
to digits, "at" and "dot" disguises to the signs.  It keeps, for every
character it writes, the source span that it stands for, so what the same
grammar finds in the rewritten text maps back to offsets of the source.

Defined results: a null or empty text has no spans.  Offsets count code points
and ends are exclusive.  Plain spans always stay; a disguised one is added only
where no plain span of its kind overlaps.  Every row gives a row, repeated ones
too; no rows give none.  Other columns are not read.  The time grows with the
length of a text, not with its square.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match never starts inside a run of digits, hence the look behind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by the grammar alone, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# Letters of other scripts and the ASCII ones they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
}
# Characters without width.
WIDTHLESS = "­​‌‍⁠﻿"
# Spelled digits in the languages of the corpus.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
FOREIGN = re.compile(r"[­Ͱ-ԯ٠-٩۰-۹०-९​-‍⁠﻿！-～\U0001d400-\U0001d7ff]")
_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: Three spelled digits in a row; a plus may lead.
RUN = rf"(?<![^\W_])(?:plus[ ,.-]{{1,3}})?{_DIGIT}(?:[ ,.-]{{1,3}}{_DIGIT}){{2,}}(?![^\W_])"
_OPEN, _CLOSE = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|(?:[ \t]{{1,3}}|[_-])dot(?:[ \t]{{1,3}}|[_-]))"
#: A domain whose dots are plain or disguised, with letters at the end.
_NAMED = rf"(?:[A-Za-z0-9-]{{1,63}}(?:\.|{_DOT})){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])"
#: A bare "at" counts only before a name whose dot is disguised as well, or before such a domain.
_SIGNS = (
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9])(?:[ \t]{{1,3}}|[_-])at(?:[ \t]{{1,3}}|[_-])(?=[A-Za-z0-9-]{{1,64}}{_DOT}[A-Za-z0-9]|{_NAMED}))|(?P<dot>{_DOT}(?=[A-Za-z0-9]))|(?P<digit>(?<=[0-9])[OoIl](?=[0-9]))"
)
DISGUISE = re.compile(rf"(?P<octets>(?!))|(?P<run>{RUN})|{_SIGNS}", re.IGNORECASE)
#: The same where spelled and written digits mix: two in a row, and four octets between dots.
_ITEM = rf"(?:{_DIGIT}|[0-9]{{1,19}})"
_OCTET = rf"{_ITEM}(?:[ ,-]{{1,3}}{_ITEM}){{0,2}}"
MIXED = re.compile(
    rf"(?P<octets>(?<![^\W_]){_OCTET}(?:(?:{_DOT}|\.){_OCTET}){{3}}(?![^\W_]))|(?P<run>(?<![^\W_])(?:plus[ ,.-]{{1,3}})?{_ITEM}(?:[ ,.-]{{1,3}}{_ITEM})+(?![^\W_]))|{_SIGNS}",
    re.IGNORECASE,
)
#: Where they can mix: a written digit before or behind a spelled one.
BESIDE = re.compile(rf"[0-9][ ,.-]{{1,3}}{_DIGIT}(?![^\W_])|[ ,.-](?=[ ,.-]{{0,2}}[0-9])(?:" + "|".join(rf"(?<={w}[ ,.-])" for w in SPELLED) + ")|dot[^A-Za-z0-9]", re.IGNORECASE)
#: What every sign of DISGUISE holds; a text without it and without three spelled digits in a row has nothing disguised.
SIGN = re.compile(
    rf"[\[({{<][ \t]{{0,3}}(?:at|@|dot|\.)[ \t]{{0,3}}[\])}}>]|[ \t_-]at(?:[ \t]{{1,3}}|[_-])[A-Za-z0-9-]{{1,64}}(?:\.|{_DOT})[A-Za-z0-9-]|[ \t_-]dot(?:[ \t]{{1,3}}|[_-])[A-Za-z0-9]|[0-9][OoIl][0-9]",
    re.IGNORECASE,
)
#: Characters that count as others when case does not.
FOLDED = re.compile("[\u017f\u0130\u0131\u212a]")
WORDS = re.compile(r"[^\W_]+")
TOKEN = re.compile(rf"plus|{_DIGIT}|[0-9]+|[ ,.-]+", re.IGNORECASE)
OCTETS = re.compile(rf"(?P<dot>{_DOT}|\.)|{_DIGIT}|[0-9]+", re.IGNORECASE)


def _letter(c: str) -> str:
    if c in WIDTHLESS:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide < "\x7f" else c


def disguised(text: str) -> bool:
    """Whether DISGUISE can match: false only where it cannot."""
    if SIGN.search(text) or FOLDED.search(text):
        return True
    words = WORDS.findall(text.lower())
    if not SPELLED.keys() & set(words):
        return False
    run = 0
    for word in words:
        run = run + 1 if word in SPELLED else 0
        if run == 3:
            return True
    return False


class Rewritten:
    """Text after the transducer, with the source span of each of its pieces."""

    def __init__(self, text: str, disguise: re.Pattern = DISGUISE) -> None:
        self.changed = False
        self.text = text
        self._at: list[int] | None = None
        self._found: list[tuple[int, int, int]] | None = None
        if FOREIGN.search(text):
            pieces, at = [], []
            for i, c in enumerate(text):
                new = _letter(c) if c > "\x7f" else c
                if new:
                    pieces.append(new)
                    at.append(i)
            at.append(len(text))
            self._at, self.text, self.changed = at, "".join(pieces), True
        #: (where in the new text, where in the old, whether its characters stand one for one)
        self._steps: list[tuple[int, int, bool]] = []
        pieces, done, length = [], 0, 0

        def put(piece: str, source: int, same: bool) -> None:
            nonlocal length
            if piece:
                self._steps.append((length, source, same))
                pieces.append(piece)
                length += len(piece)

        old = self.text
        for m in disguise.finditer(old) if disguise is not DISGUISE or disguised(old) else ():
            put(old[done : m.start()], done, True)
            if m["octets"]:
                for t in OCTETS.finditer(m[0]):
                    put("." if t["dot"] else SPELLED.get(t[0].lower(), t[0]), m.start() + t.start(), t[0].isdigit())
                    end = m.start() + t.end()
                self._steps.append((length, end, True))
            elif m["run"]:
                last = "plus"  # no blank before the first digit
                for t in TOKEN.finditer(m[0]):
                    word = t[0].lower()
                    new = word if word.isdigit() else "+" if word == "plus" else SPELLED.get(word) or ("" if last == "plus" else " ")
                    put(new, m.start() + t.start(), word.isdigit())
                    last = word
            else:
                put("@" if m["at"] else "." if m["dot"] else "0" if m[0] in "Oo" else "1", m.start(), False)
            done = m.end()
        if done:
            put(old[done:], done, True)
            self.text, self.changed = "".join(pieces), True
        self._steps.append((length if done else len(old), len(old), False))
        self._plain = not done

    def spans(self) -> list[tuple[int, int, int]]:
        """What the grammar finds in the new text."""
        if self._found is None:
            self._found = plain(self.text)
        return self._found

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that [start, end) of the new text stands for."""
        if not self._plain:
            i = bisect_right(self._steps, start, key=lambda s: s[0]) - 1
            j = bisect_right(self._steps, end - 1, key=lambda s: s[0]) - 1
            a, b = self._steps[i], self._steps[j]
            start = a[1] + (start - a[0] if a[2] else 0)
            end = b[1] + end - b[0] if b[2] else self._end(j)
        if self._at is not None:
            start, end = self._at[start], self._at[end - 1] + 1
        return start, end

    def _end(self, j: int) -> int:
        """Where a rewritten piece ends in the source: where the next one begins."""
        return self._steps[j + 1][1]


def find(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind's number, end, whether plain), in order."""
    if not text:
        return []
    base = plain(text)
    new = Rewritten(text)
    rewritten = [new] if new.changed else []
    if BESIDE.search(text) or new.changed and BESIDE.search(new.text):
        rewritten.append(Rewritten(text, MIXED))
    if not rewritten:
        return [(*x, True) for x in base]
    added = []
    for kind in range(len(KINDS)):
        own = Apart([(a, b) for a, k, b in base if k == kind])
        kept: list[tuple[int, int]] = []
        for new in rewritten:
            found = sorted({new.source(a, b) for a, k, b in new.spans() if k == kind})
            kept = longer(kept, [x for x in found if not own.touched(*x)])
        added += [(a, kind, b, False) for a, b in kept]
    return sorted([(*x, True) for x in base] + added)


class Apart:
    """Spans in order that do not overlap."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans, self.starts, self.ends = spans, [a for a, _ in spans], [b for _, b in spans]

    def touched(self, start: int, end: int) -> list[tuple[int, int]]:
        """Those that overlap [start, end)."""
        return self.spans[bisect_right(self.ends, start) : bisect_left(self.starts, end)]


def longer(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both lists in one; of spans that overlap the longer stays, of equal ones the old."""
    among, gone, out = Apart(old), set(), []
    for start, end in new:
        rivals = [x for x in among.touched(start, end) if x not in gone]
        if all(b - a < end - start for a, b in rivals):
            gone.update(rivals)
            out.append((start, end))
    return sorted([x for x in old if x not in gone] + out)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every row of docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": p} for a, k, b, p in find(text.as_py())] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the plain spans, and all spans as one string."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
