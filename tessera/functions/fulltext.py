"""Full-text pieces: tokens, stems, queries, cover density.

Tokenising and matching stay in the JVM.  A text's words are put together by
their numbers in Arrow batches.  Stems are looked up for distinct words only, by
a pandas UDF over the published Porter2 (English) rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.functions.text import col

# The English stop list of the full-text configuration.
ENGLISH_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now"
).split()


def _marked() -> tuple[str, str]:
    """Letters with marks and what they are without, by Unicode's decompositions; then the marks themselves, which go."""
    letters = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x2000)])]
    letters = [(c, d[0]) for c, d in letters if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    return "".join(c for c, _ in letters) + marks, "".join(d for _, d in letters)


MARKED, BARE = _marked()


def word_tokens(c: Column | str) -> Column:
    """Lower-case words of letters and digits, marks removed from letters."""
    # Texts of one byte a character have no marks.
    plain = F.when(F.length(col(c)) == F.octet_length(col(c)), F.lower(col(c))).otherwise(F.translate(F.lower(col(c)), MARKED, BARE))
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def places_by_word(rows: DataFrame, words: str = "words") -> DataFrame:
    """term and positions for each distinct word of each row's list of words, beside the row's other columns.

    Words are put together where their list is, so that nothing shuffles for
    each place of a word.
    """
    kept = [c for c in rows.columns if c != words]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(words)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            key = row * (len(flat.dictionary) + 1) + flat.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(at))
            one = pa.array(row[order[first]])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(one) for c in kept] + [flat.dictionary.take(flat.indices.take(pa.array(order[first]))), positions], [*kept, "term", "positions"])

    schema = StructType([rows.schema[c] for c in kept]).add("term", "string").add("positions", ArrayType(IntegerType()))
    return rows.select(*kept, words).mapInArrow(grouped, schema)


def postings(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """key, term, positions: an inverted index; with `stem`, stop words go and words become stems."""
    words = docs.select(key, F.posexplode(word_tokens(text)).alias("at", "word"))
    if stem:
        words = words.filter(~F.col("word").isin(ENGLISH_STOP))
        stems = words.select("word").distinct().withColumn("term", porter2_udf()("word"))
        words = words.join(stems, "word")
    else:
        words = words.withColumnRenamed("word", "term")
    # A document has no more positions than words.
    return words.groupBy(key, "term").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, docs, occurrences: in how many documents (key; null: none) a word is, and how often.

    Texts shuffle once, so that those of one key meet; words are added up where
    they are cut and shuffle as counts.
    """
    texts = docs.select(key, text).groupBy(key).agg(F.collect_list(text).alias("texts"))
    words = texts.select(key, F.flatten(F.transform("texts", word_tokens)).alias("words"))
    once = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.col(key).isNotNull().cast("long").alias("docs"), F.lit(0).cast("long").alias("n")))
    each = F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(0).cast("long").alias("docs"), F.lit(1).cast("long").alias("n")))
    return words.select(F.inline(F.concat(once, each))).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("occurrences"))


_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words whose stems the rules do not give.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def porter2(word: str) -> str:
    """The stem of a lower-case English word by the published Porter2 rules."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in _KEPT:
        return w
    if w.endswith(("eed", "eedly")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and re.search("[aeiouy]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif r1 >= len(w) and _short_syllable(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4] in "st":
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def porter2_udf():
    @F.pandas_udf("string")
    def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in words:
            yield batch.map(porter2)

    return stems


def lexemes(text: str) -> list[str]:
    """Stems of a query term, without stop words."""
    return [porter2(w) for w in words_of(text) if w not in ENGLISH_STOP]


def words_of(text: str) -> list[str]:
    """The same words as word_tokens, of a question."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


def any_or_all(terms: list[str], every: bool) -> list[list[str]] | None:
    """A query as groups of lexemes: a document has to hold each lexeme of every group, or of one group.

    Terms of stop words only are dropped; nothing left is None.
    """
    groups = [g for g in map(lexemes, terms) if g]
    if not groups:
        return None
    return [[x for g in groups for x in g]] if every else groups


def websearch(text: str, terms: Callable[[str], list[str]] | None = lexemes) -> tuple[list[list[list[str]]], list[list[str]]]:
    """(alternatives, excluded) of a search line: phrases in quotes, `or` between alternatives, a leading minus.

    `terms` says what words become; without it they stay words.
    """
    terms = terms or words_of
    alternatives: list[list[list[str]]] = [[]]
    excluded: list[list[str]] = []
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not minus and not quoted and plain.lower() == "or":
            alternatives.append([])
        elif phrase := terms(quoted or plain):
            (excluded if minus else alternatives[-1]).append(phrase)
    return [a for a in alternatives if a], excluded


def cover_density(positions: dict[str, list[int]], needed: list[str], weight: float = 0.1) -> float:
    """Rank by minimal covers: stretches that hold all needed lexemes and no shorter one inside.

    Each cover adds its weight over one plus the words between.
    """
    marks = sorted((p, t) for t in set(needed) for p in positions.get(t, []))
    if len({t for _, t in marks}) < len(set(needed)):
        return 0.0
    last: dict[str, int] = {}
    total, begun = 0.0, -1
    for at, term in marks:
        last[term] = at
        if len(last) == len(set(needed)):
            start = min(last.values())
            if start > begun:
                total += weight / (1 + (at - start) - (len(last) - 1))
                begun = start
    return total
