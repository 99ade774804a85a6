"""String functions as Column builders; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chain(c: Column | str, *steps: tuple[str, str]) -> Column:
    """Regex replacements one after another."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], F.lit(s[1])), steps, col(c))


BLANKS = " \t\n\x0b\f\r"


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once however often `then` mentions it."""
    return F.get(F.transform(F.array(value), then), 0)


def without_end(c: Column, sign: str) -> Column:
    """What stands before a sign that a string may end with."""
    return F.when(F.endswith(c, F.lit(sign)), F.left(c, F.length(c) - len(sign))).otherwise(c)


def rest_after(c: Column, sign: str) -> Column:
    """What follows a sign that a string may begin with, and white space behind it."""
    return F.when(F.startswith(c, F.lit(sign)), F.ltrim(F.substring(c, len(sign) + 1, 1 << 30), F.lit(BLANKS))).otherwise(c)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(col(c)) / 4).cast("int")


def snake(c: Column | str) -> Column:
    """lower_snake_case: apostrophes go, other runs of signs become one underscore."""
    return chain(F.lower(col(c)), ("['’]", ""), ("[^a-z0-9]+", "_"), ("^_+|_+$", ""))


def slug(c: Column | str) -> Column:
    """A safe part of a storage key: letters, digits and . ! _ - stay; nothing left gives x."""
    safe = chain(F.lower(col(c)), ("[^a-z0-9.!_-]+", "-"), ("^-+|-+$", ""))
    return F.when(safe == "", "x").otherwise(safe)


def storage_key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[slug(p) for p in parts])


def collapse(c: Column | str, most: int | None = None) -> Column:
    """White space squeezed to single spaces; with `most`, the first characters."""
    one = F.regexp_replace(col(c), r"\s+", " ")
    return F.substring(one, 1, most) if most else one


def clip(c: Column | str, n: int) -> Column:
    """At most n characters, the last an ellipsis where some were cut."""
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n - 1)), F.lit("…"))).otherwise(col(c))


def normal_fact(c: Column | str) -> Column:
    """What two facts have in common when they say the same: case, spacing and final stops do not count."""
    return F.trim(chain(F.lower(col(c)), (r"\s+", " "), (r"[.!\s]+$", "")))


# Words that say nothing about what to look up.
STOP_WORDS = (
    "a an the and or but if then so to of in on at by for with from into about as is are was were be been being am do does did done "
    "have has had i me my mine we us our you your yours he him his she her they them their it its this that these those there here what which "
    "who whom whose when where why how can could should would will shall may might must not no yes please tell show give find get let know "
    "any some all each every more most other just also very really now today up out over again want need like hey ok okay"
).split()


def keywords(c: Column | str, names: tuple[str, ...] = ()) -> Column:
    """Content words in order of appearance; `names` are further words to leave out, such as the assistant's."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'’-]*)"), F.lit(1))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "['’]s$", ""))
    stop = F.array(*[F.lit(w) for w in (*STOP_WORDS, *names)])
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two arrays of distinct words; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


# Entities that are read, in this order.
PAGE_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">"}
FRAGMENT_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _entities(c: Column, known: dict[str, str]) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), known.items(), c)


def _but_last(pieces: Column) -> Column:
    return F.slice(pieces, 1, F.size(pieces) - 1)


def _without_tags(c: Column, instead: Callable[[Column], Column]) -> Column:
    """Markup cut at the ends of its tags: of each piece the text before the tag, and what stands instead of this."""

    def text_of(piece: Column) -> Column:
        return bound(F.substring_index(piece, "<", 1), lambda before: bound(F.substring(piece, F.length(before) + 2, F.length(piece)), lambda tag: shown(piece, before, tag)))

    def shown(piece: Column, before: Column, tag: Column) -> Column:
        # Without a tag in front the sign is text.
        return F.when(F.length(tag) > 0, F.concat(before, instead(tag))).otherwise(F.concat(piece, F.lit(">")))

    return bound(F.split(c, ">", -1), lambda pieces: F.concat(F.array_join(F.transform(_but_last(pieces), text_of), ""), F.element_at(pieces, -1)))


def html_text(c: Column | str) -> Column:
    """Text of a page: no style blocks, lines broken at line and block ends, no tags, four entities read, two line ends in a row at most."""
    # Cut where style blocks begin, a piece goes on behind the end of its block.
    behind = lambda p: F.coalesce(F.get(F.split(p, "(?i)</style>", 2), 1), F.concat(F.lit("<style"), p))
    shown = bound(F.split(col(c), "(?i)<style", -1), lambda pieces: F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), behind), "")))

    def instead(tag: Column) -> Column:
        name = F.lower(tag)
        alone = F.rtrim(F.when(F.endswith(name, F.lit("/")), F.left(name, F.length(name) - 1)).otherwise(name), F.lit(BLANKS))
        return F.when(name.isin("/p", "/div") | (alone == "br"), "\n").otherwise("")

    text = _entities(_without_tags(shown, instead), PAGE_ENTITIES)
    return trimmed(F.regexp_replace(text, "\n\n\n+", "\n\n"))


def markup_text(c: Column | str) -> Column:
    """Text of a fragment of markup, six entities read."""
    return F.trim(_entities(_without_tags(col(c), lambda tag: F.lit("")), FRAGMENT_ENTITIES))


def html_tables(c: Column | str) -> Column:
    """array<array<array<string>>>: tables, rows, cells of a page."""
    tables = F.regexp_extract_all(col(c), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))
    return F.transform(tables, lambda t: F.transform(rows(t), lambda r: F.transform(cells(r), markup_text)))


def markdown_table(rows: Column) -> Column:
    """A markdown table of array<array<string>>: bars escaped, ragged rows padded, a rule under the first.

    Rows, width and lines are bound, so that the table is made once and not for each row.
    """
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    escaped = lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))

    def of_width(table: Column, width: Column) -> Column:
        padded = F.transform(table, lambda r: line(F.concat(F.transform(r, escaped), F.array_repeat(F.lit(""), width - F.size(r)))))
        return bound(padded, lambda lines: ruled(lines, line(F.array_repeat(F.lit("---"), width))))

    def ruled(lines: Column, rule: Column) -> Column:
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")

    return bound(rows, lambda table: bound(F.array_max(F.transform(table, F.size)), lambda width: of_width(table, width)))


# What an error's signature leaves out.
REQUEST_ID, HEX_WORD = "req_[A-Za-z0-9]+", "(?<![A-Za-z0-9_])[0-9A-Fa-f]{6,}(?![A-Za-z0-9_])"


def error_signature(source: Column | str, message: Column | str) -> Column:
    """Errors that differ in ids and numbers only have one signature: request ids and hexadecimal words go, other digits become one sign."""
    core = chain(message, (REQUEST_ID, ""), (HEX_WORD, ""), ("[0-9]+", "#"))
    return F.concat(col(source), F.lit(":"), F.substring(core, 1, 160))


def redact(c: Column | str, headers: dict[str, str]) -> Column:
    """Every header value, and the token of a bearer value, replaced."""
    out = col(c)
    for value in headers.values():
        out = F.replace(out, F.lit(value), F.lit("[redacted]"))
        if value.startswith("Bearer "):
            out = F.replace(out, F.lit(value.removeprefix("Bearer ").strip()), F.lit("[redacted]"))
    return out


def row_text(columns: list[str]) -> Column:
    """'name: value' of the columns that hold one."""
    return F.concat_ws("; ", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in columns])


def relative_segments(path: Column | str, root: str) -> Column:
    """Decoded folders of a path below a root; the root itself gives none, a path outside null."""
    wanted = [s for s in root.strip("/").split("/") if s]
    inside = F.element_at(F.split(col(path), "root:", 2), -1)
    # A plus sign is itself in a path.
    decoded = F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))
    parts = F.filter(F.split(decoded, "/"), lambda s: s != "")
    if not wanted:
        return parts
    head = F.slice(parts, 1, len(wanted))
    return F.when(head == F.array(*[F.lit(s) for s in wanted]), F.slice(parts, len(wanted) + 1, F.greatest(F.size(parts) - len(wanted), F.lit(0))))


def key_rules(c: Column | str) -> Column:
    """'name:key,name:key' as a map."""
    return F.str_to_map(F.regexp_replace(col(c), r"\s+", ""), F.lit(","), F.lit(":"))


# Commands that lose data for good, by pattern, first match first.
_SEGMENT = r"[^|;&\n]*"
DESTRUCTIVE = (
    (rf"(?i)\b(remove-item|rm|ri|del|erase|rd|rmdir)\b{_SEGMENT}\s(-r(ecurse)?\b|-rf\b|-fr\b|/s\b)", "Recursive delete"),
    (r"(?i)\|\s*(remove-item|rm|ri|del|erase)\b", "Delete of piped items"),
    (r"(?i)\b(format-volume|clear-disk|initialize-disk|remove-partition|diskpart)\b|(^|[\s;&|])format(\.com)?\s+[a-z]:", "Disk operation"),
    (r"(?i)\breg(\.exe)?\s+delete\b", "Registry delete"),
    (rf"(?i)\bremove-item(property)?\b{_SEGMENT}(\b(hklm|hkcu|hkcr|hku|hkcc):|registry::)", "Registry delete"),
    (rf"(?i)\bgit\b{_SEGMENT}\bpush\b{_SEGMENT}(\s--force(-with-lease)?\b|\s-f\b)", "Force push"),
    (rf"(?i)\bgit\b{_SEGMENT}\breset\b{_SEGMENT}--hard\b", "Hard reset"),
    (rf"(?i)\bgit\b{_SEGMENT}\bclean\b{_SEGMENT}\s-[a-z]*f", "git clean"),
    (r"(?i)\b(clear-recyclebin)\b|\bcipher(\.exe)?\s+/w\b", "Permanent erase"),
)
# Labels of buttons that pay, delete or send.
CLICKS = (
    (r"(?i)\b(pay( now)?|purchase|buy now|place (your )?order|checkout|check out|transfer( funds)?|confirm payment|submit payment|approve payment)\b", "Pay"),
    (r"(?i)\b(delete|remove|trash|discard|erase|permanently)\b", "Delete"),
    (r"(?i)\b(send|post|publish|reply( all)?|forward|share|invite)\b", "Send"),
)


def first_label(c: Column | str, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern found, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(F.rlike(col(c), F.lit(pattern)), label).otherwise(out)
    return out


def destructive_reason(c: Column | str) -> Column:
    return first_label(c, DESTRUCTIVE)


def click_risk(c: Column | str) -> Column:
    return first_label(c, CLICKS)
