"""Exact dedup: two Bloom passes choose the rows that have to meet.

Pass one hashes every text to a few cells of a bitmap and counts the cells;
the bitmap holds those hit more than once.  Pass two reads the texts again: a
row with a cell outside the bitmap is alone with its text and passes straight
through; only the others shuffle, by digest, to be grouped.  A larger input
makes the bounded bitmap denser, which sends more rows through the shuffle and
never changes the result.

Defined results: a null text equals an empty one.  Of equal texts one row is
`kept`, of rows that repeat the smallest doc_id too the first that was read.
A null doc_id is larger than any other.  without_copies decides for each row by
doc_id and text.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, written

#: Bits of the bitmap: 16 a row, within these bounds (the upper is 16 MB).
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
PROBES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _cells(text: Column, bits: int) -> list[Column]:
    """The cells of a text, from one 64-bit hash and its upper half."""
    h = F.xxhash64(text)
    first, step = F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))
    return [F.pmod(first + step * F.lit(i), F.lit(bits)).cast("long") for i in range(PROBES)]


def _has(bitmap: Column, cell: Column) -> Column:
    """Whether the bit of a cell is set in its 4 KB page."""
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(8)).cast("int"))
    return F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))


def bitmap(texts: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Pass one: the pages of the bitmap of cells that texts hit more than once, and its bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * texts.count()).bit_length()))
    hit = texts.select(F.explode(F.array(*_cells(F.col(text), bits))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    pages = hit.groupBy(F.bitmap_bucket_number("cell").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))
    return written(pages, "bloom"), bits


def suspected(rows: DataFrame, text: str, known: tuple[DataFrame, int]) -> DataFrame:
    """Pass two: rows with `__maybe`, false where the bitmap says that a text is alone."""
    (pages, bits), columns, maybe = known, rows.columns, F.lit(True)
    rows = rows.select("*", *[c.alias(f"__cell{i}") for i, c in enumerate(_cells(F.col(text), bits))])
    for i in range(PROBES):
        # At most MOST_BITS / 8 bytes, whatever the input.
        page = F.broadcast(pages.select(F.col("page").alias(f"__page{i}"), F.col("bitmap").alias(f"__bitmap{i}")))
        rows = rows.join(page, F.bitmap_bucket_number(f"__cell{i}") == F.col(f"__page{i}"), "left")
        maybe &= _has(F.col(f"__bitmap{i}"), F.col(f"__cell{i}"))
    return rows.select(*columns, maybe.alias("__maybe"))


def exact_groups(docs: DataFrame, known: tuple[DataFrame, int] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text); `known` is the bitmap of its texts."""
    docs = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    probed = suspected(docs, "text", known or bitmap(docs, "text")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("__maybe").alias("maybe"))
    # The number tells rows apart that are alike; stored, it is the same for every reader.
    probed = written(probed.withColumn("row", F.monotonically_increasing_id()), "probed")
    alone = probed.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    meet = probed.filter("maybe").select("doc_id", "text_sha256", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # Stored first: the join then shuffles for itself, and a group that holds a third of all rows is split among tasks.
    groups = written(meet.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    met = meet.join(groups, "text_sha256").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each text: that of the smallest doc_id, and of rows that repeat this too the one whose columns have the least hash.

    Rows that the bitmap knows to be alone pass by; only the others meet their groups.
    """
    by = ["__id", "__sha"]
    keyed = docs.withColumn("__text", normalised(F.col("text")))
    known = bitmap(keyed.select("__text"), "__text")
    # Stored first, for the same reason as the groups.
    groups = written(exact_groups(docs, known).filter("group_size > 1").select("doc_id", "text_sha256", "kept"), "repeated").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marks = written(groups.agg(F.bool_or("kept").alias("__kept"), F.count("*").alias("__times")).filter("not __kept or __times > 1").withColumnsRenamed({k: f"{k}_m" for k in by}), "marks")
    marked = suspected(keyed, "__text", known)
    keyed = marked.filter("__maybe").withColumns({"__id": F.col("doc_id"), "__sha": F.sha2("__text", 256)})
    same = F.col("__id").eqNullSafe(F.col("__id_m")) & (F.col("__sha") == F.col("__sha_m"))
    out = marked.filter(~F.col("__maybe")).select(*docs.columns).unionByName(keyed.join(marks, same, "left_anti").select(*docs.columns))
    tied = marks.filter("__kept")
    if tied.isEmpty():
        return out
    row = F.struct(*docs.columns)
    ones = keyed.join(tied, same, "left_semi").groupBy(*by).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
    return out.unionByName(ones.select("__row.*"))
