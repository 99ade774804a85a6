"""A trie of the prefixes that conversations share, in preorder intervals.

A turn is a digest of its role and text; a node is a sequence of digests.  The
distinct conversations are ranked in the order of their digests, in which all
that pass through a node lie side by side, so that a node is the interval of
ranks of its members and a depth.  In the order of (first rank, depth), which is
the preorder, a subtree is an interval of nodes too: it ends with the last node
of the node's last rank.  Running sums over that order give leaves and savings
of every subtree as differences.

Nothing needs a whole conversation in one task: turns are numbered in a
range-sorted table with an offset for each of its parts; a conversation is ranked
by blocks of BLOCK turns, then by BLOCK ranks at a time; a prefix is known by the
exclusive or of two 64-bit hashes of its (place, digest) pairs, block by block.
Ranks and running sums are taken within range parts and shifted by the parts
before.  Digests have 128 bits; equality of turns and prefixes rests on them.

Defined results: rows without conv_id belong to no conversation and are left
out.  Null roles and texts are empty ones.  Turns come first where null; turns
that tie go by digest.  c%20 has the sign of c.  An empty table gives no nodes.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, parts_for, written
from tessera.llm.pieces import hashed

#: Turns of a block, and ranks of a block of a block.
BLOCK = 256
#: Members' ids are joined in runs of as many neighbouring numbers, by a power of two.
RUN_BITS = 12
#: Bits of a row's number within its part in monotonically_increasing_id().
PART_BITS = 33
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digest(role: Column, text: Column) -> Column:
    """128 bits of both, in hexadecimal digits."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def _in_order(rows: DataFrame, by: list[Column], parts: int, name: str) -> DataFrame:
    """The rows stored with `at`, a number that follows their order."""
    return written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), name)


def placed(conversations: DataFrame, parts: int) -> DataFrame:
    """conv_id, place (from 1), digest, words of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = _in_order(turns, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()], parts, "turns").withColumn("part", F.shiftright("at", PART_BITS))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return turns.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "digest", "words")


def shared_head(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose first turns open this one, and how many."""
    return conv_id - conv_id % 20, F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, digest, words of rebuilt conversations; place 0 of each is the root's."""
    base, head = shared_head(F.col("conv_id"))
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    of = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = lengths.select("conv_id", base.alias("base"), head.alias("head")).join(of, "base", "left")
    convs = convs.select("conv_id", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken"))
    own = turns.join(convs, "conv_id").filter("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("pos"), "digest", "words")
    # Three turns at most of a conversation, which at most 39 others open with.
    heads = turns.filter((F.col("conv_id") % 20 == 0) & (F.col("place") <= 3)).withColumnRenamed("conv_id", "base")
    opened = convs.join(heads, "base").filter("place <= taken").select("conv_id", F.col("place").alias("pos"), "digest", "words")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(opened).unionByName(roots)


def ranks(blocks: DataFrame, parts: int) -> DataFrame:
    """conv_id, rank: equal for equal conversations, in the order of their digests.

    A block's key are its digests; a conversation of several blocks is then a
    sequence of ranks, which are digests of the next round.
    """
    names = blocks.select("conv_id", "block", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"))
    most = blocks.agg(F.max("block")).first()[0] or 0
    while True:
        keys = _in_order(names.select("key").distinct(), [F.col("key").asc()], parts, "keys").withColumnRenamed("at", "rank")
        named = names.join(keys, "key").select("conv_id", "block", "rank")
        if not most:
            return written(named.select("conv_id", "rank"), "ranks")
        most //= BLOCK
        ranked = F.struct("block", F.lpad(F.hex("rank"), 16, "0").alias("name"))
        names = named.groupBy("conv_id", F.floor(F.col("block") / BLOCK).alias("upper")).agg(F.sort_array(F.collect_list(ranked)).alias("names"))
        names = names.select("conv_id", F.col("upper").alias("block"), F.array_join(F.transform("names", lambda x: x["name"]), "").alias("key"))


def members(ranked: DataFrame) -> DataFrame:
    """rank and the hash of the ids of its conversations in order."""
    runs = ranked.groupBy("rank", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return hashed(runs.select(F.col("rank").alias("key"), F.col("run").alias("at"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("piece")), ",")


def nodes(blocks: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a node: depth, (a, b) and its parent's (up_a, up_b), ranks from lo to hi, conv_id, n_convs, words."""
    one = ranked.groupBy("rank").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    # Two hashes of a turn's place and digest; the root's are 0.
    lane = lambda t, seed: F.when(t["pos"] == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), t["pos"], t["digest"]))
    turns = F.transform("turns", lambda t: F.struct(t["pos"].alias("pos"), t["words"].alias("words"), lane(t, 1).alias("a"), lane(t, 2).alias("b")))
    own = blocks.join(one, "conv_id").select("conv_id", "rank", "n", "block", turns.alias("turns"))
    folded = lambda c: F.aggregate("turns", F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[c]))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"before_{c}": F.coalesce(F.bit_xor(folded(c)).over(before), F.lit(0)) for c in "ab"})
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flat = own.select("conv_id", "rank", "n", "block", "before_a", "before_b", F.inline("turns").alias("pos", "words", "own_a", "own_b"))
    flat = flat.withColumns({c: F.bit_xor(f"own_{c}").over(upto).bitwiseXOR(F.col(f"before_{c}")) for c in "ab"})
    flat = flat.withColumns({f"up_{c}": F.col(c).bitwiseXOR(F.col(f"own_{c}")) for c in "ab"})
    kept = [F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), *[F.max(c).alias(c) for c in ("words", "up_a", "up_b")]]
    return written(flat.groupBy(F.col("pos").alias("depth"), "a", "b").agg(*kept), "nodes")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end of every node."""
    parts = parts_for(conversations, factor=1)
    turn = F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns")
    blocks = written(rebuilt(placed(conversations, parts)).groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(turn), "blocks")
    ranked = ranks(blocks, parts)
    found = nodes(blocks, ranked)

    above = found.select(F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    kids = found.filter("depth > 0").groupBy(F.col("depth") - 1, "up_a", "up_b").agg(F.count("*").alias("n_children")).toDF("depth", "a", "b", "n_children")
    known = found.join(kids, ["depth", "a", "b"], "left").withColumn("up_depth", F.col("depth") - 1)
    known = known.join(above, ["up_depth", "up_a", "up_b"], "left").fillna(0, ["n_children"]).withColumn("part", F.shiftright("lo", PART_BITS))

    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    order = Window.partitionBy("part").orderBy("lo", "depth")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumns({"leaf": leaf, "saved": saved})
    sums = {"at": F.row_number().over(order).cast("long"), "leaves_to": F.sum("leaf").over(upto), "saved_to": F.sum("saved").over(upto)}
    numbered = written(known.withColumns(sums | {"ends": ~F.lead("lo").over(order).eqNullSafe(F.col("lo"))}), "preorder")
    # One row a part.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy("part").agg(F.count("*").alias("at"), F.sum("leaf").alias("leaves_to"), F.sum("saved").alias("saved_to"))
    shifts = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("at", "leaves_to", "saved_to")])
    numbered = numbered.join(F.broadcast(shifts), "part").withColumns({c: F.col(c) + F.col(f"{c}_before") for c in ("at", "leaves_to", "saved_to")})

    last = numbered.filter("ends").select(F.col("lo").alias("hi"), F.col("at").alias("subtree_end"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"))
    joined = numbered.join(last, "hi").join(members(ranked).toDF("lo", "sha256"), "lo", "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.when(F.col("ends"), F.col("sha256")).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        F.col("at").alias("preorder"),
        "subtree_end",
    )
