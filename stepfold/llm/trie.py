"""Prefix trie of conversations by prefix doubling.

Turns get dense names, one for each distinct (role, text). Blocks of 2, 4, 8, ... turns at multiples of their length
get dense names by joins of (left name, right name) with the distinct pairs, so the rounds are as many as the longest
conversation has binary digits. A prefix of d turns is a row of blocks, one for each binary digit of d that is set, and
the names of these blocks are its name. Prefixes with one name are one node of the trie; the smallest conversation id
among them, with d, identifies it. Sums over subtrees need no descent: a node lies below another exactly if its smallest
member does, so they are suffix sums along each conversation, added up by node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.common import cut, numbered

STRETCH = 1024  #: turns that one window sums; longer conversations are summed by stretches
PIECE = 1 << 12  #: conversation ids that are joined to one piece of text before they meet


def named(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`rows` with one more column: a dense number for each distinct value of the keys, which are not null."""
    names = numbered(rows.select(*keys).distinct(), column)
    return rows.join(names, keys)


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, name, size) for each turn and (conv_id, start, n) for each conversation.

    Turns stand by `turn` (null first), then role, then text; repeated turns repeat. Null roles and texts are empty;
    size is the text's length in bytes. Rows without conv_id are in no conversation and are left out, as are other
    columns. Equal SHA-256 digests are taken as equal turns. Places come from one range partitioning, so a conversation
    may span many tasks.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    # beginnings of role and text spread the turns that have one number; their order is that of the whole strings
    spread = said.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest")
    rows = numbered(spread.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", digest, F.octet_length("text").cast("long").alias("size")), "at")
    convs = cut(rows.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")))
    return named(rows, ["digest"], "name").drop("digest"), convs


def respliced(turns: DataFrame, convs: DataFrame, donor: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `head` turns are replaced by as many of their donor's, or all of them if it has fewer,
    or none if there is no such conversation. `donor` and `head` are columns of the conversation's id; `turns` and
    `convs` as from `placed_turns`. Returns (conv_id, at, n, name, size) and (conv_id, n)."""
    asked = convs.select("conv_id", "start", "n", donor.alias("donor"), head.cast("long").alias("head"))
    given = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    k = F.least("head", F.coalesce("has", F.lit(0)))
    made = asked.join(given, "donor", "left").withColumn("k", k).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    made = cut(made)
    found = cut(turns.join(made.select("conv_id", "start", "head", "k", "length"), "conv_id").withColumn("at", F.col("at") - F.col("start")))
    own = found.where("at >= head").select("conv_id", (F.col("at") - F.col("head") + F.col("k")).alias("at"), F.col("length").alias("n"), "name", "size")
    wanted = made.where("k > 0").select("conv_id", "donor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("at"), F.col("length").alias("n"))
    lent = found.select(F.col("conv_id").alias("donor"), "at", "name", "size")
    return own.unionByName(wanted.join(lent, ["donor", "at"]).drop("donor")), made.select("conv_id", F.col("length").alias("n"))


def prefixes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(conv_id, depth, n, size, names of blocks) for each prefix of each conversation, the empty one too, and the
    columns of the names; a name is -1 where the depth has no such block."""
    blocks = turns.select("conv_id", F.col("at").alias("block"), "n", "name")
    longest = convs.agg(F.max("n")).first()[0] or 0
    columns = [f"b{k}" for k in range(max(longest.bit_length(), 1))]
    size = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "n", F.lit(-1).alias("k"), F.lit(-1).cast("long").alias("name"), "size")
    parts = [size]
    for k in range(len(columns)):
        if k:
            side = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
            pairs = blocks.groupBy("conv_id", F.expr("block div 2").alias("half")).agg(F.max("n").alias("n"), side(0).alias("a"), side(1).alias("b"))
            pairs = named(pairs.where("a is not null and b is not null"), ["a", "b"], "name")
            blocks = cut(pairs.select("conv_id", F.col("half").alias("block"), "n", "name"))
        # the block ends the prefixes whose digits from k upwards are those of its end; only even blocks do
        begin = (F.col("block") + 1) * (1 << k)
        depths = F.explode(F.sequence(begin, F.least(begin + ((1 << k) - 1), F.col("n"))))
        parts.append(blocks.where("block % 2 = 0").select("conv_id", depths.alias("depth"), "n", F.lit(k).alias("k"), "name", F.lit(0).cast("long").alias("size")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    name = [F.max(F.when(F.col("k") == k, F.col("name")).otherwise(-1)).alias(c) for k, c in enumerate(columns)]
    long = every.groupBy("conv_id", "depth").agg(F.max("n").alias("n"), F.max("size").alias("size"), *name)
    zero = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("size"), *[F.lit(-1).cast("long").alias(c) for c in columns])
    return cut(long.unionByName(zero)), columns


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, n, node, n_convs, ends, size): the node of each prefix of each conversation.

    A node is its smallest member at that depth; n_convs members, of which `ends` have no further turn.
    """
    rows, names = prefixes(turns, convs)
    nodes = rows.groupBy("depth", *names).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum((F.col("n") == F.col("depth")).cast("long")).alias("ends"))
    # written, so that both sides of the join are shuffled and a node that holds many prefixes is split
    return cut(rows.join(cut(nodes), ["depth", *names]).select("conv_id", "depth", "n", "node", "n_convs", "ends", "size"))


def _from_here_on(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with the sums of the columns over this and all greater depths of a conversation, by stretches."""
    rows = rows.withColumn("stretch", F.expr(f"depth div {STRETCH}"))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(c) for c in columns])
    after = totals.select("conv_id", "stretch", *[F.sum(c).over(later).alias(f"{c}_after") for c in columns]).where(f"{columns[0]}_after is not null")
    both = rows.withColumns({c: F.sum(c).over(within) for c in columns}).join(after, ["conv_id", "stretch"], "left")
    return both.withColumns({c: F.col(c) + F.coalesce(f"{c}_after", F.lit(0)) for c in columns}).drop("stretch", *[f"{c}_after" for c in columns])


def nodes(found: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) for each node of `members`; the root
    has no parent. saved_tokens counts, over the subtree, the bytes of a node's last turn once for each member but one."""
    first = F.col("conv_id") == F.col("node")
    saved = F.when(first, (F.col("n_convs") - 1) * F.col("size")).otherwise(0)
    leaf = (first & (F.col("ends") == F.col("n_convs"))).cast("long")
    sums = _from_here_on(found.select("conv_id", "depth", "node", "n_convs", saved.alias("saved"), leaf.alias("leaf")), "saved", "leaf")
    below = sums.groupBy("node", "depth").agg(F.max("n_convs").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    up = found.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    linked = cut(below.join(up, ["node", "depth"], "left"))
    children = linked.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return linked.join(children, ["node", "depth"], "left").select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens")


def ends_digest(found: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) for each node where conversations end: SHA-256 of their ids, ascending, in decimal
    and joined by commas. Ids are joined to pieces where they are sorted; a node's pieces are hashed as a stream."""
    ended = found.where("depth = n").select("node", "depth", "conv_id")
    spread = ended.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")

    def pieces(batches):
        for b in batches:
            node, depth, conv = (b.column(i).to_pylist() for i in range(3))
            out, at = ([], [], [], []), 0
            for i in range(1, len(node) + 1):
                if i == len(node) or i - at == PIECE or (node[i], depth[i]) != (node[at], depth[at]):
                    for c, v in zip(out, (node[at], depth[at], conv[at], ",".join(map(str, conv[at:i])))):
                        c.append(v)
                    at = i
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["node", "depth", "first", "piece"])

    def digests(batches):
        key, sha = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

        for b in batches:
            ready = []
            for node, depth, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (node, depth):
                    sha.update(b"," + piece.encode())
                    continue
                if key is not None:
                    ready.append((*key, sha.hexdigest()))
                key, sha = (node, depth), hashlib.sha256(piece.encode())
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ready)], names=["conv_id", "depth", "ends_sha256"])
        if key is not None:
            yield done()

    joined = spread.mapInArrow(pieces, "node long, depth long, first long, piece string")
    return joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")
