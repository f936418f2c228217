"""Merkle manifest of a dataset: every row a leaf, a tree for each group, one root over the groups' roots, a proof a row.

A fragment is the sparse forest over some leaves: its unresolved nodes, keyed by tree, level and index. Two fragments
merge by union; a sibling run whose members are all there becomes its parent. How many members a run has follows from
the number of leaves alone, so merging is associative and commutative, and neighbouring leaves leave less than two runs
a level. Chunks of leaves make the first fragments; rounds of grouping, 16 neighbours at a time, reduce them to the
roots. Proofs go the same way down: each round hands the paths of what it left unresolved to what it was given.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import broadcast_if, cut, numbered

ARITY = 8
CHUNK = 1 << 13  #: leaves of the first fragments
FAN_IN = 16  #: neighbouring fragments that a task merges
FEW_GROUPS = 10_000  #: groups that are broadcast, at most: a name and two numbers each

PATH = "array<struct<left:string,right:string>>"
NODE = "fragment long, tree long, leaves long, level int, place long, digest string, top boolean"


def leaf_of(*values: Column) -> Column:
    """Digest of a row: each value is `-` if null, else its UTF-8 length, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, run by run, lead to."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one string, run by run and left to right."""
    return F.concat_ws("", F.transform(proof, lambda p: F.concat(p["left"], p["right"])))


def width(leaves: int, level: int, arity: int) -> int:
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


def complete(nodes: Iterable[tuple[int, int, int, int, str]], arity: int = ARITY) -> tuple[list[tuple], dict[tuple[int, int, int], list[str]]]:
    """Merges nodes (tree, leaves of the tree, level, place, digest).

    Returns what stays unresolved, each with whether it is its tree's root, and the runs that came together: digests by
    (tree, level and place of the parent).
    """
    trees: dict = defaultdict(lambda: defaultdict(dict))
    for tree, leaves, level, place, digest in nodes:
        trees[tree, leaves][level][place] = digest
    unresolved, made = [], {}
    for (tree, leaves), levels in sorted(trees.items()):
        level, wide = 0, leaves
        while levels:
            here, runs = levels.pop(level, {}), defaultdict(list)
            for place in sorted(here):
                runs[place // arity].append(place)
            for parent, places in runs.items():
                if wide > 1 and len(places) == min(arity, wide - arity * parent):
                    made[tree, level + 1, parent] = run = [here[p] for p in places]
                    levels[level + 1][parent] = hashlib.sha256("".join(run).encode()).hexdigest()
                else:
                    unresolved += [(tree, leaves, level, p, here[p], wide == 1) for p in places]
            level, wide = level + 1, -(-wide // arity)
    return unresolved, made


def climb(made: dict, tree: int, level: int, place: int, arity: int = ARITY) -> tuple[list[dict[str, str]], tuple[int, int, int]]:
    """The siblings of a node in the runs of `made`, from below, and the node at which they end."""
    path = []
    while (run := made.get((tree, level + 1, place // arity))) is not None:
        at = place % arity
        path.append({"left": "".join(run[:at]), "right": "".join(run[at + 1 :])})
        level, place = level + 1, place // arity
    return path, (tree, level, place)


def _columns(table: pa.Table, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


def _trees(rows: DataFrame, arity: int) -> list[DataFrame]:
    """Nodes by round: those of the chunks' fragments, then what each round of merging left of them."""
    schema = pa.schema([("fragment", pa.int64()), ("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("top", pa.bool_())])

    def left(fragment: int, nodes) -> pa.Table:
        unresolved, _ = complete(nodes, arity)
        rows = [[fragment] * len(unresolved), *([list(c) for c in zip(*unresolved)] or [[]] * 6)]
        return pa.table(rows, schema=schema)

    def first(key, table):
        tree, leaves, place, digest = _columns(table, "tree", "leaves", "place", "digest")
        return left(key[0].as_py(), zip(tree, leaves, [0] * len(tree), place, digest))

    def merge(key, table):
        return left(key[0].as_py(), zip(*_columns(table, "tree", "leaves", "level", "place", "digest")))

    rounds = [cut(rows.select("fragment", "tree", "leaves", "place", "digest").groupBy("fragment").applyInArrow(first, NODE))]
    while (rounds[-1].where("not top").agg(F.max("fragment")).first()[0] or 0) > 0:
        wider = rounds[-1].where("not top").withColumn("fragment", F.expr(f"fragment div {FAN_IN}"))
        rounds.append(cut(wider.groupBy("fragment").applyInArrow(merge, NODE)))
    return rounds


def manifest(leaves: DataFrame, group: str | None, order: list[str], digest: str = "leaf", arity: int = ARITY) -> DataFrame:
    """`leaves` with subroot, root and proof, an array of (left, right): the digests beside the row's own ancestor in
    each run up to the root, concatenated.

    The leaves of a group stand by `order` (nulls first), then by digest, so rows with equal digests may change places
    and nothing else; groups stand by name, a null group first and on its own. A group of one leaf is that leaf, runs
    of one are hashed too. Other columns pass through; own columns named subroot, root or proof are replaced. An empty
    table gives an empty one.
    """
    rest = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "proof")]
    by = [(F.col(group) if group else F.lit(0)).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(digest, F.lit("")).alias("digest")]
    names = ["g", *[f"o{i}" for i in range(len(order))], "digest"]
    rows = leaves.select(*by, F.struct(*rest).alias("row"))
    placed = numbered(rows.repartitionByRange(*names).sortWithinPartitions(*names).select("g", "digest", "row"), "at")
    trees = cut(placed.groupBy(F.col("g").alias("name")).agg(F.min("at").alias("tree"), F.count("*").alias("leaves")))
    found = placed.join(broadcast_if(trees, trees.count() <= FEW_GROUPS), placed["g"].eqNullSafe(trees["name"]))
    dealt = found.select(F.expr(f"at div {CHUNK}").alias("fragment"), "tree", "leaves", (F.col("at") - F.col("tree")).alias("place"), "digest", "row")
    rounds = _trees(dealt, arity)

    roots = rounds[0].where("top").select("tree", "digest")
    for nodes in rounds[1:]:
        roots = roots.union(nodes.where("top").select("tree", "digest"))
    if group:
        above = manifest(roots, None, ["tree"], "digest", arity).select("tree", F.col("digest").alias("subroot"), "root", F.col("proof").alias("path"))
    else:
        above = roots.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    above = cut(above)

    told = "path " + PATH + ", subroot string, root string"

    def hand_down(nodes: pa.Table, level, paths: pa.Table):
        """For each given node its whole path: within the fragment first, then that of the node where this ends."""
        _, made = complete(zip(*_columns(nodes, "tree", "leaves"), level, *_columns(nodes, "place", "digest")), arity)
        known = {(t, v, p): rest for t, v, p, *rest in zip(*_columns(paths, "tree", "level", "place", "path", "subroot", "root"))}
        for tree, lev, place in zip(nodes.column("tree").to_pylist(), level, nodes.column("place").to_pylist()):
            path, end = climb(made, tree, lev, place, arity)
            beyond, subroot, root = known[end]
            yield path + beyond, subroot, root

    path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def with_paths(columns: dict, given) -> pa.Table:
        path, subroot, root = (list(c) for c in zip(*given))
        return pa.table(columns | {"path": pa.array(path, path_type), "subroot": pa.array(subroot, pa.string()), "root": pa.array(root, pa.string())})

    def down(key, nodes, paths):
        own = {n: nodes.column(n) for n in ("fragment", "tree", "level", "place")}
        return with_paths(own, hand_down(nodes, nodes.column("level").to_pylist(), paths))

    def last(key, nodes, paths):
        return with_paths({"row": nodes.column("row")}, hand_down(nodes, [0] * nodes.num_rows, paths))

    ends = lambda nodes: nodes.where("top").join(above, "tree").select("fragment", "tree", "level", "place", "path", "subroot", "root")
    paths = ends(rounds[-1])
    for nodes in reversed(rounds[:-1]):
        wider = nodes.where("not top").select("fragment", "tree", "leaves", "level", "place", "digest", F.expr(f"fragment div {FAN_IN}").alias("wider"))
        handed = wider.groupBy("wider").cogroup(paths.groupBy("fragment")).applyInArrow(down, "fragment long, tree long, level int, place long, " + told)
        paths = cut(handed).union(ends(nodes))
    told_rows = dealt.select("row", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.lit("").alias("root")).schema
    done = dealt.groupBy("fragment").cogroup(paths.groupBy("fragment")).applyInArrow(last, told_rows)
    return done.select("row.*", "subroot", "root", F.col("path").alias("proof"))
