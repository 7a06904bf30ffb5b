"""A Merkle manifest of rows: a tree for each group, a tree over the groups, and a proof for each row.

Trees are ternary and grow in blocks: a block takes up to 81 consecutive nodes of one tree, makes the parents of four levels and
stores each one's preimage, the concatenated digests of its children. Above lie 81 times fewer nodes, so a table of 10 billion rows
needs six rounds, each an aggregate of bounded groups; no tree passes through one task, however many rows a group has.
Proofs come down the same way: a node takes over its block's path, so ancestors' preimages are joined once for 81 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

ARITY, LEVELS = 3, 4
BLOCK = ARITY**LEVELS
SLOT = 64
PATH = "array<struct<preimage: string, slot: int>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value in a leaf: `-` for null, else its byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def siblings(step: Column) -> Column:
    """A preimage without the slot of the child itself."""
    return F.concat(step["preimage"].substr(F.lit(1), step["slot"] * SLOT), step["preimage"].substr(step["slot"] * SLOT + SLOT + 1, F.lit(SLOT * ARITY)))


def spliced(step: Column, child: Column) -> Column:
    """A preimage with another child in that slot."""
    return F.concat(step["preimage"].substr(F.lit(1), step["slot"] * SLOT), child, step["preimage"].substr(step["slot"] * SLOT + SLOT + 1, F.lit(SLOT * ARITY)))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda child, step: F.sha2(spliced(step, child).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with ``position`` (from 0, within their tree, in that order) and ``total`` (rows of their tree).

    A range sort puts a tree's rows into neighbouring partitions, of which each is counted; a partition's trees start where the
    partitions before left off. So a tree of any size is numbered without a window over it. ``tree`` must not be null.
    """
    ordered = materialise(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id()), f"{name}_ordered")
    part = F.shiftright("at", 33)
    held = ordered.groupBy(F.col(tree).alias("held_tree"), part.alias("held_part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("held_tree").orderBy("held_part").rowsBetween(Window.unboundedPreceding, -1)
    base, total = F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)), F.sum("n").over(Window.partitionBy("held_tree"))
    spans = materialise(held.select("held_tree", "held_part", base.alias("base"), total.alias("total")), f"{name}_spans")
    met = ordered.join(spans, (F.col(tree) == F.col("held_tree")) & (part == F.col("held_part")))
    return met.select(*(c for c in ordered.columns if c != "at"), (F.col("at") - F.col("base")).alias("position"), "total")


def _blocks(nodes: DataFrame, payload: list[str], name: str) -> DataFrame:
    """(tree, block, total, rows, parents 0 to 3, top) of (tree, position, total, node, payload): one row for up to 81 nodes."""
    row = F.struct("position", "node", *payload)
    grouped = nodes.groupBy("tree", F.expr(f"position div {BLOCK}").alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(row)).alias("rows"))
    # Each level is a column of its own, so that no expression is worked out twice.
    out = grouped.withColumn("nodes", F.col("rows.node"))
    for level in range(LEVELS):
        more = F.col("total") > ARITY**level
        runs = F.sequence(F.lit(0), F.ceil(F.size("nodes") / ARITY).cast("int") - 1)
        made = F.transform(runs, lambda g: F.array_join(F.slice("nodes", g * ARITY + 1, F.lit(ARITY)), ""))
        out = out.withColumn(f"parents_{level}", F.when(more, made).otherwise(F.array().cast("array<string>")))
        out = out.withColumn("nodes", F.when(more, F.transform(f"parents_{level}", lambda p: F.sha2(p.cast("binary"), 256))).otherwise(F.col("nodes")))
    return materialise(out.withColumn("top", F.element_at("nodes", 1)).drop("nodes"), name)


def _path(position: Column) -> Column:
    """The steps from a node of a block to the block's top, from the block's preimages."""
    within, steps = position % BLOCK, []
    for level in range(LEVELS):
        place = F.floor(within / ARITY**level)
        parents = F.col(f"parents_{level}")
        step = F.struct(F.get(parents, F.floor(place / ARITY).cast("int")).alias("preimage"), (place % ARITY).cast("int").alias("slot"))
        steps.append(F.when(F.size(parents) > 0, F.array(step)).otherwise(F.array().cast(PATH)))
    return F.concat(*steps)


class Forest:
    """Trees over (tree, position, total, node, further columns), built upwards in rounds of written blocks."""

    def __init__(self, nodes: DataFrame, payload: list[str], name: str):
        self.payload, self.rounds = payload, [_blocks(nodes, payload, f"{name}_blocks")]
        while not (open_ := self.rounds[-1].where(F.col("total") > BLOCK)).isEmpty():
            above = open_.select("tree", F.col("block").alias("position"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node"))
            self.rounds.append(_blocks(above, [], f"{name}_blocks"))

    def tops(self) -> DataFrame:
        """(tree, top): the last node of each tree; of a single node, itself."""
        found = [blocks.where(F.col("total") <= BLOCK).select("tree", "top") for blocks in self.rounds]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, above: DataFrame, name: str) -> DataFrame:
        """(tree, position, node, payload, path, what ``above`` (tree, above_path, ...) says of the tree): all nodes with the steps to
        their tree's top and on along above_path. Only blocks' tops are joined, and the rows of the lowest blocks leave them last."""
        extra = [c for c in above.columns if c not in ("tree", "above_path")]
        carried = None
        for depth in reversed(range(len(self.rounds))):
            blocks = self.rounds[depth]
            top = blocks.where(F.col("total") <= BLOCK).join(above, "tree")
            if carried is not None:
                below = carried.select("tree", F.col("position").alias("block"), F.col("path").alias("above_path"), *extra)
                top = top.select(*blocks.columns, "above_path", *extra).unionByName(blocks.where(F.col("total") > BLOCK).join(below, ["tree", "block"]).select(*blocks.columns, "above_path", *extra))
            each = top.withColumn("row", F.explode("rows"))
            rows = each.select("tree", F.col("row.position").alias("position"), F.col("row.node").alias("node"), *(F.col(f"row.{c}").alias(c) for c in (self.payload if depth == 0 else [])), F.concat(_path(F.col("row.position")), "above_path").alias("path"), *extra)
            if depth:
                before, carried = carried, materialise(rows, name)
                if before is not None:
                    forget(before)
        return rows


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, path, folded_root, verified) for each row.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The leaves of a source, by doc_id, make its tree; the sources'
    tops, by the bytes of their names and null first, make the tree over all. ``path`` holds the preimages of all ancestors, lowest
    first, with the slot of the row in each; ``proof`` is the siblings in that order. Where ``tampered`` is true, the
    text's line ends are deleted and the changed leaf is folded along the path instead; ``verified`` says whether root comes out.

    Texts are read once and only digests are moved. Rows of a null doc_id come first in their source; rows of one doc_id lie in the
    order of their leaves, so equal rows may swap places without changing any digest. Null and empty sources are two sources,
    null and empty texts differ, an empty table gives no rows, other columns aren't read.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_of(*values, F.col("text"))
    changed = leaf
    if tampered is not None:
        changed = F.when(tampered & F.contains("text", F.lit("\n")), leaf_of(*values, F.translate("text", "\n", ""))).otherwise(leaf)
    # '' is the null source, and a + stands before all names: their order by bytes is that of the sources.
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    leaves = materialise(docs.select(tree.alias("tree"), "doc_id", leaf.alias("node"), changed.alias("changed")), "leaves")
    forest = Forest(numbered(leaves, "tree", ["doc_id", "node"], "leaves"), ["doc_id", "changed"], "sources")
    tops = forest.tops().select(F.lit("").alias("of_all"), F.col("tree").alias("name"), F.col("top").alias("node"))
    over = Forest(numbered(tops, "of_all", ["name"], "tops").withColumnRenamed("of_all", "tree"), ["name"], "all")
    root = over.tops().select("tree", F.lit(None).cast(PATH).alias("above_path"), F.col("top").alias("root")).withColumn("above_path", F.array().cast(PATH))
    above = materialise(over.paths(root, "over_paths").select(F.col("name").alias("tree"), F.col("path").alias("above_path"), F.col("node").alias("subroot"), "root"), "subroots")
    forget(leaves)
    rows = forest.paths(above, "paths")
    rows = rows.withColumn("proof", F.transform("path", siblings)).withColumn("folded_root", folded(F.col("path"), F.col("changed")))
    return rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
