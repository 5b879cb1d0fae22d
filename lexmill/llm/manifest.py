"""Merkle manifest of a dataset: a digest per record, per source and for all, with proofs.

Nodes are rows of (tree, place, digest). On every level nodes are joined with
their siblings, whose places follow from their own: with two children a run,
the sibling's place differs in the last bit; otherwise it lies at the slot's
offset. The rows of slot zero then emit the parents. Levels are written as they
come, so a lost executor costs no more than a level.

Proofs go down again: a run's path is its parent's path and the parent's own
siblings, so each level is joined once, and a level has a third of the rows of
the one below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.llm.shared import kept
from lexmill.operators.ranking import ranked

FAN_OUT = 3
#: What a record's digest is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "array<struct<before:string,after:string>>"


def digest(value: Column) -> Column:
    """Lowercase hexadecimal sha256 of a string's UTF-8 bytes."""
    return F.sha2(value, 256)


def leaf(text: Column | None = None) -> Column:
    """The digest of a record: of each field its byte count, a colon and its value, or ``-`` where it is null."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" and text is not None else F.col(name)
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def tree_name(source: str = "source") -> Column:
    """The source as a key without nulls; null sorts first, others by their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


@dataclass(frozen=True)
class Trees:
    """Trees over (tree, place, digest): runs of each level, and the top of every tree.

    ``levels[k]`` has (tree, up, children, parent) of the runs of level k, ``up``
    being the parent's place on the next level; ``tops`` has (tree, height, top).
    """

    levels: list[DataFrame]
    tops: DataFrame


def sibling(place: Column, step: int, fan_out: int) -> Column:
    """The place of the sibling ``step`` slots on, around the run."""
    if fan_out == 2:
        return place.bitwiseXOR(F.lit(1).cast("bigint"))
    return place - place % fan_out + (place % fan_out + step) % fan_out


def grow(nodes: DataFrame, fan_out: int = FAN_OUT) -> Trees:
    """Build every tree over ``nodes`` (tree, place, n, digest): places from 0 without gaps, n nodes in the tree.

    While a tree has more than one node, each run of ``fan_out`` neighbours, or
    what is left of it at the end, becomes the digest of its digests in order.
    A tree of one node is that node. Trees need not be of one height.
    """
    if fan_out < 2:
        raise ValueError("a run needs at least two nodes")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [_tops(nodes, 0)]
    while most > 1:
        open_nodes = nodes.where("n > 1")
        runs = open_nodes.where(F.col("place") % fan_out == 0)
        for step in range(1, fan_out):
            # The sibling is sought under the place that it computes for the run's slot zero.
            others = open_nodes.where(F.col("place") % fan_out == step).select(
                "tree", sibling(F.col("place"), fan_out - step, fan_out).alias("place"), F.col("digest").alias(f"digest{step}")
            )
            runs = runs.join(others, ["tree", "place"], "left")
        children = F.array_compact(F.array("digest", *[F.col(f"digest{step}") for step in range(1, fan_out)]))
        emitted = runs.select("tree", F.expr(f"place div {fan_out}").alias("up"), "n", children.alias("children"))
        emitted = emitted.withColumn("parent", digest(F.array_join("children", "")))
        level = kept(emitted, f"manifest-level{len(levels)}")
        levels.append(level.select("tree", "up", "children", "parent"))
        smaller = F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n")
        nodes = level.select("tree", F.col("up").alias("place"), smaller, F.col("parent").alias("digest"))
        tops.append(_tops(nodes, len(levels)))
        most = -(-most // fan_out)
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return Trees(levels, kept(found, "manifest-tops") if len(tops) > 1 else found)


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    done = nodes.where("n = 1")
    return done.select("tree", F.lit(height).alias("height"), F.col("digest").alias("top"))


def beside(children: Column, slot: Column) -> Column:
    """The siblings of a slot: those before it and those after it, each in order, as one string."""
    before = F.array_join(F.slice(children, F.lit(1), slot), "")
    after = F.array_join(F.slice(children, slot + 2, F.greatest(F.size(children) - slot - 1, F.lit(0))), "")
    return F.struct(before.alias("before"), after.alias("after"))


def run_paths(trees: Trees, above: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(tree, up, children, path, ...) of the lowest runs: the siblings on each level from the parent to the top, and above.

    ``above`` has (tree, path, ...): what comes after the tree's own top, and what else to pass down to each run.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    heights = trees.tops.join(above, "tree").select("tree", "height", "path", *carried)
    paths = None
    for level in range(len(trees.levels) - 1, -1, -1):
        runs = trees.levels[level]
        # A run here has its parent on the next level: the top of its tree, or a child of a run there.
        tops = heights.where(F.col("height") == level + 1).select("tree", F.lit(0).cast("bigint").alias("up"), "path", *carried)
        if paths is None:
            parents = tops
        else:
            child = paths.select("*", F.posexplode("children").alias("slot", "own"))
            place = (F.col("up") * fan_out + F.col("slot")).alias("up")
            longer = F.concat(F.array(beside(F.col("children"), F.col("slot"))), F.col("path")).alias("path")
            parents = child.select("tree", place, longer, *carried).unionByName(tops)
        paths = runs.select("tree", "up", "children").join(parents, ["tree", "up"])
        if level:
            paths = kept(paths, f"manifest-paths{level}")
    if paths is None:
        nothing = F.lit(0).cast("bigint").alias("up"), F.array(F.lit("")).alias("children")
        return heights.select("tree", *nothing, "path", *carried).limit(0)
    return paths


def fold(start: Column, path: Column) -> Column:
    """The digest that a node and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda acc, at: digest(F.concat(at["before"], acc, at["after"])))


def tampered_text() -> Column:
    """The text without line ends where the checksum of the id is even; others, and null ids, stay."""
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    return F.when(even, F.translate(F.col("text"), "\n", "")).otherwise(F.col("text"))


def manifest(docs: DataFrame, check: Column | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, leaf, subroot, root, path and checked_leaf of every record.

    ``path`` holds the siblings on each level up to the root, and ``fold`` leads
    from a leaf along it to a root. ``check`` is a text to compare: its record's
    digest is ``checked_leaf``. In a source records ascend by doc_id, null first,
    and by their digests where ids repeat; repeated rows have equal leaves and
    stand next to each other. A null field is ``-``; a null source is a source,
    first of all. A source of one record has its leaf for subroot, a table of one
    source its subroot for root. An empty table gives an empty result. Further
    columns are not read.
    """
    texts = F.col("text") if check is None else check
    records = docs.select(tree_name().alias("tree"), "doc_id", leaf().alias("leaf"), leaf(texts).alias("checked_leaf"))
    order = [F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("checked_leaf")]
    placed = ranked(records, ["tree"], order, "place", "n").withColumn("place", F.col("place") - 1)
    leaves = kept(placed, "manifest-leaves")
    trees = grow(leaves.select("tree", "place", "n", F.col("leaf").alias("digest")), fan_out)

    # Subroots are the leaves of one more tree.
    named = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "top")
    nodes = kept(ranked(named, [], ["name"], "place", "n").withColumn("place", F.col("place") - 1), "manifest-subroots")
    crown = grow(nodes.select("tree", "place", "n", F.col("top").alias("digest")), fan_out)
    nothing = F.array().cast(NO_PATH).alias("path")
    upper = run_paths(crown, crown.tops.select("tree", nothing), fan_out)
    above = _with_paths(nodes, upper, fan_out).join(F.broadcast(crown.tops.select("tree", F.col("top").alias("root"))), "tree")
    above = kept(above.select(F.col("name").alias("tree"), F.col("top").alias("subroot"), "root", "path"), "manifest-roots")

    found = run_paths(trees, above, fan_out)
    many = _with_paths(leaves.where("n > 1"), found, fan_out)
    one = leaves.where("n = 1").join(above, "tree")
    names = ["doc_id", "leaf", "subroot", "root", "path", "checked_leaf"]
    return many.select(names).unionByName(one.select(names))


def _with_paths(nodes: DataFrame, runs: DataFrame, fan_out: int) -> DataFrame:
    """Nodes of (tree, place, ...) with the ``path`` from each to the top; a lone node has an empty one."""
    runs = runs.withColumnRenamed("path", "higher")
    slot = (F.col("place") % fan_out).cast("int")
    path = F.concat(F.array(beside(F.col("children"), slot)), F.col("higher"))
    joined = nodes.withColumn("up", F.expr(f"place div {fan_out}")).join(runs, ["tree", "up"], "left")
    lone = F.array().cast(NO_PATH)
    return joined.withColumn("path", F.when(F.col("children").isNull(), lone).otherwise(path)).drop("up", "children", "higher")


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs tried on texts that lost their line ends."""
    rows = manifest(docs, tampered_text())
    siblings = F.array_join(F.transform("path", lambda at: F.concat(at["before"], at["after"])), "")
    folded = fold(F.col("checked_leaf"), F.col("path"))
    checked = rows.withColumn("folded_root", folded)
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
