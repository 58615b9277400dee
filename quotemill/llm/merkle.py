"""Merkle manifest of a table, kept in versions by path copying."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.session import stored

FANOUT = 16
#: Levels that are built in one block: a block holds FANOUT ** LEVELS consecutive nodes of a tree at most.
LEVELS = 2
BLOCK = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; the trees of sources are named otherwise.
TOP = ""

_STEP = "struct<at int, place bigint, run array<string>>"
_PATH = f"tree string, place bigint, path array<{_STEP}>"
_COPIED = "array<struct<top boolean, level int, place bigint, digest string>>"


def digest(inputs: Sequence[Column]) -> Column:
    """sha256 in hex of all inputs, one after the other: ``-`` for null, else byte count, ``:`` and value."""

    def marked(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[marked(x) for x in inputs]), 256)


def _joined(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def _levels(digests: list[str], size: int) -> list[list[str]]:
    """The block's nodes and those above them, up to its own top or that of its tree of ``size`` nodes."""
    out = [digests]
    for _ in range(LEVELS):
        if size == 1:
            break
        below, size = out[-1], -(-size // FANOUT)
        out.append([_joined(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def _steps(levels: list[list[str]], place: int) -> list[dict]:
    """From the node at ``place`` of its tree to the top of its block: its run, its place there, its parent's place."""
    out, inside = [], place % BLOCK
    for below in levels[:-1]:
        first = inside - inside % FANOUT
        out.append({"at": inside % FANOUT, "place": place // FANOUT, "run": below[first : first + FANOUT]})
        inside, place = inside // FANOUT, place // FANOUT
    return out


def fold(leaf: str, path: Sequence[dict]) -> list[str]:
    """The digests of all ancestors, nearest first, if the node at the path's start were ``leaf``."""
    out = [leaf]
    for step in path:
        run = step["run"]
        out.append(_joined([*run[: step["at"]], out[-1], *run[step["at"] + 1 :]]))
    return out[1:]


def siblings(path: Sequence[dict]) -> str:
    """What a proof holds: the others of each run, from left to right and level by level."""
    return "".join("".join(step["run"][: step["at"]]) + "".join(step["run"][step["at"] + 1 :]) for step in path)


def _depth(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        levels, size = levels + 1, -(-size // FANOUT)
    return levels


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``place``, the row's number in its ``tree`` from 0, and ``size``, the rows of that tree.

    Rows are dealt out by ranges of (tree, order), so a tree that holds most rows is cut into many
    parts; equal rows are cut by their number in the input. The dealt rows are written before they
    are numbered, so a lost executor can't change a part.
    """
    keys = ["tree", *order]
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    parts = stored(numbered.repartitionByRange(*keys, "_at").withColumn("part", F.spark_partition_id()), "merkle-parts")
    counts = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    upto = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.select("tree", "part", (upto - F.col("n")).alias("start"), F.sum("n").over(tree).alias("size"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys[1:], "_at"))
    return parts.join(starts, ["tree", "part"]).withColumn("place", F.col("start") + inside - 1).drop("_at", "part", "start")


def _builder(level: int):
    """What builds a block whose nodes lie at ``level``."""
    kinds = {"tree": pa.string(), "level": pa.int32(), "place": pa.int64(), "digest": pa.string(), "size": pa.int64(), "top": pa.bool_()}

    def build(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        tree, size, place = table["tree"][0].as_py(), table["size"][0].as_py(), table["place"][0].as_py()
        made = _levels(table["digest"].to_pylist(), size)
        rows = [
            (tree, level + up, place // FANOUT**up + i, d, None, False)
            for up, digests in enumerate(made[1:], 1)
            for i, d in enumerate(digests)
        ]
        rows.append((tree, level + LEVELS, place // BLOCK, made[-1][0], -(-size // BLOCK), True))
        return pa.table({n: pa.array(c, kinds[n]) for n, c in zip(kinds, zip(*rows))})

    return build


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Tier by tier the inner nodes (tree, level, place, digest, size, top) above ``nodes`` (tree, place, size, digest).

    A tier builds ``LEVELS`` levels, block by block; the tops of its blocks (``top``) are the nodes
    of the next. The last tier's tops are the roots of all trees.
    """
    tiers: list[DataFrame] = []
    while True:
        block = F.expr(f"place div {BLOCK}")
        made = nodes.select("tree", "place", "size", "digest").groupBy("tree", block).applyInArrow(
            _builder(LEVELS * len(tiers)), "tree string, level int, place bigint, digest string, size bigint, top boolean"
        )
        tiers.append(stored(made, f"merkle-tier-{len(tiers)}"))
        nodes = tiers[-1].where("top")
        if nodes.where("size > 1").isEmpty():
            return tiers


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The path of every one of ``nodes`` to the root, from the paths of the blocks' tops (``above``)."""

    def extend(table: pa.Table, tops: pa.Table) -> pa.Table:
        table = _sorted(table)
        up = tops["path"][0].as_py()
        levels = _levels(table["digest"].to_pylist(), table["size"][0].as_py())
        places = table["place"].to_pylist()
        paths = [_steps(levels, p) + up for p in places]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("place", pa.int64()), ("run", pa.list_(pa.string()))]))
        return pa.table({"tree": table["tree"], "place": table["place"], "path": pa.array(paths, kind)})

    left = nodes.select("tree", "place", "size", "digest").groupBy("tree", F.expr(f"place div {BLOCK}"))
    return left.cogroup(above.groupBy("tree", "place")).applyInArrow(extend, _PATH)


def _tops(tiers: list[DataFrame]) -> DataFrame:
    return tiers[-1].where("top").select("tree", "digest")


def manifest(
    docs: DataFrame,
    changed: Column | None = None,
    change: dict[str, Column] | None = None,
    columns: Sequence[str] = COLUMNS,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """The manifest of ``docs``, and the nodes of its tree.

    Every row is a leaf, the digest of its ``columns``. Per source, leaves ascend by id; every 16
    consecutive ones become their parent, level by level, up to the source's subroot; the subroots,
    ordered by source, go on likewise up to the root. Where ``changed`` holds, the row is tampered
    with: its columns named in ``change`` get those values.

    The tree is persistent: a tampered leaf is a version of its own that shares every node with the
    original but its ancestors, which are copied. Blocks of 256 aligned nodes are built in one task
    each; a version copies the ancestors within its leaf's block and goes on, in the same task, along
    the path from the block's top to the root, which is all it needs of the tree above.

    Rows: doc_id, source, place, leaf, subroot, root, proof_sha256, folded_root, verified, and
    ``copied``, the version's own nodes (null where the row is as it was). Nodes: source, top, level,
    place and digest of all inner nodes as they were. ``top`` marks those of the tree over the
    subroots; levels count from 1 above the leaves, or above the subroots.

    Null ids come first, null sources before all others. Rows with one id ascend by their digest;
    equal rows are a leaf each. A table without rows gives none; a source or a table of one row is
    its own subroot or root. Whole texts of any length are hashed by Spark itself.
    """
    change = change or {}
    own = [F.col(c) for c in columns]
    changed = F.lit(False) if changed is None else changed
    tampered = F.when(changed, digest([change.get(c, F.col(c)) for c in columns]))
    # sorts null first and then by bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    hashed = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), digest(own).alias("digest"), tampered.alias("tampered"))
    leaves = stored(placed(stored(hashed, "merkle-leaves"), ["doc_id", "digest"]), "merkle-placed")

    tiers = _climb(leaves)
    subroots = stored(placed(_tops(tiers).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), ["of"]), "merkle-subroots")
    upper = _climb(subroots)
    # downwards again: paths from the root to the blocks of leaves
    paths = _tops(upper).select("tree", F.lit(0).cast("long").alias("place"), F.array().cast(f"array<{_STEP}>").alias("path"))
    for tier in [*reversed(upper[:-1]), None]:
        paths = _paths(subroots if tier is None else tier.where("top"), paths)
    named = subroots.join(paths.select("place", "path"), "place")
    paths = named.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "path")
    for tier in reversed(tiers[:-1]):
        paths = _paths(tier.where("top"), paths)
    paths = stored(paths, "merkle-paths")
    above = paths.join(_tops(tiers).withColumnRenamed("digest", "subroot"), "tree")
    last = _tops(upper).first()
    root = last["digest"] if last else None

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, tree string, place bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied {_COPIED}"
    copied_type = pa.list_(pa.struct([("top", pa.bool_()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())]))

    def prove(table: pa.Table, tops: pa.Table) -> pa.Table:
        table, n = _sorted(table), table.num_rows
        top = tops.to_pylist()[0]
        up, size = top["path"], table["size"][0].as_py()
        own, after = table["digest"].to_pylist(), table["tampered"].to_pylist()
        levels, depth = _levels(own, size), _depth(size)
        shared = siblings(up).encode()
        proofs, folded, copied = [], [], []
        for place, leaf, other in zip(table["place"].to_pylist(), own, after):
            steps = _steps(levels, place)
            proofs.append(sha256(siblings(steps).encode() + shared).hexdigest())
            path = steps + up
            version = fold(leaf if other is None else other, path)
            folded.append(version[-1] if version else leaf if other is None else other)
            copied.append(
                None
                if other is None
                else [
                    {"top": i > depth, "level": i if i <= depth else i - depth, "place": s["place"], "digest": d}
                    for i, (s, d) in enumerate(zip(path, version), 1)
                ]
            )
        found = {
            "doc_id": table["doc_id"], "tree": table["tree"], "place": table["place"], "leaf": table["digest"],
            "subroot": pa.array([top["subroot"]] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs),
            "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded]), "copied": pa.array(copied, copied_type),
        }
        return pa.table(found)

    rows = leaves.groupBy("tree", F.expr(f"place div {BLOCK}")).cogroup(above.groupBy("tree", "place")).applyInArrow(prove, fields)
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)")).alias("source")
    rows = rows.select("doc_id", source, *[c for c in rows.columns if c not in ("doc_id", "tree")])
    return rows, _nodes(tiers, False).unionByName(_nodes(upper, True)).select(F.when(~F.col("top"), source).alias("source"), "top", "level", "place", "digest")


def _nodes(tiers: list[DataFrame], top: bool) -> DataFrame:
    """All inner nodes; the tops that are only handed on (``size`` set) are left out."""
    out = None
    for tier in tiers:
        inner = tier.where("NOT top").select("tree", F.lit(top).alias("top"), "level", "place", "digest")
        out = inner if out is None else out.unionByName(inner)
    return out

