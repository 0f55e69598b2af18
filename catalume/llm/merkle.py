"""Merkle manifest of a dataset: a digest for every row, a proof for it, and one root over all.

Rows of a group (a source) are the leaves of a tree of ``ARITY`` children a node, in the order of
a key; the roots of the groups are the leaves of a last tree. Trees are cut into superblocks of
``HEIGHT`` levels (3 ** 7 = 2,187 leaves). On the way up each superblock is reduced to one node, and
the nodes of a level of superblocks are dealt to superblocks again, so no task sees more than
2,187 nodes, whatever the size of a group. On the way down the nodes of a superblock are cogrouped
with the one row of outer nodes that all of them need; a task reduces its superblock, joins
the inner with the outer siblings, and passes them on to the superblocks below. With the
leaves the same task folds each proof.

A digest is the lowercase hex sha256 of its inputs; digests go into others as hex text. Between
steps they are kept as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.sources.scratch import stage_table

ARITY = 3
#: Levels of a superblock; no result depends on it.
HEIGHT = 7
#: The columns that make a leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "group long, pos long, n long, node binary"
_OUTER = _NODE + ", places array<tinyint>, siblings array<binary>, subroot binary, root binary"
_PROOF = "order string, source string, leaf string, subroot string, root string, places array<tinyint>, siblings array<binary>, folded_root string, verified boolean"


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256, as 32 bytes, of the values one after the other: '-' for null, else their UTF-8 byte count, ':' and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def laid_out(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in the order, cut into ranges, each a file; ``at`` grows with the order, its higher bits (``part``) number the ranges.

    Ranges are cut by samples of the order, so a hot value of its first column is cut, too.
    """
    x = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    x = stage_table(x.withColumn("at", F.monotonically_increasing_id()), "laid-out")
    return x.withColumn("part", F.shiftright("at", 33))


def spans(x: DataFrame, groups: Sequence[str]) -> DataFrame:
    """For each group and range of a table laid out by group first: its first ``at``, the rows ``before`` it in the group, and ``n``, all rows of the group.

    There is a row for each range and one more for each group at most.
    """
    s = x.groupBy(*groups, "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("some"))
    w = Window.partitionBy(*groups)
    before = F.sum("some").over(w.orderBy("part")) - F.col("some")
    return s.select(*groups, "part", "low", before.alias("before"), F.sum("some").over(w).alias("n"))


def _depth(n: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def _levels(g: pd.DataFrame, height: int) -> list[list[bytes]]:
    """The nodes of a superblock (hex), and all levels above them in it."""
    out = [[d.hex().encode() for d in g["node"]]]
    for _ in range(min(height, _depth(int(g["n"].iloc[0])))):
        below = out[-1]
        out.append([hashlib.sha256(b"".join(below[i : i + ARITY])).hexdigest().encode() for i in range(0, len(below), ARITY)])
    return out


def _inner(levels: list[list[bytes]], i: int) -> Iterator[tuple[int, bytes]]:
    """Place in its run, and the others of the run, of node ``i`` of a superblock and of those above it."""
    for below in levels[:-1]:
        k = i % ARITY
        first = i - k
        yield k, b"".join(below[first:i] + below[i + 1 : first + ARITY])
        i //= ARITY


def fold(leaf: bytes, places: Sequence[int], siblings: Sequence[bytes]) -> bytes:
    """The root (hex) that a leaf and the siblings on its way up (all hex) lead to."""
    for k, others in zip(places, siblings, strict=True):
        cut = 64 * int(k)  # places come as bytes
        leaf = hashlib.sha256(others[:cut] + leaf + others[cut:]).hexdigest().encode()
    return leaf


def _block(width: int) -> Column:
    return F.floor(F.col("pos") / F.lit(width)).cast("long").alias("block")


def climb(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The nodes, the superblocks' nodes above them, and so on up to one node for each group.

    nodes: group, pos (from 0 in the group), n (nodes of the group), node.
    """

    def up(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        top = _levels(g, height)[-1]
        n = int(g["n"].iloc[0])
        after = 1 if n <= ARITY**height else -(-n // ARITY**height)
        return pd.DataFrame({"group": g["group"].iloc[:1], "pos": g["pos"].iloc[:1] // ARITY**height, "n": after, "node": [bytes.fromhex(top[0].decode())]})

    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(stage_table(out[-1].groupBy("group", _block(ARITY**height)).applyInPandas(up, _NODE), "nodes"))
        most = -(-most // ARITY**height)
    return out


def descend(rounds: list[DataFrame], outer: DataFrame, height: int = HEIGHT) -> DataFrame:
    """For each node of the lowest of ``rounds``: places and siblings up to the root, from those of each group's top (``outer``)."""

    def down(g: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if g.empty or above.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _OUTER.split(", ")})
        g = g.sort_values("pos")
        levels, a = _levels(g, height), above.iloc[0]
        ways = [list(_inner(levels, i)) for i in range(len(g))]
        g = g[["group", "pos", "n", "node"]].copy()
        g["places"] = [[*(k for k, _ in way), *a["places"]] for way in ways]
        g["siblings"] = [[*(bytes.fromhex(s.decode()) for _, s in way), *a["siblings"]] for way in ways]
        return g.assign(subroot=[a["subroot"]] * len(g), root=[a["root"]] * len(g))

    for nodes in reversed(rounds[:-1]):
        below = nodes.select("group", "pos", "n", "node", _block(ARITY**height))
        above = outer.select(F.col("group").alias("of"), F.col("pos").alias("block"), "places", "siblings", "subroot", "root")
        outer = below.groupBy("group", "block").cogroup(above.groupBy("of", "block")).applyInPandas(down, _OUTER)
    return outer


def prove(leaves: DataFrame, outer: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Proofs of all leaves, each folded with what is ``seen`` in place of its leaf.

    leaves: group, pos, n, node, seen, order, source; outer: what the leaves of a superblock share,
    at the superblock's pos.
    """

    def finish(g: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if g.empty or above.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _PROOF.split(", ")})
        g = g.sort_values("pos")
        levels, a = _levels(g, height), above.iloc[0]
        places, siblings = list(a["places"]), list(a["siblings"])
        hexed = [s.hex().encode() for s in siblings]
        root = a["root"].hex()
        ways = [list(_inner(levels, i)) for i in range(len(g))]
        folded = [fold(s.hex().encode(), [*(k for k, _ in way), *places], [*(x for _, x in way), *hexed]).decode() for s, way in zip(g["seen"], ways, strict=True)]
        return pd.DataFrame({
            "order": g["order"].to_numpy(), "source": g["source"].to_numpy(), "leaf": [x.decode() for x in levels[0]], "subroot": a["subroot"].hex(), "root": root,
            "places": [[*(k for k, _ in way), *places] for way in ways], "siblings": [[*(bytes.fromhex(x.decode()) for _, x in way), *siblings] for way in ways],
            "folded_root": folded, "verified": [f == root for f in folded],
        })

    below = leaves.select("group", "pos", "n", "node", "seen", "order", "source", _block(ARITY**height))
    above = outer.select(F.col("group").alias("of"), F.col("pos").alias("block"), "places", "siblings", "subroot", "root")
    return below.groupBy("group", "block").cogroup(above.groupBy("of", "block")).applyInPandas(finish, _PROOF)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, order: str = "doc_id", group: str = "source", seen: Mapping[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: its leaf, the roots of its group and of all, its proof, and where the proof leads.

    Columns: ``order`` and ``group`` (named and typed as in ``docs``), leaf, subroot, root (hex),
    places and siblings (from the leaf up: its place in its run, and the others of the run, 32 bytes
    each, one after the other), folded_root (from the leaf that ``seen`` gives, columns that are
    different when the row is verified; without ``seen`` the leaf itself) and verified.

    Leaves of a group ascend by ``order``, null first; of one key by their digest, so rows that are
    repeated are neighbours, each with a place and proof of its own. A null group is a group of
    its own, before all others. Nulls in a leaf are '-', the empty text is '0:'. Texts of any
    length are digested in the JVM and go no further. Other columns are not looked at. An empty
    table gives an empty one. All rows of one group, or of one key, are no hot task: ranges are
    cut by samples of (group, order, leaf, row).
    """
    now = dict(seen or {})
    row = docs.select(
        docs[order].alias("order"), docs[group].cast("string").alias("source"), leaf_digest([docs[c] for c in columns]).alias("node"),
        leaf_digest([now.get(c, docs[c]) for c in columns]).alias("seen"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = laid_out(stage_table(row, "leaves"), ["source", "order", "node", "row"])
    parts = spans(leaves, ["source"])
    sources = laid_out(parts.groupBy("source").agg(F.first("n").alias("rows")), ["source"])
    sources = sources.join(spans(sources, []), "part").select(F.col("source").alias("named"), (F.col("before") + F.col("at") - F.col("low")).alias("number"), F.col("n").alias("sources"))
    parts = parts.join(sources, parts["source"].eqNullSafe(sources["named"]))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("in"), "low", "before", "n", "number", "sources")
    on = leaves["source"].eqNullSafe(parts["of"]) & (leaves["part"] == parts["in"])
    leaves = leaves.join(parts, on).select(F.col("number").alias("group"), (F.col("before") + F.col("at") - F.col("low")).alias("pos"), "n", "node", "seen", F.col("order").cast("string").alias("order"), "source")

    rounds = climb(leaves.select("group", "pos", "n", "node"), height)
    tops = rounds[-1].join(sources, F.col("group") == F.col("number"))
    over = climb(stage_table(tops.select(F.lit(0).cast("long").alias("group"), F.col("number").alias("pos"), F.col("sources").alias("n"), "node"), "subroots"), height)
    nothing = [F.array().cast("array<tinyint>").alias("places"), F.array().cast("array<binary>").alias("siblings"), F.lit(None).cast("binary").alias("subroot")]
    outer = descend(over, over[-1].select("group", "pos", "n", "node", *nothing, F.col("node").alias("root")), height)
    outer = outer.select(F.col("pos").alias("group"), F.lit(0).cast("long").alias("pos"), "n", "node", "places", "siblings", F.col("node").alias("subroot"), "root")
    if len(rounds) > 1:  # the lowest superblocks are the leaves'
        outer = descend(rounds[1:], outer, height)
    out = prove(leaves, outer, height)
    return out.select(F.col("order").cast(docs.schema[order].dataType).alias(order), F.col("source").cast(docs.schema[group].dataType).alias(group), *[c for c in out.columns if c not in ("order", "source")])


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of documents, in which every second row was tampered with.

    Where crc32 of the id as text is even (null: of ''), \\n characters are gone from the text
    that is verified. proof_sha256: of all siblings from the leaf to the root, left to right.
    """
    doc_id = docs["doc_id"].cast("long")
    touched = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0
    now = F.when(touched, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    x = manifest(docs, seen={"text": now})
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.lower(F.hex(s))), ""), 256)
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified", "source")

