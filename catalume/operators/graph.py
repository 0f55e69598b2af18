"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.sources.scratch import stage_table


#: Edges that are few enough for one task.
FEW_EDGES = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of few edges (u, v), each with one node of its component."""
    up: dict = {}

    def top(x: object) -> object:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up[top(u)] = top(v)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["u", "to"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", in_task: int = 0) -> DataFrame:
    """(node, component) for every node of an edge that isn't a loop; the component is the least node in it.

    In each round every node points to the least of its neighbours and itself, in a random but
    fixed order (a hash, so that no numbering of nodes makes long chains), and edges are drawn
    between what their ends point to. Nodes that are left fall by a constant factor on average,
    so there are O(log n) rounds; a star takes two or three. Each round is one aggregation and
    two joins on nodes, written to the shared folder. When ``in_task`` edges or fewer are left, one task
    joins them. Edges with a null end are left out.
    """
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    e = stage_table(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    roots, few = None, False
    while roots is None or not (few or e.isEmpty()):
        few = bool(in_task) and e.count() <= in_task
        if few:
            to = stage_table(e.coalesce(1).mapInArrow(_joined, T.StructType([T.StructField(c, e.schema["u"].dataType) for c in ("u", "to")])), "hooks")
        else:
            both = e.select("u", place("v").alias("p")).union(e.select(F.col("v").alias("u"), place("u").alias("p")))
            least = both.groupBy("u").agg(F.min("p").alias("p"))
            to = stage_table(least.select("u", F.least(F.col("p"), place("u"))["n"].alias("to")), "hooks")
            of_u, of_v = to.withColumnRenamed("to", "x"), to.select(F.col("u").alias("v"), F.col("to").alias("y"))
            e = stage_table(e.join(of_u, "u").join(of_v, "v").filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
        if roots is None:
            roots = to.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            on = to.select(F.col("u").alias("root"), "to")
            roots = stage_table(roots.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")


def minimum_forest(edges: DataFrame, order: list[str], a: str, b: str, root: str | None = None) -> DataFrame:
    """The edges of the minimum spanning forest: those that joining in the order would keep, when an edge within what is joined already is left out.

    edges: a, b and order, whose columns and ends tell edges apart. ``root``: a node that may have any
    number of edges. In each round every part takes its least edge, parts that hang together become one,
    and of several edges between two parts the least is left; the root takes none. Parts
    fall by half a round at least.
    """
    weight = F.struct(*[F.col(c) for c in dict.fromkeys([*order, a, b])])
    x = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), weight.alias("w")).filter("u != v")
    at_root = F.lit(False) if root is None else (F.col("u") == root) | (F.col("v") == root)
    other = F.col("u") if root is None else F.when(F.col("u") == root, F.col("v")).otherwise(F.col("u"))
    hung = stage_table(x.filter(at_root).select(other.alias("u"), "w").groupBy("u").agg(F.min("w").alias("w")), "hung")
    inner = stage_table(x.filter(~at_root).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w")), "inner")
    kept = []
    while True:
        none = F.lit(None).cast(inner.schema["u"].dataType)
        ends = inner.select("u", F.col("v").alias("y"), "w").union(inner.select("v", "u", "w")).union(hung.select("u", none, "w"))
        least = stage_table(ends.groupBy("u").agg(F.min_by(F.struct("y", "w"), "w").alias("m")).select("u", "m.y", "m.w"), "least")
        if least.isEmpty():
            break
        kept.append(least.select("w.*").distinct())
        of_y = least.select(F.col("u").alias("y"), F.col("y").alias("back"))
        # two that take each other: the lesser stays; with null: at the root
        to = least.join(of_y, "y", "left").select("u", F.when(F.col("y").isNotNull() & (F.coalesce(F.col("back") == F.col("u"), F.lit(False))) & (F.col("u") < F.col("y")), F.col("u")).otherwise(F.col("y")).alias("to"))
        to = stage_table(to, "to")
        while True:  # to the end of the chain
            nxt = to.select(F.col("u").alias("to"), F.col("to").alias("on"), F.lit(True).alias("known"))
            after = stage_table(to.join(nxt, "to", "left").select("u", F.when(F.col("known"), F.col("on")).otherwise(F.col("to")).alias("to"), (F.col("known") & ~F.col("on").eqNullSafe(F.col("to"))).alias("moved")), "to")
            to = after.select("u", "to")
            if after.filter("moved").isEmpty():
                break
        named = lambda df, c: df.join(to.select(F.col("u").alias(c), F.col("to").alias(f"{c}_to")), c)
        moved = stage_table(named(named(inner, "u"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v"), "w").filter("not u <=> v"), "moved")
        out = moved.filter("u is null or v is null").select(F.coalesce("u", "v").alias("u"), "w").union(named(hung, "u").filter("u_to is not null").select("u_to", "w"))
        hung = stage_table(out.groupBy("u").agg(F.min("w").alias("w")), "hung")
        inner = stage_table(moved.filter("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w")), "inner")
    if not kept:
        return x.select("w.*").limit(0)
    every = kept[0]
    for k in kept[1:]:
        every = every.union(k)
    return every.distinct()
