"""Grouping of near-duplicates and identities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.operators.facets import group_centrality
from catalume.operators.graph import FEW_EDGES, connected_components, minimum_forest
from catalume.operators.linkage import average_linkage, cohesion_split  # noqa: F401  also of this module's interface
from catalume.operators.sequence import burst_runs, renumber
from catalume.operators.similarity import cosine_all_pairs, duplicate_edges, hamming_join, hash_bits
from catalume.sources.scratch import stage_table

def burst_merge(items: DataFrame, groups: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, group): loose rows join a group, or each other, through the bursts they share; groups never fuse.

    items: id, ord; groups: id, group; runs: id, run, t. Runs are tied to atoms (groups and loose
    rows), by an edge from a run's first atom to each later one. In order of time an edge joins what isn't
    joined yet, unless both sides hold a group already. That is a minimum spanning forest in
    which all groups are one node, so it takes a few rounds of joins, and no task works through a component.
    """
    atoms = items.join(groups, "id", "left").select("id", "ord", F.coalesce(F.concat(F.lit("g"), F.col("group").cast("string")), F.concat(F.lit("r"), F.col("id").cast("string"))).alias("atom"))
    on = runs.join(atoms, "id").select("run", "t", "ord", "atom")
    first = on.groupBy("run").agg(F.min_by("atom", F.struct("t", "ord")).alias("head"), F.min("t").alias("start"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    end = lambda c: F.when(F.col(c).startswith("g"), F.lit("")).otherwise(F.col(c))
    ties = on.join(first, "run").filter("atom != head").select("start", "t", "ord", "head", "atom", end("head").alias("a"), end("atom").alias("b"))
    forest = stage_table(minimum_forest(ties, ["start", "t", "ord", "head", "atom"], "a", "b", root="").select("head", "atom"), "forest")
    comp = connected_components(forest, "head", "atom", FEW_EDGES)
    x = atoms.join(comp, atoms["atom"] == comp["node"], "left").select("id", F.coalesce("component", "atom").alias("group"))
    size = x.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return x.join(size, "group").select("id", "group")


def cull_safe(df: DataFrame, group: str, id_: str = "id", hash_: str = "phash", time: str = "capture_time", span: float = 8.0, t: int = 6) -> DataFrame:
    """(id, dup_cull_safe): all times known and within ``span`` seconds, all pairs of hashes within ``t`` bits.

    One pass over the rows sums a group up in six numbers: bits in which its hashes differ at all are those of
    their OR that aren't in their AND. With ``t`` of them or fewer all pairs are near; the least and the greatest
    hash are one pair, so more bits between these decide too. Only what is undecided then, and passes the
    test of times, gets to pairs of different hashes.
    """
    far_bits = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    t = min(t, 6)
    x = df.filter(F.col(group).isNotNull()).select(F.col(id_), F.col(group), F.col(time).cast("double").alias("_t"), hash_bits(F.col(hash_)).alias("_h"))
    tm = F.coalesce("_t", F.lit(0.0))
    g = x.groupBy(group).agg(F.max(tm).alias("_t1"), F.min(tm).alias("_t0"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.bit_and("_h").alias("_and"), F.bit_or("_h").alias("_or"))
    timed = ((F.col("_t1") - F.col("_t0")) <= span) & (F.col("_t0") > 0)
    near = F.when(F.col("_lo").isNull() | (far_bits(F.col("_and"), F.col("_or")) <= t), True).when(far_bits(F.col("_lo"), F.col("_hi")) > t, False)
    g = stage_table(g.select(group, F.when(~timed, False).otherwise(near).alias("_safe")), "safe")
    h = x.join(g.filter("_safe is null"), group, "left_semi").filter("_h is not null").select(group, "_h").distinct()
    pairs = h.join(h.select(F.col(group).alias("_g"), F.col("_h").alias("_k")).hint("merge"), (F.col(group) == F.col("_g")) & (F.col("_h") < F.col("_k")) & (far_bits(F.col("_h"), F.col("_k")) > t))
    far = pairs.select(group).distinct().withColumn("_far", F.lit(True))
    safe = g.filter("_safe is not null").union(g.filter("_safe is null").join(far, group, "left").select(group, F.col("_far").isNull()))
    return x.select(id_, group).join(safe, group).select(id_, F.col("_safe").alias("dup_cull_safe"))


def assign_duplicates(df: DataFrame, t: int = 6, sim: float = 0.92, window: float = 600.0, floor: float = 0.90, burst_gap: float = 8.0, burst_span: float = 30.0, burst_sim: float = 0.80) -> DataFrame:
    """(id, dup_group, dup_central, dup_cull_safe) of near-duplicates; rows in no group are left out.

    df: id, path, phash, embedding (unit vectors), capture_time.
    """
    comp = connected_components(duplicate_edges(df, t, sim, window), "i", "j", FEW_EDGES).withColumnRenamed("node", "id")
    split = cohesion_split(df.join(comp, "id").withColumn("ord", F.col("id")).select("component", "id", "ord", "phash", "embedding"), floor, t)
    groups = stage_table(split.select("id", F.concat_ws(":", "component", "part").alias("group")), "groups")
    runs = stage_table(burst_runs(df, gap=burst_gap, span=burst_span, sim=burst_sim).join(df.select("id", F.col("capture_time").alias("t")), "id"), "runs")
    merged = stage_table(burst_merge(df.select("id", F.col("id").alias("ord")), groups, runs), "merged")
    x = renumber(df.join(merged, "id"), "group", out="dup_group").select("id", "dup_group", "phash", "capture_time", "embedding")
    return x.select("id", "dup_group").join(group_centrality(x, "dup_group", "id", "embedding"), "id", "left").join(cull_safe(x, "dup_group", t=t), "id")


def _out_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of few edges (oa, a, ob, b) that are taken, in order."""
    edges = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    later: dict[tuple, list[tuple]] = {}
    for oa, a, ob, b in edges:
        later.setdefault((oa, a), []).append((ob, b))
    taken: set[tuple] = set()
    for node in sorted(later):
        if node not in taken:
            taken.update(later[node])
    yield pa.RecordBatch.from_arrays([pa.array([n for _, n in taken], pa.int64())], names=["b"])


def leader_groups(edges: DataFrame, items: DataFrame, in_task: int = FEW_EDGES) -> DataFrame:
    """(id, leader): in input order, each row not yet taken takes all later free rows within reach; groups of one are left out.

    edges: i, j; items: id, ord. Rounds: a row of which no earlier neighbour is free leads, and
    its neighbours are out. The last ``in_task`` edges are worked through in one task, so a long
    chain doesn't make a round for each of its rows. Every row that is out goes to its earliest leader.
    """
    o1, o2 = items.select(F.col("id").alias("i"), F.col("ord").alias("oi")), items.select(F.col("id").alias("j"), F.col("ord").alias("oj"))
    e = edges.filter("i != j").join(o1, "i").join(o2, "j")
    x, y = F.struct(F.col("oi").alias("o"), F.col("i").alias("n")), F.struct(F.col("oj").alias("o"), F.col("j").alias("n"))
    e = stage_table(e.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).select(F.col("x.o").alias("oa"), F.col("x.n").cast("long").alias("a"), F.col("y.o").alias("ob"), F.col("y.n").cast("long").alias("b")).distinct(), "links")
    left, outs = e, []
    while (n := left.count()) > 0:
        if n <= in_task:
            outs.append(left.coalesce(1).mapInArrow(_out_in_task, "b long"))
            break
        free = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        out = stage_table(left.join(free, "a", "left_semi").select("b").distinct(), "out")
        outs.append(out)
        left = stage_table(left.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("oa", "a", "ob", "b"), "links")
    # whoever was never out leads
    lead = e.join(reduce(DataFrame.union, outs).select(F.col("b").alias("a")), "a", "left_anti") if outs else e
    taken = lead.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("oa", "a")).alias("m")).select("id", F.col("m.a").alias("leader"))
    return taken.union(taken.select(F.col("leader").alias("id"), "leader").distinct())


def coarsen(scene_of: DataFrame, extra: DataFrame) -> DataFrame:
    """(id, scene_group): scenes joined where an extra group spans them; a group ties loose rows too.

    scene_of: id, path, capture_time, scene_group; extra: group_id, id. Rows alone stay null.
    """
    s = scene_of.filter("scene_group is not null")
    head = s.groupBy("scene_group").agg(F.min("id").alias("a"))
    e1 = s.join(head, "scene_group").select("a", F.col("id").alias("b"))
    known = extra.join(scene_of.select("id"), "id", "left_semi")
    head2 = known.groupBy("group_id").agg(F.min("id").alias("a"))
    e2 = known.join(head2, "group_id").select("a", F.col("id").alias("b"))
    comp = connected_components(e1.union(e2), in_task=FEW_EDGES)
    x = scene_of.join(comp, scene_of["id"] == comp["node"], "left").drop("scene_group")
    n = renumber(x, "component", out="scene_group").select(F.col("id").alias("_i"), "scene_group")
    return x.join(n, x["id"] == n["_i"], "left").select("id", "scene_group")


def cluster_identities(df: DataFrame, vec: str = "embedding", id_: str = "id", eps: float = 0.5, normalize: bool = True) -> DataFrame:
    """(id, cluster_id): components of cosine at least 1 - eps; every row has one, numbered by first row. ``normalize`` False: vectors have length 1."""
    comp = connected_components(cosine_all_pairs(df, id_, vec, 1 - eps, normalize=normalize), "i", "j", FEW_EDGES)
    x = df.select(F.col(id_).cast("long").alias("id")).join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c"))
    n = renumber(x.withColumn("capture_time", F.col("c").cast("double")).withColumn("path", F.col("c").cast("string")), "c", out="cluster_id")
    return n.select("id", "cluster_id")


def hash_leaders(df: DataFrame, t: int = 6, id_: str = "id", hash_: str = "phash") -> DataFrame:
    """Leader groups of near hashes. Rows of one hash go where the first of them goes, so only different hashes are worked through."""
    e = stage_table(hamming_join(df, id_, hash_, t), "near")
    lead = leader_groups(e.filter("d > 0").select("i", "j"), df.select(F.col(id_).alias("id"), F.col(id_).alias("ord")))
    same = e.filter("d = 0").select(F.col("i").alias("first"), F.col("j").alias("other"))
    of = lead.select(F.col("id").alias("_i"), "leader")
    rest = same.join(of, F.col("first") == F.col("_i"), "left").select(F.col("other").alias("id"), F.coalesce("leader", "first").alias("leader"))
    heads = same.select(F.col("first").alias("id")).distinct().join(of, F.col("id") == F.col("_i"), "left_anti").select("id", F.col("id").alias("leader"))
    return lead.union(rest).union(heads)
