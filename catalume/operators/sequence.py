"""Ordered operators without a global window: scenes, bursts, ranks and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scores import dot, hamming64, keeper_score
from catalume.functions.text import stem, suffix
from catalume.sources.scratch import stage_table

#: Rows are ordered within buckets of so many seconds.
BUCKET = 86400.0


def prefix_sum(df: DataFrame, bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Running sum (this row included) in the order (bucket, order): inside each bucket, plus the sums of the buckets before."""
    x = df.withColumn("_v", value)
    inside = F.sum("_v").over(Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = x.groupBy(bucket).agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
    starts = sums.select(F.col(bucket).alias("_b"), before.alias("_o"))
    x = x.withColumn("_in", inside)
    return x.join(starts, x[bucket] == starts["_b"]).withColumn(out, F.col("_in") + F.col("_o")).drop("_v", "_in", "_b", "_o")


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the number of each row in its group, from 0 in the order (which tells rows apart).

    Rows are cut into ranges by samples of (group, order), so a hot group is many tasks; a table of a row for
    each range, and one for each group more, tells where a range starts.
    """
    keys = [*groups, *order]
    x = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    x = stage_table(x.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    parts = x.groupBy(*groups, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_some"))
    before = F.coalesce(F.sum("_some").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(groups)], F.col("_part").alias("_p"), (before - F.col("_low")).alias("_shift"))
    on = x["_part"] == parts["_p"]
    for k, c in enumerate(groups):
        on &= x[c].eqNullSafe(parts[f"_g{k}"])
    return x.join(parts, on).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def with_previous(df: DataFrame, bucket: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_<c>: the values of the row before, in the order (bucket, order), over all buckets."""
    row = F.struct(*[F.col(c) for c in columns])
    inside = F.lag(row).over(Window.partitionBy(bucket).orderBy(*order))
    last = df.groupBy(bucket).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(Window.orderBy(bucket))  # a row for each bucket
    ends = last.select(F.col(bucket).alias("_b"), before.alias("_before"))
    x = df.withColumn("_inside", inside)
    x = x.join(ends, x[bucket] == ends["_b"]).withColumn("_p", F.coalesce("_inside", "_before"))
    return x.withColumns({f"prev_{c}": F.col(f"_p.{c}") for c in columns}).drop("_inside", "_b", "_before", "_p")


def _numbered_segments(x: DataFrame, cut: Column, id_: str, out: str) -> DataFrame:
    """id -> number of its segment, counting from 0 in order only those of two rows or more; others null."""
    x = prefix_sum(x, "bucket", ["t", "path"], cut.cast("long"), "seg")
    segs = x.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("bucket"))
    dense = prefix_sum(segs, "bucket", ["seg"], (F.col("n") > 1).cast("long"), "upto")
    dense = dense.select(F.col("seg").alias("_g"), F.when(F.col("n") > 1, F.col("upto") - 1).alias(out))
    return x.join(dense, x["seg"] == dense["_g"]).select(id_, out)


def segment_scenes(df: DataFrame, time: str = "capture_time", id_: str = "id", path: str = "path", vec: str | None = None, hash_: str | None = None, big: float = 3600.0, small: float = 120.0, sim: float = 0.85, dist: int = 18) -> DataFrame:
    """(id, scene_group): cut where the gap exceeds ``big``, or exceeds ``small`` and the look isn't similar.

    Similar: cosine of vectors if both have one, else Hamming distance of hashes, else not. Rows
    without time are left out. Scenes of one row have null. Exact for any gap, since each bucket
    of a day gets the last row of the bucket before from a small table.
    """
    cols = [F.col(vec).alias("vec") if vec else F.lit(None).cast("array<double>").alias("vec"), F.col(hash_).alias("hash") if hash_ else F.lit(None).cast("string").alias("hash")]
    t = F.col(time).cast("double")
    x = df.filter(t.isNotNull()).select(F.col(id_), t.alias("t"), F.col(path).alias("path"), *cols).withColumn("bucket", F.floor(F.col("t") / BUCKET))
    keep = ["t", *(["vec"] if vec else []), *(["hash"] if hash_ else [])]
    x = with_previous(x, "bucket", ["t", "path"], keep)
    alike = F.lit(False)
    if hash_:
        alike = F.coalesce(hamming64(F.col("hash"), F.col("prev_hash")) <= dist, F.lit(False))
    if vec:
        alike = F.when(F.col("vec").isNotNull() & F.col("prev_vec").isNotNull(), dot(F.col("vec"), F.col("prev_vec")) >= sim).otherwise(alike)
    gap = F.col("t") - F.col("prev_t")
    cut = F.coalesce((gap > big) | ((gap > small) & ~alike), F.lit(True))
    return _numbered_segments(x, cut, id_, "scene_group")


def _beyond(x: DataFrame, span: float, width: float) -> DataFrame:
    """(id, next): for each row the first one of its segment that is more than ``span`` seconds later; none: not in the table.

    x: seg, t, path, id. No gap in a segment is wider than ``width``, so the row is in the stretch of ``width``
    seconds that the end of the span is in, or is the first of the stretch after it.
    """
    part = lambda c: F.floor(c / width).cast("long").alias("part")
    me = F.struct("t", "path", "id")
    rows = x.select("seg", part(F.col("t")), F.col("t").alias("at"), F.lit(0).alias("asks"), me.alias("row"), F.lit(None).cast("long").alias("of"))
    asks = x.select("seg", part(F.col("t") + span), (F.col("t") + span).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("id").alias("of"))
    w = Window.partitionBy("seg", "part").orderBy(F.desc("at"), F.desc("asks"), F.desc("row"))
    found = rows.union(asks).withColumn("found", F.last("row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("asks = 1")
    first = rows.groupBy("seg", (F.col("part") - 1).alias("part")).agg(F.min("row").alias("later"))
    y = found.join(first, ["seg", "part"], "left").withColumn("found", F.coalesce("found", "later")).filter("found is not null")
    return y.select(F.col("of").alias("id"), F.col("found.id").alias("next"))


def burst_runs(df: DataFrame, id_: str = "id", time: str = "capture_time", vec: str = "embedding", path: str = "path", gap: float = 8.0, span: float = 30.0, sim: float = 0.80) -> DataFrame:
    """(id, run): neighbours at most ``gap`` seconds apart and alike, a run no longer than ``span`` seconds from its start.

    Gaps and looks cut the rows, in the order of time, path and id, into segments. In a segment a run
    starts at its first row and then at the first row beyond the span of each start. Where a start leads
    is a table of (row, next); which rows are reached from the first ones is found by
    doubling: log n joins for n runs in a segment, and no segment is in one task or row. Rows
    without time or vector are in no run.
    """
    t = F.col(time).cast("double")
    order = ["t", "path", "id"]
    x = df.filter(t.isNotNull() & F.col(vec).isNotNull()).select(F.col(id_).cast("long").alias("id"), t.alias("t"), F.col(path).alias("path"), F.col(vec).alias("vec")).withColumn("bucket", F.floor(F.col("t") / BUCKET))
    x = with_previous(x, "bucket", order, ["t", "vec"])
    cut = F.coalesce((F.col("t") - F.col("prev_t") > gap) | (dot(F.col("vec"), F.col("prev_vec")) < sim), F.lit(True))
    x = x.select("id", "t", "path", "bucket", cut.alias("cut"))
    x = stage_table(prefix_sum(x, "bucket", order, F.col("cut").cast("long"), "seg"), "segments")
    wide = x.groupBy("seg").agg((F.max("t") - F.min("t")).alias("wide")).filter(F.col("wide") > span).select("seg")
    jump = stage_table(_beyond(x.join(wide, "seg", "left_semi"), span, max(gap, span, 1.0)), "jumps")
    # heads, and what is reached from them in 1, 2, 4 ... jumps
    starts = x.filter("cut").join(wide, "seg", "left_semi").select("id")
    while not jump.isEmpty():
        starts = stage_table(starts.union(starts.join(jump, "id").select("next")), "starts")
        jump = stage_table(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("beyond")), "next").select("id", F.col("beyond").alias("next")), "jumps")
    marked = x.join(starts.distinct().withColumn("start", F.lit(True)), "id", "left")
    new = (F.col("cut") | F.coalesce("start", F.lit(False))).cast("long")
    return prefix_sum(marked, "bucket", order, new, "run").select("id", "run")


def representative(df: DataFrame, group: str) -> DataFrame:
    """Adds rep_rank in the group: most central, then best, then first."""
    w = Window.partitionBy(group).orderBy(F.coalesce("dup_central", F.lit(-1.0)).desc(), F.coalesce("combined", F.lit(0.0)).desc(), "id")
    return df.filter(F.col(group).isNotNull()).withColumn("rep_rank", F.row_number().over(w))


def rank_keepers(df: DataFrame, group: str) -> DataFrame:
    """Adds keeper_rank of active members."""
    score = F.coalesce(keeper_score(F.col("combined"), F.col("portrait")), F.lit(-1.0))
    w = Window.partitionBy(group).orderBy(score.desc(), "id")
    return df.filter(F.col(group).isNotNull() & F.col("trash_state").isNull()).withColumn("keeper_rank", F.row_number().over(w))


def score_margin(df: DataFrame, group: str, least: float = 0.02) -> DataFrame:
    """group, winner, margin over the runner-up, clear (margin of ``least`` or more)."""
    score = F.coalesce(keeper_score(F.col("combined"), F.col("portrait")), F.lit(-1.0))
    w = Window.partitionBy(group).orderBy(F.col("_s").desc(), "id")
    x = df.filter(F.col(group).isNotNull()).withColumn("_s", score)
    x = x.withColumn("_n", F.lead("_s").over(w)).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    x = x.select(group, F.col("id").alias("winner"), F.round(F.col("_s") - F.col("_n"), 6).alias("margin"))
    return x.withColumn("clear", F.coalesce(F.col("margin") >= least, F.lit(False)))


def renumber(df: DataFrame, group: str, time: str = "capture_time", path: str = "path", out: str = "number") -> DataFrame:
    """Groups numbered from 0 by least time (missing: 0), then least path; adds the number and the place in the group."""
    t = F.coalesce(F.col(time).cast("double"), F.lit(0.0))
    x = df.filter(F.col(group).isNotNull()).withColumn("_t", t)
    g = x.groupBy(group).agg(F.min("_t").alias("t0"), F.min(path).alias("p0"))
    g = numbered(g, [], ["t0", "p0", group], "k").select(F.col(group).alias("_g"), F.col("k").alias(out))
    w = Window.partitionBy(group).orderBy("_t", path)
    return x.withColumn("place", F.row_number().over(w)).join(g, F.col(group) == F.col("_g")).drop("_t", "_g")


def unique_names(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """moves (id, dir, name) with dest: the name, or stem_k.suffix with the least free k.

    Taken are the names in ``existing`` (dir, name) and the names that moves have themselves; moves of
    one name get numbers in the order of their ids (each its own). Nothing is gathered by name or folder: ranks
    of moves and of taken numbers are put in one order, in which a move's place is its number.
    """
    plain = moves.withColumn("_stem", stem(F.col("name"))).withColumn("_suf", suffix(F.col("name")))
    names = existing.select("dir", "name", F.lit(0).alias("own")).union(moves.select("dir", "name", F.lit(1).alias("own")).distinct())
    base = names.withColumn("_st", stem(F.col("name"))).withColumn("_su", suffix(F.col("name")))
    zero = base.filter("own = 0").select("dir", F.col("_st").alias("_stem"), F.col("_su").alias("_suf"), F.lit(0).alias("k"))
    nth = base.withColumn("k", F.regexp_extract("_st", r"_([1-9]\d{0,8})$", 1)).filter("k != ''")
    nth = nth.select("dir", F.regexp_replace("_st", r"_[1-9]\d{0,8}$", "").alias("_stem"), F.col("_su").alias("_suf"), F.col("k").try_cast("int").alias("k"))
    place = ["dir", "_stem", "_suf"]
    # i of the taken numbers are less than the i-th, so it comes after k - i free ones
    taken = numbered(zero.union(nth).distinct(), place, ["k"], "_i").select(*place, (F.col("k") - F.col("_i")).alias("_r"), F.lit(0).alias("_kind"), F.lit(None).cast(moves.schema["id"].dataType).alias("id"), F.col("k").alias("_k"))
    own = numbered(plain.select(*place, "id"), place, ["id"], "_r").select(*place, "_r", F.lit(1).alias("_kind"), "id", F.lit(None).cast("int").alias("_k"))
    # the r-th free number: one more for each taken one that comes after r free ones at most
    both = numbered(taken.unionByName(own), place, ["_r", "_kind", "_k", "id"], "_n").filter("_kind = 1").select(F.col("id").alias("_id"), F.col("_n").alias("k"))
    x = plain.join(both, plain["id"] == both["_id"])
    dest = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("_stem", F.lit("_"), F.col("k").cast("string"), "_suf"))
    return x.withColumn("dest", dest).select(*moves.columns, "dest")
