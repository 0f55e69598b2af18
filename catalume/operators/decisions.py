"""Keep and delete decisions, automatic culling, and the ledger of moves: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scores import keeper_score
from catalume.functions.text import basename, dirname
from catalume.operators.sequence import unique_names

MARGIN = 0.02


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same keys; of several changes the last by ``order``."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        changes = changes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    new = changes.select(*base.columns)
    return delete_keys(base, new.select(*keys), keys).unionByName(new)


def insert_new(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``base`` are added, one for each key."""
    return base.unionByName(delete_keys(rows.select(*base.columns).dropDuplicates(keys), base.select(*keys), keys))


def delete_keys(base: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    k = keys_df.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
    on = None
    for c in keys:
        same = base[c].eqNullSafe(k[f"_k_{c}"])
        on = same if on is None else on & same
    return base.join(k, on, "left_anti")


def has_other_copy(updates: DataFrame, images: DataFrame, copies: DataFrame) -> DataFrame:
    """Adds routed: another path has the hash, or the copy has an override already."""
    paths = images.filter("content_hash is not null").groupBy(F.col("content_hash").alias("_h")).agg(F.count_distinct("path").alias("_n"), F.min("path").alias("_p"))
    own = copies.select(F.col("hash").alias("_ch"), F.col("path").alias("_cp"), F.lit(True).alias("_has")).distinct()
    x = updates.join(paths, updates["hash"] == paths["_h"], "left").join(own, (updates["hash"] == own["_ch"]) & (updates["path"] == own["_cp"]), "left")
    other = (F.col("_n") > 1) | (F.col("_p") != F.col("path"))
    return x.withColumn("routed", F.col("path").isNotNull() & (F.coalesce(other, F.lit(False)) | F.coalesce("_has", F.lit(False)))).select(*updates.columns, "routed")


def write_decisions(updates: DataFrame, images: DataFrame, decisions: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each update (hash, path, decision) goes to the copies if the hash has several, else to the decisions; null deletes a mark."""
    x = has_other_copy(updates, images, copies)
    copies = upsert(copies, x.filter("routed").select("path", "hash", "decision"), ["path", "hash"])
    plain = x.filter("not routed").groupBy("hash").agg(F.max("decision").alias("decision"))
    kept = upsert(decisions, plain.filter("decision is not null"), ["hash"])
    return delete_keys(kept, plain.filter("decision is null").select("hash"), ["hash"]), copies


def check_guard(updates: DataFrame, images: DataFrame) -> DataFrame:
    """Updates (id, hash, path, expected) that don't fit the table (images has decision and trash_state), with why; nothing may be written unless there are none."""
    i = images.select(F.col("id").alias("_i"), F.col("content_hash").alias("_h"), F.col("path").alias("_p"), F.col("decision").alias("_d"), "trash_state")
    x = updates.join(i, updates["id"] == i["_i"], "left")
    why = (
        F.when(F.col("_i").isNull(), "unknown").when(~F.col("hash").eqNullSafe(F.col("_h")), "hash").when(~F.col("path").eqNullSafe(F.col("_p")), "path")
        .when(F.col("trash_state").isNotNull(), "trashed").when(~F.col("expected").eqNullSafe(F.col("_d")), "decision")
    )
    return x.withColumn("why", why).filter("why is not null").select("id", "why")


def cull_plan(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to mark (id, dup_group, hash, path, previous, decision) and the groups (dup_group, needs_review).

    images has decision and trash_state. Of each hash in a group the representative is the kept
    or best row. A group is safe if it has several representatives, all its members are safe to
    cull, the runner-up has a score, the best leads by the margin, and nobody else is kept. A
    safe group is one set; else each hash with copies is one. The winner of a set is kept, the
    others are deleted unless kept already. Windows only.
    """
    m = images.filter("dup_group is not null and trash_state is null and content_hash is not null")
    rank = F.coalesce(keeper_score(F.col("combined"), F.col("portrait")), F.lit(-1.0))
    m = m.withColumn("_rank", rank).withColumn("_keep", F.coalesce(F.col("decision") == "keep", F.lit(False)))
    best = [F.col("_keep").desc(), F.col("_rank").desc(), F.col("id").asc()]
    m = m.withColumn("_rep", F.row_number().over(Window.partitionBy("dup_group", "content_hash").orderBy(*best)) == 1)
    m = m.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("dup_group", "content_hash")))
    order = Window.partitionBy("dup_group").orderBy(F.col("_rank").desc(), "id")
    reps = m.filter("_rep").withColumn("_k", F.row_number().over(order))
    top = reps.groupBy("dup_group").agg(
        F.count(F.lit(1)).alias("_reps"), F.max(F.when(F.col("_k") == 1, F.col("id"))).alias("_win"), F.max(F.when(F.col("_k") == 1, F.col("_rank"))).alias("_r1"),
        F.max(F.when(F.col("_k") == 2, F.col("_rank"))).alias("_r2"), F.max(F.when(F.col("_k") == 2, F.col("combined"))).alias("_c2"),
    )
    m = m.join(top, "dup_group")
    group = Window.partitionBy("dup_group")
    fine = F.bool_and(F.coalesce("dup_cull_safe", F.lit(False))).over(group) & ~F.bool_or(F.col("_keep") & (F.col("id") != F.col("_win"))).over(group)
    lead = (F.col("_reps") > 1) & F.col("_c2").isNotNull() & (F.round(F.col("_r1") - F.col("_r2"), 6) >= MARGIN)
    m = m.withColumn("_safe", F.coalesce(fine & lead, F.lit(False)))
    sets = m.filter("_safe or _copies > 1").withColumn("_set", F.when(F.col("_safe"), F.lit("")).otherwise(F.col("content_hash")))
    won = F.row_number().over(Window.partitionBy("dup_group", "_set").orderBy(*best)) == 1
    plan = sets.withColumn("_won", won).filter("_won or not _keep")
    plan = plan.select("id", "dup_group", F.col("content_hash").alias("hash"), "path", F.col("decision").alias("previous"), F.when(F.col("_won"), "keep").otherwise("del").alias("decision"))
    review = m.groupBy("dup_group").agg(F.bool_or((F.col("_reps") > 1) & ~F.col("_safe")).alias("needs_review"))
    return plan, review


def cull_preview(plan: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    changes = plan.filter(~F.col("previous").eqNullSafe(F.col("decision")) | (F.col("decision") == "keep"))
    return changes, review.agg(F.count_if(F.col("needs_review")).alias("review"))


def cull_apply(plan: DataFrame, review: DataFrame, images: DataFrame, decisions: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New decisions and copies, and the counts of groups, kept, deleted and to review."""
    d, c = write_decisions(plan.select("hash", "path", "decision"), images, decisions, copies)
    groups = images.agg(F.count_distinct("dup_group").alias("groups"))
    marks = plan.agg(F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "del").alias("deleted"))
    return d, c, groups.crossJoin(marks).crossJoin(review.agg(F.count_if(F.col("needs_review")).alias("review")))  # one row each


def export_decisions(images: DataFrame) -> DataFrame:
    """bucket, hash, path, filename, combined, copy_specific (images has decision and has_override)."""
    bucket = F.when(F.col("decision") == "keep", "kept").when(F.col("decision") == "del", "deleted").otherwise("unmarked")
    return images.select(bucket.alias("bucket"), F.col("content_hash").alias("hash"), "path", "filename", "combined", F.col("has_override").alias("copy_specific"))


def import_decisions(entries: DataFrame, images: DataFrame, decisions: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (bucket, hash, path, copy_specific) added to the tables; counts of applied and unmatched ones.

    A hash is taken as it is, also if it is unknown; without one the path finds it. An override
    needs its path and hash to be present. Unmarked entries count only as overrides.
    """
    verdict = F.when(F.col("bucket") == "kept", "keep").when(F.col("bucket") == "deleted", "del")
    by_path = images.groupBy(F.col("path").alias("_p")).agg(F.min("content_hash").alias("_h"))
    here = images.select(F.col("path").alias("_cp"), F.col("content_hash").alias("_ch"), F.lit(True).alias("_here")).distinct()
    x = entries.join(by_path, entries["path"] == by_path["_p"], "left").withColumn("_hash", F.coalesce("hash", "_h"))
    x = x.join(here, (F.col("path") == F.col("_cp")) & (F.col("_hash") == F.col("_ch")), "left").withColumn("decision", verdict)
    special = F.coalesce("copy_specific", F.lit(False))
    ok = F.when(special, F.coalesce("_here", F.lit(False))).otherwise(F.col("_hash").isNotNull() & F.col("decision").isNotNull())
    x = x.withColumn("_ok", ok).withColumn("_special", special)
    new_c = x.filter("_ok and _special").select("path", F.col("_hash").alias("hash"), "decision")
    new_d = x.filter("_ok and not _special").groupBy(F.col("_hash").alias("hash")).agg(F.max("decision").alias("decision"))
    counted = x.filter(F.col("_special") | F.col("decision").isNotNull())
    counts = counted.agg(F.count_if(F.col("_ok")).alias("applied"), F.count_if(~F.col("_ok")).alias("unmatched"))
    return upsert(decisions, new_d, ["hash"]), upsert(copies, new_c, ["path", "hash"]), counts


def migrate_path_decisions(path_decisions: DataFrame, images: DataFrame) -> DataFrame:
    i = images.filter("content_hash is not null").select(F.col("path").alias("_p"), F.col("content_hash").alias("hash"))
    x = path_decisions.join(i, path_decisions["path"] == i["_p"])
    return x.groupBy("hash").agg(F.max("decision").alias("decision"))


def trash_plan(images: DataFrame, existing: DataFrame, root: str, ids: DataFrame | None = None, trash_dir: str = "_trash", files: DataFrame | None = None) -> DataFrame:
    """id, hash, from_path, trash_path of what is marked del (or of ``ids``), active, and not inside the trash folder (images has decision and trash_state).

    There is one trash folder, at the root of the library, so names of different folders collide
    there. Names are unique among ``existing`` (dir, name) and the moves themselves. ``files``
    (path): what is there; items whose file is gone aren't moved.
    """
    trash = f"{root.rstrip('/')}/{trash_dir}"
    pick = images.filter("decision = 'del'") if ids is None else images.join(ids.select("id"), "id", "left_semi")
    x = pick.filter(F.col("trash_state").isNull() & ~F.col("path").startswith(f"{trash}/"))
    if files is not None:
        x = x.join(files.select("path"), "path", "left_semi")
    moves = x.select("id", F.lit(trash).alias("dir"), basename(F.col("path")).alias("name"), F.col("content_hash").alias("hash"), F.col("path").alias("from_path"))
    named = unique_names(moves, existing)
    return named.select("id", "hash", "from_path", F.concat_ws("/", "dir", "dest").alias("trash_path"))


def _moved_overrides(copies: DataFrame, moves: DataFrame) -> DataFrame:
    """Overrides (path, hash) with their new paths; one that is at the new place already is replaced. moves: from_path, hash, to_path."""
    m = moves.filter("hash is not null").select(F.col("from_path").alias("_f"), F.col("hash").alias("_h"), F.col("to_path").alias("_t"))
    here = (copies["path"] == m["_f"]) & (copies["hash"] == m["_h"])
    went = copies.join(m, here).withColumn("path", F.col("_t")).select(*copies.columns)
    return delete_keys(copies.join(m, here, "left_anti"), went.select("path", "hash"), ["path", "hash"]).unionByName(went)


def apply_trash(plan: DataFrame, images: DataFrame, copies: DataFrame, ledger: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items and overrides (by path and hash) with their new paths, and the ledger with the new rows (ids after the largest)."""
    p = plan.select(F.col("id").alias("_i"), F.col("from_path").alias("_f"), F.col("hash").alias("_h"), F.col("trash_path").alias("_t"))
    moved = images.join(p, images["id"] == p["_i"], "left").withColumn("path", F.coalesce("_t", "path")).select(*images.columns)
    over = _moved_overrides(copies, plan.select("from_path", "hash", F.col("trash_path").alias("to_path")))
    top = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    w = Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64)))  # numbered in 64 parts
    n = plan.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(64)))
    counts = n.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("_k", F.row_number().over(w.orderBy("id"))).join(counts, "_b").crossJoin(F.broadcast(top))  # one row
    rows = n.select((F.col("_top") + F.col("_o") + F.col("_k")).alias("id"), F.col("id").alias("image_id"), "hash", "from_path", "trash_path", F.lit("trashed").alias("state"), F.lit(now).alias("trashed_at"))
    return moved, over, ledger.unionByName(rows, allowMissingColumns=True)


def restore_plan(ledger: DataFrame, existing: DataFrame) -> DataFrame:
    """Ledger with trashed rows restored if their file (existing: path) is there, else missing."""
    e = existing.select(F.col("path").alias("_p")).distinct()
    x = ledger.join(e, ledger["trash_path"] == e["_p"], "left")
    state = F.when(F.col("state") == "trashed", F.when(F.col("_p").isNotNull(), "restored").otherwise("missing")).otherwise(F.col("state"))
    return x.withColumn("state", state).drop("_p")


def restore_moves(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """id, hash, trash_path, to_path of the trashed rows whose file is there: back to where it was, or to a free name beside it.

    files: path of all that is there. The newest rows come first, so of several from one place the newest gets it.
    """
    there = ledger.filter("state = 'trashed'").join(files.select(F.col("path").alias("trash_path")), "trash_path", "left_semi")
    moves = there.select((-F.col("id")).alias("id"), dirname(F.col("from_path")).alias("dir"), basename(F.col("from_path")).alias("name"), "hash", "trash_path")
    existing = files.select(dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"))
    return unique_names(moves, existing).select((-F.col("id")).alias("id"), "hash", "trash_path", F.concat_ws("/", "dir", "dest").alias("to_path"))


def apply_restore(ledger: DataFrame, files: DataFrame, images: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items and overrides with the paths of restored files, and the ledger: restored, or missing if the file is gone."""
    moves = restore_moves(ledger, files)
    m = moves.select(F.col("trash_path").alias("_f"), F.col("to_path").alias("_t"))
    back = images.join(m, images["path"] == m["_f"], "left").withColumn("path", F.coalesce("_t", "path")).select(*images.columns)
    over = _moved_overrides(copies, moves.select(F.col("trash_path").alias("from_path"), "hash", "to_path"))
    return back, over, restore_plan(ledger, files)


def empty_plan(ledger: DataFrame, trash_dir: str = "_trash", files: DataFrame | None = None) -> DataFrame:
    """Ledger with trashed rows emptied whose folder is the trash folder itself; with ``files`` (path of all that is there) those whose file is gone are missing."""
    ok = (F.col("state") == "trashed") & (basename(dirname(F.col("trash_path"))) == trash_dir)
    if files is None:
        return ledger.withColumn("state", F.when(ok, "emptied").otherwise(F.col("state")))
    there = files.select(F.col("path").alias("_p")).distinct()
    x = ledger.join(there, ledger["trash_path"] == there["_p"], "left")
    return x.withColumn("state", F.when(ok, F.when(F.col("_p").isNotNull(), "emptied").otherwise("missing")).otherwise(F.col("state"))).drop("_p")


def keep_one_preview(pool: DataFrame, keep_id: int, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """Changes if one row of a pool is kept, and whether a rival with another hash is close or can't be compared."""
    verdict = F.when(F.col("id") == keep_id, "keep").otherwise("del")
    changes = pool.withColumn("new", verdict).filter((F.col("new") == "keep") | ~F.col("decision").eqNullSafe(F.col("new"))).select("id", F.col("decision").alias("previous"), F.col("new").alias("decision"))
    k = pool.filter(F.col("id") == keep_id).select(F.col("content_hash").alias("_h"), keeper_score(F.col("combined"), F.col("portrait")).alias("_s"))
    s = keeper_score(F.col("combined"), F.col("portrait"))
    rivals = pool.filter(F.col("id") != keep_id).crossJoin(F.broadcast(k)).filter(~F.col("content_hash").eqNullSafe(F.col("_h")))  # one row
    first = rivals.agg(F.min_by(F.struct(s.alias("s"), "_s"), F.struct(-F.coalesce(s, F.lit(-1.0)), "id")).alias("r"), F.count(F.lit(1)).alias("n"))
    close = F.when(F.col("n") == 0, False).otherwise(F.coalesce(F.abs(F.round(F.col("r._s") - F.col("r.s"), 6)) <= margin, F.lit(True)))
    return changes, first.select(close.alias("close_call"))


def visible_members(members: DataFrame, group: str, show_deleted: bool, show_culled: bool) -> DataFrame:
    """Without trashed and culled rows, unless nothing of the group would be left."""
    ok = F.lit(True)
    if not show_deleted:
        ok = ok & F.col("trash_state").isNull()
    if not show_culled:
        ok = ok & ~F.coalesce(F.col("decision") == "del", F.lit(False))
    w = Window.partitionBy(group)
    x = members.withColumn("_ok", ok).withColumn("_n", F.count_if(F.col("_ok")).over(w))
    return x.filter("_ok or _n = 0").drop("_ok", "_n")


def paired_faces(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, left_face (the largest of the left photo), right_face (the largest of its person in the right photo)."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    size = F.struct(side("x1", "x2") * side("y1", "y2"), -F.col("id"))
    one = faces.groupBy("image_id").agg(F.max_by(F.struct("id", "cluster_id"), size).alias("f"))
    each = faces.groupBy("image_id", "cluster_id").agg(F.max_by("id", size).alias("right_face"))
    x = pairs.join(one, pairs["left"] == one["image_id"]).select("left", "right", F.col("f.id").alias("left_face"), F.col("f.cluster_id").alias("_c"))
    e = each.select(F.col("image_id").alias("_i"), F.col("cluster_id").alias("_k"), "right_face")
    return x.join(e, (F.col("right") == F.col("_i")) & (F.col("_c") == F.col("_k")), "left").select("left", "right", "left_face", "right_face")
