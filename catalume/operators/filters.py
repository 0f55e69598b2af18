"""Composable filters of an item table, and the joins that they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.text import has_phrases

#: States of the ledger in which an item isn't in its place.
ACTIVE_STATES = ("trashed", "emptied", "missing")


def join_decisions(images: DataFrame, decisions: DataFrame, copies: DataFrame) -> DataFrame:
    """Adds mark (by hash), override (by hash and path) and has_override."""
    d = decisions.select(F.col("hash").alias("_h"), F.col("decision").alias("mark"))
    c = copies.select(F.col("hash").alias("_ch"), F.col("path").alias("_cp"), F.col("decision").alias("override"), F.lit(True).alias("_has"))
    x = images.join(d, images["content_hash"] == d["_h"], "left").join(c, (images["content_hash"] == c["_ch"]) & (images["path"] == c["_cp"]), "left")
    return x.withColumn("has_override", F.coalesce("_has", F.lit(False))).drop("_h", "_ch", "_cp", "_has")


def effective_decision(images: DataFrame, decisions: DataFrame, copies: DataFrame) -> DataFrame:
    """Adds decision: an override of the copy wins even if it is null."""
    x = join_decisions(images, decisions, copies)
    return x.withColumn("decision", F.when(F.col("has_override"), F.col("override")).otherwise(F.col("mark"))).drop("mark", "override", "has_override")


def with_trash_state(images: DataFrame, ledger: DataFrame, states: tuple[str, ...] = ACTIVE_STATES) -> DataFrame:
    """Adds trash_state, original_path, trashed_at of the newest active ledger row of the path."""
    row = F.struct("state", "from_path", "trashed_at")
    newest = ledger.filter(F.col("state").isin(list(states))).groupBy("trash_path").agg(F.max_by(row, "id").alias("_row"))
    x = images.join(newest, images["path"] == newest["trash_path"], "left")
    return x.withColumns({"trash_state": F.col("_row.state"), "original_path": F.col("_row.from_path"), "trashed_at": F.col("_row.trashed_at")}).drop("_row", "trash_path")


def text_search(df: DataFrame, col: str, q: str) -> DataFrame:
    return df.filter(has_phrases(F.col(col), q))


def score_range(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Within the range; the full range is no condition, any other leaves nulls out."""
    return df if lo <= 0 and hi >= 1 else df.filter(F.col(col).between(lo, hi))


def in_folder(df: DataFrame, folder: str, recursive: bool = True) -> DataFrame:
    prefix = folder.rstrip("/") + "/"
    x = df.filter(F.col("path").startswith(prefix))
    return x if recursive else x.filter(F.instr(F.substr("path", F.lit(len(prefix) + 1)), "/") == 0)


def with_all_tags(df: DataFrame, image_tags: DataFrame, tags: list[str]) -> DataFrame:
    wanted = sorted(set(tags))
    if not wanted:
        return df
    hit = image_tags.filter(F.col("tag").isin(wanted)).groupBy("image_id").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(wanted))
    return df.join(hit, df["id"] == hit["image_id"], "left_semi")


def with_any_person(df: DataFrame, faces: DataFrame, cluster_ids: list[int]) -> DataFrame:
    if not cluster_ids:
        return df
    f = faces.filter(F.col("cluster_id").isin(list(cluster_ids)))
    return df.join(f, df["id"] == f["image_id"], "left_semi")


def verdicts(csv: str) -> set[str]:
    """keep, del and none from a list in text; unmarked and new mean none, others are dropped."""
    names = {"unmarked": "none", "new": "none"}
    return {names.get(t, t) for t in (p.strip().lower() for p in csv.split(","))} & {"keep", "del", "none", "all"}


def decision_in(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Nothing, all three, or 'all' is no condition."""
    if not wanted or "all" in wanted or wanted >= {"keep", "del", "none"}:
        return df
    parts = [F.col("decision").isNull() if w == "none" else F.col("decision") == w for w in sorted(wanted)]
    return df.filter(F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False)))


def lifecycle_in(df: DataFrame, states: set[str]) -> DataFrame:
    """active, trashed, any; nothing means active."""
    if "any" in states:
        return df
    parts = []
    if "active" in states or not states:
        parts.append(F.col("trash_state").isNull())
    if "trashed" in states:
        parts.append(F.coalesce(F.col("trash_state") == "trashed", F.lit(False)))
    return df.filter(reduce(lambda a, b: a | b, parts)) if parts else df


def dup_mode(df: DataFrame, mode: str) -> DataFrame:
    return df.filter(F.col("dup_group").isNotNull() if mode == "groups-only" else F.col("dup_group").isNull())


def hide_duplicates(df: DataFrame, all_images: DataFrame) -> DataFrame:
    """Loose rows and the best of each group, chosen over the whole group before any filter."""
    w = Window.partitionBy("dup_group").orderBy(F.desc_nulls_last("combined"), "id")
    best = all_images.filter("dup_group is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("id").alias("_best"))
    x = df.join(best, df["id"] == best["_best"], "left")
    return x.filter(F.col("dup_group").isNull() | F.col("_best").isNotNull()).drop("_best")


def junk(df: DataFrame, threshold: float = 0.25) -> DataFrame:
    return df.filter(F.col("combined") < threshold)


def image_filter(df: DataFrame, spec: dict, image_tags: DataFrame | None = None, faces: DataFrame | None = None) -> DataFrame:
    """All conditions of a spec on a table that has decision and trash_state."""
    for col in ("combined", "sharpness", "para_aesthetic", "portrait"):
        df = score_range(df, col, *spec.get(col, (0.0, 1.0)))
    if spec.get("folder"):
        df = in_folder(df, spec["folder"], spec.get("recursive", True))
    if spec.get("q"):
        df = text_search(df, spec.get("text", "filename"), spec["q"])
    df = decision_in(df, spec.get("decision", set()))
    df = lifecycle_in(df, spec.get("lifecycle", set()))
    if spec.get("tags"):
        df = with_all_tags(df, image_tags, spec["tags"])
    return with_any_person(df, faces, spec.get("people", []))
