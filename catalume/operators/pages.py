"""Sorted pages, grouped pages, and small set operations on paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scores import face_quality
from catalume.functions.text import dirname

SORTS = ("combined", "sharpness", "aesthetic", "portrait", "filename")


def _sort_key(name: str) -> Column:
    if name == "aesthetic":
        return F.coalesce("para_aesthetic", "clip_iqa")
    return F.col(name if name in SORTS else "combined")


def page(df: DataFrame, sort: str = "combined", direction: str = "desc", offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows of a page (at most 300) and the total. Nulls come first going up, last going down; ties by id."""
    key = _sort_key(sort)
    rows = df.orderBy(key.asc() if direction == "asc" else key.desc(), "id").offset(offset).limit(min(limit, 300))
    return rows, df.agg(F.count(F.lit(1)).alias("total"))


def worst(df: DataFrame, n: int = 30) -> DataFrame:
    return df.orderBy("combined", "id").limit(n)


def person_faces(star: DataFrame, cluster_id: int, sort: str = "quality", offset: int = 0, limit: int = 100) -> DataFrame:
    """Faces of a person over active photos, by quality, date, size or match; nulls last, ties by id."""
    rel = F.coalesce(F.try_divide(F.col("x2") - F.col("x1"), F.col("imgw")), F.lit(0.0))
    x = star.filter((F.col("cluster_id") == cluster_id) & F.col("trash_state").isNull()).withColumn("rel", rel)
    x = x.withColumn("quality", face_quality(F.col("sharp"), F.col("expr"), F.col("rel")))
    order = {"quality": F.col("quality").desc_nulls_last(), "date": F.col("capture_time").asc_nulls_last(), "size": F.col("rel").desc_nulls_last()}
    if "match" in star.columns:
        order["match"] = F.col("match").asc_nulls_last()
    return x.orderBy(order.get(sort, order["quality"]), "id").offset(offset).limit(limit)


def face_star(faces: DataFrame, images: DataFrame) -> DataFrame:
    """Faces with what is known of their active photo (images has decision and trash_state)."""
    i = images.filter("trash_state is null").select(F.col("id").alias("_i"), "path", "content_hash", "imgw", "capture_time", "decision", "trash_state")
    return faces.join(i, faces["image_id"] == i["_i"]).drop("_i")


def events_after(events: DataFrame, task_id: int, seq: int, task: str = "task_id") -> DataFrame:
    return events.filter((F.col(task) == task_id) & (F.col("seq") > seq)).orderBy("seq")


def list_trash(ledger: DataFrame) -> DataFrame:
    return ledger.filter("state = 'trashed'").orderBy(F.desc("trashed_at"), F.desc("id"))


def merge_folder_sets(*sets: DataFrame) -> DataFrame:
    """Distinct paths of all sets, whatever the case; of equal ones that of the first set."""
    every = None
    for k, s in enumerate(sets):
        x = s.select("path", F.lit(k).alias("k"))
        every = x if every is None else every.union(x)
    return every.groupBy(F.lower("path").alias("_l")).agg(F.min_by("path", F.struct("k", "path")).alias("path")).select("path")


def minimal_roots(dirs: DataFrame) -> DataFrame:
    """Paths that lie below no other one: each is looked up under its ancestors."""
    d = dirs.select("path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ups = d.filter(F.size(parts) > 1).select(F.col("path").alias("_p"), F.explode(above).alias("_up"))
    below = ups.join(d.select(F.col("path").alias("_up")), "_up", "left_semi").select("_p").distinct()
    return d.join(below, d["path"] == below["_p"], "left_anti")


def attach_children(images: DataFrame, faces: DataFrame, image_tags: DataFrame) -> DataFrame:
    """Adds faces[] and tags[]; none are empty arrays."""
    f = faces.groupBy(F.col("image_id").alias("_fi")).agg(F.sort_array(F.collect_list(F.struct("id", "cluster_id", "x1", "y1", "x2", "y2"))).alias("faces"))
    t = image_tags.groupBy(F.col("image_id").alias("_ti")).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    x = images.join(f, images["id"] == f["_fi"], "left").join(t, images["id"] == t["_ti"], "left").drop("_fi", "_ti")
    none = F.array().cast(f.schema["faces"].dataType)
    return x.withColumns({"faces": F.coalesce("faces", none), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def exact_copies(images: DataFrame) -> DataFrame:
    """hash, count, id, path of every item whose hash others have too."""
    h = images.filter("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return images.join(h, "content_hash").select("content_hash", "n", "id", "path")


def grouped_page(all_rows: DataFrame, matching: DataFrame, group: str, stats: list[Column], order: list[Column], offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups with a matching member: a page of them with ``stats``, all their members best first, and their number.

    One semi-join and one join, however many groups; the limit is taken before members are joined.
    """
    hit = matching.filter(F.col(group).isNotNull()).select(group).distinct()
    in_groups = all_rows.join(hit, group, "left_semi")
    groups = in_groups.groupBy(group).agg(*stats)
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    chosen = groups.orderBy(*order).offset(offset).limit(limit)
    flag = matching.select(F.col("id").alias("_m"))
    members = all_rows.join(chosen.select(group), group, "left_semi").join(flag, F.col("id") == F.col("_m"), "left").withColumn("matches", F.col("_m").isNotNull()).drop("_m")
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("combined"), "id")
    return chosen, members.withColumn("place", F.row_number().over(w)), total


def duplicate_groups(all_rows: DataFrame, matching: DataFrame, order: str = "size", offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    act = F.col("trash_state").isNull()
    stats = [F.count(F.lit(1)).alias("size"), F.count_if(act).alias("active"), F.count_if(act & F.col("decision").isNull()).alias("undecided")]
    review = (F.col("active") > 1) & (F.col("undecided") > 0)
    orders = {"size": [F.desc("size"), F.asc("dup_group")], "id": [F.asc("dup_group")], "review": [review.desc(), F.desc("active"), F.asc("dup_group")]}
    return grouped_page(all_rows, matching, "dup_group", stats, orders[order], offset, limit)


def scenes(all_rows: DataFrame, matching: DataFrame, pins: DataFrame, order: str = "time", offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adds dup_sets, manual (a pinned hash is in it) and the span of time to the groups."""
    p = pins.select(F.col("hash").alias("_h")).distinct()
    rows = all_rows.join(p, all_rows["content_hash"] == p["_h"], "left")
    stats = [F.count(F.lit(1)).alias("size"), F.count_distinct("dup_group").alias("dup_sets"), F.bool_or(F.col("_h").isNotNull()).alias("manual"), F.min("capture_time").alias("time_start"), F.max("capture_time").alias("time_end")]
    orders = {"time": [F.col("time_start").asc_nulls_last(), F.asc("scene_group")], "size": [F.desc("size"), F.asc("scene_group")], "id": [F.asc("scene_group")]}
    return grouped_page(rows, matching, "scene_group", stats, orders[order], offset, limit)


def nest_by_dup(members: DataFrame) -> DataFrame:
    """scene, dup_group (null: loose), and the ids best first."""
    item = F.struct((-F.coalesce("combined", F.lit(-1.0))).alias("k"), "id")
    x = members.filter("scene_group is not null").groupBy("scene_group", "dup_group").agg(F.sort_array(F.collect_list(item)).alias("a"))
    return x.select("scene_group", "dup_group", F.transform("a", lambda s: s["id"]).alias("items"))


def folder_of(df: DataFrame) -> DataFrame:
    return df.withColumn("folder", dirname(F.col("path")))
