"""Facets, histograms, counts and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scores import dot, face_quality, keeper_score, portrait_score
from catalume.functions.text import dirname


def histogram(df: DataFrame, col: str, bins: int = 24) -> DataFrame:
    """bin, n over [0, 1]; values are clamped, nulls skipped, empty bins kept."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(col)))
    at = F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def score_ranges(df: DataFrame) -> DataFrame:
    cols = [("combined", F.col("combined")), ("sharpness", F.col("sharpness")), ("aesthetic", F.coalesce("para_aesthetic", "clip_iqa"))]
    return df.agg(*[f(c).alias(f"{n}_{k}") for n, c in cols for k, f in (("min", F.min), ("max", F.max))])


def library_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_faces") > 0).alias("with_faces"), F.count_if(F.col("portrait").isNotNull()).alias("with_portrait"),
        F.count_distinct("dup_group").alias("dup_groups"), F.count_distinct("scene_group").alias("scene_groups"),
    )


def tag_facet(image_tags: DataFrame) -> DataFrame:
    return image_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def search_tags(facet: DataFrame, q: str, cap: int) -> DataFrame:
    """Tags that contain the text, whatever the case; the most frequent ones."""
    return facet.filter(F.lower("tag").contains(q.lower())).orderBy(F.desc("n"), "tag").limit(cap)


def person_facet(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    n = faces.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(n, "cluster_id").select("cluster_id", "name", "n")


def folder_facet(images: DataFrame, trash_dir: str) -> DataFrame:
    return images.groupBy(dirname(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("path") != trash_dir)


def folder_totals(facet: DataFrame, collapse: bool = True) -> DataFrame:
    """path, direct, total (of the subtree), children. Collapsed: chains of folders with nothing of their own and one child are left out."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    every = facet.select(F.explode(prefixes).alias("at"), F.when(F.col("at") == F.col("path"), F.col("n")).otherwise(0).alias("own"), "n")
    tree = every.groupBy("at").agg(F.sum("own").alias("direct"), F.sum("n").alias("total"))
    kids = tree.groupBy(dirname(F.col("at")).alias("up")).agg(F.count(F.lit(1)).alias("children"))
    x = tree.join(kids, tree["at"] == kids["up"], "left").select(F.col("at").alias("path"), "direct", "total", F.coalesce("children", F.lit(0)).alias("children"))
    return x.filter(~((F.col("direct") == 0) & (F.col("children") == 1))) if collapse else x


def largest_face(faces: DataFrame) -> DataFrame:
    """image_id, n_faces, and sharp, expr, portrait of the largest face (the first of equal ones)."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    big = F.max_by(F.struct("sharp", "expr"), F.struct(side("x1", "x2") * side("y1", "y2"), -F.col("id")))
    x = faces.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_faces"), big.alias("b"))
    return x.select("image_id", "n_faces", F.col("b.sharp").alias("face_sharp"), F.col("b.expr").alias("face_expr"), portrait_score(F.col("b.sharp"), F.col("b.expr")).alias("portrait"))


def reaggregate(images: DataFrame, faces: DataFrame, touched: DataFrame) -> DataFrame:
    """Face aggregates of the touched items (column id) computed anew; the others stay."""
    ids = touched.select(F.col("id").alias("_t")).distinct()
    new = largest_face(faces.join(ids, faces["image_id"] == ids["_t"], "left_semi"))
    new = new.select(F.col("image_id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in ("n_faces", "face_sharp", "face_expr", "portrait")])
    x = images.join(ids, images["id"] == ids["_t"], "left").join(new, images["id"] == new["_i"], "left")
    own = {c: F.when(F.col("_t").isNull(), F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.lit(0)) if c == "n_faces" else F.col(f"_{c}")) for c in ("n_faces", "face_sharp", "face_expr", "portrait")}
    return x.withColumns(own).select(*images.columns)


def centroids(df: DataFrame, key: str, vec: str, normalize: bool = True) -> DataFrame:
    """key, centroid (mean of unit vectors, made a unit vector if asked), n. Sums are made per dimension, so no group is collected."""
    unit = df.filter(F.col(vec).isNotNull()).select(F.col(key), F.posexplode(F.transform(vec, lambda x: x.cast("double"))).alias("d", "x"))
    dims = unit.groupBy(key, "d").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    c = dims.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("a"), F.max("n").alias("n"))
    mean = F.transform("a", lambda s: s["m"])
    c = c.select(key, mean.alias("centroid"), "n")
    if normalize:
        norm = F.sqrt(dot(F.col("centroid"), F.col("centroid")))
        c = c.withColumn("centroid", F.transform("centroid", lambda x: x / F.when(norm > 0, norm)))
    return c


def group_centrality(df: DataFrame, group: str, id_: str, vec: str) -> DataFrame:
    """Mean cosine of a unit vector to the others of its group: (v.S - v.v) / (n - 1) with the group's sum S. Groups of one have null."""
    c = centroids(df.filter(F.col(group).isNotNull()), group, vec, normalize=False)
    x = df.filter(F.col(vec).isNotNull()).join(c, group)
    v = F.col(vec)
    return x.select(id_, F.when(F.col("n") > 1, F.round((dot(v, F.col("centroid")) * F.col("n") - dot(v, v)) / (F.col("n") - 1), 4)).alias("dup_central"))


def list_people(faces: DataFrame, images: DataFrame, clusters: DataFrame) -> DataFrame:
    """People over active items (images has trash_state, imgw): faces, photos, cover face, manual, section."""
    act = images.filter("trash_state is null").select(F.col("id").alias("_i"), "imgw")
    x = faces.join(act, faces["image_id"] == act["_i"])
    rel = F.when(F.col("imgw") > 0, (F.col("x2") - F.col("x1")) / F.col("imgw"))
    q = face_quality(F.col("sharp"), F.col("expr"), F.coalesce(rel, F.lit(0.0)))
    x = x.withColumn("_c", F.when(F.col("cluster_id") >= 0, F.col("cluster_id")).otherwise(-1)).withColumn("_q", q)
    g = x.groupBy("_c").agg(F.count(F.lit(1)).alias("faces"), F.count_distinct("image_id").alias("photos"), F.max_by("id", F.struct("_q", -F.col("id"))).alias("cover_face_id"))
    named = clusters.select(F.col("cluster_id").alias("_k"), "name")
    x = g.join(named, g["_c"] == named["_k"], "left")
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    label = F.when(F.col("_c") < 0, F.lit("Unsorted faces")).when(blank, F.concat(F.lit("Person "), F.col("_c").cast("string"))).otherwise(F.col("name"))
    return x.select(F.col("_c").alias("cluster_id"), "name", label.alias("label"), "faces", "photos", "cover_face_id", (F.col("_c") >= 100000).alias("manual"))


def people_sections(people: DataFrame) -> DataFrame:
    unnamed = F.coalesce(F.trim("name"), F.lit("")) == ""
    return people.withColumn("section", F.when(F.col("cluster_id") < 0, "unsorted").when(unnamed & (F.col("faces") == 1), "once").otherwise("main"))


def top_tags(df: DataFrame, group: str, k: int = 6) -> DataFrame:
    """group, tag, n, rank: the most frequent, ties by name."""
    counts = df.groupBy(group, "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "tag")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def group_activity(df: DataFrame, group: str) -> DataFrame:
    """active, trashed and unavailable members, and whether an undecided choice is left."""
    t = F.col("trash_state")
    x = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(t.isNull()).alias("active"), F.count_if(t == "trashed").alias("trashed"), F.count_if(t.isin("emptied", "missing")).alias("unavailable"),
        F.count_if(t.isNull() & F.col("decision").isNull()).alias("_open"),
    )
    return x.withColumn("needs_review", (F.col("active") > 1) & (F.col("_open") > 0)).drop("_open")


def trash_counts(images: DataFrame, ledger: DataFrame, root: str, trash_dir: str = "_trash") -> DataFrame:
    """pending: marked del, active and not inside the trash folder, which is the one at the root; trashed and emptied ledger rows. images has decision and trash_state."""
    trash = f"{root.rstrip('/')}/{trash_dir}"
    inside = (F.col("path") == trash) | F.col("path").startswith(f"{trash}/")
    p = images.agg(F.count_if(F.coalesce((F.col("decision") == "del") & F.col("trash_state").isNull() & ~inside, F.lit(False))).alias("pending"))
    s = ledger.agg(F.count_if(F.col("state") == "trashed").alias("trashed"), F.count_if(F.col("state") == "emptied").alias("emptied"))
    return p.crossJoin(s)  # one row each


def face_size_profile(faces: DataFrame, images: DataFrame) -> DataFrame:
    """bucket, n of the face width relative to the image."""
    i = images.select(F.col("id").alias("_i"), "imgw")
    rel = F.try_divide(F.col("x2") - F.col("x1"), F.col("imgw"))
    edges = (0.02, 0.04, 0.06, 0.10, 0.20)
    bucket = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        bucket = F.when(rel < edges[k], k).otherwise(bucket)
    return faces.join(i, faces["image_id"] == i["_i"]).filter(rel.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def minmax_log(df: DataFrame, col: str) -> DataFrame:
    """Adds normalised: min-max of log1p over the table; all equal gives 0.5."""
    r = df.agg(F.log1p(F.min(col)).alias("_lo"), F.log1p(F.max(col)).alias("_hi"))
    x = df.crossJoin(F.broadcast(r))  # one row
    return x.withColumn("normalised", F.when(F.col("_hi") > F.col("_lo"), (F.log1p(F.col(col)) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).when(F.col(col).isNotNull(), 0.5)).drop("_lo", "_hi")


def pile_summary(members: DataFrame, group: str, matching: Column | None = None) -> DataFrame:
    """kept, deleted, undecided active members, best and worst score, how many match of how many."""
    act = F.col("trash_state").isNull()
    return members.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(act & (F.col("decision") == "keep")).alias("kept"), F.count_if(act & (F.col("decision") == "del")).alias("deleted"),
        F.count_if(act & F.col("decision").isNull()).alias("undecided"), F.max("combined").alias("best"), F.min("combined").alias("worst"),
        F.count_if(matching if matching is not None else F.lit(True)).alias("matching"), F.count(F.lit(1)).alias("total"),
    )


def group_kind(members: DataFrame, group: str = "dup_group") -> DataFrame:
    """exact (one hash), close (all safe to cull) or alternates, of active members."""
    x = members.filter(F.col(group).isNotNull() & F.col("trash_state").isNull())
    one = (F.count_distinct("content_hash") == 1) & (F.count("content_hash") == F.count(F.lit(1)))
    safe = F.bool_and(F.coalesce("dup_cull_safe", F.lit(False)))
    return x.groupBy(group).agg(F.when(one, "exact").when(safe, "close").otherwise("alternates").alias("kind"))


def with_keeper(df: DataFrame) -> DataFrame:
    return df.withColumn("keeper", keeper_score(F.col("combined"), F.col("portrait")))
