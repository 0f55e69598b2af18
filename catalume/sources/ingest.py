"""Sources, sinks and incremental ingest of item tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.functions.text import basename

# fixed values
RAW_SUFFIXES = (".nef", ".raf", ".cr2", ".cr3", ".arw", ".dng", ".orf", ".rw2")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif", *RAW_SUFFIXES)
HIDDEN_DIRS = ("_trash", "_rejected")

FACE = "struct<bbox:array<double>,prob:double,cluster_id:bigint,name:string,sharp:double,expr:double>"
REPORT = f"""folder string, backend string, total_images bigint, duplicate_groups bigint, scene_groups bigint,
    images array<struct<path:string,filename:string,combined:double,sharpness:double,para_aesthetic:double,clip_iqa:double,
    dup_group:bigint,scene_group:bigint,dup_central:double,dup_cull_safe:boolean,capture_time:double,phash:string,content_hash:string,
    mtime:double,fsize:bigint,imgw:bigint,imgh:bigint,caption:string,tags:array<string>,faces:array<{FACE}>>>"""


def in_library(files: DataFrame, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recurse: bool = True) -> DataFrame:
    """Files (path) below the root with the suffixes, whatever the case, not below a hidden folder of it; without ``recurse`` only its own.

    The root is the start of a path, whatever comes again further down. A scheme (``file:``) may stand before either.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"
    path, top = F.regexp_replace("path", scheme, ""), re.sub(scheme, "", root).rstrip("/") + "/"
    below = F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30))
    folders = F.split(F.lower(below), "/")
    hidden = F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(d) for d in HIDDEN_DIRS]))
    name = F.lower(basename(F.col("path")))
    # a name that only starts with a dot has no suffix
    suffix = F.when(F.locate(".", F.substring(name, 2, 1 << 20)) > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    ok = below.isNotNull() & F.coalesce(suffix.isin(list(suffixes)), F.lit(False)) & ~hidden
    return files.filter(ok if recurse else ok & (F.size(folders) == 1))


def discover(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recurse: bool = False) -> DataFrame:
    """root_ord, path, mtime, fsize of the files of each root, as :func:`in_library` picks them."""
    out = None
    for k, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(root)
        f = files.select(F.lit(k).alias("root_ord"), "path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("fsize"))
        f = in_library(f, root, suffixes)
        out = f if out is None else out.unionByName(f)
    return out


def union_roots(dfs: list[DataFrame]) -> DataFrame:
    """All rows, of equal paths that of the first table."""
    out = None
    for k, d in enumerate(dfs):
        x = d.withColumn("root_ord", F.lit(k))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("root_ord")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _star(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, faces, image_tags of items with nested faces and tags."""
    faces = rows.select(F.col("id").alias("image_id"), F.posexplode("faces").alias("k", "f"))
    box = [F.get("f.bbox", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    faces = faces.select((F.col("image_id") * 100000 + F.col("k")).alias("id"), "image_id", *box, "f.prob", "f.cluster_id", "f.name", "f.sharp", "f.expr")
    return rows.drop("faces", "tags"), faces, rows.select(F.col("id").alias("image_id"), F.explode("tags").alias("tag"))


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """header, images, faces, image_tags of a report document; ids count from 1 in the order of the document."""
    doc = spark.read.schema(REPORT).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("images").alias("pos", "i")).select((F.col("pos") + 1).cast("long").alias("id"), "i.*")
    return doc.drop("images"), *_star(rows)


def nested_report(images: DataFrame, faces: DataFrame, tags: DataFrame) -> DataFrame:
    """Items with their faces (in order of id) and tags (in order) nested, as a report has them."""
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox")
    optional = [F.col(c) if c in faces.columns else F.lit(None).cast("string").alias(c) for c in ("name",)]
    face = F.struct(box, "prob", F.col("cluster_id").cast("long").alias("cluster_id"), *optional, "sharp", "expr")
    f = faces.select(F.col("image_id").alias("_f"), F.struct(F.col("id"), face.alias("face")).alias("_x")).groupBy("_f").agg(F.sort_array(F.collect_list("_x")).alias("_faces"))
    t = tags.groupBy(F.col("image_id").alias("_t")).agg(F.sort_array(F.collect_list("tag")).alias("_tags"))
    x = images.join(f, images["id"] == f["_f"], "left").join(t, images["id"] == t["_t"], "left")
    empty = F.array().cast("array<string>")
    faces_of = F.coalesce(F.transform("_faces", lambda v: v["face"]), F.array().cast(f"array<{FACE}>"))
    return x.select(*images.columns, faces_of.alias("faces"), F.coalesce("_tags", empty).alias("tags"))


def report_totals(images: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: items, groups and scenes of a report, items with a face, and people (without nobody's faces)."""
    n = images.agg(F.count(F.lit(1)).alias("total_images"), F.count_distinct("dup_group").alias("duplicate_groups"), F.count_distinct("scene_group").alias("scene_groups"))
    known = faces.join(images.select(F.col("id").alias("_i")), F.col("image_id") == F.col("_i"), "left_semi")
    f = known.agg(F.count_distinct("image_id").alias("faces_images"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("face_clusters"))
    return n.crossJoin(f)  # one row each


def write_report(images: DataFrame, faces: DataFrame, tags: DataFrame, header: dict, path: str) -> None:
    """Nested items worst first as JSON lines under images, and one row of header and totals beside them.

    A report of any size is a folder of files, not one document; :func:`read_report_folder` reads it.
    """
    nested_report(images, faces, tags).orderBy("combined", "path").write.mode("overwrite").json(f"{path}/images")
    head = report_totals(images, faces).select(*[F.lit(v).alias(k) for k, v in header.items()], "*")
    head.write.mode("overwrite").json(f"{path}/header")


def read_report_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """header, images, faces, image_tags of a written report; items keep the ids they were written with."""
    fields = T.StructType([T.StructField("id", T.LongType()), *T._parse_datatype_string(REPORT)["images"].dataType.elementType.fields])
    rows = spark.read.schema(fields).json(f"{path}/images")
    return spark.read.json(f"{path}/header"), *_star(rows)


def with_content_hash(df: DataFrame, content: str, path: str, out: str = "content_hash") -> DataFrame:
    """SHA-256 of the content, of the path where there is none."""
    return df.withColumn(out, F.sha2(F.coalesce(F.col(content).cast("binary"), F.col(path).cast("binary")), 256))


def _has_all(required: list[str], prefix: str = "_o_"):
    out = F.lit(True)
    for c in required:
        out = out & F.col(f"{prefix}{c}").isNotNull()
    return out


def incremental_split(cur: DataFrame, prev: DataFrame, required: list[str], tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Rows whose results can be used again (with them), and the rest: same path and size, same time, nothing missing."""
    p = prev.select(F.col("path").alias("_p"), F.col("fsize").alias("_s"), F.col("mtime").alias("_m"), *[F.col(c).alias(f"_o_{c}") for c in required])
    x = cur.join(p, cur["path"] == p["_p"], "left")
    same = F.coalesce((F.col("fsize") == F.col("_s")) & (F.abs(F.col("mtime") - F.col("_m")) <= tol) & _has_all(required), F.lit(False))
    own = [c for c in cur.columns if c not in required]
    return x.filter(same).select(*own, *[F.col(f"_o_{c}").alias(c) for c in required]), x.filter(~same).select(*cur.columns)


def recover_moved(todo: DataFrame, prev: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the rest, rows whose content is known under another path, and what is then left."""
    w = Window.partitionBy("content_hash").orderBy("path")
    p = prev.filter("content_hash is not null").filter(_has_all(required, "")).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    p = p.select(F.col("content_hash").alias("_h"), *[F.col(c).alias(f"_o_{c}") for c in required])
    x = todo.join(p, todo["content_hash"] == p["_h"], "left")
    own = [c for c in todo.columns if c not in required]
    return x.filter("_h is not null").select(*own, *[F.col(f"_o_{c}").alias(c) for c in required]), x.filter("_h is null").select(*todo.columns)


def reuse_hash(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Adds known_hash of the row with the same path, time and size."""
    p = prev.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"), F.col("fsize").alias("_s"), F.col("content_hash").alias("known_hash"))
    return cur.join(p, (cur["path"] == p["_p"]) & cur["mtime"].eqNullSafe(p["_m"]) & cur["fsize"].eqNullSafe(p["_s"]), "left").drop("_p", "_m", "_s")


def resolve_paths(images: DataFrame, existing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Missing paths are led to where the ledger last put them, if it is the same content; else they are left out.

    The newest row of the original path must be trashed, emptied or missing, and must be the
    newest one of its place in the trash.
    """
    e = existing.select(F.col("path").alias("_e")).distinct()
    row = F.struct("id", "trash_path", "state", "hash")
    newest = ledger.groupBy(F.col("from_path").alias("_f")).agg(F.max_by(row, "id").alias("_r"))
    holder = ledger.groupBy(F.col("trash_path").alias("_t")).agg(F.max("id").alias("_top"))
    # the ledger's rows meet first: items without one would all have the same key, none
    newest = newest.filter(F.col("_r.state").isin("trashed", "emptied", "missing")).join(holder, (F.col("_r.trash_path") == F.col("_t")) & (F.col("_top") == F.col("_r.id"))).select("_f", "_r")
    x = images.filter("path is not null").join(e, F.col("path") == F.col("_e"), "left").join(newest, F.col("path") == F.col("_f"), "left")
    ok = F.col("_r.id").isNotNull() & (F.col("content_hash").isNull() | (F.col("content_hash") == F.col("_r.hash")))
    path = F.when(F.col("_e").isNotNull(), F.col("path")).when(F.coalesce(ok, F.lit(False)), F.col("_r.trash_path"))
    known = F.when(F.col("_e").isNull(), F.col("_r.hash"))
    return x.withColumn("known_hash", known).withColumn("path", path).filter("path is not null").select(*images.columns, "known_hash")


def orphans(artefacts: DataFrame, images: DataFrame, name: str) -> DataFrame:
    return artefacts.join(images.select(F.col(name).alias("_n")), artefacts[name] == F.col("_n"), "left_anti")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, absent ones null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
