"""Ingest, scalar functions, filters, joins, facets and pages over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.functions import scores as S
from catalume.functions import text as X
from catalume.operators import decisions as D
from catalume.operators import facets as A
from catalume.operators import filters as C
from catalume.operators import nearest as N
from catalume.operators import pages as P
from catalume.operators import sequence as Q
from catalume.operators import similarity as M
from catalume.plans.registry import Tables, query
from catalume.sources import ingest as I

KEEPER = "coalesce(round(combined + 0.05 * (portrait - 0.5), 6), combined)"


@query("""with f as (select id, case id % 4 when 0 then '/lib/_Trash' when 1 then folder || '/_rejected/x' else folder end || '/' || id || case id % 5 when 0 then '.JPG' when 1 then '.cr3' when 2 then '.txt' when 3 then '.bmp' else '' end as path from photos)
    select id, path from f where id % 4 > 1 and id % 5 in (0, 1, 3)""")
def o1_discover(t: Tables) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".JPG", ".cr3", ".txt", ".bmp", "")])
    dirs = F.when(F.col("id") % 4 == 0, "/lib/_Trash").when(F.col("id") % 4 == 1, F.concat("folder", F.lit("/_rejected/x"))).otherwise(F.col("folder"))
    files = t.photos.select("id", F.concat(dirs, F.lit("/"), F.col("id").cast("string"), F.get(ends, (F.col("id") % 5).cast("int"))).alias("path"))
    return I.in_library(files, "/lib")


@query("""with f as (select id, case id % 5 when 0 then '/lib/_trash/lib' when 1 then folder || '/lib' when 2 then '/lib' when 3 then '/other/lib' else '/lib/x/lib/_rejected/y' end || '/' || filename as path from photos)
    select id, path, id % 5 = 2 as own from f where id % 5 in (1, 2)""")
def o1_nested_root(t: Tables) -> DataFrame:
    """The name of the root comes again further down, and outside of it."""
    path = F.expr("concat(case id % 5 when 0 then '/lib/_trash/lib' when 1 then concat(folder, '/lib') when 2 then '/lib' when 3 then '/other/lib' else '/lib/x/lib/_rejected/y' end, '/', filename)")
    files = t.photos.select("id", path.alias("path"))
    own = I.in_library(files, "/lib/", recurse=False).select(F.col("id").alias("_i"))
    x = I.in_library(files, "/lib")
    return x.join(own, x["id"] == own["_i"], "left").select("id", "path", F.col("_i").isNotNull().alias("own"))


@query("""select f.image_id, f.x1, f.y2, f.prob, f.cluster_id, f.sharp from faces f join photos p on p.id = f.image_id""")
def o3_report_star(t: Tables) -> DataFrame:
    return I._star(I.nested_report(t.photos, t.faces, t.tags))[1].select("image_id", "x1", "y2", "prob", "cluster_id", "sharp")


@query("""select count(*) as total_images, count(distinct dup_group) as duplicate_groups, count(distinct scene_group) as scene_groups,
    (select count(distinct image_id) from faces where image_id in (select id from photos)) as faces_images, (select count(distinct cluster_id) from faces where cluster_id >= 0 and image_id in (select id from photos)) as face_clusters from photos""")
def o13_report_totals(t: Tables) -> DataFrame:
    return I.report_totals(t.photos, t.faces)


@query("""with g as (select image_id, count(*) as n_faces, max(cluster_id) as top from faces group by 1), k as (select image_id, string_agg(tag, ',' order by tag) as tags from tags group by 1)
    select id, path, combined, coalesce(g.n_faces, 0)::int as n, g.top, coalesce(k.tags, '') as tags from photos p left join g on g.image_id = p.id left join k on k.image_id = p.id""")
def o13_report_rows(t: Tables) -> DataFrame:
    x = I.nested_report(t.photos, t.faces, t.tags)
    return x.select("id", "path", "combined", F.size("faces").alias("n"), F.array_max(F.transform("faces", lambda f: f["cluster_id"])).alias("top"), F.array_join("tags", ",").alias("tags"))


@query("""select id, path, combined, decision, trash_state from seen where combined between 0.3 and 0.9 and decision is null and trash_state is null
    order by combined desc nulls last, id limit 300 offset 20""")
def flagship_page(t: Tables) -> DataFrame:
    """A page of active, undecided photos by score."""
    spec = {"combined": (0.3, 0.9), "decision": {"none"}}
    return P.page(C.image_filter(t.seen, spec), offset=20, limit=300)[0].select("id", "path", "combined", "decision", "trash_state")


@query("select path, min(k) as root_ord, arg_min(id, k) as id from (select path, 0 as k, id from photos where id % 2 = 0 union all select path, 1 as k, -id from photos where id % 3 = 0 union all select path, 2, id + 1000000 from photos) group by path")
def o2_union_roots(t: Tables) -> DataFrame:
    p = t.photos.select("path", "id")
    return I.union_roots([p.filter("id % 2 = 0"), p.filter("id % 3 = 0").withColumn("id", -F.col("id")), p.withColumn("id", F.col("id") + 1000000)]).select("path", "root_ord", "id")


@query("select doc_id, sha256(coalesce(text, cast(doc_id as string))) as content_hash from documents")
def o4_content_identity(t: Tables) -> DataFrame:
    d = t.documents.withColumn("p", F.col("doc_id").cast("string"))
    return I.with_content_hash(d, "text", "p").select("doc_id", "content_hash")


def _cur_prev(t: Tables) -> tuple[DataFrame, DataFrame]:
    cur = t.photos.select("id", F.when(F.col("id") % 13 == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"), "content_hash", "fsize", (F.col("mtime") + F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0)).alias("mtime"))
    prev = t.photos.select("path", "content_hash", "fsize", "mtime", "para_aesthetic", "clip_iqa")
    return cur, prev


@query("""select p.id, case when p.id % 5 <> 0 and p.id % 13 <> 0 and p.para_aesthetic is not null then 1 else 0 end as cached,
    case when p.id % 5 <> 0 and p.id % 13 <> 0 then p.para_aesthetic end as para_aesthetic from photos p""")
def o5_incremental_split(t: Tables) -> DataFrame:
    cached, todo = I.incremental_split(*_cur_prev(t), ["para_aesthetic", "clip_iqa"])
    return cached.select("id", F.lit(1).alias("cached"), "para_aesthetic").union(todo.select("id", F.lit(0), F.lit(None).cast("double")))


@query("""with k as (select content_hash as h, arg_min(clip_iqa, path) as clip_iqa from photos where content_hash is not null and para_aesthetic is not null group by 1)
    select id, k.clip_iqa, case when k.h is null then 0 else 1 end as recovered from photos p left join k on p.content_hash = k.h
    where not (id % 5 <> 0 and id % 13 <> 0 and para_aesthetic is not null)""")
def o6_recover_moved(t: Tables) -> DataFrame:
    cur, prev = _cur_prev(t)
    need = ["para_aesthetic", "clip_iqa"]
    got, left = I.recover_moved(I.incremental_split(cur, prev, need)[1], prev, need)
    return got.select("id", "clip_iqa", F.lit(1).alias("recovered")).union(left.select("id", F.lit(None).cast("double"), F.lit(0)))


@query("select id, case when id % 5 <> 0 and id % 13 <> 0 then content_hash end as known_hash from photos")
def o8_reuse_hash(t: Tables) -> DataFrame:
    cur, prev = _cur_prev(t)
    return I.reuse_hash(cur, prev).select("id", "known_hash")


@query("""with here as (select path from photos where id % 4 = 0),
    n as (select from_path as f, max(id) as id, arg_max(trash_path, id) as tp, arg_max(state, id) as st, arg_max(hash, id) as h from ledger group by 1),
    g as (select trash_path as tp, max(id) as top from ledger group by 1),
    im as (select id, case when id % 4 = 0 then path else '/orig' || path end as path, content_hash from photos)
    select im.id, case when here.path is not null then im.path else n.tp end as path, case when here.path is null then n.h end as known_hash
    from im left join here on im.path = here.path left join n on n.f = im.path left join g on g.tp = n.tp
    where here.path is not null or (n.st in ('trashed', 'emptied', 'missing') and (im.content_hash is null or im.content_hash = n.h) and g.top = n.id)""")
def o9_resolve_paths(t: Tables) -> DataFrame:
    p = t.photos
    images = p.select("id", F.when(F.col("id") % 4 == 0, F.col("path")).otherwise(F.concat(F.lit("/orig"), "path")).alias("path"), "content_hash")
    return I.resolve_paths(images, p.filter("id % 4 = 0").select("path"), t.ledger).select("id", "path", "known_hash")


@query("""with ch as (select content_hash as hash, case when arg_max(id, id) % 2 = 0 then 'keep' else 'del' end as decision from photos where id % 9 = 0 and content_hash is not null group by 1)
    select hash, decision from ch union all select hash, decision from decisions where hash not in (select hash from ch) and substr(hash, 1, 1) <> '2'
    union all select hash, 'new' from hashes where substr(hash, 1, 1) = 'f' and hash not in (select hash from ch)""")
def o10_upsert(t: Tables) -> DataFrame:
    ch = t.photos.filter("id % 9 = 0 and content_hash is not null").select(F.col("content_hash").alias("hash"), F.when(F.col("id") % 2 == 0, "keep").otherwise("del").alias("decision"), "id")
    x = D.delete_keys(t.decisions, t.hashes.filter("substr(hash, 1, 1) = '2'"), ["hash"])
    x = D.upsert(x, ch, ["hash"], "id")
    return D.insert_new(x, t.hashes.filter("substr(hash, 1, 1) = 'f'").withColumn("decision", F.lit("new")), ["hash"])


@query("select id as key, label from vectors where id in (select id from photos where id % 3 = 0)")
def o11_lookup_vectors(t: Tables) -> DataFrame:
    store = t.vectors.select(F.col("id").alias("key"), "label", "embedding")
    return M.lookup_vectors(store, t.photos.filter("id % 3 = 0").select(F.col("id").alias("key"))).select("key", "label")


@query("select id from photos where content_hash is not null and substr(content_hash, 1, 1) in ('a', 'b')")
def o12_missing_vectors(t: Tables) -> DataFrame:
    store = t.hashes.filter("substr(hash, 1, 1) not in ('a', 'b')").select(F.col("hash").alias("key"))
    return M.missing_vectors(t.photos, store).select("id")


@query("select filename from photos where id % 6 = 1")
def o14_orphans(t: Tables) -> DataFrame:
    return I.orphans(t.photos.select("filename"), t.photos.filter("id % 6 <> 1"), "filename")


@query("""select case when decision = 'keep' then 'kept' when decision = 'del' then 'deleted' else 'unmarked' end as bucket, content_hash as hash, path, filename, combined, has_override as copy_specific from seen""")
def o15_export_decisions(t: Tables) -> DataFrame:
    x = t.joined
    x = x.withColumn("decision", F.when(F.col("has_override"), F.col("override")).otherwise(F.col("mark")))
    return D.export_decisions(x)


def _entries(t: Tables) -> DataFrame:
    p = t.photos
    return p.select(F.expr("case id % 3 when 0 then 'kept' when 1 then 'deleted' else 'unmarked' end").alias("bucket"), F.expr("case when id % 4 <> 0 then md5(cast(id as string)) end").alias("hash"), "path", (F.col("id") % 5 == 0).alias("copy_specific"))


@query("""with e as (select case id % 3 when 0 then 'keep' when 1 then 'del' end as decision, case when id % 4 <> 0 then md5(cast(id as string)) else content_hash end as h, content_hash, id % 5 = 0 as special from photos),
    f as (select *, case when special then h = content_hash and h is not null else h is not null and decision is not null end as ok from e)
    select count(*) filter (where coalesce(ok, false)) as applied, count(*) filter (where not coalesce(ok, false)) as unmatched from f where special or decision is not null""")
def o16_import_decisions(t: Tables) -> DataFrame:
    return D.import_decisions(_entries(t), t.photos, t.decisions, t.copies)[2]


@query("select content_hash as hash, max(case when id % 2 = 0 then 'keep' else 'del' end) as decision from photos where content_hash is not null and id % 7 = 0 group by 1")
def o17_migrate_path_decisions(t: Tables) -> DataFrame:
    old = t.photos.filter("id % 7 = 0").select("path", F.when(F.col("id") % 2 == 0, "keep").otherwise("del").alias("decision"))
    return D.migrate_path_decisions(old, t.photos)


@query("select id, combined, cast(null as string) as caption2, cast(null as double) as extra from photos")
def o18_align(t: Tables) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("combined", T.DoubleType()), T.StructField("caption2", T.StringType()), T.StructField("extra", T.DoubleType())])
    return I.align(t.photos, schema)


@query("select id, round(least(1.0, greatest(0.0, (ln(1 + raw_laplacian) - ln(41.0)) / (ln(15001.0) - ln(41.0)))), 6) as sharp from photos")
def o19_calibrated_sharpness(t: Tables) -> DataFrame:
    return t.photos.select("id", F.round(S.calibrated_sharpness(F.col("raw_laplacian")), 6).alias("sharp"))


@query("select id, round(0.4 * sharpness + 0.6 * coalesce(para_aesthetic, 0.5), 4) as combined_para, round(0.4 * sharpness + 0.6 * coalesce(clip_iqa, 0.5), 4) as combined_clip from photos")
def o20_combined_score(t: Tables) -> DataFrame:
    return t.photos.select("id", S.combined_score(F.col("sharpness"), F.col("para_aesthetic")).alias("combined_para"), S.combined_score(F.col("sharpness"), F.col("clip_iqa")).alias("combined_clip"))


@query("select id, coalesce(para_aesthetic, 2.5) / 5 as para_aesthetic, coalesce(clip_iqa, 2.5) / 5 as clip_iqa from photos")
def o21_rescale_heads(t: Tables) -> DataFrame:
    return t.photos.select("id", *S.rescale_heads(["para_aesthetic", "clip_iqa"]))


@query(f"select id, {KEEPER} as keeper from photos")
def o22_keeper_score(t: Tables) -> DataFrame:
    return A.with_keeper(t.photos).select("id", "keeper")


@query("select id, case when sharp is null then null when expr is null then round(sharp, 4) else round(0.6 * sharp + 0.4 * expr, 4) end as portrait from faces")
def o23_portrait_score(t: Tables) -> DataFrame:
    return t.faces.select("id", S.portrait_score(F.col("sharp"), F.col("expr")).alias("portrait"))


@query("select id, round(0.55 * coalesce(sharp, 0.5) + 0.25 * least(1.0, (x2 - x1) / 3700 / 0.10) + 0.20 * coalesce(expr, 0.5), 4) as quality from faces")
def o24_face_quality(t: Tables) -> DataFrame:
    return t.faces.select("id", S.face_quality(F.col("sharp"), F.col("expr"), (F.col("x2") - F.col("x1")) / 3700).alias("quality"))


@query("select id, coalesce(para_aesthetic, clip_iqa) as aesthetic from photos")
def o25_aesthetic(t: Tables) -> DataFrame:
    return t.photos.select("id", S.aesthetic(F.col("para_aesthetic"), F.col("clip_iqa")).alias("aesthetic"))


@query("""select a.id as i, b.id as j, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 5) as dot,
    round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cos from vectors a join vectors b on b.id = a.id + 1""")
def o26_vector_functions(t: Tables) -> DataFrame:
    a, b = t.vectors.select(F.col("id").alias("i"), F.col("embedding").alias("v")), t.vectors.select(F.col("id").alias("j"), F.col("embedding").alias("u"))
    x = a.join(b, F.col("j") == F.col("i") + 1)
    return x.select("i", "j", F.round(S.dot(F.col("v"), F.col("u")), 5).alias("dot"), F.round(S.dot(S.l2_normalize(F.col("v")), S.l2_normalize(F.col("u"))), 5).alias("cos"))


@query("""select a.id as i, b.id as j, bit_count(xor(('0x' || substr(a.phash, 1, 8))::bigint, ('0x' || substr(b.phash, 1, 8))::bigint)) + (bit_count(xor(('0x' || substr(a.phash, 9, 8))::bigint, ('0x' || substr(b.phash, 9, 8))::bigint)))::int as d
    from photos a join photos b on b.id = a.id + 1""")
def o27_hamming(t: Tables) -> DataFrame:
    p = t.photos.select("id", "phash")
    x = p.join(p.select((F.col("id") - 1).alias("k"), F.col("id").alias("j"), F.col("phash").alias("h")), F.col("id") == F.col("k"))
    return x.select(F.col("id").alias("i"), "j", S.hamming64(F.col("phash"), F.col("h")).alias("d"))


@query("""select id, round((1 / (1 + exp(embedding[2]::double - embedding[1]::double)) + 1 / (1 + exp(embedding[4]::double - embedding[3]::double))) / 2, 6) as score from vectors""")
def o28_bipolar_score(t: Tables) -> DataFrame:
    one = lambda k: [1.0 if i == k else 0.0 for i in range(64)]
    return t.vectors.select("id", F.round(S.bipolar_score(F.col("embedding"), [(one(0), one(1)), (one(2), one(3))]), 6).alias("score"))


@query("select id, x1 || ',' || y1 || ',' || x2 || ',' || y2 as bbox, x1 as px, y2 as py from faces")
def o29_bbox_key(t: Tables) -> DataFrame:
    x = t.faces.withColumn("bbox", X.bbox_key(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    p = X.parse_bbox(F.col("bbox"))
    return x.select("id", "bbox", p["x1"].alias("px"), p["y2"].alias("py"))


IOU_SQL = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
IOU_SQL = f"({IOU_SQL}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU_SQL})"


@query(f"select a.id as i, b.id as j, round({IOU_SQL}, 6) as iou from faces a join faces b on a.image_id = b.image_id and a.id < b.id")
def o30_iou(t: Tables) -> DataFrame:
    a = t.faces
    b = t.faces.select(F.col("image_id").alias("k"), F.col("id").alias("j"), *[F.col(c).alias(f"o_{c}") for c in M.BOX])
    x = a.join(b, (F.col("image_id") == F.col("k")) & (F.col("id") < F.col("j")))
    return x.select(F.col("id").alias("i"), "j", F.round(S.iou(M._box(), M._box("o_")), 6).alias("iou"))


@query("select id, decision from seen")
def o31_effective_decision(t: Tables) -> DataFrame:
    return C.effective_decision(t.photos, t.decisions, t.copies).select("id", "decision")


@query(r"""with p as (select id, k, x from (select id, unnest(string_split_regex(caption, '[,\n;]')) as x, generate_subscripts(string_split_regex(caption, '[,\n;]'), 1) as k from photos)),
    c as (select id, k, lower(trim(regexp_replace(trim(x), '^(?:[-•]\s*|\d+[.)]\s+)', ''), '. ')) as tag from p),
    d as (select id, tag, min(k) as k from c where tag <> '' and length(tag) <= 40 and len(string_split_regex(tag, '\s+')) <= 4 group by 1, 2)
    select id, string_agg(tag, '|' order by k) as tags from d group by id""")
def o32_clean_tags(t: Tables) -> DataFrame:
    return t.photos.select("id", F.array_join(X.clean_tags(F.col("caption")), "|").alias("tags")).filter("tags <> ''")


@query("""select id, case when id % 3 = 0 then epoch(strptime(strftime(make_timestamp(cast(floor(mtime) as bigint) * 1000000), '%Y:%m:%d %H:%M:%S'), '%Y:%m:%d %H:%M:%S')) when id % 3 = 1 then mtime else 0.0 end as t from photos""")
def o34_capture_time(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    stamp = F.date_format(F.timestamp_seconds(F.floor("mtime")), "yyyy:MM:dd HH:mm:ss")
    exif = F.when(F.col("id") % 3 == 0, stamp).otherwise(F.lit("not a date"))
    return t.photos.select("id", X.capture_time([F.lit(None).cast("string"), exif], F.when(F.col("id") % 3 == 1, F.col("mtime"))).alias("t"))


@query(r"select id, folder as dir, filename as base, cast(id as string) as stem, '.jpg' as suffix from photos")
def o35_paths(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.photos.select("id", X.dirname(p).alias("dir"), X.basename(p).alias("base"), X.stem(p).alias("stem"), X.suffix(p).alias("suffix"))


@query("""select f.id, case when o in (5, 6, 7, 8) then h else w end as uw,
    case o when 2 then w - x2 when 3 then w - x2 when 5 then y1 when 6 then h - y2 when 7 then h - y2 when 8 then y1 else x1 end as ux1,
    case o when 3 then h - y2 when 4 then h - y2 when 5 then x1 when 6 then x1 when 7 then w - x2 when 8 then w - x2 else y1 end as uy1,
    case o when 2 then w - x1 when 3 then w - x1 when 5 then y2 when 6 then h - y1 when 7 then h - y1 when 8 then y2 else x2 end as ux2
    from faces f join (select id, orientation as o, imgw as w, imgh as h from photos) p on f.image_id = p.id""")
def o36_upright(t: Tables) -> DataFrame:
    x = t.faces.join(t.photos.select(F.col("id").alias("k"), "orientation", "imgw", "imgh"), F.col("image_id") == F.col("k"))
    b = X.upright_box(M._box(), F.col("imgw"), F.col("imgh"), F.col("orientation"))
    return x.select("id", X.upright_size(F.col("imgw"), F.col("imgh"), F.col("orientation"))["w"].alias("uw"), b["x1"].alias("ux1"), b["y1"].alias("uy1"), b["x2"].alias("ux2"))


@query("select id, ((x2 - x1) / 4000 >= 0.04) or (prob >= 0.98 and (x2 - x1) / 4000 >= 0.015) as ok from faces")
def o38_accept_direct(t: Tables) -> DataFrame:
    return t.faces.select("id", S.accept_direct(F.col("prob"), (F.col("x2") - F.col("x1")) / 4000).alias("ok"))


@query(r"""select id from photos where regexp_matches(' ' || regexp_replace(lower(caption), '[^a-z0-9]+', ' ', 'g') || ' ', ' photo of ') and regexp_matches(' ' || regexp_replace(lower(caption), '[^a-z0-9]+', ' ', 'g') || ' ', ' user 7 ')""")
def o41_text_search(t: Tables) -> DataFrame:
    return C.text_search(t.photos, "caption", "Photo-OF user_7").select("id")


@query("select id from photos where para_aesthetic between 0.2 and 0.5 and sharpness between 0.1 and 0.9")
def o42_score_range(t: Tables) -> DataFrame:
    return C.score_range(C.score_range(C.score_range(t.photos, "combined"), "para_aesthetic", 0.2, 0.5), "sharpness", 0.1, 0.9).select("id")


@query("select id from photos where folder = '/lib/u3/click' union all select id + 1000000000 from photos where starts_with(path, '/lib/u3/')")
def o43_in_folder(t: Tables) -> DataFrame:
    direct = C.in_folder(t.photos, "/lib/u3/click", False).select("id")
    return direct.union(C.in_folder(t.photos, "/lib/u3").select(F.col("id") + 1000000000))


@query("select id from photos where event_type = 'click' and id % 2 = 0 and id % 12 = 4")
def o44_all_tags(t: Tables) -> DataFrame:
    return C.with_all_tags(t.photos, t.tags, ["click", "t4"]).select("id")


@query("select distinct p.id from photos p join faces f on p.id = f.image_id where f.cluster_id in (3, 5, -1)")
def o45_any_person(t: Tables) -> DataFrame:
    return C.with_any_person(t.photos, t.faces, [3, 5, -1]).select("id")


@query("select id from seen where decision = 'keep' or decision is null")
def o46_decision_in(t: Tables) -> DataFrame:
    return C.decision_in(t.seen, C.verdicts("Keep, unmarked, other")).select("id")


@query("select id, 'a' as k from seen where trash_state is null union all select id, 'b' from seen where trash_state is null or trash_state = 'trashed'")
def o47_lifecycle_in(t: Tables) -> DataFrame:
    a, b = C.lifecycle_in(t.seen, set()), C.lifecycle_in(t.seen, {"active", "trashed"})
    return a.select("id", F.lit("a").alias("k")).union(b.select("id", F.lit("b")))


@query("select id, dup_group is not null as grouped from photos")
def o48_dup_mode(t: Tables) -> DataFrame:
    a, b = C.dup_mode(t.photos, "groups-only"), C.dup_mode(t.photos, "no-groups")
    return a.select("id", F.lit(True).alias("grouped")).union(b.select("id", F.lit(False)))


@query("""select id from seen where trash_state is null and (dup_group is null or id in (select id from (select id, row_number() over (partition by dup_group order by combined desc nulls last, id) as r from photos where dup_group is not null) where r = 1))""")
def o49_hide_duplicates(t: Tables) -> DataFrame:
    return C.hide_duplicates(C.lifecycle_in(t.seen, set()), t.photos).select("id")


@query("select id from photos where combined < 0.25")
def o51_junk(t: Tables) -> DataFrame:
    return C.junk(t.photos).select("id")


@query("select id, trash_state, original_path, trashed_at from seen")
def o52_trash_state(t: Tables) -> DataFrame:
    return C.with_trash_state(t.photos, t.ledger).select("id", "trash_state", "original_path", "trashed_at")


@query("select p.id, d.decision as mark, c.decision as override from photos p left join decisions d on d.hash = p.content_hash left join copies c on c.hash = p.content_hash and c.path = p.path")
def o53_join_decisions(t: Tables) -> DataFrame:
    return t.joined.select("id", "mark", "override")


@query("select content_hash, n, id, path from (select *, count(*) over (partition by content_hash) as n from photos where content_hash is not null) where n > 1")
def o61_exact_copies(t: Tables) -> DataFrame:
    return P.exact_copies(t.photos)


@query("select f.id, s.path, s.decision, s.capture_time from faces f join seen s on f.image_id = s.id where s.trash_state is null")
def o62_face_star(t: Tables) -> DataFrame:
    return P.face_star(t.faces, t.seen).select("id", "path", "decision", "capture_time")


@query("""select f.id, v.label from faces f join photos p on f.image_id = p.id join vectors v on v.id = f.id % 500 where p.content_hash is not null""")
def o63_face_vectors(t: Tables) -> DataFrame:
    box = X.bbox_key(*M._box())
    f = t.faces.join(t.photos.filter("content_hash is not null").select(F.col("id").alias("pid"), "content_hash"), F.col("image_id") == F.col("pid")).withColumn("bbox", box)
    store = f.select(F.col("content_hash").alias("h"), F.col("bbox").alias("k"), F.col("pid").alias("p2"), (F.col("id") % 500).alias("v")).distinct()
    store = store.join(t.vectors.select(F.col("id").alias("v"), "label"), "v")
    return f.join(store, (F.col("content_hash") == F.col("h")) & (F.col("bbox") == F.col("k")) & (F.col("pid") == F.col("p2")) & (F.col("id") % 500 == F.col("v"))).select("id", "label")


@query("""select p.id, coalesce(n, 0) as n_faces, coalesce(tg, '') as tags from photos p left join (select image_id, count(*) as n from faces group by 1) f on f.image_id = p.id
    left join (select image_id, string_agg(tag, ',' order by tag) as tg from tags group by 1) t on t.image_id = p.id""")
def o64_attach_children(t: Tables) -> DataFrame:
    x = P.attach_children(t.photos.drop("n_faces"), t.faces, t.tags)
    return x.select("id", F.size("faces").cast("long").alias("n_faces"), F.array_join("tags", ",").alias("tags"))


@query("select b as bin, coalesce(n, 0) as n from (select unnest(range(24))::int as b) left join (select least(floor(combined * 24), 23)::int as k, count(*) as n from photos where combined is not null group by 1) on b = k")
def o67_histogram(t: Tables) -> DataFrame:
    return A.histogram(t.photos, "combined")


@query("select min(combined) as combined_min, max(combined) as combined_max, min(sharpness) as sharpness_min, max(sharpness) as sharpness_max, min(coalesce(para_aesthetic, clip_iqa)) as aesthetic_min, max(coalesce(para_aesthetic, clip_iqa)) as aesthetic_max from photos")
def o68_score_ranges(t: Tables) -> DataFrame:
    return A.score_ranges(t.photos)


@query("select count(*) as total, count(*) filter (where n_faces > 0) as with_faces, count(portrait) as with_portrait, count(distinct dup_group) as dup_groups, count(distinct scene_group) as scene_groups from photos")
def o69_counts(t: Tables) -> DataFrame:
    return A.library_counts(t.photos)


@query("select tag, count(*) as n from tags group by tag")
def o70_tag_facet(t: Tables) -> DataFrame:
    return A.tag_facet(t.tags)


@query("select c.cluster_id, c.name, count(*) as n from clusters c join faces f on c.cluster_id = f.cluster_id group by 1, 2")
def o71_person_facet(t: Tables) -> DataFrame:
    return A.person_facet(t.clusters, t.faces)


@query("select folder as path, count(*) as n from photos where folder <> '/lib/u1/click' group by 1")
def o72_folder_facet(t: Tables) -> DataFrame:
    return A.folder_facet(t.photos, "/lib/u1/click")


@query("""with parts as (select path, n, string_split(path, '/') as p from folders),
    e as (select array_to_string(p[1:k], '/') as place, path, n from (select *, unnest(range(2, len(p) + 1)) as k from parts)),
    tr as (select place as path, sum(case when place = path then n else 0 end) as direct, sum(n) as total from e group by 1),
    k as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as up, count(*) as c from tr group by 1)
    select tr.path, direct::bigint as direct, total::bigint as total, coalesce(c, 0) as children from tr left join k on k.up = tr.path where not (direct = 0 and coalesce(c, 0) = 1)""")
def o73_folder_totals(t: Tables) -> DataFrame:
    return A.folder_totals(t.folders)


@query("""select image_id, n as n_faces, sharp as face_sharp, expr as face_expr, case when sharp is null then null when expr is null then round(sharp, 4) else round(0.6 * sharp + 0.4 * expr, 4) end as portrait
    from (select *, count(*) over (partition by image_id) as n, row_number() over (partition by image_id order by (x2 - x1) * (y2 - y1) desc, id) as r from faces) where r = 1""")
def o74_largest_face(t: Tables) -> DataFrame:
    return A.largest_face(t.faces)


@query("""with b as (select *, count(*) over (partition by image_id) as n, row_number() over (partition by image_id order by (x2 - x1) * (y2 - y1) desc, id) as r from faces)
    select p.id, case when p.id % 3 = 0 then coalesce(b.n, 0) else p.n_faces end as n_faces, case when p.id % 3 = 0 then b.sharp else p.face_sharp end as face_sharp
    from photos p left join b on b.image_id = p.id and b.r = 1""")
def o75_reaggregate(t: Tables) -> DataFrame:
    return A.reaggregate(t.photos, t.faces, t.photos.filter("id % 3 = 0").select("id")).select("id", "n_faces", "face_sharp")


@query("""with d as (select label, i, avg(embedding[i]::double) as m, count(*) as n from vectors, range(1, 65) r(i) group by 1, 2)
    select label, max(n) as n, round(sum(m * m), 5) as norm2, round(sum(case when i = 1 then m end), 5) as first from d group by 1""")
def o76_centroids(t: Tables) -> DataFrame:
    c = A.centroids(t.vectors, "label", "embedding", normalize=False)
    return c.select("label", "n", F.round(S.dot(F.col("centroid"), F.col("centroid")), 5).alias("norm2"), F.round(F.col("centroid")[0], 5).alias("first"))


@query("""select a.id, round(avg(list_dot_product(a.embedding::double[], b.embedding::double[])), 4) as dup_central from vectors a join vectors b on a.label = b.label and a.id <> b.id group by 1""")
def o77_centrality(t: Tables) -> DataFrame:
    return A.group_centrality(t.vectors, "label", "id", "embedding")


PEOPLE = """people as (select case when f.cluster_id >= 0 then f.cluster_id else -1 end as cluster_id, count(*) as faces, count(distinct f.image_id) as photos,
    arg_max(f.id, {'q': round(0.55 * coalesce(sharp, 0.5) + 0.25 * least(1.0, (x2 - x1) / imgw / 0.10) + 0.20 * coalesce(expr, 0.5), 4), 'i': -f.id}) as cover_face_id
    from faces f join seen s on s.id = f.image_id where s.trash_state is null group by 1)"""


@query(f"""with {PEOPLE} select p.cluster_id, c.name, case when p.cluster_id < 0 then 'Unsorted faces' when c.name is null then 'Person ' || p.cluster_id else c.name end as label, faces, photos, cover_face_id, p.cluster_id >= 100000 as manual
    from people p left join clusters c on c.cluster_id = p.cluster_id""")
def o78_list_people(t: Tables) -> DataFrame:
    return A.list_people(t.faces, t.seen, t.clusters)


@query("""with d as (select label, i, avg(embedding[i]::double) as m from vectors, range(1, 65) r(i) group by 1, 2), c as (select label, list(m order by i) as v from d group by 1)
    select cluster_id, other, round(s, 4) as similarity from (select a.label as cluster_id, b.label as other, list_cosine_similarity(a.v, b.v) as s,
    row_number() over (partition by a.label order by list_cosine_similarity(a.v, b.v) desc, b.label) as r from c a join c b on a.label <> b.label) where s >= 0.05 and r <= 6""")
def o79_similar_people(t: Tables) -> DataFrame:
    kind = t.vectors.schema["label"].dataType
    x = N.similar_people(A.centroids(t.vectors, "label", "embedding").withColumnRenamed("label", "cluster_id"), floor=0.05)
    return x.select(F.col("cluster_id").cast(kind).alias("cluster_id"), F.col("other").cast(kind).alias("other"), F.round("cos", 4).alias("similarity"))


@query("""with d as (select label, i, avg(embedding[i]::double) as m from vectors, range(1, 65) r(i) group by 1, 2), c as (select label, list(m order by i) as v from d group by 1)
    select v.id, round(list_cosine_similarity(v.embedding::double[], c.v), 3) as match from vectors v join c on c.label = v.label""")
def o80_self_match(t: Tables) -> DataFrame:
    c = A.centroids(t.vectors, "label", "embedding")
    return t.vectors.join(c, "label").select("id", F.round(S.cosine(F.col("embedding"), F.col("centroid")), 3).alias("match"))


@query("""select scene_group, tag, n, r as rank from (select scene_group, tag, count(*) as n, row_number() over (partition by scene_group order by count(*) desc, tag) as r
    from photos p join tags t on p.id = t.image_id where scene_group is not null group by 1, 2) where r <= 6""")
def o82_top_tags(t: Tables) -> DataFrame:
    x = t.tags.join(t.photos.filter("scene_group is not null").select("id", "scene_group"), F.col("id") == F.col("image_id"))
    return A.top_tags(x, "scene_group").withColumn("rank", F.col("rank").cast("long"))


@query("""select dup_group, count(*) filter (where trash_state is null) as active, count(*) filter (where trash_state = 'trashed') as trashed, count(*) filter (where trash_state in ('emptied', 'missing')) as unavailable,
    count(*) filter (where trash_state is null) > 1 and count(*) filter (where trash_state is null and decision is null) > 0 as needs_review from seen where dup_group is not null group by 1""")
def o83_group_activity(t: Tables) -> DataFrame:
    return A.group_activity(t.seen, "dup_group")


@query("""select count(*) filter (where decision = 'del' and trash_state is null) as pending, (select count(*) from ledger where state = 'trashed') as trashed, (select count(*) from ledger where state = 'emptied') as emptied from seen""")
def o84_trash_counts(t: Tables) -> DataFrame:
    return A.trash_counts(t.seen, t.ledger, "/lib")


@query("""with p as (select *, case id % 4 when 0 then '/lib/_trash/' when 1 then folder || '/_trash/' when 2 then '/lib/_trash_old/' else '/other/lib/_trash/' end || filename as spot from seen)
    select count(*) filter (where decision = 'del' and trash_state is null and not starts_with(spot, '/lib/_trash/')) as pending, (select count(*) from ledger where state = 'trashed') as trashed, (select count(*) from ledger where state = 'emptied') as emptied from p""")
def o84_trash_inside(t: Tables) -> DataFrame:
    """Only the folder at the root is the trash folder."""
    at = F.expr("concat(case id % 4 when 0 then '/lib/_trash/' when 1 then concat(folder, '/_trash/') when 2 then '/lib/_trash_old/' else '/other/lib/_trash/' end, filename)")
    return A.trash_counts(t.seen.withColumn("path", at), t.ledger, "/lib")


@query("""select case when r < 0.02 then 0 when r < 0.04 then 1 when r < 0.06 then 2 when r < 0.10 then 3 when r < 0.20 then 4 else 5 end as bucket, count(*) as n
    from (select (x2 - x1) / imgw as r from faces f join photos p on f.image_id = p.id) group by 1""")
def o85_face_sizes(t: Tables) -> DataFrame:
    return A.face_size_profile(t.faces, t.photos)


@query("""select id, round((ln(1 + raw_laplacian) - lo) / (hi - lo), 6) as normalised from photos, (select ln(1 + min(raw_laplacian)) as lo, ln(1 + max(raw_laplacian)) as hi from photos)""")
def o87_minmax_log(t: Tables) -> DataFrame:
    return A.minmax_log(t.photos, "raw_laplacian").select("id", F.round("normalised", 6).alias("normalised"))


@query("""select id, dup_group, row_number() over (partition by dup_group order by coalesce(dup_central, -1) desc, coalesce(combined, 0) desc, id) as rep_rank from photos where dup_group is not null""")
def o91_representative(t: Tables) -> DataFrame:
    return Q.representative(t.photos, "dup_group").select("id", "dup_group", F.col("rep_rank").cast("long").alias("rep_rank"))


@query(f"select id, row_number() over (partition by dup_group order by coalesce({KEEPER}, -1) desc, id) as keeper_rank from seen where dup_group is not null and trash_state is null")
def o92_rank_keepers(t: Tables) -> DataFrame:
    return Q.rank_keepers(t.seen, "dup_group").select("id", F.col("keeper_rank").cast("long").alias("keeper_rank"))


@query(f"""select dup_group, id as winner, round(s - n, 6) as margin, coalesce(round(s - n, 6) >= 0.02, false) as clear from (select *, lead(s) over (partition by dup_group order by s desc, id) as n,
    row_number() over (partition by dup_group order by s desc, id) as r from (select *, coalesce({KEEPER}, -1) as s from photos where dup_group is not null)) where r = 1""")
def o93_score_margin(t: Tables) -> DataFrame:
    return Q.score_margin(t.photos, "dup_group")


@query("""with g as (select dup_group, min(coalesce(capture_time, 0)) as t0, min(path) as p0 from photos where dup_group is not null group by 1),
    n as (select dup_group, row_number() over (order by t0, p0) - 1 as number from g)
    select id, number, row_number() over (partition by p.dup_group order by coalesce(capture_time, 0), path) as place from photos p join n on n.dup_group = p.dup_group""")
def o94_renumber(t: Tables) -> DataFrame:
    return Q.renumber(t.photos, "dup_group").select("id", F.col("number").cast("long").alias("number"), F.col("place").cast("long").alias("place"))


@query("""select id, 'u' || id % 5 as dir, case when k = 1 then 'p.jpg' else 'p_' || (k - 1) || '.jpg' end as dest from (select id, row_number() over (partition by id % 5 order by id) + case when id % 5 = 0 then 1 else 0 end as k from photos)""")
def o95_unique_names(t: Tables) -> DataFrame:
    moves = t.photos.select("id", F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("dir"), F.lit("p.jpg").alias("name"))
    existing = moves.filter("dir = 'u0'").select("dir", "name").distinct()
    return Q.unique_names(moves, existing).select("id", "dir", "dest")


@query("select id, coalesce(para_aesthetic, clip_iqa) as aesthetic, (select count(*) from photos) as total from photos order by coalesce(para_aesthetic, clip_iqa) asc nulls first, id limit 120 offset 40")
def o96_page(t: Tables) -> DataFrame:
    rows, total = P.page(t.photos, "aesthetic", "asc", 40, 120)
    return rows.select("id", F.coalesce("para_aesthetic", "clip_iqa").alias("aesthetic")).crossJoin(total)


@query("select id, combined from photos order by combined, id limit 30")
def o97_worst(t: Tables) -> DataFrame:
    return P.worst(t.photos).select("id", "combined")


@query("""select f.id, capture_time, round((x2 - x1) / imgw, 6) as rel from faces f join seen s on f.image_id = s.id where cluster_id = 3 and trash_state is null order by capture_time asc nulls last, f.id limit 50""")
def o98_person_faces(t: Tables) -> DataFrame:
    return P.person_faces(P.face_star(t.faces, t.seen), 3, "date", 0, 50).select("id", "capture_time", F.round("rel", 6).alias("rel"))


@query("select event_id as seq, event_type from events where user_id = 5 and event_id > 2000")
def o99_events_after(t: Tables) -> DataFrame:
    return P.events_after(t.events.withColumn("seq", F.col("event_id")), 5, 2000, "user_id").select("seq", "event_type")


@query("select id, from_path, trashed_at from ledger where state = 'trashed'")
def o100_list_trash(t: Tables) -> DataFrame:
    return P.list_trash(t.ledger).select("id", "from_path", "trashed_at")


@query("select lower(path) as lp, path from (select path, row_number() over (partition by lower(path) order by k, path) as r from (select path, 0 as k from folders union all select upper(path), 1 from folders union all select '/x' || path, 2 from folders)) where r = 1")
def o102_merge_folders(t: Tables) -> DataFrame:
    f = t.folders.select("path")
    return P.merge_folder_sets(f, f.select(F.upper("path").alias("path")), f.select(F.concat(F.lit("/x"), "path").alias("path"))).select(F.lower("path").alias("lp"), "path")


@query("with d as (select distinct folder as path from photos union select '/lib/u' || user_id from photos where user_id % 2 = 0) select path from d a where not exists (select 1 from d b where starts_with(a.path, b.path || '/'))")
def o104_minimal_roots(t: Tables) -> DataFrame:
    p = t.photos
    return P.minimal_roots(p.select(F.col("folder").alias("path")).union(p.filter("user_id % 2 = 0").select(F.concat(F.lit("/lib/u"), F.col("user_id").cast("string")))))


@query("""with m as (select * from seen where combined between 0.5 and 0.6 and trash_state is null), g as (select dup_group, count(*) as size from seen where dup_group in (select dup_group from m) group by 1 order by size desc, dup_group limit 40 offset 5)
    select s.dup_group, s.id, s.id in (select id from m) as matches, row_number() over (partition by s.dup_group order by combined desc nulls last, s.id) as place, g.size, (select count(distinct dup_group) from m where dup_group is not null) as total from seen s join g on g.dup_group = s.dup_group""")
def o105_grouped_page(t: Tables) -> DataFrame:
    seen = t.seen
    m = C.image_filter(seen, {"combined": (0.5, 0.6)})
    groups, members, total = P.grouped_page(seen, m, "dup_group", [F.count(F.lit(1)).alias("size")], [F.desc("size"), F.asc("dup_group")], 5, 40)
    return members.join(groups, "dup_group").crossJoin(total).select("dup_group", "id", "matches", F.col("place").cast("long").alias("place"), "size", "total")


@query("""with g as (select dup_group, count(*) as size, count(*) filter (where trash_state is null) as active, count(*) filter (where trash_state is null and decision is null) as undecided from seen where dup_group in (select dup_group from seen where combined between 0.3 and 0.7) group by 1)
    select * from g order by (active > 1 and undecided > 0) desc, active desc, dup_group limit 60""")
def o106_duplicate_groups(t: Tables) -> DataFrame:
    seen = t.seen
    return P.duplicate_groups(seen, C.score_range(seen, "combined", 0.3, 0.7), "review", 0, 60)[0]


@query("""with pin as (select hash from decisions where substr(hash, 1, 2) = '3a')
    select scene_group, count(*) as size, count(distinct dup_group) as dup_sets, bool_or(content_hash in (select hash from pin) and content_hash is not null) as manual, min(capture_time) as time_start, max(capture_time) as time_end
    from seen where scene_group in (select scene_group from seen where combined between 0.3 and 0.7) group by 1 order by time_start asc nulls last, scene_group limit 60""")
def o107_scenes(t: Tables) -> DataFrame:
    seen = t.seen
    pins = t.decisions.filter("substr(hash, 1, 2) = '3a'")
    return P.scenes(seen, C.score_range(seen, "combined", 0.3, 0.7), pins, "time", 0, 60)[0]


@query("select scene_group, dup_group, string_agg(cast(id as string), ',' order by combined desc nulls last, id) as items from photos where scene_group is not null group by 1, 2")
def o108_nest_by_dup(t: Tables) -> DataFrame:
    x = P.nest_by_dup(t.photos)
    return x.select("scene_group", "dup_group", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


@query("""select dup_group, count(*) filter (where trash_state is null and decision = 'keep') as kept, count(*) filter (where trash_state is null and decision = 'del') as deleted, count(*) filter (where trash_state is null and decision is null) as undecided,
    max(combined) as best, min(combined) as worst, count(*) filter (where combined >= 0.5) as matching, count(*) as total from seen where dup_group is not null group by 1""")
def o134_pile_summary(t: Tables) -> DataFrame:
    return A.pile_summary(t.seen, "dup_group", F.col("combined") >= 0.5)


@query("""select dup_group, case when count(distinct content_hash) = 1 and count(content_hash) = count(*) then 'exact' when bool_and(coalesce(dup_cull_safe, false)) then 'close' else 'alternates' end as kind from seen where dup_group is not null and trash_state is null group by 1""")
def o135_group_kind(t: Tables) -> DataFrame:
    return A.group_kind(t.seen)


@query(f"""with {PEOPLE} select p.cluster_id, case when p.cluster_id < 0 then 'unsorted' when c.name is null and faces = 1 then 'once' else 'main' end as section from people p left join clusters c on c.cluster_id = p.cluster_id""")
def o136_people_sections(t: Tables) -> DataFrame:
    return A.people_sections(A.list_people(t.faces, t.seen, t.clusters)).select("cluster_id", "section")


@query("select tag, count(*) as n from tags where contains(lower(tag), 't1') group by 1 order by n desc, tag limit 5")
def o137_search_tags(t: Tables) -> DataFrame:
    return A.search_tags(A.tag_facet(t.tags), "T1", 5)
