"""The catalog's tables, derived from the generic tables that queries are run over.

There are no photos in the given data, so each table of the catalog is a projection of one of
them. The expressions are plain SQL that any engine reads; where dialects differ there is one
for each. ``views`` makes DataFrames, ``with_clause`` the same tables for the comparison SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EPOCH = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D", "duckdb": "epoch_us(ts) / 1000000.0"}
LIST = {"spark": "array", "duckdb": "list_value"}

#: name -> (base table, columns as SQL, condition). {epoch}: seconds since 1970 of ts.
TABLES: dict[str, tuple[str, dict[str, str], str]] = {
    "photos0": ("events", {
        "id": "event_id", "user_id": "user_id", "event_type": "event_type",
        "folder": "'/lib/u' || cast(user_id as string) || '/' || event_type",
        "filename": "cast(event_id as string) || '.jpg'",
        "t": "{epoch}", "capture_time": "case when event_id % 23 <> 0 then {epoch} end",
        "raw_laplacian": "value * 40",
        "sharpness": "round(least(1.0e0, greatest(0.0e0, (ln(1 + value * 40) - ln(41.0e0)) / (ln(15001.0e0) - ln(41.0e0)))), 4)",
        "para_aesthetic": "case when event_id % 7 <> 0 then (event_id * 37 % 1000) / 1000.0e0 end",
        "clip_iqa": "(event_id * 53 % 1000) / 1000.0e0",
        "portrait": "case when event_id % 5 <> 0 then (event_id * 29 % 1000) / 1000.0e0 end",
        "dup_group": "case when event_id % 3 <> 0 then (event_id - event_id % 6) / 6 end",
        "scene_group": "case when event_id % 10 <> 9 then (event_id - event_id % 20) / 20 end",
        "content_hash": "case when event_id % 97 <> 0 then md5(cast(user_id % 40 as string) || ':' || cast(event_id % 50 as string)) end",
        "dup_central": "case when event_id % 9 <> 0 then (event_id * 17 % 100) / 100.0e0 end",
        "dup_cull_safe": "((event_id - event_id % 6) / 6) % 2 = 0",
        "orientation": "cast(event_id % 8 + 1 as int)", "imgw": "4000 + (event_id % 3) * 1000", "imgh": "3000",
        "fsize": "1000 + event_id % 977", "mtime": "{epoch} + event_id % 3",
        "phash": "substr(md5(cast((event_id - event_id % 3) / 3 as string)), 1, 15) || cast(event_id % 3 as string)",
        "n_faces": "event_id % 4",
        "caption": "event_type || ' Photo-of user_' || cast(user_id as string) || '; ' || props",
    }, "true"),
    "photos1": ("photos0", {
        "*": "*", "path": "folder || '/' || filename",
        "combined": "round(0.4e0 * sharpness + 0.6e0 * coalesce(para_aesthetic, clip_iqa), 4)",
    }, "true"),
    "photos": ("photos1", {
        "id": "id", "user_id": "user_id", "event_type": "event_type", "folder": "folder", "filename": "filename", "path": "path", "capture_time": "capture_time",
        "raw_laplacian": "raw_laplacian", "sharpness": "sharpness", "para_aesthetic": "para_aesthetic", "clip_iqa": "clip_iqa", "combined": "combined", "portrait": "portrait",
        "dup_group": "cast(dup_group as bigint)", "scene_group": "cast(scene_group as bigint)", "content_hash": "content_hash", "dup_central": "dup_central", "dup_cull_safe": "dup_cull_safe",
        "orientation": "orientation", "imgw": "imgw", "imgh": "imgh", "fsize": "fsize", "mtime": "mtime", "phash": "phash", "n_faces": "n_faces", "caption": "caption",
        "face_sharp": "case when n_faces > 0 then 0.5e0 end", "face_expr": "case when n_faces > 1 then 0.25e0 end",
    }, "true"),
    "hashes": ("photos", {"distinct": "content_hash as hash"}, "content_hash is not null"),
    "decisions": ("hashes", {"hash": "hash", "decision": "case when substr(hash, 1, 1) in ('0', '1', '2', '3') then 'keep' else 'del' end"}, "substr(hash, 1, 1) in ('0', '1', '2', '3', '4', '5', '6')"),
    "copies": ("photos", {"path": "path", "hash": "content_hash", "decision": "case when id % 3 = 0 then 'keep' when id % 3 = 1 then 'del' end"}, "id % 17 = 0 and content_hash is not null"),
    "ledger_a": ("photos", {
        "id": "id * 10", "image_id": "id", "hash": "content_hash", "from_path": "'/orig' || path", "trash_path": "path",
        "state": "case id % 4 when 0 then 'trashed' when 1 then 'restored' when 2 then 'emptied' else 'missing' end", "trashed_at": "1000.0e0 + id",
    }, "id % 11 = 0"),
    "ledger_b": ("photos", {
        "id": "id * 10 + 1", "image_id": "id", "hash": "content_hash", "from_path": "'/orig' || path", "trash_path": "path",
        "state": "case (id + 1) % 4 when 0 then 'trashed' when 1 then 'restored' when 2 then 'emptied' else 'missing' end", "trashed_at": "2000.0e0 + id",
    }, "id % 22 = 0"),
    "ledger": ("ledger_a", {"union": "ledger_b"}, "true"),
    "image_tags": ("photos", {"image_id": "id", "tag": "event_type"}, "true"),
    "tags_b": ("photos", {"image_id": "id", "tag": "'t' || cast(id % 12 as string)"}, "id % 2 = 0"),
    "tags": ("image_tags", {"union": "tags_b"}, "true"),
    "faces": ("lineitem", {
        "id": "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000", "image_id": "l_orderkey",
        "x1": "l_linenumber * 90.0e0", "y1": "l_quantity * 10", "x2": "l_linenumber * 90.0e0 + 50 + l_quantity * 4", "y2": "l_quantity * 10 + 60 + l_quantity * 3",
        "prob": "1 - l_discount", "cluster_id": "case when l_linenumber = 6 then null when l_suppkey % 11 = 0 then -1 else l_suppkey end",
        "sharp": "case when l_partkey % 13 <> 0 then l_tax * 10 end", "expr": "case when l_partkey % 7 <> 0 then (l_partkey % 100) / 100.0e0 end",
    }, "true"),
    "clusters": ("supplier", {"cluster_id": "s_suppkey", "name": "case when s_suppkey % 3 = 0 then s_name end"}, "true"),
    "folders": ("customer_places", {"path": "'/' || r_name || '/' || n_name || '/' || c_mktsegment", "n": "n"}, "true"),
    "vectors": ("embeddings", {"id": "vec_id", "path": "'/v/' || cast(vec_id as string) || '.jpg'", "embedding": "embedding", "label": "label", "capture_time": "vec_id * 3.0e0", "phash": "substr(md5(cast((vec_id - vec_id % 3) / 3 as string)), 1, 15) || cast(vec_id % 3 as string)"}, "true"),
}

PLACES = "select r_name, n_name, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name, c_mktsegment"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def _sql(name: str, engine: str) -> str:
    base, cols, where = TABLES[name]
    if "union" in cols:
        return f"select * from {base} union all select * from {cols['union']}"
    if "distinct" in cols:
        return f"select distinct {cols['distinct']} from {base} where {where}"
    parts = [c if n == "*" else f"{c} as {n}" for n, c in cols.items()]
    return f"select {', '.join(parts)} from {base} where {where}".replace("{epoch}", EPOCH[engine])


def _needs(text: str) -> list[str]:
    """Adapter tables that a text names, with what they need, in the order to define them."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in out or name not in TABLES:
            return
        base, cols, _ = TABLES[name]
        add(base)
        if "union" in cols:
            add(cols["union"])
        out.append(name)

    for word in dict.fromkeys(re.findall(r"\w+", text)):
        add(word)
    return out


def with_clause(sql: str) -> str:
    """The SQL with the tables it names before it."""
    names = _needs(sql)
    parts = ["customer_places as (" + PLACES + ")"] if "folders" in names else []
    parts += [f"{n} as ({_sql(n, 'duckdb')})" for n in names]
    if not parts:
        return sql
    m = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    if m:
        return f"with {m[1] or ''}{', '.join(parts)}, {sql[m.end():]}"
    return f"with {', '.join(parts)} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table, or a given one, as a DataFrame."""
    if name not in TABLES:
        if name == "customer_places":
            c, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
            x = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
            return x.groupBy("r_name", "n_name", "c_mktsegment").count().withColumnRenamed("count", "n")
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, cols, where = TABLES[name]
    df = table(spark, sf_dir, base)
    if "union" in cols:
        return df.unionByName(table(spark, sf_dir, cols["union"]))
    if "distinct" in cols:
        return df.filter(where).selectExpr(cols["distinct"]).distinct()
    parts = [c if n == "*" else f"{c} as {n}" for n, c in cols.items()]
    return df.filter(where).selectExpr(*[p.replace("{epoch}", EPOCH["spark"]) for p in parts])
