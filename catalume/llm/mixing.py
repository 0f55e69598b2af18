"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.llm.common import numbered, word_count

#: The random offset of a source has this many steps, so that sums with it are exact.
STEPS = 1 << 20


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size -> source, source_size, weight, target.

    Sources are ordered by code point, null last, and take ``weights`` in turn. Together they
    share ``share`` times all sizes by weight, none above ``most`` times its own size; what is
    above is shared again. That level is found in closed form: with the sources in the order of
    cap / weight, the first ones are full and the rest get ``level`` times their weight. The
    window runs over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(float(most))
    t = sizes.withColumn("_k", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_k", F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", cap)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    t = t.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_taken_w", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("_w", F.sum("weight").over(everything))
    level = (F.col("_all") - F.col("_full")) / (F.col("_w") - F.col("_taken_w"))
    t = t.withColumn("_level", F.when(level * F.col("weight") <= F.col("_cap"), level))
    # the first source, in this order, that is not filled sets the level of all after it
    t = t.withColumn("_set", F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_set") * F.col("weight"), F.col("_cap"))).alias("target"))


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str, rows: str | None = None) -> DataFrame:
    n = word_count(docs[text])
    bits = F.length(F.bin(F.col("size")))
    # size class: length in bits and the three bits after the first
    kind = bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7").cast("int")
    out = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), n.alias("size"), *([docs[rows].alias("row_key")] if rows else []))
    out = out.withColumn("kind", kind).withColumn("spread", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return out.withColumn("part", F.substring("spread", 1, 2))


def plan_mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows: str | None = None) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Within a source all documents have the same expected copies, target / source_size. They are
    put in the order of size class (so that a sample of the order is one of all sizes), then of a
    hash of doc_id; the prefix sum of the expected copies, plus one random offset per source,
    gives a document a copy for each integer that it crosses. The taken words of a source thus
    differ from its target by little more than its longest document, and no document is taken
    more than ``ceil(most)`` times. Reruns give the same rows.

    Null texts and texts without words have size 0 and take part. Null sources are one source,
    the last. Repeated rows are each taken on their own; they come as one row whose ``n_rows``
    tells how many they are and whose ``copies`` is that of all. Empty in, empty out. Only narrow
    rows are shuffled, in 256 parts for each source and size class, so a hot source is spread.
    """
    narrow = _narrow(docs, doc_id, text, source, rows)
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most)
    placed = numbered(narrow, ["source"], ["kind", "part"], ["spread", "doc_id", "size", *(["row_key"] if rows else [])], "first")
    t = targets.select(F.col("source").alias("_of"), "source_size", "target")
    x = placed.join(t, placed["source"].eqNullSafe(t["_of"])).drop("_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("long") / F.lit(STEPS)
    crossed = lambda k: F.floor(offset + k * rate)
    copies = crossed(F.col("first") + F.col("n_rows")) - crossed(F.col("first"))
    x = x.withColumn("copies", copies.cast("long"))
    keep = ["doc_id", "source", "size", *(["row_key"] if rows else []), "source_size", "target", "first", "n_rows", "copies"]
    return x.select(*keep, rate.alias("rate"), offset.alias("offset"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken (words, copies counted)."""
    x = plan_mix(docs, **options).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    k = F.col("first") + F.col("i")
    own = F.floor(F.col("offset") + (k + 1) * F.col("rate")) - F.floor(F.col("offset") + k * F.col("rate"))
    return x.select("doc_id", "size", "source_size", "target", (own * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it, same columns.

    A row travels as one struct, so its columns may have any names and types. Texts, however long,
    are shuffled once, to meet the plan by document and row hash. Rows equal in id, text, source
    and all else that can be hashed meet it as one and share its copies evenly, the first ones
    taking what is left over; numbering them takes a task for each such row. Null texts, sources
    and ids take part, see :func:`plan_mix`. Empty in, empty out.
    """
    hashed = [docs[c] for c in docs.columns if not _has_map(docs.schema[c].dataType)]
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[source].alias("source"), F.xxhash64(*hashed).alias("row_key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    plan = plan_mix(rows, rows="row_key", **options).filter("copies > 0")
    p = plan.select(F.col("row_key").alias("of_key"), F.col("doc_id").alias("of_doc"), "copies", F.col("n_rows").alias("equal"))
    x = rows.select("doc_id", "row_key", "row").join(p, (F.col("row_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_doc")))
    single = x.filter("equal = 1").select("row", F.col("copies").alias("own"))
    w = Window.partitionBy("of_key", "of_doc").orderBy(F.lit(1))
    several = x.filter("equal > 1").withColumn("nth", F.row_number().over(w) - 1)
    more = F.when(F.col("nth") < F.col("copies") % F.col("equal"), 1).otherwise(0)
    several = several.select("row", (F.floor(F.col("copies") / F.col("equal")) + more).alias("own"))
    every = single.unionByName(several).filter("own > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own").cast("long")))).select("row.*")


def _has_map(kind: T.DataType) -> bool:
    """Maps can't be hashed."""
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))
