"""Text, path, time and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox_key(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Four sides to one place, joined by commas."""
    return F.concat_ws(",", *[F.round(c.cast("double"), 1).cast("string") for c in (x1, y1, x2, y2)])


def parse_bbox(key: Column) -> Column:
    """Struct of four doubles."""
    parts = F.split(key, ",")
    return F.struct(*[F.get(parts, i).try_cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def clean_tags(text: Column, k: int = 8, longest: int = 40, most_words: int = 4) -> Column:
    """Tags from free text: split at commas, lines and semicolons; without list markers; distinct; at most k."""
    one = lambda t: F.lower(F.btrim(F.regexp_replace(F.trim(t), r"^(?:[-•]\s*|\d+[.)]\s+)", ""), F.lit(". ")))
    parts = F.transform(F.split(text, r"[,\n;]"), one)
    fine = F.filter(parts, lambda t: (t != "") & (F.length(t) <= longest) & (F.size(F.split(t, r"\s+")) <= most_words))
    return F.slice(F.array_distinct(fine), 1, k)


def capture_time(fields: list[Column], mtime: Column) -> Column:
    """Epoch seconds of the first parseable 'yyyy:MM:dd HH:mm:ss', else mtime, else 0."""
    parsed = [F.unix_timestamp(F.try_to_timestamp(F.trim(c), F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double") for c in fields]
    return F.coalesce(*parsed, mtime.cast("double"), F.lit(0.0))


def dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def suffix(p: Column) -> Column:
    """The last extension with its dot; hidden files without one have none."""
    return F.regexp_extract(basename(p), r"^.+(\.[^.]+)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"^(.+)\.[^.]+$", "$1")


def upright_size(w: Column, h: Column, orientation: Column) -> Column:
    turned = orientation.between(5, 8)
    return F.struct(F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def upright_box(box: tuple[Column, Column, Column, Column], w: Column, h: Column, orientation: Column) -> Column:
    """A box of the stored image in the image as it is seen; w and h are of the stored image."""
    x1, y1, x2, y2 = box
    turned = {
        2: (w - x2, y1, w - x1, y2), 3: (w - x2, h - y2, w - x1, h - y1), 4: (x1, h - y2, x2, h - y1), 5: (y1, x1, y2, x2),
        6: (h - y2, x1, h - y1, x2), 7: (h - y2, w - x2, h - y1, w - x1), 8: (y1, w - x2, y2, w - x1),
    }
    make = lambda b: F.struct(*[c.cast("double").alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])
    out = make(box)
    for k, b in turned.items():
        out = F.when(orientation == k, make(b)).otherwise(out)
    return out


def phrases(q: str) -> list[str]:
    """Each word of a query is a phrase of one or more tokens, written with single spaces."""
    import re

    return [p for p in (" ".join(re.findall(r"\w+", w.lower().replace("_", " "))) for w in q.split()) if p]


def has_phrases(text: Column, q: str) -> Column:
    """Every phrase of the query occurs as neighbouring tokens, whatever the case."""
    joined = F.concat(F.lit(" "), F.array_join(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), " "), F.lit(" "))
    out = F.lit(True)
    for p in phrases(q):
        out = out & joined.contains(f" {p} ")
    return out
