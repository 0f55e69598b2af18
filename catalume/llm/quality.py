"""Quality rules: statistics of a text, and robust multivariate outliers per language and source.

All of it is DataFrame and SQL functions. The minimum covariance determinant (Rousseeuw and Van
Driessen, 1999) is the half of a group whose scatter has the least determinant. It is looked for
by concentration steps from many starts: three of the whole group (Hubert, Rousseeuw and Verdonck,
2012) and ``DRAWS`` of a few vectors each, drawn by hash, of which the ``BEST`` go on after two
steps. With the present centre and scatter every vector falls into a bin of its squared distance; moments
are summed by group and bin; the nearest bins that hold the share ``SUPPORT`` of a group, the last
one in part, give the next centre and scatter. Steps end when nothing moves any more, and the
start with the least determinant is taken.

Equal vectors of a group are one row with a count from the start, so the steps work on what is
different, however large a group is. Statistics are whole numbers (1/1024 steps), so that sums
are exact and reruns agree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.common import WORD, fresh
from catalume.sources.scratch import stage_table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Positions of words take so many bits beside the hash of a window.
POSITION = 30
#: Steps of a statistic, and how far from the median it can be.
UNIT, FAR = 1024, 8192
#: Bins of a squared distance for each power of e.
BINS = 64
#: Share of a group that estimates its centre and scatter; up to the other half may be outliers.
SUPPORT = 0.5
#: Least standard deviations, in units of the statistics. More than half of the good texts have no
#: symbols and no repeated lines or words, so the best half of most groups lies in a plane and has
#: no determinant; a deviation that is smaller is raised to this. Others stay as they are.
LEAST_SD = (0.06, 0.10, 0.20, 0.14)
#: Share of a variance that the other statistics can't tell, at least: halves may lie in a plane that
#: isn't along the axes, too.
ALONE = 0.1
#: Share of a normal group that lies within the cutoff.
WITHIN = 0.9999
#: Concentration steps at most; they end before when nothing moves.
STEPS = 15
P = 4
#: Documents of a group that weigh as much as what it leans on, five for each statistic: a group leans on its
#: language, a language on all documents, and these on the least deviations, times ``WIDE``.
SHARED, WIDE = 5 * P, 3.0
#: Starts that are drawn, about how many vectors each has, and how many starts go on after two steps.
DRAWS, DRAWN, BEST = 20, 6, 3


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words inside 3-word windows that are found twice or more count once each. The windows of a
    text are hashed, packed with their position and sorted as plain numbers; neighbours with the
    same short hash are then compared by 64-bit hashes. Nothing is shuffled or exploded. Write the
    result before filtering on it, as :func:`judge` does.
    Null texts have none of anything. Existing columns of these names are replaced.
    """
    words, lines, packed, close, at, t = fresh(docs, "t_words", "t_lines", "t_packed", "t_close", "t_at", "t_text")
    x = docs.withColumn(t, F.coalesce(docs[text], F.lit("")))
    x = x.withColumn(words, F.array_remove(F.split(t, SPACE), ""))
    x = x.withColumn(lines, F.filter(F.split(t, "\n"), lambda s: s.rlike(WORD)))
    window = lambda p: F.xxhash64(F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
    high = F.lit(-1 << POSITION)
    none = F.array().cast("array<bigint>")
    pack = lambda p: window(p.cast("int")).bitwiseAND(high).bitwiseOR(p)
    x = x.withColumn(packed, F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), (F.size(words) - 3).cast("long")), pack))).otherwise(none))
    short = lambda v: F.shiftright(v, POSITION)
    x = x.withColumn(close, F.filter(packed, lambda v, i: (short(F.get(packed, i + 1)) == short(v)) | ((i > 0) & (short(F.get(packed, F.greatest(i - 1, F.lit(0)))) == short(v)))))
    exact = F.sort_array(F.transform(close, lambda v: F.struct(window(v.bitwiseAND(F.lit((1 << POSITION) - 1)).cast("int")).alias("h"), v.bitwiseAND(F.lit((1 << POSITION) - 1)).alias("p"))))
    x = x.withColumn(close, exact)
    twice = F.filter(close, lambda v, i: (F.get(close, i + 1)["h"] == v["h"]) | ((i > 0) & (F.get(close, F.greatest(i - 1, F.lit(0)))["h"] == v["h"])))
    x = x.withColumn(at, F.sort_array(F.transform(twice, lambda v: v["p"])))
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, n: a + n)
    x = x.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
    })
    return x.drop(words, lines, packed, close, at, t)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The transformed statistics, in units, of a text with words; the same SQL in either engine.
STATISTICS = (
    "ln(word_chars / cast(n_words as double))",
    "ln(1 + 4 * (n_symbols / cast(n_words as double)))",
    "sqrt(n_dup_lines / cast(n_lines as double))",
    "sqrt(n_repeat_words / cast(n_words as double))",
)


def chi2_cdf(x: float, k: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(q: float, k: int = P) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


#: Makes the scatter of the nearest share of a normal sample one of all.
CONSISTENT = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT), P + 2)


def cholesky() -> list[tuple[str, str]]:
    """SQL of the lower triangle l_ij of the matrix s_ij (i >= j), variances raised to the least, in the order to compute it in."""
    out = [(f"v_{i}", f"greatest(s_{i}{i}, {(sd * UNIT) ** 2!r})") for i, sd in enumerate(LEAST_SD)]
    for i in range(P):
        for j in range(i + 1):
            rest = "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j))
            out.append((f"l_{i}{j}", f"sqrt(greatest(v_{i}{rest}, {ALONE} * v_{i}))" if i == j else f"(s_{i}{j}{rest}) / l_{j}{j}"))
    return out


def forward() -> list[tuple[str, str]]:
    """SQL of z, with L z = x - m; the squared distance is the sum of z_i * z_i."""
    return [(f"z_{i}", f"(x_{i} - m_{i}{''.join(f' - l_{i}{k} * z_{k}' for k in range(i))}) / l_{i}{i}") for i in range(P)]


DISTANCE = " + ".join(f"z_{i} * z_{i}" for i in range(P))
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _with(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Adds columns, each of which may use those before it."""
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in columns])


def _median(df: DataFrame, values: list[str]) -> DataFrame:
    """gid -> the lower median of each column of whole numbers with counts n, by counts of its values."""
    long = df.select("gid", "n", F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*values))).alias("what", "value"))
    counts = long.groupBy("gid", "what", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("gid", "what")
    up = counts.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("all", F.sum("n").over(w))
    med = up.filter("2 * upto >= all").groupBy("gid", "what").agg(F.min("value").alias("m"))
    return med.groupBy("gid").agg(*[F.max(F.when(F.col("what") == v, F.col("m"))).alias(v) for v in values])


#: The scatter of a group from which the concentration starts, in its own scales: none between the
#: statistics; of bounded (tanh) statistics; of directions only.
SCALE = [f"greatest(1.4826 * a_{i}, {sd * UNIT!r})" for i, sd in enumerate(LEAST_SD)]
BOUNDED = [f"tanh(x_{i} / d_{i})" for i in range(P)]
DIRECTION = [f"x_{i} / d_{i} / greatest(1e-9, sqrt({' + '.join(f'(x_{k} / d_{k}) * (x_{k} / d_{k})' for k in range(P))}))" for i in range(P)]


def starting_scatters(near: DataFrame, mad: DataFrame) -> DataFrame:
    """gid, start, m_i, s_ij. Rounded, so that the order of sums doesn't matter."""
    d = mad.select("gid", *[F.expr(x).alias(f"d_{i}") for i, x in enumerate(SCALE)])
    x = near.join(d, "gid")
    y = x.select("gid", "n", *[f"d_{i}" for i in range(P)], *[F.expr(e).alias(f"t_{i}") for i, e in enumerate(BOUNDED)], *[F.expr(e).alias(f"u_{i}") for i, e in enumerate(DIRECTION)])
    mean = lambda t, i, j: f"sum(n * t_{i} * t_{j}) / sum(n)".replace("t_", f"{t}_")
    sums = y.groupBy("gid", *[f"d_{i}" for i in range(P)]).agg(*[F.expr(f"round({mean(t, i, j)}, 6)").alias(f"{t}{i}{j}") for t in "tu" for i, j in PAIRS])
    entry = {0: lambda i, j: f"d_{i} * d_{j} * {float(i == j)}", 1: lambda i, j: f"d_{i} * d_{j} * t{i}{j}", 2: lambda i, j: f"d_{i} * d_{j} * u{i}{j} * {float(P)}"}
    parts = [sums.select("gid", F.lit(k).alias("start"), *[F.lit(0.0).alias(f"m_{i}") for i in range(P)], *[F.expr(entry[k](i, j)).alias(f"s_{i}{j}") for i, j in PAIRS]) for k in entry]
    kinds = near.groupBy("gid").agg(F.count(F.lit(1)).alias("kinds"))
    each = near.join(kinds, "gid").select("gid", "kinds", *[f"x_{i}" for i in range(P)], F.explode(F.sequence(F.lit(len(entry)), F.lit(len(entry) + DRAWS - 1))).alias("start"))
    place = F.conv(F.substring(F.md5(F.concat_ws(",", "start", *[f"x_{i}" for i in range(P)])), 1, 8), 16, 10).cast("long")
    drawn = each.filter(place * F.col("kinds") < DRAWN << 32).groupBy("gid", "start").agg(*[F.expr(f"avg(x_{i})").alias(f"m_{i}") for i in range(P)], *[F.expr(f"avg(x_{i} * x_{j})").alias(f"b_{i}{j}") for i, j in PAIRS])
    parts.append(drawn.select("gid", "start", *[f"m_{i}" for i in range(P)], *[F.expr(f"b_{i}{j} - m_{i} * m_{j}").alias(f"s_{i}{j}") for i, j in PAIRS]))
    return reduce(DataFrame.unionByName, parts)


def _scatter(params: DataFrame) -> DataFrame:
    """gid, start, centres m_i and Cholesky factors from the columns m_i and s_ij."""
    return _with(params, cholesky()).select("gid", "start", *[f"m_{i}" for i in range(P)], *[f"l_{i}{j}" for i, j in PAIRS])


def group_ids() -> list[Column]:
    """Names of the groups of a document: language and source, language, all."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return [F.concat(name(F.col("of_lang")), F.lit("\u0001"), name(F.col("of_source"))), name(F.col("of_lang")), F.lit("")]


def minimum_covariance(points: DataFrame) -> DataFrame:
    """points: gid, x_0 .. x_3, n (all long). Returns gid, n, c_i, m_i, l_ij: median, centre about it, and scatter of each group.

    The tables between the steps have a row for each group and start; whether they are broadcast
    is left to Spark, by their size.
    """
    x = [f"x_{i}" for i in range(P)]
    med = stage_table(_median(points, x).select("gid", *[F.col(c).alias(f"c_{i}") for i, c in enumerate(x)]), "medians")
    near = points.join(med, "gid").select("gid", *[F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col(f"x_{i}") - F.col(f"c_{i}"))).cast("long").alias(f"x_{i}") for i in range(P)], "n")
    near = stage_table(near, "points")
    mad = _median(near.select("gid", "n", *[F.abs(c).alias(c) for c in x]), x).select("gid", *[F.col(c).alias(f"a_{i}") for i, c in enumerate(x)])
    params = stage_table(_scatter(starting_scatters(near, mad)), "scatter")
    sums = [f"a_{i}" for i in range(P)] + [f"b_{i}{j}" for i, j in PAIRS]
    own = [f"m_{i}" for i in range(P)] + [f"l_{i}{j}" for i, j in PAIRS]
    spread = F.expr(" + ".join(f"ln(l_{i}{i})" for i in range(P)))
    for step in range(STEPS):
        d = _with(near.join(params, "gid"), forward())
        binned = d.withColumn("bin", F.expr(f"cast(floor(ln({DISTANCE} + 1e-6) * {BINS}) as int)"))
        of = [F.sum("n").alias("n"), *[F.sum(F.expr(f"n * x_{i}")).alias(f"a_{i}") for i in range(P)], *[F.sum(F.expr(f"n * x_{i} * x_{j}")).alias(f"b_{i}{j}") for i, j in PAIRS]]
        by_bin = binned.groupBy("gid", "start", "bin").agg(*of)
        w = Window.partitionBy("gid", "start")
        by_bin = by_bin.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("h", SUPPORT * F.sum("n").over(w))
        # whole bins, and of the last one the share that is still needed
        part = by_bin.filter("before < h").withColumn("share", F.expr("case when before + n > h then (h - before) / n end"))
        inner = part.groupBy("gid", "start", "h").agg(*[F.expr(f"(coalesce(sum({c}) filter (where share is null), 0) + coalesce(max(share * {c}), 0.0)) / h").alias(c) for c in sums])
        m = [F.col(f"a_{i}").alias(f"m_{i}") for i in range(P)]
        s = [F.expr(f"{CONSISTENT!r} * (b_{i}{j} - a_{i} * a_{j})").alias(f"s_{i}{j}") for i, j in PAIRS]
        new = _scatter(inner.select("gid", "start", *m, *s))
        old = params.select("gid", "start", *[F.col(c).alias(f"old_{c}") for c in own])
        same = reduce(Column.__and__, [F.col(c) == F.col(f"old_{c}") for c in own])
        new = new.join(old, ["gid", "start"]).select("gid", "start", *own, (~same).alias("moved"))
        if step == 1:  # a row for each start
            new = new.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy(spread, "start"))).filter(F.col("place") <= BEST).drop("place")
        new = stage_table(new, "scatter")
        params = new.drop("moved")
        if step > 1 and new.filter("moved").isEmpty():
            break
    best = params.groupBy("gid").agg(F.min_by(F.struct(*own), F.struct(spread, "start")).alias("p"))
    size = near.groupBy("gid").agg(F.sum("n").alias("n"))
    return stage_table(best.select("gid", "p.*").join(med, "gid").join(size, "gid"), "groups")


def lean(groups: DataFrame, of: DataFrame) -> DataFrame:
    """of_0, m_i, l_ij: centre and scatter that documents of the groups in ``of`` (of_0, of_1) are judged by.

    A group of n documents has the weight n / (n + ``SHARED``) in its own judgement, its language the
    same of the rest, then all documents; the last rest goes to a wide scatter. So no size switches anything.
    """

    def part(k: int) -> DataFrame:
        centre = [F.expr(f"c_{i} + m_{i}").alias(f"k{k}_{i}") for i in range(P)]
        scatter = [F.expr(" + ".join(f"l_{i}{c} * l_{j}{c}" for c in range(j + 1))).alias(f"s{k}_{i}{j}") for i, j in PAIRS]
        return groups.select(F.col("gid").alias(f"gid_{k}"), F.expr(f"n / (n + {float(SHARED)})").alias(f"w_{k}"), *centre, *scatter)

    x = of.join(part(0), F.col("of_0") == F.col("gid_0")).join(part(1), F.col("of_1") == F.col("gid_1")).crossJoin(part(2).filter("gid_2 = ''"))  # one row
    wide = lambda i, j: repr((WIDE * LEAST_SD[i] * UNIT) ** 2 if i == j else 0.0)
    m = [(f"m_{i}", f"w_0 * k0_{i} + (1 - w_0) * (w_1 * k1_{i} + (1 - w_1) * k2_{i})") for i in range(P)]
    s = [(f"s_{i}{j}", f"w_0 * s0_{i}{j} + (1 - w_0) * (w_1 * s1_{i}{j} + (1 - w_1) * (w_2 * s2_{i}{j} + (1 - w_2) * {wide(i, j)}))") for i, j in PAIRS]
    return _with(x, [*m, *s, *cholesky()]).select("of_0", *[name for name, _ in m], *[f"l_{i}{j}" for i, j in PAIRS])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) of each row, with its statistics, base_failed, distance2 and kept.

    A document fails the base rules, or is rejected if its squared robust distance from its group
    (language and source) is beyond the cutoff of the chi-square distribution. The smaller a group, the
    more it leans on its language and on all documents (:func:`lean`); even a single document has a
    distance. Null languages and sources are values of their own. Null
    and empty texts fail the base rules. Repeated rows count, and are judged, each on its own.
    Very long texts are one row like others. Columns of ``docs`` may have any names. Empty in,
    empty out.
    """
    own = docs.columns if carry is None else carry
    inner = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs[lang].alias("of_lang"), docs[source].alias("of_source"), docs[text].alias("of_text"))
    stats = text_statistics(inner, "of_text")
    stats = stats.drop("of_text").withColumn("base_failed", base_failed())
    # written once: filters on these statistics would otherwise be pushed into, and repeat, their long expressions
    stats = stage_table(stats, "statistics")
    units = [F.expr(f"cast(round({UNIT} * ({sql})) as bigint)") for sql in STATISTICS]
    point = stats.withColumns({f"x_{i}": F.when(F.col("n_words") > 0, u) for i, u in enumerate(units)})
    x = [f"x_{i}" for i in range(P)]
    points = point.filter(~F.col("base_failed")).select(F.explode(F.array(*group_ids())).alias("gid"), *x).groupBy("gid", *x).agg(F.count(F.lit(1)).alias("n"))
    groups = minimum_covariance(stage_table(points, "vectors"))
    names = {f"of_{k}": g for k, g in enumerate(group_ids()[:2])}
    of = point.filter(~F.col("base_failed")).select(*[g.alias(k) for k, g in names.items()]).distinct()
    judges = stage_table(lean(groups, of), "judges")
    y = point.withColumn("of_0", names["of_0"]).join(judges, "of_0", "left")
    y = _with(y, forward()).withColumn("distance2", F.when(~F.col("base_failed"), F.expr(DISTANCE)))
    beyond = F.coalesce(F.col("distance2") > chi2_quantile(WITHIN), F.lit(False))
    y = y.withColumn("kept", ~F.col("base_failed") & ~beyond)
    return y.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept."""
    return judge(docs, carry=["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("distance2", 6).alias("distance2"), "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns. Texts are written once and not shuffled."""
    return judge(docs).filter("kept").select("row.*")
