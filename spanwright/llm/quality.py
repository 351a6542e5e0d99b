"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

``text_statistics`` computes counts of each whole text. ``mcd_estimates`` fits a minimum
covariance determinant estimate of location and scatter to transformed statistics of each
(language, source) group; ``judge`` rejects documents far from their group's estimate by
Mahalanobis distance. All of it is DataFrame expressions.

Null text counts as empty (n_words 0, fails the base rules). Null lang or source is a group
of its own. Repeated rows are judged each. Very long texts are counted whole. Distances that
equal the cutoff are kept; of starts with one determinant the first is. An empty table gives an
empty result. Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_GAP, blank, null_key, stash, table


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are the base rules. cover: share of a group's
    documents that the estimate rests on. tail: odds that a regular document is rejected, were
    the statistics normal; the cutoff is that quantile of chi-square, times how much farther
    than normal ones the ``spread`` quantile of the group's distances lies, if it does: tails
    heavier than normal raise the cutoff of their group. floors: least standard deviation of
    each transformed statistic. min_group: smaller groups share an estimate per language; where
    that is smaller too, one of all languages. starts: from which subsets the search begins."""

    min_words: int = 50
    max_repeat_percent: int = 50
    cover: float = 0.75
    tail: float = 1e-6
    spread: float = 0.75
    floors: tuple[float, ...] = (0.06, 0.3, 0.8, 0.8, 0.3)
    min_group: int = 50
    steps: int = 4
    starts: tuple[str, ...] = ("quartiles", "scatter", "tenth")


#: Transformed statistics, in the order of Rules.floors.
DIMS = ("x0", "x1", "x2", "x3", "x4")
_BIN = 32.0  # bins of log2(1 + distance) that hold the order of distances


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines and
    n_upper for the outlier rule (all long), under ``prefix``."""
    p = prefix
    tmp = [f"__sw_{n}" for n in ("words", "lines", "hashes", "twice")]
    words, lines, hashes, twice = map(F.col, tmp)
    clean = blank(F.col(text))
    out = docs.withColumn(tmp[0], word_list(clean)).withColumn(tmp[1], F.filter(F.split(clean, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    n = F.size(words)
    # a text whose windows' hashes all differ has no window twice; others compare the words
    triple = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    out = out.withColumn(tmp[2], F.slice(triple, 1, F.greatest(n - 2, F.lit(0))))
    out = out.withColumn(tmp[3], F.size(hashes) > F.size(F.array_distinct(hashes)))
    out = out.select(
        *docs.columns,
        n.cast("long").alias(f"{p}n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias(f"{p}word_chars"),
        F.length(F.regexp_replace(clean, r"[^#*$%&|<>]+", "")).cast("long").alias(f"{p}n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        F.when(twice, _covered(hashes, words)).otherwise(F.lit(0)).cast("long").alias(f"{p}n_repeat_words"),
        F.size(lines).cast("long").alias(f"{p}n_lines"),
        F.length(F.regexp_replace(clean, r"[^A-Z]+", "")).cast("long").alias(f"{p}n_upper"),
    )
    return out


def _covered(hashes: Column, words: Column | None = None) -> Column:
    """Words in windows of three that occur twice: sort (hash, place), take the places of equal
    neighbours, and add up what each adds to the words covered so far. If neighbours of one hash
    have other ``words``, windows are sorted and compared by their words instead."""

    def count(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    def places(ordered: Column) -> Column:
        alike = F.transform(ordered, lambda c, i: F.when((c["h"] == F.get(ordered, i - 1)["h"]) | (c["h"] == F.get(ordered, i + 1)["h"]), c["i"]))
        return F.sort_array(F.array_compact(alike))

    def of(names: Column, inside) -> Column:
        return _let(F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), inside)

    counted = lambda x: _let(places(x), count)
    if words is None:
        return of(hashes, counted)
    spelled = F.transform(hashes, lambda h, i: F.struct(*[F.get(words, i + k).alias(f"w{k}") for k in range(3)]))

    def other_words(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & ((F.get(words, a["i"]) != F.get(words, b["i"])) | (F.get(words, a["i"] + 1) != F.get(words, b["i"] + 1)) | (F.get(words, a["i"] + 2) != F.get(words, b["i"] + 2)))

    clash = lambda x: F.exists(F.transform(x, lambda c, i: F.coalesce(other_words(c, F.get(x, i - 1)), F.lit(False))), lambda v: v)
    return of(hashes, lambda x: F.when(clash(x), of(spelled, counted)).otherwise(counted(x)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once though ``body`` names it often."""
    return F.transform(F.array(value), body)[0]


def base_failed(rules: Rules, p: str = "") -> Column:
    return (F.col(f"{p}n_words") < rules.min_words) | (100 * F.col(f"{p}n_repeat_words") > rules.max_repeat_percent * F.col(f"{p}n_words"))


def transformed(p: str = "") -> list[Column]:
    """Mean word length and the shares of symbols, repeated lines, repeated words and
    capitals, on log scales."""
    n = F.greatest(F.col(f"{p}n_words"), F.lit(1)).cast("double")
    chars, lines = F.greatest(F.col(f"{p}word_chars"), F.lit(1)).cast("double"), F.greatest(F.col(f"{p}n_lines"), F.lit(1)).cast("double")
    percent = lambda a, b: F.log1p(100.0 * a / b)
    return [F.log(chars / n), percent(F.col(f"{p}n_symbols"), n), percent(F.col(f"{p}n_dup_lines"), lines), percent(F.col(f"{p}n_repeat_words"), n), percent(F.col(f"{p}n_upper"), chars)]


def with_group(stats: DataFrame, rules: Rules, p: str = "") -> DataFrame:
    """Adds ``g``, by which a row is judged: the (lang, source) group, the language where that
    is small, or all where that is small too; and ``rests``: the groups whose estimates rest on
    the row, of those by which any row is judged."""
    good = F.count_if(~base_failed(rules, p))
    sizes = stats.groupBy(null_key("lang", "source").alias("g0"), null_key("lang").alias("g1")).agg(good.alias("size"))
    sizes = sizes.withColumn("size1", F.sum("size").over(Window.partitionBy("g1")))
    level = F.when(F.col("size") >= rules.min_group, 0).when(F.col("size1") >= rules.min_group, 1).otherwise(2)
    sizes = sizes.withColumn("level", level)
    sizes = stash(sizes.withColumn("pooled", F.max(F.col("level") == 1).over(Window.partitionBy("g1"))), "sizes")
    anyone = not sizes.where("level = 2").isEmpty()
    names = F.array("g0", "g1", F.lit("all"))
    rests = F.array_compact(F.array(F.when(F.col("level") == 0, F.col("g0")), F.when(F.col("pooled"), F.col("g1")), F.when(F.lit(anyone), "all")))
    out = stats.withColumn("g0", null_key("lang", "source"))
    return out.join(_small(sizes.select("g0", names[F.col("level")].alias("g"), rests.alias("rests"))), "g0").drop("g0")


#: Rows of a table of groups up to which it is sent to every task; each has some 30 numbers.
SMALL_ROWS = 20_000


def _small(groups: DataFrame) -> DataFrame:
    """A table with a row for each group, to be broadcast if it has few."""
    kept = stash(groups, "groups")
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def _estimate(rows: DataFrame, *more: str) -> DataFrame:
    """Count, means and covariances of each group, and of each of ``more`` in it."""
    k = range(len(DIMS))
    means = [F.avg(d).alias(f"m{i}") for i, d in enumerate(DIMS)]
    return rows.groupBy("g", *more).agg(F.count("*").alias("n"), *means, *[F.covar_pop(DIMS[i], DIMS[j]).alias(f"s{i}{j}") for i in k for j in k if j <= i])


def _cholesky(est: DataFrame, rules: Rules, scale: float, *more: str) -> DataFrame:
    """Adds the lower triangle l_ij of the scatter, inflated by ``scale`` and by the floors."""
    k = len(DIMS)
    out = est
    for i in range(k):
        for j in range(i + 1):
            dot = sum((F.col(f"l{i}{m}") * F.col(f"l{j}{m}") for m in range(j)), F.lit(0.0))
            if i == j:
                out = out.withColumn(f"l{i}{i}", F.sqrt(F.greatest(F.col(f"s{i}{i}") * scale + rules.floors[i] ** 2 - dot, F.lit(rules.floors[i] ** 2 / 4))))
            else:
                out = out.withColumn(f"l{i}{j}", (F.col(f"s{i}{j}") * scale - dot) / F.col(f"l{j}{j}"))
    return out.select("g", *more, "n", *[f"m{i}" for i in range(k)], *[f"l{i}{j}" for i in range(k) for j in range(i + 1)])


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i, xi in enumerate(x):
        y.append((xi - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * y[j] for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(1 + distance) * _BIN).cast("int")


def _quantile_bins(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """``by`` and edge: the bin up to which that share of a group's rows lies."""
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    return upto.groupBy(*by).agg(F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))).alias("edge"))


def _quartile_start(points: DataFrame) -> DataFrame:
    """Medians and quartile spreads, no correlation. Order statistics come from counts of bins."""
    k = len(DIMS)
    long = points.select("g", F.posexplode(F.array(*[F.round(F.col(d) * 64).cast("int") for d in DIMS])).alias("dim", "bin"))
    bins = long.groupBy("g", "dim", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "dim")
    run = bins.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    quart = run.groupBy("g", "dim").agg(*[at(q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))], F.first("all").alias("n"))
    spread = F.pow((F.col("q3") - F.col("q1")) / 64.0 / 1.349, 2)
    of = lambda i, v: F.max(F.when(F.col("dim") == i, v))
    first = quart.groupBy("g").agg(F.max("n").alias("n"), *[of(i, F.col("q2") / 64.0).alias(f"m{i}") for i in range(k)], *[of(i, spread).alias(f"s{i}{i}") for i in range(k)])
    return first.withColumns({f"s{i}{j}": F.lit(0.0) for i in range(k) for j in range(i)})


def mcd_estimates(points: DataFrame, rules: Rules) -> DataFrame:
    """The estimate of each group of ``points`` (g, x0..x4) with the least determinant: from
    several starts, concentration steps take the ``cover`` share of rows nearest by distance
    and estimate again; of the starts' last scatters the smallest is kept.

    Starts: medians and quartile spreads; mean and scatter of all rows; mean and scatter of a
    tenth of them, by hash. All go side by side as groups of their own. Order statistics come
    from counts per bin, so groups of any size are summed on the map side and no group's rows
    meet in one task. Each step's table has a row for each group and start.
    """
    k = len(DIMS)
    tenth = F.pmod(F.xxhash64(*DIMS), F.lit(10)) == 0
    made = {
        "quartiles": lambda: _quartile_start(points),
        "scatter": lambda: _estimate(points),
        "tenth": lambda: _estimate(points.where(tenth)).where(F.col("n") > 2 * k),
    }
    fits = [_cholesky(made[name](), rules, 1.0).withColumn("start", F.lit(i)) for i, name in enumerate(rules.starts)]
    few = points.select("g").distinct().count() * len(fits) <= SMALL_ROWS
    sent = F.broadcast if few else lambda df: df
    fit = sent(stash(functools.reduce(DataFrame.unionByName, fits), "mcd"))
    for _ in range(rules.steps):
        near = points.join(fit, "g").select("g", "start", *DIMS, _bin(_distance([F.col(d) for d in DIMS])).alias("bin"))
        edge = sent(_quantile_bins(near, ["g", "start"], rules.cover))
        fit = sent(stash(_cholesky(_estimate(near.join(edge, ["g", "start"]).where("bin <= edge"), "start"), rules, consistency(rules.cover, k), "start"), "mcd"))
    volume = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, k)), F.log(F.col("l00")))
    names = [c for c in fit.columns if c not in ("g", "start")]
    return fit.groupBy("g").agg(F.min(F.struct(volume.alias("volume"), "start", *names)).alias("best")).select("g", *[f"best.{n}" for n in names])


def chi2_cdf(x: float, d: int) -> float:
    """Of an odd number of degrees of freedom, by recurrence from one."""
    total = math.erf(math.sqrt(x / 2))
    for m in range(1, d, 2):
        total -= x ** (m / 2) * math.exp(-x / 2) / (2 ** (m / 2) * math.gamma(m / 2 + 1))
    return total


def chi2_quantile(q: float, d: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < q else (low, mid)
    return low


def consistency(cover: float, dims: int) -> float:
    """Factor that makes the scatter of the nearest ``cover`` share of a normal sample equal
    to the whole scatter: cover / P(chi2(dims + 2) <= q), with q the quantile of chi2(dims)."""
    return cover / chi2_cdf(chi2_quantile(cover, dims), dims + 2)


def judge(stats: DataFrame, rules: Rules = Rules(), p: str = "") -> DataFrame:
    """Adds base_failed, distance2, cutoff (both null where no document passes the base rules)
    and kept to a table of statistics with lang and source."""
    grouped = with_group(stats, rules, p)
    points = stash(grouped.where(~base_failed(rules, p)).select(F.explode("rests").alias("g"), *[c.alias(d) for c, d in zip(transformed(p), DIMS, strict=True)]), "points")
    fit = _small(mcd_estimates(points, rules).withColumnRenamed("n", "fitted"))
    near = points.join(fit, "g").select("g", _bin(_distance([F.col(d) for d in DIMS])).alias("bin"))
    reach = F.pow(2.0, (F.col("edge") + 1) / _BIN) - 1  # the upper edge of the bin
    k = len(DIMS)
    wide = F.greatest(reach / chi2_quantile(rules.spread, k), F.lit(1.0))
    cutoffs = _quantile_bins(near, ["g"], rules.spread).select("g", (wide * chi2_quantile(1 - rules.tail, k)).alias("cutoff"))
    out = grouped.join(fit, "g", "left").join(_small(cutoffs), "g", "left")
    out = out.withColumn("distance2", _distance(transformed(p))).withColumn("base_failed", base_failed(rules, p))
    out = out.drop("rests")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= F.col("cutoff"), F.lit(True)))


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance2 and kept."""
    stats = stash(text_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "stats")
    return judge(stats, rules)


def good_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. A verdict rests on text,
    lang and source, so rows are matched by these."""
    same = [F.xxhash64(blank(F.col("text"))), null_key("lang", "source")]
    plain = docs.select(same[0].alias("_text"), same[1].alias("_place"), "lang", "source", "text")
    stats = stash(text_statistics(plain).drop("text"), "stats")
    bad = judge(stats, rules).where(~F.col("kept")).select("_text", "_place").distinct()
    return docs.join(bad, (same[0] == bad["_text"]) & (same[1] == bad["_place"]), "left_anti")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
