"""Quality rules: fixed rules per document, then robust multivariate outliers per language and source.

The minimum covariance determinant (MCD) of a group is the mean and covariance of the part of its documents whose
covariance has the least determinant. It is sought by concentration steps: measure all distances, keep the nearest part,
estimate anew. Three starts, all around the coordinatewise medians, take two steps each; the one of the least determinant
goes on until it settles. Everything is a DataFrame operation: a step is one aggregate of counts, sums and products per
group and bin of distance, so a group of any size is spread over all tasks and what follows is a small table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import no_space, whole_text, words_of
from pulsegrid.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
AXES = ["length", "symbols", "lines", "repeats"]
NOISE = [*(f"noise{i}" for i in range(len(AXES))), "together"]
PAIRS = [(i, j) for i in range(len(AXES)) for j in range(i + 1)]


@dataclass
class OutlierParams:
    """`part` of a group's documents is trusted. `rare` is the share of normal documents beyond the bound, were they
    Gaussian. `prior` documents of the language's estimate stand beside a group's own, so a small group leans on its
    language. `least` are the smallest deviations that count, per axis."""

    part: float = 0.75
    rare: float = 1e-3
    prior: float = 20.0
    least: tuple[float, ...] = (0.05, 0.3, 0.5, 0.5)
    first_steps: int = 2
    steps: int = 20
    settled: float = 1e-4


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), whole_text(text_col).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id", "lang", "source", F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("words"),
        F.length(no_space(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: no_space(x) != "").alias("lines"),
    )
    places = F.sequence(F.lit(0), F.size("words") - WINDOW)
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(places, window)).otherwise(
            F.array().cast("array<bigint>")).alias("windows"),
    )
    # Only texts with a repeated window go further: its places, sorted, and what they cover.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    kind = "array<struct<h:bigint,i:int>>"
    rows = rows.withColumn("sorted", F.when(repeated, placed).otherwise(F.array().cast(kind))).drop("windows")
    hash_at = lambda k: F.get("sorted", k)["h"]
    twice = F.filter(F.transform("sorted", lambda s, k: F.when(
        F.coalesce((s["h"] == hash_at(k - 1)) | F.lit(False), F.lit(False)) | F.coalesce(s["h"] == hash_at(k + 1), F.lit(False)),
        s["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("places", F.array_sort(twice)).drop("sorted")
    covers = F.transform("places", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - i, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)).drop("places")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def transformed(base: DataFrame) -> DataFrame:
    """Adds AXES: logarithms of mean word length and of the rates of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return base.withColumns({
        "length": F.log(chars / n), "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "lines": F.log1p(1000 * F.col("n_dup_lines") / n), "repeats": F.log1p(100 * F.col("n_repeat_words") / n),
    })


def with_noise(rows: DataFrame, p: OutlierParams) -> DataFrame:
    """Adds NOISE, the variance of each axis that a text's shortness explains, as measured in its language.

    One symbol, repeated line or passage said twice moves a short text far. The documents of a length class (a power of
    two of words) that have any are a binomial draw; its variance is in units of one such event, so documents with many
    do not widen it. A passage said twice is often a line said twice: `together` is the correlation of the two draws.
    A mean word length varies by 1/n_words, with the factor of the median document.
    """
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    one = {"symbols": F.log1p(100 / chars), "lines": F.log1p(1000 / n), "repeats": F.log1p(100 * F.least(F.lit(2 * WINDOW), n) / n)}
    rows = rows.withColumns({"language": F.xxhash64(F.struct("lang", F.col("lang").isNull())), "class": F.floor(F.log2(n))})
    passed = rows.where("NOT base_failed")
    seen = {a: F.col(a) > 0 for a in one} | {"both": (F.col("lines") > 0) & (F.col("repeats") > 0)}
    counts = [F.count(F.lit(1)).alias("size"), *(F.count_if(seen[a]).alias(f"any_{a}") for a in seen)]
    of_class = passed.groupBy("language", "class").agg(*counts)
    of_lang = of_class.groupBy("language").agg(*(F.sum(c).alias(f"all_{c}") for c in of_class.columns[2:]))
    share = lambda a: (F.col(f"any_{a}") + p.prior * F.col(f"all_any_{a}") / F.col("all_size")) / (F.col("size") + p.prior)
    shares = of_class.join(of_lang, "language").select("language", "class", *(share(a).alias(f"share_{a}") for a in seen))
    mid = lower_part(passed, ["language"], F.floor(F.col("length") * 512), 0.5).select("language", (F.col("bound") / 512).alias("mid"))
    off = F.sqrt(n) * F.abs(F.col("length") - F.col("mid"))
    off = lower_part(passed.join(mid, "language"), ["language"], F.floor(off * 64), 0.5).select("language", ((F.col("bound") + 1) / 64 * 1.4826).alias("off"))
    out = rows.join(shares, ["language", "class"], "left").join(off, "language", "left")
    draw = lambda a: F.col(f"share_{a}") * (1 - F.col(f"share_{a}"))
    shared = F.col("share_both") - F.col("share_lines") * F.col("share_repeats")
    together = F.try_divide(shared, F.sqrt(draw("lines") * draw("repeats")))
    noise = [F.col("off") ** 2 / n, *(draw(a) * one[a] ** 2 for a in AXES[1:]), together]
    return out.select(*rows.columns[:-2], *(F.coalesce(v, F.lit(0.0)).alias(c) for c, v in zip(NOISE, noise)))


def _settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later ones build on. Exploding an array of one keeps the optimizer from writing each out again
    wherever it is used, which made plans of hundreds of thousands of characters."""
    held = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_held")
    return df.select("*", held).select("*", "_held.*").drop("_held")


def distances(rows: DataFrame, estimates: DataFrame, p: OutlierParams) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by a Cholesky factor made column by column, and `start` if estimates
    have it.

    NOISE, if the rows have it, makes up what a group's variance without its floor lacks of it.
    """
    out = rows.join(estimates, "g")
    noisy = NOISE[0] in rows.columns
    lacks = lambda i: F.greatest(F.col(NOISE[i]) - (F.col(f"c{i}{i}") - p.least[i] ** 2), F.lit(0.0))

    def cov(i: int, j: int) -> Column:
        value = F.col(f"c{i}{j}")
        if noisy and i == j:
            value = value + lacks(i)
        elif noisy and (AXES[i], AXES[j]) == ("repeats", "lines"):
            value = value + F.col("together") * F.sqrt(lacks(i) * lacks(j))
        return value

    for j, axis in enumerate(AXES):
        less = lambda i: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = _settle(out, {f"l{j}{j}": F.sqrt(F.greatest(cov(j, j) - less(j), F.lit(p.least[j] ** 2 / 4)))})
        turned = F.col(axis) - F.col(f"m{j}") - sum((F.col(f"l{j}{k}") * F.col(f"z{k}") for k in range(j)), F.lit(0.0))
        below = {f"l{i}{j}": (cov(i, j) - less(i)) / F.col(f"l{j}{j}") for i in range(j + 1, len(AXES))}
        out = _settle(out, below | {f"z{j}": turned / F.col(f"l{j}{j}")})
    total = sum((F.col(f"z{i}") ** 2 for i in range(1, len(AXES))), F.col("z0") ** 2)
    return out.withColumn("d2", total).select(*rows.columns, *(c for c in ["start"] if c in estimates.columns), "d2")


def lower_part(rows: DataFrame, group: list[str], bin_: Column, part: float) -> DataFrame:
    """Per group the least bin up to which at least `part` of its rows lie. Bins are few, whatever the group's size."""
    bins = rows.groupBy(*group, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*group).orderBy("bin")
    bins = bins.select(*group, "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("all"))
    return bins.where(F.col("upto") >= part * F.col("all")).groupBy(*group).agg(F.min("bin").alias("bound"))


_SUMS = [f"s{i}" for i in range(len(AXES))] + [f"q{i}{j}" for i, j in PAIRS]


def sums_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and sums of products of the AXES."""
    product = lambda i, j: F.col(AXES[i]) * F.col(AXES[j])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(a).alias(f"s{i}") for i, a in enumerate(AXES)),
        *(F.sum(product(i, j)).alias(f"q{i}{j}") for i, j in PAIRS))


def estimates_of(sums: DataFrame, p: OutlierParams) -> DataFrame:
    """Mean and regularised covariance per group g and start, each group beside `prior` rows of its language."""
    sums = sums.groupBy("g", "lang", "start").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    of_lang = sums.groupBy(F.col("lang").alias("_lang"), F.col("start").alias("_start")).agg(
        F.sum("n").alias("in_lang"), *(F.sum(c).alias(f"t{c}") for c in _SUMS))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("start") == F.col("_start"))
    both = sums.join(of_lang, same).select(
        "g", "start", (F.col("n") + p.prior).alias("size"),
        *((F.col(c) + p.prior * F.col(f"t{c}") / F.col("in_lang")).alias(c) for c in _SUMS))
    mean = lambda i: F.col(f"s{i}") / F.col("size")
    cov = lambda i, j: F.col(f"q{i}{j}") / F.col("size") - mean(i) * mean(j) + (p.least[i] ** 2 if i == j else 0.0)
    return both.select(
        "g", "start", *(mean(i).alias(f"m{i}") for i in range(len(AXES))), *(cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS))


def moments(rows: DataFrame, p: OutlierParams) -> DataFrame:
    """`estimates_of` all given rows (g, lang, AXES)."""
    return estimates_of(sums_of(rows.withColumn("start", F.lit(0)), ["g", "lang", "start"]), p).drop("start")


def chi2(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_at(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if chi2((low + high) / 2, dof) > share else ((low + high) / 2, high)
    return low


def spread(estimates: DataFrame, p: OutlierParams) -> DataFrame:
    """The covariance of the nearest part is too small; the factor makes it that of all, for Gaussian rows."""
    dof = len(AXES)
    factor = p.part / chi2(chi2_at(p.part, dof), dof + 2)
    grown = {f"c{i}{j}": (F.col(f"c{i}{j}") - (p.least[i] ** 2 if i == j else 0)) * factor + (p.least[i] ** 2 if i == j else 0)
             for i, j in PAIRS}
    return estimates.withColumns(grown)


def determinants(estimates: DataFrame, p: OutlierParams) -> DataFrame:
    """Adds `logdet` of the covariance, by the same factor."""
    out = estimates
    for j in range(len(AXES)):
        less = lambda i: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = _settle(out, {f"l{j}{j}": F.sqrt(F.greatest(F.col(f"c{j}{j}") - less(j), F.lit(p.least[j] ** 2 / 4)))})
        below = {f"l{i}{j}": (F.col(f"c{i}{j}") - less(i)) / F.col(f"l{j}{j}") for i in range(j + 1, len(AXES))}
        out = _settle(out, below) if below else out
    logdet = sum((2 * F.log(f"l{j}{j}") for j in range(1, len(AXES))), 2 * F.log("l00"))
    return out.select(*estimates.columns, logdet.alias("logdet"))


def starts(rows: DataFrame, p: OutlierParams) -> DataFrame:
    """Three first estimates per group, around its medians (to 1/64): with the median deviations alone, with the covariance
    of values drawn in to 2.5 deviations, and with that of the directions in which rows lie."""
    stacked = rows.select("g", F.posexplode(F.array(*AXES)).alias("axis", "x"))
    mid = lower_part(stacked, ["g", "axis"], F.floor(F.col("x") * 64), 0.5).select("g", "axis", (F.col("bound") / 64).alias("mid"))
    mid = materialize(mid, "medians")
    off = lower_part(stacked.join(mid, ["g", "axis"]), ["g", "axis"], F.floor(F.abs(F.col("x") - F.col("mid")) * 64), 0.5)
    off = off.select("g", "axis", ((F.col("bound") + 1) / 64 * 1.4826).alias("off")).join(mid, ["g", "axis"])
    pick = lambda c, i: F.max(F.when(F.col("axis") == i, F.col(c)))
    centre = materialize(off.groupBy("g").agg(
        *(pick("mid", i).alias(f"m{i}") for i in range(len(AXES))), *(pick("off", i).alias(f"d{i}") for i in range(len(AXES)))), "centres")
    z = [(F.col(a) - F.col(f"m{i}")) / F.col(f"d{i}") for i, a in enumerate(AXES)]
    near = _settle(rows.join(centre, "g"), {f"z{i}": v for i, v in enumerate(z)})
    far = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(1, len(AXES))), F.col("z0") ** 2))
    drawn = {f"w{i}": F.greatest(F.least(F.col(f"z{i}"), F.lit(2.5)), F.lit(-2.5)) for i in range(len(AXES))}
    turned = {f"u{i}": F.when(far > 0, F.col(f"z{i}") / far).otherwise(0.0) for i in range(len(AXES))}
    near = _settle(near, drawn | turned)
    size = F.count(F.lit(1))
    shape = near.groupBy("g").agg(
        *((F.sum(F.col(f"w{i}") * F.col(f"w{j}")) / size - F.avg(f"w{i}") * F.avg(f"w{j}")).alias(f"w{i}{j}") for i, j in PAIRS),
        *((F.sum(F.col(f"u{i}") * F.col(f"u{j}")) / size * len(AXES)).alias(f"u{i}{j}") for i, j in PAIRS)).join(centre, "g")
    floor = lambda i, j: F.lit(p.least[i] ** 2 if i == j else 0.0)
    scaled = lambda kind, i, j: F.col(f"{kind}{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}") + floor(i, j)
    alone = lambda i, j: (F.col(f"d{i}") ** 2 if i == j else F.lit(0.0)) + floor(i, j)
    forms = [alone, lambda i, j: scaled("w", i, j), lambda i, j: scaled("u", i, j)]
    every = F.array(*(F.struct(F.lit(k).alias("start"), *(form(i, j).alias(f"c{i}{j}") for i, j in PAIRS)) for k, form in enumerate(forms)))
    return shape.select("g", *(f"m{i}" for i in range(len(AXES))), F.explode(every).alias("e")).select(
        "g", "e.start", *(f"m{i}" for i in range(len(AXES))), *(f"e.c{i}{j}" for i, j in PAIRS))


def concentrated(rows: DataFrame, now: DataFrame, p: OutlierParams) -> DataFrame:
    """Estimates of the part of each group that lies nearest by the estimates `now`. Bins of distance stand for their
    rows, so the part may be larger by one bin."""
    binned = distances(rows, now, p).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 32))
    sums = materialize(sums_of(binned, ["g", "lang", "start", "bin"]), "mcd-bins")
    upto = Window.partitionBy("g", "start").orderBy("bin", "lang")
    whole = Window.partitionBy("g", "start")
    placed = sums.withColumns({"upto": F.sum("n").over(upto) - F.col("n"), "all": F.sum("n").over(whole)})
    nearest = placed.where(F.col("upto") < p.part * F.col("all"))
    return materialize(determinants(spread(estimates_of(nearest, p), p), p), "mcd")


def estimate(rows: DataFrame, p: OutlierParams) -> DataFrame:
    """MCD of every group g of `rows` (g, lang, AXES, and NOISE if measured)."""
    now = materialize(starts(rows, p), "mcd")
    for _ in range(p.first_steps):
        now = concentrated(rows, now.drop("logdet"), p)
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("best")).select("g", "best.start")
    now, last = materialize(now.join(best, ["g", "start"]), "mcd"), None
    for _ in range(p.steps - p.first_steps):
        size = now.agg(F.sum("logdet"), F.count(F.lit(1))).first()
        if last is not None and abs(last - (size[0] or 0)) <= p.settled * max(size[1], 1):
            break
        last = size[0] or 0
        now = concentrated(rows, now.drop("logdet"), p)
    return now.drop("logdet", "start")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    p: OutlierParams = OutlierParams(),
) -> DataFrame:
    """Base statistics, base_failed, outlier_distance and kept of every document.

    A document is kept if it does not fail the base rules (at least 20 words, at most 30 % of them in repeated windows)
    and its distance from the estimate of its language and source is within the bound. Estimates use all documents that
    pass the base rules. A null language or source is a group like any other. Null texts have no words and fail. Rows
    repeated are rated alike; an empty table gives an empty result. Texts are read once, whole.
    """
    base = base_rules(docs, id_col, text_col, lang_col, source_col)
    base = materialize(transformed(base).withColumn("g", F.xxhash64(
        F.struct("lang", F.col("lang").isNull(), "source", F.col("source").isNull()))), "quality-rules")
    base = materialize(with_noise(base, p), "quality-noise")
    passed = base.where("NOT base_failed").select("g", "lang", *AXES, *NOISE)
    rated = distances(base, estimate(passed, p), p)
    out = base.columns[:base.columns.index("base_failed") + 1]
    limit = chi2_at(1 - p.rare, len(AXES))
    fine = rated.where("NOT base_failed").select(*out, F.col("d2").alias("outlier_distance"), (F.col("d2") <= limit).alias("kept"))
    failed = base.where("base_failed").select(*out, F.lit(None).cast("double").alias("outlier_distance"), F.lit(False).alias("kept"))
    return fine.unionByName(failed)
