"""Quality classifier: an ensemble of rules over text statistics, with lasso logistic weights.

Small trees are boosted on a bounded sample of labelled rows; every path from a root is a rule, a conjunction of
comparisons. A logistic model with an L1 penalty gives most rules the weight 0. The rest become one Spark column, so
scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import whole_text, words_of
from pulsegrid.session import materialize

FEATURES = [
    "log_words", "word_length", "symbols", "bangs", "bars", "capitals", "digits", "stops", "distinct_words",
    "repeated_lines", "line_words",
]


@dataclass
class FitParams:
    """`fit_rows` bounds the labelled rows that are fitted: those whose ids have the smallest hashes."""

    fit_rows: int = 20_000
    bins: int = 64
    depth: int = 3
    trees: int = 40
    learning_rate: float = 0.3
    min_leaf: int = 10
    penalty: float = 0.001
    steps: int = 1500
    folds: int = 5
    threshold: float = 0.3


def held_out(id_col: str, folds: int = 5) -> Column:
    """Rows that no model sees; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The statistics of every whole text, as doc_id and FEATURES; with `carry` also the input row, as a struct `row`."""
    row = [F.struct("*").alias("row")] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *row)
    row = ["row"] if carry else []
    full = F.col("text")
    base = base.select(
        "doc_id", *row, "text", words_of(full).alias("words"), F.length(full).cast("double").alias("chars"),
        F.filter(F.split(full, "\n"), lambda x: F.trim(x) != "").alias("lines"),
    )
    n, lines = F.size("words").cast("double"), F.size("lines").cast("double")
    per_char = lambda count: count / F.greatest("chars", F.lit(1.0))
    among = lambda chars: per_char(F.col("chars") - F.length(F.translate(full, chars, "")))
    return base.select(
        "doc_id", *row,
        F.log1p(n).alias("log_words"),
        (F.length(F.array_join("words", "")) / F.greatest(n, F.lit(1.0))).alias("word_length"),
        among("#*$%&<>").alias("symbols"), among("!").alias("bangs"), among("|").alias("bars"),
        per_char(F.regexp_count(full, F.lit("\\p{Lu}"))).alias("capitals"),
        among("0123456789").alias("digits"), among(".,;:?").alias("stops"),
        (F.size(F.array_distinct("words")) / F.greatest(n, F.lit(1.0))).alias("distinct_words"),
        (F.lit(1.0) - F.size(F.array_distinct("lines")) / F.greatest(lines, F.lit(1.0))).alias("repeated_lines"),
        (n / F.greatest(lines, F.lit(1.0))).alias("line_words"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, bound): x > bound, or else x <= bound


def grow(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, p: FitParams):
    """One tree on binned features by second-order gain. Gives its rules and the step for every row."""
    rules, step = [], np.zeros(len(slope))

    def split(rows: np.ndarray, path: Rule):
        g, h = slope[rows].sum(), weight[rows].sum()
        step[rows] = g / (h + 1.0)
        if path:
            rules.append(path)
        if len(path) == p.depth or len(rows) < 2 * p.min_leaf:
            return
        best = (1e-6, -1, -1)
        for j, edge in enumerate(edges):
            if not len(edge):
                continue
            b = bins[rows, j]
            size, gs, hs = (np.bincount(b, w, len(edge) + 1).cumsum()[:-1] for w in (None, slope[rows], weight[rows]))
            fits = (size >= p.min_leaf) & (len(rows) - size >= p.min_leaf)
            gain = np.where(fits, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), j, k))
        gain, j, k = best
        if j >= 0:
            low = bins[rows, j] <= k
            split(rows[low], (*path, (j, False, float(edges[j][k]))))
            split(rows[~low], (*path, (j, True, float(edges[j][k]))))

    split(np.arange(len(slope)), ())
    return rules, step


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > bound) == above for j, above, bound in rule])


def fit(x: np.ndarray, y: np.ndarray, p: FitParams) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules. Without rows the score is a half; with one class only it is that class's share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return intercept, []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    found: dict[Rule, None] = {}
    raw = np.full(len(y), intercept)
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-raw))
        rules, step = grow(bins, edges, y - prob, prob * (1 - prob), p)
        found |= dict.fromkeys(rules)
        raw += p.learning_rate * step
    rules = list(found)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    keep = np.flatnonzero((z.mean(axis=0) > 0) & (z.mean(axis=0) < 1))
    rules, z = [rules[k] for k in keep], z[:, keep]
    # Proximal gradient with momentum; the intercept bears no penalty.
    z1 = np.hstack([z, np.ones((len(z), 1))])
    rate = 4 * len(z) / np.linalg.norm(z1, 2) ** 2
    w = np.append(np.zeros(len(rules)), intercept)
    ahead, t = w, 1.0
    for _ in range(p.steps):
        grad = z1.T @ (1 / (1 + np.exp(-z1 @ ahead)) - y) / len(y)
        new = ahead - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * p.penalty, 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (was - 1) / t * (new - w), new
    return float(w[-1]), [(r, float(c)) for r, c in zip(rules, w) if c]


def compiled(intercept: float, rules: list[tuple[Rule, float]], names: list[str]) -> Column:
    """The probability of label 1 as one column over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for j, above, bound in rule:
            test &= (F.col(names[j]) > bound) if above else (F.col(names[j]) <= bound)
        total += F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality", p: FitParams = FitParams()):
    """Fit on the labelled rows that are not held out. Labels that are null or of unknown ids are passed over; of
    labels repeated for one id the least counts."""
    known = labels.where(~held_out("doc_id", p.folds)).groupBy("doc_id").agg(F.min(label_col).cast("double").alias("y"))
    known = known.where("y IS NOT NULL")
    # Thinned first by hash, so that tasks send the driver about as many rows as are fitted, however many there are.
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, known.count() // (2 * p.fit_rows)))) == 0)
    rows = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.fit_rows)
    got = rows.select(*FEATURES, "y").toPandas().to_numpy(dtype=float)
    return fit(got[:, :-1], got[:, -1], p)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    p: FitParams = FitParams(),
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score reaches the threshold) for every document.

    The statistics are computed once, over whole texts, and written; the model is fitted on at most `p.fit_rows` of
    them on the driver. Labels, ids and all columns other than the text are no inputs of a score. A null text is
    empty and gets a score like any other; repeated rows each get one; an empty table gives an empty result.
    """
    stats = materialize(statistics(docs, id_col, text_col), "quality-statistics")
    model = learn(stats, labels, label_col, p)
    scored = stats.select("doc_id", held_out("doc_id", p.folds).alias("held_out"), compiled(*model, FEATURES).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: FitParams = FitParams(),
) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns.

    The statistics are recomputed in the pass that filters, which is cheaper than a shuffle of all texts.
    """
    model = learn(materialize(statistics(docs, id_col, text_col), "quality-statistics"), labels, p=p)
    rated = statistics(docs, id_col, text_col, carry=True)
    return rated.where(compiled(*model, FEATURES) >= p.threshold).select("row.*")
