"""Quality of notes by a sparse ensemble of rules over their statistics, compiled to Spark columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.session import cut_lineage, release

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 10_000
#: The statistics of a text, each a share or a mean so that it does not depend on length alone.
STATISTICS = (
    "chars", "words", "word_chars", "distinct_words", "lines", "distinct_lines", "upper", "digits", "symbols",
    "marks", "bars", "stops", "short_words", "repeats",
)


def with_statistics(alerts: DataFrame) -> DataFrame:
    """The alerts with a double column ``s_<name>`` for each of ``STATISTICS`` of the whole ``notes`` (null: empty)."""
    text = F.coalesce("notes", F.lit(""))
    parts = alerts.withColumn("__text", text).withColumn("__words", F.split("__text", r"[\x20\x09-\x0D]+")).withColumn(
        "__lines", F.split("__text", "\n"))

    def count(pattern: str) -> Column:
        return F.regexp_count("__text", F.lit(pattern)).cast("double")

    chars = F.greatest(F.length("__text"), F.lit(1)).cast("double")
    words = F.size("__words").cast("double")
    lines = F.size("__lines").cast("double")
    firsts = F.size(F.array_distinct("__words")).cast("double")
    return parts.withColumns({
        "s_chars": F.log1p(F.length("__text").cast("double")),
        "s_words": F.log1p(words),
        "s_word_chars": chars / words,
        "s_distinct_words": firsts / F.sqrt(words),
        "s_lines": lines / words,
        "s_distinct_lines": F.size(F.array_distinct("__lines")).cast("double") / lines,
        "s_upper": count("[A-Z]") / chars,
        "s_digits": count("[0-9]") / chars,
        "s_symbols": count(r"[#$%&*<>{}=~^@\\]") / words,
        "s_marks": count("[!?]") / words,
        "s_bars": count(r"[|;_]") / words,
        "s_stops": count("[.]") / words,
        "s_short_words": F.size(F.filter("__words", lambda w: F.length(w) <= 3)).cast("double") / words,
        "s_repeats": F.size(F.filter(
            F.zip_with("__words", F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 1, F.lit(0))),
                       lambda a, b: a == b), lambda same: same)).cast("double") / words,
    }).drop("__text", "__words", "__lines")


# ---- trees


@dataclass(frozen=True)
class Rule:
    """A conjunction: each condition is a statistic, a bound, and whether it has to be above it."""

    conditions: tuple[tuple[str, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for name, bound, above in self.conditions:
            column = x[:, STATISTICS.index(name)]
            found &= (column > bound) if above else (column <= bound)
        return found

    def column(self) -> Column:
        test = F.lit(True)
        for name, bound, above in self.conditions:
            stat = F.col(f"s_{name}")
            test = test & ((stat > bound) if above else (stat <= bound))
        return test


def _split(x: np.ndarray, gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray, least: int):
    """The best cut of the rows by second-order gain: statistic, bound; None if no cut gains."""
    best, total_g, total_h = None, gradient[rows].sum(), curve[rows].sum()
    base = total_g ** 2 / (total_h + 1.0)
    for j in range(x.shape[1]):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        value = x[order, j]
        g, h = np.cumsum(gradient[order])[:-1], np.cumsum(curve[order])[:-1]
        gain = g ** 2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
        at = np.arange(1, len(order))
        gain[(value[1:] <= value[:-1]) | (at < least) | (len(order) - at < least)] = -1.0
        if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
            k = int(gain.argmax())
            best = gain[k], j, float((value[k] + value[k + 1]) / 2)
    return best


def tree_rules(
    x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, rate: float = 0.3, least: int = 5,
) -> list[Rule]:
    """All paths from the root to an inner node or leaf of boosted trees, as rules without repetition."""
    margin = np.full(len(y), np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0)))
    rules: dict[tuple, Rule] = {}
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        nodes = [(np.arange(len(y)), ())]
        for _ in range(depth):
            after = []
            for rows, path in nodes:
                cut = _split(x, gradient, curve, rows, least) if len(rows) >= 2 * least else None
                if cut is None:
                    margin[rows] += rate * gradient[rows].sum() / (curve[rows].sum() + 1.0)
                    continue
                _, j, bound = cut
                above = x[rows, j] > bound
                for side in (False, True):
                    longer = (*path, (STATISTICS[j], bound, side))
                    rules.setdefault(tuple(sorted(longer)), Rule(longer))
                    after.append((rows[above == side], longer))
            nodes = after
        for rows, _ in nodes:
            margin[rows] += rate * gradient[rows].sum() / (curve[rows].sum() + 1.0)
    return list(rules.values())


def fit_lasso(z: np.ndarray, y: np.ndarray, strength: float, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic weights under an absolute penalty on all but the constant, by accelerated proximal steps."""
    n, k = z.shape
    design = np.hstack([z, np.ones((n, 1))])
    scale = 0.25 * np.linalg.norm(design, 2) ** 2 / n
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ v, -60, 60)))
        new = v - design.T @ (p - y) / n / scale
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - strength / scale, 0.0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return w[:k], float(w[k])


@dataclass(frozen=True)
class QualityModel:
    """Rules with their weights, and the constant."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    constant: float

    def column(self) -> Column:
        """The score as a Spark expression over the columns of ``with_statistics``."""
        total = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_quality(
    alerts: DataFrame, labels: DataFrame, trees: int = 12, depth: int = 3, strength: float = 0.001,
    max_rows: int = MAX_ROWS,
) -> QualityModel:
    """Fit on alerts (``id, notes``) that ``labels`` (``id, quality`` 0 or 1) marks.

    Uses ``max_rows`` labelled rows at most, those with the smallest hash of
    their id; other labels than 0 and 1 are passed over. Boosted trees of
    ``depth`` over the statistics give candidate rules, a lasso of ``strength``
    picks few of them and weighs them. Without labelled rows of both classes the
    model is the share of good rows.
    """
    marked = labels.filter("quality in (0, 1) and id is not null").select(
        F.col("id").alias("__label_id"), F.col("quality").cast("int").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("__label_id"), "__label_id", "quality").limit(max_rows)
    # broadcast: max_rows narrow rows at most
    sample = cut_lineage(with_statistics(
        alerts.select("id", "notes").join(F.broadcast(chosen), F.col("id") == F.col("__label_id"))
        .select("id", "notes", "quality")).drop("notes"))
    rows = sorted(sample.select("quality", *[f"s_{s}" for s in STATISTICS]).collect())
    release(sample)
    y = np.array([r[0] for r in rows], np.float64)
    good = int(y.sum())
    if not good or good == len(y):
        return QualityModel((), (), float(np.log((good + 1.0) / (len(y) - good + 1.0))))
    x = np.array([r[1:] for r in rows], np.float64)
    rules = tree_rules(x, y, trees, depth)
    if not rules:  # too few rows for a cut
        return QualityModel((), (), float(np.log((good + 1.0) / (len(y) - good + 1.0))))
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    weights, constant = fit_lasso(z, y, strength)
    kept = [at for at in np.argsort(-np.abs(weights), kind="stable") if weights[at]]
    return QualityModel(tuple(rules[at] for at in kept), tuple(float(weights[at]) for at in kept), constant)


def score_quality(alerts: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The alerts with ``score`` (0 to 1, higher: likelier good) and ``predicted`` (1 from ``threshold`` on).

    Reads whole ``notes`` (null: empty) and nothing else, in DataFrame
    expressions throughout; all columns are handed on, those named like the two
    new ones or the statistics (``s_...``) are replaced.
    """
    plain = alerts.drop("score", "predicted", *[f"s_{s}" for s in STATISTICS])
    return with_statistics(plain).withColumn("score", model.column()).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
    ).drop(*[f"s_{s}" for s in STATISTICS])


def describe(model: QualityModel) -> Sequence[str]:
    """The rules as text, heaviest first."""
    return [
        f"{w:+.3f} if " + " and ".join(f"{n} {'>' if above else '<='} {b:.4g}" for n, b, above in r.conditions)
        for r, w in zip(model.rules, model.weights, strict=True)]
