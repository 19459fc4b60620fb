"""Quality: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Statistics of a text are Spark expressions. Boosted trees, fitted in numpy to a bounded sample of labelled rows, propose
rules: every path from a root is a conjunction of bounds on statistics. A logistic regression with a lasso penalty keeps
few of them. Their sum, again a Spark expression, scores whole texts inside the JVM; no text goes to Python.

The sample: at most `most` labelled rows, first by a hash of their ids; only their statistics reach the driver.

Defined cases: null, empty and word-less texts have all statistics 0; rows that repeat are scored one by one; labels that
are null or neither 0 nor 1 are not learned from; a label without a document does nothing; without good or without bad
labels every score is the share of good ones (no labels: 0.5); a null doc_id is not held out.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, remainder, text_or_empty


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column, all doubles, none null."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(WORD))
    least_words = F.greatest(words, F.lit(1))

    def share(pattern: str) -> Column:
        """Share of characters in runs that match."""
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars

    lines = F.split(text, "\n")
    return {
        "words": words.cast("double"),
        "word_length": F.length(text) / least_words,
        "letters": share(r"\p{L}+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"[0-9]+"),
        "marks": share(r"[#$%&*|!<>{}=_~^@\\/\[\]]+"),
        "stops": share(r"[.,;:?]+"),
        "short_words": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])")) / least_words,
        "distinct_words": F.when(words > 0, F.size(F.array_distinct(F.split(text, " "))) / least_words).otherwise(0.0),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


#: A bound on one statistic: (statistic, above, limit): x > limit if above, else x <= limit. A rule is a conjunction of such.
Bound = tuple[str, bool, float]


@dataclass
class RuleEnsemble:
    rules: list[tuple[tuple[Bound, ...], float]]
    shift: float

    def score(self) -> Column:
        """Probability of the label 1, over columns named as the statistics."""
        total = F.lit(float(self.shift))
        for bounds, weight in self.rules:
            test = F.lit(True)
            for name, above, limit in bounds:
                test = test & ((F.col(name) > limit) if above else (F.col(name) <= limit))
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def odds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Log-odds in numpy, for rows of statistics."""
        total = np.full(len(next(iter(x.values()))), self.shift)
        for bounds, weight in self.rules:
            total += weight * holds(bounds, x)
        return total


def holds(bounds: tuple[Bound, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, above, limit in bounds:
        out &= (x[name] > limit) == above
    return out


def simplified(path: list[Bound]) -> tuple[Bound, ...]:
    """One bound of a kind for each statistic: the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, limit in path:
        key = (name, above)
        tight[key] = limit if key not in tight else (max if above else min)(limit, tight[key])
    return tuple(sorted((name, above, limit) for (name, above), limit in tight.items()))


def grow(x: dict[str, np.ndarray], gradient: np.ndarray, hessian: np.ndarray, cuts: dict[str, np.ndarray], depth: int, least: int) -> tuple[list[tuple[Bound, ...]], np.ndarray]:
    """One tree by second-order gain: (all paths, the leaf value of each row)."""
    value, paths = np.zeros(len(gradient)), []

    def split(rows: np.ndarray, path: list[Bound], left: int) -> None:
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, None, 0.0)
        if left:
            for name, limits in cuts.items():
                if not len(limits):
                    continue
                place = np.searchsorted(limits, x[name][rows], "left")  # rows at or below limits[k] have a place <= k
                gs, hs, ns = (np.bincount(place, w, len(limits) + 1).cumsum()[:-1] for w in (g, h, None))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), name, float(limits[k]))
        if best[1] is None:
            value[rows] = -g.sum() / (h.sum() + 1)
            return
        _, name, limit = best
        for above in (False, True):
            inner = [*path, (name, above, limit)]
            paths.append(simplified(inner))
            split(rows[(x[name][rows] > limit) == above], inner, left - 1)

    split(np.arange(len(gradient)), [], depth)
    return paths, value


def lasso_logistic(rules: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and shift that minimise the mean logistic loss plus penalty times the weights' sum, by accelerated proximal steps."""
    n, m = rules.shape
    mean = rules.mean(0)
    centred = rules - mean
    bound = 0.25 * (np.linalg.norm(centred, 2) ** 2 / n + 1)
    w, shift = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    v, v_shift, t = w, shift, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(centred @ v + v_shift, -40, 40))) - y
        step = v - centred.T @ r / n / bound
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / bound, 0)
        new_shift = v_shift - r.mean() / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_shift = new + (t - 1) / t_new * (new - w), new_shift + (t - 1) / t_new * (new_shift - shift)
        w, shift, t = new, new_shift, t_new
    return w, shift - float(mean @ w)


def train(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, least: int = 8, rate: float = 0.3, penalty: float = 1e-3) -> RuleEnsemble:
    """A rule ensemble for rows of statistics x and labels y (both kinds among them)."""
    cuts = {}
    for name, v in x.items():
        points = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
        cuts[name] = (points[1:] + points[:-1]) / 2
    odds, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        paths, value = grow(x, p - y, p * (1 - p), cuts, depth, least)
        odds = odds + rate * value
        found.update(dict.fromkeys(paths))
    if not found:
        return RuleEnsemble([], float(odds[0]))
    columns = {}
    for path in found:  # rules that hold on the same rows are one
        column = holds(path, x)
        key = column.tobytes()
        if key not in columns or len(path) < len(columns[key][0]):
            columns[key] = (path, column)
    kept = list(columns.values())
    weights, shift = lasso_logistic(np.stack([c for _, c in kept], 1).astype(float), y.astype(float), penalty)
    return RuleEnsemble([(path, float(w)) for (path, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-4], shift)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> RuleEnsemble:
    """A rule ensemble from the labels (doc_id, quality) of docs."""
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND _id IS NOT NULL")
    sample = F.broadcast(good.orderBy(F.xxhash64("_id", F.lit(12)), "_id").limit(most))  # bounded by `most`
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    names = list(statistics(F.col("text")))
    found = rows.select("_id", "quality", *(c.alias(n) for n, c in statistics(F.col("text")).items())).toPandas().sort_values(["_id", *names])
    y = found["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    return train({n: found[n].to_numpy(float) for n in names}, y)


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """row (a struct of all columns of docs), score."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", *(c.alias(n) for n, c in statistics(F.col("row.text")).items()))
    return rows.select("row", model.score().alias("score"))


def without_poor(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score is below the threshold."""
    found = scored(docs, model)
    # Spark would push a filter on the score below the statistics and work them out again at each bound; it pushes none below explode
    return found.select("row", F.explode(F.array("score")).alias("kept_score")).where(F.col("kept_score") >= threshold).select("row.*")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, kept_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels of held-out rows are not learned from."""
    model = fit(docs, labels.where(remainder(F.col("doc_id"), modulus) != kept_out))
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == kept_out, F.lit(False))
    found = scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
