"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled documents; every
path from a root to a node becomes a rule, a conjunction of comparisons. A logistic
model with a lasso penalty weighs the rules, which leaves most at zero. The others
are compiled into one Spark column expression over the statistics, so scoring is
plain column arithmetic in the JVM and reads the text once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents used for training at most.
SAMPLE = 8_000
TREES, DEPTH, BINS = 40, 3, 24
PENALTY = 0.002
PREFIX = "__quality_"


def statistics(text: str) -> dict[str, Column]:
    """Statistics of a text by name; null counts as empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    count = lambda p: F.regexp_count(body, F.lit(p)).cast("double")
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    size = F.length(body).cast("double")
    one = lambda x: F.greatest(x, F.lit(1.0))
    distinct = lambda a: F.transform(F.array(a), lambda x: F.size(F.array_distinct(x)) / one(F.size(x).cast("double")))[0]
    return {
        "size": F.log1p(size),
        "word_length": size / one(count(r"[^\x20\x09-\x0D]+")),
        "symbols": count("[#*$%&|<>]") / one(size),
        "capitals": count(r"\p{Lu}") / one(size),
        "digits": count("[0-9]") / one(size),
        "shouts": count("[!?]") / one(size),
        "stops": count("[.,;:]") / one(size),
        "distinct_words": distinct(words),
        "distinct_lines": distinct(lines),
        "line_length": size / one(count("\n") + 1),
    }


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold)


@dataclass(frozen=True)
class RuleModel:
    rules: list[tuple[float, Rule]]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the statistics columns."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, above, limit in rule:
                stat = F.col(PREFIX + name)
                holds = holds & (stat > limit if above else stat <= limit)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, residual: np.ndarray, edges: list[np.ndarray], depth: int, path: tuple, rows: np.ndarray, out: list, values: np.ndarray):
    """Split ``rows`` by the comparison that lowers the squared error most; collects
    (path) of every node below the root and fills ``values`` with leaf means."""
    best = None
    if depth and len(rows) >= 20:
        r = residual[rows]
        for k, cuts in enumerate(edges):
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, x[rows, k], "left")  # at <= j exactly when x <= cuts[j]
            n = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
            s = np.cumsum(np.bincount(at, weights=r, minlength=len(cuts) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s**2 / n + (r.sum() - s) ** 2 / (len(r) - n)
            gain[(n < 8) | (len(r) - n < 8)] = -1
            j = int(gain.argmax())
            if gain[j] > (best[0] if best else r.sum() ** 2 / len(r) + 1e-9):
                best = (gain[j], k, cuts[j])
    if best is None:
        values[rows] = residual[rows].mean() if len(rows) else 0
        return
    _, k, cut = best
    for above in (False, True):
        side = rows[(x[rows, k] > cut) == above]
        more = (*path, (k, above, float(cut)))
        out.append(more)
        _grow(x, residual, edges, depth - 1, more, side, out, values)


def _tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Paths of boosted trees, each grown on what the earlier ones left."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        values = np.zeros(len(y))
        _grow(x, residual, edges, DEPTH, (), np.arange(len(y)), rules, values)
        margin += 2.0 * values
    return list(dict.fromkeys(rules))


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated
    proximal gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    step = 4 * len(x) / np.linalg.norm(x1, 2) ** 2
    w = v = np.zeros(x1.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        new = v - step * (x1.T @ (p - y)) / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w[:-1], float(w[-1])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumns({PREFIX + k: v for k, v in statistics(text).items()})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, salt: str = "quality") -> RuleModel:
    """Learn from at most about ``sample`` labelled documents, chosen by a hash of
    their key. Null keys and labels are left out; repeated label rows count once,
    with the smaller label. Without both classes the score is 0.5 for every text.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("double").alias("__y"))
    total = marked.count()
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = marked.where(unit < min(1.0, sample / max(total, 1)))
    chosen = with_statistics(docs.select(F.col(key), F.col(text)).join(picked, key), text)
    names = list(statistics(text))
    # the sample's statistics, a few numbers for each document
    rows = chosen.select("__y", *(PREFIX + n for n in names)).toPandas().to_numpy(float)
    # one order whatever the tasks' was: sums and equal splits do not depend on it
    rows = rows[np.lexsort(rows.T)]
    y, x = rows[:, 0], rows[:, 1:]
    if not len(y) or y.min() == y.max():
        return RuleModel([], 0.0)
    rules = _tree_rules(x, y)
    weights, bias = _lasso(np.stack([_holds(x, r) for r in rules], 1).astype(float), y, PENALTY)
    kept = [(float(w), tuple((names[k], a, c) for k, a, c in r)) for w, r in zip(weights, rules, strict=True) if w]
    return RuleModel(kept, bias)


def score(docs: DataFrame, model: RuleModel, text: str = "text", column: str = "__score") -> DataFrame:
    """``docs`` with ``column``, 0 to 1; all other columns and rows stay as they are."""
    return with_statistics(docs, text).withColumn(column, model.column()).drop(*(PREFIX + n for n in statistics(text)))
