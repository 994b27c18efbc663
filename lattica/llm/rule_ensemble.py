"""Quality classifier: a sparse ensemble of conjunctive rules taken from trees, with lasso logistic weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import apart, checkpointed, lowest_hashes, map_texts, remainder, table

#: Statistics of a text, in the order of `text_statistics`.
STATISTICS = ("chars", "words", "upper", "digits", "symbols", "exclaims", "pipes", "dup_lines", "line_chars", "word_chars", "distinct_words", "same_as_last", "stops", "commas", "ascii", "top_word")
#: Labelled rows that are fitted at most, the ones of the lowest hashes of their ids.
MAX_TRAINING_ROWS = 20_000


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and the STATISTICS (double) of each whole text; shares are of its bytes, lines or words."""
    upper, lower, digit = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
    symbol = np.frombuffer(b"#*$%&|<>@^~=_{}[]\\", np.uint8)

    def measure(texts: list[str]):
        out = np.zeros((len(texts), len(STATISTICS)))
        for i, text in enumerate(texts):
            raw = text.encode()
            if not raw:
                continue
            n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            words, lines = raw.split(), raw.split(b"\n")
            nw = max(1, len(words))
            seen: dict = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            letters = max(1, n[upper].sum() + n[lower].sum() + n[128:].sum())
            out[i] = (
                len(text), len(words), n[upper].sum() / letters, n[digit].sum() / len(raw), n[symbol].sum() / len(raw), n[33] / len(raw), n[124] / len(raw),
                1 - len(set(lines)) / len(lines), len(text) / len(lines), len(raw) / nw, len(seen) / nw, sum(a == b for a, b in zip(words, words[1:], strict=False)) / nw,
                n[46] / nw, n[44] / nw, n[:128].sum() / len(raw), max(seen.values(), default=0) / nw,
            )
        return list(out.T.copy())

    return map_texts(docs, keep, text_col, measure, ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds on statistics: (statistic, above, bound); above False means at most the bound."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, bound in self.bounds:
            v = x[:, STATISTICS.index(name)]
            out &= v > bound if above else v <= bound
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, bound in self.bounds:
            out = out & ((F.col(name) > bound) if above else (F.col(name) <= bound))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1, as one Spark expression over the STATISTICS."""
        total = F.lit(self.intercept)
        for rule, w in self.weights:
            total = total + F.when(rule.column(), w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, found: list, step: np.ndarray, least: int) -> None:
    """Grows one regression tree on gradients; every node below the root gives a rule. `step` gets the leaves' values."""
    if path:
        found.append(path)
    step[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
    if not depth or len(rows) < 2 * least:
        return
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        b = np.searchsorted(edges, x[rows, f], "left")
        n, sg, sh = (np.cumsum(np.bincount(b, weights=w, minlength=len(edges) + 1))[:-1] for w in (np.ones(len(rows)), g[rows], h[rows]))
        gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
        gain[(n < least) | (len(rows) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, float(edges[k]))
    if best[1] is None:
        return
    _, f, bound = best
    low = x[rows, f] <= bound
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _tree(x, cuts, g, h, part, depth - 1, (*path, (STATISTICS[f], above, bound)), found, step, least)


def _rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int) -> list[Rule]:
    """The distinct rules of boosted trees of logistic loss; trees differ in depth."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    margin, paths = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _tree(x, cuts, y - p, np.maximum(p * (1 - p), 1e-4), np.arange(len(y)), 1 + (t + depth - 1) % depth, (), paths, step, max(5, len(y) // 1000))
        margin += 0.3 * step
    rules, seen = [], set()
    for path in paths:
        rule = Rule(tuple(sorted(path)))
        key = rule.holds(x).tobytes()
        if key not in seen:
            seen.add(key)
            rules.append(rule)
    return rules


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleEnsemble:
    """Rules from trees over `x` (rows of STATISTICS), weighted by lasso logistic regression (accelerated proximal gradient).

    With one class only, or no row, the result is a constant near that class (0.5 without rows).
    """
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(0.0 if not len(y) else 4.0 if y[0] else -4.0, ())
    rules = _rules(x, y, trees, depth)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)
    spread = np.maximum(a.std(axis=0), 1e-3)
    mean = a.mean(axis=0)
    z = (a - mean) / spread
    rate = 4 * len(y) / np.linalg.norm(z.T @ z, 2)
    w, v, c, d, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 0.0, 1.0
    d = c
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + d))) - y
        new = v - rate * (z.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        c2 = d - 4 * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, d = new + (t - 1) / t2 * (new - w), c2 + (t - 1) / t2 * (c2 - c)
        w, c, t = new, c2, t2
    real = w / spread
    return RuleEnsemble(float(c - (real * mean).sum()), tuple((r, float(k)) for r, k in zip(rules, real, strict=True) if k))


def fit_labels(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> RuleEnsemble:
    """The ensemble of the rows of `docs` (id, text) with a label in `labels` (id, label) outside fold `held` of `folds`, at most `max_rows` of them.

    The ids are picked first (the lowest hashes of those that have both a text and a label), so that only
    their texts are measured.  A repeated label row counts once.
    """
    train = labels.where(F.col("label").isNotNull() & (remainder("id", folds) != held)).select("id", F.col("label").cast("double").alias("label")).distinct()
    ids = checkpointed(docs.select("id").distinct().join(train, "id", "left_semi"))
    ids = checkpointed(lowest_hashes(ids, "id", max_rows))
    stats = text_statistics(docs.join(F.broadcast(ids), "id", "left_semi"), ["id"])  # max_rows ids at most
    rows = stats.join(train.join(F.broadcast(ids), "id", "left_semi"), "id").orderBy(F.xxhash64(F.col("id").cast("string")), *STATISTICS, "label").limit(max_rows).drop("id").toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, max_rows: int) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns renamed apart, and `score`."""
    rows, back = apart(docs)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    model = fit_labels(rows.select(F.col(back[id_col]).alias("id"), F.col(back[text_col]).alias("text")), known, folds, held, max_rows)
    return text_statistics(rows, list(back.values()), back[text_col]).withColumn("score", model.score()), back


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The id, held_out, score and predicted of every row.

    Labels are learned from rows outside fold `held` of `folds` (crc32 of the id's text), at most
    `max_rows` of them.  Rows with a null label or a null id are not learned from; a repeated label row counts
    once.  Null and empty texts have all statistics 0 and are scored like others; very long texts are
    measured whole; a score of exactly 0.5 predicts 1; an empty table gives an empty result, and without
    labels every score is 0.5.  Other columns may have any names.
    """
    out, back = _scored(docs.select(id_col, text_col), labels, id_col, text_col, label_col, folds, held, max_rows)
    return out.select(F.col(back[id_col]).alias(id_col), (remainder(back[id_col], folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """`docs` without the rows that `classify` predicts 0 for; all columns, whatever their names."""
    rows, back = _scored(docs, labels, id_col, text_col, label_col, folds, held, max_rows)
    return rows.where(F.col("score") >= 0.5).select(*(F.col(v).alias(c) for c, v in back.items()))


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
